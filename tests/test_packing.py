"""Packing and typed relations against plain Python."""

import random

from tessera.operators import packing, relations


def plain(rows, most):
    out, by = {}, {}
    for k, i, n in rows:
        by.setdefault(k, []).append((i, max(0, n or 0)))
    for k, own in by.items():
        batch, used = 0, 0
        for i, n in sorted(own):
            if used and used + n > most:
                batch, used = batch + 1, 0
            used += n
            out[k, i] = batch
    return out


def test_batches(spark):
    rng = random.Random(1)
    rows = [(k, i, rng.choice([0, 0, 1, 3, 9, 10, 11, 40, None, -2])) for k in ("a", "b", None, "c") for i in range({"a": 2000, "b": 1, None: 30, "c": 50}[k])]
    rows += [("zeros", i, 0) for i in range(20)] + [("large", i, 99) for i in range(20)]
    df = spark.createDataFrame(rows, "k string, i int, n int").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that a key lies in several partitions
    try:
        assert packing.placed(df, "k", ["i"]).where("k = 'a'").selectExpr("shiftright(place, 33) AS p").distinct().count() > 1
        got = {(r.k, r.i): r.batch for r in packing.batches(df, "k", ["i"], "n", 10).collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert got == plain(rows, 10)
    assert packing.batches(df.limit(0), "k", ["i"], "n", 10).count() == 0


def test_a_large_relation_stays_small(spark):
    uris = [f"ctx://resources/a/{i:05d}" for i in range(3000)]
    rel = spark.createDataFrame([("ctx://resources", "big", "why", uris), ("ctx://resources/a", "two", "also", uris[:2] + [uris[0]])], "owner_uri string, id string, reason string, uris array<string>")
    hits = spark.createDataFrame([(u,) for u in [*uris, "ctx://resources/b/1", "ctx://resources"]], "uri string")
    rules = spark.createDataFrame([("ctx://resources", "any"), ("ctx://resources/a/00001", "one"), ("ctx://resources/a/0000", "no border")], "prefix string, object_type string")
    out = relations.edges(hits, rel, 5, rules, spark.createDataFrame([("big",)], "id string")).collect()
    by = {}
    for r in out:
        by.setdefault(r.uri, []).append(r)
    assert len(out) == 15_000 and set(by) == set(uris)
    first = sorted(by[uris[0]], key=lambda r: r.place)
    assert [(r.related[-1], r.reason, r.relation_type, r.target_type) for r in first] == [("1", "also", None, "one"), ("1", "why", "big", "one"), ("2", "why", "big", "any"), ("3", "why", "big", "any"), ("4", "why", "big", "any")]
    assert all(r.related != r.uri for r in out) and by[uris[1]][0].source_type == "one"
