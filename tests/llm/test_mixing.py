import re

import pytest

from tessera.llm import mixing


def plain_targets(sizes, weights=mixing.WEIGHTS, most=mixing.MOST_REPEATS):
    """Target of each source: its weight's share of all sizes, at most ``most`` times its own.

    Sources go by code point, null last, and take the weights in turn. What a
    source can't take is shared among the others by weight, until none is above.
    """
    order = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    out = {}
    left, active = float(sum(sizes.values())), list(order)
    while active:
        total = sum(weight[s] for s in active)
        above = [s for s in active if left * weight[s] / total > most * sizes[s]]
        if not above:
            out |= {s: left * weight[s] / total for s in active}
            break
        for s in above:
            out[s] = float(most * sizes[s])
        left -= sum(out[s] for s in above)
        active = [s for s in active if s not in above]
    return out


def test_targets_by_hand():
    assert plain_targets({"a": 100, "b": 100, "c": 100}) == {"a": 187.5, "b": 75.0, "c": 37.5}
    got = plain_targets({"a": 10, "b": 1000, None: 1000})
    assert got["a"] == 30 and got["b"] == pytest.approx(1980 * 2 / 3) and got[None] == pytest.approx(660)
    assert plain_targets({}) == {}


def test_targets_of_many_sources(spark):
    import random

    rng = random.Random(2)
    for case in range(4):
        names = [f"s{rng.randrange(10**6)}é" if i % 3 else f"S{i}" for i in range(rng.choice([1, 5, 200]))] + ([None] if case % 2 else [])
        sizes = {s: rng.choice([0, 1, 10, 1000, 100_000]) for s in names}
        df = spark.createDataFrame(list(sizes.items()), "source string, size long").repartition(3)
        got = {r.source: r.target for r in mixing.targets(mixing.weighted(df)).collect()}
        want = plain_targets(sizes)
        assert got.keys() == want.keys() and all(got[s] == pytest.approx(want[s]) for s in want)


def test_against_sorting_by_hash(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = docs.select("doc_id", "source", "text", mixing.hash_of().alias("h")).collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in rows}
    by = {}
    for r in rows:
        by.setdefault(r.source, []).append((r.h, r.doc_id))
    goal = plain_targets({s: sum(size[i] for _, i in v) for s, v in by.items()})
    out = {r.doc_id: r for r in mixing.mix(docs).collect()}
    assert len(out) == 1000
    for s, own in by.items():
        total = sum(size[i] for _, i in own)
        whole = min(3, int(goal[s] // total))
        left, want = goal[s] - whole * total, {}
        for h, i in sorted(own):  # the plain path: sort, take while the budget lasts
            more = left > 0 and whole < 3 and size[i] - left <= left
            want[i] = size[i] * (whole + more)
            left = left - size[i] if size[i] <= left else 0 if not more else -1
        assert {i: out[i].taken for _, i in own} == want
        assert abs(sum(want.values()) - goal[s]) <= max(size[i] for _, i in own)
        assert all(out[i].size == size[i] and out[i].taken <= 3 * size[i] and out[i].source_size == total and out[i].target == pytest.approx(goal[s]) for _, i in own)


def test_sources_that_are_joined_by_a_shuffle(spark, monkeypatch):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = sorted(map(tuple, mixing.mix(docs).collect()))
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", 0)
    assert sorted(map(tuple, mixing.mix(docs).collect())) == want


def test_edges(spark):
    rows = [(1, "a b c", "x", 9), (2, None, "x", 9), (3, "", None, 9), (4, "w " * 50, None, 9), (5, "q r", "y", 9), (5, "q r", "y", 9), (None, "n", "y", 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, size int")
    one, two = (sorted(map(str, mixing.mix(df).collect())) for _ in range(2))
    assert one == two and len(one) == 7
    assert mixing.mix(df.limit(0)).count() == 0 and mixing.mixed(df.limit(0)).count() == 0
    kept = mixing.mixed(df)
    assert kept.columns == [*df.columns, "repeats"] and all(1 <= r.repeats <= 3 for r in kept.collect())
    none = spark.createDataFrame([(1, None, None)], "doc_id long, text string, source string")
    assert mixing.mix(none).first().taken == 0


def test_clear_removes_written_tables(spark):
    from tessera.llm import common

    df = common.stored(spark.range(3).toDF("id"), "t")
    assert df.count() == 3 and len(df.inputFiles()) > 0
    common.clear(spark)
    assert not common._WRITTEN
