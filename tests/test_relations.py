"""The least related uris against plain Python."""

import random

import pytest

from tessera.operators import relations, retrieval

SCHEMA = "owner_uri string, id string, reason string, uris array<string>"


def plain(hits, rows, most, by):
    out = set()
    for uri in set(hits):
        up = [uri[:i] for i, c in enumerate(uri) if c == "/" and i > 6] + ([uri] if "id" in by else [])
        found = {(v, *(dict(reason=reason, id=i)[b] for b in by)) for owner, i, reason, uris in rows if owner in up and uri in uris for v in uris if v is not None and v != uri}
        out |= {(uri, place + 1, *e) for place, e in enumerate(sorted(found)[:most])}
    return out


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    parts = [f"ctx://resources/p/{i}" for i in range(30)] + ["ctx://resources/other", None]
    out = [(rng.choice(["ctx://resources", "ctx://resources/p", "ctx://user"]), str(i % 150), rng.choice("ab"), rng.choices(parts, k=rng.randrange(1, 9))) for i in range(200)]
    return out + out[:20] + [("ctx://resources", f"h{i:03d}", "a", ["ctx://resources/p/0", "ctx://resources/p/1"]) for i in range(300)] + [("ctx://resources/p/3", "own", "a", parts[:9]), ("ctx://resources", "none", "a", [])]


def below(df):
    """The plan under the step that unfolds members."""
    return df._jdf.queryExecution().executedPlan().toString().split("explode(few", 1)[1]


def test_least_of_many_relations(spark, rows):
    hits = [f"ctx://resources/p/{i}" for i in range(0, 30, 2)] + ["ctx://resources/p/0", "ctx://resources/p/none"]
    df, rel = spark.createDataFrame([(h,) for h in hits], "uri string"), spark.createDataFrame(rows, SCHEMA).repartition(4)
    edges, related = relations.edges(df, rel, 5), retrieval.relations_of(df, rel, 5)
    assert {tuple(r) for r in edges.select("uri", "place", "related", "reason").collect()} == {e[:4] for e in plain(hits, rows, 5, ["reason", "id"])}
    assert {tuple(r) for r in related.select("uri", "place", "related", "reason").collect()} == plain(hits, rows, 5, ["reason"])
    assert related.count() == len(plain(hits, rows, 5, ["reason"])) and edges.count() == len(plain(hits, rows, 5, ["reason", "id"]))
    for found in (edges, related):  # relations are cut by rank before their members are unfolded, and no uri's are collected
        assert "WindowGroupLimit" in below(found) and "collect_list" not in below(found)
