import math

import numpy as np
import pytest

from tessera.llm import vectors


def slow(rows, least=0.98):
    """n_links and component of every row, by comparing all of a label."""
    ok = [lab is not None and v is not None and len(v) > 0 and all(x is not None and math.isfinite(x) for x in v) and any(v) for _, lab, v in rows]
    parent, n = list(range(len(rows))), [0] * len(rows)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, (_, la, a) in enumerate(rows):
        for j in range(i):
            _, lb, b = rows[j]
            if ok[i] and ok[j] and la == lb and len(a) == len(b):
                x, y = np.array(a, float), np.array(b, float)
                x, y = x / np.abs(x).max(), y / np.abs(y).max()
                if x @ y / math.sqrt((x @ x) * (y @ y)) >= least:
                    n[i] += 1
                    n[j] += 1
                    parent[find(i)] = find(j)
    low = {}
    for i, (vid, _, _) in enumerate(rows):
        if vid is not None:
            low[find(i)] = min(low.get(find(i), vid), vid)
    return sorted(((vid, n[i], low.get(find(i)), vid is not None and vid == low.get(find(i))) for i, (vid, _, _) in enumerate(rows)), key=repr)


def near(rng, base, cos):
    """A vector at about a given cosine to a unit vector."""
    e = rng.standard_normal(len(base))
    e -= e @ base * base
    return cos * base + math.sqrt(1 - cos * cos) * e / np.linalg.norm(e)


def run(spark, rows, kind="float"):
    df = spark.createDataFrame([(i, lab, [None if x is None else float(x) for x in v] if v is not None else None, 1) for i, lab, v in rows], f"vec_id long, label int, embedding array<{kind}>, cid int").repartition(3)
    return sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in vectors.near_duplicates(df).collect()), key=repr)


def as_floats(rows):
    return [(i, lab, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, lab, v in rows]


def test_against_brute_force(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(300):
        base = rng.standard_normal(16)
        base /= np.linalg.norm(base)
        rows.append((len(rows), int(i % 3), base * rng.uniform(0.01, 100)))
        for cos in rng.uniform(0.975, 0.985, rng.integers(0, 4)):
            rows.append((len(rows), int(i % 3), near(rng, base, cos)))
    want = slow(as_floats(rows))
    assert sum(r[1] for r in want) > 100 and any(r[1] == 0 for r in want)
    assert run(spark, rows) == want
    monkeypatch.setattr(vectors, "TILE_ROWS", 17)  # many tiles, most pruned by their boxes
    monkeypatch.setattr(vectors, "ROWS", 5)
    classes = spark.createDataFrame([(i, 1, lab, [float(x) for x in v]) for i, lab, v in rows], "cid long, copies long, label int, v array<float>")
    pairs = vectors.tile_pairs(vectors.tiles(classes)).count()
    assert 0 < pairs < (len(rows) // 17 / 3) ** 2 / 2 * 3 + len(rows)


def test_small_tiles_find_the_same():
    rng = np.random.default_rng(6)
    base = rng.standard_normal(24)
    base /= np.linalg.norm(base)
    x = np.stack([near(rng, base, c) for c in rng.uniform(0.97, 1, 200)]).astype(np.float32)
    u = vectors.units(x)
    exact = u @ u.T >= 0.98
    ids, copies = np.arange(200), np.ones(200)
    a, b = (vectors.Tile.of(x[s], ids[s], copies[s]) for s in (slice(0, 120), slice(120, 200)))
    got = {int(i): int(n) for i, n, _ in zip(*vectors.compare(a, b))}
    assert got == {int(i): int(n) for i, n in enumerate(np.r_[exact[:120, 120:].sum(1), exact[:120, 120:].sum(0)]) if n}
    q, scale, err = vectors.quantised(u)
    approx = vectors._integer_products(q, q) * scale[:, None] * scale
    assert (np.abs(approx - u @ u.T) <= err[:, None] + (1 + err[:, None]) * err).all()
    again = sum(n for _, _, n in vectors.linked(a, b, 0.98))
    assert 0 < again < 120 * 80  # pairs far from the threshold aren't computed again


def test_wide_vectors_add_up_exactly():
    rng = np.random.default_rng(7)
    q = rng.integers(-127, 128, (5, 3000)).astype(np.int8)
    assert (vectors._integer_products(q, q) == q.astype(np.int64) @ q.astype(np.int64).T).all()


def test_copies_and_odd_rows(spark):
    one = [1.0, 0.0, 0.0]
    rows = [(i, 1, one) for i in range(10, 60)] + [(3, 1, [2.0, 0.1, 0.0]), (4, 2, one), (5, None, one), (6, 1, None), (7, 1, []), (8, 1, [0.0, 0.0, 0.0])]
    rows += [(9, 1, [1.0, float("nan"), 0.0]), (61, 1, [1.0, None, 0.0]), (62, 1, [float("inf"), 0.0, 0.0]), (63, 1, [1.0, 0.0]), (64, 1, [5.0, 0.0]), (None, 1, one), (None, 3, one), (10, 1, one), (65, 4, [1e-30, 1e-30]), (66, 4, [1e30, 1e30]), (67, 1, [-1.0, -0.0, 0.0])]
    assert run(spark, rows) == slow(as_floats(rows))
    rows = [(1, 1, [1e-300, 1e-300]), (2, 1, [1e300, 1e300]), (3, 1, [1e300, -1e300])]
    assert run(spark, rows, "double") == slow(rows) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_empty_and_without_labels(spark):
    empty = spark.createDataFrame([], "vec_id long, label int, embedding array<float>")
    assert vectors.near_duplicates(empty).count() == 0
    df = spark.createDataFrame([(1, 1, [1.0, 0.0]), (2, 2, [1.0, 0.01]), (3, None, [0.0, 1.0])], "vec_id long, label int, embedding array<float>")
    assert sorted((r.vec_id, r.component_id) for r in vectors.near_duplicates(df, label_col=None).collect()) == [(1, 1), (2, 1), (3, 3)]
    with pytest.raises(ValueError):
        vectors.near_duplicates(df, least=0.0)


def test_a_hot_group_writes_no_pairs(spark):
    """Near copies of one vector: rows in proportion to vectors and tiles, never to links."""
    rng = np.random.default_rng(8)
    base = rng.standard_normal(8)
    base /= np.linalg.norm(base)
    rows = [(i, 1, [float(x) for x in near(rng, base, 0.999)]) for i in range(1500)]
    df = spark.createDataFrame([(i, 1, lab, v) for i, lab, v in rows], "cid long, copies long, label int, v array<float>")
    tiled = vectors.tiles(df)
    pairs = vectors.tile_pairs(tiled)
    n = pairs.count()
    got = vectors.forests(tiled, pairs, 0.98, False)
    assert got.count() <= n * 1500 and got.count() < 1500 * 1499 / 4
    u = vectors.units(np.array([v for _, _, v in rows], np.float32))
    assert got.groupBy().sum("n").first()[0] == int((u @ u.T >= 0.98).sum()) - 1500
