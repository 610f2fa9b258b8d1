import numpy as np
import pytest

from tessera.operators import resolution


def one_by_one(rows, existing, t):
    made, out = {}, []
    for c, i, v in existing:
        made.setdefault(c, []).append((i, np.array(v)))
    for c, i, v in sorted(rows, key=lambda r: r[1]):
        v = np.array(v)
        sims = [(u @ v) / (np.linalg.norm(u) * np.linalg.norm(v) or 1) for _, u in made.get(c, [])]
        best = int(np.argmax(sims)) if sims else 0
        if sims and sims[best] >= t:
            out.append((c, i, made[c][best][0], "merge"))
        else:
            made.setdefault(c, []).append((i, v))
            out.append((c, i, i, "create"))
    return sorted(out)


@pytest.mark.parametrize("bits", [2, 10])
def test_equals_the_sequential_fold(spark, monkeypatch, bits):
    monkeypatch.setattr(resolution, "TILE_BITS", bits)
    rng = np.random.default_rng(3)
    step = lambda k: [np.cos(k * 0.3), np.sin(k * 0.3), 0.0, 0.0]  # noqa: E731  a chain: each is near the one before
    rows = [("chain", i, step(i)) for i in range(40)] + [("noise", 100 + i, list(rng.standard_normal(4))) for i in range(80)] + [("same", 300 + i, [1.0, 2.0, 0.0, 0.0]) for i in range(30)] + [("zero", 400 + i, [0.0] * 4) for i in range(3)]
    existing = [("noise", 9001, [1.0, 1.0, 1.0, 1.0]), ("noise", 9000, [1.0, -1.0, 0.0, 0.0]), ("same", 9002, [2.0, 4.0, 0.1, 0.0]), ("other", 9003, [1.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame([(c, i, [float(x) for x in v]) for c, i, v in rows], "category string, id long, vec array<double>").repartition(3)
    old = spark.createDataFrame(existing, "category string, memory_id long, vec array<double>")
    got = resolution.resolve(df, 0.9, old if bits == 2 else None).collect()
    assert sorted(tuple(r) for r in got) == one_by_one(rows, sorted(existing, key=lambda r: r[1]) if bits == 2 else [], 0.9)
