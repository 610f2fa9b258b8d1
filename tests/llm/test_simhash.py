import random

import xxhash

from tessera.llm import simhash


def slow_fp(text):
    words = (text or "").encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    if not grams:
        return 0
    hs = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hs) * 2 > len(hs))


def slow_components(fps):
    ids = list(fps)
    parent = {i: i for i in ids}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in ids:
        for j in ids:
            if i < j and bin(fps[i] ^ fps[j]).count("1") <= 2:
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def test_fingerprint_against_plain_form():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 4, 300, 1000):
        t = "\t".join(rng.choice(["Alpha", "béta", "c d", "x", "Y"]) for _ in range(n))
        assert simhash.fingerprint(t) == slow_fp(t)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0


def test_long_text_is_counted_in_blocks():
    t = "a b c d " * 40_000
    assert simhash.fingerprint(t) == slow_fp(t)


def test_components_match_brute_force(spark):
    rng = random.Random(2)
    rows = []
    base = [rng.getrandbits(64) for _ in range(20)]
    for i in range(300):
        f = rng.choice(base)
        for _ in range(rng.randrange(5)):
            f ^= 1 << rng.randrange(64)
        rows.append(f)
    centre = rng.getrandbits(64)
    rows += [centre ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)) for _ in range(300)]  # over DENSE in many variants
    fps = sorted(set(rows))
    want = slow_components(dict(enumerate(fps)))
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    got = {r.node & (2**64 - 1): r.label & (2**64 - 1) for r in simhash.components(simhash.links(df)).collect()}
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(want[i], set()).add(f)
    mine = {}
    for f in fps:
        mine.setdefault(got.get(f, f), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_rows_nulls_copies_and_clashing_columns(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(5, text, "x", 1), (3, text, None, 2), (9, None, None, 3), (7, "", None, 4), (8, "other words entirely here", None, 5), (8, "other words entirely here", None, 5)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string, label int")
    out = simhash.near_duplicates(df).collect()
    assert len(out) == 6
    comp = {r.doc_id: r.component_id for r in out}
    assert comp == {5: 3, 3: 3, 9: 7, 7: 7, 8: 8}
    assert {r.fingerprint for r in out if r.doc_id in (7, 9)} == {"0" * 16}
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [3, 7, 8]
    assert simhash.near_duplicates(df.limit(0)).count() == 0


def test_one_row_of_each_component_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "x"), (2, b, "z"), (None, c, "n"), (None, c, "m"), (None, a, "k"), (3, "", "e"), (None, None, "f")]
    df = spark.createDataFrame(rows, "doc_id long, text string, __row string")
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in kept.collect()) == sorted([("1", a), ("1", b), ("None", c), ("3", "")])


def test_dense_variants_are_split(spark, monkeypatch):
    rng = random.Random(12)
    centre = rng.getrandbits(64)
    fps = {centre ^ (rng.getrandbits(11) << 40) for _ in range(120)} | {centre ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for _ in range(150)} | {rng.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    want = slow_components(dict(enumerate(fps)))
    groups = {}
    for i, f in enumerate(fps):
        groups.setdefault(want[i], set()).add(f)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for dense in (2, 16):
        monkeypatch.setattr(simhash, "DENSE", dense)
        got = {r.node & (2**64 - 1): r.label & (2**64 - 1) for r in simhash.components(simhash.links(df)).collect()}
        mine = {}
        for f in fps:
            mine.setdefault(got.get(f, f), set()).add(f)
        assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_against_brute_force_on_the_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    fps = {r.doc_id: slow_fp(r.text) for r in rows}
    want = slow_components(fps)
    out = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.near_duplicates(docs).collect()}
    assert out == {i: (f"{f:016x}", want[i]) for i, f in fps.items()}
