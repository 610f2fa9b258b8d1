import hashlib
import random
import re

import numpy as np
import pytest

from tessera.llm import infill


def plain_form(doc_id, text):
    """The contract, over code points of a Python string."""
    text = text or ""
    n = len(text)
    d = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(d[i : i + 8], 16) for i in (0, 8, 16, 24))
    a, b = min(h1 % (n + 1), h2 % (n + 1)), max(h1 % (n + 1), h2 % (n + 1))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    p, m, s = text[:a], text[a:b], text[b:]
    if h4 % 100 < 20:
        return n, "spm", a, b - a, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", a, b - a, f"<P>{p}<S>{s}<M>{m}"


def sha(t):
    return hashlib.sha256(t.encode()).hexdigest()


def check(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "x", b"y") for i, t in rows], "doc_id long, text string, n int, output string, __digest binary").repartition(3)
    got = sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) for r in infill.infill_digests(df).collect()), key=repr)
    want = sorted(((i, *p[:4], sha(p[4]), sha(t or "")) for i, t in rows for p in [plain_form(i, t)]), key=repr)
    assert got == want
    kept = infill.fill_in_middle(df)
    assert kept.columns == ["doc_id", "text", "__digest", "n", "form", "prefix_units", "middle_units", "output"]
    assert sorted((r.doc_id, r.text, r.output) for r in kept.where("doc_id is not null").collect()) == sorted((i, t, plain_form(i, t)[4]) for i, t in rows if i is not None) if all(t is not None for _, t in rows) else True


def test_against_plain_form(spark):
    rng = random.Random(3)
    alphabet = "ab <>PSM\n\téß漢🙂"
    rows = [(i, "".join(rng.choice(alphabet) for _ in range(rng.choice([1, 2, 5, 40, 300])))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (None, "no id"), (None, "no id"), (5, rows[5][1]), (1002, "a<P>b"), (1003, "<S"), (1004, "<M>")]
    check(spark, rows)


def test_long_texts_and_chunk_borders(spark, monkeypatch):
    rows = [(i, t) for i, t in enumerate(["é" * 9000, "🙂" * 4096 + "x", "a" * 4095 + "é" * 3, "w" * 4096, "long wörds " * 60_000, "<" * 20_000])]
    check(spark, rows)
    assert spark.createDataFrame([], "doc_id long, text string").transform(infill.infill_digests).count() == 0


@pytest.mark.parametrize("unit", infill.UNITS)
def test_ranks_in_chunks(unit, monkeypatch):
    monkeypatch.setattr(infill, "CHUNK", 7)
    monkeypatch.setattr(infill, "WINDOW", 21)
    rng = random.Random(4)
    texts = ["".join(rng.choice("ab  \né漢") for _ in range(rng.randrange(60))) for _ in range(50)] + ["", "x", " "]
    raw = [t.encode() for t in texts]
    cuts = infill.Cuts(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), unit)
    base = 0
    for i, (t, r) in enumerate(zip(texts, raw)):
        places = {"chars": range(len(t)), "words": [m.start() for m in re.finditer(r"(?<![^ \n])[^ \n]", t)], "lines": [0, *(m.end() for m in re.finditer("\n", t[:-1]))]}[unit]
        want = sorted({0, *places}) if t else []
        assert cuts.units[i] == len(want)
        assert [cuts.at(i, k) - base for k in range(len(want) + 1)] == [len(t[:p].encode()) for p in want] + [len(r)]
        base += len(r)


def test_slices_hold_all_rows(spark, monkeypatch):
    monkeypatch.setattr(infill, "SLICE", 100)
    import pyarrow as pa

    col = pa.array(["x" * 60, None, "", "y" * 500, "z"])
    edges = list(infill._slices(col))
    assert edges[0][0] == 0 and edges[-1][1] == 5 and all(a[1] == b[0] for a, b in zip(edges, edges[1:]))
    assert list(infill._slices(pa.array([], pa.string()))) == []


def test_unknown_unit(spark):
    with pytest.raises(ValueError):
        infill.fill_in_middle(spark.createDataFrame([], "doc_id long, text string"), unit="bytes")
