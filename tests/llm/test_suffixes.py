import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import suffixes, windows


def plain(texts, width=200):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + width] for r in raw for i in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, dtype=bool)
        for i in range(len(r) - width + 1):
            if seen[r[i : i + width]] > 1:
                gone[i : i + width] = True
        kept = bytes(b for b, g in zip(r, gone) if not g)
        spans = int((gone[:-1] & ~np.r_[False, gone[:-1]][: len(r)]).sum()) if len(r) else 0
        out.append((len(r), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé ") for _ in range(rng.randrange(1, 9)))
    text = lambda k: " ".join(word() for _ in range(k))
    shared = [text(rng.randrange(30, 120)) for _ in range(8)]
    texts = []
    for _ in range(n):
        parts = [text(rng.randrange(1, 60))]
        for _ in range(rng.randrange(4)):
            p = rng.choice(shared)
            a = rng.randrange(len(p) // 2)
            parts += [p[a : rng.randrange(a, len(p))] if rng.random() < 0.6 else p, text(rng.randrange(1, 30))]
        texts.append(" ".join(parts))
    texts += [texts[0], texts[1], texts[0] + "x", "ab" * 500, "a" * 450, "a" * 199, "a" * 200, None, "", shared[0], "license " * 30]
    return texts


def run(spark, texts):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, n_bytes int").repartition(3)
    rows = sorted(tuple(r) for r in suffixes.repeat_digests(df).collect())
    assert [r[0] for r in rows] == list(range(len(texts)))
    return [r[1:] for r in rows]


@pytest.mark.parametrize("dense", [64, 2])
def test_against_brute_force(spark, monkeypatch, dense):
    monkeypatch.setattr(suffixes, "DENSE", dense)
    texts = corpus(7, 120)
    assert run(spark, texts) == plain(texts)


def test_stretches_cover_all_windows_and_agree(monkeypatch):
    rng = random.Random(8)
    data = bytes(rng.choice(b"abcd") for _ in range(40_000)) + b"xy" * 3000
    arr = np.frombuffer(data, np.uint8)
    got = [np.concatenate(c) for c in zip(*windows.stretches(arr))]
    assert got[0][0] == 0 and (got[0][1:] == got[0][:-1] + got[1][:-1]).all() and got[0][-1] + got[1][-1] == len(data) - 199
    monkeypatch.setattr(windows, "BLOCK", 1000)
    small = [np.concatenate(c) for c in zip(*windows.stretches(arr))]
    assert all((a == b).all() for a, b in zip(got, small))


def test_suffix_order_and_previous_factors():
    rng = random.Random(9)
    data = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(600)) * 3 + b"a" * 300, np.uint8)
    starts = np.arange(len(data) - 199)
    order, same = suffixes.suffix_order(data, starts)
    raw = data.tobytes()
    assert [raw[i : i + 200] for i in order] == sorted(raw[i : i + 200] for i in starts)
    before, behind = suffixes.previous_factors(order, same)
    for i in starts:
        earlier = {j for j in range(i) if raw[j : j + 200] == raw[i : i + 200]}
        got = {int(before[i]), int(behind[i])} - {-1}
        assert got <= earlier and bool(got) == bool(earlier)
    rows = sorted(range(len(order)), key=lambda k: (raw[order[k] : order[k] + 200], k))  # the full definition, by plain search
    for k in rows:
        want = next((order[j] for j in range(k - 1, -1, -1) if order[j] < order[k]), -1)
        assert before[order[k]] == (want if want >= 0 and raw[want : want + 200] == raw[order[k] : order[k] + 200] else -1)


def test_nearest_smaller_against_plain_search():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 50, 400):
        v = rng.permutation(n)
        border = rng.random(n) < 0.1
        got = suffixes.nearest_smaller(v, border)
        for i in range(n):
            j = i - 1 if not border[i] else -1
            while j >= 0 and v[j] > v[i]:
                j = -1 if border[j] else j - 1
            assert got[i] == j


def plain_first(texts, ids, width=200):
    """Kept bytes if the first occurrence of each string stays."""
    raw = [(t or "").encode() for t in texts]
    line = sorted(range(len(raw)), key=lambda i: (ids[i] is None, ids[i] or 0, i))
    seen, out = set(), {}
    for r in line:
        gone = np.zeros(len(raw[r]) + 1, dtype=bool)
        for i in range(len(raw[r]) - width + 1):
            w = raw[r][i : i + width]
            if w in seen:
                gone[i : i + width] = True
            seen.add(w)
        out[r] = bytes(b for b, g in zip(raw[r], gone) if not g)
    return out


@pytest.mark.parametrize("dense", [64, 2])
def test_first_occurrences_stay(spark, monkeypatch, dense):
    monkeypatch.setattr(suffixes, "DENSE", dense)
    texts = corpus(11, 90)
    rng = random.Random(13)
    body = ["".join(rng.choice("abcdef ") for _ in range(300)) for _ in range(2)]
    ids = [None if i == 5 else 1000 - i for i in range(len(texts))]
    df = spark.createDataFrame([(i, n, t) for n, (i, t) in enumerate(zip(ids, texts))], "doc_id long, n int, text string").repartition(3)
    out = suffixes.remove_repeats(df).collect()
    want = plain_first(texts, ids)
    assert sorted((str(r.doc_id), bytes(r.kept)) for r in out) == sorted((str(i), want[n]) for n, i in enumerate(ids))
    again = spark.createDataFrame([(1, body[i % 2]) for i in range(6)], "doc_id long, text string")  # repeated rows
    assert sorted(len(r.kept) for r in suffixes.remove_repeats(again).collect()) == [0, 0, 0, 0, 300, 300]


def test_hot_anchors_are_dealt_out(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "HOT", 3)  # an anchor with a third of all rows
    texts = corpus(7, 20) + ["the same long text again and again " * 12] * 60
    assert run(spark, texts) == plain(texts)


def test_very_long_texts(spark):
    rng = random.Random(10)
    body = "".join(rng.choice("abcdefghij ") for _ in range(1_000_000))
    rows = [(1, body), (2, "short|" + body[500_000:500_400] + "|end"), (3, None)]
    out = {r.doc_id: r for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), keep_first=False).collect()}
    assert [(s.start, s.end) for s in out[1].spans] == [(500_000, 500_400)] and bytes(out[2].kept) == b"short||end" and out[3].spans == []


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert suffixes.repeat_digests(df).count() == 0
