import random

import pytest
from tokenizers import Tokenizer

from tessera.llm import tokens

PATH = tokens.vocabulary_path()


@pytest.fixture(scope="module")
def tok():
    return Tokenizer.from_file(PATH)


def n(tok, text):
    return len(tok.encode(text, add_special_tokens=False).ids)


TEXTS = [
    "", " ", "  two  spaces\n\n\nlines \t x", "don't we'll they're I'd 've 's'", "naïve café Ünïcödé", "日本語のテキスト한국어", "a<|endoftext|>b <|endoftext|><|endoftext|>", "<|endo", "x = 12345.678; y += 1e-9 // ok!!! %%% ***",
    "  odd space\x1c\x1d\x85", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "🙂🙃 emoji👩‍👩‍👧", "  ", "\n\n", "a \n b", "a\n\n b\n \n",
]


@pytest.mark.parametrize("text", TEXTS)
def test_every_prefix(tok, text):
    got = tokens.counter(PATH).counts(text)
    assert got.tolist() == [n(tok, text[:p]) for p in range(len(text) + 1)]


def test_every_prefix_of_random_texts(tok):
    rng = random.Random(3)
    alphabet = list("abcdethiosn  \n\t'.,;!?019éßñ") + ["'re", " the", "tion", "<|endoftext|>"]
    for _ in range(150):
        text = "".join(rng.choice(alphabet) for _ in range(60))
        assert tokens.counter(PATH).counts(text).tolist() == [n(tok, text[:p]) for p in range(len(text) + 1)]


def test_against_the_library_on_the_table(spark, tok):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").repartition(4)
    text = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    out = tokens.count_tokens(docs).collect()
    assert len(out) == 1000
    for r in out:
        assert (r.n_tokens, r.n_bytes) == (n(tok, text[r.doc_id]), len(text[r.doc_id].encode()))
        assert r.over_limit == (r.n_tokens > 1024)


def test_edges(spark, tok):
    df = spark.createDataFrame([(1, None, 5), (2, "", 6), (3, "hello there", 7), (3, "hello there", 7)], "doc_id long, text string, n_tokens int")
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.count_tokens(df).collect()) == [(1, 0, 0, False), (2, 0, 0, False), (3, 11, 2, False), (3, 11, 2, False)]
    assert tokens.count_tokens(df.limit(0)).count() == 0
    arrays = {r.doc_id: r.prefix_tokens for r in tokens.prefix_table(df).collect()}
    assert arrays[1] == arrays[2] == [0] and len(arrays[3]) == 12
    assert tokens.within(arrays[3], 1) == max(p for p in range(12) if n(tok, "hello there"[:p]) <= 1)


def test_blocks_and_shared_pieces(tok, monkeypatch):
    rng = random.Random(5)
    alphabet = list("abcdethiosn  \n\t'.,;!?019éßñ") + ["'re", " the", "tion", "<|endoftext|>"]
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 90))) for _ in range(80)] + [None, ""]
    want = [[n(tok, t[:p]) for p in range(len(t) + 1)] for t in (t or "" for t in texts)]
    for block, memo, short in ((1 << 21, 1 << 18, 256), (16, 1 << 18, 4), (7, 20, 1)):
        for name, value in (("BLOCK", block), ("MEMO", memo), ("SHORT", short)):
            monkeypatch.setattr(tokens, name, value)
        own = tokens.PrefixCounter(PATH)
        for _ in range(2):
            got = [[int(x) for part in parts for x in part] for parts in own.many(texts)]
            assert got == want


def test_very_long_texts_in_bounded_memory(tok):
    import resource

    own = tokens.PrefixCounter(PATH)
    rng = random.Random(7)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    piece = "".join(rng.choice("abcdefghij") for _ in range(5_000_000))  # one piece without a blank
    parts = [part[-1] for part in own.parts(piece)]
    assert parts[-1] == n(tok, piece)
    spaced = " ".join("".join(rng.choice("abcdéfghij") for _ in range(rng.randint(1, 9))) for _ in range(500_000))
    assert [part[-1] for part in own.parts(spaced)][-1] == n(tok, spaced)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 800 << 10
