import numpy as np

from tessera.llm import langid

DOCS = "/root/testdata/sf0.01/documents.parquet"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(DOCS)
    out = langid.held_out_identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert len(out) == 1000 and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in out)


def plain(text):
    """Bucket counts of one text, n-gram by n-gram."""
    out = np.zeros(langid.BUCKETS, int)
    if not text or not any(map(str.isalpha, text)):
        return out
    t, run = " ", False
    for c in text.lower():
        if c.isalpha() or not run:
            t += c if c.isalpha() else " "
        run = not c.isalpha()
    t += " "
    # a run of others at the beginning or end adds a second space, as the operator has it
    for n in langid.ORDERS:
        for i in range(len(t) - n + 1):
            h = n
            for j in range(n):
                h = (h ^ ord(t[i + j])) * int(langid._MIX[j]) & 0xFFFFFFFF
                h ^= h >> 15
            out[h % langid.BUCKETS] += 1
    return out


def test_blocks_and_batches_give_the_plain_counts(monkeypatch):
    texts = ["Ünïcode words, and 12 more; " * 50, None, "x", "", "123 !!", "le chat -- et l'eau", "Ünïcode words, and 12 more; " * 9]
    for block in (1 << 18, 97, 5):
        monkeypatch.setattr(langid, "BLOCK", block)
        got = np.zeros((len(texts), langid.BUCKETS), int)
        for of, first, b in langid.buckets(texts):
            for i, own in zip(of, np.split(b, first[1:])):
                got[i] += np.bincount(own, minlength=langid.BUCKETS)
        assert all((got[i] == plain(t)).all() for i, t in enumerate(texts))


def test_predictions_against_a_plain_form(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    (model,) = langid.train(docs)
    out = {r.doc_id: r for r in langid.identify(docs.select("doc_id", "text"), [model]).collect()}
    for r in docs.collect():
        total = model.logp.astype(float) @ plain(r.text)
        k = int(total.argmax())
        assert out[r.doc_id].lang_pred == model.langs[k]
        assert abs(out[r.doc_id].score - 1 / np.exp(total - total[k]).sum()) < 1e-6


def test_slices_of_languages_give_the_same(spark, monkeypatch):
    rows = [(i, f"{chr(97 + i % 7) * 3} {chr(98 + i % 7) * 2} word{i % 7}", f"l{i % 7}") for i in range(70)] + [(99, "12 34", "l1"), (98, None, None), (97, "aaa bb", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    whole = sorted(map(tuple, langid.identify(docs, langid.train(docs)).select("doc_id", "lang_pred", "score").collect()))
    monkeypatch.setattr(langid, "SLICE", 2)
    parts = sorted(map(tuple, langid.identify(docs, langid.train(docs)).select("doc_id", "lang_pred", "score").collect()))
    assert [r[:2] for r in parts] == [r[:2] for r in whole] and len({r[1] for r in whole}) == 8
    assert all(abs(a[2] - b[2]) < 1e-9 for a, b in zip(parts, whole))


def test_every_language_is_learned(spark):
    docs = spark.createDataFrame([(None, "same words here", "aa")] * 50 + [(1, "other words there", "bb")] * 50, "doc_id long, text string, lang string")
    models = list(langid.train(docs, rows_per_lang=1))
    assert [m.langs for m in models] == [["aa", "bb"]] and np.isfinite(models[0].logp).all()


def test_edges(spark):
    rows = [(1, "the cat sat", "en", 0), (2, "der hund", "de", 0), (3, None, "en", 0), (4, "", None, 0), (5, "123 !!", "en", 0), (None, "le chat", None, 0), (1, "the cat sat", "en", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int")
    out = langid.identify(df, langid.train(df)).collect()
    assert [r.lang_pred for r in out if r.doc_id in (3, 4, 5)] == ["und"] * 3
    assert len(out) == 7 and {r.lang_pred for r in out if r.doc_id == 1} == {"en"}
    assert langid.held_out_identify(df.limit(0)).count() == 0
    assert {r.lang_pred for r in langid.identify(df, langid.train(df.limit(0))).collect()} == {"und"}


STRANGE = ["Быстрая коричневая лиса прыгает через ленивую собаку и бежит дальше в лес.", "敏捷的棕色狐狸跳过了懒狗然后跑进森林里去了", "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee metsään", "xqzv kjwq zzxk"]


def test_unlearned_languages_are_rejected(spark):
    import corpus_pipeline as cp

    docs = spark.read.parquet(DOCS).select("doc_id", "text", "lang")
    more = spark.createDataFrame([(10**6 + i, t, None) for i, t in enumerate([*STRANGE, "the cat sat there and then"])], docs.schema)
    for own in (docs, docs.where("lang = 'en'")):  # with one language the posterior is always 1
        kept = {r.doc_id for r in cp.language_id(spark, own.unionByName(more), "").select("doc_id").collect()}
        assert {i for i in kept if i >= 10**6} == {10**6 + len(STRANGE)} and len(kept) == own.count() + 1
