import re

import corpus_pipeline as cp
from tessera.llm import decontam, langid, mixing

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_plain_forms(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs.collect()
    (model,) = [langid.floors(docs, m) for m in langid.train(docs)]
    one = cp.stored(cp.language_id(spark, docs, SF), "t1")
    assert one.columns == COLUMNS
    want = {r.doc_id for r, x in zip(before, langid.best([r.text for r in before], model)) if x["n"] and x["total"] / x["n"] >= model.least[model.langs.index(x["lang"])]}
    assert {r.doc_id for r in one.collect()} == want

    from test_simhash import slow_components, slow_fp

    two = cp.stored(cp.near_duplicates(spark, one, SF), "t2")
    comp = slow_components({r.doc_id: slow_fp(r.text) for r in one.collect()})
    assert two.columns == COLUMNS and {r.doc_id for r in two.collect()} == set(comp.values())

    three = cp.stored(cp.benchmark_decontamination(spark, two, SF), "t3")
    items = [decontam.fold(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    gone = {r.doc_id for r in two.collect()} - {r.doc_id for r in three.collect()}
    exact = {r.doc_id for r in two.collect() if any(i in decontam.fold(r.text) for i in items)}
    assert three.columns == COLUMNS and exact <= gone
    for r in two.where(two.doc_id.isin(list(gone))).collect():
        assert any(decontam.Pattern(i).best(decontam.fold(r.text))[0] <= len(i) * decontam.RATE for i in items)

    four = cp.stored(cp.personal_data(spark, three, SF), "t4")
    assert four.columns == COLUMNS and four.count() == three.count()
    for r in four.collect():
        assert not re.search(r"[a-z]@[a-z0-9]+\.[a-z]", r.text) and len(r.text) == r.n_chars

    five = cp.mix_sources(spark, four, SF)
    taken = {r.doc_id: r.taken for r in mixing.mix(four).collect()}
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text)) for r in four.collect()}
    assert {r.doc_id: r.repeats * size[r.doc_id] for r in five.collect() if size[r.doc_id]} == {i: n for i, n in taken.items() if n}


def test_repeated_long_and_clashing_rows(spark):
    long = " ".join(f"the{i % 977} house" for i in range(60_000))
    rows = [(1, "the house and the garden", "en", "a", 0), (1, "the house and the garden", "en", "a", 0), (1, "the other house and the other garden", "en", "a", 0), (2, long, "en", "b", 0), (3, long, "en", "b", 0), (4, "Быстрая коричневая лиса", None, "b", 0)]
    names = ["__lang", "__score", "__row", "__fp", "__found", "__source", "__whole", "__cut", "repeats"]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for c in names:
        docs = docs.withColumn(c, docs.doc_id)
    out = docs
    for name, stage in cp.STAGES[:-1]:
        out = cp.stored(stage(spark, out, SF), "t")
        assert out.columns == docs.columns, name
    assert sorted((r.doc_id, len(r.text)) for r in out.collect()) == sorted([(1, 24), (1, 36), (2, len(long))])
    assert all(r[c] == r.doc_id for r in out.collect() for c in names)
    assert cp.STAGES[-1][1](spark, out, SF).columns == [c for c in docs.columns if c != "repeats"] + ["repeats"]


def test_empty_and_null_rows(spark):
    docs = spark.createDataFrame([(1, None, None, None, None, "x"), (2, "", "en", "a", 0, "x"), (None, "some words", "en", "a", 10, None)], "doc_id long, text string, lang string, source string, n_chars long, h string")
    for rows in (docs, docs.limit(0)):
        out = rows
        for _, stage in cp.STAGES[:-1]:
            out = cp.stored(stage(spark, out, SF), "t")
            assert out.columns == docs.columns
        assert cp.STAGES[-1][1](spark, out, SF).count() <= rows.count()
