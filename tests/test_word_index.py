from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import docs as D
from tessera.operators import retrieval as R
from tessera.plans import retrieval as P

SF = "/root/testdata/sf0.001"


def test_counts(spark):
    texts = ["b a b", "", None, "x", "ü b ü ü a"]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, t string").select("k", "t", T.counts(F.split("t", " ")).alias("c"))
    for r in rows.collect():
        assert (r.c or []) == sorted(Counter(r.t.split(" ") if r.t is not None else []).items())


@pytest.mark.parametrize("weighted", [False, True])
def test_words_are_counted_in_the_row(spark, weighted, tmp_path):
    docs = P._docs(spark, SF)
    rows = D.postings(docs) if weighted else D.word_postings(docs)
    assert "Exchange" not in rows._jdf.queryExecution().executedPlan().toString()
    plain = R.build_index(rows.select("uri", "term", "tf"), str(tmp_path / "a"), buckets=4)
    index = R.build_index(rows, str(tmp_path / "b"), buckets=4)
    assert (index.n, index.avg_len) == (plain.n, plain.avg_len)
    read = lambda i: sorted(spark.read.parquet(i.path).select("uri", "term", "tf", "doc_len", "terms").collect())
    assert read(index) == read(plain)


def test_no_document(spark, tmp_path):
    index = R.build_index(D.word_postings(P._docs(spark, SF).where("false")), str(tmp_path / "i"), buckets=4)
    assert (index.n, index.avg_len) == (0, 0.0)


def test_texts_stay_out_of_the_join(spark):
    df = P.hybrid(spark, SF)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    join = plan[plan.index("Join") :]
    assert "content" not in join.split("Project")[0] and "lower(text" in join
