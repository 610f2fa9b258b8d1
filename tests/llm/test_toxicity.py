import numpy as np
from pyspark.sql import functions as F

from tessera.llm import toxicity


def test_non_negative_risk_recovers_the_posterior():
    rng = np.random.default_rng(0)
    y = rng.random(4000) < 0.3
    x = np.c_[rng.random(4000) < np.where(y, 0.9, 0.05), rng.random((4000, 5)) < 0.5].astype(float)
    pos = x[y][:500]
    ((w, b),) = toxicity.fit(pos, x, 0.3)
    s = 1 / (1 + np.exp(-(x @ w + b)))
    assert s[y & (x[:, 0] == 1)].mean() > 0.7 and s[x[:, 0] == 0].mean() < 0.15


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.1/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    out = toxicity.held_out_scores(docs, labels)
    assert out.count() == docs.count()
    rows = out.where("held_out").join(labels.select("doc_id", "toxic"), "doc_id").collect()
    hit = sum(r.predicted and r.toxic for r in rows) / sum(r.toxic for r in rows)
    right = sum(r.predicted and r.toxic for r in rows) / max(1, sum(r.predicted for r in rows))
    print("recall", hit, "precision", right)
    assert hit > 0.85 and right > 0.85


def test_edges(spark):
    docs = spark.createDataFrame([(1, "you idiot", 1), (2, None, 0), (3, "", 0), (3, "", 0), (None, "x", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(1, 1), (1, None), (2, 0), (None, 1)], "doc_id long, toxic int")
    out = toxicity.held_out_scores(docs, labels).collect()
    assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in out)
    assert toxicity.held_out_scores(docs.limit(0), labels).count() == 0
    assert {r.score < 0.01 for r in toxicity.held_out_scores(docs, labels.limit(0)).collect()} == {True}


def test_scores_against_a_plain_form(spark):
    import math

    d = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    model = toxicity.train(docs, labels)
    weight = dict(zip(model.words.tolist(), model.weights.tolist()))
    assert 0 < len(weight) <= toxicity.FEATURES[-1]
    long = " ".join(f"word{i} idiot" for i in range(100_000))
    more = docs.select("doc_id", "text").union(spark.createDataFrame([(10**6, long), (None, "x"), (10**6 + 1, None)], "doc_id long, text string"))
    out = sorted((str(r.doc_id), r.score) for r in toxicity.score_texts(more, model, ["doc_id"]).collect())
    want = []
    for r in more.collect():
        held = {b for w in toxicity.words_of(r.text) for b in toxicity.buckets_of_word(w)}
        want.append((str(r.doc_id), 1 / (1 + math.exp(-(model.bias + sum(v for b, v in weight.items() if b in held))))))
    assert all(a[0] == b[0] and abs(a[1] - b[1]) < 1e-9 for a, b in zip(out, sorted(want)))


def test_words_are_chosen_by_the_counts_of_all_rows(spark):
    texts = ["vile vile trash"] * 4 + ["vile calm"] * 3 + ["calm day", "calm night", None, ""] * 10
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i < 7)) for i in range(20)], "doc_id long, toxic int")
    got = toxicity._counts(docs)
    vile, calm = (toxicity.buckets_of_word(w.encode())[0] for w in ("vile", "calm"))
    assert (got[vile], got[calm], got[toxicity.BUCKETS]) == (7, 23, len(texts))
    model = toxicity.train(docs, labels)
    assert vile in model.words and model.weights[list(model.words).index(vile)] > 0


def test_held_out_labels_have_no_part(spark):
    d = "/root/testdata/sf0.01/"
    docs, labels = spark.read.parquet(d + "documents.parquet"), spark.read.parquet(d + "labels.parquet")
    other = labels.withColumn("toxic", F.when(toxicity.crc_of("doc_id") % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    a, b = (sorted(map(tuple, toxicity.held_out_scores(docs, x).collect())) for x in (labels, other))
    assert a == b
