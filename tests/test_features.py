from collections import Counter

import duckdb
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import features as X


def test_hashed_weights(spark):
    texts = ["Running camelCaseHTTPServer 'quoted', errors!", "a b a b a b", "", "...", "tokens " * 300 + "Tokens", None, "((x)) ==y"]
    rows = spark.createDataFrame([(f"u{i}", t) for i, t in enumerate(texts)] + [("u1", "again"), (None, "one")], "uri string, t string")
    found = X.hashed_weights(rows, "uri", T.tokenize(F.col("t")))
    want: dict = {}
    for r in rows.select("uri", T.tokenize(F.col("t")).alias("w")).collect():
        own = r.w or []
        features = [(X.canonical(w), 100) for w in own] + [(f"bi:{a} {b}", 80) for a, b in zip(own, own[1:])]
        features += [("tri:" + w[i : i + 3], 35) for w in own for i in range(max(1, len(w) - 2))]
        for f, n in features:
            want.setdefault(r.uri, Counter())[X.bucket(f.encode(), 64)] += n
    assert {r.uri: dict(enumerate(r.weights)) for r in found.collect()} == {u: {i: c[i] for i in range(64)} for u, c in want.items()}
    # features aren't rows: the plan deals one row of sums a key, and explodes nothing
    assert "Generate" not in found._jdf.queryExecution().toString()


def test_steps_and_batches(spark, monkeypatch):
    rows = spark.range(40).selectExpr("id AS k", "concat_ws(' ', transform(sequence(0, id % 7), i -> concat('w', i * id % 11))) AS t").coalesce(1)
    whole = sorted(X.hashed_weights(rows, "k", T.tokenize(F.col("t"))).collect())
    monkeypatch.setattr(X, "STEP", 8)
    assert sorted(X.hashed_weights(rows, "k", T.tokenize(F.col("t"))).collect()) == whole


def test_canonical(spark):
    words = ["running", "boxes", "cats", "used", "as", "login", "panic", "ing", "caches", "édes", "store"]
    own = [r[0] for r in spark.createDataFrame([(w,) for w in words], "t string").select(T.canonical_token(F.col("t"))).collect()]
    assert own == [X.canonical(w) for w in words]


def test_tokens_of_whole_texts(spark):
    """Cutting a whole text gives what trimming and cutting token by token gives."""
    texts = ["(a) 'b' c' d-e_f  ((G)) ***", "x! y?  z;", "===a=b===", "HTTPServer's camelCase (snake_case)", "", "!!", "a\n'b'\t\"C\"", "ΑΣ' Σ"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    each = F.transform(T.split_white(F.col("t")), T.trim_token)
    old = F.concat(F.flatten(F.transform(each, T.split_identifier)), F.transform(F.filter(each, lambda x: x.rlike(r"[\p{L}\p{N}]")), F.lower))
    assert [r[0] for r in df.select(T.tokenize(F.col("t"))).collect()] == [r[0] for r in df.select(old).collect()]


def test_rounded(spark):
    values = [1.005, -1.005, 2.675, 0.285, 1.115, 0.125, -0.125, 3.0, 0.0]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(S.rounded(F.col("x"), 2)).collect()]
    assert got == [duckdb.connect().execute(f"SELECT round({v}::DOUBLE, 2)").fetchone()[0] for v in values]


def test_rounded_keeps_the_sign_of_zero(spark):
    """Minus zero and zero are equal numbers but other bits, which a comparison by text or hash tells apart."""
    values = [-0.004, 0.004, -0.0, 0.0, -0.005, float("nan"), float("-inf")]
    got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "x double").select(S.rounded(F.col("x"), 2)).collect()]
    want = [duckdb.connect().execute("SELECT round(?::DOUBLE, 2)", [v]).fetchone()[0] for v in values]
    assert [str(x) for x in got] == [str(x) for x in want]
