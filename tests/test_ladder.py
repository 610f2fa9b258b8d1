from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import retrieval as R


def test_keys_are_made_once(spark):
    names = ["uri", "name", "base", "stem", "abstract"]
    df = spark.createDataFrame([("u", "n", "b", "small ring", "a", ["small-ring"], [])], "f_uri string, f_name string, f_base string, f_stem string, f_abstract string, f_heading array<string>, f_line array<string>")
    df = df.coalesce(1).select(R.exact_ladder("Small-Ring", {k: F.col(f"f_{k}") for k in [*names, "heading", "line"]}).alias("s"))
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        plan = df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.debug.maxToStringFields")
    for k in ("base", "stem", "name"):
        assert plan.count(f"regexp_replace(f_{k}") == 3  # plain and symbolic tokens, and the compact key
    assert "regexp_replace(Small-Ring" not in plan and "lower(Small-Ring" not in plan
    assert df.first().s == 0.985


def test_edits_and_swaps(spark):
    pairs = [("abc", "abc"), ("abc", "acb"), ("abc", "bca"), ("abc", "abcd"), ("abc", "abcde"), ("ab", ""), ("a", ""), ("", ""), ("abcd", "badc"), ("abc", None), ("äb", "bä"), ("abcd", "abxx")]
    got = [r[0] for r in spark.createDataFrame(pairs, "a string, b string").coalesce(1).select(T.edit_distance_one(F.col("a"), F.col("b"))).collect()]
    assert got == [True, True, False, True, False, False, True, True, False, None, True, False]
    plan = spark.createDataFrame(pairs, "a string, b string").select(T.edit_distance_one(F.col("a"), F.col("b")))._jdf.queryExecution().optimizedPlan().toString()
    assert "CASE WHEN (abs(" in plan  # texts of other lengths aren't compared
