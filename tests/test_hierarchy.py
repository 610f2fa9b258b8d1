"""Tree labels against sets of prefixes in plain Python."""

import pytest
from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.operators import hierarchy as H
from tessera.operators import namespace as N
from tessera.operators import retrieval as R

PATHS = ["a/b/1.md", "a/b/c/2.md", "a/b-c/3.md", "a/b c/4.md", "a/b.d/5.md", "a/b!/6.md", "a", "z/é/7.md", "a/b/c", "/".join("deep") + "/x.md", "a/\x01/8", "a\x02/9"]


def table(spark, paths, **more):
    rows = [(f"ctx://resources/{p}", i, None if i % 5 == 0 else "t" * i) for i, p in enumerate(paths)]
    df = spark.createDataFrame(rows, "uri string, doc_id long, content string")
    return df.select("uri", F.regexp_replace("uri", r"/[^/]+$", "").alias("parent_uri"), F.lit(True).alias("is_leaf"), D.depth(F.col("uri")).alias("depth"), "doc_id", "content", *[v.alias(k) for k, v in more.items()])


def below(uri, all_):
    return {u for u in all_ if u.startswith(uri + "/")}


@pytest.fixture(scope="module")
def tree(spark, tmp_path_factory):
    return H.Tree.build(table(spark, PATHS, pre=F.lit("clash"), n=F.lit(1), key=F.lit("clash")), str(tmp_path_factory.mktemp("tree")))


def test_labels_are_ranges(tree):
    rows = {r.uri: r for r in tree.nodes.collect()}
    assert sorted(r.pre for r in rows.values()) == list(range(len(rows)))
    for uri, r in rows.items():
        assert {u for u, o in rows.items() if r.pre < o.pre <= r.last} == below(uri, rows), uri
        assert {x.uri for x in tree.subtree(uri).select("uri").collect()} == below(uri, rows) | {uri}
    assert rows["ctx://resources/a"].document and not rows["ctx://resources/a"].is_leaf and rows["ctx://resources"].pre == 0
    up = tree.ancestors("ctx://resources/a/b/c/2.md").orderBy("pre").select("uri").collect()
    assert [r.uri for r in up] == ["ctx://resources", "ctx://resources/a", "ctx://resources/a/b", "ctx://resources/a/b/c"]
    assert tree.label("ctx://resources/none") is None and tree.subtree("ctx://resources/none").count() == 0 == tree.ancestors("ctx://user").count()


def test_sums_and_projection(spark, tree):
    rows = {r.uri: r for r in tree.nodes.collect()}
    got = {r.uri: (r.leaves, r.chars) for r in tree.sums(leaves=F.col("document").cast("long"), chars=F.length("content")).collect()}
    want = {u: (sum(rows[x].document for x in below(u, rows)), sum(len(rows[x].content or "") for x in below(u, rows))) for u, r in rows.items() if not r.is_leaf}
    assert got == want
    docs = table(spark, PATHS)
    for ok in (F.length("content") > 6, F.col("doc_id") == 8, F.lit(False), F.col("content").isNull()):
        assert sorted(r.uri for r in tree.projection(ok).collect()) == sorted(r.uri for r in R.filter_projection(docs, ok).collect())


def test_parts_of_running_sums(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(H, "PART_BITS", 3)
    tree = H.Tree.build(table(spark, [f"d{i % 7}/e{i % 3}/{i}" for i in range(200)]), str(tmp_path))
    got = {r.uri: r.n for r in tree.sums(n=F.col("document").cast("long")).collect()}
    assert got["ctx://resources"] == 200 and got["ctx://resources/d3"] == len([i for i in range(200) if i % 7 == 3]) and len(got) == 1 + 7 + 21


def test_moves_and_removals_are_those_of_the_scan(spark, tree):
    docs = table(spark, PATHS)
    changed, gone = tree.moved("ctx://resources/a/b", "ctx://resources/z/q")
    after = docs.join(gone, "uri", "left_anti").select("uri", "parent_uri", "depth", "doc_id").unionByName(changed.select("uri", "parent_uri", "depth", "doc_id"))
    want = N.move(docs, "ctx://resources/a/b", "ctx://resources/z/q").select("uri", "parent_uri", "depth", "doc_id")
    assert sorted(map(tuple, after.collect())) == sorted(map(tuple, want.collect())) and changed.count() == 3
    left = docs.join(tree.removed("ctx://resources/a/b", recursive=True), "uri", "left_anti")
    assert sorted(r.uri for r in left.collect()) == sorted(r.uri for r in D.delete_prefix(docs, "ctx://resources/a/b").collect())
    for bad, error in ((("ctx://resources/a", "ctx://user/a"), PermissionError), (("ctx://resources/a", "ctx://resources/a/b"), ValueError)):
        with pytest.raises(error):
            tree.moved(*bad)
    with pytest.raises(ValueError):
        tree.removed("ctx://resources/a")
    assert [r.uri for r in tree.removed("ctx://resources/z/é/7.md").collect()] == ["ctx://resources/z/é/7.md"]


def test_a_subtree_reads_its_range(spark, tmp_path):
    tree = H.Tree.build(table(spark, [f"d{i:03}/{i}" for i in range(400)]), str(tmp_path))
    plan = tree.subtree("ctx://resources/d007")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(pre" in plan and "LessThanOrEqual(pre" in plan


def test_empty_and_repeated(spark, tmp_path):
    docs = table(spark, ["a/1", "a/1", "a/2"])
    assert H.Tree.build(docs.limit(0), f"{tmp_path}/none").nodes.count() == 0
    tree = H.Tree.build(docs.unionByName(docs.limit(1).withColumn("uri", F.lit(None).cast("string"))), f"{tmp_path}/some")
    assert tree.nodes.where("document").count() == 2 and tree.sums(n=F.col("document").cast("long")).count() == 2
