"""Reconciling a ledger of hashes with a listing, by trees of digests.

A directory's digest sums hashes over the leaves below it, so it is one
aggregate with partial sums, whatever a directory's size, and a changed leaf moves
the digests above it alone. Two stored trees are compared from the roots:
where a directory's digests agree, nothing below it is read; the children of those that
differ are the next level's. Rows compared go with the change and its
directories' sizes, not with the tree.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.sources.shared import drop_at_exit, shared_dir

#: Uris of a report's sample, and differing directories that become a condition of the scan instead of a join.
SAMPLE, MOST_INLINE = 50, 1024
NODE = "parent_uri string, uri string, is_leaf boolean, a long, b long, leaves long"


def build_tree(entries: DataFrame, path: str) -> DataFrame:
    """Write the tree of ``entries(uri, hash)``, sorted by parent, so that reading a directory's children opens few files.

    A node has two sums of 64-bit hashes over its leaves and their number.
    """
    one = F.struct(F.xxhash64("uri", "hash").alias("a"), F.xxhash64(F.lit("second"), "hash", "uri").alias("b"))
    leaves = entries.select("uri", one.alias("h")).select("uri", "h.*")
    up = leaves.select(F.explode(D.ancestors(F.col("uri"))).alias("uri"), "a", "b").groupBy("uri").agg(_wrapped("a"), _wrapped("b"), F.count("*").alias("leaves"))
    parent = F.when(D.depth(F.col("uri")) > 0, F.regexp_replace("uri", r"/[^/]+$", "")).alias("parent_uri")
    nodes = leaves.select(parent, "uri", F.lit(True).alias("is_leaf"), "a", "b", F.lit(1).cast("long").alias("leaves")).unionByName(up.select(parent, "uri", F.lit(False).alias("is_leaf"), "a", "b", "leaves"))
    nodes.repartitionByRange("parent_uri", "uri").sortWithinPartitions("parent_uri", "uri").write.mode("overwrite").parquet(path)
    return entries.sparkSession.read.schema(NODE).parquet(path)


def _wrapped(column: str):
    """A sum modulo 2 ** 64: both halves are summed apart, which can't overflow for under 2 ** 31 leaves, and put together."""
    low, high = F.sum(F.col(column).bitwiseAND(0xFFFFFFFF)), F.sum(F.shiftright(column, 32))
    carried = (high + F.shiftrightunsigned(low, 32)).bitwiseAND(0xFFFFFFFF)
    return F.shiftleft(carried, 32).bitwiseOR(low.bitwiseAND(0xFFFFFFFF)).alias(column)


@dataclass
class Drift:
    """``rows(uri, drift)`` and how many nodes were compared on each level."""

    rows: DataFrame
    compared: list[int]


def drift(ledger: DataFrame, listing: DataFrame, scopes: list[str] | None = None) -> Drift:
    """What differs between two trees: ``missing`` in the listing, ``untracked`` in the ledger, or ``changed``; in some scopes, or all."""
    spark = ledger.sparkSession
    at = lambda df: df.where("parent_uri IS NULL AND NOT is_leaf") if scopes is None else df.where(F.col("parent_uri").isNull() & F.col("uri").isin([D.SCHEME + s for s in scopes]))
    left, right, found, compared = at(ledger), at(listing), [], []
    while True:
        a, b = (df.select("uri", "is_leaf", F.struct("a", "b", "leaves").alias(n)) for df, n in ((left, "x"), (right, "y")))
        both = a.join(b, ["uri", "is_leaf"], "full_outer")
        level = _kept(both.withColumn("same", F.coalesce(F.col("x") == F.col("y"), F.lit(False))), "reconcile")
        compared.append(level.count())
        differ = level.where("not same")
        kind = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "untracked").otherwise("changed")
        found.append(differ.where("is_leaf").select("uri", kind.alias("drift")))
        dirs = differ.where("not is_leaf").select(F.col("uri").alias("parent_uri"))
        few = [r.parent_uri for r in dirs.limit(MOST_INLINE + 1).collect()]
        if not few:
            return Drift(reduce(DataFrame.unionByName, found), compared)
        below = lambda df: df.where(F.col("parent_uri").isin(few)) if len(few) <= MOST_INLINE else df.join(dirs, "parent_uri", "left_semi")  # noqa: B023, E731
        left, right = below(ledger), below(listing)


def _kept(df: DataFrame, name: str) -> DataFrame:
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    drop_at_exit(spark, path)
    return spark.read.schema(df.schema).parquet(path)


def reconcile(ledger: DataFrame, listing: DataFrame, ledger_tree: DataFrame, listing_tree: DataFrame, dry_run: bool = False, scopes: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """(the ledger afterwards, one report row).

    Entries that aren't uris of a known scope are invalid and go, whatever the scopes asked for; missing ones are pruned, and changed and untracked
    ones taken from the listing, in those scopes. A dry run reports the same and leaves the ledger as it is. The sample holds ``SAMPLE`` invalid and missing uris.
    """
    spark: SparkSession = ledger.sparkSession
    known = D.scope(F.col("uri")).isin(list(D.SCOPES)) & F.startswith("uri", F.lit(D.SCHEME))
    invalid = ledger.where(~F.coalesce(known, F.lit(False))).select("uri")
    found = drift(ledger_tree, listing_tree, list(D.SCOPES) if scopes is None else scopes).rows
    gone = found.where("drift = 'missing'").select("uri")
    bad = invalid.unionByName(gone)
    fresh = listing.join(found.where("drift <> 'missing'").select("uri"), "uri", "left_semi")
    counts = found.groupBy().agg(*[F.count_if(F.col("drift") == k).alias(k) for k in ("missing", "untracked", "changed")]).first()
    n = invalid.count()
    sample = [r.uri for r in bad.orderBy("uri").limit(SAMPLE).collect()]
    did = 0 if dry_run else 1
    report = spark.createDataFrame(
        [(n + counts["missing"], n, counts["missing"], did * counts["missing"], did * (counts["untracked"] + counts["changed"]), did * len(scopes or D.SCOPES), dry_run, sample, "dry_run" if dry_run else "success")],
        "drift_count long, invalid long, missing long, pruned long, reindexed long, reindexed_scopes long, dry_run boolean, sample array<string>, status string",
    )
    if dry_run:
        return ledger, report
    kept = ledger.join(bad.unionByName(fresh.select("uri")), "uri", "left_anti")
    return kept.unionByName(fresh.select(*ledger.columns)), report
