"""A stored tree with labels: a node's number in pre-order and the last number below it.

A subtree is a range of numbers, so reading, removing or moving one reads the
files of that range. Whether something lies below a directory, and how much, is
a difference of two running sums: no uri is spread to its ancestors, and the
work is linear in the nodes whatever their depth. Labels belong to one stored
version; changes are given as rows for the commit log, and a merge labels anew.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.operators.packing import placed, running

#: Nodes of a part that running sums go over, as a power of two.
PART_BITS = 20
LABELS = ("pre", "last", "uri", "parent_uri", "is_leaf", "depth")


def path_order(uri: Column) -> Column:
    """A key in whose order a subtree has no gap: the slash sorts before all other characters."""
    return F.translate(F.regexp_replace(uri, "([\x00-\x02])", "\x02$1"), "/", "\x01")


def labelled(nodes: DataFrame) -> DataFrame:
    """``nodes`` (unique uris, is_leaf) with ``pre`` and ``last``.

    One sort by range of the nodes and of an end marker for each directory; a
    marker's running count of nodes is the number of the last one below. A leaf
    ends at itself, a directory without anything below it too.
    """
    key = path_order(F.col("uri"))
    rows = nodes.select("uri", key.alias("key"), F.lit(0).alias("end"))
    ends = nodes.where(~F.col("is_leaf")).select("uri", F.concat(key, F.lit("\x02")).alias("key"), F.lit(1).alias("end"))
    put = placed(rows.unionByName(ends).withColumn("all", F.lit(0)), "all", ["key", "end"])
    counted = running(put, "all", (F.col("end") == 0).cast("int"), "n").select("uri", "end", (F.col("n") - 1).alias("n"))
    label = counted.groupBy("uri").agg(F.max(F.when(F.col("end") == 0, F.col("n"))).alias("pre"), F.max("n").alias("last"))
    return nodes.join(label, "uri")


@dataclass
class Tree:
    """A stored tree; ``nodes`` has ``LABELS`` and the documents' other columns, null for directories."""

    spark: SparkSession
    path: str

    @staticmethod
    def build(docs: DataFrame, path: str) -> Tree:
        """Write the tree of a document table: leaves, and the directories above them. Of documents with one uri, which a table of keys has not, the first in the order of all columns counts."""
        others = [c for c in docs.columns if c not in LABELS and c != "document"]
        order = F.struct(*[F.to_json(F.struct(F.col(c))) for c in docs.columns])
        one = docs.where("uri is not null").groupBy("uri").agg(F.min_by(F.struct(*[c for c in docs.columns if c != "uri"]), order).alias("d")).select("uri", "d.*")
        dirs = D.directories(one).join(one.select("uri"), "uri", "left_anti")
        below = one.join(D.directories(one).select("uri"), "uri", "left_semi").select("uri", F.lit(False).alias("__end"))  # a document with others below it ends like a directory
        leaves = one.join(below, "uri", "left").select("uri", "parent_uri", F.coalesce("__end", F.lit(True)).alias("is_leaf"), F.lit(True).alias("document"), D.depth(F.col("uri")).alias("depth"), *others)
        none = [F.lit(None).cast(one.schema[c].dataType).alias(c) for c in others]
        nodes = leaves.unionByName(dirs.select("uri", "parent_uri", F.lit(False).alias("is_leaf"), F.lit(False).alias("document"), "depth", *none))
        labelled(nodes).repartitionByRange("pre").sortWithinPartitions("pre").write.mode("overwrite").parquet(f"{path}/nodes")
        return Tree(docs.sparkSession, path)

    @property
    def nodes(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/nodes")

    def label(self, uri: str) -> tuple[int, int] | None:
        """(pre, last) of a node: one row, found by the files' bounds of the uri."""
        row = self.nodes.where(F.col("uri") == uri).select("pre", "last").first()
        return None if row is None else (row.pre, row.last)

    def subtree(self, uri: str) -> DataFrame:
        """A node and all below it, as a range of numbers; no row if it isn't there."""
        span = self.label(uri)
        return self.nodes.where(F.col("pre").between(*span)) if span else self.nodes.limit(0)

    def ancestors(self, uri: str) -> DataFrame:
        """The nodes above one, from the root."""
        span = self.label(uri)
        return self.nodes.where((F.col("pre") < span[0]) & (F.col("last") >= span[1])) if span else self.nodes.limit(0)

    def sums(self, **values: Column) -> DataFrame:
        """``(pre, uri, depth, ...)``: for every directory the sums of ``values`` over all nodes below it, nulls as 0.

        Running sums in parts of ``1 << PART_BITS`` nodes, then each directory meets the row of its last node.
        """
        low = (1 << PART_BITS) - 1
        place = F.shiftleft(F.shiftright("pre", PART_BITS), 33) + F.col("pre").bitwiseAND(low)
        rows = self.nodes.select("pre", place.alias("place"), F.lit(0).alias("all"), *[F.coalesce(v, F.lit(0)).cast("long").alias(k) for k, v in values.items()])
        for name in values:
            rows = running(rows, "all", F.col(name), f"__{name}")
        at_last = rows.select(F.col("pre").alias("last"), *[F.col(f"__{k}").alias(f"to_{k}") for k in values])
        dirs = self.nodes.where(~F.col("is_leaf")).select("pre", "last", "uri", "depth")
        both = dirs.join(at_last, "last").join(rows.select("pre", *[F.col(f"__{k}").alias(f"from_{k}") for k in values]), "pre")
        return both.select("pre", "uri", "depth", *[(F.col(f"to_{k}") - F.col(f"from_{k}")).alias(k) for k in values])

    def projection(self, matching: Column) -> DataFrame:
        """``(uri)``: matching documents and the directories above any of them."""
        hit = F.col("document") & F.coalesce(matching, F.lit(False))
        dirs = self.sums(hits=hit.cast("long")).where("hits > 0").select("uri")
        return self.nodes.where(hit).select("uri").unionByName(dirs).distinct()

    def removed(self, uri: str, recursive: bool = False) -> DataFrame:
        """``(uri)``: the documents that go with a node. What has others below it asks for ``recursive``."""
        span = self.label(uri)
        if span is not None and span[0] < span[1] and not recursive:
            raise ValueError(f"{uri} isn't empty")
        return self.subtree(uri).where("document").select("uri")

    def moved(self, source: str, target: str) -> tuple[DataFrame, DataFrame]:
        """(documents under their new names, uris that go) of moving a subtree within its scope; only its range is read."""
        from tessera.operators.namespace import _scope

        if _scope(source) != _scope(target):
            raise PermissionError(f"no move from {_scope(source)} to {_scope(target)}")
        if target == source or target.startswith(source + "/"):
            raise ValueError(f"{source} can't move into itself")
        rows = self.subtree(source).where("document")
        new = F.concat(F.lit(target), F.substring("uri", F.lit(len(source) + 1), F.length("uri")))
        changed = rows.withColumn("uri", new).withColumn("parent_uri", F.regexp_replace("uri", r"/[^/]+$", "")).withColumn("depth", D.depth(F.col("uri"))).withColumn("is_leaf", F.lit(True))
        return changed.drop("pre", "last", "document"), rows.select("uri")
