"""Typed relations of hits, by equality joins on prefixes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.operators.packing import _kept


def prefixes(uris: DataFrame, column: str = "uri") -> DataFrame:
    """``(column, prefix)``: each uri with itself and everything above it."""
    return uris.select(column, F.explode(F.concat(F.array(column), D.ancestors(F.col(column)))).alias("prefix"))


def object_types(uris: DataFrame, rules: DataFrame) -> DataFrame:
    """``(uri, object_type)`` by the longest prefix in ``rules(prefix, object_type)``, null if none holds.

    All prefixes of a uri are looked up at once, so rules may be a table of any
    size. Of rules with one prefix the least type counts.
    """
    own = uris.select("uri").distinct()
    one = rules.groupBy("prefix").agg(F.min("object_type").alias("object_type"))
    best = prefixes(own).join(one, "prefix").groupBy("uri").agg(F.max_by("object_type", F.length("prefix")).alias("object_type"))
    return own.join(best, "uri", "left")


def least(up: DataFrame, relations: DataFrame, by: list[str], most: int) -> DataFrame:
    """``(uri, place, related, *by)``: the ``most`` least ``(related, *by)`` of each uri, all different.

    ``up(owner_uri, uri)`` says which owners' relations a uri looks at. A relation
    goes by the least of its members beside the uri; of relations that come after ``most`` others none has a
    member to give, so members are unfolded of those alone. Both cuts are ranks over sorted rows: no uri's relations are held at once.
    """
    own = relations.select("owner_uri", *by, F.sort_array(F.array_compact(F.array_distinct("uris"))).alias("all"))
    few = F.slice("all", 1, most + 1)  # one of them may be the uri itself
    member = own.select("owner_uri", *by, "all", few.alias("few")).select("owner_uri", *by, "few", F.explode("all").alias("uri"))
    others = member.withColumn("few", F.slice(F.array_remove("few", F.col("uri")), 1, most)).where(F.size("few") > 0)
    met = up.join(others, ["owner_uri", "uri"]).withColumn("related", F.get("few", F.lit(0)))
    first = met.withColumn("place", F.dense_rank().over(Window.partitionBy("owner_uri", "uri").orderBy("related", *by))).where(F.col("place") <= most)
    edge = first.select("uri", F.explode("few").alias("related"), *by)
    best = edge.withColumn("place", F.dense_rank().over(Window.partitionBy("uri").orderBy("related", *by))).where(F.col("place") <= most)
    return best.select("uri", "place", "related", *by).dropDuplicates(["uri", "place"])


def edges(hits: DataFrame, relations: DataFrame, most: int = 5, rules: DataFrame | None = None, link_types: DataFrame | None = None) -> DataFrame:
    """``(uri, place, related, reason, relation_type, source_type, target_type)``: up to ``most`` related uris of each hit.

    ``relations`` has owner_uri, id, reason and uris; an owner is above the
    hit, or the hit itself. Edges differ by uri, relation and reason, and go by uri, reason and relation. A hit looks at the
    least ``most`` + 1 members of each relation alone, one of which may be itself, so a
    relation of m members gives m rows, not m times m (``least``). With
    ``rules`` (``object_types``) and ``link_types(id)`` edges are typed; without, types are null.
    """
    out = least(prefixes(hits.select("uri").distinct()).withColumnRenamed("prefix", "owner_uri"), relations, ["reason", "id"], most)
    null = F.lit(None).cast("string")
    if rules is None:
        return out.select("uri", "place", "related", "reason", null.alias("relation_type"), null.alias("source_type"), null.alias("target_type"))
    out = _kept(out, "edges")  # read four times below
    kinds = object_types(out.select("uri").unionByName(out.select(F.col("related").alias("uri"))), rules)
    source, target = (kinds.select(F.col("uri").alias(u), F.col("object_type").alias(t)) for u, t in (("uri", "source_type"), ("related", "target_type")))
    typed = out.join(source, "uri", "left").join(target, "related", "left")
    known = null.alias("relation_type") if link_types is None else F.col("relation_type")
    if link_types is not None:
        typed = typed.join(link_types.select("id", F.col("id").alias("relation_type")).distinct(), "id", "left")
    return typed.select("uri", "place", "related", "reason", known, "source_type", "target_type")
