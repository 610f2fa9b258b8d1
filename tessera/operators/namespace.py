"""The URI namespace as data: scope roots, moves, removals, relations of directories, memory records as documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.operators import docs as D

WRITABLE = ("resources", "user", "agent", "session")


def _scope(uri: str) -> str:
    return uri.split("://", 1)[1].split("/", 1)[0]


def scope_roots(docs: DataFrame, scopes: list[str]) -> DataFrame:
    """The roots of the scopes that are there, in the order asked for."""
    order = F.create_map(*[F.lit(x) for i, s in enumerate(dict.fromkeys(scopes)) for x in (D.SCHEME + s, i)])
    own = docs.where(F.col("uri").isin([D.SCHEME + s for s in scopes])).select("uri").distinct()
    return own.select("uri", order[F.col("uri")].alias("place"))


def make_directory(docs: DataFrame, uri: str) -> DataFrame:
    """The directory and those above it, as rows that aren't there yet; only writable scopes have any."""
    if _scope(uri) not in WRITABLE:
        raise PermissionError(f"no directories in scope {_scope(uri)}")
    one = docs.sparkSession.createDataFrame([(uri,)], "uri string")
    new = one.select(F.explode(F.concat(D.ancestors(F.col("uri")), F.array("uri"))).alias("uri")).join(docs.select("uri"), "uri", "left_anti")
    parent = F.when(D.depth(F.col("uri")) > 0, F.regexp_replace("uri", r"/[^/]+$", ""))
    return new.select("uri", parent.alias("parent_uri"), F.lit(False).alias("is_leaf"))


def remove(docs: DataFrame, uri: str, recursive: bool) -> DataFrame:
    """The documents without one, or without its subtree. Removing what has children asks for ``recursive``."""
    if not recursive and not docs.where(F.startswith("uri", F.lit(uri + "/"))).isEmpty():
        raise ValueError(f"{uri} isn't empty")
    return D.delete_prefix(docs, uri)


def move(docs: DataFrame, source: str, target: str) -> DataFrame:
    """The documents with a subtree under another name, in the same scope; what was at the target's names goes."""
    if _scope(source) != _scope(target):
        raise PermissionError(f"no move from {_scope(source)} to {_scope(target)}")
    uri = F.col("uri")
    here = S.under(uri, source)
    new = F.concat(F.lit(target), F.substring(uri, F.lit(len(source) + 1), F.length(uri)))
    moved = docs.where(here).withColumn("uri", new)
    moved = moved.withColumn("parent_uri", F.regexp_replace("uri", r"/[^/]+$", ""))
    if "depth" in docs.columns:
        moved = moved.withColumn("depth", D.depth(F.col("uri")))
    rest = docs.where(~here).join(moved.select("uri"), "uri", "left_anti").select(*docs.columns)
    return rest.unionByName(moved.select(*docs.columns))


def relation_faults(relations: DataFrame) -> DataFrame:
    """Relations that can't be written, with what is wrong: an owner's ids are unique, members distinct and two or more."""
    ids = relations.groupBy("owner_uri", F.trim("id").alias("key")).agg(F.count("*").alias("times"))
    both = relations.withColumn("key", F.trim("id")).join(ids, ["owner_uri", "key"])
    bad_uri = F.exists("uris", lambda u: ~u.rlike(r"^[a-z]+://(?:%s)(?:/|$)" % "|".join(D.SCOPES)))
    rules = [
        (F.col("key") == "", "empty_id"), (F.col("times") > 1, "duplicate_id"), (F.trim("reason") == "", "empty_reason"), (F.size("uris") < 2, "too_few"),
        (bad_uri, "invalid_uri"), (F.size(F.array_distinct("uris")) < F.size("uris"), "duplicate_uri"),
    ]
    faults = F.array_compact(F.array(*[F.when(bad, name) for bad, name in rules]))
    return both.select("owner_uri", "id", faults.alias("faults")).where(F.size("faults") > 0)


def link(relations: DataFrame, new: DataFrame) -> DataFrame:
    """``relations`` with new ones; an owner's relation of the same id is replaced."""
    return relations.join(new.select("owner_uri", "id"), ["owner_uri", "id"], "left_anti").select(*relations.columns).unionByName(new.select(*relations.columns))


def unlink(relations: DataFrame, owner: str, id: str) -> DataFrame:
    return relations.where(~((F.col("owner_uri") == owner) & (F.col("id") == id)))


def relation_documents(relations: DataFrame) -> DataFrame:
    """Each owner's relations as one JSON document, by id; an owner's relations are one value by definition."""
    own = F.array_sort(F.collect_list(F.struct("id", "uris", "reason")))
    return relations.groupBy("owner_uri").agg(F.to_json(own).alias("document"))


def memory_records(records: DataFrame) -> DataFrame:
    """Observational memory records as leaf documents: the first observation line is the abstract."""
    uri = F.concat(F.lit(D.SCHEME + "agent/om/"), "scope_key")
    return records.select(
        uri.alias("uri"), F.lit(D.SCHEME + "agent/om").alias("parent_uri"), F.lit(True).alias("is_leaf"), F.lit("om_record").alias("context_type"),
        F.concat(F.lit("OM: "), "scope_key").alias("name"), F.get(F.split("active_observations", "\n"), F.lit(0)).alias("abstract_text"), F.col("active_observations").alias("content"),
        F.array(F.lit("om"), "scope").alias("tags"), "updated_at", D.depth(uri).alias("depth"),
    )
