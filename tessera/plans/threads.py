"""Typed relations, thread references, the measures of records, and reconciling by digests."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks as C
from tessera.operators import om as Z
from tessera.operators import reconcile as X
from tessera.operators import relations as L
from tessera.sources.shared import drop_at_exit, shared_dir

from .memory import MSG_SQL, _msgs
from .registry import query, table


@query("""WITH m AS (SELECT l_orderkey AS id, o_orderpriority AS reason, list(DISTINCT 'ctx://resources/parts/' || p_brand || '/' || l_partkey) AS uris FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey GROUP BY ALL),
rules AS (SELECT DISTINCT 'ctx://resources/parts/' || p_brand AS prefix, 'brand ' || p_brand AS kind FROM part WHERE p_brand < 'Brand#3' UNION ALL SELECT 'ctx://resources/parts', 'part' UNION ALL SELECT DISTINCT 'ctx://resources/parts/' || p_brand || '/' || p_partkey, 'large part' FROM part WHERE p_size > 40),
u AS (SELECT id, reason, unnest(uris) AS uri, uris FROM m), e AS (SELECT DISTINCT uri, id, reason, related FROM (SELECT uri, id, reason, unnest(uris) AS related FROM u) WHERE related <> uri),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY related, reason, CAST(id AS VARCHAR)) AS place FROM e) WHERE place <= 5),
t AS (SELECT uri, coalesce(CASE WHEN p_size > 40 THEN 'large part' END, CASE WHEN p_brand < 'Brand#3' THEN 'brand ' || p_brand END, 'part') AS kind FROM (SELECT *, 'ctx://resources/parts/' || p_brand || '/' || p_partkey AS uri FROM part))
SELECT top.uri, CAST(place AS INTEGER) AS place, related, reason, CASE WHEN id % 2 = 0 THEN CAST(id AS VARCHAR) END AS relation_type, a.kind AS source_type, b.kind AS target_type FROM top JOIN t a ON a.uri = top.uri JOIN t b ON b.uri = related""")
def q_typed_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five typed edges of every part: an order relates its parts, types go by the longest prefix among a table of rules."""
    li, o, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    root = "ctx://resources/parts"
    uri = F.concat(F.lit(f"{root}/"), "p_brand", F.lit("/"), F.col("p_partkey").cast("string"))
    members = li.join(p, F.col("l_partkey") == F.col("p_partkey")).groupBy("l_orderkey").agg(F.collect_set(F.struct("p_brand", "p_partkey")).alias("own"))  # an order has a few lines
    uris = F.transform("own", lambda x: F.concat(F.lit(f"{root}/"), x["p_brand"], F.lit("/"), x["p_partkey"].cast("string")))
    relations = members.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit(root).alias("owner_uri"), F.col("l_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("reason"), uris.alias("uris"))
    brands = p.where("p_brand < 'Brand#3'").select(F.concat(F.lit(f"{root}/"), "p_brand").alias("prefix"), F.concat(F.lit("brand "), "p_brand").alias("object_type")).distinct()
    rules = brands.unionByName(p.where("p_size > 40").select(uri.alias("prefix"), F.lit("large part").alias("object_type"))).unionByName(p.groupBy().agg(F.lit(root).alias("prefix"), F.lit("part").alias("object_type")))
    return L.edges(p.select(uri.alias("uri")), relations, 5, rules, o.where("o_orderkey % 2 = 0").select(F.col("o_orderkey").cast("string").alias("id")))


_REFS = f"""{MSG_SQL}, r AS (SELECT id, CASE turn % 3 WHEN 0 THEN 'session' WHEN 1 THEN 'thread' ELSE 'resource' END AS scope, CASE session_id % 4 WHEN 0 THEN 'session:' || session_id WHEN 1 THEN ' thread:t' || session_id WHEN 2 THEN 'resource: r' || session_id ELSE 'x' END AS key,
 CASE WHEN turn % 5 = 0 THEN 'thread:' || turn WHEN turn % 5 = 1 THEN ' ' END AS thread, CASE WHEN turn % 7 < 3 THEN 'session: ' || session_id WHEN turn % 7 = 3 THEN '' END AS session, CASE WHEN turn % 2 = 0 THEN 'res' || turn END AS resource FROM msgs)"""


def _behind(v: str, prefix: str) -> str:
    return f"CASE WHEN starts_with({v}, '{prefix}') THEN nullif(trim(substr({v}, {len(prefix) + 1}), ' '), '') END"


def _plain(v: str) -> str:
    own = f"nullif(trim({v}, ' '), '')"
    return f"coalesce({_behind(own, 'thread:')}, {_behind(own, 'session:')}, {own})"


_T, _S = f"coalesce(nullif(trim(thread, ' '), ''), {_behind('k', 'thread:')})", f"coalesce(nullif(trim(session, ' '), ''), {_behind('k', 'session:')})"
_R = f"coalesce(nullif(trim(resource, ' '), ''), CASE WHEN scope = 'resource' THEN {_behind('k', 'resource:')} END)"


@query(f"""WITH {_REFS}, n AS (SELECT *, trim(key, ' ') AS k FROM r) SELECT id, coalesce(CASE scope WHEN 'thread' THEN {_behind("key", "thread:")} WHEN 'session' THEN {_behind("key", "session:")} END, {_plain("thread")}, {_plain("session")}, {_plain("resource")}, k) AS runtime_id,
CASE WHEN scope = 'session' THEN coalesce('session:' || {_S}, 'thread:' || {_T}, 'resource:' || {_R}, 'session:default') ELSE coalesce('thread:' || {_T}, 'session:' || {_S}, 'resource:' || {_R}, scope || ':default') END AS engine_id,
scope || ':' || nullif(trim(CASE scope WHEN 'session' THEN session WHEN 'thread' THEN thread ELSE resource END, ' '), '') AS scope_key FROM n""")
def q_thread_refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both canonical identifiers of every message's thread, and the key of its scope."""
    turn, session = F.col("turn"), F.col("session_id").cast("string")
    kind = F.when(turn % 3 == 0, "session").when(turn % 3 == 1, "thread").otherwise("resource")
    at = F.col("session_id") % 4
    key = F.when(at == 0, F.concat(F.lit("session:"), session)).when(at == 1, F.concat(F.lit(" thread:t"), session)).when(at == 2, F.concat(F.lit("resource: r"), session)).otherwise("x")
    thread = F.when(turn % 5 == 0, F.concat(F.lit("thread:"), turn.cast("string"))).when(turn % 5 == 1, " ")
    own = F.when(turn % 7 < 3, F.concat(F.lit("session: "), session)).when(turn % 7 == 3, "")
    resource = F.when(turn % 2 == 0, F.concat(F.lit("res"), turn.cast("string")))
    none = F.lit(None).cast("string")
    ref = C.canonical_thread_ref(kind, key, none, own, thread, none, resource)
    return _msgs(spark, sf_dir).select("id", C.canonical_thread_id(kind, key, thread, own, resource).alias("runtime_id"), ref["canonical_thread_id"].alias("engine_id"), C.scope_key(kind, own, thread, resource).alias("scope_key"))


@query(f"""WITH {MSG_SQL}, r AS (SELECT session_id, max(turn) AS last, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, CAST(sum(CASE WHEN turn % 2 = 0 THEN ceil(length(text) / 4.0) END) AS BIGINT) AS pending, count(*) FILTER (role = 'user') AS seen, count(*) FILTER (role = 'assistant') AS told FROM msgs GROUP BY session_id)
SELECT count(*) AS records_total, count(*) FILTER (last % 2 = 0) AS observing_count, count(*) FILTER (tokens > 200) AS reflecting_count, count(*) FILTER (last > 4) AS buffering_observation_count, count(*) FILTER (session_id % 3 = 0) AS buffering_reflection_count,
CAST(coalesce(sum(tokens), 0) AS BIGINT) AS observation_tokens_active, CAST(coalesce(sum(pending), 0) AS BIGINT) AS pending_message_tokens, CAST(coalesce(sum(seen), 0) AS BIGINT) AS observer_trigger_count_total, CAST(coalesce(sum(told), 0) AS BIGINT) AS reflector_trigger_count_total FROM r""")
def q_om_status_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nine measures of the sessions' records."""
    size = T.estimate_tokens(F.col("text"))
    r = _msgs(spark, sf_dir).groupBy("session_id").agg(
        F.max("turn").alias("last"), F.sum(size).alias("observation_token_count"), F.sum(F.when(F.col("turn") % 2 == 0, size)).alias("pending_message_tokens"),
        F.count_if(F.col("role") == "user").alias("observer_trigger_count_total"), F.count_if(F.col("role") == "assistant").alias("reflector_trigger_count_total"),
    )
    flags = {"is_observing": F.col("last") % 2 == 0, "is_reflecting": F.col("observation_token_count") > 200, "is_buffering_observation": F.col("last") > 4, "is_buffering_reflection": F.col("session_id") % 3 == 0}
    return Z.status(r.withColumns(flags))


_LEDGER = """l AS (SELECT 'ctx://resources/' || source || '/' || lang || '/' || doc_id || '.txt' AS uri, md5(text) AS h FROM documents), d AS (SELECT 'ctx://resources/' || source || '/' || lang || '/' || doc_id || CASE WHEN source = 'src3' AND lang = 'fr' THEN '.md' ELSE '.txt' END AS uri, md5(CASE WHEN source = 'src1' AND lang <> 'en' THEN text || 'x' ELSE text END) AS h FROM documents),
f AS (SELECT coalesce(l.uri, d.uri) AS uri, d.h, CASE WHEN d.h IS NULL THEN 'missing' WHEN l.h IS NULL THEN 'untracked' WHEN l.h <> d.h THEN 'changed' END AS drift FROM l FULL JOIN d ON l.uri = d.uri)"""


def _trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """A ledger of the documents and a listing in which a source has changed and files of another one have other names, with their trees."""
    d = table(spark, sf_dir, "documents")
    uri = lambda end: F.concat(F.lit("ctx://resources/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), end).alias("uri")
    renamed = F.when((F.col("source") == "src3") & (F.col("lang") == "fr"), ".md").otherwise(".txt")
    text = F.when((F.col("source") == "src1") & (F.col("lang") != "en"), F.concat("text", F.lit("x"))).otherwise(F.col("text"))
    ledger, listing = d.select(uri(F.lit(".txt")), F.md5("text").alias("hash")), d.select(uri(renamed), F.md5(text).alias("hash"))
    out = [ledger, listing]
    for df in (ledger, listing):
        path = f"{shared_dir(spark)}/tree-{uuid.uuid4().hex}"
        drop_at_exit(spark, path)
        out.append(X.build_tree(df, path))
    return tuple(out)


@query(f"WITH {_LEDGER} SELECT uri, drift FROM f WHERE drift IS NOT NULL")
def q_tree_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift by digests of directories: only those that differ are opened."""
    _, _, a, b = _trees(spark, sf_dir)
    return X.drift(a, b).rows


@query(f"WITH {_LEDGER} SELECT uri, h AS hash FROM f WHERE drift IS DISTINCT FROM 'missing'")
def q_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger after reconciling: missing files pruned, changed and untracked ones taken in."""
    return X.reconcile(*_trees(spark, sf_dir))[0]
