"""Document table, hierarchy, projections and upserts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import docs as D
from tessera.operators.features import hashed_weights

from .registry import query, table
from .retrieval import _PLAIN, _SYMBOLIC, _TOKENS, DOCS_SQL, _docs, _nation_uris

_CUSTOMERS = "SELECT 'ctx://resources/' || lower(replace(r_name, ' ', '-')) || '/' || lower(replace(n_name, ' ', '-')) || '/' || c_custkey AS uri FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"


def _customer_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = _nation_uris(spark, sf_dir)
    return c.join(n, c["c_nationkey"] == n["n_nationkey"]).select(F.concat("uri", F.lit("/"), F.col("c_custkey").cast("string")).alias("uri"))


@query(f"WITH u AS ({_CUSTOMERS}), p AS (SELECT uri, string_split(uri, '/') AS s FROM u), a AS (SELECT array_to_string(s[1:i], '/') AS uri, i - 3 AS depth FROM p, unnest(range(3, 6)) AS t(i)) SELECT uri, CAST(depth AS INTEGER) AS depth, count(*) AS leaves FROM a GROUP BY ALL")
def q_tree_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every directory of the customer tree with its depth and the leaves below it."""
    return D.directories(_customer_uris(spark, sf_dir)).select("uri", "depth", "leaves")


@query(f"WITH u AS ({_CUSTOMERS}), p AS (SELECT DISTINCT regexp_replace(uri, '/[^/]+$', '') AS uri FROM u) SELECT uri FROM p WHERE starts_with(uri, 'ctx://resources/europe/')")
def q_children_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.directories(_customer_uris(spark, sf_dir)).where("parent_uri = 'ctx://resources/europe'").select("uri")


@query(f"WITH {DOCS_SQL} SELECT uri, name FROM docs WHERE uri = 'ctx://resources/src1' OR starts_with(uri, 'ctx://resources/src1/')")
def q_prefix_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(S.under(F.col("uri"), "ctx://resources/src1")).select("uri", "name")


@query(f"WITH {DOCS_SQL} SELECT source, count(*) AS kept FROM docs WHERE NOT starts_with(uri, 'ctx://resources/src1/') GROUP BY source")
def q_prefix_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = D.delete_prefix(_docs(spark, sf_dir), "ctx://resources/src1")
    return kept.groupBy(F.get("tags", F.lit(1)).alias("source")).agg(F.count("*").alias("kept"))


@query("""WITH upd AS (SELECT o_orderkey, 'Z' AS o_orderstatus, o_totalprice * 2 AS o_totalprice FROM orders WHERE o_orderkey % 10 = 0)
SELECT o_orderkey, o_orderstatus, o_totalprice FROM upd UNION ALL SELECT o_orderkey, o_orderstatus, o_totalprice FROM orders WHERE o_orderkey NOT IN (SELECT o_orderkey FROM upd)""")
def q_upsert_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Replace by key: a snapshot of orders with a tenth of them changed."""
    base = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    upd = base.where("o_orderkey % 10 = 0").select("o_orderkey", F.lit("Z").alias("o_orderstatus"), (F.col("o_totalprice") * 2).alias("o_totalprice"))
    return D.upsert(base, upd, "o_orderkey")


@query("""WITH v AS (SELECT user_id, event_id, CASE WHEN event_type = 'purchase' THEN value END AS v FROM events)
SELECT user_id, max_by(v, event_id) FILTER (v IS NOT NULL) AS last_purchase, max(event_id) AS last_event FROM v GROUP BY user_id""")
def q_coalesce_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Field-wise upserts folded per key: the last value that isn't null stays."""
    e = table(spark, sf_dir, "events")
    v = F.when(F.col("event_type") == "purchase", F.col("value"))
    last = F.max_by(v, F.when(v.isNotNull(), F.col("event_id")))
    return e.groupBy("user_id").agg(last.alias("last_purchase"), F.max("event_id").alias("last_event"))


@query("""WITH cur AS (SELECT o_orderkey, md5(o_orderstatus || '|' || CASE WHEN o_orderkey % 7 = 0 THEN 'changed' ELSE o_orderpriority END) AS h FROM orders WHERE o_orderkey % 11 <> 0), old AS (SELECT o_orderkey, md5(o_orderstatus || '|' || o_orderpriority) AS h FROM orders WHERE o_orderkey % 13 <> 0)
SELECT coalesce(cur.o_orderkey, old.o_orderkey) AS o_orderkey, CASE WHEN old.h IS NULL THEN 'added' WHEN cur.h IS NULL THEN 'removed' ELSE 'changed' END AS change FROM cur FULL JOIN old ON cur.o_orderkey = old.o_orderkey WHERE cur.h IS DISTINCT FROM old.h""")
def q_cdc_changed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drift between a ledger of content hashes and the present content."""
    o = table(spark, sf_dir, "orders")
    now = F.when(F.col("o_orderkey") % 7 == 0, "changed").otherwise(F.col("o_orderpriority"))
    cur = o.where("o_orderkey % 11 <> 0").select(F.col("o_orderkey").alias("ck"), F.md5(F.concat_ws("|", "o_orderstatus", now)).alias("ch"))
    old = o.where("o_orderkey % 13 <> 0").select(F.col("o_orderkey").alias("ok"), F.md5(F.concat_ws("|", "o_orderstatus", "o_orderpriority")).alias("oh"))
    both = cur.join(old, F.col("ck") == F.col("ok"), "full_outer").where(~F.col("ch").eqNullSafe(F.col("oh")))
    return both.select(F.coalesce("ck", "ok").alias("o_orderkey"), F.when(F.col("oh").isNull(), "added").when(F.col("ch").isNull(), "removed").otherwise("changed").alias("change"))


@query(f"WITH {DOCS_SQL}, u AS (SELECT CASE doc_id % 3 WHEN 0 THEN uri WHEN 1 THEN 'ctx://user/memories/' || name ELSE 'ctx://agent/skills/' || name END AS uri FROM docs) SELECT CASE WHEN starts_with(uri, 'ctx://user/memories') THEN 'memories' WHEN starts_with(uri, 'ctx://agent/skills') THEN 'skills' ELSE 'resources' END AS bucket, CASE WHEN starts_with(uri, 'ctx://user/memories') THEN 'memory' WHEN starts_with(uri, 'ctx://agent/skills') THEN 'skill' ELSE 'resource' END AS context_type, count(*) AS n FROM u GROUP BY ALL")
def q_hit_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Buckets and context types by prefix."""
    third = F.col("doc_id") % 3
    uri = F.when(third == 0, F.col("uri")).when(third == 1, F.concat(F.lit("ctx://user/memories/"), "name")).otherwise(F.concat(F.lit("ctx://agent/skills/"), "name"))
    own = _docs(spark, sf_dir).select(uri.alias("uri"))
    return own.groupBy(D.hit_bucket(F.col("uri")).alias("bucket"), D.context_type(F.col("uri")).alias("context_type")).agg(F.count("*").alias("n"))


@query("SELECT page_id, CASE lower(string_split(url, '.')[-1]) WHEN 'html' THEN NULL WHEN 'txt' THEN 'text/plain' WHEN 'md' THEN 'text/markdown' WHEN 'json' THEN 'application/json' WHEN 'xml' THEN 'application/xml' END AS mime FROM pages")
def q_mime(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", D.mime(F.col("url"), F.lit(True)).alias("mime"))


@query("SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug FROM pages")
def q_page_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The default target of a fetched page: a slug of its address."""
    return table(spark, sf_dir, "pages").select("page_id", T.slug(F.col("url")).alias("slug"))


@query(f"WITH {DOCS_SQL} SELECT uri, list_sort(list_filter(list_transform(['auth', 'oauth', 'session', 'memory', 'skill', 'api'], lambda w: CASE WHEN contains(lower(content), w) THEN w END), lambda w: w IS NOT NULL)) AS tags FROM docs")
def q_infer_tags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("uri", D.infer_tags(F.col("name"), F.col("content")).alias("tags"))


@query(f"WITH {DOCS_SQL} SELECT uri, substr(coalesce(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x, ' ')), lambda x: contains(lower(x), 'license'))[1], abstract_text), 1, 240) AS snippet FROM docs")
def q_snippet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first line with a query word, else the abstract, cut at 240 characters."""
    lines = F.transform(F.split("content", "\n"), lambda x: F.trim(x))
    hit = F.get(F.filter(lines, lambda x: F.contains(F.lower(x), F.lit("license"))), F.lit(0))
    return _docs(spark, sf_dir).select("uri", F.substring(F.coalesce(hit, "abstract_text"), 1, 240).alias("snippet"))


@query("SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens FROM documents")
def q_token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"))


@query(r"SELECT CASE WHEN regexp_matches(text, '[\x{AC00}-\x{D7A3}\x{1100}-\x{11FF}\x{3130}-\x{318F}]') THEN 'hangul' WHEN regexp_matches(text, '[\x{3040}-\x{30FF}]') THEN 'kana' WHEN regexp_matches(text, '[\x{4E00}-\x{9FFF}]') THEN 'han' ELSE 'other' END AS profile, lang, count(*) AS n FROM documents GROUP BY ALL")
def q_language_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.groupBy(T.language_profile(F.col("text")).alias("profile"), "lang").agg(F.count("*").alias("n"))


@query(f"""WITH {DOCS_SQL}, w AS (SELECT parent_uri, unnest(list_filter(regexp_split_to_array(lower(content), '[^\\p{{L}}\\p{{N}}]+'), lambda x: length(x) >= 4)) AS term FROM docs), c AS (SELECT parent_uri, term, count(*) AS n FROM w GROUP BY ALL)
SELECT parent_uri, term, n FROM (SELECT *, row_number() OVER (PARTITION BY parent_uri ORDER BY n DESC, term) AS rn FROM c) WHERE rn <= 6""")
def q_directory_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The six most frequent longer words of each directory, found with a bounded top-k per group after partial sums."""
    from pyspark.sql import Window

    words = _docs(spark, sf_dir).select("parent_uri", F.explode(F.filter(T.alnum_words(F.col("content")), lambda x: F.length(x) >= 4)).alias("term"))
    c = words.groupBy("parent_uri", "term").agg(F.count("*").alias("n"))
    w = Window.partitionBy("parent_uri").orderBy(F.desc("n"), "term")
    return c.withColumn("rn", F.row_number().over(w)).where("rn <= 6").select("parent_uri", "term", "n")


@query("SELECT vec_id, list_transform(range(0, 16), lambda k: round(CAST(embedding[k + 1] AS DOUBLE) - 0.5 * embedding[k + 17] + embedding[k + 33] - 0.5 * embedding[k + 49], 5)) AS folded FROM embeddings")
def q_project_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors folded to 16 numbers, odd folds at minus a half."""
    e = table(spark, sf_dir, "embeddings")
    at = lambda i: F.get("embedding", i).cast("double")
    own = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: S.rounded(at(k) - 0.5 * at(k + 16) + at(k + 32) - 0.5 * at(k + 48), 5))
    return e.select("vec_id", own.alias("folded"))


def _canonical(t: str) -> str:
    own = "CASE " + " ".join(f"WHEN trim({t}, ' ') IN ({', '.join(repr(w) for w in words)}) THEN '{name}'" for name, words in T.SYNONYMS.items()) + f" ELSE trim({t}, ' ') END"
    return own


_STEM = " ".join(f"WHEN ends_with(c, '{e}') AND strlen(c) > 4 AND strlen(c) - {len(e)} >= 3 THEN substr(c, 1, length(c) - {len(e)})" for e in ("ing", "ed", "es", "s"))
_TOK = _TOKENS.format(c="content")


@query(f"""WITH {DOCS_SQL}, t AS (SELECT uri, list_concat({_PLAIN.format(t=_TOK)}, {_SYMBOLIC.format(t=_TOK)}) AS ts FROM docs), one AS (SELECT uri, {_canonical("x")} AS c FROM (SELECT uri, unnest(ts) AS x FROM t)),
f AS (SELECT uri, CASE {_STEM} ELSE c END AS f, 1.0 AS w FROM one UNION ALL SELECT uri, 'tri:' || g, 0.35 FROM (SELECT uri, unnest(CASE WHEN length(x) <= 3 THEN [x] ELSE list_transform(range(1, length(x) - 1), lambda i: substr(x, i, 3)) END) AS g FROM (SELECT uri, unnest(ts) AS x FROM t))
 UNION ALL SELECT uri, 'bi:' || b, 0.8 FROM (SELECT uri, unnest(list_transform(range(1, len(ts)), lambda i: ts[i] || ' ' || ts[i + 1])) AS b FROM t)), c AS (SELECT uri, CAST('0x' || substr(md5(f), 1, 4) AS BIGINT) % 64 AS b, sum(w) AS w FROM f GROUP BY ALL), n AS (SELECT uri, sqrt(sum(w * w)) AS norm, map_from_entries(list((b, w))) AS m FROM c GROUP BY uri)
SELECT uri, list_transform(range(0, 64), lambda i: round(coalesce(m[i], 0) / norm, 4)) AS vec FROM n""")
def q_feature_hash_embed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """64-bucket feature-hash vectors of the documents, normalised: tokens, trigrams at 0.35, pairs at 0.8, all with their repeats."""
    own = hashed_weights(_docs(spark, sf_dir), "uri", T.tokenize(F.col("content")))
    square = F.aggregate("weights", F.lit(0).cast("long"), lambda acc, w: acc + w * w)
    return own.withColumn("norm", F.sqrt(square / 10000.0)).select("uri", F.transform("weights", lambda w: S.rounded(w / 100.0 / F.col("norm"), 4)).alias("vec"))
