"""Ranked retrieval queries."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import scoring as S
from tessera.functions import text as T
from tessera.operators import docs as D
from tessera.operators import retrieval as R
from tessera.sources.shared import drop_at_exit, shared_dir

from .registry import query, table

TERMS = ["license", "version", "token", "pathetic", "thing"]
AS_OF = "2024-02-01 00:00:00"
#: The document table in SQL.
DOCS_SQL = """docs AS (SELECT doc_id, 'ctx://resources/' || source || '/' || lang || '/' || doc_id || '.txt' AS uri,
  'ctx://resources/' || source || '/' || lang AS parent_uri, doc_id || '.txt' AS name, text AS content, lang, source,
  coalesce(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '')[1], '') AS abstract_text,
  TIMESTAMP '2024-01-01' + to_days(CAST(doc_id AS INTEGER)) AS updated_at FROM documents)"""
WORDS_SQL = r"""words AS (SELECT uri, unnest(list_filter(regexp_split_to_array(lower(content), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM docs),
post AS (SELECT uri, term, count(*) AS tf FROM words GROUP BY ALL)"""
BM25_SQL = """lens AS (SELECT uri, sum(tf) AS doc_len FROM post GROUP BY uri), corpus AS (SELECT count(*) AS n, avg(doc_len) AS avg_len FROM lens),
hits AS (SELECT * FROM post WHERE term IN (%s)), dfs AS (SELECT term, count(*) AS df FROM hits GROUP BY term),
bm AS (SELECT uri, sum(greatest(ln(1 + (n - df + 0.5) / (df + 0.5)), 0) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * doc_len / avg_len))) AS bm25, count(*) AS matched
  FROM hits JOIN dfs USING (term) JOIN lens USING (uri) CROSS JOIN corpus GROUP BY uri)"""


def _in(words: list[str]) -> str:
    return ", ".join(f"'{w}'" for w in words)


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.from_documents(table(spark, sf_dir, "documents"))


_INDEXES: dict[tuple, R.Index] = {}


def _index(spark: SparkSession, sf_dir: str, weighted: bool) -> R.Index:
    """The stored index of the documents: built once a session for a table as it is, then read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/documents.parquet")
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path)
    key = (spark.sparkContext.applicationId, sf_dir, weighted, there.getLength(), there.getFileCount())
    if key not in _INDEXES:
        docs = _docs(spark, sf_dir)
        folder = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
        drop_at_exit(spark, folder)
        _INDEXES[key] = R.build_index(D.postings(docs) if weighted else D.word_postings(docs), folder)
    return _INDEXES[key]


@query(f"WITH {DOCS_SQL}, {WORDS_SQL}, {BM25_SQL % _in(TERMS)} SELECT uri, round(bm25, 4) AS score, matched FROM bm ORDER BY score DESC, uri LIMIT 10")
def q_bm25_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over plain words, the ten best documents."""
    found = _index(spark, sf_dir, False).bm25(spark, TERMS)
    return R.top(found.select("uri", F.round("bm25", 4).alias("score"), "matched"), 10)


@query(f"WITH {DOCS_SQL}, {WORDS_SQL}, {BM25_SQL % _in(TERMS)} SELECT uri, round(bm25, 4) AS score, matched FROM bm")
def q_bm25_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same scores of all matching documents without an index, by one scan for the statistics and one for the scores."""
    found = R.bm25_scan(_docs(spark, sf_dir), T.alnum_words(F.col("content")), TERMS, ["uri"])
    return found.select("uri", F.round("bm25", 4).alias("score"), "matched")


_TOKENS = r"""(list_filter(list_transform(list_filter(regexp_split_to_array({c}, '\s+'), lambda x: x <> ''), lambda x: regexp_replace(x, '^[!"#$%&''()*+,;<=>?@\[\\\]^`{{|}}~]+|[!"#$%&''()*+,;<=>?@\[\\\]^`{{|}}~]+$', '', 'g')), lambda x: x <> ''))"""
_PLAIN = r"""flatten(list_transform({t}, lambda x: list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(x, '(\p{{Lu}}\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g'), '(\p{{Ll}})(\p{{Lu}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+'), lambda y: y <> '')))"""
_SYMBOLIC = r"""list_transform(list_filter({t}, lambda x: regexp_matches(x, '[\p{{L}}\p{{N}}]')), lambda x: lower(x))"""


def _field(column: str, plain: int, symbolic: int) -> str:
    t = _TOKENS.format(c=column)
    return f"SELECT uri, unnest({_PLAIN.format(t=t)}) AS term, {plain} AS w FROM docs UNION ALL SELECT uri, unnest({_SYMBOLIC.format(t=t)}) AS term, {symbolic} AS w FROM docs"


_WEIGHTED_SQL = f"""weighted AS ({" UNION ALL ".join([_field("name || ' ' || abstract_text || ' ' || content || ' ' || lang || ' ' || source", 1, 1), _field("name", 2, 3), _field("uri", 2, 4), _field("lang || ' ' || source", 2, 2)])}),
post AS (SELECT uri, term, CAST(sum(w) AS BIGINT) AS tf FROM weighted GROUP BY ALL)"""


@query(f"WITH {DOCS_SQL}, {_WEIGHTED_SQL}, {BM25_SQL % _in(TERMS)} SELECT uri, round(bm25, 4) AS score, matched FROM bm ORDER BY score DESC, uri LIMIT 20")
def q_bm25_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 over weighted plain and symbolic tokens of text, name, uri and tags."""
    found = _index(spark, sf_dir, True).bm25(spark, TERMS)
    return R.top(found.select("uri", F.round("bm25", 4).alias("score"), "matched"), 20)


@query(f"WITH {DOCS_SQL}, {_WEIGHTED_SQL}, d AS (SELECT term, count(*) AS df, sum(tf) AS tf FROM post GROUP BY term) SELECT df, CAST(count(*) AS BIGINT) AS terms, CAST(sum(tf) AS BIGINT) AS total_tf FROM d GROUP BY df")
def q_corpus_statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many terms occur in how many documents."""
    d = D.postings(_docs(spark, sf_dir)).groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("tf"))
    return d.groupBy("df").agg(F.count("*").alias("terms"), F.sum("tf").alias("total_tf"))


@query(f"""WITH {DOCS_SQL}, {WORDS_SQL}, sizes AS (SELECT uri, count(*) AS n FROM post GROUP BY uri), m AS (SELECT uri, count(*) AS inter FROM post WHERE term IN ({_in(TERMS)}) GROUP BY uri)
SELECT uri, inter AS matched, round(inter / ({len(TERMS)} + n - inter), 6) AS jaccard FROM m JOIN sizes USING (uri)""")
def q_jaccard_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token overlap of each document with the query's terms."""
    found = _index(spark, sf_dir, False).bm25(spark, TERMS)
    return found.select("uri", "matched", F.round(F.col("matched") / (len(TERMS) + F.col("terms") - F.col("matched")), 6).alias("jaccard"))


@query(f"WITH {DOCS_SQL} SELECT uri, CAST(1 AS DOUBLE) AS literal FROM docs WHERE contains(lower(content), 'apache license')")
def q_literal_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).where(F.contains(F.lower("content"), F.lit("apache license"))).select("uri", F.lit(1.0).alias("literal"))


_QV = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"


def _query_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


@query(f"SELECT vec_id, label, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QV} AS DOUBLE[])), 5) AS score FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10")
def q_dense_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest vectors by dot product; the query vector is one row."""
    found = R.dense(table(spark, sf_dir, "embeddings").where("vec_id <> 0"), _query_vector(spark, sf_dir))
    return R.top(found.select("vec_id", "label", F.round("score", 5).alias("score")), 10, key="vec_id")


@query(f"SELECT vec_id, round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QV} AS DOUBLE[])), 5) AS score FROM embeddings WHERE round(list_dot_product(CAST(embedding AS DOUBLE[]), CAST({_QV} AS DOUBLE[])), 5) >= 0.1")
def q_dense_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.dense(table(spark, sf_dir, "embeddings"), _query_vector(spark, sf_dir))
    return found.select("vec_id", F.round("score", 5).alias("score")).where("score >= 0.1")


@query("""WITH q AS (SELECT label, vec_id AS query_id, embedding AS qe FROM embeddings WHERE vec_id % 100 = 0)
SELECT query_id, vec_id, sim FROM (SELECT query_id, vec_id, round(list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[]))) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) AS sim,
row_number() OVER (PARTITION BY query_id ORDER BY round(list_dot_product(CAST(qe AS DOUBLE[]), CAST(embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(qe AS DOUBLE[]), CAST(qe AS DOUBLE[]))) / sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))), 5) DESC, vec_id) AS rn
FROM q JOIN embeddings USING (label) WHERE vec_id <> query_id) WHERE rn = 1""")
def q_full_cosine_best_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best match within its category for every stated query vector; an aggregate, so no group is sorted."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id % 100 = 0").select("label", F.col("vec_id").alias("query_id"), F.col("embedding").alias("qe"))
    pairs = e.join(q, "label").where("vec_id <> query_id").select("query_id", "vec_id", F.round(S.cosine(F.col("qe"), F.col("embedding")), 5).alias("sim"))
    best = pairs.groupBy("query_id").agg(F.max(F.struct("sim", (-F.col("vec_id")).alias("neg"))).alias("b"))
    return best.select("query_id", (-F.col("b.neg")).alias("vec_id"), F.col("b.sim").alias("sim"))


@query(f"SELECT event_id, round(1 / (1 + greatest(floor((epoch(TIMESTAMP '{AS_OF}') - floor(epoch(ts))) / 86400), 0) / 30), 6) AS recency FROM events")
def q_recency_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    as_of = F.lit(AS_OF).cast("timestamp_ntz").cast("timestamp")
    return table(spark, sf_dir, "events").select("event_id", F.round(S.recency(F.col("ts").cast("timestamp"), as_of), 6).alias("recency"))


_NATIONS = "SELECT 'ctx://resources/' || lower(replace(r_name, ' ', '-')) || '/' || lower(replace(n_name, ' ', '-')) AS uri FROM nation JOIN region ON n_regionkey = r_regionkey"


def _nation_uris(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, r = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    part = lambda c: F.lower(F.replace(c, F.lit(" "), F.lit("-")))
    return n.join(r, n["n_regionkey"] == r["r_regionkey"]).select(F.concat(F.lit("ctx://resources/"), part(F.col("r_name")), F.lit("/"), part(F.col("n_name"))).alias("uri"), "n_nationkey", "r_name")


@query(f"WITH u AS ({_NATIONS} UNION ALL SELECT 'ctx://resources/asia') SELECT uri, CASE WHEN uri = 'ctx://resources/asia' THEN 1.0 WHEN starts_with(uri, 'ctx://resources/asia/') THEN 0.8 ELSE 0.0 END::DOUBLE AS path_score FROM u")
def q_path_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    uris = _nation_uris(spark, sf_dir).select("uri").unionByName(spark.createDataFrame([("ctx://resources/asia",)], "uri string"))
    return uris.select("uri", S.path_score(F.col("uri"), "ctx://resources/asia").alias("path_score"))


_PART_Q = "small ring"


@query(f"""WITH u AS (SELECT p_partkey, p_name, 'ctx://resources/parts/' || p_name || '.md' AS uri FROM part)
SELECT p_partkey, CASE WHEN lower(uri) = lower('{_PART_Q}') THEN 1.0 WHEN lower(p_name) = lower('{_PART_Q}') THEN 0.99 WHEN lower(p_name || '.md') = lower('{_PART_Q}') THEN 0.98 END::DOUBLE AS exact
FROM u WHERE lower(p_name) = lower('{_PART_Q}')""")
def q_exact_ladder_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ladder over part names; rows with a literal match."""
    p = table(spark, sf_dir, "part").withColumn("uri", F.concat(F.lit("ctx://resources/parts/"), "p_name", F.lit(".md")))
    base = T.basename(F.col("uri"))
    fields = {"uri": F.col("uri"), "name": base, "base": base, "stem": T.stem_of(base), "abstract": F.col("p_name"), "heading": F.array().cast("array<string>"), "line": F.array().cast("array<string>")}
    return p.where(F.lower("p_name") == _PART_Q.lower()).select("p_partkey", R.exact_ladder(_PART_Q, fields).alias("exact"))


@query("SELECT DISTINCT a.p_brand AS a, b.p_brand AS b FROM part a JOIN (SELECT DISTINCT p_brand FROM part) b ON damerau_levenshtein(lower(a.p_brand), lower(b.p_brand)) <= 1")
def q_edit_distance_one(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Brands within one edit or swap: they meet by what is left without one character, and are then compared."""
    brands = table(spark, sf_dir, "part").select(F.col("p_brand").alias("a"))
    return R.near_pairs(brands, brands.select(F.col("a").alias("b")), "a", "b")


@query(r"""WITH k AS (SELECT DISTINCT p_type, lower(regexp_replace(p_type, '[^\p{L}\p{N}]', '', 'g')) AS c FROM part), q AS (SELECT min(c) AS qc FROM k),
g AS (SELECT p_type, c, unnest(list_transform(range(1, len(c)), lambda i: c[i:i+1])) AS gram FROM k), gc AS (SELECT p_type, gram, count(*) AS n FROM g GROUP BY ALL),
qg AS (SELECT unnest(list_transform(range(1, len(qc)), lambda i: qc[i:i+1])) AS gram FROM q), qgc AS (SELECT gram, count(*) AS n FROM qg GROUP BY gram)
SELECT k.p_type, round(2.0 * sum(least(gc.n, coalesce(qgc.n, 0))) / (len(k.c) - 1 + (SELECT len(qc) - 1 FROM q)), 6)::DOUBLE AS dice FROM k JOIN gc ON gc.p_type = k.p_type LEFT JOIN qgc ON gc.gram = qgc.gram GROUP BY k.p_type, k.c""")
def q_dice_fuzzy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bigram similarity of every part type with the first one."""
    k = table(spark, sf_dir, "part").select("p_type").distinct().withColumn("c", T.compact_key(F.col("p_type")))
    first = k.agg(F.min("c").alias("qc"))
    both = k.crossJoin(F.broadcast(first))  # one row
    return both.select("p_type", F.round(T.dice(T.bigrams(F.col("c")), T.bigrams(F.col("qc"))), 6).alias("dice"))


_HYBRID_SQL = f"""WITH {DOCS_SQL}, {WORDS_SQL}, {BM25_SQL % _in(TERMS)}, sizes AS (SELECT uri, count(*) AS k FROM post GROUP BY uri),
s AS (SELECT d.uri, CASE WHEN lower(abstract_text) = 'license' THEN 0.99 ELSE 0.0 END::DOUBLE AS e, b.bm25, b.matched, k,
 CASE WHEN contains(lower(content), 'license') THEN 1.0 ELSE 0.0 END::DOUBLE AS lit,
 1 / (1 + greatest(floor((epoch(TIMESTAMP '2026-01-01') - epoch(updated_at)) / 86400), 0) / 30) AS rec, CASE WHEN starts_with(d.uri, 'ctx://resources/src1/') THEN 0.8 ELSE 0.0 END::DOUBLE AS path FROM docs d JOIN bm b USING (uri) JOIN sizes USING (uri)),
h AS (SELECT uri, round(CASE WHEN e >= 0.9 THEN 0.35 WHEN e >= 0.82 THEN 0.22 WHEN e >= 0.7 THEN 0.1 ELSE 0 END + 0.42 * e + 0.2 * e * e * e
 + 0.2 * least(1, greatest(0, 0.65 * bm25 / (bm25 + 2) + 0.25 * matched / ({len(TERMS)} + k - matched) + 0.1 * lit)) + 0.03 * rec + 0.02 * path, 4) AS score, path FROM s)"""


def hybrid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(uri, score, path) with all parts of the blend, for documents with a query term."""
    hits = _index(spark, sf_dir, False).bm25(spark, TERMS)
    license_ = F.contains(F.lower("content"), F.lit("license")).cast("double").alias("literal")
    found = _docs(spark, sf_dir).select("uri", (F.lower("abstract_text") == "license").alias("same"), license_, "updated_at").join(hits, "uri")  # texts stay where they are read
    inter, size = F.col("matched"), F.col("terms")
    sparse = S.lexical(F.col("bm25"), inter / (len(TERMS) + size - inter), F.col("literal"))
    recent = S.recency(F.col("updated_at").cast("timestamp"), F.lit("2026-01-01 00:00:00").cast("timestamp_ntz").cast("timestamp"))
    path = F.when(F.startswith("uri", F.lit("ctx://resources/src1/")), 0.8).otherwise(0.0)
    return found.select("uri", F.round(S.blended(F.when(F.col("same"), 0.99).otherwise(0.0), F.lit(0.0), sparse, recent, path), 4).alias("score"), path.alias("path"))


@query(f"{_HYBRID_SQL} SELECT uri, score FROM h ORDER BY score DESC, uri LIMIT 20")
def q_hybrid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.top(hybrid(spark, sf_dir).select("uri", "score"), 20)


@query(f"{_HYBRID_SQL} SELECT uri, score FROM (SELECT * FROM h ORDER BY score DESC, uri LIMIT 128) WHERE path > 0 ORDER BY score DESC, uri LIMIT 10")
def q_limit_then_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A global top 128 comes first, the filter on it second."""
    return R.top(R.top(hybrid(spark, sf_dir), 128).where("path > 0").select("uri", "score"), 10)


@query(f"""WITH {DOCS_SQL}, f AS (SELECT uri, string_split(uri, '/') AS p FROM docs WHERE lang = 'es' AND source IN ('src1', 'src2'))
SELECT uri FROM f UNION SELECT array_to_string(p[1:i], '/') AS uri FROM f, unnest(range(3, 6)) AS t(i)""")
def q_filter_projection_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves with the wanted tags, and all directories above them."""
    docs = _docs(spark, sf_dir)
    ok = R.matches_filter(F.col("tags"), D.mime(F.col("name"), F.col("is_leaf")), ["ES"], "text/plain") & (F.array_contains("tags", "src1") | F.array_contains("tags", "src2"))
    return R.filter_projection(docs, ok)


@query(f"{_HYBRID_SQL} SELECT uri, round(max(w), 4) AS score FROM (SELECT uri, score * 1.0 AS w FROM h UNION ALL SELECT uri, score * 0.82 FROM h WHERE path > 0 UNION ALL SELECT uri, 2 * score * 0.64 FROM h WHERE path > 0) GROUP BY uri ORDER BY score DESC, uri LIMIT 20")
def q_fanout_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three planned queries merged by weighted maximum."""
    h = hybrid(spark, sf_dir)
    second = h.where("path > 0")
    third = second.withColumn("score", 2 * F.col("score"))
    merged = R.merge_fanout([(h, 1), (second, 2), (third, 3)])
    return R.top(merged.select("uri", F.round("score", 4).alias("score")), 20)


_TREE_SQL = f"""n AS (SELECT 'ctx://resources/' || source AS uri, 'ctx://resources' AS parent_uri, false AS is_leaf FROM documents GROUP BY source
UNION ALL SELECT DISTINCT 'ctx://resources/' || source || '/' || lang, 'ctx://resources/' || source, false FROM documents UNION ALL SELECT uri, parent_uri, true FROM docs)"""


@query(f"{_HYBRID_SQL}, {_TREE_SQL}" + """, a AS (SELECT n.uri, coalesce(h.score, 0) AS l, n.parent_uri, n.is_leaf FROM n LEFT JOIN h USING (uri)),
l1 AS (SELECT uri, 0.5 * l AS s FROM a WHERE parent_uri = 'ctx://resources'), l2 AS (SELECT a.uri, 0.5 * a.l + 0.5 * l1.s AS s FROM a JOIN l1 ON a.parent_uri = l1.uri),
l3 AS (SELECT a.uri, round(0.5 * a.l + 0.5 * l2.s, 5) AS score FROM a JOIN l2 ON a.parent_uri = l2.uri WHERE is_leaf) SELECT uri, score FROM l3 WHERE score > 0""")
def q_level_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Level-wise descent through the tree with blended scores."""
    docs = _docs(spark, sf_dir)
    dirs = D.directories(docs).where("depth > 0").select("uri", "parent_uri", F.lit(False).alias("is_leaf"))
    tree = dirs.unionByName(docs.select("uri", "parent_uri", "is_leaf"))
    found = R.expand_levels(tree, hybrid(spark, sf_dir).select("uri", "score"), "ctx://resources", 3)
    return found.select("uri", F.round("score", 5).alias("score")).where("score > 0")


@query(f"{_HYBRID_SQL} SELECT uri, round(score * (1 + least(0.65, CASE WHEN contains(uri, '/en/') THEN 0.12 ELSE 0.08 END + CASE WHEN contains(uri, 'src1') THEN 0.08 ELSE 0 END)), 5) AS score FROM h ORDER BY score DESC, uri LIMIT 10")
def q_rerank_doc_aware(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boosts by document class and by overlap of the uri with the query."""
    boost = F.when(F.contains("uri", F.lit("/en/")), 0.12).otherwise(0.08) + F.when(F.contains("uri", F.lit("src1")), 0.08).otherwise(0.0)
    best = hybrid(spark, sf_dir).select("uri", "score").withColumn("score", F.round(F.col("score") * (1 + F.least(F.lit(0.65), boost)), 5))
    return R.top(best, 10)


@query("""WITH pairs AS (SELECT DISTINCT l_orderkey AS o, 'ctx://resources/parts/' || l_partkey AS p FROM lineitem), m AS (SELECT DISTINCT a.p AS uri, b.p AS related, o_orderpriority AS reason FROM pairs a JOIN pairs b ON a.o = b.o AND a.p <> b.p JOIN orders ON a.o = o_orderkey)
SELECT uri, related, reason, place FROM (SELECT *, row_number() OVER (PARTITION BY uri ORDER BY related, reason) AS place FROM m) WHERE place <= 5""")
def q_relations_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Up to five related parts of each part: an order is a relation of its parts, owned by their directory."""
    li, o, p = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), table(spark, sf_dir, "part")
    uri = lambda c: F.concat(F.lit("ctx://resources/parts/"), c.cast("string"))
    members = li.groupBy("l_orderkey").agg(F.collect_set("l_partkey").alias("keys"))  # an order has a few lines
    relations = members.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.lit("ctx://resources/parts").alias("owner_uri"), F.col("l_orderkey").cast("string").alias("id"), F.col("o_orderpriority").alias("reason"), F.transform("keys", uri).alias("uris"))
    return R.relations_of(p.select(uri(F.col("p_partkey")).alias("uri")), relations, 5).select("uri", "related", "reason", F.col("place").cast("long").alias("place"))


@query(f"""WITH {DOCS_SQL}, r(prefix, kind) AS (VALUES ('ctx://resources', 'resource'), ('ctx://resources/src1', 'source_one'), ('ctx://resources/src1/en', 'english'), ('ctx://resources/src2', 'source_two'))
SELECT uri, kind AS object_type FROM (SELECT uri, kind, row_number() OVER (PARTITION BY uri ORDER BY length(prefix) DESC) AS rn FROM docs JOIN r ON uri = prefix OR starts_with(uri, prefix || '/')) WHERE rn = 1""")
def q_longest_prefix_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.longest_prefix(_docs(spark, sf_dir), [("ctx://resources", "resource"), ("ctx://resources/src1", "source_one"), ("ctx://resources/src1/en", "english"), ("ctx://resources/src2", "source_two")])
