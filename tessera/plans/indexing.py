"""Files, directories, hits, the namespace and keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.operators import indexing as I
from tessera.operators import ledger as L
from tessera.operators import namespace as N
from tessera.operators import ranking as K
from tessera.operators import retrieval as R

from .memory import MSG_SQL, _msgs
from .registry import query, table
from .retrieval import _PLAIN, _SYMBOLIC, _TOKENS, BM25_SQL, DOCS_SQL, TERMS, WORDS_SQL, _docs, _in, _index

ENDS = [".md", ".txt", ".py", ".yaml", ".log", ".toml", ".rs", ""]
PLACES = ["resources/src", "user/memories", "agent/skills", "session/s"]
_list = lambda xs: "[" + ", ".join(f"'{x}'" for x in xs) + "]"
FILES_SQL = f"""files AS (SELECT 'ctx://' || {_list(PLACES)}[doc_id % 4 + 1] || '/' || doc_id || {_list(ENDS)}[doc_id // 4 % 8 + 1] AS uri, doc_id || {_list(ENDS)}[doc_id // 4 % 8 + 1] AS name, text AS content FROM documents
UNION ALL SELECT 'ctx://resources/events/e' || event_id || CASE WHEN event_id % 2 = 0 THEN '.json' ELSE '.jsonl' END, 'e' || event_id || CASE WHEN event_id % 2 = 0 THEN '.json' ELSE '.jsonl' END, CASE WHEN event_id % 5 = 0 THEN '{{"name": "' || event_type || '", "id": 7}}' WHEN event_id % 5 = 1 THEN 'no json' ELSE props END FROM events),
parsed AS (SELECT *, CASE WHEN ends_with(name, '.md') THEN 'markdown' WHEN ends_with(name, '.json') AND content <> 'no json' THEN 'json' WHEN ends_with(name, '.jsonl') AND content <> 'no json' THEN 'jsonl' WHEN ends_with(name, '.yaml') THEN 'yaml' WHEN ends_with(name, '.toml') THEN 'toml' ELSE 'text' END AS parser,
 CASE WHEN starts_with(uri, 'ctx://agent/skills') THEN 'skill' WHEN starts_with(uri, 'ctx://user/memories') THEN 'memory' WHEN starts_with(uri, 'ctx://session') THEN 'session' ELSE 'resource' END AS context FROM files)"""
_CLASS_SQL = "CASE WHEN context <> 'resource' THEN context WHEN parser IN ('json', 'yaml', 'toml') THEN 'config' WHEN parser = 'jsonl' THEN 'data' WHEN parser = 'markdown' THEN 'narrative' WHEN ends_with(name, '.py') OR ends_with(name, '.rs') THEN 'code' ELSE 'general' END"


def _files(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, e = table(spark, sf_dir, "documents"), table(spark, sf_dir, "events")
    pick = lambda xs, i: F.get(F.array(*[F.lit(x) for x in xs]), i.cast("int"))
    name = F.concat(F.col("doc_id").cast("string"), pick(ENDS, F.floor(F.col("doc_id") / 4) % 8))
    a = d.select(F.concat(F.lit("ctx://"), pick(PLACES, F.col("doc_id") % 4), F.lit("/"), name).alias("uri"), name.alias("name"), F.col("text").alias("content"))
    own = F.concat(F.lit("e"), F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".json").otherwise(".jsonl"))
    body = F.when(F.col("event_id") % 5 == 0, F.concat(F.lit('{"name": "'), "event_type", F.lit('", "id": 7}'))).when(F.col("event_id") % 5 == 1, "no json").otherwise(F.col("props"))
    b = e.select(F.concat(F.lit("ctx://resources/events/"), own).alias("uri"), own.alias("name"), body.alias("content"))
    return a.unionByName(b).withColumn("updated_at", F.lit("2024-01-01").cast("timestamp_ntz"))


@query(f"WITH {FILES_SQL} SELECT parser, {_CLASS_SQL} AS doc_class, context, count(*) AS n FROM parsed GROUP BY ALL")
def q_doc_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files by parser, class and context."""
    f = _files(spark, sf_dir)
    parser, context = I.parser_of(F.col("name"), F.col("content")), D.context_type(F.col("uri"))
    own = f.select(parser.alias("parser"), context.alias("context"), "name")
    return own.groupBy("parser", I.doc_class(F.col("context"), F.col("name"), F.col("parser")).alias("doc_class"), "context").agg(F.count("*").alias("n"))


@query(rf"""WITH {FILES_SQL}, l AS (SELECT *, list_filter(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS rows FROM parsed)
SELECT uri, CASE WHEN parser = 'json' THEN CASE WHEN json_extract_string(content, '$.name') IS NOT NULL THEN json_extract_string(content, '$.name') END
 WHEN parser = 'markdown' THEN coalesce(trim(substr(list_filter(rows, lambda x: starts_with(x, '# '))[1], 3), ' '), list_filter(rows, lambda x: NOT regexp_matches(x, '^(-{{3,}}|\*{{3,}}|_{{3,}})$'))[1]) ELSE rows[1] END AS title FROM l""")
def q_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The title of every file: a heading, a JSON key, or its first line."""
    f = _files(spark, sf_dir)
    return f.select("uri", I.title_of(I.parser_of(F.col("name"), F.col("content")), F.col("content")).alias("title"))


_TAGS_SQL = f"""list_sort(list_distinct(list_filter([CASE WHEN ends_with(name, '.rs') THEN 'rust' END, CASE WHEN ends_with(name, '.md') THEN 'markdown' END, CASE WHEN ends_with(name, '.json') THEN 'json' END,
 CASE WHEN contains(lower(content), 'auth') THEN 'auth' END, CASE WHEN contains(lower(content), 'oauth') THEN 'oauth' END, CASE WHEN contains(lower(content), 'session') THEN 'session' END, CASE WHEN contains(lower(content), 'memory') THEN 'memory' END, CASE WHEN contains(lower(content), 'skill') THEN 'skill' END, CASE WHEN contains(lower(content), 'api') THEN 'api' END,
 parser, CASE WHEN parser IN ('json', 'yaml', 'toml') THEN 'config' WHEN parser = 'jsonl' THEN 'data' END, 'parser:' || parser, 'doc_class:' || {_CLASS_SQL},
 'mime:' || CASE string_split(name, '.')[-1] WHEN 'md' THEN 'text/markdown' WHEN 'txt' THEN 'text/plain' WHEN 'log' THEN 'text/plain' WHEN 'py' THEN 'text/x-python' WHEN 'yaml' THEN 'application/yaml' WHEN 'toml' THEN 'application/toml' WHEN 'rs' THEN 'text/rust' WHEN 'json' THEN 'application/json' WHEN 'jsonl' THEN 'application/x-ndjson' END], lambda x: x IS NOT NULL)))"""


@query(f"WITH {FILES_SQL} SELECT uri, context AS context_type, {_TAGS_SQL} AS tags, sha256(content) AS hash, CAST(len(string_split(uri, '/')) - 3 AS INTEGER) AS depth FROM parsed")
def q_index_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Document rows of all files, with their tags and content hash."""
    return I.index_entries(_files(spark, sf_dir)).select("uri", "context_type", "tags", "hash", "depth")


@query(f"WITH {FILES_SQL}, led AS (SELECT uri, sha256(CASE WHEN length(name) % 3 = 0 THEN content || 'x' ELSE content END) AS hash FROM files WHERE length(content) % 4 <> 0) SELECT f.uri FROM files f LEFT JOIN led USING (uri) WHERE led.hash IS NULL OR led.hash <> sha256(f.content)")
def q_changed_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose entry has to be written, by a ledger of hashes."""
    f = _files(spark, sf_dir)
    old = f.where("length(content) % 4 <> 0").select("uri", F.sha2(F.when(F.length("name") % 3 == 0, F.concat("content", F.lit("x"))).otherwise(F.col("content")), 256).alias("hash"), "updated_at")
    return I.changed_entries(I.index_entries(f), old).select("uri")


_LONG_ENDS = [".log", ".yaml", ".py", ".md"]
LONG_SQL = f"""long AS (SELECT o_custkey AS id, o_custkey || {_list(_LONG_ENDS)}[o_custkey % 4 + 1] AS name, string_agg(CASE WHEN o_orderkey % 7 = 0 THEN '```' WHEN o_orderkey % 3 = 0 THEN 'def order_' || o_orderkey || '(a):' WHEN o_orderkey % 3 = 1 THEN 'order_' || o_orderkey || ': ' || o_orderstatus ELSE '# Failed  ' || o_orderkey % 50 END, chr(10) ORDER BY o_orderkey) AS content FROM orders GROUP BY o_custkey)"""


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    line = F.when(k % 7 == 0, "```").when(k % 3 == 0, F.concat(F.lit("def order_"), k.cast("string"), F.lit("(a):"))).when(k % 3 == 1, F.concat(F.lit("order_"), k.cast("string"), F.lit(": "), "o_orderstatus")).otherwise(F.concat(F.lit("# Failed  "), (k % 50).cast("string")))
    own = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(k.alias("k"), line.alias("l")))), lambda x: x["l"]), "\n").alias("content"))
    name = F.concat(F.col("o_custkey").cast("string"), F.get(F.array(*[F.lit(x) for x in _LONG_ENDS]), (F.col("o_custkey") % 4).cast("int")))
    return own.select(F.col("o_custkey").alias("id"), name.alias("name"), "content")


_SECTION = "CASE WHEN len({l}) > 0 THEN chr(10) || chr(10) || '[{t}]' || chr(10) || array_to_string(list_transform(list_filter({l}, lambda x, i: list_position(list_transform({l}, lambda y: lower(y)), lower(x)) = i), lambda x: '- ' || x || chr(10)), '') ELSE '' END"
_CLEAN = r"list_filter(list_transform(string_split({c}, chr(10)), lambda x: substr(trim(regexp_replace(x, '\s+', ' ', 'g')), 1, 220)), lambda x: x <> '')"
_HEADS_SQL = r"""heads AS (SELECT id, n, h FROM (SELECT id, n, trim(regexp_replace(x, '^#+', ''), ' ') AS h, row_number() OVER (PARTITION BY id, lower(trim(regexp_replace(x, '^#+', ''), ' ')) ORDER BY n) AS again
 FROM (SELECT id, n, x, sum(CASE WHEN starts_with(x, '```') THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY n ROWS UNBOUNDED PRECEDING) AS fences FROM (SELECT id, unnest(string_split(content, chr(10))) AS x, generate_subscripts(string_split(content, chr(10)), 1) AS n FROM long)) WHERE fences % 2 = 0 AND starts_with(x, '#')) WHERE again = 1),
tails AS (SELECT id, list(h ORDER BY n) AS hs FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC) AS back FROM heads) WHERE back <= 64 GROUP BY id)"""


@query(f"WITH {LONG_SQL}, {_HEADS_SQL} SELECT long.id, coalesce(hs, []) AS headings FROM long LEFT JOIN tails USING (id)")
def q_tail_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last distinct headings of long files, outside fences."""
    return _long(spark, sf_dir).select("id", I.tail_headings(F.col("content")).alias("headings"))


@query(f"""WITH {LONG_SQL}, {_HEADS_SQL}, w AS (SELECT *, {_CLEAN.format(c="substr(content, CAST(greatest(length(content) // 2 - 60, 0) AS BIGINT) + 1, 120)")}[1:18] AS mid, {_CLEAN.format(c="substr(content, greatest(length(content) - 120, 0) + 1, 120)")} AS every, string_split(name, '.')[2] AS ending FROM long),
v AS (SELECT *, every[greatest(len(every) - 17, 1):] AS tail FROM w), s AS (SELECT v.*, list_filter(tail, lambda x: starts_with(x, 'def ') OR (contains(x, '(') AND contains(x, ')') AND ends_with(x, ':')))[1:12] AS sigs, list_filter(tail, lambda x: (contains(x, ':') OR contains(x, '=')) AND regexp_matches(lower(x), '[a-z]'))[1:16] AS keys, list_filter(tail, lambda x: contains(lower(x), 'failed'))[1:16] AS logs, coalesce(hs, []) AS hs FROM v LEFT JOIN tails USING (id))
SELECT id, CASE WHEN length(content) <= 200 THEN content ELSE substr(content, 1, 200) || chr(10) || chr(10) || '[indexing truncated at 200 bytes]' || {_SECTION.format(l="mid", t="index middle window sample")} || {_SECTION.format(l="tail", t="index tail window sample")}
 || CASE WHEN ending = 'py' THEN {_SECTION.format(l="sigs", t="index code tail signatures")} ELSE '' END || CASE WHEN ending = 'yaml' THEN {_SECTION.format(l="keys", t="index config tail keys")} ELSE '' END || CASE WHEN ending = 'log' THEN {_SECTION.format(l="logs", t="index log tail signals")} ELSE '' END || CASE WHEN ending = 'md' THEN {_SECTION.format(l="hs", t="index markdown tail headings")} ELSE '' END END AS text FROM s""")
def q_truncated_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is indexed of long files: the first bytes, samples of middle and tail, and telling lines."""
    f = _long(spark, sf_dir)
    return f.select("id", I.index_text(F.col("content"), F.col("name"), I.parser_of(F.col("name"), F.col("content")), 200, 120).alias("text"))


def _tokens(column: str) -> str:
    t = _TOKENS.format(c=column)
    return f"list_concat({_PLAIN.format(t=t)}, {_SYMBOLIC.format(t=t)})"


_STOP = ", ".join(f"'{w}'" for w in I.STOP_WORDS)


@query(f"""WITH {DOCS_SQL}, e AS (SELECT parent_uri, name, false AS is_dir, content FROM docs UNION ALL SELECT DISTINCT 'ctx://resources/' || source, lang, true, NULL FROM docs), n AS (SELECT *, row_number() OVER (PARTITION BY parent_uri ORDER BY name) AS place FROM e),
t AS (SELECT parent_uri, unnest({_tokens("name")}) AS t, 2 AS w FROM n WHERE place <= 64 UNION ALL SELECT parent_uri, unnest({_tokens("array_to_string(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10))[1:8], ' ')")}), 1 FROM n WHERE place <= 64 AND NOT is_dir),
c AS (SELECT parent_uri, t, sum(w) AS n FROM t WHERE strlen(t) >= 3 AND NOT regexp_matches(t, '^[0-9]+$') AND t NOT IN ({_STOP}) GROUP BY ALL), b AS (SELECT parent_uri, string_agg(t, ', ' ORDER BY n DESC, t) AS topics FROM (SELECT *, row_number() OVER (PARTITION BY parent_uri ORDER BY n DESC, t) AS rk FROM c) WHERE rk <= 6 GROUP BY parent_uri),
d AS (SELECT parent_uri, count(*) AS n, count(*) FILTER (is_dir) AS dirs, string_agg('- ' || name || chr(10), '' ORDER BY name) FILTER (place <= 50) AS names FROM n GROUP BY parent_uri)
SELECT parent_uri AS uri, CASE WHEN topics IS NULL THEN parent_uri || ' contains ' || n || ' items' ELSE parent_uri || ' semantic summary: ' || n || ' items (' || dirs || ' directories, ' || (n - dirs) || ' files); topics: ' || topics END AS abstract_text,
 '# ' || parent_uri || chr(10) || chr(10) || CASE WHEN topics IS NULL THEN '' ELSE 'Summary:' || chr(10) || '- topics: ' || topics || chr(10) || '- directories: ' || dirs || chr(10) || '- files: ' || (n - dirs) || chr(10) || chr(10) END || 'Contains:' || chr(10) || names AS overview FROM d LEFT JOIN b USING (parent_uri)""")
def q_directory_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summaries of all directories from their entries' names and first lines."""
    docs = _docs(spark, sf_dir)
    leaves = docs.select("parent_uri", "name", F.lit(False).alias("is_dir"), "content")
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("ctx://resources/"), "source").alias("parent_uri"), F.col("lang").alias("name"), F.lit(True).alias("is_dir"), F.lit(None).cast("string").alias("content")).distinct()
    return I.directory_tiers(leaves.unionByName(d))


@query(f"""WITH {DOCS_SQL}, {WORDS_SQL}, {BM25_SQL % _in(TERMS)}, s AS (SELECT uri, round(bm25, 4) AS score FROM bm ORDER BY score DESC, uri LIMIT 30),
l AS (SELECT s.*, abstract_text, list_filter(list_transform(string_split(replace(content, chr(13) || chr(10), chr(10)), chr(10)), lambda x: trim(x, ' ')), lambda x: x <> '') AS rows FROM s JOIN docs USING (uri)), h AS (SELECT *, list_filter(list_transform(list_filter(rows, lambda x: starts_with(x, '#')), lambda x: trim(regexp_replace(x, '^#+', ''), ' ')), lambda x: x <> '') AS hs FROM l)
SELECT uri, score, abstract_text, 'resource' AS context_type, 'resources' AS bucket, coalesce(substr(list_filter(rows, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'version'))[1], 1, 240), nullif(substr(trim(abstract_text, ' '), 1, 240), '')) AS snippet, substr(coalesce(list_filter(hs, lambda x: contains(lower(x), 'license') OR contains(lower(x), 'version'))[1], hs[1]), 1, 240) AS matched_heading FROM h""")
def q_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits with snippet, matched heading and bucket."""
    best = R.top(_index(spark, sf_dir, False).bm25(spark, TERMS).select("uri", F.round("bm25", 4).alias("score")), 30)
    return I.hits(best, _docs(spark, sf_dir), "License version")


@query("""WITH p AS (SELECT p_partkey, [p_brand || '/' || p_name || '.md', '.hidden/' || p_name || '.md', p_type || '/.abstract.md', 'node/' || p_name || '.txt', 'skip/x/' || p_name || '.markdown'][p_partkey % 5 + 1] AS path FROM part)
SELECT p_partkey, string_split(path, '/')[-1] <> '.abstract.md' AS indexable, NOT regexp_matches(path, '(^|/)\\.') AND NOT starts_with(path, 'skip/') AS ingested, NOT regexp_matches(path, '(^|/)\\.') AND NOT starts_with(path, 'skip/') AND ends_with(path, '.md') AS markdown, NOT starts_with(path, 'skip/') AS hidden_too FROM p""")
def q_ingest_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths are taken in: system files, hidden parts, excluded globs, Markdown only."""
    n = F.col("p_name")
    paths = F.array(F.concat("p_brand", F.lit("/"), n, F.lit(".md")), F.concat(F.lit(".hidden/"), n, F.lit(".md")), F.concat("p_type", F.lit("/.abstract.md")), F.concat(F.lit("node/"), n, F.lit(".txt")), F.concat(F.lit("skip/x/"), n, F.lit(".markdown")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(paths, (F.col("p_partkey") % 5).cast("int")).alias("path"))
    path, out = F.col("path"), ("skip/**",)
    return p.select("p_partkey", I.indexable(F.element_at(F.split("path", "/"), -1)).alias("indexable"), I.ingestible(path, exclude=out).alias("ingested"), I.ingestible(path, True, exclude=out).alias("markdown"), I.ingestible(path, include_hidden=True, exclude=out).alias("hidden_too"))


@query(f"WITH {DOCS_SQL}, t AS (SELECT doc_id, 'toxic' AS tag FROM labels WHERE toxic = 1 UNION ALL SELECT doc_id, 'good' FROM labels WHERE quality = 1), g AS (SELECT doc_id, string_agg(DISTINCT tag, ' ' ORDER BY tag) AS own FROM t GROUP BY doc_id) SELECT uri, coalesce(own, lang) AS tags_text FROM docs LEFT JOIN g USING (doc_id)")
def q_tag_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their joined tags; those without keep their text."""
    docs, l = _docs(spark, sf_dir), table(spark, sf_dir, "labels")
    tags = l.where("toxic = 1").select("doc_id", F.lit("toxic").alias("tag")).unionByName(l.where("quality = 1").select("doc_id", F.lit("good").alias("tag")))
    named = tags.join(docs.select("doc_id", "uri"), "doc_id").select("uri", "tag")
    return I.with_tags(docs.withColumn("tags_text", F.get("tags", F.lit(0))), named).select("uri", "tags_text")


@query("SELECT 'ctx://resources' AS uri, 1 AS place")
def q_scope_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots of the scopes asked for that are there, in order."""
    return N.scope_roots(D.directories(_docs(spark, sf_dir)), ["agent", "resources", "user"])


@query(f"WITH {DOCS_SQL}, m AS (SELECT CASE WHEN starts_with(uri, 'ctx://resources/src1/') THEN replace(uri, 'ctx://resources/src1/', 'ctx://resources/old/src1/') ELSE uri END AS uri FROM docs) SELECT uri, regexp_replace(uri, '/[^/]+$', '') AS parent_uri, CAST(len(string_split(uri, '/')) - 3 AS INTEGER) AS depth FROM m")
def q_move_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A subtree under another name."""
    return N.move(_docs(spark, sf_dir), "ctx://resources/src1", "ctx://resources/old/src1").select("uri", "parent_uri", "depth")


_REL_SQL = """rel AS (SELECT 'ctx://resources/c' || o_custkey AS owner_uri, CASE WHEN l_orderkey % 50 = 0 THEN ' ' WHEN l_orderkey % 50 = 1 THEN 'same' ELSE 'o' || l_orderkey END AS id, list(CASE WHEN l_partkey % 97 = 0 THEN 'nowhere' ELSE 'ctx://resources/p' || l_partkey END ORDER BY l_partkey) AS uris, CASE WHEN o_orderstatus = 'P' THEN '' ELSE o_orderpriority END AS reason FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY l_orderkey, o_custkey, o_orderstatus, o_orderpriority)"""


def _relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    k = F.col("l_orderkey")
    uri = F.when(F.col("l_partkey") % 97 == 0, "nowhere").otherwise(F.concat(F.lit("ctx://resources/p"), F.col("l_partkey").cast("string")))
    own = both.groupBy("l_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority").agg(F.transform(F.array_sort(F.collect_list(F.struct("l_partkey", uri.alias("u")))), lambda x: x["u"]).alias("uris"))
    id_ = F.when(k % 50 == 0, " ").when(k % 50 == 1, "same").otherwise(F.concat(F.lit("o"), k.cast("string")))
    return own.select(F.concat(F.lit("ctx://resources/c"), F.col("o_custkey").cast("string")).alias("owner_uri"), id_.alias("id"), "uris", F.when(F.col("o_orderstatus") == "P", "").otherwise(F.col("o_orderpriority")).alias("reason"))


@query(f"""WITH {_REL_SQL}, t AS (SELECT owner_uri, trim(id, ' ') AS key, count(*) AS times FROM rel GROUP BY ALL) SELECT rel.owner_uri, id, list_filter([CASE WHEN key = '' THEN 'empty_id' END, CASE WHEN times > 1 THEN 'duplicate_id' END, CASE WHEN reason = '' THEN 'empty_reason' END, CASE WHEN len(uris) < 2 THEN 'too_few' END, CASE WHEN list_contains(uris, 'nowhere') THEN 'invalid_uri' END, CASE WHEN len(list_distinct(uris)) < len(uris) THEN 'duplicate_uri' END], lambda x: x IS NOT NULL) AS faults
FROM rel JOIN t ON t.owner_uri = rel.owner_uri AND t.key = trim(id, ' ') WHERE len(faults) > 0""")
def q_relation_faults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations that may not be written, with what is wrong."""
    return N.relation_faults(_relations(spark, sf_dir))


@query(f"""WITH {_REL_SQL} SELECT owner_uri, CAST(to_json(list({{'id': id, 'uris': uris, 'reason': reason}} ORDER BY id, uris, reason)) AS VARCHAR) AS document FROM (SELECT owner_uri, id, uris, reason FROM rel WHERE reason <> '5-LOW' UNION ALL SELECT owner_uri, id, uris, 'again' FROM rel WHERE reason = '5-LOW') GROUP BY owner_uri""")
def q_relation_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Relations with some replaced, as each owner's document."""
    r = _relations(spark, sf_dir).where("trim(id) <> '' and id <> 'same'")
    rest = _relations(spark, sf_dir).where("trim(id) = '' or id = 'same'")
    new = r.where("reason = '5-LOW'").withColumn("reason", F.lit("again"))
    low = rest.withColumn("reason", F.when(F.col("reason") == "5-LOW", "again").otherwise(F.col("reason")))
    return N.relation_documents(N.link(r, new).unionByName(low))


@query(f"WITH {MSG_SQL}, r AS (SELECT 'session:' || session_id AS k, string_agg('[' || role || '] ' || turn, chr(10) ORDER BY turn, id) AS o FROM msgs GROUP BY session_id) SELECT 'ctx://agent/om/' || k AS uri, 'OM: ' || k AS name, string_split(o, chr(10))[1] AS abstract_text, o AS content, ['om', 'session'] AS tags, CAST(2 AS INTEGER) AS depth FROM r")
def q_memory_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memory records of all sessions as leaf documents."""
    line = F.concat(F.lit("["), "role", F.lit("] "), F.col("turn").cast("string"))
    r = _msgs(spark, sf_dir).groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "id", line.alias("l")))), lambda x: x["l"]), "\n").alias("active_observations"), F.max("created_at").alias("updated_at"))
    records = r.select(F.concat(F.lit("session:"), F.col("session_id").cast("string")).alias("scope_key"), F.lit("session").alias("scope"), "active_observations", "updated_at")
    return N.memory_records(records).select("uri", "name", "abstract_text", "content", "tags", "depth")


@query("SELECT 'w' || user_id % 5 AS worker_name, max(event_id) AS last_event_id, max(ts) AS updated_at FROM events WHERE event_id % 3 <> 0 OR user_id % 5 = 2 GROUP BY 1 ORDER BY 1")
def q_checkpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of all workers, one advanced by a pass."""
    e = table(spark, sf_dir, "events")
    base = e.where("event_id % 3 <> 0").groupBy(F.concat(F.lit("w"), (F.col("user_id") % 5).cast("string")).alias("worker_name")).agg(F.max("event_id").alias("last_event_id"), F.max("ts").alias("updated_at"))
    done = e.where("user_id % 5 = 2").select(F.col("event_id").alias("id"), F.col("ts").alias("created_at"))
    return L.checkpoints(L.advance(base, "w2", done))


@query(f"WITH {MSG_SQL} SELECT scope_key, thread_id, place FROM (SELECT session_id % 7 AS scope_key, session_id AS thread_id, row_number() OVER (PARTITION BY session_id % 7 ORDER BY max(created_at) DESC, count(*) DESC, session_id) AS place FROM msgs GROUP BY session_id) WHERE place <= 4")
def q_thread_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The newest continuations of each scope."""
    t = _msgs(spark, sf_dir).groupBy((F.col("session_id") % 7).alias("scope_key"), F.col("session_id").alias("thread_id")).agg(F.max("created_at").alias("updated_at"), F.count("*").alias("confidence"))
    return L.newest_by_scope(t, 4).select("scope_key", "thread_id", F.col("place").cast("long").alias("place"))


_CHUNKS = f"""{MSG_SQL}, c AS (SELECT session_id AS record_id, id, turn, row_number() OVER (PARTITION BY session_id ORDER BY created_at, id) + 10 AS seq FROM msgs WHERE turn % 2 = 1)"""


def _chunk_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    m = _msgs(spark, sf_dir)
    old = m.select(F.col("session_id").alias("record_id")).distinct().select("record_id", F.lit(None).cast("string").alias("id"), F.lit("old").alias("observations"), F.array().cast("array<string>").alias("message_ids"), F.lit("2024-01-01").cast("timestamp_ntz").alias("created_at"), F.lit(10).alias("seq"))
    new = m.where("turn % 2 = 1").select(F.col("session_id").alias("record_id"), "id", F.col("text").alias("observations"), F.array("id").alias("message_ids"), "created_at")
    return old, new


@query(f"WITH {_CHUNKS} SELECT record_id, 'observation:' || record_id || ':' || seq AS entry_id, 'medium' AS priority, [id] AS message_ids FROM c")
def q_chunk_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of chunks that are appended behind each record's last."""
    return L.append_chunks(*_chunk_tables(spark, sf_dir))[1].select("record_id", "entry_id", "priority", "message_ids")


@query(f"WITH {_CHUNKS} SELECT record_id, CAST(seq AS INTEGER) AS seq FROM c WHERE seq > 10 + record_id % 3 UNION ALL SELECT DISTINCT session_id, 10 FROM msgs WHERE session_id % 4 = 1 UNION ALL SELECT record_id, CAST(seq AS INTEGER) FROM c WHERE record_id % 4 = 1 AND seq <= 10 + record_id % 3")
def q_clear_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks behind the point up to which each record is cleared; some records aren't."""
    chunks, _ = L.append_chunks(*_chunk_tables(spark, sf_dir))
    through = chunks.select("record_id").distinct().where("record_id % 4 <> 1").select("record_id", (F.lit(10) + F.col("record_id") % 3).cast("int").alias("seq"))
    return L.clear_chunks(chunks, through).select("record_id", "seq")


@query("""SELECT event_id AS trace_id, 'ctx://queue/traces/' || event_id || '.json' AS uri, CAST(to_json({'trace_id': event_id, 'request_type': event_type, 'query': props, 'target_uri': 'ctx://resources'}) AS VARCHAR) AS payload FROM events""")
def q_trace_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Traces as JSON documents."""
    t = table(spark, sf_dir, "events").select(F.col("event_id").alias("trace_id"), F.col("event_type").alias("request_type"), F.col("props").alias("query"), F.lit("ctx://resources").alias("target_uri"))
    return L.trace_documents(t.withColumn("created_at", F.lit(None).cast("timestamp_ntz")))[0].select("trace_id", "uri", "payload")


_RERANK_Q = "license version guide"


@query(f"""WITH {FILES_SQL}, k AS (SELECT uri, name, {_TAGS_SQL} AS tags, {_CLASS_SQL} AS class FROM parsed), s AS (SELECT k.*, round(1.0 / (1 + length(uri) % 7), 6) AS score FROM k)
SELECT uri, round(score * (1 + least(0.65, semantic)), 6)::DOUBLE AS score, class AS doc_class FROM (SELECT uri, class, score, CASE WHEN class IN ('narrative', 'spec') THEN 0.16 ELSE 0 END + CASE class WHEN 'narrative' THEN 0.12 WHEN 'spec' THEN 0.09 WHEN 'memory' THEN 0.09 ELSE 0 END AS semantic FROM s) ORDER BY 2 DESC, uri LIMIT 50""")
def q_rerank_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits reranked by intent, needs, document class and overlap with name and tags."""
    docs = I.index_entries(_files(spark, sf_dir))
    hits = docs.select("uri", F.round(1.0 / (1 + F.length("uri") % 7), 6).alias("score"))
    return K.rerank(hits, docs, _RERANK_Q, 50)
