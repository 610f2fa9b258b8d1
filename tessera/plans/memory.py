"""Session memories and observational-memory state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import chunks as C
from tessera.operators import memory as M
from tessera.operators import om as Z

from .registry import query, table

MSG_SQL = "msgs AS (SELECT conv_id AS session_id, conv_id || ':' || turn AS id, turn, role, text, TIMESTAMP '2024-01-01' + to_minutes(turn) AS created_at FROM conversations)"


def _msgs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.messages(table(spark, sf_dir, "conversations"))


#: What the made-up messages say, by turn: the tables hold no such sentences.
SAYINGS = ["I prefer short answers. ", "Root cause found and fixed. ", "My name is Kim. ", "", "We always deploy today. ", "The project repo moved. "]
SAID_SQL = MSG_SQL.replace(" role, text,", " role, " + f"list_value({', '.join(repr(s) for s in SAYINGS)})[turn % {len(SAYINGS)} + 1] || text AS text,")


def _said(spark: SparkSession, sf_dir: str) -> DataFrame:
    lead = F.get(F.array(*[F.lit(s) for s in SAYINGS]), (F.col("turn") % len(SAYINGS)).cast("int"))
    return _msgs(spark, sf_dir).withColumn("text", F.concat(lead, "text"))


def _category_sql() -> str:
    rows = []
    for name, words in M.CATEGORIES.items():
        test = " OR ".join("contains(lower(text), '" + w.replace("'", "''") + "')" for w in words)
        user = "role = 'user' AND " if name in M.USER_ONLY else ""
        rows.append(f"SELECT session_id, id, role, text, '{name}' AS category FROM msgs WHERE {user}({test})")
    return " UNION ALL ".join(rows)


@query(f"WITH {SAID_SQL} SELECT session_id, id, category FROM ({_category_sql()})")
def q_memory_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.extract_memories(_said(spark, sf_dir)).select("session_id", "id", "category")


@query(rf"WITH {SAID_SQL} SELECT category, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, 550 AS confidence, list_sort(list(DISTINCT id)) AS sources FROM ({_category_sql()}) GROUP BY ALL")
def q_memory_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_memories(M.extract_memories(_said(spark, sf_dir)))


@query(rf"WITH {SAID_SQL}, f AS (SELECT category, text, min(id) AS id FROM ({_category_sql()}) GROUP BY ALL), old AS (SELECT DISTINCT category, text FROM ({_category_sql()}) WHERE session_id % 5 = 0) SELECT category, id FROM f WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.category = f.category AND old.text = f.text)")
def q_promotion_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New facts only: one of each category and text, none that exists."""
    facts = M.extract_memories(_said(spark, sf_dir))
    old = facts.where("session_id % 5 = 0").select("category", "text").distinct()
    return facts.groupBy("category", "text").agg(F.min("id").alias("id")).join(old, ["category", "text"], "left_anti").select("category", "id")


@query(f"WITH {MSG_SQL} SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rn FROM msgs) WHERE rn <= 2")
def q_recent_n(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    return _msgs(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn <= 2").select("session_id", "id")


@query(f"WITH {MSG_SQL} SELECT session_id, min_by(substr(text, 1, 120), turn) FILTER (role = 'user') AS first_user, max_by(substr(text, 1, 120), turn) FILTER (role = 'assistant') AS last_assistant FROM msgs GROUP BY session_id")
def q_session_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first user text and the last assistant text of each session."""
    when = lambda r: F.when(F.col("role") == r, F.col("turn"))
    clip = F.substring("text", 1, 120)
    return _msgs(spark, sf_dir).groupBy("session_id").agg(F.min_by(clip, when("user")).alias("first_user"), F.max_by(clip, when("assistant")).alias("last_assistant"))


@query(f"""WITH {MSG_SQL}, s AS (SELECT session_id, id, created_at, CAST(contains(lower(text), 'the') AS INTEGER) + CAST(contains(lower(text), 'and') AS INTEGER) + CAST(contains(lower(text), 'thing') AS INTEGER) AS rel FROM msgs), a AS (SELECT session_id FROM s GROUP BY session_id HAVING max(rel) > 0)
SELECT session_id, id, rel FROM (SELECT s.*, row_number() OVER (PARTITION BY session_id ORDER BY rel DESC, created_at DESC, id) AS rn FROM s JOIN a USING (session_id) WHERE rel > 0) WHERE rn <= 3""")
def q_archive_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most relevant messages of each archive that has any."""
    terms = F.array(*[F.lit(t) for t in ("the", "and", "thing")])
    s = _msgs(spark, sf_dir).withColumn("rel", T.message_relevance(F.col("text"), terms)).where("rel > 0")
    w = Window.partitionBy("session_id").orderBy(F.desc("rel"), F.desc("created_at"), "id")
    return s.withColumn("rn", F.row_number().over(w)).where("rn <= 3").select("session_id", "id", "rel")


@query(f"""WITH {MSG_SQL}, m AS (SELECT session_id % 7 AS session_id, session_id AS archive, id, created_at, CAST(contains(lower(text), 'tion') AS INTEGER) + CAST(contains(lower(text), 'license') AS INTEGER) + CAST(contains(lower(text), 'the') AS INTEGER) AS rel FROM msgs),
a AS (SELECT session_id, archive, max(rel) AS score FROM m GROUP BY ALL), b AS (SELECT *, max(score) OVER (PARTITION BY session_id) AS top FROM a), n AS (SELECT session_id, archive FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, archive DESC) AS n FROM b WHERE top = 0 OR score > 0) WHERE n <= 2),
f AS (SELECT *, max(rel) OVER (PARTITION BY session_id) AS top FROM m JOIN n USING (session_id, archive)), k AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY rel DESC, archive DESC, created_at DESC, id) AS n FROM f WHERE top = 0 OR rel > 0) WHERE n <= 5)
SELECT session_id, archive, id, rel, row_number() OVER (PARTITION BY session_id ORDER BY rel, created_at, n DESC) AS place FROM k""")
def q_archive_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives ranked by their best message, then their messages, the most relevant last."""
    m = _msgs(spark, sf_dir).select((F.col("session_id") % 7).alias("session_id"), F.col("session_id").alias("archive"), "id", "text", "created_at")
    return M.archive_context(m, "tion license, THE", 2, 5).withColumn("place", F.col("place").cast("long"))


@query(f"WITH {MSG_SQL} SELECT id, regexp_matches(lower(text), 'todo|task|next step|need to|should|해야|작업') AS task, contains(text, '?') AS question, regexp_matches(lower(text), 'error|fail|exception|panic|timeout|오류|실패') AS error FROM msgs")
def q_task_error_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    low = F.lower("text")
    return _msgs(spark, sf_dir).select("id", low.rlike("todo|task|next step|need to|should|해야|작업").alias("task"), F.contains("text", F.lit("?")).alias("question"), low.rlike("error|fail|exception|panic|timeout|오류|실패").alias("error"))


@query(f"WITH {MSG_SQL}, seen AS (SELECT id FROM msgs WHERE turn % 3 = 0) SELECT session_id, id FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY created_at DESC, id DESC) AS rn FROM msgs WHERE id NOT IN (SELECT id FROM seen)) WHERE rn <= 4")
def q_observer_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _msgs(spark, sf_dir)
    return M.observer_candidates(m, m.where("turn % 3 = 0"), 4).select("session_id", "id")


@query(f"""WITH {MSG_SQL} SELECT session_id, '<other-conversation id="' || session_id || '">' || string_agg('[' || role || '] ' || replace(replace(replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&apos;'), chr(10) ORDER BY turn, id) || '</other-conversation>' AS block FROM msgs GROUP BY session_id""")
def q_other_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each other conversation as one escaped block; a session's messages make one value by definition."""
    line = F.concat(F.lit("["), "role", F.lit("] "), T.escape_xml(F.col("text")))
    own = _msgs(spark, sf_dir).groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("turn", "id", line.alias("line")))).alias("all"))
    head = F.concat(F.lit('<other-conversation id="'), F.col("session_id").cast("string"), F.lit('">'))
    return own.select("session_id", F.concat(head, F.array_join(F.transform("all", lambda x: x["line"]), "\n"), F.lit("</other-conversation>")).alias("block"))


@query(f"WITH {MSG_SQL}, c AS (SELECT session_id, turn, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tok FROM msgs) SELECT count(DISTINCT session_id) AS records, count(*) AS chunks, CAST(coalesce(sum(tok), 0) AS BIGINT) AS tokens, max(tok) AS largest, count(*) FILTER (tok > 50) AS over_threshold FROM c")
def q_om_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _msgs(spark, sf_dir).select("session_id", T.estimate_tokens(F.col("text")).alias("tok"))
    return c.agg(F.countDistinct("session_id").alias("records"), F.count("*").alias("chunks"), F.coalesce(F.sum("tok"), F.lit(0)).alias("tokens"), F.max("tok").alias("largest"), F.count_if(F.col("tok") > 50).alias("over_threshold"))


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS UNBOUNDED PRECEDING) AS run FROM (SELECT DISTINCT ON (l_orderkey, l_linenumber) l_orderkey, l_linenumber, l_quantity FROM lineitem ORDER BY l_orderkey, l_linenumber, l_quantity))
SELECT l_orderkey, greatest(count(*) FILTER (run <= 60), 1) AS chunks, CAST(coalesce(max(run) FILTER (run <= 60), min_by(run, l_linenumber)) AS BIGINT) AS tokens FROM r GROUP BY l_orderkey""")
def q_activation_boundary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best prefix of each order's lines within a target, at least one line."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_quantity").cast("long").alias("q"))
    return M.activation_boundary(li, "l_orderkey", "l_linenumber", "q", F.lit(60))


@query(f"WITH {MSG_SQL}, c AS (SELECT session_id, turn, id, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY session_id ORDER BY turn, id ROWS UNBOUNDED PRECEDING) - ceil(length(text) / 4.0) AS before FROM msgs) SELECT session_id, id FROM c WHERE before < 100")
def q_buffered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries in order until a token target is reached, always the first."""
    w = Window.partitionBy("session_id").orderBy("turn", "id").rowsBetween(Window.unboundedPreceding, 0)
    tok = T.estimate_tokens(F.col("text"))
    return _msgs(spark, sf_dir).withColumn("before", F.sum(tok).over(w) - tok).where("before < 100").select("session_id", "id")


_STATES = f"{MSG_SQL}, grid AS (SELECT id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens, CASE session_id % 4 WHEN 1 THEN 0.5 WHEN 2 THEN 0.8 WHEN 3 THEN 1.5 END AS act, CASE WHEN turn % 3 > 0 THEN 100 END AS blk, session_id % 5 = 0 AS buffered, turn % 4 = 1 AS buffering, session_id % 7 = 0 AS reflecting FROM msgs)"


@query(f"""WITH {_STATES} SELECT id, tokens, CASE WHEN reflecting THEN 'none' WHEN act IS NULL THEN CASE WHEN tokens > 50 THEN 'reflect' ELSE 'none' END WHEN act > 1 OR act <= 0 THEN 'none'
WHEN tokens > 50 THEN CASE WHEN buffered OR coalesce(tokens >= blk, false) THEN 'reflect' WHEN buffering THEN 'none' ELSE 'buffer' END WHEN buffered OR buffering THEN 'none' WHEN tokens >= 50 * act THEN 'buffer' ELSE 'none' END AS action FROM grid""")
def q_reflection_action(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The decision for every message's tokens, with states and options that go with its session and turn."""
    k, turn = F.col("session_id"), F.col("turn")
    act = F.when(k % 4 == 1, 0.5).when(k % 4 == 2, 0.8).when(k % 4 == 3, 1.5)
    action = M.reflection_action(F.col("tokens"), F.lit(50), act, F.when(turn % 3 > 0, 100), k % 5 == 0, turn % 4 == 1, k % 7 == 0)
    return _msgs(spark, sf_dir).withColumn("tokens", T.estimate_tokens(F.col("text"))).select("id", "tokens", action.alias("action"))


@query(f"""WITH {MSG_SQL}, r AS (SELECT session_id, turn, sum(ceil(length(text) / 4.0)) OVER (PARTITION BY session_id ORDER BY turn, id ROWS UNBOUNDED PRECEDING) AS pending FROM msgs), p AS (SELECT *, coalesce(lag(pending) OVER (PARTITION BY session_id ORDER BY turn, pending), 0) AS last FROM r)
SELECT session_id, turn, CAST(pending AS BIGINT) AS pending, pending >= 200 AS threshold_reached, floor(pending / 50) > floor(last / 50) AND pending < 200 AS interval_triggered, pending >= 240 AS block_after_exceeded FROM p""")
def q_observer_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold, interval and block-after on every message."""
    w = Window.partitionBy("session_id").orderBy("turn", "id")
    r = _msgs(spark, sf_dir).withColumn("pending", F.sum(T.estimate_tokens(F.col("text"))).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    r = r.withColumn("last", F.coalesce(F.lag("pending").over(Window.partitionBy("session_id").orderBy("turn", "pending")), F.lit(0)))
    d = M.observer_write(F.col("pending"), F.lit(0), F.col("last"), 200, None, 50, 240)
    return r.select("session_id", "turn", "pending", d["threshold_reached"].alias("threshold_reached"), d["interval_triggered"].alias("interval_triggered"), d["block_after_exceeded"].alias("block_after_exceeded"))


@query(f"""WITH {MSG_SQL}, e AS (SELECT session_id AS scope, id AS entry_id, 'medium' AS priority, turn FROM msgs) SELECT scope, entry_id, priority, CASE WHEN turn < 3 THEN scope || ':r' END AS superseded_by FROM e
UNION ALL SELECT scope, scope || ':r', 'high', NULL FROM (SELECT DISTINCT scope FROM e)""")
def q_reflection_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One generation of reflections: the first turns are superseded by one merged entry a session."""
    m = _msgs(spark, sf_dir)
    entries = m.select(F.col("session_id").alias("scope"), F.col("id").alias("entry_id"), "text", F.lit("medium").alias("priority"), F.lit(None).cast("string").alias("superseded_by"))
    covers = F.collect_list(F.when(F.col("turn") < 3, F.col("id")))
    refl = m.groupBy(F.col("session_id").alias("scope")).agg(covers.alias("covers")).select("scope", F.concat(F.col("scope").cast("string"), F.lit(":r")).alias("event_id"), F.lit("merged").alias("text"), "covers")
    return M.apply_reflection(entries, refl).select("scope", "entry_id", "priority", "superseded_by")


@query(f"""WITH {MSG_SQL}, u AS (SELECT session_id, created_at, id, CASE WHEN role <> 'assistant' THEN text END AS task, CASE WHEN role <> 'user' THEN text END AS reply, CASE WHEN turn % 4 = 0 THEN 940 WHEN turn % 4 = 1 THEN 720 WHEN turn % 4 = 2 THEN 600 ELSE 450 END AS c FROM msgs),
f AS (SELECT session_id, list_reduce(list({{'task': task, 'reply': reply, 'c': c}} ORDER BY created_at, id), lambda s, x: {{
 'task': CASE WHEN x.c >= 500 THEN coalesce(nullif(trim(x.task, ' '), ''), s.task) ELSE s.task END,
 'reply': CASE WHEN x.c >= 700 AND nullif(trim(x.reply, ' '), '') IS NOT NULL AND (s.reply IS NULL OR s.c <= x.c) THEN trim(x.reply, ' ') ELSE s.reply END,
 'c': CASE WHEN (x.c >= 500 AND nullif(trim(x.task, ' '), '') IS NOT NULL) OR (x.c >= 700 AND nullif(trim(x.reply, ' '), '') IS NOT NULL AND (s.reply IS NULL OR s.c <= x.c)) THEN x.c ELSE s.c END}},
 {{'task': NULL::VARCHAR, 'reply': NULL::VARCHAR, 'c': 0}}) AS s FROM u GROUP BY session_id) SELECT session_id, s.task AS task, s.reply AS reply, CAST(s.c AS INTEGER) AS confidence FROM f""")
def q_continuation_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuation state of each session, folded in time order."""
    conf = F.get(F.array(F.lit(940), F.lit(720), F.lit(600), F.lit(450)), (F.col("turn") % 4).cast("int"))
    task, reply = F.when(F.col("role") != "assistant", F.col("text")), F.when(F.col("role") != "user", F.col("text"))
    own = _msgs(spark, sf_dir).select("session_id", "id", "created_at", task.alias("task"), reply.alias("reply"), conf.alias("confidence"))
    return Z.fold_continuations(own).select("session_id", "task", "reply", "confidence")


_FOLD = """WITH RECURSIVE o AS (SELECT label AS category, list({'id': vec_id, 'v': list_transform(e, lambda x: x / n)} ORDER BY vec_id) AS rows FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e, sqrt(list_dot_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[]))) AS n FROM embeddings) GROUP BY label),
x AS (SELECT category, rows, 0 AS k, CAST([] AS STRUCT(id BIGINT, v DOUBLE[])[]) AS made, CAST([] AS STRUCT(id BIGINT, m BIGINT)[]) AS said FROM o
UNION ALL SELECT category, rows, k + 1, CASE WHEN best >= 0.9 THEN made ELSE list_append(made, r) END, list_append(said, {'id': r.id, 'm': CASE WHEN best >= 0.9 THEN made[list_position(sims, best)].id ELSE r.id END})
FROM (SELECT *, list_max(sims) AS best FROM (SELECT *, rows[k + 1] AS r, list_transform(made, lambda m: list_dot_product(m.v, rows[k + 1].v)) AS sims FROM x WHERE k < len(rows)))),
s AS (SELECT category, unnest(said) AS s FROM x WHERE k = len(rows)) SELECT category, s.id AS id, s.m AS memory_id, CASE WHEN s.m = s.id THEN 'create' ELSE 'merge' END AS decision FROM s"""


@query(_FOLD)
def q_memory_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Greedy resolution of vectors within their category."""
    e = table(spark, sf_dir, "embeddings").select(F.col("label").alias("category"), F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return M.resolve_candidates(e, 0.9)


@query("""WITH rules(prefix, kind) AS (VALUES ('ctx://resources/src1', 'a'), ('ctx://resources/src2', 'b'), ('ctx://resources', 'c')), u AS (SELECT doc_id, 'ctx://resources/' || source || '/' || lang AS uri FROM documents), t AS (SELECT doc_id, uri, CASE WHEN uri = 'ctx://resources/src1' OR starts_with(uri, 'ctx://resources/src1/') THEN 'a' WHEN starts_with(uri, 'ctx://resources/src2/') THEN 'b' ELSE 'c' END AS kind FROM u)
SELECT doc_id // 10 AS link_id, count(*) AS arity, count(*) >= 2 AND count(*) FILTER (kind = 'a') > 0 AND count(*) FILTER (kind = 'b') > 0 AS valid FROM t GROUP BY 1""")
def q_ontology_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of documents judged against a link type: arity, and both ends covered."""
    from tessera.operators.retrieval import longest_prefix

    u = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("ctx://resources/"), "source", F.lit("/"), "lang").alias("uri"))
    kinds = longest_prefix(u.select("uri").distinct(), [("ctx://resources/src1", "a"), ("ctx://resources/src2", "b"), ("ctx://resources", "c")])
    t = u.join(kinds, "uri")
    has = lambda k: F.count_if(F.col("object_type") == k) > 0
    return t.groupBy(F.floor(F.col("doc_id") / 10).alias("link_id")).agg(F.count("*").alias("arity"), ((F.count("*") >= 2) & has("a") & has("b")).alias("valid"))


@query("WITH d(kind) AS (VALUES ('click'), ('view'), ('refund')) SELECT d.kind, count(e.event_id) AS uses, count(e.event_id) > 0 AS holds FROM d LEFT JOIN events e ON e.event_type = d.kind GROUP BY d.kind")
def q_invariants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Declared action types against those in use; the declarations are the small side."""
    declared = spark.createDataFrame([("click",), ("view",), ("refund",)], "kind string")
    used = table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("n"))
    both = declared.join(used, F.col("kind") == F.col("event_type"), "left")
    n = F.coalesce("n", F.lit(0))
    return both.select("kind", n.alias("uses"), (n > 0).alias("holds"))


@query(f"WITH {MSG_SQL} SELECT session_id, CAST(sum(ceil(length(text) / 4.0)) AS BIGINT) AS tokens, max_by(id, (created_at, id)) AS anchor, max(created_at) AS last_observed, list_sort(list(DISTINCT id)) AS message_ids FROM msgs WHERE trim(text, ' ') <> '' GROUP BY session_id")
def q_observation_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chunk of each session's messages."""
    return C.build_chunks(_msgs(spark, sf_dir))


@query(rf"WITH {SAID_SQL} SELECT DISTINCT category, text, session_id::VARCHAR AS session_id, id FROM (SELECT category, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text, session_id, id FROM ({_category_sql()})) WHERE text <> ''")
def q_memory_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Memories written as documents by category and read back."""
    m = M.extract_memories(_said(spark, sf_dir)).withColumn("text", T.collapse(F.col("text"))).where("text <> ''")
    return C.render_entries(m).mapInPandas(C.parse_documents, "category string, text string, session_id string, id string")


@query(f"""WITH {SAID_SQL}, m AS (SELECT category, text, id FROM ({_category_sql()})), w AS (SELECT *, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g'), ' ') AS words FROM m),
h AS (SELECT *, CASE WHEN words = '' THEN 14695981039346656037::UBIGINT ELSE list_reduce(list_transform(string_split(words, ''), lambda x: ascii(x)::UBIGINT), lambda a, x: CAST((xor(a, x)::UHUGEINT * 17592186044851) % 18446744073709551616::UHUGEINT AS UBIGINT), 14695981039346656037::UBIGINT) END AS h FROM w)
SELECT category, text, id, CASE category WHEN 'profile' THEN 'profile' WHEN 'preferences' THEN 'pref-' WHEN 'entities' THEN 'entity-' WHEN 'events' THEN 'event-' WHEN 'cases' THEN 'case-' ELSE 'pattern-' END || CASE WHEN category = 'profile' THEN '' ELSE substr(lpad(lower(to_hex(h)), 16, '0'), 1, 12) END AS key FROM h""")
def q_memory_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The key of every memory."""
    return C.with_memory_keys(M.extract_memories(_said(spark, sf_dir)).select("category", "text", "id"))


@query("""WITH n AS (SELECT event_id // 2 AS event_id, event_id AS seq, user_id AS scope, event_id % 3 AS generation FROM events), f AS (SELECT event_id, min(seq) AS seq, min_by(scope, seq) AS scope, min_by(generation, seq) AS generation FROM n GROUP BY event_id)
SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'idempotent_event' WHEN generation <> scope % 3 THEN 'stale_generation' ELSE 'applied' END AS outcome FROM f""")
def q_chunk_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks appended once for each event, if their generation is the present one."""
    e = table(spark, sf_dir, "events")
    new = e.select(F.floor(F.col("event_id") / 2).alias("event_id"), F.col("event_id").alias("seq"), F.col("user_id").alias("scope"), (F.col("event_id") % 3).alias("generation"))
    done = new.where("event_id % 10 = 0").select("event_id")
    now = e.select(F.col("user_id").alias("scope"), (F.col("user_id") % 3).alias("generation")).distinct()
    return C.append_chunks(new, done, now).select("event_id", "outcome")
