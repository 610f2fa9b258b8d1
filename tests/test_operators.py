"""Operators of indexing, the namespace, ledgers, memory writes, ranking and suites, on rows by hand."""

import re

import pytest
from pyspark.sql import functions as F

from tessera.operators import docs as D
from tessera.operators import indexing as I
from tessera.operators import ledger as L
from tessera.operators import memory as M
from tessera.operators import namespace as N
from tessera.operators import om as Z
from tessera.operators import planner as P
from tessera.operators import ranking as K
from tessera.operators import retrieval as R
from tessera.operators import suite as U


def one(spark, *cols, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values)) if values else spark.range(1)
    return df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).first()


def test_files_of_all_formats():
    cases = {
        ("a.md", "---\n\nIntro\n# The Title \ntext"): ("markdown", "The Title"), ("a.md", "***\nfirst\nsecond"): ("markdown", "first"), ("a.json", '{"id": 3, "name": " N "}'): ("json", "N"), ("a.json", "{bad"): ("text", "{bad"),
        ("a.yaml", "title: T\nlist:\n- 1\n"): ("yaml", "T"), ("a.yml", "a: [1"): ("text", "a: [1"), ("a.toml", 'name = "x"\n[t]\nk = 1\n'): ("toml", "x"), ("a.toml", "= 1"): ("text", "= 1"),
        ("a.jsonl", 'no\n{"a": 1}\n{"title": "J"}'): ("jsonl", "J"), ("a.jsonl", "no"): ("text", "no"), ("a.xml", "<r><name>X</name></r>"): ("xml", "X"), ("a.xml", "plain"): ("text", "plain"), (".env", "K=1"): ("text", "K=1"), ("a", ""): ("text", None),
    }
    for (name, raw), want in cases.items():
        assert I.parse_text(name, raw)[:2] == want, (name, raw)
    assert I.parse_text("a.toml", 'b = 1\na = "x  y"')[2] == ["$.a=x y", "$.b=1"]
    assert I.parse_text("a.jsonl", '{"b": 1, "a": 2}\nbad\n{"a": []}')[2] == ["jsonl.records=2", "jsonl.keys=a,b", "$[1].a=2", "$[1].b=1", "$[3].a=[]"]


def test_parsed_files_and_nulls(spark):
    df = spark.createDataFrame([("u1", "a.json", '{"k": [true, null]}'), ("u2", "b.txt", None)], "uri string, name string, content string")
    got = {r.uri: (r.parser, r.title, r.lines) for r in I.parse_files(df).collect()}
    assert got == {"u1": ("json", None, ["$.k[0]=true", "$.k[1]=null"]), "u2": ("text", None, [])}


def test_endings_classes_and_filters(spark):
    n = F.col("n")
    for name, end in (("A.PY", "py"), (".env", ""), ("x", ""), ("a.tar.gz", "gz"), ("a.", "")):
        assert one(spark, I.ending(n), n=name).c0 == end
    cls = lambda c, name, p: one(spark, I.doc_class(F.lit(c), n, F.lit(p)), n=name).c0
    assert [cls("skill", "a.py", "text"), cls("resource", "OpenAPI.md", "markdown"), cls("resource", "a.hpp", "text"), cls("resource", "a.xml", "xml")] == ["skill", "spec", "code", "data"]
    ok = lambda path, **k: one(spark, I.ingestible(n, **k), n=path).c0
    assert ok("a/b.txt") and not ok("a/.git/x") and ok("a/.git/x", include_hidden=True) and not ok("a/b.txt", exclude=("a/*.txt", " ")) and not ok("a/b.txt", markdown_only=True)


def test_snippets_and_headings(spark):
    c = F.col("c")
    text = "intro\n# One\nThe Token is here\n## Two token\n"
    assert tuple(one(spark, I.snippet(c, F.lit("x"), ["token"]), I.matched_heading(c, ["token"]), I.matched_heading(c, ["none"]), I.snippet(c, F.lit(" abs "), ["none"]), I.snippet(c, F.lit(" "), ["none"]), c=text)) == ("The Token is here", "Two token", "One", "abs", None)
    long = "x" * 400
    assert len(one(spark, I.snippet(c, F.lit(""), []), c=long).c0) == 240


def test_namespace(spark):
    rows = [(1, "t", "en", "a"), (2, "t", "en", "b"), (3, "t", "de", "a")]
    docs = D.from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    uris = lambda df: sorted(r.uri for r in df.collect())
    moved = N.move(docs, "ctx://resources/a", "ctx://resources/b/x")
    assert uris(moved) == ["ctx://resources/b/en/2.txt", "ctx://resources/b/x/de/3.txt", "ctx://resources/b/x/en/1.txt"] and moved.where("depth = 4").count() == 2
    onto = N.move(docs, "ctx://resources/a/en/1.txt", "ctx://resources/b/en/2.txt")
    assert uris(onto) == ["ctx://resources/a/de/3.txt", "ctx://resources/b/en/2.txt"]  # what was there is replaced
    with pytest.raises(PermissionError):
        N.move(docs, "ctx://resources/a", "ctx://user/a")
    with pytest.raises(PermissionError):
        N.make_directory(docs, "ctx://queue/x")
    with pytest.raises(ValueError):
        N.remove(docs, "ctx://resources/a", recursive=False)
    assert uris(N.remove(docs, "ctx://resources/a", recursive=True)) == ["ctx://resources/b/en/2.txt"]
    made = {r.uri: r.parent_uri for r in N.make_directory(docs, "ctx://user/x/y").collect()}
    assert made == {"ctx://user": None, "ctx://user/x": "ctx://user", "ctx://user/x/y": "ctx://user/x"}
    rel = spark.createDataFrame([("o", "a", ["ctx://user/1", "ctx://user/2"], "r"), ("o", "b", ["ctx://user/1"], " ")], "owner_uri string, id string, uris array<string>, reason string")
    assert {r.id: r.faults for r in N.relation_faults(rel).collect()} == {"b": ["empty_reason", "too_few"]}
    assert [r.id for r in N.unlink(rel, "o", "b").collect()] == ["a"] and N.link(rel, rel).count() == 2


def test_ledgers(spark):
    t = spark.createDataFrame([("a", 1, 10), ("b", 2, 10)], "worker_name string, last_event_id int, updated_at int")
    new = spark.createDataFrame([("b", 9, 11), ("b", 7, 12), ("c", 1, 1)], t.schema)
    assert sorted(map(tuple, L.put(t, new, ["worker_name"]).collect())) == [("a", 1, 10), ("b", 7, 12), ("c", 1, 1)]
    done = spark.createDataFrame([(1, 20)], "id int, created_at int")
    assert [tuple(r) for r in L.checkpoints(L.advance(t, "b", done)).collect()] == [("a", 1, 10), ("b", 2, 20)]  # never further back
    assert L.advance(t, "z", done.limit(0)).count() == 2 and L.point(t, worker_name="a").count() == 1


def test_reflection_text(spark):
    rows = [(["a", "b", "c"], "a\nb", "R"), (["a", "b"], "x", "R"), (["a", " b "], "a\nb\nc", " "), (["a"], "a", "R"), ([], "", "R")]
    df = spark.createDataFrame(rows, "active array<string>, covered string, r string")
    got = [x[0] for x in df.coalesce(1).select(Z.merge_reflection(F.col("active"), F.col("covered"), F.col("r"))).collect()]
    assert got == ["R\n\nc", "R\n\na\nb", "a\n b", "R", "R"]
    assert one(spark, Z.reflection_draft(F.col("o"), 5), o="  \n").c0 is None


def test_observer_falls_back_and_models_are_injected(spark):
    m = spark.createDataFrame([(1, "1:0", 0, "user", "hello"), (2, "2:0", 0, "tool", " ")], "session_id long, id string, turn int, role string, text string")
    active = spark.createDataFrame([(1, "[user] hello")], "session_id long, line string")
    got = {r.session_id: r for r in Z.respond(m, active, 100).collect()}
    assert got[1].observations == "[user] hello" and got[1].confidence == 320 and got[2].observations == "" and got[2].confidence == 0
    model = lambda msgs: Z.observer_response(msgs.where("session_id = 2"), active, 100).withColumn("observations", F.lit("made"))
    assert {r.session_id: (r.source, r.observations) for r in Z.respond(m, active, 100, "auto", model).collect()} == {1: ("deterministic", "[user] hello"), 2: ("model", "made")}
    with pytest.raises(ValueError):
        Z.respond(m, active, 100, "model")


def test_configuration():
    c = Z.resolve(share_token_budget=True, buffer_tokens=Z.DISABLED)
    assert c.total_budget == 70_000 and c.threshold(10_000) == 60_000 and c.threshold(50_000) == 30_000 and c.buffer_tokens is None
    for bad, name in (({"message_tokens": 100, "block_after": float("nan")}, "observation_block_after"), ({"reflection_block_after": 0.5}, "reflection_block_after"), ({"buffer_tokens": 0}, "buffer_tokens_absolute")):
        with pytest.raises(Z.ConfigError, match=name):
            Z.resolve(**bad)
    assert Z.saves_output(False, 1) and not Z.saves_output(True, 1) and not Z.saves_output(False, 0)


def test_query_needs_and_hints():
    assert K.tokens("fooBar HTTPServer (x)") == ["foo", "bar", "http", "server", "x", "foobar", "httpserver", "x"]
    assert K.intent("a::b", ["a", "b", "a::b"]) == "lexical" and K.intent("how to do it", ["how", "to", "do", "it"]) == "semantic" and K.intent("two words", ["two", "words"]) == "mixed"
    assert K.needs(["config", "how"], "mixed") == ["config", "guide"] and K.needs([], "lexical") == ["code"]
    assert K.merge_hints(["r1", "r1"], "om", ["n1", "n2", "n3"], 4, 1, 10) == ["n1", "om", "r1", "n2"]
    assert K.merge_hints([" r  1 "], None, ["n1", " "], 4, 1, 3) == ["r 1", "n1"] and K.merge_hints(["x"], "o", [], 0, 1, 9) == []
    assert K.recent_hints(["a", "b", "c"], 2) == ["c", "b"]
    q = P.Request("q", "search", session_hints=("a",), filter={"tags": ["x"]}, max_ms=5)
    assert K.notes(q, P.plan(q))[1:] == ["fanout:3", "fanout_priority_weighting:v1", "budget_nodes:256", "budget_depth:5", "session_hints:1", "session_om_hints:0", "filter", "budget_ms:5"]


def test_rerank_by_class(spark):
    rows = [("ctx://resources/a/x.py", "resource", "x.py", []), ("ctx://resources/a/guide.md", "resource", "guide.md", ["how"]), ("ctx://user/memories/m.md", "memory", "m.md", []), ("ctx://resources/spec/y.bin", "resource", "y.bin", ["doc_class:odd", "parser:none"])]
    docs = spark.createDataFrame(rows, "uri string, context_type string, name string, tags array<string>")
    hits = docs.select("uri", F.lit(1.0).alias("score"))
    got = {r.uri.split("/")[-1]: (r.doc_class, r.score) for r in K.rerank(hits, docs, "explain how this works now", 10).collect()}
    # semantic; guide: narrative .12 + need .16 + tag .03 (its name holds no token of the query)
    assert got == {"x.py": ("code", 1.0), "guide.md": ("narrative", 1.31), "m.md": ("memory", 1.09), "y.bin": ("spec", 1.25)}
    assert K.rerank(hits, docs, "x", 2, mode="off").count() == 2


def test_index_on_disk(spark, tmp_path):
    rows = [(1, "alpha beta alpha", "en", "s"), (2, "beta", "en", "s"), (3, "", "en", "s")]
    docs = D.from_documents(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    index = R.build_index(D.word_postings(docs), str(tmp_path / "i"), buckets=4)
    assert (index.n, index.avg_len) == (2, 2.0)
    want = {r.uri: (pytest.approx(r.bm25), r.matched) for r in R.bm25(D.word_postings(docs), ["alpha", "beta", "none"]).collect()}
    assert {r.uri: (r.bm25, r.matched) for r in index.bm25(spark, ["alpha", "beta", "none"]).collect()} == want and index.bm25(spark, []).count() == 0
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", index.rows(spark, ["alpha"])._jdf.queryExecution().toString())


def test_near_pairs(spark):
    words = ["brand", "brnad", "brad", "brands", "grand", "other", "a", "", "ab", "ba"]
    df = spark.createDataFrame([(w,) for w in words], "a string")

    def near(a, b):
        if abs(len(a) - len(b)) > 1:
            return False
        if len(a) == len(b):
            d = [i for i in range(len(a)) if a[i] != b[i]]
            return len(d) < 2 or (len(d) == 2 and d[1] == d[0] + 1 and a[d[0]] == b[d[1]] and a[d[1]] == b[d[0]])
        s, t = sorted((a, b), key=len)
        return any(t[:i] + t[i + 1 :] == s for i in range(len(t)))

    got = {(r.a, r.b) for r in R.near_pairs(df, df.toDF("b"), "a", "b").collect()}
    assert got == {(a, b) for a in words for b in words if near(a, b)}


def test_reports(spark):
    df = spark.createDataFrame([(1, None)], "a int, b string")
    assert U.report_json(df, "r") == '{"report": "r", "rows": [{"a": 1, "b": null}]}' and U.report_markdown(df, "T") == "# T\n\n| a | b |\n|-|-|\n| 1 |  |\n"


def test_commits_without_archives(spark):
    m = M.messages(spark.createDataFrame([(1, 0, "user", "My name is Kim")], "conv_id long, turn int, role string, text string"))
    none = spark.createDataFrame([], "session_id long, archive int")
    rows, found = M.commit(m, none)
    assert rows.first().archive == 1 and found.first().category == "profile" and M.commit(m, none, extract=False)[1].count() == 0


def test_streams_go_on_where_they_stopped(spark, tmp_path):
    from tessera.streaming import outbox

    import uuid

    name = f"t-{uuid.uuid4().hex}"  # the shared folder may outlive this run
    schema = "event_id long, user_id long, event_type string, ts timestamp_ntz"
    row = lambda *ids: spark.createDataFrame([(i, i % 2, f"t{i}") for i in ids], "event_id long, user_id long, event_type string").withColumn("ts", F.lit("2024-01-01").cast("timestamp_ntz"))
    row(1, 2, 2).write.parquet(f"{tmp_path}/in/a")
    once = outbox.fold_stream(spark, f"{tmp_path}/in", schema, name=name)
    assert {r.user_id: (r.last_type, r.events) for r in once.collect()} == {0: ("t2", 1), 1: ("t1", 1)}
    row(2, 4, 5).write.parquet(f"{tmp_path}/in/b")
    again = outbox.fold_stream(spark, f"{tmp_path}/in", schema, name=name)
    assert {r.user_id: (r.last_type, r.events) for r in again.collect()} == {0: ("t4", 2), 1: ("t5", 2)}
    timed = outbox.fold_stream(spark, f"{tmp_path}/in", schema, time="ts")
    assert {r.user_id: r.last_event for r in timed.collect()} == {0: 4, 1: 5}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from tessera.sources import shared

    class Session:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

    with pytest.raises(ValueError):
        shared.shared_dir(Session)


def test_configurations_as_columns_agree_with_resolve(spark):
    import itertools

    from tessera.operators import om

    names = ("scope", "share_token_budget", "message_tokens", "observation_tokens", "max_tokens_per_batch", "buffer_tokens", "buffer_ratio", "buffer_off", "buffer_activation", "block_after", "reflection_activation", "reflection_block_after")
    kinds = "scope string, share_token_budget boolean, message_tokens int, observation_tokens int, max_tokens_per_batch int, buffer_tokens int, buffer_ratio double, buffer_off boolean, buffer_activation double, block_after double, reflection_activation double, reflection_block_after double"
    rows = []
    for i, (scope, share, base, buffer, off, block) in enumerate(itertools.product(("session", "resource"), (True, False, None), (None, 0, 100, 7), ((None, None), (20, None), (None, 0.5), (None, 1.5), (0, None), (100, None)), (True, None), (None, 1.5, 50.0, 300.0, float("inf"), 0.5))):
        rows.append((scope, share, base, (None, 500, 0)[i % 3], (None, None, 0, 9)[i % 4], *buffer, off, (None, 0.4, 0.0)[i % 3], block, (None, 1.0, 2.0)[i % 5 % 3], (None, 90_000.0)[i % 2]))
    got = om.resolve_columns(spark.createDataFrame(rows, ", ".join(kinds.split(", "))).coalesce(1)).collect()
    for r, given in zip(got, rows):
        o = dict(zip(names, given))
        buffer = om.DISABLED if o["buffer_off"] else o["buffer_tokens"] if o["buffer_tokens"] is not None else o["buffer_ratio"]
        try:
            c = om.resolve(o["scope"], bool(o["share_token_budget"]), o["message_tokens"], o["max_tokens_per_batch"], buffer, o["buffer_activation"], o["block_after"], o["observation_tokens"], o["reflection_activation"], o["reflection_block_after"])
            want = (None, c.message_tokens, c.buffer_tokens, c.observation_block_after, c.reflection_block_after)
        except om.ConfigError as e:
            want = (str(e), None, None, None, None)
        assert (r.error, r.threshold, r.buffer, r.block, r.reflection_block) == want, o


def test_status_measures(spark):
    from tessera.operators import om

    kinds = "is_observing boolean, is_reflecting boolean, is_buffering_observation boolean, is_buffering_reflection boolean, observation_token_count long, pending_message_tokens long, observer_trigger_count_total long, reflector_trigger_count_total long"
    df = spark.createDataFrame([(True, False, None, True, 5, None, 1, 2), (True, None, False, False, 7, 3, None, 4)], kinds)
    assert tuple(om.status(df).first()) == (2, 2, 0, 0, 1, 12, 3, 1, 6) and tuple(om.status(df.limit(0)).first()) == (0,) * 9
