"""Column functions and planners against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import engine, gates, memory, om, ontology, outbox, planner
from tessera.sources import files
from tessera.streaming import observer

WORDS = ["camelCaseHTTPServer", "snake_case::path/x.rs", "Émile", "한국어", "(paren)", "a", "HTTPServer2go", "x.y-z", "...", "don't", "ÀÉa", "plain", "UPPER", "aB"]


def texts():
    rng = random.Random(1)
    return [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(6))) for _ in range(120)] + ["", "  ", "\t\n"]


def plain_split(token):
    out, word = [], ""
    for i, c in enumerate(token):
        if not c.isalnum():
            if word:
                out.append(word)
            word = ""
            continue
        prev = token[i - 1] if i else ""
        nxt = token[i + 1] if i + 1 < len(token) else ""
        prev2 = token[i - 2] if i > 1 else ""
        if word and ((prev.islower() and c.isupper()) or (prev2.isupper() and prev.isupper() and c.isupper() and nxt.islower())):
            out.append(word)
            word = ""
        word += c
    return [w.lower() for w in [*out, word] if w]


def plain_tokens(text):
    plain, symbolic = [], []
    for raw in text.split():
        t = raw.strip("!\"#$%&'()*+,;<=>?@[\\]^`{|}~")
        plain += plain_split(t)
        if any(c.isalnum() for c in t):
            symbolic.append(t.lower())
    return plain + symbolic


def values(spark, rows, schema, *cols):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).coalesce(1).select(*cols).collect()]


def test_tokenize(spark):
    rows = [(t,) for t in texts()]
    for (t,), (got,) in zip(rows, values(spark, rows, "t string", T.tokenize(F.col("t")))):
        assert got == plain_tokens(t), t


def osa(a, b):
    d = {(i, -1): i + 1 for i in range(-1, len(a))} | {(-1, j): j + 1 for j in range(-1, len(b))}
    for i in range(len(a)):
        for j in range(len(b)):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i] != b[j]))
            if i and j and a[i] == b[j - 1] and a[i - 1] == b[j]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a) - 1, len(b) - 1]


def test_edit_distance_and_dice(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abc") for _ in range(rng.randrange(7)))
    rows = [(word(), word()) for _ in range(400)]
    got = values(spark, rows, "a string, b string", T.edit_distance_one(F.col("a"), F.col("b")), T.dice(T.bigrams(F.col("a")), T.bigrams(F.col("b"))))
    for (a, b), (near, d) in zip(rows, got):
        assert near == (osa(a, b) <= 1), (a, b)
        x, y = ([s[i : i + 2] for i in range(len(s) - 1)] for s in (a, b))
        shared = sum(min(x.count(g), y.count(g)) for g in set(x))
        assert d == pytest.approx(2 * shared / (len(x) + len(y)) if x or y else 0.0)


def test_small_text_functions(spark):
    rows = [("running",), ("boxes",), ("cats",), ("used",), ("as",), ("oauth",), ("errors",)]
    assert [g[0] for g in values(spark, rows, "t string", T.canonical_token(F.col("t")))] == ["runn", "box", "cats", "used", "as", "identity", "failure"]
    md = "# One\ntext\n```\n# no\n```\n## Two ##\n"
    ((h, ht, esc),) = values(spark, [(md, "<a & 'b'>")], "m string, x string", T.headings(F.col("m")), T.head_tail(F.array(*[F.lit(str(i)) for i in range(30)]), 5), T.unescape_xml(T.escape_xml(F.col("x"))))
    assert h == ["one", "two"] and ht == ["0", "1", "2", "28", "29"] and esc == "<a & 'b'>"


def test_planner():
    plans = planner.plan(planner.Request("recent chat", "search", session_hints=("h",)))
    assert [p.kind for p in plans] == ["primary", "session_focus", "session_recent"]
    assert planner.plan(planner.Request("my skill", "find")) == [planner.Plan("primary", "my skill", ("agent",), 1)]
    assert planner.budget(planner.Request("q", max_nodes=0)) == (1, 5)
    for bad in ({"score_threshold": 2.0}, {"min_match_tokens": 1}, {"filter": {"x": 1}}):
        with pytest.raises(ValueError):
            planner.plan(planner.Request("q", **bad))


def test_descent_orders_and_stops():
    tree = {"r": [("r/b", False), ("r/a", False)], "r/a": [("r/a/1", True)], "r/b": [("r/b/1", True)]}
    hits, steps, why = engine.descend(tree, {"r/a": 0.4, "r/b": 0.4, "r/a/1": 1.0}, {"r": 0.0}, 256, 5, 10)
    assert [s["uri"] for s in steps] == ["r", "r/b", "r/a"] and why == "queue_empty"
    assert hits == {"r/a/1": pytest.approx(0.6), "r/b/1": pytest.approx(0.1)}
    assert engine.descend(tree, {}, {"r": 0.0}, 1, 5, 10)[2] == "budget_nodes"


def test_reflection_and_policy(spark):
    rows = [("semantic_scan", 4), ("semantic_scan", 5), ("other", 3), ("om_reflect_requested", 8)]
    got = values(spark, rows, "k string, a int", outbox.should_retry(F.col("k"), F.col("a")), outbox.backoff(F.col("k"), F.col("a")))
    assert got == [(True, 8), (False, 16), (False, 4), (False, 64)]


def test_observer_stream_equals_batch(spark, tmp_path):
    rows = [(s, f"{s}:{t}", t, "word " * (20 + 7 * t)) for s in range(5) for t in range(12)]
    df = spark.createDataFrame(rows, "session_id long, id string, turn int, text string")
    want = {r.session_id: tuple(r) for r in observer.fold_batch(df).collect()}
    for part in range(3):
        df.where(f"turn div 4 = {part}").coalesce(1).write.parquet(f"{tmp_path}/in/p{part}")
    source = spark.readStream.schema(df.schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in")
    out = {}

    def keep(batch, _):
        out.update({r.session_id: tuple(r) for r in batch.collect()})

    observer.fold_stream(source).writeStream.foreachBatch(keep).outputMode("update").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start().awaitTermination()
    assert out == want


def test_files(spark, tmp_path):
    (tmp_path / "x.jsonl").write_text('{"a": 1}\nnot json\n{"a": 2}\n')
    good, report = files.read_jsonl_tolerant(spark, str(tmp_path / "x.jsonl"), "a int")
    assert sorted(r.a for r in good.collect()) == [1, 2] and tuple(report.first())[:2] == (2, 1)
    assert list(files.flatten_json({"b": [1, {}], "a": " x  y "})) == [("$.a", "x y"), ("$.b[0]", "1"), ("$.b[1]", "{}")]
    assert list(files.flatten_xml('<a k="v"><b>t</b><br>u</a>')) == [("/a/@k", "v"), ("/a/b", "t"), ("/a", "u")]
    assert re.match(files.glob_regex("**/*.md"), "x/y/z.md") and not re.match(files.glob_regex("*.md"), "x/z.md")


def test_ontology_and_gates(spark):
    schema = {"version": 1, "object_types": [{"id": "a"}, {"id": "a"}], "link_types": [{"id": "l", "from_types": ["b"], "to_types": ["a"]}], "action_types": [{"id": "x", "input_contract": "json-set"}]}
    assert ontology.schema_violations(schema) == ["object_types: duplicate a", "link l: unknown b", "action x: input set"]
    m = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (3, "a"), (3, None)], "link_id int, object_type string")
    assert {r.link_id: r.reasons for r in ontology.links(m, ["a"], ["b"]).collect()} == {1: [], 2: ["too_few", "no_target"], 3: ["no_target", "unknown_type"]}
    kinds = [("1",), ("null",), ("[1]",), ("{}",), ('"s"',), ("true",), ("{",)]
    assert [g[0] for g in values(spark, kinds, "j string", ontology.json_kind(F.col("j")))] == ["number", "null", "array", "object", "string", "boolean", None]
    assert gates.release_decision(3, 0.8, {"relation_missing": 1}) == {"eval": False, "memory": True}
    rep = spark.createDataFrame([(500, 500, 1000, 0.8, 0.8, 130, 70, 40, 20)], ", ".join(f"{n} double" if "10" in n else f"{n} int" for n, _, _ in gates.ACCEPTANCE))
    assert [r.check for r in gates.acceptance(rep).where("not passed").collect()] == ["recall10"]


def test_continuation_is_gated(spark):
    rows = [(1, "1:1", 1, "first", "go", 720), (1, "1:2", 2, "weak", "no", 400), (1, "1:3", 3, "second", None, 600), (1, "1:4", 4, " ", "later", 710), (2, "2:1", 1, None, None, 900)]
    df = spark.createDataFrame(rows, "session_id long, id string, created_at int, task string, reply string, confidence int")
    got = {r.session_id: (r.task, r.reply, r.confidence, r.applied) for r in om.fold_continuations(df).collect()}
    assert got == {1: ("second", "later", 710, 3), 2: (None, None, 0, 0)}


def test_packing_promotion_and_pure_reflection(spark):
    from tessera.operators import observe

    rows = spark.createDataFrame([(1, i, t) for i, t in enumerate([60, 60, 60, 200, 10])], "k int, i int, tokens int")
    assert [r.batch for r in observe.pack(rows, "k", ["i"], "tokens", 150).orderBy("i").collect()] == [0, 0, 1, 2, 3]
    facts = spark.createDataFrame([("c", "a", 1, [1], 500), ("c", "a", 2, [1], 600), ("c", " ", 3, [1], 5), ("c", "old", 4, [1], 5)], "category string, text string, id int, ids array<int>, confidence int")
    old = facts.where("text = 'old'")
    assert [(r.text, r.id, r.confidence) for r in observe.promote(facts, old, True).collect()] == [("a", 1, 600)]
    assert observe.promote(facts, old, False).count() == 0
    e = spark.createDataFrame([(1, "x", "t", "medium", None)], "scope int, entry_id string, text string, priority string, superseded_by string")
    r = spark.createDataFrame([(1, "r", "m", ["x"]), (1, "q", "n", ["none"])], "scope int, event_id string, text string, covers array<string>")
    assert sorted((x.entry_id, x.priority, x.superseded_by) for x in observe.reflect_pure(e, r).collect()) == [("r", "medium", None), ("x", "medium", "r")]
    assert {x.entry_id: x.priority for x in memory.apply_reflection(e, r).collect()} == {"x": "medium", "r": "high", "q": "high"}


def test_keys_and_configuration(spark):
    from tessera.operators import chunks

    assert chunks.text_key("Hello, World!") == chunks.text_key("hello world") != chunks.text_key("hello")
    assert chunks.buffer_tokens(None, 100) == 0 and chunks.buffer_tokens(0.2, 100) == 20 and chunks.buffer_tokens(50, 100) == 50
    assert chunks.block_after(1.2, 100) == 120 and chunks.block_after(300, 100) == 300
    for bad in (0, -1):
        with pytest.raises(ValueError):
            chunks.buffer_tokens(bad, 100)
    rows = [("Persona ", "0.5"), ("rules", "900"), ("x", None)]
    got = values(spark, rows, "c string, v string", chunks.category_of(F.col("c")), chunks.confidence_of(F.col("v")), chunks.thread_id(F.lit(" "), F.col("c")))
    assert got == [("profile", 500, "Persona"), ("patterns", 900, "rules"), (None, 700, "x")]
    faults = spark.createDataFrame([(0, 1, ["a", "a"]), (1, 1, ["a"])], "seq int, tokens int, message_ids array<string>")
    assert [r.faults for r in chunks.chunk_faults(faults).collect()] == [["seq", "repeated_ids"]]


def test_lines_keep_their_digits(spark):
    """A function of two parameters in a transform gets the place, too: trimming must not take it for characters."""
    from tessera.operators import docs, indexing

    df = spark.createDataFrame([("0 first\n1\n# 22 two2\n 3",)], "c string")
    got = df.select(docs.first_line(F.col("c")), indexing.title_of(F.lit("text"), F.col("c")), indexing.tail_headings(F.col("c")), indexing.snippet(F.col("c"), F.lit(""), ["two"])).first()
    assert tuple(got) == ("0 first", "0 first", ["22 two2"], "# 22 two2")
