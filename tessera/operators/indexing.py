"""Files to document rows: parsers by ending, titles, tags, windows of long files, directory summaries, hits."""

from __future__ import annotations

import json
import re
import tomllib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import docs as D
from tessera.sources.files import flatten_json, flatten_xml, glob_regex

#: Parsers with the endings that they read and the tags that they give. Fixed values.
PARSERS = {
    "markdown": (["md", "markdown"], ["markdown"]), "json": (["json"], ["json", "config"]), "yaml": (["yaml", "yml"], ["yaml", "config"]),
    "toml": (["toml"], ["toml", "config"]), "jsonl": (["jsonl"], ["jsonl", "data"]), "xml": (["xml"], ["xml", "data"]),
}
CODE = ("rs", "py", "ts", "tsx", "js", "jsx", "java", "go", "c", "cpp", "h", "hpp")
CONFIG = ("ini", "cfg", "conf", "env", "properties", "yaml", "yml", "json", "jsonl", "toml", "xml")
LOGS = ("log", "out")
LOG_NAMES = ("log", "trace", "event")
SPEC_NAMES = ("schema", "contract", "openapi")
#: What marks a line of code, of a log. Fixed values.
CODE_STARTS = ("fn ", "pub fn", "async fn", "def ", "class ", "function ", "impl ")
LOG_SIGNALS = ("error", "warn", "panic", "exception", "timeout", "dead_letter", "failed", "failure", "traceback")
#: Names that the index leaves out. Fixed values.
SYSTEM_FILES = (".abstract.md", ".overview.md", ".meta.json", ".relations.json", "messages.jsonl")
#: Words that say nothing about a directory. Fixed values.
STOP_WORDS = (
    "the", "and", "for", "with", "from", "into", "this", "that", "are", "was", "were", "have", "has", "had", "you", "your",
    "our", "their", "its", "but", "not", "all", "any", "can", "will", "would", "about", "contains", "item", "items",
)
HEAD_BYTES, WINDOW_BYTES, WINDOW_LINES, LINE_CHARS = 512 * 1024, 12 * 1024, 18, 220
TAIL_HEADINGS, HEADING_CHARS = 64, 160
SNIPPET = 240


def ending(name: Column) -> Column:
    """The lower-case file ending; empty for names without one, also if only a dot leads."""
    return F.regexp_extract(F.lower(name), r"^.+\.([^.]+)$", 1)


def any_in(text: Column, words: tuple[str, ...] | list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(text, F.lit(w))
    return out


def parser_of(name: Column, content: Column) -> Column:
    """The parser by ending; JSON that can't be read is text, and so are JSON lines without a good one."""
    own, end = F.lit("text"), ending(name)
    for parser, (ends, _) in PARSERS.items():
        ok = end.isin(ends)
        if parser == "json":
            ok = ok & F.try_parse_json(content).isNotNull()
        elif parser == "jsonl":
            ok = ok & F.exists(T.lines(content), lambda x: (F.trim(x) != "") & F.try_parse_json(x).isNotNull())
        elif parser == "xml":
            ok = ok & content.rlike(r"<[A-Za-z]")
        own = F.when(ok, parser).otherwise(own)
    return own


def json_title(content: Column) -> Column:
    """The first of title, name and id that is a string with something in it."""
    v = F.try_parse_json(content)
    own = []
    for key in ("title", "name", "id"):
        is_text = F.schema_of_variant(F.try_variant_get(v, f"$.{key}", "variant")) == "STRING"
        own.append(F.when(is_text, F.nullif(F.trim(F.try_variant_get(v, f"$.{key}", "string")), F.lit(""))))
    return F.coalesce(*own)


def title_of(parser: Column, content: Column) -> Column:
    """The title of Markdown (its first top heading, else the first line), JSON or text; null if there is none."""
    rows = F.transform(T.lines(content), lambda x: F.trim(x))
    first = F.get(F.filter(rows, lambda x: x != ""), F.lit(0))
    plain = F.get(F.filter(rows, lambda x: (x != "") & ~x.rlike(r"^(?:-{3,}|\*{3,}|_{3,})$")), F.lit(0))
    head = F.trim(F.substring(F.get(F.filter(rows, lambda x: x.startswith("# ")), F.lit(0)), F.lit(3), F.length(content)))
    return F.when(parser == "markdown", F.coalesce(head, plain)).when(parser == "json", json_title(content)).otherwise(first)


def parser_tags(parser: Column) -> Column:
    own = F.array(F.lit("text"))
    for name, (_, tags) in PARSERS.items():
        own = F.when(parser == name, F.array(*[F.lit(t) for t in tags])).otherwise(own)
    return own


def doc_class(context: Column, name: Column, parser: Column) -> Column:
    """memory, skill, session, config, data, spec, narrative, code or general."""
    return (
        F.when(context.isin("memory", "skill", "session"), context).when(parser.isin("json", "yaml", "toml"), "config").when(parser.isin("jsonl", "xml"), "data")
        .when((parser == "markdown") & any_in(F.lower(name), SPEC_NAMES), "spec").when(parser == "markdown", "narrative").when(ending(name).isin(*CODE), "code").otherwise("general")
    )


def indexable(name: Column) -> Column:
    return ~name.isin(*SYSTEM_FILES)


def ingestible(path: Column, markdown_only: bool = False, include_hidden: bool = False, exclude: tuple[str, ...] = ()) -> Column:
    """Whether a relative path is taken in: hidden parts, excluded globs and other than Markdown are left out as asked."""
    ok = F.lit(True)
    if not include_hidden:
        ok = ok & ~path.rlike(r"(^|/)\.")
    for pattern in exclude:
        if pattern.strip():
            ok = ok & ~path.rlike(glob_regex(pattern.strip()))
    return ok & ending(path).isin("md", "markdown") if markdown_only else ok


def clean_lines(text: Column) -> Column:
    """Lines with white space collapsed, cut at ``LINE_CHARS``; blank ones are left out."""
    return F.filter(F.transform(T.lines(text), lambda x: F.substring(T.collapse(x), 1, LINE_CHARS)), lambda x: x != "")


def code_signatures(lines: Column, most: int = 12) -> Column:
    low = lambda x: F.lower(x)

    def is_one(x: Column) -> Column:
        starts = F.lit(False)
        for s in CODE_STARTS:
            starts = starts | low(x).startswith(s)
        calls = F.contains(x, F.lit("(")) & F.contains(x, F.lit(")"))
        return starts | (calls & (F.contains(x, F.lit("{")) | F.contains(x, F.lit("->")) | x.endswith(":")))

    return F.slice(F.filter(lines, is_one), 1, most)


def config_keys(lines: Column, most: int = 16) -> Column:
    def is_one(x: Column) -> Column:
        low = F.lower(x)
        return (F.contains(x, F.lit(":")) | F.contains(x, F.lit("="))) & low.rlike("[a-z]") & ~low.startswith("http://") & ~low.startswith("https://")

    return F.slice(F.filter(lines, is_one), 1, most)


def log_signals(lines: Column, most: int = 16) -> Column:
    return F.slice(F.filter(lines, lambda x: any_in(F.lower(x), LOG_SIGNALS)), 1, most)


def section(title: str, lines: Column) -> Column:
    """A titled list of lines, each once whatever its case; nothing without lines."""
    low = F.transform(lines, F.lower)
    once = F.transform(F.array_distinct(low), lambda k: F.get(lines, (F.array_position(low, k) - 1).cast("int")))
    text = F.concat(F.lit(f"\n\n[{title}]\n"), F.array_join(F.transform(once, lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))
    return F.when(F.size(lines) > 0, text).otherwise("")


def _bytes(content: Column, start: Column, size: Column) -> Column:
    return F.make_valid_utf8(F.substring(content.cast("binary"), start, size).cast("string"))


def index_text(content: Column, name: Column, parser: Column, head: int = HEAD_BYTES, window: int = WINDOW_BYTES) -> Column:
    """What is indexed of a file: all of it, or its first bytes with samples of its middle and its tail.

    The samples are lines, and of code, configuration and logs the telling
    lines of the tail; Markdown adds its last headings.
    """
    size, end = F.octet_length(content), ending(name)
    middle = _bytes(content, F.greatest(F.floor(size / 2) - window // 2, F.lit(0)).cast("int") + 1, F.lit(window))
    tail = _bytes(content, F.greatest(size - window, F.lit(0)) + 1, F.lit(window))
    first, every = F.slice(clean_lines(middle), 1, WINDOW_LINES), clean_lines(tail)
    last = F.slice(every, F.greatest(F.size(every) - WINDOW_LINES + 1, F.lit(1)), F.lit(WINDOW_LINES))
    logs = end.isin(*LOGS) | any_in(F.lower(name), LOG_NAMES)
    config = parser.isin("json", "yaml", "toml", "jsonl", "xml") | end.isin(*CONFIG)
    more = F.concat(
        _bytes(content, F.lit(1), F.lit(head)), F.lit(f"\n\n[indexing truncated at {head} bytes]"), section("index middle window sample", first), section("index tail window sample", last),
        F.when(end.isin(*CODE), section("index code tail signatures", code_signatures(last))).otherwise(""), F.when(config, section("index config tail keys", config_keys(last))).otherwise(""),
        F.when(logs, section("index log tail signals", log_signals(last))).otherwise(""), F.when(end.isin("md", "markdown"), section("index markdown tail headings", tail_headings(content))).otherwise(""),
    )
    return F.when(size > head, more).otherwise(content)


def tail_headings(content: Column, most: int = TAIL_HEADINGS) -> Column:
    """The last distinct Markdown headings outside fences, each where it comes first."""
    parts = F.split(content, r"(?m)^[ \t]*(?:```|~~~).*$", -1)
    open_text = F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), "\n")
    heads = F.filter(F.transform(T.lines(open_text), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    texts = F.filter(F.transform(heads, lambda x: F.substring(F.trim(F.regexp_replace(x, "^#+", "")), 1, HEADING_CHARS)), lambda x: x != "")
    low = F.transform(texts, F.lower)
    once = F.transform(F.array_distinct(low), lambda k: F.get(texts, (F.array_position(low, k) - 1).cast("int")))
    return F.slice(once, F.greatest(F.size(once) - most + 1, F.lit(1)), F.lit(most))


def index_entries(files: DataFrame, head: int = HEAD_BYTES, window: int = WINDOW_BYTES) -> DataFrame:
    """Document rows from ``files(uri, name, content, updated_at)``, with a content hash for the ledger.

    System files are left out. Texts of structured kinds are kept as they are;
    ``parse_files`` flattens them.
    """
    context, parser = D.context_type(F.col("uri")), F.col("parser")
    own = files.where(indexable(F.col("name"))).withColumn("parser", parser_of(F.col("name"), F.col("content")))
    text = index_text(F.col("content"), F.col("name"), parser, head, window)
    mime = D.mime(F.col("name"), F.lit(True))
    own = own.withColumn("text", text)
    kind = F.concat(F.lit("doc_class:"), doc_class(context, F.col("name"), parser))
    extra = F.array_compact(F.array(F.concat(F.lit("parser:"), parser), F.when(mime.isNotNull(), F.concat(F.lit("mime:"), mime)), kind))
    tags = F.array_sort(F.array_distinct(F.concat(D.infer_tags(F.col("name"), F.col("text")), parser_tags(parser), extra)))
    title = F.coalesce(title_of(parser, F.col("content")), F.get(T.lines(F.col("text")), F.lit(0)), F.lit("content truncated for indexing"))
    return own.select(
        "uri", F.regexp_replace("uri", r"/[^/]+$", "").alias("parent_uri"), F.lit(True).alias("is_leaf"), context.alias("context_type"), "name", title.alias("abstract_text"),
        F.col("text").alias("content"), tags.alias("tags"), "updated_at", D.depth(F.col("uri")).alias("depth"), F.sha2(F.col("content"), 256).alias("hash"),
    )


def changed_entries(entries: DataFrame, ledger: DataFrame) -> DataFrame:
    """The entries whose hash or time isn't the ledger's ``(uri, hash, updated_at)``."""
    old = ledger.select(F.col("uri").alias("u"), F.col("hash").alias("h"), F.col("updated_at").alias("t"))
    both = entries.join(old, F.col("uri") == F.col("u"), "left")
    return both.where(F.col("u").isNull() | (F.col("hash") != F.col("h")) | (F.col("updated_at") != F.col("t"))).drop("u", "h", "t")


def parse_text(name: str, raw: str) -> tuple[str, str | None, list[str]]:
    """(parser, title, lines) of one file; structured input that can't be read is text."""
    end = name.lower().rsplit(".", 1)[-1] if "." in name.lstrip(".") else ""
    kind = next((p for p, (ends, _) in PARSERS.items() if end in ends), "text")
    title = lambda v: next((x.strip() for k in ("title", "name", "id") if isinstance(v, dict) and isinstance(x := v.get(k), str) and x.strip()), None)
    line = lambda pairs: [f"{p}={v}" for p, v in pairs]
    try:
        if kind in ("json", "toml", "yaml"):
            value = _load(kind, raw)
            return kind, title(value), line(flatten_json(value))
        if kind == "jsonl":
            good = []
            for i, x in enumerate(raw.splitlines(), 1):
                try:
                    good.append((i, json.loads(x)))
                except ValueError:
                    continue
            if good:
                keys: dict[str, int] = {}
                for _, v in good:
                    for k in v if isinstance(v, dict) else ():
                        keys[k] = keys.get(k, 0) + 1
                top = sorted(keys, key=lambda k: (-keys[k], k))[:8]
                lines = [f"jsonl.records={len(good)}"] + ([f"jsonl.keys={','.join(top)}"] if top else [])
                return kind, next((t for _, v in good if (t := title(v))), None), lines + [x for i, v in good for x in line(flatten_json(v, f"$[{i}]"))]
        if kind == "xml" and re.search("<[A-Za-z]", raw) and (pairs := list(flatten_xml(raw))):
            return kind, next((v for p, v in pairs if p.endswith(("/title", "/name", "/id")) and v.strip()), None), line(pairs)
    except (ValueError, TypeError):
        pass
    rows = [x.strip() for x in raw.splitlines() if x.strip()]
    if kind == "markdown":
        first = next((x for x in rows if set(x) not in ({"-"}, {"*"}, {"_"}) or len(x) < 3), None)
        return kind, next((x[2:].strip() for x in rows if x.startswith("# ")), first), raw.splitlines()
    return "text", rows[0] if rows else None, raw.splitlines()


def _load(kind: str, raw: str) -> object:
    if kind == "json":
        return json.loads(raw)
    if kind == "toml":
        return json.loads(json.dumps(tomllib.loads(raw), default=str))
    try:
        import yaml
    except ImportError:  # without a reader it is text
        raise ValueError("no YAML reader") from None
    try:
        return json.loads(json.dumps(yaml.safe_load(raw), default=str))
    except yaml.YAMLError as e:
        raise ValueError(str(e)) from None


def parse_files(files: DataFrame) -> DataFrame:
    """``(uri, parser, title, lines)`` of whole files, in Arrow batches: what structured formats need Python for."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(u, *parse_text(n, c or "")) for u, n, c in zip(pdf["uri"], pdf["name"], pdf["content"])], columns=["uri", "parser", "title", "lines"])

    return files.select("uri", "name", "content").mapInPandas(run, "uri string, parser string, title string, lines array<string>")


def directory_tiers(entries: DataFrame, most_entries: int = 64, most_words: int = 6) -> DataFrame:
    """``(uri, abstract_text, overview)`` of each directory from its ``entries(parent_uri, name, is_dir, content)``.

    The topics are the most frequent tokens of the first entries by name:
    names count twice, the first eight lines of files once. A directory
    without topics is only counted.
    """
    w = Window.partitionBy("parent_uri").orderBy("name")
    own = entries.where(indexable(F.col("name"))).withColumn("place", F.row_number().over(w))
    token = lambda c, n: F.transform(T.tokenize(c), lambda t: F.struct(t.alias("t"), F.lit(n).alias("w")))
    preview = F.array_join(F.slice(T.lines(F.coalesce("content", F.lit(""))), 1, 8), " ")
    words = F.when(F.col("is_dir"), token(F.col("name"), 2)).otherwise(F.concat(token(F.col("name"), 2), token(preview, 1)))
    telling = (F.octet_length("x.t") >= 3) & ~F.col("x.t").rlike("^[0-9]+$") & ~F.col("x.t").isin(*STOP_WORDS)
    counts = own.where(F.col("place") <= most_entries).select("parent_uri", F.explode(words).alias("x")).where(telling).groupBy("parent_uri", F.col("x.t").alias("t")).agg(F.sum("x.w").alias("n"))
    best = counts.withColumn("rank", F.row_number().over(Window.partitionBy("parent_uri").orderBy(F.desc("n"), "t"))).where(F.col("rank") <= most_words)
    topics = best.groupBy("parent_uri").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "t"))), lambda x: x["t"]), ", ").alias("topics"))
    listed = F.array_sort(F.collect_list(F.when(F.col("place") <= 50, F.struct("place", "name"))))
    dirs = own.groupBy("parent_uri").agg(F.count("*").alias("n"), F.count_if("is_dir").alias("dirs"), F.array_join(F.transform(listed, lambda x: F.concat(F.lit("- "), x["name"], F.lit("\n"))), "").alias("names"))
    both = dirs.join(topics, "parent_uri", "left")
    uri, files = F.col("parent_uri"), F.col("n") - F.col("dirs")
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])
    short = F.when(F.col("topics").isNull(), text(uri, " contains ", F.col("n"), " items")).otherwise(text(uri, " semantic summary: ", F.col("n"), " items (", F.col("dirs"), " directories, ", files, " files); topics: ", F.col("topics")))
    summary = F.when(F.col("topics").isNull(), F.lit("")).otherwise(text("Summary:\n- topics: ", F.col("topics"), "\n- directories: ", F.col("dirs"), "\n- files: ", files, "\n\n"))
    return both.select(uri.alias("uri"), short.alias("abstract_text"), text("# ", uri, "\n\n", summary, "Contains:\n", F.col("names")).alias("overview"))


def snippet(content: Column, abstract: Column, words: list[str]) -> Column:
    """The first line with a query word (any line without words), else the abstract, cut at 240 characters; null if both are blank."""
    rows = F.filter(F.transform(T.lines(content), lambda x: F.trim(x)), lambda x: x != "")
    hit = F.get(F.filter(rows, lambda x: any_in(F.lower(x), words)) if words else rows, F.lit(0))
    return F.coalesce(F.substring(hit, 1, SNIPPET), F.nullif(F.substring(F.trim(abstract), 1, SNIPPET), F.lit("")))


def matched_heading(content: Column, words: list[str]) -> Column:
    """The first heading with a query word, else the first heading."""
    heads = F.filter(F.transform(T.lines(content), lambda x: F.trim(x)), lambda x: x.startswith("#"))
    texts = F.filter(F.transform(heads, lambda x: F.trim(F.regexp_replace(x, "^#+", ""))), lambda x: x != "")
    hit = F.get(F.filter(texts, lambda x: any_in(F.lower(x), words)), F.lit(0)) if words else F.lit(None).cast("string")
    return F.substring(F.coalesce(hit, F.get(texts, F.lit(0))), 1, SNIPPET)


def hits(scored: DataFrame, docs: DataFrame, query: str) -> DataFrame:
    """``scored(uri, score)`` as hits: abstract, context type, snippet, matched heading, bucket."""
    words = [w for w in dict.fromkeys("".join(c if c.isalnum() else " " for c in query.lower()).split())]
    own = docs.select("uri", "abstract_text", "context_type", "content")
    return scored.join(own, "uri").select(
        "uri", "score", "abstract_text", "context_type", snippet(F.col("content"), F.col("abstract_text"), words).alias("snippet"),
        matched_heading(F.col("content"), words).alias("matched_heading"), D.hit_bucket(F.col("uri")).alias("bucket"),
    )


def with_tags(docs: DataFrame, tags: DataFrame) -> DataFrame:
    """Documents with their tags from ``tags(uri, tag)``, joined in order; documents without keep ``tags_text``."""
    joined = tags.groupBy(F.col("uri").alias("u")).agg(F.array_join(F.array_sort(F.collect_set("tag")), " ").alias("own"))
    return docs.join(joined, F.col("uri") == F.col("u"), "left").withColumn("tags_text", F.coalesce("own", "tags_text")).drop("u", "own")
