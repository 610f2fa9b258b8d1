"""Document-aware reranking, search hints and plan notes."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.operators import docs as D
from tessera.operators import indexing as I
from tessera.operators import planner as P
from tessera.operators import retrieval as R

#: Boosts by intent and document class, by need and class, and words that tell a need. Fixed values.
CLASS_BOOST = {
    "lexical": {"code": 0.12, "config": 0.10, "spec": 0.08}, "semantic": {"narrative": 0.12, "spec": 0.09, "memory": 0.09},
    "mixed": {"spec": 0.10, "narrative": 0.08, "code": 0.08, "config": 0.08},
}
NEED_BOOST = {
    "api": (0.22, ["spec"]), "config": (0.20, ["config", "data"]), "code": (0.18, ["code"]), "guide": (0.16, ["narrative", "spec"]), "memory": (0.24, ["memory"]),
    "skill": (0.24, ["skill"]), "session": (0.20, ["session"]),
}
NEED_WORDS = {
    "api": ["api", "endpoint", "schema", "contract", "spec", "openapi", "grpc"],
    "config": ["config", "configuration", "setting", "settings", "env", "yaml", "yml", "toml", "json", "ini", "docker", "compose"],
    "code": ["code", "impl", "function", "stack", "panic", "compile", "build", "trace"], "guide": ["guide", "overview", "summary", "explain", "how", "why"],
    "memory": ["memory", "memories", "preference", "remember"], "skill": ["skill", "skills", "tool", "tools"], "session": ["session", "recent", "conversation", "chat"],
}
CLASSES = ["code", "config", "spec", "narrative", "memory", "skill", "session", "data", "general"]
CODE_ENDS = ["rs", "py", "ts", "tsx", "js", "jsx", "java", "go", "c", "cpp", "h"]
CONFIG_ENDS = ["toml", "yaml", "yml", "ini", "conf", "cfg", "env"]
DATA_ENDS = ["json", "jsonl", "csv", "tsv", "parquet"]
NARRATIVE_ENDS = ["md", "markdown", "txt", "rst", "adoc"]
CONFIG_TAGS = ["config", "yaml", "json", "toml", "ini"]
SPEC_PATHS, SPEC_NAMES = ["/spec", "/contract", "/openapi", "/schema"], ["openapi", "schema", "contract"]
OVERLAP_BOOST, MOST_BOOST = 0.08, 0.65
TAG_BOOST = [0.0, 0.03, 0.06, 0.09]
TRIMMED = "".join(c for c in map(chr, range(33, 127)) if not c.isalnum() and c not in "_-./:")


def tokens(query: str) -> list[str]:
    """Plain, then symbolic tokens of a query, as ``text.tokenize`` has them."""
    words = [w for w in (x.strip(TRIMMED) for x in query.split()) if w]
    plain = []
    for w in words:
        spaced, at = "", 0
        for i, c in enumerate(w):
            lower_up = i > 0 and w[i - 1].islower() and c.isupper()
            acronym = i > 1 and w[i - 2].isupper() and w[i - 1].isupper() and c.isupper() and i + 1 < len(w) and w[i + 1].islower()
            spaced += (" " if lower_up or acronym else "") + c
            at += 1
        plain += [x for x in re.split(r"[\W_]+", spaced.lower()) if x]
    return plain + [w.lower() for w in words if any(c.isalnum() for c in w)]


def intent(query: str, own: list[str]) -> str:
    """lexical, semantic or mixed, by symbols, digits and the number of tokens."""
    symbolic, digit = any(s in query for s in ("::", "/", ".", "_", "`")), any("0" <= c <= "9" for c in query)
    if (symbolic or digit) and len(own) <= 3:
        return "lexical"
    return "semantic" if len(own) >= 4 and not symbolic and not digit else "mixed"


def needs(own: list[str], kind: str) -> list[str]:
    return [n for n, words in NEED_WORDS.items() if set(own) & set(words) or (n == "code" and kind == "lexical")]


def document_class(context: Column, uri: Column, name: Column, tags: Column) -> Column:
    """A hit's class by its context, its tags, and last its path and ending."""
    low_uri, low_name = F.lower(uri), F.lower(name)
    given = F.get(F.filter(F.transform(F.filter(tags, lambda t: t.startswith("doc_class:")), lambda t: F.substring(t, 11, 64)), lambda c: c.isin(CLASSES)), F.lit(0))
    parser = F.lower(F.substring(F.get(F.filter(tags, lambda t: t.startswith("parser:")), F.lit(0)), 8, 64))
    ends = F.element_at(F.split(low_name, r"\."), -1)
    return (
        F.when(context == "memory", "memory").when(context == "skill", "skill").when((context == "session") | uri.startswith(D.SCHEME + "session/"), "session").when(given.isNotNull(), given)
        .when(parser.isin("json", "yaml", "toml"), "config").when(parser.isin("jsonl", "xml"), "data").when(parser == "markdown", "narrative")
        .when(F.exists(tags, lambda t: t.isin(CONFIG_TAGS)), "config").when(F.exists(tags, lambda t: t.startswith("mime:application/")), "data")
        .when(I.any_in(low_uri, SPEC_PATHS) | I.any_in(low_name, SPEC_NAMES), "spec").when(ends.isin(CODE_ENDS), "code").when(ends.isin(CONFIG_ENDS), "config")
        .when(ends.isin(DATA_ENDS), "data").when(ends.isin(NARRATIVE_ENDS), "narrative").otherwise("general")
    )


def boost(query: str, kind: Column, uri: Column, name: Column, tags: Column) -> Column:
    """The boost of a hit of class ``kind``: intent, needs, overlap of name or path, and of tags with the query; 0 to 0.65."""
    own = tokens(query)
    aim = intent(query, own)
    total = F.lit(0.0)
    for c, value in CLASS_BOOST[aim].items():
        total = total + F.when(kind == c, value).otherwise(0.0)
    for need in needs(own, aim):
        value, classes = NEED_BOOST[need]
        total = total + F.when(kind.isin(classes), value).otherwise(0.0)
    words = list(dict.fromkeys(own))
    total = total + F.when(I.any_in(F.lower(uri), words) | I.any_in(F.lower(name), words), OVERLAP_BOOST).otherwise(0.0)
    met = F.least(F.size(F.filter(tags, lambda t: F.lower(t).isin(words) if words else F.lit(False))), F.lit(3))
    total = total + F.get(F.array(*[F.lit(x) for x in TAG_BOOST]), met)
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(MOST_BOOST))


def rerank(hits: DataFrame, docs: DataFrame, query: str, k: int, mode: str = "doc-aware-v1") -> DataFrame:
    """The best ``k`` hits with their scores raised by what their documents are; any other mode leaves them as they are."""
    if mode.strip().lower() != "doc-aware-v1":
        return R.top(hits, k)
    own = docs.select("uri", "context_type", "name", "tags")
    both = hits.join(own, "uri")
    kind = document_class(F.col("context_type"), F.col("uri"), F.col("name"), F.col("tags"))
    new = F.greatest(F.col("score") * (1 + boost(query, kind, F.col("uri"), F.col("name"), F.col("tags"))), F.lit(0.0))
    return R.top(both.select(*[c for c in hits.columns if c != "score"], F.round(new, 6).alias("score"), kind.alias("doc_class")), max(1, k))


# Hints: short lists of one request


def normal_hint(text: str, most: int) -> str | None:
    return " ".join(text.split())[:most].rstrip() or None


def recent_hints(texts: list[str], limit: int) -> list[str]:
    """The newest messages first."""
    return texts[::-1][:limit]


def merge_hints(runtime: list[str], om: str | None, recent: list[str], total: int, keep_recent: int, most: int) -> list[str]:
    """One list of at most ``total`` distinct hints: with a memory hint some recent ones, it, runtime, the rest; else runtime, then recent."""
    kept = min(keep_recent, len(recent), max(total - 1, 0))
    line = [*recent[:kept], om, *runtime, *recent[kept:]] if om is not None else [*runtime, *recent]
    own = [h for h in (normal_hint(x, most) for x in line) if h]
    return list(dict.fromkeys(own))[:total]


def resolve_hints(msgs: DataFrame, activated: DataFrame, om: DataFrame, runtime: list[str], total: int = 4, keep_recent: int = 1, recent: int = 2, most: int = 240) -> DataFrame:
    """``(session_id, hints)``: what a search in each session adds to its query.

    ``om``: session_id, hint. Where a session has a memory hint, messages that
    it activated don't count as recent. The runtime hints are one request's.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("session_id").orderBy(F.desc("created_at"), F.desc("id"))
    hint = om.select("session_id", F.nullif(_clip(F.col("hint"), most), F.lit("")).alias("om"))
    rows = msgs.join(hint, "session_id", "left").join(activated.select("id", F.lit(True).alias("old")).distinct(), "id", "left").where("om is null or old is null")
    new = rows.withColumn("n", F.row_number().over(w)).where(F.col("n") <= recent).groupBy("session_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: _clip(x["text"], most)).alias("recent"))
    both = msgs.select("session_id").distinct().join(hint, "session_id", "left").join(new, "session_id", "left")
    own, own_run = F.coalesce("recent", F.array().cast("array<string>")), F.array(*[F.lit(x) for x in dict.fromkeys(h for h in (normal_hint(r, most) for r in runtime) if h)]).cast("array<string>")
    kept = F.least(F.lit(keep_recent), F.size(own), F.lit(max(total - 1, 0)))
    with_om = F.concat(F.slice(own, F.lit(1), kept), F.array("om"), own_run, F.slice(own, kept + 1, F.greatest(F.size(own) - kept, F.lit(0))))
    line = F.when(F.col("om").isNotNull(), with_om).otherwise(F.concat(own_run, own))
    return both.select("session_id", F.slice(F.array_distinct(F.filter(line, lambda x: x != "")), 1, total).alias("hints"))


def _clip(text: Column, most: int) -> Column:
    return T.clip_words(text, most)


# Notes


def notes(request: P.Request, plans: list[P.Plan]) -> list[str]:
    """What is said of a plan: fan-out, budgets, hints, filter."""
    nodes, depth = P.budget(request)
    out = ["drr", f"fanout:{len(plans)}", "fanout_priority_weighting:v1", f"budget_nodes:{nodes}", f"budget_depth:{depth}"]
    if request.session_hints or request.om_hints:
        out += [f"session_hints:{len(request.session_hints) + len(request.om_hints)}", f"session_om_hints:{len(request.om_hints)}"]
    if request.filter:
        out.append("filter")
    if request.max_ms is not None:
        out.append(f"budget_ms:{request.max_ms}")
    return out
