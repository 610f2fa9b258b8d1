"""File sources: tolerant JSON lines, structured documents, listings, globs."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLIP = 240


def read_jsonl_tolerant(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, one row with counts of good and bad lines and the first bad one). Bad lines are kept apart, not raised."""
    full = f"{schema}, _bad string"
    raw = spark.read.schema(full).json(path, mode="PERMISSIVE", columnNameOfCorruptRecord="_bad")
    report = raw.agg(F.count_if(F.col("_bad").isNull()).alias("good"), F.count_if(F.col("_bad").isNotNull()).alias("bad"), F.first("_bad", ignorenulls=True).alias("first_bad"), F.count(raw.columns[0]).alias("with_first_field"))
    return raw.where("_bad is null").drop("_bad"), report


def glob_regex(pattern: str) -> str:
    """A path glob as a regular expression: ``*`` within a segment, ``**`` across, ``?`` one character."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def glob(docs: DataFrame, base: str, pattern: str) -> DataFrame:
    """Documents below ``base`` whose relative path matches."""
    inside = docs.where(F.startswith("uri", F.lit(base + "/")))
    return inside.where(F.substring("uri", F.lit(len(base) + 2), F.length("uri")).rlike(glob_regex(pattern)))


def listing(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, size, modified) of the files below a folder, without their content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(path)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))


def flatten_json(value: object, path: str = "$") -> Iterator[tuple[str, str]]:
    """(path, scalar) pairs, keys sorted; empty containers show as such, scalars are collapsed and clipped."""
    if isinstance(value, dict) and value:
        for k in sorted(value):
            yield from flatten_json(value[k], f"{path}.{k}")
    elif isinstance(value, list) and value:
        for i, x in enumerate(value):
            yield from flatten_json(x, f"{path}[{i}]")
    else:
        text = value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
        yield path, " ".join(text.split())[:CLIP]


def flatten_xml(text: str) -> Iterator[tuple[str, str]]:
    """(/a/b, text) and (/a/@k, value) pairs of markup, which needn't be well formed."""
    stack: list[str] = []
    for m in re.finditer(r"<!--.*?-->|<[!?][^>]*>|<(/?)([A-Za-z][\w:.-]*)([^>]*?)(/?)>|([^<]+)", text, re.S):
        close, name, attrs, alone, body = m.groups()
        if name:
            if close:
                if name in stack:
                    while stack and stack.pop() != name:
                        pass
                continue
            stack.append(name)
            for k, v in re.findall(r'([\w:.-]+)\s*=\s*"([^"]*)"', attrs or ""):
                yield "/" + "/".join(stack) + f"/@{k}", v
            if alone or name.lower() in ("br", "img", "hr", "meta", "link", "input"):
                stack.pop()
        elif body and body.strip():
            yield "/" + "/".join(stack), " ".join(body.split())[:CLIP]


def flatten_documents(docs: DataFrame, id_col: str, text_col: str, kind: str = "json") -> DataFrame:
    """(id, path, value) rows of structured texts, in Arrow batches; texts that can't be read give one row ``$raw``."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, t in zip(pdf["id"], pdf["t"]):
                try:
                    pairs = list(flatten_json(json.loads(t)) if kind == "json" else flatten_xml(t))
                except (TypeError, ValueError):
                    pairs = [("$raw", " ".join((t or "").split())[:CLIP])]
                out += [(i, p, v) for p, v in pairs]
            yield pd.DataFrame(out, columns=["id", "path", "value"])

    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return own.mapInPandas(run, f"id {docs.schema[id_col].dataType.simpleString()}, path string, value string")
