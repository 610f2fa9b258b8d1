"""Scores as column expressions: BM25, blends, vectors, recency, paths, percentiles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def rounded(x: Column, places: int) -> Column:
    """A double at so many places, halves away from zero, decided on the scaled double: a value just under a half that scaling takes to it goes up, as in SQL engines that scale.

    A negative value that goes to zero is minus zero, as there; Spark's own rounding loses the sign.
    """
    whole = F.round(x * 10.0**places, 0)
    return F.when(whole == 0, x * 0.0).otherwise(whole / 10.0**places)


def idf(n: Column, df: Column) -> Column:
    return F.greatest(F.log1p((n - df + 0.5) / (df + 0.5)), F.lit(0.0))


def bm25_term(tf: Column, doc_len: Column, avg_len: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * doc_len / avg_len))


def lexical(bm25: Column, jaccard: Column, literal: Column) -> Column:
    """The blend of BM25 (saturated), token overlap and literal containment, in 0 to 1."""
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), 0.65 * bm25 / (bm25 + 2) + 0.25 * jaccard + 0.10 * literal))


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision; the shorter length counts."""
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda acc, x: acc + F.coalesce(x, F.lit(0.0)))


def cosine(a: Column, b: Column) -> Column:
    """Full cosine; 0 where a norm is zero."""
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm == 0, F.lit(0.0)).otherwise(dot(a, b) / norm)


def recency(updated: Column, as_of: Column) -> Column:
    """1 / (1 + whole days / 30), never over 1."""
    days = F.floor((F.unix_timestamp(as_of) - F.unix_timestamp(updated)) / 86400)
    return 1.0 / (1.0 + F.greatest(days, F.lit(0)) / 30.0)


def exact_bonus(exact: Column) -> Column:
    return F.when(exact >= 0.90, 0.35).when(exact >= 0.82, 0.22).when(exact >= 0.70, 0.10).otherwise(0.0)


def blended(exact: Column, dense: Column, sparse: Column, recent: Column, path: Column) -> Column:
    """The final ranking score; not clamped."""
    return exact_bonus(exact) + 0.42 * exact + 0.20 * F.pow(exact, F.lit(3)) + 0.33 * dense + 0.20 * sparse + 0.03 * recent + 0.02 * path


def under(uri: Column, prefix: str | Column) -> Column:
    """Segment-wise prefix test: equal, or followed by a slash."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    return (uri == p) | F.startswith(uri, F.concat(p, F.lit("/")))


def path_score(uri: Column, target: str | None) -> Column:
    """1 at the target, 0.8 below it; 0 elsewhere and without a target."""
    if target is None:
        return F.lit(0.0)
    return F.when(uri == target, 1.0).when(under(uri, target), 0.8).otherwise(0.0)


def rounded_rank(values: Column, basis_points: int) -> Column:
    """Percentile by rounded rank of an array: ((n - 1) * bp + 5000) div 10000."""
    own = F.sort_array(values)
    at = F.floor(((F.size(own) - 1) * basis_points + 5000) / 10000).cast("int")
    return F.when(F.size(own) == 0, F.lit(None)).otherwise(F.get(own, at))


def safe_ratio(a: Column, b: Column) -> Column:
    return F.when(b == 0, F.lit(0.0)).otherwise(a / b)


def backoff_seconds(attempt: Column, most: int = 60) -> Column:
    """min(2 ** min(attempt - 1, 6), most), without jitter."""
    steps = F.least(F.greatest(attempt - 1, F.lit(0)), F.lit(6))
    return F.least(F.pow(F.lit(2), steps).cast("long"), F.lit(most).cast("long"))


def embedding_from_json(text: Column) -> Column:
    """The vector in a model's reply, under ``embedding`` or the first of ``data``; null if it is empty or not all finite numbers."""
    v = F.try_parse_json(text)
    own = F.coalesce(F.try_variant_get(v, "$.embedding", "array<double>"), F.try_variant_get(v, "$.data[0].embedding", "array<double>"))
    bad = F.exists(own, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when((F.size(own) > 0) & ~bad, F.transform(own, lambda x: x.cast("float")))


def content_from_json(text: Column) -> Column:
    """The answer in a model's reply: message.content, the first choice's, or response."""
    v = F.try_parse_json(text)
    paths = ("$.message.content", "$.choices[0].message.content", "$.response")
    is_text = lambda p: F.schema_of_variant(F.try_variant_get(v, p, "variant")) == "STRING"
    return F.coalesce(*[F.when(is_text(p), F.try_variant_get(v, p, "string")) for p in paths])


def json_fragment(text: Column) -> Column:
    """What lies between the first opening and the last closing bracket or brace; null without both."""
    found = F.regexp_extract(text, r"(?s)^[^{\[]*([{\[].*[}\]])[^}\]]*$", 1)
    return F.nullif(found, F.lit(""))


def whole_number(text: Column) -> Column:
    """A JSON number as a count from 0 to 2^32 - 1, rounded; null for anything else."""
    v = F.try_variant_get(F.try_parse_json(text), "$", "double")
    number = F.trim(text).rlike(r"^-?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?$")
    return F.when(number, F.least(F.greatest(F.round(v), F.lit(0.0)), F.lit(4294967295.0)).cast("long"))
