"""Text functions as column expressions: tokens, keys, similarities, signals.

Everything here is built from Spark's own functions, so it stays in the JVM and
can be pushed down and folded by Catalyst.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation that is trimmed from token ends; ``_-./:`` stay. A fixed value.
TRIMMED = r"[!\"#$%&'()*+,;<=>?@\[\\\]^`{|}~]"
#: Synonym groups by their canonical word. Fixed values.
SYNONYMS = {
    "identity": ["auth", "oauth", "authenticate", "authentication", "authorize", "authorization", "login", "signin", "credential", "token"],
    "storage": ["storage", "store", "cache", "cached", "database", "db", "persist", "persistence"],
    "failure": ["error", "errors", "failure", "fail", "failed", "panic", "incident"],
    "performance": ["latency", "throughput", "performance", "slow", "fast"],
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def split_white(text: Column) -> Column:
    return F.filter(F.split(text, r"(?U)\s+"), lambda x: x != "")


def trim_token(token: Column) -> Column:
    return F.regexp_replace(token, f"^{TRIMMED}+|{TRIMMED}+$", "")


def split_identifier(token: Column) -> Column:
    """Lower-case parts of an identifier: at non-alphanumerics, lower-to-upper and acronym borders, which all lie at an upper-case letter."""
    return alnum_words(F.regexp_replace(token, r"(?=\p{Lu})(?:(?<=\p{Lu}\p{Lu})(?=\p{Lu}\p{Ll})|(?<=\p{Ll}))", " "))


def plain_tokens(text: Column) -> Column:
    """The parts of all tokens; white space and what is trimmed split a text like any other non-alphanumeric, so it is cut whole."""
    return split_identifier(text)


def symbolic_tokens(text: Column) -> Column:
    """Lower-case trimmed tokens that hold a letter or digit; ends are trimmed in the whole text, before it is split."""
    trimmed = F.regexp_replace(text, rf"(?U)(?={TRIMMED})(?:(?<!\S){TRIMMED}++|(?<!{TRIMMED}){TRIMMED}++(?!\S))", "")
    return F.transform(F.filter(F.split(trimmed, r"(?U)\s+"), lambda t: t.rlike(r"[\p{L}\p{N}]")), F.lower)


def tokenize(text: Column) -> Column:
    """Plain tokens, then symbolic ones: a plain lower-case word counts twice."""
    return F.concat(plain_tokens(text), symbolic_tokens(text))


def counts(words: Column) -> Column:
    """``(term, tf)`` of each distinct word: runs of the sorted array, so a text's words are counted in its own row."""

    def runs(own: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(own)), lambda i: (i < F.size(own)) & ((i == 0) | (F.get(own, i) != F.get(own, i - 1))))
        return let(at, lambda starts: F.transform(starts, lambda i, n: F.struct(F.get(own, i).alias("term"), (F.coalesce(F.get(starts, n + 1), F.size(own)) - i).alias("tf"))))

    return let(F.sort_array(words), runs)


def keywords(text: Column) -> Column:
    """Ordered distinct lower-case alphanumeric words."""
    return F.array_distinct(alnum_words(text))


def alnum_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def query_terms(text: Column) -> Column:
    """Alphanumeric terms of two bytes or more, repeats kept."""
    return F.filter(alnum_words(text), lambda x: F.octet_length(x) >= 2)


def message_relevance(text: Column, terms: Column) -> Column:
    """How many of the terms the text contains."""
    low = F.lower(text)
    return F.size(F.filter(terms, lambda t: F.contains(low, t)))


def stem_suffix(token: Column) -> Column:
    """Strip the first of ing, ed, es, s from tokens over four bytes if three bytes stay."""
    n = F.octet_length(token)
    out = token
    for suffix in ("s", "es", "ed", "ing"):  # the last one written is tried first
        ok = token.endswith(suffix) & (n > 4) & (n - len(suffix) >= 3)
        out = F.when(ok, F.substring(token, F.lit(1), F.length(token) - len(suffix))).otherwise(out)
    return out


def canonical_token(token: Column) -> Column:
    """The stem of a token's synonym group, or of the token."""
    own = F.trim(token)
    for name, words in SYNONYMS.items():
        own = F.when(F.trim(token).isin(words), name).otherwise(own)
    return stem_suffix(own)


def char_ngrams(token: Column, n: int) -> Column:
    size = F.length(token)
    return F.when(size <= n, F.array(token)).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(size - n + 1, F.lit(1))), lambda i: F.substring(token, i, F.lit(n))))


def compact_key(text: Column) -> Column:
    return F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", ""))


def bigrams(compact: Column) -> Column:
    """Sorted multiset of the character pairs of a compact key."""
    size = F.length(compact)
    pairs = F.transform(F.sequence(F.lit(1), F.greatest(size - 1, F.lit(1))), lambda i: F.substring(compact, i, F.lit(2)))
    return F.when(size < 2, F.array().cast("array<string>")).otherwise(F.array_sort(pairs))


def dice(a: Column, b: Column) -> Column:
    """Twice the multiset intersection of two arrays over the sum of their sizes."""

    def count(xs: Column, x: Column) -> Column:
        return F.size(F.filter(xs, lambda y: y == x))

    shared = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda acc, x: acc + F.least(count(a, x), count(b, x)))
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(0.0)).otherwise(2.0 * shared / total)


def edit_distance_one(a: Column, b: Column) -> Column:
    """Levenshtein distance of at most 1, or one swap of neighbours."""
    n = F.length(a)
    differ = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substring(a, i, F.lit(1)) != F.substring(b, i, F.lit(1)))
    i, j = F.get(differ, F.lit(0)), F.get(differ, F.lit(1))
    at = lambda s, k: F.substring(s, k, F.lit(1))
    swap = (n == F.length(b)) & (F.size(differ) == 2) & (j == i + 1) & (at(a, i) == at(b, j)) & (at(a, j) == at(b, i))
    edits = let(F.levenshtein(a, b), lambda d: (d <= 1) | ((d == 2) & F.coalesce(swap, F.lit(False))))  # a swap is two edits
    return F.when(F.abs(n - F.length(b)) > 1, False).otherwise(edits)


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clip_words(text: Column, limit: int) -> Column:
    """White space collapsed, cut at ``limit`` characters, without a blank at the end."""
    return F.rtrim(F.substring(collapse(text), 1, limit))


def estimate_tokens(text: Column) -> Column:
    return F.ceil(F.length(text) / 4).cast("long")


def lines(text: Column) -> Column:
    return F.split(text, r"\r?\n")


def head_tail(keys: Column, limit: int) -> Column:
    """The first half (rounded up) and the last half of distinct keys, in order."""
    head, tail = (limit + 1) // 2, limit // 2

    def ends(d: Column) -> Column:
        start = F.greatest(F.size(d) - tail + 1, F.lit(head + 1))
        return F.when(F.size(d) <= limit, d).otherwise(F.concat(F.slice(d, 1, head), F.slice(d, start, F.lit(tail))))

    return let(F.array_distinct(keys), ends)


def content_lines(text: Column, limit: int = 64) -> Column:
    """Collapsed lower-case lines of three bytes or more, head and tail."""
    low = F.filter(F.transform(lines(text), lambda x: F.lower(collapse(x))), lambda x: F.octet_length(x) >= 3)
    return head_tail(low, limit)


def headings(text: Column, limit: int = 24) -> Column:
    """Lower-case Markdown headings outside code fences, head and tail."""
    parts = F.split(text, r"(?m)^[ \t]*(?:```|~~~).*$", -1)
    plain = F.array_join(F.filter(parts, lambda _, i: i % 2 == 0), "\n")
    title = lambda x: F.lower(F.trim(F.regexp_replace(F.regexp_extract(F.trim(x), r"^#{1,6}\s+(.*)$", 1), r"#+\s*$", "")))
    return head_tail(F.filter(F.transform(lines(plain), title), lambda x: x != ""), limit)


def basename(uri: Column) -> Column:
    return F.element_at(F.split(uri, "/"), -1)


def stem_of(name: Column) -> Column:
    return F.regexp_replace(name, r"\.[^.]*$", "")


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def language_profile(text: Column) -> Column:
    return (
        F.when(text.rlike(r"[가-힣ᄀ-ᇿ㄰-㆏]"), "hangul")
        .when(text.rlike(r"[぀-ヿ]"), "kana")
        .when(text.rlike(r"[一-鿿]"), "han")
        .otherwise("other")
    )


def escape_xml(text: Column) -> Column:
    out = F.replace(text, F.lit("&"), F.lit("&amp;"))
    for a, b in (("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&apos;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def unescape_xml(text: Column) -> Column:
    out = text
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&amp;", "&")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def is_identifier_query(query: str) -> bool:
    """No white space and six or more alphanumerics."""
    return not any(c.isspace() for c in query) and sum(c.isalnum() for c in query) >= 6
