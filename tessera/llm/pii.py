"""Personal data by candidate gradient boosting, in Spark's own functions.

Base patterns give spans that always stay. Beside them, looser generators
propose spans (digit groups in telephone layouts, card numbers with other
separators, addresses spelt with "at" and "dot", long addresses of hosts), which may
overlap base spans and each other. Boosted trees judge every candidate, base
ones too, by features of its format and context. The trees are written out as
one SQL expression, so generators, features and scores all run in the JVM. A
calibrated threshold selects; a candidate inside a base span adds nothing, and
of two that overlap the better one stays.

Offsets come from splitting the text at the matches: both the pieces between
and the matches have lengths, and their running sum is where each match starts.
Running sums and sweeps go through ``scan``, in blocks, so that work is linear
in the number of matches.

The trees are trained once a process on sentences that a seeded generator
labels (``EXAMPLES`` of them); features are computed by the same expressions.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import FINDING, fresh, score_column, span_columns

KINDS = ["email", "ip", "card", "phone"]
#: A match: where it starts, itself, the text before it (up to ``CONTEXT``) and the character behind it.
MATCH = "struct<start:int,m:string,before:string,after:string>"
#: The base patterns, fixed values. Repeats are possessive where nothing they
#: could give back would help, and a run of characters is tried from its first
#: only (or from the end of the match before), which gives the same matches in
#: linear time and constant stack. Card numbers ask for the number of digits at
#: once: the plain pattern's matches are the longest runs, from where a run begins.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "phone": "+"}
#: Loose generators of further candidates.
LOOSE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++(?:\x20?[\[({<]\x20?(?i:at|@)\x20?[\])}>]\x20?|\x20(?i:at)\x20|\x20@\x20?|@\x20)[A-Za-z0-9-]++(?:(?:\x20?[\[({<]\x20?(?i:dot|\.)\x20?[\])}>]\x20?|\x20(?i:dot)\x20|\.)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9A-Za-z:.])(?:[0-9A-Fa-f]{1,4}:){2,7}(?::?[0-9A-Fa-f]{1,4})(?::[0-9A-Fa-f]{1,4}){0,5}(?![0-9A-Za-z:])",
    "card": r"(?<![0-9A-Za-z.])[0-9]{4}(?:[._/\x20:-][0-9]{4}){2}[._/\x20:-][0-9]{2,7}(?![0-9A-Za-z])|(?<![0-9A-Za-z.])[0-9]{4}[._/\x20:-][0-9]{6}[._/\x20:-][0-9]{5}(?![0-9A-Za-z])",
    "phone": r"(?<![0-9A-Za-z+.,/:-])(?:\([0-9]{2,5}\)[\x20.-]?[0-9]{2,8}|0[0-9]{1,12}|[0-9]{2,5})(?:[\x20./-]{1,2}[0-9]{2,8}){0,5}(?![0-9A-Za-z])",
}
#: Words that speak for a kind when they stand before a candidate.
HINTS = {
    "email": r"(?i)\b(?:e-?mails?|mail|contact|write|reach|kontakt|correo|courriel)\b",
    "ip": r"(?i)\b(?:ip|ipv6|address|host|server|client|gateway|adresse)\b",
    "card": r"(?i)\b(?:card|visa|credit|debit|mastercard|amex|cc|karte|tarjeta|carte|pan)\b",
    "phone": r"(?i)\b(?:tel|telefon|telephone|phones?|call|mobile|mob|fax|t[eé]l[eé]fono|t[eé]l|appelez|cell|dial|ring|whatsapp|sms|ph)\b",
}
AGAINST = r"(?i)\b(?:order|invoice|isbn|version|id|no|nr|part|serial|ref|page|lot|item|ticket|build|between|from|years?|room|code|sku|tracking|batch|release|model|case|date)\b"
FEATURES = [
    "kind", "length", "digits", "separators", "luhn", "brackets", "hint", "against", "before_alnum", "after_alnum", "digit_share", "distinct",
    "groups", "longest_group", "hex_letters", "spelt", "leading", "date", "equal_separators", "spaces",
]
CONTEXT = 32
EXAMPLES = 3600
TREES, DEPTH, RATE = 40, 4, 0.2
PRECISION = 0.97
#: Items that a sweep works on at a time.
BLOCK = 256


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once; a lambda would compute it again at each use."""
    return F.transform(F.array(value), body)[0]


def scan(items: Column, state: Column, kind: str, step: Callable[[Column, Column], tuple[Column, Column]]) -> Column:
    """A running state over an array: the outputs of ``step(state, item) -> (state, output)``, nulls left out.

    Appending to an array copies it, so outputs are gathered in blocks.
    """
    none = F.array().cast(f"array<{kind}>")

    def one(acc: Column, x: Column) -> Column:
        new, out = step(acc["s"], x)
        return F.struct(new.alias("s"), F.when(out.isNull(), acc["o"]).otherwise(F.concat(acc["o"], F.array(out))).alias("o"))

    def block(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, F.struct(acc["s"].alias("s"), none.alias("o")), one)
        return bound(done, lambda r: F.struct(r["s"].alias("s"), F.concat(acc["o"], F.array(r["o"])).alias("o")))

    def whole(own: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(own) - 1) / BLOCK).cast("int")), lambda b: F.slice(own, b * BLOCK + 1, BLOCK))
        start = F.struct(state.alias("s"), F.array().cast(f"array<array<{kind}>>").alias("o"))
        return F.when(F.size(own) > 0, F.flatten(F.aggregate(blocks, start, block, lambda acc: acc["o"]))).otherwise(none)

    return bound(items, whole)


def matches(text: Column, pattern: str, passes: Callable[[Column], Column] | None = None) -> Column:
    """The leftmost non-overlapping matches that pass, as ``MATCH``; starts are code points from 0."""

    def placed(cut: Column) -> Column:
        gaps, found = cut["gaps"], cut["found"]
        pairs = F.transform(found, lambda m, i: F.struct(gaps[i].alias("gap"), m.alias("m"), F.substring(gaps[i + 1], 1, 1).alias("after")))

        def step(at: Column, x: Column) -> tuple[Column, Column]:
            start = at + F.length(x["gap"])
            out = F.struct(start.alias("start"), x["m"].alias("m"), F.right(x["gap"], F.lit(CONTEXT)).alias("before"), x["after"].alias("after"))
            return start + F.length(x["m"]), out if passes is None else F.when(passes(x["m"]), out)

        return scan(pairs, F.lit(0), MATCH, step)

    cut = F.struct(F.split(text, pattern, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("found"))
    return F.when(F.regexp_like(text, F.lit(pattern)), bound(cut, placed)).otherwise(F.array().cast(f"array<{MATCH}>"))


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of at most 19 digits passes the check sum."""
    places = F.split(F.reverse(digits), "")

    def value(d: Column, i: Column) -> Column:
        n = d.try_cast("int")
        return F.when(i % 2 == 1, n * 2 - F.when(n > 4, 9).otherwise(0)).otherwise(n)

    total = F.aggregate(F.transform(places, value), F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0)))
    return total % 10 == 0


def _passes(kind: str, m: Column) -> Column:
    """The test that a base match must pass."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return F.regexp_like(m, F.lit(r"^0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$"))
    if kind == "phone":
        return F.length(digits_of(m)).between(10, 15)
    return luhn(digits_of(m))


def candidate_features(kind: str, x: Column) -> Column:
    """Format and context features of a candidate, an array in the order of ``FEATURES``."""
    m, before, after = x["m"], x["before"], x["after"]
    d = digits_of(m)
    groups = F.filter(F.split(m, "[^0-9]+"), lambda g: g != "")
    marks = F.regexp_replace(m, r"[^\x20.\-/_:]", "")
    flag = lambda c: c.cast("double")
    values = [
        F.lit(float(KINDS.index(kind))), F.length(m), F.length(d), F.length(marks),
        flag(F.when(F.length(d).between(13, 19), luhn(d)).otherwise(False)), flag(F.regexp_like(m, F.lit(r"[\[({<]"))),
        flag(F.regexp_like(before, F.lit(HINTS[kind]))), flag(F.regexp_like(before, F.lit(AGAINST))),
        flag(F.regexp_like(before, F.lit(r"[\p{L}\p{N}]$"))), flag(F.regexp_like(after, F.lit(r"[\p{L}\p{N}]"))),
        F.length(d) / F.length(m), F.size(F.array_distinct(F.split(d, ""))),
        F.size(groups), F.coalesce(F.array_max(F.transform(groups, lambda g: F.length(g))), F.lit(0)), F.length(F.regexp_replace(m, "[^A-Fa-f]", "")),
        flag(F.regexp_like(m, F.lit(r"(?i)[\x20\[({<]dot[\x20\])}>]"))), flag(F.regexp_like(m, F.lit(r"^(?:0|\(|\+)"))),
        flag(F.regexp_like(m, F.lit(r"^(?:(?:19|20)[0-9]{2}[./\x20-][0-9]{1,2}[./\x20-]|[0-9]{1,2}[./\x20-][0-9]{1,2}[./\x20-](?:19|20)?[0-9]{2}|(?:19|20)[0-9]{2}[./\x20-]+(?:19|20)[0-9]{2}(?![0-9]))"))),
        flag(F.size(F.array_distinct(F.split(marks, ""))) <= 1), F.length(F.regexp_replace(m, r"[^\x20]", "")),
    ]
    return F.array(*[v.cast("double") for v in values])


def _candidate(kind: str, base: bool, x: Column) -> Column:
    return F.struct(
        x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("rank"), (x["start"] + F.length(x["m"])).alias("end"),
        F.lit(kind).alias("kind"), F.lit(base).alias("base"), candidate_features(kind, x).alias("f"),
    )


def base_candidates(text: Column) -> Column:
    """All base findings of a text with their features."""
    parts = []
    for kind, pattern in BASE.items():
        found = matches(text, pattern, None if kind == "email" else partial(_passes, kind))
        if kind in NEEDS:
            found = F.when(F.contains(text, F.lit(NEEDS[kind])), found).otherwise(F.array().cast(f"array<{MATCH}>"))
        parts.append(F.transform(found, partial(_candidate, kind, True)))
    return F.concat(*parts)


def loose_candidates(text: Column) -> Column:
    """All candidates of the loose generators, with their features; digits are in all but spelt addresses."""
    parts = []
    digit = F.regexp_like(text, F.lit("[0-9]"))
    for kind, pattern in LOOSE.items():
        found = matches(text, pattern, (lambda m: F.length(digits_of(m)).between(7, 15)) if kind == "phone" else None)
        if kind != "email":
            found = F.when(digit, found).otherwise(F.array().cast(f"array<{MATCH}>"))
        parts.append(F.transform(found, partial(_candidate, kind, False)))
    return F.concat(*parts)


@dataclass
class Boosted:
    """Trees as nested (feature, threshold, below, above) with numbers at the leaves."""

    bias: float
    trees: list
    slope: float
    offset: float
    threshold: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.bias + sum(_walk(t, x) for t in self.trees)

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.margin(x) + self.offset)))

    def score(self, f: Column) -> Column:
        """The calibrated probability as a Spark expression over a feature array."""

        def at(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(float(tree))
            j, cut, low, high = tree
            return F.when(F.get(f, F.lit(j)) <= F.lit(cut), at(low)).otherwise(at(high))

        total = F.lit(self.bias)
        for tree in self.trees:
            total = total + at(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-(F.lit(self.slope) * total + F.lit(self.offset))))


def _walk(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), float(tree))
    j, cut, low, high = tree
    return np.where(x[:, j] <= cut, _walk(low, x), _walk(high, x))


def grow(x: np.ndarray, g: np.ndarray, h: np.ndarray, depth: int) -> object:
    """One regression tree on gradients and curvatures, by exact search over all cuts."""
    leaf = -RATE * g.sum() / (h.sum() + 1.0)
    if depth == 0 or len(g) < 20:
        return leaf
    best, found = 1e-6 + g.sum() ** 2 / (h.sum() + 1.0), None
    for j in range(x.shape[1]):
        order = np.argsort(x[:, j], kind="stable")
        v, gs, hs = x[order, j], np.cumsum(g[order]), np.cumsum(h[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if len(cuts):
            gain = gs[cuts] ** 2 / (hs[cuts] + 1.0) + (gs[-1] - gs[cuts]) ** 2 / (hs[-1] - hs[cuts] + 1.0)
            k = int(gain.argmax())
            if gain[k] > best:
                best, found = gain[k], (j, float((v[cuts[k]] + v[cuts[k] + 1]) / 2))
    if found is None:
        return leaf
    low = x[:, found[0]] <= found[1]
    return (*found, grow(x[low], g[low], h[low], depth - 1), grow(x[~low], g[~low], h[~low], depth - 1))


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Gradient boosting on the logistic loss; calibration and threshold on the last third."""
    cut = len(x) * 2 // 3
    rate = y[:cut].mean()
    out = Boosted(float(np.log(rate / (1 - rate))), [], 1.0, 0.0, 0.5)
    z = np.full(cut, out.bias)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        tree = grow(x[:cut], p - y[:cut], p * (1 - p), DEPTH)
        out.trees.append(tree)
        z += _walk(tree, x[:cut])
    zv, yv = out.margin(x[cut:]), y[cut:]
    ab = np.array([1.0, 0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(ab[0] * zv + ab[1], -40, 40)))
        w = p * (1 - p) + 1e-6
        grad = np.array([((p - yv) * zv).sum() + 0.1 * (ab[0] - 1), (p - yv).sum() + 0.1 * ab[1]])
        hess = np.array([[(w * zv * zv).sum() + 0.1, (w * zv).sum()], [(w * zv).sum(), w.sum() + 0.1]])
        ab = ab - np.linalg.solve(hess, grad)
    out.slope, out.offset = float(ab[0]), float(ab[1])
    p = out.probability(x[cut:])
    order = np.argsort(-p, kind="stable")
    right = np.cumsum(yv[order]) / np.arange(1, len(order) + 1)
    good = np.flatnonzero(right >= PRECISION)
    out.threshold = float(max(0.5, p[order[good[-1]]])) if len(good) else 1.0
    return out


def labelled(n: int = EXAMPLES, seed: int = 7) -> list[tuple[str, int, int, int, bool]]:
    """(text, kind's rank, start, end, whether personal) of seeded sentences with one planted span."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    lead = lambda k: str(rng.integers(1, 10)) + num(k - 1)
    word = lambda: "".join(pick(["th", "er", "on", "an", "re", "ti", "en", "le", "de", "ka", "mo"]) for _ in range(int(rng.integers(2, 4))))
    prose = lambda: " ".join(word() for _ in range(int(rng.integers(3, 6))))
    hexa = lambda k: "".join(pick(list("0123456789abcdef")) for _ in range(k))
    near = {
        "email": ["e-mail", "contact", "mail me:", "write to", "reach us:"], "ip": ["IP", "host", "server", "gateway"],
        "card": ["card", "Visa", "credit card", "cc:"], "phone": ["tel", "phone:", "call", "mobile", "fax", "dial", "Tel.:"],
    }
    far = ["order", "invoice no", "ISBN", "version", "part", "serial", "ref", "lot", "page", "between", "tracking", "date:", "build", "code"]

    def card() -> str:
        body = [int(c) for c in pick("3456") + num(14)]
        s = sum(d if i % 2 else (d * 2 - 9 if d > 4 else d * 2) for i, d in enumerate(body))
        return "".join(map(str, body)) + str(-s % 10)

    def grouped(s: str, by: str) -> str:
        return by.join(s[i : i + 4] for i in range(0, 16, 4))

    def personal(kind: str) -> str:
        if kind == "email":
            at, dot = pick([(" (at) ", " (dot) "), ("[at]", "[dot]"), (" at ", " dot "), ("(at)", "(dot)"), (" [at] ", "."), ("(at)", "."), (" AT ", " DOT "), ("{at}", "{dot}"), (" @ ", "."), ("@", ".")])
            return word() + pick(["", ".", "_"]) + pick([word(), num(2)]) + at + word() + dot + pick(["com", "org", "de", "net", "co.uk"])
        if kind == "ip":
            groups = [hexa(int(rng.integers(1, 5))) for _ in range(8)]
            cut = int(rng.integers(2, 6))
            return pick([":".join(hexa(4) for _ in range(8)), ":".join(groups), ":".join(groups[:cut]) + "::" + hexa(4), ".".join(str(int(rng.integers(1, 255))) for _ in range(4))])
        if kind == "card":
            return grouped(card(), pick([".", "_", "/", " ", "-", ":", ""]))
        a, b, c, d = lead(3), lead(3), num(4), num(4)
        return pick([f"({a}) {b}-{c}", f"({a}) {b} {c}", f"0{lead(3)} {d}{num(3)}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"0{lead(2)}/{d}{num(2)}", f"0{lead(1)} {num(2)} {num(2)} {num(2)} {num(2)}", f"0{lead(9)}", f"0{lead(3)}-{num(3)}-{num(3)}", f"00{lead(2)} {num(3)} {num(4)}", f"+{lead(2)} {num(3)} {num(3)} {num(3)}"])

    def other(kind: str) -> str:
        if kind == "email":
            return pick([f"{word()} at {word()}.{word().title()}", f"{word()} at {word()}.{word()}", f"{word()} at {num(1)}.{num(2)}", f"{word()} at {word()}.py"])
        if kind == "ip":
            return pick([":".join(num(2) for _ in range(int(rng.integers(3, 7)))), f"{num(2)}:{num(2)}:{num(2)}", ":".join(hexa(2) for _ in range(6)), ":".join(str(int(rng.integers(0, 60))) for _ in range(3))])
        if kind == "card":
            return grouped(num(16), pick([".", "_", "/", " ", ":"]))
        year = str(rng.integers(1900, 2030))
        return pick([f"{year}-{num(2)}-{num(2)}", f"{num(2)}.{num(2)}.{year}", f"{year} {num(2)} {num(2)}", f"{year}-{rng.integers(1900, 2030)}", f"978-{num(1)}-{num(4)}-{num(4)}", f"{num(2)}.{num(3)}.{num(4)}", f"{num(3)} {num(3)} {num(3)}", f"{num(2)} {num(2)} {num(2)} {num(2)}", f"{num(5)}-{num(5)}", f"{num(4)}/{num(4)}", f"{num(3)}-{num(2)}-{num(4)}", f"{lead(3)}-{lead(3)}-{num(4)}", f"{num(5)}.{num(4)}"])

    rows = []
    while len(rows) < n:
        kind, good = pick(KINDS), bool(rng.random() < 0.5)
        own = personal(kind) if good else other(kind)
        hint = pick(near[kind]) if good and rng.random() < 0.75 else pick(far) if not good and rng.random() < 0.6 else ""
        if good and kind == "phone" and not hint and not own.startswith(("(", "0", "+")):
            continue  # digit groups that nothing marks as a number to call
        text = f"{prose()} {hint} ".replace("  ", " ")
        rows.append((text + own + pick([" ", ". ", ", "]) + prose(), KINDS.index(kind), len(text), len(text) + len(own), good))
    return rows


@lru_cache(1)
def _model(app: str) -> Boosted:
    spark = SparkSession.getActiveSession()
    rows = labelled()
    df = spark.createDataFrame([(i, r[0]) for i, r in enumerate(rows)], "i int, text string")
    got = df.select("i", F.explode(F.concat(base_candidates(F.col("text")), loose_candidates(F.col("text")))).alias("c")).select("i", "c.start", "c.end", "c.rank", "c.f")
    x, y = [], []
    for r in got.orderBy("i", "rank", "start", "end").collect():
        _, rank, start, end, good = rows[r["i"]]
        x.append(r["f"])
        y.append(good and r["rank"] == rank and r["start"] < end and start < r["end"])
    return boost(np.array(x), np.array(y, dtype=float))


def model(spark: SparkSession) -> Boosted:
    """The trees, trained once a process from the fixed examples."""
    return _model(spark.sparkContext.applicationId)


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, findings)``: a sorted array of findings for every row.

    Offsets are code points of the whole text, end exclusive. Null texts are
    empty and have no findings. Null ids stay. Repeated rows give repeated rows, an
    empty table none; other columns are ignored. Of two candidates that overlap the
    one with the higher score stays, judged from left to right; ties go to
    the earlier start, then to the kind that is listed first.
    """
    spark = docs.sparkSession
    return docs.select(F.col(id_col), findings_of(F.coalesce(F.col(text_col), F.lit("")), model(spark)).alias("findings"))


def findings_of(text: Column, trees: Boosted) -> Column:
    """Base findings and selected candidates as one sorted array, all with their scores."""

    def scored(c: Column) -> Column:
        return F.struct(*[c[x].alias(x) for x in ("start", "rank", "end", "kind", "base")], trees.score(c["f"]).alias("score"))

    base = F.transform(base_candidates(text), scored)
    loose = F.filter(F.transform(loose_candidates(text), scored), lambda c: c["score"] >= trees.threshold)
    nobody = F.lit(None).cast(FINDING)

    def step(state: Column, x: Column) -> tuple[Column, Column]:
        """State: how far base findings reach, and the candidate that no better one has yet replaced."""
        reach, last = state["reach"], state["last"]
        inside, apart = reach >= x["end"], last.isNull() | (last["end"] <= x["start"])
        adds = ~x["base"] & ~inside
        new = F.when(x["base"], F.greatest(reach, x["end"])).otherwise(reach)
        keep = F.when(adds & (apart | (x["score"] > last["score"])), x).otherwise(last)
        return F.struct(new.alias("reach"), keep.alias("last")), F.when(adds & apart, last)

    def both(pair: Column) -> Column:
        # Base findings come first among equal starts. A last, far candidate makes the sweep hand over the one it holds.
        far = F.struct(F.lit((1 << 31) - 1).alias("start"), F.lit(0).alias("rank"), F.lit((1 << 31) - 1).alias("end"), F.lit("").alias("kind"), F.lit(False).alias("base"), F.lit(0.0).alias("score"))
        order = lambda c: F.struct(c["start"].alias("start"), (~c["base"]).alias("later"), c.alias("c"))
        line = F.transform(F.array_sort(F.transform(F.concat(pair["b"], pair["c"], F.array(far)), order)), lambda o: o["c"])
        start = F.struct(F.lit(-1).alias("reach"), nobody.alias("last"))
        return F.when(F.size(pair["c"]) == 0, F.array_sort(pair["b"])).otherwise(F.array_sort(F.concat(pair["b"], scan(line, start, FINDING, step))))

    return bound(F.struct(base.alias("b"), loose.alias("c")), both)


def personal_digests(docs: DataFrame) -> DataFrame:
    """Counts, the base spans' hash, all spans and their scores of every row."""
    found = F.col("findings")
    return find_personal_data(docs).select("doc_id", *span_columns(found, KINDS), score_column(found))


def redacted(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with every finding in the text replaced by its kind in brackets; all columns and rows stay.

    Overlapping findings become one replacement, named by the first. Texts without
    findings, and nulls, stay as they are. A block of findings is cut out of the
    text once, and its pieces out of that.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = fresh(docs, "found")

    def block(acc: Column, own: Column) -> Column:
        base = acc["at"]
        upto = F.greatest(base, F.array_max(F.transform(own, lambda f: f["end"])))

        def cut(part: Column) -> Column:
            def add(a: Column, f: Column) -> Column:
                gap = F.substring(part, a["at"] - base + 1, f["start"] - a["at"])
                out = F.concat(a["out"], F.array(F.concat(gap, F.lit("["), f["kind"], F.lit("]"))))
                return F.struct(F.greatest(a["at"], f["end"]).alias("at"), F.when(f["start"] >= a["at"], out).otherwise(a["out"]).alias("out"))

            done = F.aggregate(own, F.struct(base.alias("at"), F.array().cast("array<string>").alias("out")), add)
            return bound(done, lambda r: F.struct(r["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(r["out"], ""))).alias("out")))

        return bound(F.substring(text, base + 1, upto - base), cut)

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(found) - 1) / BLOCK).cast("int")), lambda b: F.slice(found, b * BLOCK + 1, BLOCK))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out"))
    cut = F.aggregate(blocks, start, block, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, a["at"] + 1, F.length(text))))
    new = F.when(F.size(found) > 0, cut).otherwise(F.col(text_col))
    return docs.withColumn(found, findings_of(text, model(docs.sparkSession))).select(*[new.alias(c) if c == text_col else docs[c] for c in docs.columns])
