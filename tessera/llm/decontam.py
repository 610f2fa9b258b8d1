"""Benchmark decontamination by pigeonhole edit matching.

A test item of L bytes has an error budget of k = floor(L x RATE) edits, or none
if it has fewer than ``MIN_BYTES``: it then has to occur as whole words. It is
split into k + 1 pieces; where the item occurs with at most k edits, one piece
at least is untouched. An automaton over the pieces of all items reads each
text once; every exact piece hit names a window in which the item would lie,
and Myers' bit-parallel distance verifies the window. It is verified upwards:
of n pieces with fewer than n edits, one half has fewer edits than pieces, so a
true hit holds in its pair of pieces, in that pair's pair, and so on up to the
item, and a chance hit mostly fails in the first, short, comparison.

The items are the benchmark table, which doesn't grow with the corpus. They are
collected under a checked bound (``MAX_ITEM_BYTES``); a larger benchmark is
worked through in slices of that bound, each by a pass over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.pandas.types import to_arrow_type

from .common import stored

RATE = 0.1
#: Items with fewer bytes after folding have no error budget: they are found as whole words.
MIN_BYTES = 40
MAX_ITEM_BYTES = 32 << 20
#: Parts of items whose bit patterns a worker keeps.
PATTERNS = 1 << 16
#: ASCII letters become lower case, other ASCII but digits becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 else 32 for c in range(256))


def fold(text: str | None) -> bytes:
    """Lower case words of letters and digits, one space between them."""
    return b" ".join((text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split())


def pieces(item: bytes, rate: float = RATE) -> list[tuple[int, bytes]]:
    """(offset, piece) of the error budget + 1 pieces."""
    n = int(len(item) * rate) + 1
    cuts = [i * len(item) // n for i in range(n + 1)]
    return [(a, item[a:b]) for a, b in zip(cuts, cuts[1:])]


class Pattern:
    """Myers' distance of one item against windows of text, any start and end."""

    def __init__(self, item: bytes):
        self.m, self.mask, self.top = len(item), (1 << len(item)) - 1, 1 << (len(item) - 1)
        self.peq: dict[int, int] = {}
        for i, c in enumerate(item):
            self.peq[c] = self.peq.get(c, 0) | 1 << i

    def best(self, window: bytes) -> tuple[int, int]:
        """(least distance of the item to a part of the window, where that part first ends)."""
        pv, mv, score, mask, top = self.mask, 0, self.m, self.mask, self.top
        get, low, end = self.peq.get, self.m, 0
        for j, c in enumerate(window):
            eq = get(c, 0)
            xv = eq | mv
            xh = (((eq & pv) + pv) ^ pv) | eq
            ph = mv | ~(xh | pv) & mask
            mh = pv & xh
            if ph & top:
                score += 1
            elif mh & top:
                score -= 1
            if score < low:
                low, end = score, j + 1
            ph, mh = ph << 1 & mask, mh << 1 & mask
            pv, mv = mh | ~(xv | ph) & mask, ph & xv
        return low, end


def ladder(n: int) -> list[list[tuple[int, int]]]:
    """For each of n pieces the ranges of pieces above it, from its pair to all."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]

    def halve(a: int, b: int) -> None:
        if b - a > 1:
            halve(a, (a + b) // 2)
            halve((a + b) // 2, b)
            for i in range(a, b):
                out[i].append((a, b))

    halve(0, n)
    return out


class Matcher:
    """Finds all items in texts: long ones within their error budget, short ones exactly, at word borders."""

    def __init__(self, items: list[tuple[object, bytes]], rate: float = RATE):
        self.items = items
        self.starts: list[list[int]] = []
        self.ladders: dict[int, list[list[tuple[int, int]]]] = {}
        self.pattern: dict[bytes, Pattern] = {}
        found: dict[str, list[tuple[int, int]]] = {}
        for k, (_, item) in enumerate(items):
            own = pieces(item, rate if len(item) >= MIN_BYTES else 0)
            self.starts.append([at for at, _ in own] + [len(item)])
            self.ladders.setdefault(len(own), ladder(len(own)))
            for i, (_, piece) in enumerate(own):
                found.setdefault(piece.decode("latin-1"), []).append((k, i))
        self.auto = ahocorasick.Automaton()
        for piece, where in found.items():
            self.auto.add_word(piece, (len(piece), where))
        self.auto.make_automaton()

    def _verify(self, t: bytes, k: int, i: int, at: int, known: dict[tuple[bytes, int], int]) -> int | None:
        """Least distance of item k around piece i at a place of the text; None if over its budget.

        ``known`` has the distances found around this place, for items that
        begin with the same parts.
        """
        starts, item = self.starts[k], self.items[k][1]
        n = len(starts) - 1
        zero = at - starts[i]  # where the item would start without edits
        if len(item) < MIN_BYTES:  # the piece is the item
            stop = at + len(item)
            return 0 if (at == 0 or t[at - 1] == 32) and (stop == len(t) or t[stop] == 32) else None
        if zero >= 0 and t[zero : zero + len(item)] == item:
            return 0
        d = 0
        for a, b in self.ladders[n][i]:
            budget = b - a - 1
            part, lo = item[starts[a] : starts[b]], zero + starts[a] - budget
            d = known.get((part, lo))
            if d is None:
                p = self.pattern.get(part)
                if p is None:
                    if len(self.pattern) >= PATTERNS:
                        self.pattern.clear()
                    p = self.pattern[part] = Pattern(part)
                d, _ = p.best(t[max(0, lo) : max(0, zero + starts[b] + budget)])
                known[part, lo] = d
            if d > budget:
                return None
        return d

    def find(self, text: str | None, first: bool = False) -> list[tuple[int, int]]:
        """(item's number, least distance) of every item within its budget; with ``first``, of one."""
        t = fold(text)
        if not t or not self.items:
            return []
        out: dict[int, int] = {}
        for end, (n, where) in self.auto.iter(t.decode("latin-1")):
            known: dict[tuple[bytes, int], int] = {}
            for k, i in where:
                if out.get(k) == 0:
                    continue
                d = self._verify(t, k, i, end + 1 - n, known)
                if d is not None:
                    out[k] = min(d, out.get(k, d))
                    if first:
                        return [(k, d)]
        return sorted(out.items())


def load_items(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[list[tuple[object, bytes]]]:
    """Folded items in slices of at most ``MAX_ITEM_BYTES``; repeated items count once; null ones and those without a letter or digit go."""
    size, own = 0, []
    rows = benchmark.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where("t is not null and i is not null").distinct().orderBy("i", "t")
    for row in rows.toLocalIterator():
        item = fold(row.t)
        if not item:
            continue
        if own and size + len(item) > MAX_ITEM_BYTES:
            yield own
            size, own = 0, []
        own.append((row.i, item))
        size += len(item)
    yield own


def contaminated(docs: DataFrame, benchmark: DataFrame, rate: float = RATE) -> DataFrame:
    """``(doc_id, item_id, distance)``: every item that a text holds within its error budget.

    Texts and items are compared as lower case letters and digits, so case,
    punctuation and white space don't count; texts are read whole. Null and
    empty texts match nothing; a null item or id, or an item without a letter
    or digit, is no item. An item under ``MIN_BYTES`` matches without edits,
    as whole words. An item that a text holds several times is one
    row with its least distance, and so are repeated items; a repeated document row repeats its matches.
    Distances count bytes of the folded UTF-8, for budgets and edits alike.
    Other columns are ignored; an empty table on either side gives no rows.
    """
    spark, out, before = docs.sparkSession, None, None
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType
    schema = f"doc_id {kinds[0]}, item_id {kinds[1].simpleString()}, distance int"
    kind = to_arrow_type(kinds[1])
    for items in load_items(benchmark):
        if before is not None:  # one slice at a time is broadcast
            out = stored(out, "decontam-found")
            before.destroy()
        before = sent = spark.sparkContext.broadcast(items)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            matcher = Matcher(sent.value, rate)
            for batch in batches:
                at, ids, far = [], [], []
                for i, t in enumerate(batch.column(1)):
                    for k, d in matcher.find(t.as_py()):
                        at.append(i), ids.append(matcher.items[k][0]), far.append(d)
                if at:
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(ids, kind), pa.array(far, pa.int32())], ["doc_id", "item_id", "distance"])

        part = docs.select("doc_id", "text").mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item; all columns stay.

    Each row is judged by its own text, whatever its id; a null or empty text
    holds nothing. The texts stay where they are: no join, no shuffle.
    """
    spark, out, before = docs.sparkSession, docs, None
    for items in load_items(benchmark):
        if before is not None:
            out = stored(out, "decontam-clean")
            before.destroy()
        before = sent = spark.sparkContext.broadcast(items)
        out = out.where(_clean(sent)("text"))
    return out


def _clean(sent: Broadcast):
    """Whether a text holds none of these items, as a function of a column."""

    @arrow_udf("boolean")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = Matcher(sent.value)
        for t in texts:
            yield pa.array([not matcher.find(x.as_py(), first=True) for x in t], pa.bool_())

    return clean
