"""Fill-in-the-middle: texts cut into prefix, middle and suffix, and written anew around sentinels.

A text's units are found by a predicate on adjacent characters, which says
whether a unit starts between them: any two characters (``chars``), a space
before a word (``words``), a line's end before the next one (``lines``). A batch's
texts, as UTF-8, are decomposed into chunks of ``CHUNK`` bytes that overlap by the character
before them, so each chunk counts its boundaries by itself, all of them in one
vectorised pass. Prefix sums of the counts give each text's length in units and
route both cut ranks to the chunks that own them; only these are scanned again,
for the byte where the cut falls.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
PLAIN_PERCENT, SPM_PERCENT = 10, 20
#: Bytes of a chunk, and bytes whose boundaries are marked at a time.
CHUNK, WINDOW = 1 << 12, 1 << 22
#: Texts whose outputs are made together, in bytes.
SLICE = 1 << 25
UNITS = ("chars", "words", "lines")


def boundaries(data: np.ndarray, lo: int, hi: int, unit: str) -> np.ndarray:
    """Whether a unit starts at each byte of ``data[lo:hi]``, by the character before it and its own; the byte before ``lo`` is the overlap."""
    own = data[lo:hi]
    first = (own & 0xC0) != 0x80  # no continuation byte: a character starts
    if unit == "chars":
        return first
    before = np.empty_like(own)
    before[1:] = own[:-1]
    before[:1] = data[lo - 1] if lo else 0x0A
    if unit == "lines":
        return before == 0x0A
    space = lambda x: (x == 0x20) | ((x >= 0x09) & (x <= 0x0D))
    return first & space(before) & ~space(own)


class Cuts:
    """Unit counts of a batch of texts, and the bytes at which given ranks start."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, unit: str = "chars"):
        """``offsets`` has the texts' borders in ``data``, one more than there are texts."""
        self.data, self.offsets, self.unit = data, offsets, unit
        sizes = np.diff(offsets)
        chunks = -(-sizes // CHUNK)
        text = np.repeat(np.arange(len(sizes)), chunks)
        number = np.arange(len(text)) - np.repeat(np.cumsum(chunks) - chunks, chunks)
        self.starts = offsets[text] + number * CHUNK
        self.ends = np.minimum(self.starts + CHUNK, offsets[text + 1])
        self.heads = number == 0
        counts = self._counts()
        self.through = np.cumsum(counts)  # units of all chunks as far as each one
        self.units = np.bincount(text, weights=counts, minlength=len(sizes)).astype(np.int64)
        self.before = np.cumsum(self.units) - self.units  # units of all texts before each one

    def _mask(self, lo: int, hi: int, heads: np.ndarray) -> np.ndarray:
        mask = boundaries(self.data, lo, hi, self.unit)
        mask[heads - lo] = True  # a text's first byte starts a unit
        return mask

    def _counts(self) -> np.ndarray:
        out, step = np.zeros(len(self.starts), np.int64), max(1, WINDOW // CHUNK)
        for a in range(0, len(out), step):  # texts lie one behind the other, so chunks do
            b = min(len(out), a + step)
            lo, own = self.starts[a], self.starts[a:b]
            mask = self._mask(lo, self.ends[b - 1], own[self.heads[a:b]])
            out[a:b] = np.add.reduceat(mask, own - lo, dtype=np.int64)
        return out

    def at(self, text: int, rank: int) -> int:
        """Where in ``data`` a text's unit ``rank`` starts; its end for a rank behind the last one."""
        if rank >= self.units[text]:
            return int(self.offsets[text + 1])
        wanted = self.before[text] + rank
        owner = int(np.searchsorted(self.through, wanted, side="right"))
        lo, hi = int(self.starts[owner]), int(self.ends[owner])
        inside = wanted - (self.through[owner - 1] if owner else 0)
        return lo + int(np.flatnonzero(self._mask(lo, hi, np.array([lo] if self.heads[owner] else [], np.int64)))[inside])


def _bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """A column's UTF-8 bytes and the borders of its values; nulls are empty."""
    own = pc.fill_null(column.cast(pa.large_binary()), b"")
    _, offsets, data = own.buffers()
    borders = np.frombuffer(offsets, np.int64)[own.offset : own.offset + len(own) + 1] if len(own) else np.zeros(1, np.int64)
    return np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8), borders


def draws(digest: str) -> tuple[int, int, int, int]:
    """The numbers h1 to h4 of a hexadecimal digest: its first four groups of eight digits."""
    return tuple(int(digest[8 * i : 8 * i + 8], 16) for i in range(4))


def _slices(column: pa.Array) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``SLICE`` bytes, so that the outputs of a batch aren't all in memory beside it."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(column), 0))
    part = (np.cumsum(sizes) - sizes) // SLICE
    edges = np.flatnonzero(np.r_[True, part[1:] != part[:-1], True]) if len(sizes) else []
    yield from zip(edges[:-1], edges[1:])


def _transform(texts: pa.Array, digests: list[str], unit: str) -> list[tuple]:
    """(n, form, prefix units, middle units, output) of every text."""
    data, borders = _bytes(texts)
    cuts, raw, rows = Cuts(data, borders, unit), memoryview(data), []
    for i, digest in enumerate(digests):
        a, z, n = int(borders[i]), int(borders[i + 1]), int(cuts.units[i])
        h1, h2, h3, h4 = draws(digest)
        whole = bytes(raw[a:z])
        if not whole or any(s in whole for s in (PREFIX, SUFFIX, MIDDLE)) or h3 % 100 >= 100 - PLAIN_PERCENT:
            rows.append((n, "plain", None, None, whole))
            continue
        first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
        p, m = cuts.at(i, first), cuts.at(i, second)
        prefix, middle, suffix = (bytes(raw[x:y]) for x, y in ((a, p), (p, m), (m, z)))
        spm = h4 % 100 < SPM_PERCENT
        out = (SUFFIX + suffix + PREFIX + prefix if spm else PREFIX + prefix + SUFFIX + suffix) + MIDDLE + middle
        rows.append((n, "spm" if spm else "psm", first, second - first, out))
    return rows


def fill_in_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", unit: str = "chars") -> DataFrame:
    """The columns of ``docs`` with ``n``, ``form``, ``prefix_units``, ``middle_units`` and ``output`` behind them.

    Cuts and form follow from the SHA-256 of ``1:`` and the id, so reruns agree
    and rows of one id and text are treated alike; a null id counts as the empty text. ``n``
    is the text's number of units. A null or empty text, one that holds a sentinel, and a
    share of ``PLAIN_PERCENT`` are ``plain``: the text as it is (null: empty),
    without cuts (null). Of the others ``SPM_PERCENT`` put the suffix first
    (``spm``, else ``psm``). Very long texts are worked on chunk by chunk, and
    are in memory once beside their output. Columns of these names are
    replaced. An empty table gives no rows.
    """
    if unit not in UNITS:
        raise ValueError(f"unknown unit {unit}")
    added = ["n", "form", "prefix_units", "middle_units", "output"]
    kept = [c for c in docs.columns if c not in added or c in (id_col, text_col)]
    key = F.concat(F.lit("1:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    own = docs.select(*kept, F.sha2(key, 256).alias(fresh(docs, "digest")))
    at = kept.index(text_col)
    names = [f"{c}_" if c in added else c for c in kept]  # an id or a text of an added name makes way meanwhile

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in _slices(batch.column(at)):
                part = batch.slice(a, b - a)
                n, form, prefix, middle, out = zip(*_transform(part.column(at), part.column(len(kept)).to_pylist(), unit))
                made = [pa.array(n, pa.int64()), pa.array(form, pa.string()), pa.array(prefix, pa.int64()), pa.array(middle, pa.int64()), pa.array(out, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*part.columns[: len(kept)], *made], [*names, *added])

    schema = docs.select(*kept).toDF(*names).schema
    for name, kind in zip(added, ("long", "string", "long", "long", "string")):
        schema = schema.add(name, kind)
    return own.mapInArrow(run, schema)


def restored(output: Column, form: Column) -> Column:
    """The exact text, from an output and its form alone."""
    head = lambda c, mark: F.substring_index(c, mark.decode(), 1)
    tail = lambda c, part: F.substring(c, F.char_length(part) + 4, F.char_length(c))  # noqa: E731  behind the part and a sentinel

    def parts(second: bytes) -> tuple[Column, Column, Column]:
        rest = F.substring(output, F.lit(4), F.char_length(output))
        one = head(rest, second)
        behind = tail(rest, one)
        two = head(behind, MIDDLE)
        return one, two, tail(behind, two)

    prefix, suffix, middle = parts(SUFFIX)
    suffix2, prefix2, middle2 = parts(PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix2, middle2, suffix2)).otherwise(output)


def infill_digests(docs: DataFrame) -> DataFrame:
    """Lengths, forms, cuts and hashes of every text's output and of the text that is rebuilt from it.

    Null texts are empty, and plain. Null ids and repeated rows stay, an empty table gives
    no rows; other columns are ignored.
    """
    made = fill_in_middle(docs.select("doc_id", "text"))
    sha = lambda c: F.sha2(c.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.col("prefix_units").alias("prefix_chars"), F.col("middle_units").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )
