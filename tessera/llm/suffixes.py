"""Removal of repeated byte strings by longest-previous-factor arrays.

A byte is repeated if it lies in a string of ``WIDTH`` bytes that also starts
somewhere else, in the same text or another. Either all of them go, or the first
occurrence of each string stays. A suffix array over the whole corpus doesn't
fit a task, so anchors (see ``windows``) bring together the strings that could
be equal, and each meeting is settled by itself:

1. Every text is cut into stretches of windows with one anchor. Anchors that
   occur once can't hold a repeat; their stretches are dropped.
2. Stretches with equal anchors and equal hashes of all bytes (128 bits
   together) are of one kind. Long repeats consist of such stretches, but for
   their two ends.
3. Where several kinds share an anchor, one stretch of each is gathered with
   its bytes. The suffixes of such a group are sorted (ranks by doubling, up to
   WIDTH bytes), and the longest-previous-factor array tells which windows have
   an earlier equal: it comes from the previous and the next smaller position
   in suffix order.
4. Groups of over ``DENSE`` kinds aren't gathered. Their stretches are cut into
   pieces of ``PIECE`` windows, counted by 128-bit hash from the anchor's place on, so
   steps 2 and 3 repeat on a smaller scale; what still differs is counted
   window by window. No task has to hold such a group.

Equal texts are one key with a count, so a text that makes up a third of the
rows costs its own size once after the first pass. Texts travel compressed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf
from pyspark.sql.types import BinaryType

from .common import stored
from .windows import WIDTH, stretches

#: Kinds of stretches up to which an anchor's group is sorted in one task.
DENSE = 64
#: Windows of a piece, into which the stretches of larger groups are cut.
PIECE = 16
#: An anchor with over a HOT-th of all stretches is dealt over SALTS tasks.
HOT, SALTS = 64, 64
#: Bytes of groups that are sorted together.
BATCH = 1 << 20
#: A text's key: 80 bits of hash.
KEY = ["k1", "kk"]


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    kk = F.xxhash64(F.lit(2), text).bitwiseAND(F.lit(0xFFFF)).cast("int")
    return docs.select(F.col(id_col).alias("id"), F.xxhash64(F.lit(1), text).alias("k1"), kk.alias("kk"), text.alias("t"))


@arrow_udf(BinaryType())
def _zip(texts: pa.Array) -> pa.Array:
    codec = pa.Codec("zstd", compression_level=1)
    return pa.array([codec.compress(t.as_buffer() or b"", asbytes=True) for t in texts], pa.binary())


def _light(keyed: DataFrame) -> DataFrame:
    """The rows with their texts compressed (``z``, of ``size`` bytes), for joins that move them."""
    return keyed.select(*[c for c in keyed.columns if c != "t"], F.octet_length("t").alias("size"), _zip("t").alias("z"))


def _unzip(z: pa.Scalar, size: int) -> bytes:
    return pa.decompress(z.as_buffer(), size, "zstd", asbytes=True) if size else b""


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All stretches of every text."""
    for batch in batches:
        for i in range(batch.num_rows):
            data = np.frombuffer(batch.column(2)[i].as_buffer() or b"", np.uint8)
            for first, n, place, anchor, whole in stretches(data) if len(data) >= WIDTH else ():
                keys = [pa.repeat(batch.column(k)[i], len(first)) for k in range(2)]
                yield pa.RecordBatch.from_arrays(
                    [*keys, pa.array(first.astype(np.int64)), pa.array(n.astype(np.int16)), pa.array((place - first).astype(np.int16)), pa.array(anchor.view(np.int64)), pa.array(whole.view(np.int64))],
                    ["k1", "kk", "s", "n", "off", "ah", "rh"],
                )


def _narrow() -> Column:
    """A stretch's place and sizes with its text's short key in one number, so that few bytes are shuffled."""
    return F.shiftleft(F.col("kk").cast("long"), 48).bitwiseOR(F.shiftleft("s", 16)).bitwiseOR(F.shiftleft(F.col("n").cast("long"), 8)).bitwiseOR(F.col("off").cast("long")).alias("p")


def _wide(p: Column) -> list[Column]:
    byte = lambda x: x.bitwiseAND(F.lit(0xFF)).cast("int")
    s = F.shiftright(p, 16).bitwiseAND(F.lit(0xFFFFFFFF))
    return [F.shiftrightunsigned(p, 48).cast("int").alias("kk"), s.alias("s"), byte(F.shiftright(p, 8)).alias("n"), byte(p).alias("off")]


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fewer, larger batches."""
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= 20_000:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, rows = [], 0
    if rows:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def suffix_order(data: np.ndarray, starts: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(order of the suffixes at ``starts``, whether each equals the one before it for ``width`` bytes).

    Every suffix has ``width`` bytes. Ranks of 8 bytes are doubled up to 128;
    two of these overlap to ``width``. Equal suffixes stand in no order.
    """
    wide = np.concatenate([data, np.zeros(8, np.uint8)])
    packed = np.zeros(len(data), dtype=np.uint64)
    for k in range(8):
        packed = (packed << np.uint64(8)) | wide[k : k + len(data)]
    rank = np.unique(packed, return_inverse=True)[1].astype(np.int64)
    size = 8
    while size * 2 <= width:
        top = int(rank.max(initial=0)) + 1
        rank = np.unique(rank[:-size] * top + rank[size:], return_inverse=True)[1].astype(np.int64)
        size *= 2
    key = rank[starts] * (int(rank.max(initial=0)) + 1) + rank[starts + width - size]
    order = np.argsort(key)
    same = np.zeros(len(order), dtype=bool)
    same[1:] = key[order[1:]] == key[order[:-1]]
    return order, same


def nearest_smaller(values: np.ndarray, border: np.ndarray) -> np.ndarray:
    """For each place the nearest one to its left with a smaller value, or -1; ``border`` marks places that look no further left.

    All between a place and its pointer is larger, so a pointer to a larger
    value may take that one's pointer over: each round skips what is known.
    """
    left = np.arange(len(values)) - 1
    left[border] = -1
    while True:
        at = np.flatnonzero(left >= 0)
        at = at[values[left[at]] > values[at]]
        if not len(at):
            return left
        left[at] = left[left[at]]


def previous_factors(order: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each suffix, two earlier ones that are equal over the whole width, or -1.

    This is the longest-previous-factor array cut at the width: in suffix
    order, among the suffixes before and behind, the nearest that stands at a
    smaller position. As the array is cut, only runs of equal suffixes are looked at.
    """
    out = np.full((2, len(order)), -1, dtype=np.int64)
    in_run = same | np.r_[same[1:], False]
    pos, border = order[in_run], ~same[in_run]
    before = nearest_smaller(pos, border)
    last = np.r_[border[1:], True][::-1] if len(pos) else border
    behind = nearest_smaller(pos[::-1], last)
    hit = before >= 0
    out[0, pos[hit]] = pos[before[hit]]
    hit = behind >= 0
    out[1, pos[::-1][hit]] = pos[::-1][behind[hit]]
    return out[0], out[1]


def _settle(keep_first: bool):
    """Repeated windows of the gathered kinds; rows come sorted by anchor and, if the first is kept, by order."""
    names = ("ah", "k1", "kk", "s", "n", "w", "bytes")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in names]):
                if size >= BATCH and row[0] != last:
                    yield from _settled(held, keep_first)
                    held, size = [], 0
                held.append(row)
                size += len(row[6])
                last = row[0]
        if held:
            yield from _settled(held, keep_first)

    return run


def _settled(rows: list[tuple], keep_first: bool) -> Iterator[pa.RecordBatch]:
    data = np.frombuffer(b"".join(r[6] for r in rows), np.uint8)
    sizes, counts = np.array([len(r[6]) for r in rows]), np.array([r[4] for r in rows])
    begin = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(rows)), counts)
    inner = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    earlier = previous_factors(*suffix_order(data, begin[of] + inner))
    hit = (earlier[0] >= 0) | (earlier[1] >= 0)
    if not keep_first:
        for e in earlier:  # the first of equal windows goes too
            hit[e[e >= 0]] = True
        hit &= np.array([r[5] == 1 for r in rows])[of]  # other kinds go as a whole
    edge = hit & np.r_[True, ~hit[:-1] | (of[1:] != of[:-1])]
    starts = np.flatnonzero(edge)
    if len(starts):
        ends = np.flatnonzero(hit & np.r_[~hit[1:] | (of[1:] != of[:-1]), True])
        own = of[starts]
        at = np.array([r[3] for r in rows])[own] + inner[starts]
        yield pa.RecordBatch.from_arrays(
            [pa.array([rows[r][1] for r in own], pa.int64()), pa.array([rows[r][2] for r in own], pa.int32()), pa.array(at, pa.int64()), pa.array((ends - starts + 1).astype(np.int32))],
            ["k1", "kk", "s", "n"],
        )


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The stretches of dense groups in pieces, cut at fixed distances from the anchor."""
    for batch in batches:
        out: list[tuple] = []
        rows = []
        for r, (off, s, n, w, raw) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("off", "s", "n", "w", "bytes")])):
            i = 0
            while i < n:
                u = (off - i) // PIECE
                m = min(n - i, off - i - u * PIECE + 1)
                part = raw[i : i + m + WIDTH - 1]
                out.append((u, hashlib.blake2b(part + (off - i).to_bytes(2, "big"), digest_size=16).digest(), s + i, m, min(w, 2), part))
                rows.append(r)
                i += m
        kinds = (pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
        for lo in range(0, len(out), 5000):
            cols = [pa.array(c, k) for c, k in zip(zip(*out[lo : lo + 5000]), kinds)]
            carried = [batch.column(c).take(pa.array(rows[lo : lo + 5000])) for c in ("ah", "o", "k1", "kk")]
            yield pa.RecordBatch.from_arrays([*carried, *cols], ["ah", "o", "k1", "kk", "u", "h", "s", "n", "w", "bytes"])


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each window of the pieces that still differ."""
    for batch in batches:
        for i, (s, n, w, raw) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("s", "n", "w", "bytes")])):
            hashes = [hashlib.blake2b(raw[j : j + WIDTH], digest_size=16).digest() for j in range(n)]
            carried = [batch.column(c).take(pa.array([i] * n)) for c in ("o", "k1", "kk")]
            yield pa.RecordBatch.from_arrays([pa.array(hashes, pa.binary()), *carried, pa.array(range(s, s + n), pa.int64()), pa.array([w == 1] * n)], ["h", "o", "k1", "kk", "s", "single"])


def _on(columns: list[str]) -> Column:
    """Equality of columns with those of the same names behind a tick."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(c) == F.col(c + "_"))
    return out


def _ticked(df: DataFrame, columns: list[str], *more: str) -> DataFrame:
    return df.select(*[F.col(c).alias(c + "_") for c in columns], *more)


#: Of equal things the first: by the order of texts, then by place.
FIRST = ["o", "k1", "kk", "s"]

def _later() -> Column:
    """Whether a row isn't the one that ``first`` names."""
    return (F.col("k1") != F.col("first.k1")) | (F.col("kk") != F.col("first.kk")) | (F.col("s") != F.col("first.s"))


def _counted(many: DataFrame, keep_first: bool) -> DataFrame:
    """Repeated windows of dense groups, ``(k1, kk, s, n)``, by counting pieces and then windows."""
    kind = many.schema["o"].dataType.simpleString()
    pieces = stored(many.mapInArrow(_pieces, f"ah long, o {kind}, k1 long, kk int, u int, h binary, s long, n int, w long, bytes binary"), "lpf-pieces")
    w = F.count("*") if keep_first else F.sum("w")  # all rows are firsts of their kind of stretch
    kinds = stored(pieces.groupBy("ah", "u", "h").agg(w.alias("w"), F.min(F.struct(*FIRST, "n", "bytes")).alias("first")), "lpf-piece-kinds")
    again = _ticked(kinds.where("w > 1"), ["ah", "u", "h"], "first")
    if keep_first:
        whole = pieces.join(again, _on(["ah", "u", "h"])).where(_later())
    else:
        whole = pieces.where("w = 1").join(again, _on(["ah", "u", "h"]))
    mixed = kinds.groupBy("ah", "u").agg(F.count("*").alias("kinds"), F.min("w").alias("least")).where("kinds > 1" if keep_first else "kinds > 1 and least = 1")
    mixed = stored(_ticked(mixed, ["ah", "u"]), "lpf-piece-mixed")
    differ = kinds.join(mixed, _on(["ah", "u"])).select("first.*", "w")
    hashed = stored(differ.mapInArrow(_hashed, f"h binary, o {kind}, k1 long, kk int, s long, single boolean"), "lpf-hashed")
    twice = stored(_ticked(hashed.groupBy("h").agg(F.count("*").alias("n"), F.min(F.struct(*FIRST)).alias("first")).where("n > 1"), ["h"], "first"), "lpf-twice")
    edges = (hashed if keep_first else hashed.where("single")).join(twice, _on(["h"]))
    edges = edges.where(_later()) if keep_first else edges
    return whole.select(*KEY, "s", "n").unionByName(edges.select(*KEY, "s", F.lit(1).alias("n")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of the stretches that a text's list names."""
    kinds = (("s", pa.int64()), ("n", pa.int32()), ("off", pa.int32()), ("ah", pa.int64()), ("rh", pa.int64()), ("w", pa.int64()), ("kinds", pa.int64()))
    for batch in batches:
        for i in range(batch.num_rows):
            raw, rows = _unzip(batch.column("z")[i], batch.column("size")[i].as_py()), batch.column("list")[i].as_py()
            cols = [pa.repeat(batch.column(k)[i], len(rows)) for k in KEY] + [pa.array([r["o"] for r in rows], batch.schema.field("list").type.value_type.field("o").type)]
            fields = [pa.array([r[f] for r in rows], t) for f, t in kinds]
            parts = pa.array([raw[r["s"] : r["s"] + r["n"] + WIDTH - 1] for r in rows], pa.binary())
            yield pa.RecordBatch.from_arrays([*cols, *fields, parts], [*KEY, "o", *(f for f, _ in kinds), "bytes"])


def _near(rows: DataFrame, shared: DataFrame, total: int) -> DataFrame:
    """The ``rows`` whose anchor is in ``shared(ah_, count)``.

    An anchor with over a ``HOT``-th of all ``total`` rows, of which there are
    under ``HOT``, is dealt over ``SALTS`` tasks by its rows' texts.
    """
    hot = [r["ah_"] for r in shared.where(F.col("count") > total / HOT).select("ah_").collect()]
    if not hot:
        return rows.join(shared.select("ah_"), _on(["ah"]), "left_semi")
    salt = F.when(F.col("ah").isin(hot), F.pmod(F.xxhash64("k1"), F.lit(SALTS)).cast("int")).otherwise(0)
    wide = shared.select("ah_", F.explode(F.sequence(F.lit(0), F.when(F.col("ah_").isin(hot), SALTS - 1).otherwise(0))).alias("salt_"))
    return rows.withColumn("salt", salt).join(wide, _on(["ah", "salt"]), "left_semi").drop("salt")


def _marks(keyed: DataFrame, firsts: DataFrame | None) -> DataFrame:
    """``(k1, kk, s, n)``: n repeated windows from byte s on.

    With ``firsts``, an order for each text, the first of equal windows isn't
    marked, and copies of texts aren't looked at. Without, n = -1 marks a text that occurs
    twice or more.
    """
    keep_first = firsts is not None
    cut = lambda b: _merged(_cut(b))
    everything = stored(keyed.select(*KEY, "t").mapInArrow(cut, "k1 long, kk int, s long, n short, off short, ah long, rh long"), "lpf-stretches")
    shared = stored(everything.groupBy("ah").count().where("count > 1").select(F.col("ah").alias("ah_"), "count"), "lpf-shared")
    near = _near(everything.select("k1", _narrow(), "ah", "rh"), shared, everything.count())
    near = near.groupBy("k1", "p", "ah", "rh").agg(F.count("*").alias("copies"))
    order = F.lit(0)
    if keep_first:
        near, order = near.join(_ticked(firsts, KEY, "first"), (F.col("k1") == F.col("k1_")) & (F.shiftrightunsigned("p", 48).cast("int") == F.col("kk_"))), F.col("first")
    near = stored(near.select("k1", *_wide(F.col("p")), "ah", "rh", "copies", order.alias("o")), "lpf-near")
    w = F.count("*") if keep_first else F.sum("copies")
    kinds = stored(near.groupBy("ah", "rh").agg(w.alias("w"), F.min(F.struct(*FIRST, "n", "off")).alias("first")), "lpf-kinds")
    again = _ticked(kinds.where("w > 1"), ["ah", "rh"], "first")
    if keep_first:
        whole = near.join(again, _on(["ah", "rh"])).where(_later())
    else:
        whole = near.where("copies = 1").join(again, _on(["ah", "rh"]))
    mixed = kinds.groupBy("ah").agg(F.count("*").alias("kinds"), F.min("w").alias("least")).where("kinds > 1" if keep_first else "kinds > 1 and least = 1")
    mixed = stored(_ticked(mixed, ["ah"], "kinds"), "lpf-mixed")
    lists = kinds.join(mixed, _on(["ah"])).select("first.*", "ah", "rh", "w", "kinds").groupBy(*KEY)
    lists = stored(_ticked(lists.agg(F.collect_list(F.struct("s", "n", "off", "ah", "rh", "w", "kinds", "o")).alias("list")), KEY, "list"), "lpf-lists")
    own = _light(keyed.select(*KEY, "t")).join(lists, _on(KEY)).select(*KEY, "size", "z", "list")
    kind = near.schema["o"].dataType.simpleString()
    gathered = stored(own.mapInArrow(_extract, f"k1 long, kk int, o {kind}, s long, n int, off int, ah long, rh long, w long, kinds long, bytes binary"), "lpf-gathered")
    gathered = gathered if keep_first else gathered.where("w = 1").unionByName(gathered.where("w > 1").dropDuplicates(["ah", "rh"]))
    gathered = gathered.dropDuplicates(["ah", "rh"]) if keep_first else gathered  # copies of a text give the same rows
    few, many = gathered.where(F.col("kinds") <= DENSE), gathered.where(F.col("kinds") > DENSE)
    line = ["ah", *FIRST] if keep_first else ["ah"]
    settled = few.select("ah", *FIRST, "n", "w", "bytes").repartition("ah").sortWithinPartitions(*line).mapInArrow(_settle(keep_first), "k1 long, kk int, s long, n int")
    out = whole.select(*KEY, "s", "n").unionByName(settled).unionByName(_counted(many, keep_first))
    if not keep_first:
        out = out.unionByName(near.where("copies > 1").select(*KEY, F.lit(0).cast("long").alias("s"), F.lit(-1).alias("n")).distinct())
    return out


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for lo in range(0, batch.num_rows, 512):
            part = batch.slice(lo, 512)
            sizes, spans, kept = part.column("size").to_pylist(), [], []
            for i, size in enumerate(sizes):
                raw, marks = _unzip(part.column("z")[i], size), part.column("marks")[i].as_py()
                runs = [(0, size)] if part.column("gone")[i].as_py() and size >= WIDTH else _spans(marks, size) if marks else []
                spans.append([{"start": a, "end": b} for a, b in runs])
                cuts = [0, *[x for run in runs for x in run], size]
                kept.append(b"".join(raw[a:b] for a, b in zip(cuts[::2], cuts[1::2])))
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(sizes, pa.int64()), pa.array(spans, span), pa.array(kept, pa.binary())], ["id", "n_bytes", "spans", "kept"])


def _spans(marks: list[dict], size: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, n in sorted((m["s"], m["n"]) for m in marks):
        if n < 0:
            return [(0, size)]
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s + n + WIDTH - 1)
        else:
            out.append([s, s + n + WIDTH - 1])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, keep_first: bool = True, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, spans, kept)`` for every row of ``docs``.

    ``spans`` are the maximal removed runs, in bytes of the UTF-8 text, end
    exclusive; ``kept`` are the bytes that stay. Repeats are judged on the
    input. With ``keep_first`` the first occurrence of each repeated string
    stays: in the row with the smallest id (nulls last; of rows with one id, any
    one), and there at the first place. Without, every occurrence goes. Null texts are empty.
    Texts under ``WIDTH`` bytes keep all; copies of longer texts lose all, but for
    the first if that is kept. Repeated rows count as copies, whatever their ids.
    Other columns are ignored; an empty table gives no rows.
    """
    keyed, firsts, row = _keyed(docs, id_col, text_col), None, []
    gone = F.lit(False)
    if keep_first:
        keyed, row = stored(keyed.withColumn("row", F.monotonically_increasing_id()), "lpf-rows"), ["row"]
        firsts = stored(keyed.groupBy(*KEY).agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")), "lpf-firsts")
    marks = _marks(keyed, firsts).groupBy(*KEY).agg(F.collect_list(F.struct("s", "n")).alias("marks"))
    both = _light(keyed.select("id", *KEY, "t", *row))
    if keep_first:
        both, gone = both.join(_ticked(firsts, KEY, F.col("first.row").alias("first")), _on(KEY)).drop("k1_", "kk_"), F.col("row") != F.col("first")
    both = both.join(stored(_ticked(marks, KEY, "marks"), "lpf-marks"), _on(KEY), "left").select("id", "size", "z", "marks", gone.alias("gone"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = both.mapInArrow(_apply, f"id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")
    return out.withColumnRenamed("id", id_col)


def repeat_digests(docs: DataFrame) -> DataFrame:
    """Sizes of every row's removed runs and the hash of what stays; every occurrence of a repeated string goes."""
    out = remove_repeats(docs, keep_first=False)
    return out.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
