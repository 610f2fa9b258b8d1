"""SimHash near-dedup by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints at two
or fewer differing bits have a segment in which at most one bit differs, so
they share one of that segment's 32 one-wildcard variants. The distinct
fingerprints are indexed under all 2 x 32 variants, fingerprints that meet in a
variant are compared, and components are found by label propagation.

Work stays linear in the number of distinct fingerprints:

* equal fingerprints are folded before anything is indexed, so copies cost one
  row, whatever their number;
* a variant with over ``DENSE`` fingerprints is split by the other segment: two
  bits at most differ there, so of its three thirds one at least is equal, and
  only members with an equal third are compared;
* where over ``DENSE`` share a variant and a third, they are indexed again
  under two-wildcard keys of all 64 bits. All that share such a key are within
  two bits of each other, so a chain through them links them exactly, without
  pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import fresh, stored

SEED = 42
SHINGLE = 3
MAX_BITS = 2
#: Members of a variant, or of one of its thirds, up to which pairs are compared directly.
DENSE = 64
#: The first bits of a segment's thirds, and the bits of each.
THIRDS = ((0, 11), (11, 11), (22, 10))
#: Shingles that are counted at a time, which bounds memory on long texts.
BLOCK = 1 << 16
_LANES = np.uint64(0x0101010101010101)
_EDGE = "a long, b long"
#: A link, or with a key a member of a dense run.
_MET = "a long, b long, key long"


def fingerprint(text: str | None) -> int:
    """The fingerprint of one text; 0 for null and for texts without words."""
    if not text:
        return 0
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    join, digest = b" ".join, xxhash.xxh64_intdigest
    n = max(1, len(words) - SHINGLE + 1)
    counts = np.zeros(64, dtype=np.int64)
    for at in range(0, n, BLOCK):
        part = words[at : at + BLOCK + SHINGLE - 1]
        grams = map(join, zip(part, part[1:], part[2:])) if len(words) >= SHINGLE else [join(words)]
        h = np.fromiter((digest(g, SEED) for g in grams), dtype=np.uint64)
        counts += _bit_counts(h)
    bits = counts * 2 > n
    return int(np.packbits(bits[::-1]).view(">u8")[0])


def _bit_counts(h: np.ndarray) -> np.ndarray:
    """How many values have each bit set, bit 0 first.

    Bit k of every byte is added up in byte lanes, at most 255 values at a
    time, so that no lane overflows.
    """
    out = np.zeros(64, dtype=np.int64)
    starts = np.arange(0, len(h), 255)
    for k in range(8):
        lanes = np.add.reduceat((h >> np.uint64(k)) & _LANES, starts)
        out[k::8] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, fp)`` of every row; other columns of ``docs`` aren't read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = np.array([fingerprint(t.as_py()) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64), pa.int64())], ["id", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {kind}, fp long")


def _variants(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(key, fingerprint) under the 64 one-wildcard segment variants.

    A key holds the segment with the wildcard cleared in its low half, and the
    segment's number and the wildcard's place in its high half.
    """
    places = np.arange(32, dtype=np.uint64)
    clear = ~(np.uint64(1) << places)
    keys = []
    for s in range(2):
        seg = (fps >> np.uint64(32 * s)) & np.uint64(0xFFFFFFFF)
        keys.append((seg[:, None] & clear) | ((places + np.uint64(32 * s)) << np.uint64(32)))
    key = np.concatenate(keys, axis=1).ravel()
    return key.view(np.int64), np.repeat(fps, 64).view(np.int64)


def _index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 4096):
            key, fp = _variants(fps[at : at + 4096])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(fp)], ["key", "fp"])


def _runs(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks of sorted rows, cut only where the key (all but the last column) changes.

    A run that is longer than a batch comes in several blocks; a flag says
    whether the block's first run goes on from the block before it.
    """
    held: list[np.ndarray] | None = None
    goes_on = False
    for batch in batches:
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(columns)]
        if not len(cols[0]):
            continue
        cols = [np.concatenate(x) for x in zip(held, cols)] if held else cols
        new = np.zeros(len(cols[0]), dtype=bool)
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
        last = int(np.flatnonzero(new)[-1]) if new.any() else 0
        if last:
            yield (*[c[:last] for c in cols], goes_on)
            held, goes_on = [c[last:] for c in cols], False
        elif len(cols[0]) > 4 * DENSE:
            yield (*cols, goes_on)
            keep = [c[-1:] for c in cols]
            held, goes_on = keep, True
        else:
            held = cols
    if held:
        yield (*held, goes_on)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links inside small runs of equal keys; members of dense ones as (fp, fp, key)."""
    for key, fp, goes_on in _runs(batches, 2):
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        dense = sizes > DENSE
        if goes_on:
            dense[0] = True
        run = np.repeat(np.arange(len(starts)), sizes)
        u = fp.view(np.uint64)
        left, right = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        small = np.where(dense, 1, sizes)
        for step in range(1, int(small.max(initial=1))):
            i = np.flatnonzero((run[:-step] == run[step:]) & ~dense[run[:-step]])
            if not len(i):
                break
            far = np.bitwise_count(u[i] ^ u[i + step]) <= MAX_BITS
            left.append(fp[i[far]])
            right.append(fp[i[far] + step])
        a, b = np.concatenate(left), np.concatenate(right)
        if len(a):
            a, b = np.unique(np.stack([a, b]), axis=1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.nulls(len(a), pa.int64())], ["a", "b", "key"])
        many = dense[run]
        if many.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[many]), pa.array(fp[many]), pa.array(key[many])], ["a", "b", "key"])


def _thirds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, fingerprint) of dense variants' members, a row for each third of the segment that isn't the variant's."""
    for batch in batches:
        key, fp = (batch.column(i).to_numpy(zero_copy_only=False).view(np.uint64) for i in range(2))
        low = key >> np.uint64(32) < np.uint64(32)  # the variant is of the low segment
        other = np.where(low, fp >> np.uint64(32), fp & np.uint64(0xFFFFFFFF))
        for number, (first, bits) in enumerate(THIRDS):
            third = (other >> np.uint64(first)) & np.uint64((1 << bits) - 1)
            fine = key | np.uint64(number << 38) | third << np.uint64(40)
            yield pa.RecordBatch.from_arrays([pa.array(fine.view(np.int64)), pa.array(fp.view(np.int64))], ["key", "fp"])


def _dense_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All 2016 two-wildcard keys of each fingerprint."""
    i, j = np.triu_indices(64, 1)
    mask = ~((np.uint64(1) << i.astype(np.uint64)) | (np.uint64(1) << j.astype(np.uint64)))
    place = (i * 64 + j).astype(np.int16)
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(fps), 64):
            f = fps[at : at + 64]
            yield pa.RecordBatch.from_arrays(
                [pa.array((f[:, None] & mask).ravel().view(np.int64)), pa.array(np.tile(place, len(f))), pa.array(np.repeat(f, len(mask)).view(np.int64))],
                ["key", "place", "fp"],
            )


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links from each run's neighbours; a chain in sorted order, which links the run as a star would."""
    for key, place, fp, _ in _runs(batches, 3):
        same = (key[1:] == key[:-1]) & (place[1:] == place[:-1]) & (fp[1:] != fp[:-1])
        if same.any():
            yield pa.RecordBatch.from_arrays([pa.array(fp[:-1][same]), pa.array(fp[1:][same])], ["a", "b"])


def links(distinct: DataFrame) -> DataFrame:
    """Links ``(a, b)`` that connect all fingerprints at two or fewer differing bits.

    ``distinct`` has one column of distinct fingerprints. The links of dense
    variants are chains, which connect the same fingerprints with fewer rows.
    """
    meet = lambda keyed: keyed.repartition("key").sortWithinPartitions("key", "fp").mapInArrow(_pairs, _MET)
    met = stored(meet(distinct.mapInArrow(_index, "key long, fp long")), "simhash-met")
    dense = met.where("key is not null").select("key", F.col("a").alias("fp"))
    fine = stored(meet(dense.mapInArrow(_thirds, "key long, fp long")), "simhash-thirds")
    chains = (
        fine.where("key is not null").select("a").distinct().mapInArrow(_dense_index, "key long, place short, fp long")
        .repartition("key", "place")
        .sortWithinPartitions("key", "place", "fp")
        .mapInArrow(_stars, _EDGE)
    )
    near = met.where("key is null").select("a", "b").unionByName(fine.where("key is null").select("a", "b"))
    return near.unionByName(chains).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def components(edges: DataFrame, rounds: int = 200) -> DataFrame:
    """``(node, label)`` of all nodes of ``edges``: label is the component's smallest node.

    Each round takes the smallest label among a node and its neighbours, then
    the label of that label, which halves long chains. Both joins read written
    tables, so that AQE may split a label that very many nodes carry.
    """
    both = stored(edges.union(edges.select("b", "a")).toDF("u", "v"), "cc-edges")
    labels = stored(both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.col("u")).alias("label")), "cc-labels")
    for _ in range(rounds):
        near = both.join(labels, both["v"] == labels["node"]).groupBy("u").agg(F.min("label").alias("near"))
        hooked = stored(
            labels.join(near, labels["node"] == near["u"], "left").select("node", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label")),
            "cc-hooked",
        )
        up = hooked.select(F.col("node").alias("root"), F.col("label").alias("over"))
        labels2 = stored(
            hooked.join(up, hooked["label"] == up["root"]).select("node", "old", F.least("label", "over").alias("label")),
            "cc-labels",
        )
        if labels2.where("label <> old").isEmpty():
            return labels2.select("node", "label")
        labels = labels2.select("node", "label")
    raise RuntimeError(f"components have not settled in {rounds} rounds")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, fingerprint, component_id)`` for every row of ``docs``.

    Null and empty texts, and texts without words, have fingerprint zero and
    are linked with each other. Repeated rows are kept. A null id stays null
    and doesn't name a component unless all its ids are null. Other columns,
    whatever their names, are ignored. An empty table gives no rows.
    """
    fps = stored(fingerprints(docs, id_col, text_col), "simhash-fp")
    classes = stored(fps.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-classes")
    comp = components(links(classes.select("fp")))
    rooted = stored(classes.join(comp, classes["fp"] == comp["node"]).select("fp", "rep", "label"), "simhash-rooted")
    least = stored(rooted.groupBy("label").agg(F.min("rep").alias("component")), "simhash-least")
    named = stored(rooted.join(least, "label").select("fp", "component"), "simhash-named")
    own = stored(classes.join(named, "fp", "left").select(F.col("fp").alias("key"), F.coalesce("component", "rep").alias("component")), "simhash-own")
    return fps.join(own, fps["fp"] == own["key"]).select(
        F.col("id").alias(id_col),
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of each component of ``docs``; all columns stay.

    The row with the smallest id stays, of rows with one id any one; ids that
    are null come last. Rows are judged, not ids: a text that shares an id with
    another one is judged by itself. Texts without words, nulls included, are
    one component. An empty table gives no rows.
    """

    @arrow_udf("long")
    def mark(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.array(np.array([fingerprint(x.as_py()) for x in t], dtype=np.uint64).view(np.int64))

    row, fp = fresh(docs, "row"), fresh(docs, "fp")
    rows = stored(docs.withColumn(row, F.monotonically_increasing_id()).withColumn(fp, mark(text_col)), "simhash-rows")
    one = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col(row).alias("row"))
    classes = stored(rows.groupBy(F.col(fp).alias("fp")).agg(F.min(one).alias("one")), "simhash-classes")
    comp = components(links(classes.select("fp")))
    first = classes.join(comp, classes["fp"] == comp["node"], "left").groupBy(F.coalesce("label", "fp").alias("label")).agg(F.min("one").alias("one"))
    stay = stored(first.select(F.col("one.row").alias("stay")), "simhash-stay")
    # row numbers spread evenly; a table of them is never broadcast, however small
    return rows.join(stay.hint("shuffle_hash"), F.col(row) == F.col("stay"), "left_semi").select(*docs.columns)
