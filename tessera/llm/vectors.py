"""Near-duplicate embeddings by products of int8 tiles with rigorous error bounds.

Vectors are compared within their label, and links are those with a cosine of
``LEAST`` or more, computed in double precision:

* equal vectors of a label are folded into a class first, so copies cost a row
  of a sum, whatever their number;
* classes are sorted by cells of a few fixed orthonormal projections and packed
  into tiles of at most ``TILE_BYTES``. A tile carries its vectors in int8 with
  a scale and the norm of what quantising lost, and in full precision;
* two tiles are compared unless their boxes in the projections lie farther
  apart than linked unit vectors can: projections never lengthen a distance;
* the integer products of a pair of tiles, exact as they are, bound each
  cosine from both sides; only pairs whose bounds hold the threshold are
  computed again in full precision.

A pair of tiles gives at most a row for each of its vectors: how many vectors
it links to there, and the root of its tree in a spanning forest of the links.
So no pair of vectors is ever written, and components are those of the forests.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored
from .simhash import components

LEAST = 0.98
#: Bytes of a tile, and the most vectors that it holds.
TILE_BYTES, TILE_ROWS = 1 << 20, 2048
#: Projections that order the vectors and give tiles their boxes.
PROJECTIONS, SEED = 4, 11
#: Rows of a tile whose products are in memory at a time, and pairs that are computed again at a time.
ROWS, PAIRS = 512, 1 << 14
#: Components whose int8 products add up exactly in 32-bit floats: 1024 x 127 x 127 is under 2^24.
EXACT_DIMS = 1024
#: Beside the bounds, for rounding in double precision.
SLACK = 1e-9
_TILE = "tile_label {label}, dim int, lo array<double>, hi array<double>, ids binary, copies binary, q binary, scale binary, err binary, full binary"


def comparable(vec: Column) -> Column:
    """Neither null, empty nor zero, and without null or non-finite components."""
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))
    return F.coalesce(F.forall(vec, finite) & F.exists(vec, lambda x: x != 0), F.lit(False))


@lru_cache(8)
def _directions(dim: int) -> np.ndarray:
    """Fixed orthonormal directions, dim x PROJECTIONS; as many as there are dimensions at most, zeros beyond."""
    k = min(dim, PROJECTIONS)
    q, _ = np.linalg.qr(np.random.default_rng(SEED).standard_normal((dim, k)))
    return np.concatenate([q, np.zeros((dim, PROJECTIONS - k))], axis=1)


def units(raw: np.ndarray) -> np.ndarray:
    """Rows at length 1, in double precision; scaled by their largest component first, so that squares neither overflow nor vanish."""
    x = raw.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def quantised(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(int8 rows, scales, error norms) of unit rows: a row is its scale times its integers, up to a vector of at most that norm."""
    scale = np.abs(x).max(axis=1) / 127
    q = np.rint(x / scale[:, None]).astype(np.int8)
    lost = x - q * scale[:, None]
    return q, scale, np.sqrt((lost * lost).sum(axis=1)) * (1 + SLACK) + SLACK


@dataclass
class Tile:
    ids: np.ndarray
    copies: np.ndarray
    q: np.ndarray
    scale: np.ndarray
    err: np.ndarray
    full: np.ndarray

    @staticmethod
    def of(raw: np.ndarray, ids: np.ndarray, copies: np.ndarray) -> Tile:
        return Tile(ids, copies, *quantised(units(raw)), raw)


def _integer_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT_DIMS):
        out += a[:, d : d + EXACT_DIMS].astype(np.float32) @ b[:, d : d + EXACT_DIMS].astype(np.float32).T
    return out


def linked(a: Tile, b: Tile, least: float) -> Iterator[tuple[int, np.ndarray, int]]:
    """(first row, which rows of ``b`` each row links to, pairs computed again), block by block of the rows of ``a``."""
    for lo in range(0, len(a.ids), ROWS):
        hi = min(len(a.ids), lo + ROWS)
        near = _integer_products(a.q[lo:hi], b.q) * a.scale[lo:hi, None] * b.scale
        bound = a.err[lo:hi, None] + (1 + a.err[lo:hi, None]) * b.err + SLACK
        sure = near - bound >= least
        i, j = np.nonzero((near + bound >= least) & ~sure)
        for p in range(0, len(i), PAIRS):
            x, y = i[p : p + PAIRS], j[p : p + PAIRS]
            sure[x, y] = np.einsum("ij,ij->i", units(a.full[lo + x]), units(b.full[y])) >= least
        yield lo, sure, len(i)


def compare(a: Tile, b: Tile | None, least: float = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, number of linked vectors, root) of the classes that link between two tiles, or within one.

    The roots are those of a spanning forest of the links, which the rows of a
    block join one by one.
    """
    other = a if b is None else b
    n = len(a.ids)
    at = 0 if b is None else n  # where the other tile's classes are numbered from
    ids = a.ids if b is None else np.concatenate([a.ids, b.ids])
    counts, root = np.zeros(len(ids)), np.arange(len(ids))
    for lo, links, _ in linked(a, other, least):
        if b is None:
            links[np.arange(len(links)), lo + np.arange(len(links))] = False
        weights = links.astype(np.float64)
        counts[lo : lo + len(links)] += weights @ other.copies
        if b is not None:
            counts[at:] += a.copies[lo : lo + len(links)] @ weights
        for r in np.flatnonzero(links.any(axis=1)):
            met = np.unique(root[np.r_[lo + r, at + np.flatnonzero(links[r])]])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    some = counts > 0
    return ids[some], counts[some].astype(np.int64), ids[root[some]]


def _matrix(column: pa.Array) -> np.ndarray:
    """A list column of one length as rows."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1)


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (cid, copies, label, dim, v) with the cells of their projections; several dimensions may stand in a batch."""
    for batch in batches:
        dims = batch.column(3).to_numpy()
        for dim in np.unique(dims):
            part = batch.filter(pa.array(dims == dim))
            cells = np.floor(units(_matrix(part.column(4))) @ _directions(int(dim)) / _cell()).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, *[pa.array(c) for c in cells.T]], [*batch.schema.names, *[f"c{k}" for k in range(PROJECTIONS)]])


def _cell() -> float:
    """The width of a projection's cells: about the distance of the farthest linked vectors."""
    return 0.2


def _pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows as tiles, cut where the label or the dimension changes and where one is full."""
    held: list[pa.RecordBatch] = []

    def close() -> Iterator[pa.RecordBatch]:
        if held:
            rows = pa.Table.from_batches(held).combine_chunks()
            raw = _matrix(rows.column("v").combine_chunks())
            tile = Tile.of(raw, rows.column("cid").to_numpy(), rows.column("copies").to_numpy())
            seen = units(raw) @ _directions(raw.shape[1])
            label = rows.column("label").combine_chunks().slice(0, 1)
            parts = [tile.ids, tile.copies, tile.q, tile.scale, tile.err, tile.full]
            boxes = [pa.array([seen.min(axis=0) - SLACK]), pa.array([seen.max(axis=0) + SLACK])]
            yield pa.RecordBatch.from_arrays(
                [label, pa.array([raw.shape[1]], pa.int32()), *boxes, *[pa.array([np.ascontiguousarray(p).tobytes()], pa.binary()) for p in parts]],
                ["tile_label", "dim", "lo", "hi", "ids", "copies", "q", "scale", "err", "full"],
            )
            held.clear()

    last, size = None, 0
    for batch in batches:
        keys = [(k["label"], k["dim"]) for k in batch.select(["label", "dim"]).to_pylist()]
        cuts = [i for i in range(1, len(keys)) if keys[i] != keys[i - 1]]
        for a, z in zip([0, *cuts], [*cuts, len(keys)]):
            if a == z:
                continue
            if keys[a] != last:
                yield from close()
                last, size = keys[a], 0
            most = max(1, min(TILE_ROWS, TILE_BYTES // (keys[a][1] * 9 + 32)))
            while a < z:
                take = min(z - a, most - size)
                held.append(batch.slice(a, take))
                a, size = a + take, size + take
                if size == most:
                    yield from close()
                    size = 0
    yield from close()


def tiles(classes: DataFrame) -> DataFrame:
    """Tiles of ``classes(cid, copies, label, v)``, numbered in ``tile``.

    One shuffle by range, which splits a label of any size; the sort is total, so a task that runs again packs the same tiles.
    """
    kinds = {f.name: f.dataType.simpleString() for f in classes.schema}
    own = classes.select("cid", "copies", "label", F.size("v").alias("dim"), "v")
    cells = [f"c{k}" for k in range(PROJECTIONS)]
    placed = own.mapInArrow(_place, f"cid long, copies long, label {kinds['label']}, dim int, v {kinds['v']}, " + ", ".join(f"{c} int" for c in cells))
    order = ["label", "dim", *cells, "cid"]
    packed = placed.repartitionByRange(*order).sortWithinPartitions(*order).mapInArrow(_pack, _TILE.format(label=kinds["label"]))
    return stored(packed.withColumn("tile", F.monotonically_increasing_id()), "vectors-tiles")


def tile_pairs(tiled: DataFrame, least: float = LEAST) -> DataFrame:
    """``(a, b)``, a <= b: tiles of one label and dimension whose boxes are near enough for a link.

    Tiles meet by equality in the cells of the first projection that they cover, one of
    them widened by the reach of a link; a pair counts in the first cell that both have.
    """
    reach = float(np.sqrt(max(0.0, 2 - 2 * least))) + SLACK
    cell = lambda x: F.floor(x / F.lit(_cell())).cast("int")
    box = tiled.select("tile", "tile_label", "dim", "lo", "hi")
    wide = box.select(F.col("tile").alias("a"), F.col("tile_label").alias("la"), F.col("dim").alias("da"), F.col("lo").alias("lo_a"), F.col("hi").alias("hi_a"), cell(F.col("lo")[0] - reach).alias("from_a"), cell(F.col("hi")[0] + reach).alias("to_a"))
    wide = wide.withColumn("ca", F.explode(F.sequence("from_a", "to_a")))
    own = box.select(F.col("tile").alias("b"), F.col("tile_label").alias("lb"), F.col("dim").alias("db"), F.col("lo").alias("lo_b"), F.col("hi").alias("hi_b"), cell(F.col("lo")[0]).alias("from_b"), cell(F.col("hi")[0]).alias("to_b"))
    own = own.withColumn("cb", F.explode(F.sequence("from_b", "to_b")))
    gap = lambda k: F.greatest(F.lit(0.0), F.col("lo_b")[k] - F.col("hi_a")[k], F.col("lo_a")[k] - F.col("hi_b")[k])
    apart = sum((gap(k) * gap(k) for k in range(PROJECTIONS)), F.lit(0.0))
    met = wide.join(own, (F.col("la") == F.col("lb")) & (F.col("da") == F.col("db")) & (F.col("ca") == F.col("cb")) & (F.col("a") <= F.col("b")))
    return met.where((F.col("ca") == F.greatest("from_a", "from_b")) & (apart <= reach * reach)).select("a", "b")


def _read(row: dict, wide: bool) -> Tile:
    n = len(row["ids"]) // 8
    part = lambda name, kind: np.frombuffer(row[name], kind)
    return Tile(part("ids", np.int64), part("copies", np.int64).astype(np.float64), part("q", np.int8).reshape(n, -1), part("scale", np.float64), part("err", np.float64), part("full", np.float64 if wide else np.float32).reshape(n, -1))


def forests(tiled: DataFrame, pairs: DataFrame, least: float, wide: bool) -> DataFrame:
    """``(cid, n, root)``: what every pair of tiles says of its classes that link. A task holds two tiles at a time."""
    payload = ["ids", "copies", "q", "scale", "err", "full"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first: tuple[tuple[int, int], Tile] | None = None
        for batch in batches:
            for at in range(batch.num_rows):
                row = batch.slice(at, 1).to_pylist()[0]
                pair, tile = (row["a"], row["b"]), _read(row, wide)
                if row["a"] == row["b"]:
                    got = compare(tile, None, least)
                elif first is None or first[0] != pair:
                    first = (pair, tile)
                    continue
                else:
                    got = compare(first[1], tile, least)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in got], ["cid", "n", "root"])

    sides = pairs.select("a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("side"))
    brought = sides.join(tiled.select(F.col("tile").alias("side"), *payload).hint("shuffle_hash"), "side")
    return brought.repartition("a", "b").sortWithinPartitions("a", "b", "side").mapInArrow(run, "cid long, n long, root long")


def near_duplicates(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str | None = "label", least: float = LEAST) -> DataFrame:
    """``(vec_id, n_links, component_id, kept)`` for every row of ``vectors``.

    Rows link if their labels are equal and not null (``label_col`` None: all
    are compared) and their cosine is ``least`` or more; vectors of different
    lengths don't. Vectors that are null, empty or zero, or that hold null or non-finite
    components, link with nothing and are their own component. Repeated rows
    link with each other. A null id stays null, isn't kept, and doesn't name a component unless
    all its ids are null. Other columns, whatever their names, are ignored. An
    empty table gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("the least cosine must be over 0, and 1 at most")
    kind = vectors.schema[vec_col].dataType.simpleString()
    wide = kind != "array<float>"
    v = F.col(vec_col) if kind in ("array<float>", "array<double>") else F.col(vec_col).cast("array<double>")
    label = F.lit(0) if label_col is None else F.col(label_col)
    good = comparable(v) & label.isNotNull()
    rows = vectors.select(F.col(id_col).alias("id"), F.when(good, label).alias("label"), F.when(good, v).alias("v"))
    folded = rows.where("v is not null").groupBy("label", "v").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    classes = stored(folded.withColumn("cid", F.monotonically_increasing_id()), "vectors-classes")
    tiled = tiles(classes)
    pairs = stored(tile_pairs(tiled, least), "vectors-pairs")
    links = stored(forests(tiled, pairs, least, wide), "vectors-links")
    edges = links.where("cid <> root").select(F.col("cid").alias("a"), F.col("root").alias("b")).distinct()
    trees = components(edges).toDF("node", "tree")
    counts = links.groupBy(F.col("cid").alias("of")).agg(F.sum("n").alias("n"))
    counted = classes.join(counts, F.col("cid") == F.col("of"), "left").join(trees, F.col("cid") == F.col("node"), "left")
    rooted = stored(counted.select("label", "v", "copies", "least", "n", F.coalesce("tree", "cid").alias("tree")), "vectors-rooted")
    named = stored(rooted.groupBy("tree").agg(F.min("least").alias("component")), "vectors-named")
    own = stored(rooted.join(named, "tree").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component"), "vectors-own")
    met = rows.join(own.select(F.col("label").alias("l"), F.col("v").alias("w"), "n_links", "component"), (F.col("label") == F.col("l")) & (F.col("v") == F.col("w")), "left")
    component = F.when(F.col("n_links").isNull(), F.col("id")).otherwise(F.col("component"))
    return met.select(F.col("id").alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
