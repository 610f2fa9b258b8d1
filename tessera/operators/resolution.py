"""Greedy resolution of candidates against memories, in rounds instead of one by one.

In order, a candidate merges into the most similar memory before it (cosine of
at least a threshold) or becomes one. Those that become memories are the lexicographically
first independent set of the graph of similar pairs, which rounds find: a candidate with
an earlier memory near it merges, one without any earlier undecided candidate near it
becomes a memory, and the others wait. Rows of a category lie in tiles of at most ``1 << TILE_BITS`` in
their order; pairs of tiles are compared, and a tile is then worked through in order, so a round decides
more than one link of a chain. A pair of tiles gives a row for each candidate at most, never one for each pair of similar vectors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.packing import _kept, placed

TILE_BITS = 10
UNDECIDED, MEMORY, MERGED = 0, 1, 2


def _units(column: pa.Array) -> np.ndarray:
    """Rows of one tile at length 1; zero vectors stay zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)
    norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


def _tile(batch: pa.RecordBatch, at: int, rows: str) -> tuple[np.ndarray, np.ndarray]:
    """(places, unit vectors) of the tile in a row's column."""
    own = batch.column(batch.schema.get_field_index(rows)).slice(at, 1).flatten()
    return own.field("place").to_numpy(), _units(own.field("v"))


def _states(batch: pa.RecordBatch, at: int, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).slice(at, 1).flatten().field("state").to_numpy()


def _near(later: np.ndarray, earlier: np.ndarray, threshold: float, same: bool) -> np.ndarray:
    """Which earlier rows are similar to each later one."""
    out = later @ earlier.T >= threshold
    return np.tril(out, -1) if same else out


def resolve(candidates: DataFrame, threshold: float = 0.9, existing: DataFrame | None = None) -> DataFrame:
    """``(category, id, memory_id, decision)``: create or merge, as going through ``candidates(category, id, vec)`` by id one by one would.

    ``existing(category, memory_id, vec)`` come before all candidates. Of equally similar memories the
    earliest counts. Null vectors and those of another length than their category's first are an error of the caller; zero vectors are similar to nothing.
    """
    kinds = {f.name: f.dataType.simpleString() for f in candidates.schema}
    rows = candidates.select("category", F.lit(1).alias("new"), "id", F.col("vec").alias("v"))
    if existing is not None:
        rows = rows.unionByName(existing.select("category", F.lit(0).alias("new"), F.col("memory_id").cast(kinds["id"]).alias("id"), F.col("vec").alias("v")))
    every = placed(rows, "category", ["new", "id"])
    tiles = every.groupBy("category", F.shiftright("place", TILE_BITS).alias("block")).agg(F.sort_array(F.collect_list(F.struct("place", "v"))).alias("rows"))
    tiles = _kept(tiles.select("category", F.monotonically_increasing_id().alias("tile"), F.col("rows")[0]["place"].alias("first"), "rows"), "tiles")
    states = _kept(every.select("place", F.when(F.col("new") == 0, MEMORY).otherwise(UNDECIDED).alias("state")), "states")
    within = tiles.select("tile", F.explode("rows.place").alias("place"))
    head = tiles.select("category", "tile", "first")
    earlier = head.select(F.col("category").alias("c"), F.col("tile").alias("a"), F.col("first").alias("fa"))
    met = earlier.join(head.withColumnRenamed("tile", "b"), F.col("c").eqNullSafe(F.col("category")) & (F.col("fa") < F.col("first"))).select("a", "b")
    side = lambda name: tiles.select(F.col("tile").alias(name), F.col("rows").alias(f"rows_{name}"))

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [_near(_tile(batch, i, "rows_b")[1], _tile(batch, i, "rows_a")[1], threshold, False).any() for i in range(batch.num_rows)]
            yield batch.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))

    pairs = _kept(met.join(side("a"), "a").join(side("b"), "b").mapInArrow(some, "a long, b long"), "pairs")

    def by_tile(now: DataFrame, name: str) -> DataFrame:
        own = within.join(now, "place", "left").groupBy(F.col("tile").alias(name))
        return own.agg(F.sort_array(F.collect_list(F.struct("place", F.coalesce("state", F.lit(0)).alias("state")))).alias(f"states_{name}"))

    def across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """For undecided rows of the later tile: 2 if a memory of the earlier one is near, 1 if an undecided row is."""
        for batch in batches:
            for i in range(batch.num_rows):
                sa, sb = _states(batch, i, "states_a"), _states(batch, i, "states_b")
                (_, a), (places, b) = _tile(batch, i, "rows_a"), _tile(batch, i, "rows_b")
                near = _near(b, a, threshold, False)
                flag = np.where(near[:, sa == MEMORY].any(axis=1), 2, near[:, sa == UNDECIDED].any(axis=1)).astype(np.int32)
                told = (sb == UNDECIDED) & (flag > 0)
                yield pa.RecordBatch.from_arrays([pa.array(places[told]), pa.array(flag[told])], ["place", "state"])

    def inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A tile in order: what other tiles say comes first, then its own earlier rows."""
        for batch in batches:
            for i in range(batch.num_rows):
                state, flag = _states(batch, i, "states_b").copy(), _states(batch, i, "states_f")
                places, x = _tile(batch, i, "rows_b")
                near = _near(x, x, threshold, True)
                for r in np.flatnonzero(state == UNDECIDED):
                    own = state[near[r]]
                    if flag[r] == 2 or (own == MEMORY).any():
                        state[r] = MERGED
                    elif flag[r] == 0 and not (own == UNDECIDED).any():
                        state[r] = MEMORY
                yield pa.RecordBatch.from_arrays([pa.array(places), pa.array(state.astype(np.int32))], ["place", "state"])

    while not states.where(f"state = {UNDECIDED}").isEmpty():  # the earliest undecided row of a category is decided in every round
        said = pairs.join(side("a"), "a").join(side("b"), "b").join(by_tile(states, "a"), "a").join(by_tile(states, "b"), "b").mapInArrow(across, "place long, state int")
        flags = by_tile(said.groupBy("place").agg(F.max("state").alias("state")), "f")
        states = _kept(side("b").join(by_tile(states, "b"), "b").join(flags, F.col("b") == F.col("f")).mapInArrow(inside, "place long, state int"), "states")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sa, sb = _states(batch, i, "states_a"), _states(batch, i, "states_b")
                (pa_, a), (pb, b) = _tile(batch, i, "rows_a"), _tile(batch, i, "rows_b")
                made, told = np.flatnonzero(sa == MEMORY), np.flatnonzero(sb == MERGED)
                if len(made) and len(told):
                    sims = np.where(pa_[made] < pb[told][:, None], b[told] @ a[made].T, -2.0)
                    top = sims.argmax(axis=1)
                    yield pa.RecordBatch.from_arrays([pa.array(pb[told]), pa.array(sims[np.arange(len(told)), top]), pa.array(-pa_[made][top])], ["place", "sim", "minus"])

    both = pairs.unionByName(tiles.select(F.col("tile").alias("a"), F.col("tile").alias("b")))
    nearest = both.join(side("a"), "a").join(side("b"), "b").join(by_tile(states, "a"), "a").join(by_tile(states, "b"), "b").mapInArrow(best, "place long, sim double, minus long")
    chosen = nearest.groupBy("place").agg(F.max(F.struct("sim", "minus")).alias("s")).select(F.col("place").alias("p"), (-F.col("s.minus")).alias("into"))
    names = every.select(F.col("place").alias("into"), F.col("id").alias("memory"))
    done = every.where("new = 1").join(states, "place").join(chosen, F.col("place") == F.col("p"), "left").join(names, "into", "left")
    merged = F.col("state") == MERGED
    return done.select("category", "id", F.when(merged, F.col("memory")).otherwise(F.col("id")).alias("memory_id"), F.when(merged, "merge").otherwise("create").alias("decision"))
