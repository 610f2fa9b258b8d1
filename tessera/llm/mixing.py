"""Mixing sources to target weights by hash-threshold histograms.

Every document has a hash. A source takes all documents whose hash lies below
its threshold, so larger budgets take supersets of smaller ones, and no row is
sorted. The thresholds come from histograms: sizes are summed by source and
hash bucket, the bucket in which a source's budget ends is found from running
sums, and only that bucket is split again, until it holds one hash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, stored

WEIGHTS = (5.0, 2.0, 1.0)
MOST_REPEATS = 3
#: Bits of the hash, and bits that one histogram looks at.
BITS, STEP = 60, 10
#: Sources up to which their thresholds are broadcast; beyond, they are joined by a shuffle.
BROADCAST_SOURCES = 100_000
WORD = r"[^\x20\x09-\x0D]+"


def words_in(text: Column | str) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_of(id_col: str = "doc_id", text_col: str = "text") -> Column:
    h = F.xxhash64(F.lit("mix"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col), F.lit("")))
    return F.shiftrightunsigned(h, 64 - BITS)


def weighted(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """``sizes(source, size)`` with each source's ``weight``: by code point, null last, sources take the weights in turn.

    The place in order is counted in ranges: a row number in each, behind the
    numbers of rows in the ranges before. The driver sees one number a range.
    """
    order = [F.col("source").isNull(), F.col("source").cast("binary")]
    own = sizes.repartitionByRange(*order).withColumn("range", F.spark_partition_id())
    own = stored(own.withColumn("n", F.row_number().over(Window.partitionBy("range").orderBy(*order))), "mix-ranges")
    before, total = {}, 0
    for r in own.groupBy("range").count().orderBy("range").collect():
        before[r["range"]], total = total, total + r["count"]
    first = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[F.col("range")] if before else F.lit(0)
    return own.select("source", "size", F.get(F.array(*[F.lit(w) for w in weights]), ((first + F.col("n") - 1) % len(weights)).cast("int")).alias("weight"))


def targets(sources: DataFrame, most: int = MOST_REPEATS) -> DataFrame:
    """``sources(source, size, weight)`` with ``target``: the weight's share of all sizes, at most ``most`` times the size.

    What a source can't take is shared among the others by weight, until none
    is above. A round is one aggregate: the share a weight has once the sources
    above it are held at their most. Shares only grow, so the rounds end.
    """
    cap = F.lit(float(most)) * F.col("size")
    total = float(sources.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("t")).first()["t"])
    share, held = 0.0, -1
    while True:
        over = F.lit(share) * F.col("weight") > cap
        r = sources.agg(F.count_if(over).alias("n"), F.sum(F.when(over, cap).otherwise(0.0)).alias("taken"), F.sum(F.when(over, 0.0).otherwise(F.col("weight"))).alias("w")).first()
        if r["n"] == held or not r["w"]:
            break
        held, share = r["n"], (total - r["taken"]) / r["w"]
    goal = F.lit(share) * F.col("weight")
    return sources.withColumn("target", F.when(goal > cap, cap).otherwise(goal).cast("double"))


def _small(df: DataFrame, n: int) -> DataFrame:
    return F.broadcast(df) if n <= BROADCAST_SOURCES else df


def thresholds(slim: DataFrame, budgets: DataFrame, n: int) -> DataFrame:
    """``(s, cut)``: the hash below which a source's documents add up to about its budget; sources without a border have none.

    ``slim`` has ``source``, ``size`` and ``h``; ``budgets`` has s and budget,
    of ``n`` sources. The document at the border is taken if that comes nearer
    to the budget.
    """
    state, done = budgets.select("s", F.lit(0).cast("long").alias("prefix"), F.col("budget").cast("double").alias("budget")), None
    for shift in range(BITS, 0, -STEP):
        within = slim.join(_small(state, n), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", shift) == F.col("prefix")))
        hist = within.groupBy("s", "budget", F.shiftright("h", shift - STEP).alias("bucket")).agg(F.sum("size").alias("sum"), F.min("h").alias("lo"), F.max("h").alias("hi"))
        run = F.sum("sum").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        ends = (
            hist.withColumn("run", run).where(F.col("run") > F.col("budget"))
            .groupBy("s").agg(F.min_by(F.struct("bucket", "run", "sum", "lo", "hi", "budget"), "bucket").alias("e"))
            .select("s", "e.*", (F.col("e.budget") - (F.col("e.run") - F.col("e.sum"))).alias("left"))
        )
        ends = stored(ends, "mix-ends")
        border = F.col("lo") == F.col("hi")
        found = ends.where(border).select("s", (F.col("hi") + F.when(F.col("sum") - F.col("left") <= F.col("left"), 1).otherwise(0)).alias("cut"))
        done = found if done is None else done.unionByName(found)
        state = ends.where(~border).select("s", F.col("bucket").alias("prefix"), F.col("left").alias("budget"))
        if state.isEmpty():
            break
    return done


def plan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = WEIGHTS) -> tuple[DataFrame, DataFrame, int]:
    """(a row a document, a row a source, number of sources).

    A document's row: id, source, size, h. A source's: its size, target, whole
    repeats and the threshold for one repeat more. Sources are a table like any
    other; it is broadcast up to ``BROADCAST_SOURCES`` rows.
    """
    slim = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), words_in(text_col).alias("size"), hash_of(id_col, text_col).alias("h")), "mix-sizes")
    sources = stored(weighted(slim.groupBy("source").agg(F.sum("size").alias("size")), weights), "mix-sources")
    n = sources.count()
    whole = F.when(F.col("size") > 0, F.least(F.lit(MOST_REPEATS), F.floor(F.col("target") / F.col("size")))).otherwise(0).cast("long")
    goal = stored(targets(sources).withColumn("whole", whole).withColumn("budget", F.col("target") - F.col("whole") * F.col("size")), "mix-goals")
    full = (F.col("whole") >= MOST_REPEATS) | (F.col("budget") <= 0)
    cut = thresholds(slim, goal.where(~full).select(F.col("source").alias("s"), "budget"), n)
    cuts = goal.join(cut, F.col("source").eqNullSafe(F.col("s")), "left").select(
        F.col("source").alias("__source"), F.col("size").alias("source_size"), "target", F.col("whole").alias("__whole"), F.when(full, 0).otherwise(F.coalesce("cut", F.lit(1 << BITS))).cast("long").alias("__cut")
    )
    return slim, stored(cuts, "mix-cuts"), n


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """``(doc_id, size, source_size, target, taken)`` for every row of ``docs``.

    Null texts have size 0; null is a source of its own, the last. Equal rows
    have equal hashes and are taken together. Reruns take the same rows. An
    empty table gives no rows; other columns are ignored.
    """
    slim, per, n = plan(docs, id_col, text_col, source_col)
    taken = F.col("size") * (F.col("__whole") + (F.col("h") < F.col("__cut")).cast("long"))
    return slim.join(_small(per, n), F.col("source").eqNullSafe(F.col("__source"))).select(F.col("id").alias(id_col), "size", "source_size", "target", taken.alias("taken"))


def mixed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of ``docs`` that the mix takes, all columns, with ``repeats`` (1 to 3) behind them.

    Rows are judged in place, so their texts aren't shuffled.
    """
    _, per, n = plan(docs, id_col, text_col, source_col)
    own = [fresh(docs, x) for x in ("mixsource", "mixwhole", "mixcut")]
    per = per.select(*[F.col(a).alias(b) for a, b in zip(("__source", "__whole", "__cut"), own)])
    repeats = F.col(own[1]) + (hash_of(id_col, text_col) < F.col(own[2])).cast("long")
    both = docs.join(_small(per, n), F.col(source_col).eqNullSafe(F.col(own[0])))
    return both.where(repeats > 0).select(*[docs[c] for c in docs.columns if c != "repeats"], repeats.cast("int").alias("repeats"))
