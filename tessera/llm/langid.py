"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts n-grams of one to three characters, hashed into ``BUCKETS``,
on a bounded sample of labelled rows (``ROWS_PER_LANG`` expected rows for each
language). Counting is an aggregation; the driver gets one row a language. The
log-probability matrix, ``BUCKETS`` x languages of 32-bit floats, is broadcast;
if there are over ``SLICE`` languages it is made, sent and used slice by slice,
and each text keeps its best of all slices. Scoring turns batches of texts into
sparse bucket numbers and sums matrix entries by text in numpy.
"""

from __future__ import annotations

import sys
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .common import crc_of, fresh, stored, unit_hash

BUCKETS = 1 << 16
ORDERS = (1, 2, 3)
ROWS_PER_LANG = 4000
#: Languages whose matrix is broadcast at once (64 MB).
SLICE = 256
ALPHA = 0.05
#: Code points that are hashed at a time: of several texts, or of a part of a long one. Parts overlap, so no n-gram is lost.
BLOCK = 1 << 18
_MIX = tuple(np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D))


@lru_cache(1)
def _letters() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(c).isalpha() for c in range(sys.maxunicode + 1)), dtype=bool, count=sys.maxunicode + 1)


@dataclass
class Model:
    """Languages in code point order, their log-probabilities (a row a language), and the least mean an n-gram that each accepts."""

    langs: list[str]
    logp: np.ndarray
    least: np.ndarray | None = None


def codes_of(text: str | None) -> np.ndarray | None:
    """Letters in lower case, a space for each run of others and at both ends; nothing if no letter is there."""
    if not text:
        return None
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    letter = _letters()[codes]
    if not letter.any():
        return None
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first of a run of others stays, as a space
    out = np.full(int(keep.sum()) + 2, 32, np.uint32)
    out[1:-1] = np.where(letter, codes, np.uint32(32))[keep]
    return out


def buckets(texts: Iterable[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of texts, where each one's n-grams begin, buckets of the n-grams), for one order and one block after the other."""
    held: list[tuple[int, np.ndarray]] = []
    size = 0
    for i, text in enumerate(texts):
        codes = codes_of(text)
        if codes is None:
            continue
        for at in range(0, len(codes), BLOCK):
            part = codes[at : at + BLOCK + max(ORDERS) - 1]
            if held and size + len(part) > BLOCK:
                yield from _hashed(held)
                held, size = [], 0
            held.append((i, part))
            size += len(part)
    if held:
        yield from _hashed(held)


def _hashed(held: list[tuple[int, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    of, sizes = np.array([i for i, _ in held]), np.array([len(c) for _, c in held])
    codes, first = np.concatenate([c for _, c in held]), np.cumsum(sizes) - sizes
    place = np.arange(len(codes)) - np.repeat(first, sizes)
    for n in ORDERS:
        counts = np.minimum(sizes - n + 1, BLOCK)
        m = len(codes) - n + 1
        if m <= 0:
            continue
        h = np.full(m, n, dtype=np.uint32)
        for i in range(n):
            h = (h ^ codes[i : i + m]) * _MIX[i]
            h ^= h >> np.uint32(15)
        h = (h & np.uint32(BUCKETS - 1))[place[:m] < np.repeat(counts, sizes)[:m]]
        some = counts > 0
        yield of[some], (np.cumsum(counts[some]) - counts[some]), h


def train(docs: DataFrame, rows_per_lang: int = ROWS_PER_LANG) -> Iterator[Model]:
    """Models of all languages in ``docs``, ``SLICE`` languages each, from ``text`` and ``lang``.

    Rows with a null text or lang teach nothing. With no row left there is no
    model. The sample goes by the hash of id and text, and takes the least hash
    of each language at least, so no language goes without rows.
    """
    labelled = docs.where(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", unit_hash(F.concat_ws("\0", "doc_id", "text"), "langid").alias("u"))
    sizes = labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("u").alias("least")).collect()  # a row a language
    sizes.sort(key=lambda r: r["lang"])
    for at in range(0, len(sizes), SLICE):
        yield _slice(labelled, sizes[at : at + SLICE], rows_per_lang)


def _slice(labelled: DataFrame, sizes: list, rows_per_lang: int) -> Model:
    share = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], max(min(1.0, rows_per_lang / r["n"]), r["least"]))])
    sample = labelled.where(F.col("u") <= share[F.col("lang")]).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column(0).to_pylist()
            for of, first, b in buckets(t.as_py() for t in batch.column(1)):
                for i, own in zip(of, np.split(b, first[1:])):
                    sums.setdefault(langs[i], np.zeros(BUCKETS, np.int64))
                    sums[langs[i]] += np.bincount(own, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at])], ["lang", "bucket", "n"])

    rows = (
        sample.mapInArrow(count, "lang string, bucket int, n long")
        .groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
        .groupBy("lang").agg(F.collect_list(F.struct("bucket", "n")).alias("counts"))
        .toPandas()
    )
    langs = sorted(rows["lang"])
    counts = np.full((len(langs), BUCKETS), ALPHA)
    for lang, cells in zip(rows["lang"], rows["counts"]):
        at = np.array([(c["bucket"], c["n"]) for c in cells], dtype=np.int64).reshape(-1, 2)
        counts[langs.index(lang), at[:, 0]] += at[:, 1]
    return Model(langs, np.log(counts / counts.sum(axis=1, keepdims=True)).astype(np.float32))


def totals(texts: list[str | None], logp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums of the n-grams' log-probabilities, texts x languages; numbers of n-grams)."""
    out, n = np.zeros((len(logp), len(texts))), np.zeros(len(texts), np.int64)
    for of, first, b in buckets(texts):
        np.add.at(n, of, np.diff(np.r_[first, len(b)]))
        for row, own in zip(logp, out):
            np.add.at(own, of, np.add.reduceat(row.take(b), first, dtype=np.float64))
    return out.T, n


_BEST = "struct<lang:string,total:double,rest:double,n:long,fits:boolean>"


def best(texts: list[str | None], model: Model) -> list[dict]:
    """For each text the likeliest language of one model, its log-probability, the sum of all languages' against it, and whether the text fits."""
    total, n = totals(texts, model.logp)
    out = []
    for row, size in zip(total, n.tolist()):
        if not size or not len(row):
            out.append({"lang": None, "total": float("-inf"), "rest": 0.0, "n": size, "fits": False})
            continue
        k = int(row.argmax())
        fits = model.least is None or bool(row[k] / size >= model.least[k])
        out.append({"lang": model.langs[k], "total": float(row[k]), "rest": float(np.exp(row - row[k]).sum()), "n": size, "fits": fits})
    return out


def floors(docs: DataFrame, model: Model) -> Model:
    """The model with the mean log-probability an n-gram under which a text isn't its language.

    The posterior only tells learned languages from each other, so a text in
    none of them can have 1. This is half way between the median of all
    labelled rows under their own language and an n-gram drawn evenly from the
    buckets; it doesn't depend on the other languages. Means are rounded to
    thousandths, which bounds the exact median's state.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = sent.value
        at = {x: i for i, x in enumerate(own.langs)}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            names, means = [], []
            for lang in set(langs) & at.keys():
                total, n = totals([t for t, x in zip(texts, langs) if x == lang], own.logp[at[lang] : at[lang] + 1])
                some = n > 0
                names += [lang] * int(some.sum())
                means += np.round(total[some, 0] / n[some], 3).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(means, pa.float64())], ["lang", "mean"])

    rows = docs.where(F.col("text").isNotNull() & F.col("lang").isin(model.langs)).select("lang", "text").mapInArrow(run, "lang string, mean double")
    least = np.full(len(model.langs), -np.inf)
    for r in rows.groupBy("lang").agg(F.median("mean").alias("mid")).collect():
        least[model.langs.index(r.lang)] = (r.mid - np.log(BUCKETS)) / 2
    return Model(model.langs, model.logp, least)


def _finder(sent: Broadcast):
    """``best`` as a function of a text column."""

    @arrow_udf(_BEST)
    def found(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.struct([("lang", pa.string()), ("total", pa.float64()), ("rest", pa.float64()), ("n", pa.int64()), ("fits", pa.bool_())])
        for t in texts:
            yield pa.array(best(t.to_pylist(), sent.value), kind)

    return found


def identify(docs: DataFrame, models: Iterable[Model], names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """All columns of ``docs`` with the language and its score, called ``names``, behind them.

    The score is the language's posterior under equal priors. A null text, an
    empty one and one without letters is ``und`` with score 0, and so is one
    that no language fits (see ``floors``), and every text without models. Texts are
    read whole, in blocks. Ties go to the language that sorts first. Repeated
    rows are scored alike; an empty table gives an empty result. Columns of
    ``docs`` that have one of ``names`` are left out.

    The texts stay in the JVM; Python gives back the scores alone. With more
    than one model the best so far is written after each, so that one matrix at
    a time is broadcast.
    """
    cols = [c for c in docs.columns if c not in names]
    so_far, new = fresh(docs, "best"), fresh(docs, "new")
    rows, before = docs, None
    for model in models:
        if before is not None:
            rows = stored(rows, "langid-best")
            before.destroy()
        before = sent = docs.sparkSession.sparkContext.broadcast(model)

        found = _finder(sent)
        if so_far not in rows.columns:
            rows = rows.withColumn(so_far, found("text"))
        else:
            a, b = F.col(so_far), F.col(new)
            top = F.greatest(a["total"], b["total"])
            rest = a["rest"] * F.exp(a["total"] - top) + b["rest"] * F.exp(b["total"] - top)
            win = F.when(b["total"] > a["total"], b).otherwise(a)
            both = F.struct(win["lang"].alias("lang"), top.alias("total"), rest.alias("rest"), a["n"].alias("n"), win["fits"].alias("fits"))
            rows = rows.withColumn(new, found("text")).withColumn(so_far, F.when(a["n"] == 0, a).otherwise(both)).drop(new)
    if before is None:
        return docs.select(*cols, F.lit("und").alias(names[0]), F.lit(0.0).alias(names[1]))
    x = F.col(so_far)
    known = (x["n"] > 0) & x["fits"] & x["lang"].isNotNull()
    return rows.select(*cols, F.when(known, x["lang"]).otherwise("und").alias(names[0]), F.when(known, 1.0 / x["rest"]).otherwise(0.0).alias(names[1]))


def held_out_identify(docs: DataFrame) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod 5 isn't 0; predict all rows."""
    fold = crc_of("doc_id") % 5
    models = train(docs.where(fold != 0))
    return identify(docs.select("doc_id", "text"), models).select("doc_id", (fold == 0).alias("held_out"), "lang_pred", "score")
