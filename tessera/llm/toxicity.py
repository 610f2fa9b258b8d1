"""Toxicity by non-negative positive-unlabelled learning.

Positives are confirmed toxic texts; all texts, labelled or not, are
unlabelled. A logistic model over the presence of chosen words and word beginnings minimises

    prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))

where the class prior corrects for the toxic texts among the unlabelled and the
bound at zero keeps the model from fitting unlabelled texts as negatives. The
words are the hash buckets that positives hold most in excess of all texts (a
z-score; the counts of all texts are an aggregate over every row). The prior is
the toxic share of all labelled rows.

The fit itself uses a bounded sample: ``POSITIVES`` labelled ids, and as many
unlabelled rows as an expected ``UNLABELLED``, chosen by hash. How many words
and how many steps it takes is decided inside the training rows: each quarter
of them is left out in turn, and the setting wins that has the highest recall
squared over the number of texts called toxic, which needs no negative labels.
Held-out rows have no part in it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of, first_rows_by_hash, fresh, unit_hash

POSITIVES = 6000
UNLABELLED = 12000
#: Numbers of words and of steps that the inner parts decide between.
FEATURES = (96, 256)
STEPS = (600, 1200, 2400, 3600)
INNER = 4
BUCKETS = 1 << 20
THRESHOLD = 0.7
#: Bytes of the beginnings that count beside whole words.
STEMS = (6, 8)
#: ASCII letters become lower case, other ASCII becomes a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))


@dataclass
class Model:
    words: np.ndarray  # hash buckets, sorted
    weights: np.ndarray
    bias: float


def words_of(text: str | None) -> set[bytes]:
    return set((text or "").lower().encode("utf-8", "surrogatepass").translate(FOLD).split())


def buckets_of_word(word: bytes) -> tuple[int, ...]:
    """The hash buckets of a word and of its longer beginnings."""
    parts = [word, *(b"^" + word[:k] for k in STEMS if len(word) > k)]
    return tuple(xxhash.xxh32_intdigest(p) % BUCKETS for p in parts)


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60, 60)))


def fit(x_pos: np.ndarray, x_unl: np.ndarray, prior: float, c_pos: np.ndarray | None = None, c_unl: np.ndarray | None = None, steps: tuple[int, ...] = (2400,), rate: float = 0.05, decay: float = 3e-5) -> list[tuple[np.ndarray, float]]:
    """Weights and bias that minimise the non-negative risk after each number of ``steps``, by Adam on whole batches.

    Where the negative part of the risk falls below zero, the step goes up its
    gradient instead of down the total, as non-negative learning has it. Rows
    have the weights ``c_pos`` and ``c_unl``.
    """
    d = x_pos.shape[1]
    w, m, v = np.zeros(d + 1), np.zeros(d + 1), np.zeros(d + 1)
    w[d] = np.log(prior / (1 - prior))
    cp = np.ones(len(x_pos)) if c_pos is None else c_pos.astype(float)
    cu = np.ones(len(x_unl)) if c_unl is None else c_unl.astype(float)
    xp, xu, cp, cu, out = np.c_[x_pos, np.ones(len(x_pos))], np.c_[x_unl, np.ones(len(x_unl))], cp / cp.sum(), cu / cu.sum(), []
    for t in range(1, max(steps) + 1):
        sp, su = _logistic(xp @ w), _logistic(xu @ w)
        negative = -(cu @ np.log(1 - su + 1e-12)) + prior * (cp @ np.log(1 - sp + 1e-12))
        grad_neg = (cu * su) @ xu - prior * ((cp * sp) @ xp)
        g = prior * ((cp * (sp - 1)) @ xp) + grad_neg if negative >= 0 else -grad_neg
        g[:d] += decay * w[:d]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        if t in steps:
            out.append((w[:d].copy(), float(w[d])))
    return out


@dataclass
class Sample:
    """Rows of presence, folded by equality: how often each is among positives and among unlabelled texts."""

    x: np.ndarray
    pos: np.ndarray
    unl: np.ndarray

    def fit(self, k: int, prior: float, steps: tuple[int, ...]) -> list[tuple[np.ndarray, float]]:
        p, u = self.pos > 0, self.unl > 0
        return fit(self.x[p, :k], self.x[u, :k], prior, self.pos[p], self.unl[u], steps)


def chosen_setting(parts: list[Sample], prior: float) -> tuple[int, int]:
    """(words, steps) that do best on each part when learned from the others; the smaller ones if nothing tells them apart."""
    caught, called = np.zeros((2, len(FEATURES), len(STEPS)))
    for i, check in enumerate(parts):
        learn = joined(parts[:i] + parts[i + 1 :])
        if not (learn.pos.sum() and learn.unl.sum() and check.unl.sum()):
            continue
        for f, k in enumerate(FEATURES):
            for j, (w, b) in enumerate(learn.fit(k, prior, STEPS)):
                yes = _logistic(check.x[:, :k] @ w + b) >= THRESHOLD
                caught[f, j] += check.pos[yes].sum()
                called[f, j] += check.unl[yes].sum()
    value = caught**2 / np.maximum(called, 1)
    f, j = np.unravel_index(int(value.argmax()), value.shape)
    return FEATURES[f], STEPS[j]


def joined(parts: list[Sample]) -> Sample:
    return Sample(np.concatenate([p.x for p in parts]), np.concatenate([p.pos for p in parts]), np.concatenate([p.unl for p in parts]))


def _counts(rows: DataFrame, wanted: np.ndarray | None = None) -> dict[int, int]:
    """How many texts hold each bucket, and under ``BUCKETS`` how many texts there are; only the wanted ones, if given."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, known = np.zeros(BUCKETS + 1, np.int64), {}
        keep = None if wanted is None else np.isin(np.arange(BUCKETS), wanted)
        for batch in batches:
            for t in batch.column(0):
                sums[_held(t.as_py(), known, keep)] += 1
                sums[BUCKETS] += 1
        at = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(sums[at])], ["bucket", "n"])

    got = rows.select("text").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    return {r.bucket: r.n for r in (got.where("n >= 3") if wanted is None else got).collect()}  # at most BUCKETS rows


def _held(text: str | None, known: dict[bytes, tuple[int, ...]], keep: np.ndarray | None) -> list[int]:
    """Distinct buckets of a text, of those kept; ``known`` remembers words."""
    seen: set[int] = set()
    for word in words_of(text):
        own = known.get(word)
        if own is None:
            if len(known) > 1 << 18:
                known.clear()
            own = known[word] = tuple(b for b in buckets_of_word(word) if keep is None or keep[b])
        seen.update(own)
    return sorted(seen)


def _samples(rows: DataFrame, words: np.ndarray) -> list[Sample]:
    """The inner parts of ``rows(inner, pos, unl, text)``; equal rows are folded in Spark."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = {int(b): i for i, b in enumerate(words)}
        keep, known = np.isin(np.arange(BUCKETS), words), {}
        for batch in batches:
            out = []
            for t in batch.column(3):
                bits = np.zeros(len(words), bool)
                bits[[place[b] for b in _held(t.as_py(), known, keep)]] = True
                out.append(np.packbits(bits).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.binary())], ["inner", "pos", "unl", "bits"])

    got = (
        rows.select("inner", "pos", "unl", "text").mapInArrow(run, "inner int, pos boolean, unl boolean, bits binary")
        .groupBy("inner", "bits").agg(F.count_if("pos").alias("pos"), F.count_if("unl").alias("unl"))
        .orderBy("inner", "bits").collect()
    )
    out = []
    for inner in range(INNER):
        own = [r for r in got if r.inner == inner]
        x = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8))[: len(words)] for r in own], dtype=np.float64).reshape(len(own), len(words))
        out.append(Sample(x, np.array([r.pos for r in own], dtype=np.int64), np.array([r.unl for r in own], dtype=np.int64)))
    return out


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """Learn from ``docs(doc_id, text)`` and ``labels(doc_id, toxic)``.

    A label of a repeated id is its largest; null labels are none. Without a
    toxic label the model gives 0 to every text. Ties between words go to the
    smaller bucket.
    """
    toxic = labels.where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").alias("l_id")).agg(F.max("toxic").alias("l_toxic"))
    share = toxic.agg(F.avg(F.when(F.col("l_toxic") == 1, 1.0).otherwise(0.0)).alias("p")).first()["p"]
    nothing = Model(np.zeros(0, np.int64), np.zeros(0), -60.0)
    if not share:
        return nothing
    prior = min(max(share, 1e-4), 0.9)
    rows = docs.select("doc_id", "text")
    ids = toxic.where("l_toxic = 1").join(rows.select("doc_id"), F.col("l_id") == F.col("doc_id"), "left_semi").select("l_id")
    chosen = F.broadcast(first_rows_by_hash(ids, "l_id", "toxic", POSITIVES))  # at most POSITIVES ids
    p = _counts(rows.join(chosen, F.col("doc_id") == F.col("l_id"), "left_semi"))
    words = np.array(sorted(b for b in p if b < BUCKETS), dtype=np.int64)
    if not len(words):
        return nothing
    u = _counts(rows, words)
    n_pos, n_unl = p[BUCKETS], u[BUCKETS]
    in_pos, in_all = np.array([p[b] for b in words]), np.array([u.get(b, 0) for b in words])
    both = (in_pos + in_all) / (n_pos + n_unl)
    z = (in_pos / n_pos - in_all / n_unl) / np.sqrt(both * (1 - both) * (1 / n_pos + 1 / n_unl) + 1e-12)
    words = words[np.argsort(-z, kind="stable")][: FEATURES[-1]]
    key = F.concat_ws("\0", F.col("doc_id").cast("string"), "text")
    marked = rows.join(chosen, F.col("doc_id") == F.col("l_id"), "left").select(
        F.floor(unit_hash(key, "inner") * INNER).cast("int").alias("inner"), F.col("l_id").isNotNull().alias("pos"), (unit_hash(key, "unlabelled") < min(1.0, UNLABELLED / n_unl)).alias("unl"), "text",
    )
    parts = _samples(marked.where("pos or unl"), words)
    k, steps = chosen_setting(parts, prior)
    every = joined(parts)
    if not every.unl.sum():
        return nothing
    ((weights, bias),) = every.fit(k, prior, (steps,))
    order = np.argsort(words[:k])
    return Model(words[:k][order], weights[order], bias)


def score_texts(docs: DataFrame, model: Model, keep: list[str]) -> DataFrame:
    """The columns ``keep`` with ``score``; whole texts are read, null as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        weight = dict(zip(m.words.tolist(), m.weights.tolist()))
        known, wanted = {}, np.isin(np.arange(BUCKETS), m.words)
        for batch in batches:
            found = (_held(t.as_py(), known, wanted) for t in batch.column(len(keep)))
            out = [float(_logistic(np.float64(m.bias + sum(weight[b] for b in own)))) for own in found]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], [*keep, "score"])

    own = docs.select(*keep, F.col("text").alias(fresh(docs, "text")))
    return own.mapInArrow(run, own.select(*keep).schema.add("score", "double"))


def held_out_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learn labels from rows whose crc32(doc_id) mod 3 isn't 1; score all rows.

    Returns ``doc_id, held_out, score, predicted`` for every row of ``docs``.
    Null and empty texts are scored as texts without words. Repeated rows are
    scored alike; empty tables give no rows, or scores of 0 without labels.
    """
    fold = crc_of("doc_id") % 3
    model = train(docs.where(fold != 1), labels.where(fold != 1))
    out = score_texts(docs, model, ["doc_id"])
    return out.select("doc_id", (fold == 1).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
