"""Feature-hash vectors: counts of hashed tokens, character trigrams and pairs of neighbours."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Weights of a token, of each of its trigrams and of a pair of neighbours, in hundredths. Fixed values.
TOKEN, TRIGRAM, PAIR = 100, 35, 80
#: Tokens that one step works through (a longer text is one step), and hashed features that a task keeps.
STEP, KEPT = 1 << 20, 1 << 20
_SYNONYM = {w: name for name, words in reversed(T.SYNONYMS.items()) for w in words}


def bucket(feature: bytes, buckets: int) -> int:
    """A feature's bucket: the first two bytes of its MD5."""
    d = hashlib.md5(feature).digest()
    return (d[0] << 8 | d[1]) % buckets


def canonical(token: str) -> str:
    """``text.canonical_token`` of one token."""
    own = _SYNONYM.get(token, token)
    n = len(own.encode())
    return next((own[: -len(s)] for s in ("ing", "ed", "es", "s") if own.endswith(s) and n > 4 and n - len(s) >= 3), own)


def token_buckets(token: str, buckets: int, kept: dict[str, int]) -> list[int]:
    """The bucket of a token, then those of its trigrams."""
    out = [bucket(canonical(token).encode(), buckets)]
    for i in range(max(1, len(token) - 2)):
        gram = token[i : i + 3]
        if gram not in kept:
            kept[gram] = bucket(b"tri:" + gram.encode(), buckets)
        out.append(kept[gram])
    return out


def _weights(codes: np.ndarray, words: list[str], sizes: np.ndarray, buckets: int, kept: dict[str, int]) -> np.ndarray:
    """A row of buckets for each text; ``sizes`` has the texts' numbers of tokens. Each token and pair is hashed once."""
    used, codes = np.unique(codes, return_inverse=True)
    own = [words[i] for i in used]
    row = np.repeat(np.arange(len(sizes)), sizes)
    hashed = [token_buckets(w, buckets, kept) for w in own]
    many = np.array([len(h) for h in hashed], np.int64)
    start, flat = np.cumsum(many) - many, np.fromiter((x for h in hashed for x in h), np.int64)
    cells, times = np.unique(row * len(own) + codes, return_counts=True)
    r, c = np.divmod(cells, len(own))
    n = many[c]
    first = np.cumsum(n) - n
    place = np.arange(n.sum()) - np.repeat(first, n)
    weight = np.where(place == 0, TOKEN, TRIGRAM) * np.repeat(times, n)
    out = np.bincount(np.repeat(r * buckets, n) + flat[np.repeat(start[c], n) + place], weight, len(sizes) * buckets)
    same = row[:-1] == row[1:]
    pairs, at = np.unique((codes[:-1] * len(own) + codes[1:])[same], return_inverse=True)
    if len(pairs):
        raw, ids = [w.encode() for w in own], zip(*(x.tolist() for x in np.divmod(pairs, len(own))))
        met = np.array([bucket(b"bi:" + raw[x] + b" " + raw[y], buckets) for x, y in ids], np.int64)
        out += PAIR * np.bincount(row[1:][same] * buckets + met[at], minlength=len(out))
    return out.astype(np.int64).reshape(len(sizes), buckets)


def hashed_weights(rows: DataFrame, key: str, tokens: Column, buckets: int = 64) -> DataFrame:
    """``(key, weights)``: weights in hundredths of all buckets, of each key with tokens.

    A row's tokens become one row of buckets where it is read, and each token and pair is
    hashed once in a step, so nothing is shuffled but a row of sums for each key.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, int] = {}
        for b in batches:
            column = b.column(1)
            coded = column.flatten().dictionary_encode()
            words, codes, sizes = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64), np.diff(column.offsets.to_numpy()).astype(np.int64)
            ends = np.cumsum(sizes)
            cuts = [0, *(1 + np.flatnonzero(np.diff(ends // STEP))).tolist(), len(sizes)]
            for a, z in zip(cuts, cuts[1:]):
                if len(kept) > KEPT:
                    kept.clear()
                if z > a:
                    own = _weights(codes[ends[a] - sizes[a] : ends[z - 1]], words, sizes[a:z], buckets, kept)
                    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, buckets), pa.int32()), pa.array(own.ravel()))
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), flat], ["k", "w"])

    some = rows.select(F.col(key).alias("k"), tokens.alias("t")).where(F.size("t") > 0)
    counted = some.mapInArrow(count, some.select("k", F.array(F.lit(0).cast("long")).alias("w")).schema)
    sums = counted.groupBy("k").agg(*[F.sum(F.get("w", F.lit(i))).alias(f"w{i}") for i in range(buckets)])
    return sums.select(F.col("k").alias(key), F.array(*[f"w{i}" for i in range(buckets)]).alias("weights"))
