"""Token counts by prefix dynamic programming over byte-level BPE.

For a text ``t``, the prefix counts hold the exact number of tokens of ``t[:p]``
for every p. Truncation and budget questions ("how many tokens has t[:p]?",
"which is the longest prefix within n tokens?") are then array lookups.

A pattern splits text into pieces, and merges act inside a piece. For one
piece, ``count[p] = count[p - len(last)] + 1``: the last token of a prefix is
the only token that may follow the last token of what stands before it, and two
tokens may follow each other if merging their bytes gives the two back. Pieces
repeat, so their prefix counts are kept, and a text's counts are those of its
pieces plus a running sum. New pieces of many texts are worked through in
sorted order, so that what two of them begin with alike is done once. Two
prefixes need care: one that ends after the
first character of a piece behind white space (the white space is then one
piece), and one that ends inside a special string (ordinary text until then).
"""

from __future__ import annotations

import json
from array import array
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LIMIT = 1024
VOCABULARY = "byte_bpe_50k.json"
#: How byte-level BPE splits text: a fixed value of the vocabulary file's format.
PATTERN = regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")
CONTRACTIONS = frozenset(["'s", "'t", "'re", "'ve", "'m", "'ll", "'d"])
#: Pieces, pairs of tokens and steps of the automaton that a worker remembers.
MEMO = 1 << 18
#: Code points of texts that are worked on together; longer texts are cut where white space follows something else.
BLOCK = 1 << 21
#: Bytes up to which a piece may share its beginning with others.
SHORT = 256
CUT = regex.compile(r"(?<=\S)\s")


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_names() -> dict[str, int]:
    """The characters by which the vocabulary file writes bytes: printable ones by themselves, others from 256 on."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class PrefixCounter:
    """Exact token counts of all prefixes, for one vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        names = _byte_names()
        raw = lambda s: bytes(names[c] for c in s)
        # Tokens are numbered in the order in which merges make them, bytes first.
        self.number = {bytes([b]): b for b in range(256)}
        self.halves: list[tuple[int, int]] = [(b, b) for b in range(256)]
        self.joined: dict[tuple[int, int], int] = {}
        for a, b in spec["model"]["merges"]:
            a, b = raw(a), raw(b)
            pair = self.number[a], self.number[b]
            if a + b in self.number:  # made by an earlier merge already
                self.joined.setdefault(pair, len(self.halves))
                self.halves.append(pair)
                continue
            self.number[a + b] = self.joined[pair] = len(self.halves)
            self.halves.append(pair)
        # What tokens begin with: the states of an automaton that reads a piece.
        self.heads = {t[:i] for t in self.number for i in range(len(t) + 1)}
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.memo: dict[str, bytes | np.ndarray] = {}
        # States are numbered as they are met; a step's key is its state and the next byte.
        self.states: dict[bytes, int] = {b"": 0}
        self.names: list[bytes] = [b""]
        self.steps: dict[int, tuple[int, tuple]] = {}
        self.after: dict[int, dict[int, bool]] = {}  # by a token, whether it may follow another one
        self.pairs = 0

    def _apart(self, a: int, b: int) -> bool:
        """Whether merging leaves token a and then token b as they are.

        The later merge of the two is undone step by step, on the sides that
        touch; if a merge across the border exists that comes before the one
        undone, it would have been made first.
        """
        halves, joined = self.halves, self.joined
        # A merge across the border counts from "since" on only if its rank is lower.
        left, right, since = a, b, len(halves)
        while True:
            across = joined.get((left, right))
            if across is not None and across < since:
                return False
            splits_left, splits_right = left >= 256, right >= 256
            if not splits_left and not splits_right:
                return True
            # Merges run in order of rank and, at one rank, from the left: undo the last one made.
            if splits_left and (not splits_right or left > right):
                since, left = left, halves[left][1]
            else:
                since, right = right + 1, halves[right][0]

    def _step(self, key: int) -> tuple[int, tuple]:
        """(the next state, the tokens that it ends with), from a state and the next byte.

        A state is the longest end of what was read that some token begins
        with. A token is its length, its number and what is known of it in
        ``after``; the longest comes first.
        """
        if len(self.steps) >= MEMO:
            self.steps.clear()
        x, i = self.names[key >> 8] + bytes([key & 255]), 0
        while x[i:] not in self.heads:
            i += 1
        x = x[i:]
        state = self.states.setdefault(x, len(self.names))
        if state == len(self.names):
            self.names.append(x)
        ends = []
        for j in range(len(x)):
            t = self.number.get(x[j:])
            if t is not None:
                ends.append((len(x) - j, t, self.after.setdefault(t, {})))
        got = self.steps[key] = state, tuple(ends)
        return got

    def _extend(self, raw: bytes, at: int, counts, last, states) -> None:
        """Append, for each byte from ``at`` on, the prefix's count, last token and state.

        Each prefix ends with the only token that may follow the last token of
        what stands before it.
        """
        state, steps, p = states[-1], self.steps, at
        for byte in raw[at:]:
            key = state << 8 | byte
            state, ends = steps.get(key) or self._step(key)
            p += 1
            for n, t, after in ends:
                if n == p:
                    counts.append(1)
                    last.append(t)
                    break
                a = last[p - n]
                ok = after.get(a)
                if ok is None:
                    if self.pairs >= MEMO:
                        for known in self.after.values():
                            known.clear()
                        self.pairs = 0
                    ok = after[a] = self._apart(a, t)
                    self.pairs += 1
                if ok:
                    counts.append(counts[p - n] + 1)
                    last.append(t)
                    break
            states.append(state)

    def learn(self, pieces: Iterable[str], keep: bool = False) -> None:
        """Remember the prefix counts of these pieces, each worked on once; older pieces go if there are too many, unless they are to be kept."""
        memo = self.memo
        fresh = sorted(s for s in pieces if s not in memo)
        if len(memo) + len(fresh) > MEMO and not keep:
            self.memo = memo = {s: memo[s] for s in pieces if s in memo}
        before, counts, last, states = b"", [0], [-1], [0]
        for s in fresh:
            raw = s.encode("utf-8", "surrogatepass")
            if len(raw) > SHORT:
                far = array("i", [0])
                self._extend(raw, 0, far, array("i", [-1]), deque([0], 1))
                own = np.frombuffer(far, np.int32)[1:]
                if len(raw) > len(s):
                    follow = np.frombuffer(raw, np.uint8)[1:]
                    own = own[np.r_[follow & 0xC0 != 0x80, True]]
                memo[s] = own.astype(np.uint8).tobytes() if own[-1] < 256 else own
                continue
            n, at = min(len(before), len(raw)), 0
            while at < n and before[at] == raw[at]:
                at += 1
            del counts[at + 1 :], last[at + 1 :], states[at + 1 :]
            self._extend(raw, at, counts, last, states)
            before, own = raw, counts[1:]
            if len(raw) > len(s):  # only prefixes that end with a character
                own = [n for n, follow in zip(own, raw[1:] + b"a") if follow & 0xC0 != 0x80]
            memo[s] = bytes(own) if own[-1] < 256 else np.array(own, dtype=np.int32)
        for s in CONTRACTIONS.intersection(fresh):  # cut short, they are an apostrophe and letters
            own = list(memo[s])
            for j in range(1, len(s)):
                own[j - 1] = sum(int(self.piece(x)[-1]) for x in PATTERN.findall(s[:j]))
            memo[s] = bytes(own)

    def piece(self, s: str) -> bytes | np.ndarray:
        """Counts of the prefixes of one piece, from one character to all; as bytes where they fit."""
        if s not in self.memo:
            self.learn([s], keep=True)
        return self.memo[s]

    def _sum(self, pieces: list[str]) -> np.ndarray:
        """Counts of the prefixes of pieces that follow each other, from one character on."""
        if not pieces:
            return np.zeros(0, np.int64)
        try:
            own = list(map(self.memo.__getitem__, pieces))
        except KeyError:  # another text's pieces have taken their place
            self.learn(dict.fromkeys(pieces), keep=True)
            own = list(map(self.memo.__getitem__, pieces))
        sizes = np.fromiter(map(len, own), np.int64, len(own))
        joined = b"".join(own)
        if len(joined) == sizes.sum():
            out = np.frombuffer(joined, np.uint8).astype(np.int64)
        else:  # some counts don't fit a byte
            out = np.concatenate([np.frombuffer(x, np.uint8) if type(x) is bytes else x for x in own]).astype(np.int64)
        ends = np.cumsum(sizes)
        whole = out[ends - 1]
        base = np.cumsum(whole) - whole
        out += np.repeat(base, sizes)
        blank = np.fromiter(map(str.isspace, pieces), bool, len(pieces))
        for i in (np.flatnonzero(blank[:-1]) + 1).tolist():
            size = int(sizes[i])
            if pieces[i][0].isspace() and (size > 1 or i + 1 < len(pieces)):
                out[ends[i] - size] = base[i - 1] + int(self.piece(pieces[i - 1] + pieces[i][0])[-1])
        return out

    def _blocks(self, text: str) -> Iterator[np.ndarray]:
        """Counts of the prefixes of a text without special strings, block by block.

        A block begins where white space follows something else: no piece
        crosses such a place, and none looks beyond it.
        """
        at, total = 0, 0
        while at < len(text):
            cut = CUT.search(text, at + BLOCK) if len(text) - at > BLOCK else None
            end = cut.start() if cut else len(text)
            pieces = PATTERN.findall(text, at, end) if at or cut else PATTERN.findall(text)
            self.learn(dict.fromkeys(pieces))
            part = self._sum(pieces) + total
            yield part
            total, at = int(part[-1]), end

    def parts(self, text: str | None) -> Iterator[np.ndarray]:
        """The counts of ``counts`` in parts that follow each other."""
        text = text or ""
        yield np.zeros(1, np.int64)
        at, total = 0, 0
        for m in self.special.finditer(text) if self.special else ():
            near = np.concatenate(list(self._blocks(text[at : m.end()]))) + total  # as long as the special string isn't whole
            total = 1 + (int(near[m.start() - at - 1]) if m.start() > at else total)
            near[-1] = total
            yield near
            at = m.end()
        for block in self._blocks(text[at:] if at else text):
            yield block + total if total else block

    def counts(self, text: str | None) -> np.ndarray:
        """counts[p] = tokens of text[:p], for p from 0 to the number of code points."""
        return np.concatenate(list(self.parts(text)))

    def many(self, texts: list[str | None]) -> Iterator[Iterator[np.ndarray]]:
        """The ``parts`` of each text; pieces that these texts share are worked on once."""
        plain = [t if t and len(t) <= BLOCK and not (self.special and self.special.search(t)) else None for t in texts]
        split = [PATTERN.findall(t) if t else None for t in plain]
        self.learn(dict.fromkeys(s for own in split if own for s in own))
        for t, own in zip(texts, split):
            yield self.parts(t) if own is None else iter((np.zeros(1, np.int64), self._sum(own)))


def groups(column: pa.Array) -> Iterator[list[str | None]]:
    """The values of a text column in lists of about ``BLOCK`` code points."""
    own, size = [], 0
    for t in column:
        t = t.as_py()
        own.append(t)
        size += len(t or "")
        if size >= BLOCK:
            yield own
            own, size = [], 0
    if own:
        yield own


@lru_cache(4)
def counter(path: str) -> PrefixCounter:
    return PrefixCounter(path)


def within(counts: np.ndarray, budget: int) -> int:
    """The longest prefix, in code points, that has at most ``budget`` tokens."""
    return int(np.flatnonzero(np.asarray(counts) <= budget)[-1])


def prefix_table(docs: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, prefix_tokens)``: exact token counts at every prefix of every text.

    Null and empty texts have the array [0]. Repeated rows give repeated rows,
    an empty table none; other columns are ignored. ``path`` names the
    vocabulary file on every executor.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            at = 0
            for texts in groups(batch.column(1)):
                for i, parts in enumerate(own.many(texts), at):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([np.concatenate(list(parts))], pa.list_(pa.int32()))], ["id", "prefix_tokens"])
                at += len(texts)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t"))
    return rows.mapInArrow(run, f"id {kind}, prefix_tokens array<int>").withColumnRenamed("id", id_col)


def count_tokens(docs: DataFrame, path: str | None = None, limit: int = LIMIT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, n_tokens, over_limit)`` for every row: the last of the prefix counts.

    The counts at all prefixes are made and answered from on the executor,
    block by block for a long text, and aren't moved. Null counts as empty: no bytes and no tokens. Rows, empty
    tables and other columns are as in ``prefix_table``.
    """
    path = path or vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(path)
        for batch in batches:
            n = [int(deque(parts, 1)[0][-1]) for texts in groups(batch.column(2)) for parts in own.many(texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(n, pa.int64())], ["id", "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("t"))
    out = rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")
    return out.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
