"""Least-cost repair of the role structure of conversations.

A repaired conversation's role initials are nothing, or user and assistant in
turn behind at most one system row: ``(s?(ua)+)?``. An edit script keeps,
reroles or deletes each row and inserts rows with empty text anywhere. Scripts are the paths of
a graph whose nodes are (rows read, state of that pattern). Forward and
backward minimum costs tell which arcs are tight, that is, on a cheapest path;
from the start, the set of nodes that the least string so far can have reached
moves on along the tight arcs of the least letter.

A conversation of any length is split: rows are sorted by range, so a long
one lies in many partitions as pieces. A piece's costs between its borders are a 4 x 4
matrix, which is associative under (min, +). The matrices, one row a piece, are folded into
the forward costs at each piece's start and the backward ones at its end, and then
every piece finds its tight arcs by itself. Texts stay out of all this: they are joined by row number
when scripts are applied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc_of, stored

SPACE = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated row that stays.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: Initials that the pattern knows; a row of another one can't be kept.
INITIALS = "sua"
#: States: nothing yet, behind the system row, behind a user row, behind an assistant row. A script ends in ENDS.
STATES, ENDS = range(4), (0, 3)
#: Where a kept row's initial leads from each state, and where a user or assistant row that the state wants does.
KEPT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
WANTED = (2, 2, 3, 2)
#: Faults of rows. Blank and duplicate ones can't stay.
FAULTS = ("", "truncated", "blank", "duplicate")
CUT_SHORT, DOOMED = 1, 2
#: Which initials may follow each other, by their places in INITIALS: su, ua and au.
LEGAL = np.zeros((4, 4), bool)
LEGAL[[1, 2, 3], [2, 3, 2]] = True
NEVER = float("inf")
#: Roles of inserted and reroled rows, as scripts write them.
WRITTEN = {"u": "user", "a": "assistant"}
#: Leading characters that order rows of one turn; behind them the hash does.
HEAD = 64
START = (0, NEVER, NEVER, NEVER)
Vector = tuple[float, float, float, float]


def code_of(initial: str, fault: str = "") -> int:
    """A row as one byte: its initial's place in INITIALS, from 1 (another one: 0), and its fault."""
    return (INITIALS.find(initial) + 1 if initial else 0) * 4 + FAULTS.index(fault)


@lru_cache(64)
def arcs(code: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of the edits that read a row."""
    kind, fault = divmod(code, 4)
    out = [("D", DELETE, state)]
    if fault < DOOMED:
        if kind and INITIALS[kind - 1] in KEPT[state]:
            out.append(("K", KEEP + TRUNCATED * fault, KEPT[state][INITIALS[kind - 1]]))
        out.append(("R", REROLE + TRUNCATED * fault, WANTED[state]))
    return tuple(out)


@lru_cache(1 << 16)
def inserted(v: Vector) -> Vector:
    """Forward costs with inserted rows."""
    w = list(v)
    w[2] = min(v[2], min(v[0], v[1], v[3]) + INSERT)
    w[3] = min(v[3], w[2] + INSERT)
    return tuple(w)


@lru_cache(1 << 16)
def ahead(v: Vector) -> Vector:
    """Backward costs with inserted rows."""
    w = list(v)
    w[2] = min(v[2], v[3] + INSERT)
    for s in (0, 1, 3):
        w[s] = min(v[s], w[2] + INSERT)
    return tuple(w)


@lru_cache(1 << 16)
def forward(v: Vector, code: int) -> tuple[float, Vector]:
    """Costs behind a row from those before it, as an offset and a vector whose least is 0."""
    own, out = inserted(v), [NEVER] * 4
    for s in STATES:
        for _, cost, to in arcs(code, s):
            out[to] = min(out[to], own[s] + cost)
    low = min(out)
    return low, tuple(x - low for x in out)


@lru_cache(1 << 16)
def backward(v: Vector, code: int) -> tuple[float, Vector]:
    """Costs from before a row to the end, inserted rows included, as an offset and a vector."""
    own = ahead(tuple(min(cost + v[to] for _, cost, to in arcs(code, s)) for s in STATES))
    low = min(own)
    return low, tuple(x - low for x in own)


def transfer(codes: bytes) -> list[list[float]]:
    """The cost from each state before the rows to each one behind them."""
    out = []
    for s in STATES:
        at, v = 0.0, tuple(0 if t == s else NEVER for t in STATES)
        for c in codes:
            low, v = forward(v, c)
            at += low
        out.append([at + x for x in v])
    return out


_transfer = lru_cache(4096)(transfer)


def end_costs() -> Vector:
    return ahead(tuple(0 if s in ENDS else NEVER for s in STATES))


def through(v: Vector, matrix: list[list[float]]) -> Vector:
    return tuple(min(v[s] + matrix[s][t] for s in STATES) for t in STATES)


def before(matrix: list[list[float]], v: Vector) -> Vector:
    """Backward costs at a piece's start: inserted rows before its first one are in the matrix already."""
    return tuple(min(matrix[s][t] + v[t] for t in STATES) for s in STATES)


def scripts(codes: bytes, costs_in: Vector, costs_out: Vector, last: bool) -> dict[int, tuple[int, str, str]]:
    """By entry state on a cheapest path: (exit state, least letters, roles of inserted and reroled rows as u or a, else a dash).

    ``costs_in`` are forward costs at the start without rows inserted there, ``costs_out`` backward ones at the end.
    """
    n = len(codes)
    fore, back = [(0.0, costs_in)], [(0.0, costs_out)]
    for c in codes:
        low, v = forward(fore[-1][1], c)
        fore.append((fore[-1][0] + low, v))
    for c in reversed(codes):
        low, v = backward(back[-1][1], c)
        back.append((back[-1][0] + low, v))
    back.reverse()
    cost_to = lambda i, s: fore[i][0] + inserted(fore[i][1])[s]
    cost_on = lambda i, s: back[i][0] + back[i][1][s]
    best = min(costs_in[s] + cost_on(0, s) for s in STATES)

    def tight(node: tuple[int, int]) -> Iterator[tuple[str, tuple[int, int], str]]:
        i, s = node
        if i < n or last:
            own = cost_to(i, s)
            if own + INSERT + cost_on(i, WANTED[s]) == best:
                yield "I", (i, WANTED[s]), "u" if WANTED[s] == 2 else "a"
            if i < n:
                for letter, cost, to in arcs(codes[i], s):
                    if own + cost + cost_on(i + 1, to) == best:
                        yield letter, (i + 1, to), ("u" if to == 2 else "a") if letter == "R" else "-"

    out = {}
    for entry in STATES:
        if costs_in[entry] + cost_on(0, entry) != best or costs_in[entry] == NEVER:
            continue
        reached, letters, roles = {(0, entry)}, [], []
        while options := [x for node in reached for x in tight(node)]:
            letter = min(x[0] for x in options)
            chosen = [x for x in options if x[0] == letter]
            reached = {x[1] for x in chosen}
            letters.append(letter)
            roles.append(chosen[0][2])  # a node and a letter lead to one node, so there is one
        out[entry] = (min(s for _, s in reached), "".join(letters), "".join(roles))
    return out


_scripts = lru_cache(4096)(scripts)


def damaged(conversations: DataFrame) -> DataFrame:
    """Conversations with faults put in by the hash of ``conv_id:turn``: rows dropped, emptied, without ends, repeated, or given to the user.

    Null roles and texts are one space, as are null ids and turns in the hash.
    """
    word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    act = crc_of(F.concat(word("conv_id"), F.lit(":"), word("turn"))) % 20
    rows = conversations.select("conv_id", "turn", word("role").alias("role"), word("text").alias("text"), act.alias("act")).where("act <> 0")
    text = F.when(F.col("act") == 1, "").when(F.col("act") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    role = F.when(F.col("act") == 4, "user").otherwise(F.col("role"))
    times = F.array_repeat(F.lit(0), F.when(F.col("act") == 3, 2).otherwise(1))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(times).alias("_")).drop("_")


def numbered(turns: DataFrame) -> DataFrame:
    """Rows of ``turns(conv_id, turn, role, text)`` with a number ``rid`` and what repair looks at, written once."""
    shown = F.rtrim(F.col("text"), F.lit(SPACE))
    initial = F.substring("role", 1, 1)
    kind = F.coalesce(F.array_position(F.array(*[F.lit(c) for c in INITIALS]), initial), F.lit(0)).cast("int")
    key = F.unhex(F.md5(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")).cast("binary")))
    return stored(
        turns.select(
            F.col("conv_id").alias("conv"), "turn", "role", "text", key.alias("key"), F.substring("role", 1, HEAD).alias("role_head"), F.substring("text", 1, HEAD).alias("text_head"),
            kind.alias("kind"), (shown == "").alias("blank"), (~F.substring(shown, -1, 1).isin(".", "!", "?")).alias("open"), F.monotonically_increasing_id().alias("rid"),
        ),
        "dialogues-rows",
    )


def pieces(rows: DataFrame) -> DataFrame:
    """``(conv, seg, rows, pid)``: each conversation's rows in order, a piece for each partition that it lies in.

    Rows go by turn, nulls first, then by role and text (their first ``HEAD`` characters, then a hash).
    A row number breaks the ties of equal rows, so neither a long conversation nor copies in it make a hot partition.
    A role and text that stood earlier in the conversation are found by a minimum of each, not by gathering them.
    """
    order = ["conv", "turn", "role_head", "text_head", "key", "rid"]
    by = rows.select(*order, "kind", "blank", "open").repartitionByRange(*order).sortWithinPartitions(*order)
    placed = stored(by.select("conv", "turn", "key", "rid", "kind", "blank", "open", F.monotonically_increasing_id().alias("place")), "dialogues-placed")
    again = placed.groupBy("conv", "key").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv").alias("c"), F.col("key").alias("k"), "first")
    met = placed.join(again, F.col("conv").eqNullSafe(F.col("c")) & (F.col("key") == F.col("k")), "left")
    fault = F.when(F.col("blank"), 2).when(F.col("place") > F.col("first"), 3).when(F.col("open"), 1).otherwise(0)
    own = met.select("conv", F.shiftright("place", 33).alias("seg"), F.struct("place", "rid", "turn", (F.col("kind") * 4 + fault).cast("byte").alias("code")).alias("row"))
    cut = own.groupBy("conv", "seg").agg(F.sort_array(F.collect_list("row")).alias("rows"))
    return stored(cut.withColumn("pid", F.monotonically_increasing_id()), "dialogues-pieces")


def _rows(batch: pa.RecordBatch) -> Iterator[dict[str, np.ndarray]]:
    """The rows of each piece of a batch as arrays; turns are in order, without nulls."""
    column = batch.column(batch.schema.get_field_index("rows"))
    edges, struct = column.offsets.to_numpy(), column.values
    whole = {k: struct.field(k).to_numpy(zero_copy_only=False) for k in ("place", "rid", "code")}
    for lo, hi in zip(edges[:-1], edges[1:]):
        yield {k: v[lo:hi] for k, v in whole.items()} | {"turn": struct.field("turn").slice(lo, hi - lo).drop_null().to_numpy()}


_SUMMARY = "pid long, matrix array<double>, blank long, duplicate long, truncated long, illegal long, kind_in int, kind_out int, turns long, turn_in long, turn_out long"


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A piece as one small row: its matrix, its counts and its borders."""
    fields = [("matrix", pa.list_(pa.float64())), *[(k, pa.int64()) for k in ("blank", "duplicate", "truncated", "illegal")], ("kind_in", pa.int32()), ("kind_out", pa.int32()), ("turns", pa.int64()), ("turn_in", pa.int64()), ("turn_out", pa.int64())]
    for batch in batches:
        out = []
        for conv, seg, pid, p in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), _rows(batch)):
            kind, fault, turn = p["code"] // 4, p["code"] % 4, p["turn"]
            counts = {f: int((fault == i).sum()) for i, f in enumerate(FAULTS) if f}
            matrix = [x for line in _transfer(p["code"].tobytes()) for x in line]
            ends = {"kind_in": kind[0], "kind_out": kind[-1], "turn_in": turn[0] if len(turn) else None, "turn_out": turn[-1] if len(turn) else None}
            distinct = int((turn[1:] != turn[:-1]).sum()) + 1 if len(turn) else 0
            out.append({"conv": conv, "seg": seg, "pid": pid, "matrix": matrix, **counts, "illegal": int((~LEGAL[kind[:-1], kind[1:]]).sum()), "turns": distinct, **ends})
        yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("conv"), batch.schema.field("seg"), batch.schema.field("pid"), *fields]))


def _fold(parts: list[dict]) -> dict:
    """A conversation's measures, and each piece's costs at its borders."""
    m = [[p["matrix"][4 * s : 4 * s + 4] for s in STATES] for p in parts]
    fore, back = [START], [end_costs()]
    for x in m:
        fore.append(through(fore[-1], x))
    for x in reversed(m):
        back.append(before(x, back[-1]))
    back.reverse()
    out = {k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated", "illegal")}
    out["illegal"] += sum(not LEGAL[a["kind_out"], b["kind_in"]] for a, b in zip(parts, parts[1:]))
    told = [p for p in parts if p["turn_in"] is not None]
    distinct = sum(p["turns"] for p in told) - sum(a["turn_out"] == b["turn_in"] for a, b in zip(told, told[1:]))
    out["gaps"] = told[-1]["turn_out"] - told[0]["turn_in"] + 1 - distinct if told else 0
    out["cost"] = int(back[0][0])
    low = lambda v: [x - min(v) for x in v]
    borders = zip(parts, fore, back[1:])
    out["borders"] = [{"id": p["pid"], "costs_in": low(f), "costs_out": low(b), "last": p is parts[-1]} for p, f, b in borders]
    return out


_MEASURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
_BORDER = pa.struct([("id", pa.int64()), ("costs_in", pa.list_(pa.float64())), ("costs_out", pa.list_(pa.float64())), ("last", pa.bool_())])


def _measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        schema = pa.schema([batch.schema.field("conv"), *[(k, pa.int64()) for k in _MEASURES], ("borders", pa.list_(_BORDER))])
        yield pa.RecordBatch.from_pylist([{"conv": r["conv"], **_fold(r["parts"])} for r in batch.to_pylist()], schema)


def _ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The scripts of each piece, one for every entry state on a cheapest path."""
    for batch in batches:
        out = []
        for p, rows in zip(batch.drop_columns(["rows"]).to_pylist(), _rows(batch)):
            found = _scripts(rows["code"].tobytes(), tuple(p["costs_in"]), tuple(p["costs_out"]), p["last"])
            out += [{"conv": p["conv"], "seg": p["seg"], "pid": p["pid"], "entry": e, "exit": x, "letters": t, "roles": r} for e, (x, t, r) in found.items()]
        yield pa.RecordBatch.from_pylist(out, pa.schema([batch.schema.field("conv"), batch.schema.field("seg"), batch.schema.field("pid"), ("entry", pa.int32()), ("exit", pa.int32()), ("letters", pa.string()), ("roles", pa.string())]))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each piece's entry state, as the pieces before it leave theirs."""
    for batch in batches:
        ids, entries = [], []
        for r in batch.column(0).to_pylist():
            ways = {(w["pid"], w["entry"]): w["exit"] for w in r}
            state = 0
            for pid in dict.fromkeys(w["pid"] for w in r):
                ids.append(pid)
                entries.append(state)
                state = ways[pid, state]
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(entries, pa.int32())], ["id", "at"])


def _edits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of the repaired conversation: kept and reroled ones by number, inserted ones before or behind them."""
    names = ["conv", "place", "sub", "edit", "new_role", "id"]
    for batch in batches:
        of, place, sub, edit, role, ids, none = ([] for _ in range(7))
        for i, (letters, roles, rows) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), _rows(batch))):
            codes = np.frombuffer(letters.encode(), np.uint8)
            new = codes == ord("I")
            row = np.cumsum(~new) - ~new  # rows read before each edit
            at = np.minimum(row, len(rows["code"]) - 1)
            first = np.searchsorted(row, np.arange(len(rows["code"]) + 1))
            some = np.flatnonzero(codes != ord("D"))
            of.append(np.full(len(some), i))
            place.append(rows["place"][at[some]])
            sub.append((np.arange(len(codes)) - first[at])[some])  # rows inserted at the end stand behind the last one
            ids.append(rows["rid"][at[some]])
            none.append(new[some])
            edit += [letters[k] for k in some]
            role += [WRITTEN.get(roles[k]) for k in some]
        if of:
            whole = [np.concatenate(x).astype(np.int64) for x in (of, place, sub, ids)]
            conv = batch.column(0).take(pa.array(whole[0]))
            yield pa.RecordBatch.from_arrays([conv, pa.array(whole[1]), pa.array(whole[2]), pa.array(edit, pa.string()), pa.array(role, pa.string()), pa.array(whole[3], mask=np.concatenate(none))], names)


class Repair:
    """Repaired conversations of ``turns(conv_id, turn, role, text)``.

    Null roles and texts are one space. ``measures`` has a row for each conversation with rows, with
    its faults, its gaps in the turns and the least cost; ``audit`` has the edits' letters; ``rows`` the repaired
    rows in order of (place, sub). Rows of one turn go by role and text. A null id is a conversation of its own. An empty table gives no rows.
    """

    def __init__(self, turns: DataFrame):
        word = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
        kind = turns.schema["conv_id"].dataType.simpleString()
        self.source = numbered(turns.select("conv_id", F.col("turn").cast("long").alias("turn"), word("role").alias("role"), word("text").alias("text")))
        cut = pieces(self.source)
        small = cut.mapInArrow(_summaries, f"conv {kind}, seg long, {_SUMMARY}")
        parts = small.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", *[c.split()[0] for c in _SUMMARY.split(", ")]))).alias("parts"))  # a row a partition at most
        borders = "array<struct<id:long,costs_in:array<double>,costs_out:array<double>,last:boolean>>"
        folded = stored(parts.mapInArrow(_measures, f"conv {kind}, " + ", ".join(f"{c} long" for c in _MEASURES) + f", borders {borders}"), "dialogues-measures")
        self.measures = folded.select("conv", *_MEASURES)
        met = cut.join(folded.select(F.inline("borders")), F.col("pid") == F.col("id"))
        ways = stored(met.select("conv", "seg", "pid", "rows", "costs_in", "costs_out", "last").mapInArrow(_ways, f"conv {kind}, seg long, pid long, entry int, exit int, letters string, roles string"), "dialogues-ways")
        steps = ways.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "pid", "entry", "exit"))).alias("w"))  # four rows a partition at most
        chosen = stored(ways.join(steps.select("w").mapInArrow(_chain, "id long, at int"), (F.col("pid") == F.col("id")) & (F.col("entry") == F.col("at"))).select("conv", "seg", "pid", "letters", "roles"), "dialogues-chosen")
        self.audit = chosen.groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("seg", "letters"))).alias("l")).select("conv", F.array_join(F.col("l.letters"), "").alias("audit"))
        applied = chosen.join(cut.select(F.col("pid").alias("of"), "rows"), F.col("pid") == F.col("of")).select("conv", "letters", "roles", "rows")
        edits = applied.mapInArrow(_edits, f"conv {kind}, place long, sub long, edit string, new_role string, id long")
        texts = self.source.select("rid", "role", "text")
        kept = edits.where("id is not null").join(texts.hint("shuffle_hash"), F.col("id") == F.col("rid")).select("conv", "place", "sub", "edit", F.coalesce("new_role", "role").alias("role"), "text")
        new = edits.where("id is null").select("conv", "place", "sub", "edit", F.col("new_role").alias("role"), F.lit("").alias("text"))
        self.rows = kept.unionByName(new)

    def hashes(self) -> DataFrame:
        """``(conv, sha)`` of the repaired ``role:text`` rows, joined by newlines.

        A hash of a whole conversation reads it in order, so one task streams through it; it holds a batch at a time.
        """
        kind = self.rows.schema["conv"].dataType.simpleString()

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            conv, digest, some = None, None, False
            for batch in batches:
                ids, out = batch.column(0), []
                for c, role, text in zip(ids.to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                    if digest is None or c != conv:
                        if digest is not None:
                            out.append((conv, digest.hexdigest()))
                        conv, digest, some = c, hashlib.sha256(), False
                    digest.update(("\n" if some else "").encode() + role.encode() + b":" + text.encode())
                    some = True
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array([c for c, _ in out], ids.type), pa.array([h for _, h in out])], ["conv", "sha"])
            if digest is not None:
                yield pa.RecordBatch.from_arrays([pa.array([conv], ids.type), pa.array([digest.hexdigest()])], ["conv", "sha"])

        return self.rows.repartition("conv").sortWithinPartitions("conv", "place", "sub").select("conv", "role", "text").mapInArrow(run, f"conv {kind}, sha string")


def repaired(turns: DataFrame) -> DataFrame:
    """``(conv_id, place, edit, role, text)``: the rows of the repaired conversations, numbered from 1; see ``Repair``.

    The numbers come from a window over each conversation.
    """
    place = F.row_number().over(Window.partitionBy("conv").orderBy("place", "sub"))
    return Repair(turns).rows.select(F.col("conv").alias("conv_id"), place.cast("long").alias("place"), "edit", "role", "text")


def repair_digests(conversations: DataFrame) -> DataFrame:
    """The faults, the least cost, the edits and the hash of the repaired rows of every conversation, after ``damaged``.

    Conversations whose rows are all dropped have zeros, no edits and the empty text's hash. Null ids are one
    conversation; other columns are ignored. An empty table gives no rows.
    """
    work = Repair(damaged(conversations))
    own = [c for c in _MEASURES]
    zeros = [F.lit(None).cast("long").alias(c) for c in own]
    text = lambda c: F.lit(None).cast("string").alias(c)
    parts = conversations.select(F.col("conv_id").alias("conv"), *zeros, text("audit"), text("sha"))
    parts = parts.unionByName(work.measures.select("conv", *own, text("audit"), text("sha"))).unionByName(work.audit.select("conv", *zeros, "audit", text("sha"))).unionByName(work.hashes().select("conv", *zeros, text("audit"), "sha"))
    one = parts.groupBy("conv").agg(*[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in own], F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))
    return one.withColumnRenamed("conv", "conv_id").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")
