import hashlib
import heapq
import random
import re
import zlib

import pytest

from tessera.llm import dialogues

SP = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired rows) by a search over the whole graph in order of cost and letters; rows are (role, text, fault)."""
    heap, best = [(0, "", 0, 0, ())], {}
    while heap:
        cost, audit, i, s, out = heapq.heappop(heap)
        if (i, s) in best:
            continue
        best[i, s] = audit
        if i == len(rows) and s in (0, 3):
            return cost, audit, [(r, t) for r, t in out]
        want = {0: 2, 1: 2, 2: 3, 3: 2}[s]
        role = {2: "user", 3: "assistant"}[want]
        heapq.heappush(heap, (cost + 2, audit + "I", i, want, (*out, (role, ""))))
        if i < len(rows):
            own, text, fault = rows[i]
            heapq.heappush(heap, (cost + 3, audit + "D", i + 1, s, out))
            if fault in ("", "truncated"):
                more = fault == "truncated"
                to = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}.get((s, own[:1]))
                if to is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, to, (*out, (own, text))))
                heapq.heappush(heap, (cost + 2 + more, audit + "R", i + 1, want, (*out, (role, text))))


def plain_form(table):
    """The contract over a list of (conv_id, turn, role, text)."""
    word = lambda x: " " if x is None else str(x)
    by = {c: [] for c, *_ in table}
    for c, turn, role, text in table:
        act = zlib.crc32(f"{word(c)}:{word(turn)}".encode()) % 20
        role, text = word(role), word(text)
        if act == 0:
            continue
        if act == 1:
            text = ""
        if act == 2:
            text = re.sub("[.!?]", "", text)
        if act == 4:
            role = "user"
        by[c] += [(turn, role, text)] * (2 if act == 3 else 1)
    out = []
    for c, rows in by.items():
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        faults, seen = [], set()
        for _, role, text in rows:
            shown = text.rstrip(SP)
            faults.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
        cost, audit, fixed = cheapest([(r, t, f) for (_, r, t), f in zip(rows, faults)])
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for r, t in fixed).encode()).hexdigest()
        out.append((c, gaps, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, sha))
    return sorted(out, key=repr)


COLUMNS = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def run(spark, table):
    df = spark.createDataFrame([(*r, "x", 1) for r in table], "conv_id long, turn long, role string, text string, seg string, place int").repartition(3)
    return sorted((tuple(r[c] for c in COLUMNS) for r in dialogues.repair_digests(df).collect()), key=repr)


def made(rng, conv, n):
    texts = ["Yes.", "No", "why?", "", " \n", "Good!", "ok .", "é漢.", "a\x00b."]
    roles = ["user", "assistant", "system", "tool", "", None, "User", "agent"]
    return [(conv, rng.choice([t, t, t, t + 3, None]) if rng.random() < 0.2 else t, roles[t % 2] if rng.random() < 0.7 else rng.choice(roles), None if rng.random() < 0.05 else rng.choice(texts) + rng.choice(["", "", f" {t}."])) for t in range(n)]


def test_against_brute_force(spark):
    rng = random.Random(9)
    table = [row for conv in range(250) for row in made(rng, conv, rng.choice([1, 1, 2, 3, 5, 8, 20]))]
    table += [(None, 1, "user", "Hi."), (None, None, None, None), (7, 0, "user", "Hi.")]
    assert run(spark, table) == plain_form(table)


@pytest.mark.parametrize("kind", ["mixed", "copies"])
def test_a_long_conversation_lies_in_pieces(spark, kind):
    """One conversation that holds most rows is cut at partition borders; the result is the same."""
    rng = random.Random(10)
    long = made(rng, 1, 3000) if kind == "mixed" else [(1, 5, "user", "Again.")] * 2000
    table = long + [row for conv in range(2, 30) for row in made(rng, conv, 6)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that little data has several partitions
    df = dialogues.damaged(spark.createDataFrame(table, "conv_id long, turn long, role string, text string").repartition(4))
    cut = dialogues.pieces(dialogues.numbered(df))
    try:
        assert cut.where("conv = 1").count() > 1
        assert run(spark, table) == plain_form(table)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_pieces_agree_with_the_whole():
    rng = random.Random(11)
    for _ in range(60):
        codes = bytes(rng.choice([4, 8, 8, 12, 12, 0, 5, 9, 13, 10, 14, 15]) for _ in range(rng.randrange(1, 30)))
        whole = dialogues.scripts(codes, dialogues.START, dialogues.end_costs(), True)[0]
        k = rng.randrange(len(codes) + 1)
        a, b = codes[:k], codes[k:]
        mid = dialogues.through(dialogues.START, dialogues.transfer(a))
        back = dialogues.before(dialogues.transfer(b), dialogues.end_costs())
        assert min(mid[s] + back[s] for s in range(4)) == min(dialogues.before(dialogues.transfer(codes), dialogues.end_costs())[:1])
        if not b or not a:
            continue
        first = dialogues.scripts(a, dialogues.START, back, False)[0]
        rest = dialogues.scripts(b, mid, dialogues.end_costs(), True)[first[0]]
        assert (rest[0], first[1] + rest[1], first[2] + rest[2]) == whole


def test_repaired_rows_hold_the_pattern(spark):
    rng = random.Random(12)
    table = [row for conv in range(60) for row in made(rng, conv, rng.choice([1, 3, 9]))]
    df = spark.createDataFrame(table, "conv_id long, turn long, role string, text string")
    rows = dialogues.repaired(df).orderBy("conv_id", "place").collect()
    by = {}
    for r in rows:
        by.setdefault(r.conv_id, []).append(r)
    assert by and all(re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in v)) for v in by.values())
    assert all([r.place for r in v] == list(range(1, len(v) + 1)) for v in by.values())
    assert all(r.text == "" for r in rows if r.edit == "I") and {r.edit for r in rows} == {"I", "K", "R"}


def test_empty_and_all_dropped(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert dialogues.repair_digests(empty).count() == 0
    gone = next((c, 0, "user", "Hi.") for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    assert run(spark, [gone]) == [(gone[0], 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())] == plain_form([gone])
