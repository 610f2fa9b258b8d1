"""The write path: rules by hand, against a plain model that keeps every message, batch against stream, restart."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from tessera.operators import om as Z
from tessera.operators import writepath as W
from tessera.streaming import writepath as S

CONFIG = Z.resolve(message_tokens=100, buffer_tokens=30, observation_tokens=60)
NOW = datetime(2024, 1, 1, tzinfo=timezone.utc)


def handlers():
    """Handlers by name, made here so that tasks get them by value."""

    def flaky(kind, key, number, attempt):  # all depends on the call alone
        r = random.Random(f"{kind}:{key}:{number}:{attempt}").random()
        return "failed" if r < 0.3 else "lost" if r < 0.4 else "done"

    return {"always": W.always, "flaky": flaky, "down": lambda kind, key, number, attempt: "failed"}


HANDLERS = handlers()


def made(seed, keys=5, most=60):
    r = random.Random(seed)
    out = []
    for k in range(keys):
        at = 0
        for n in range(r.randrange(1, most)):
            at += r.choice([0, 0, 1, 30, 60, 400, 4000])
            text = r.choice(["", " ", "again", "x" * r.randrange(1, 300), f"unique {n} " + "word " * r.randrange(40), "two\nlines of\ttext " * r.randrange(9)])
            out.append((k, r.choice(["", f"{k}:{n}"]), r.choice(["user", "assistant", "", " tool "]), text, NOW + timedelta(seconds=at)))
    return out


SCHEMA = "session_id long, id string, role string, text string, created_at timestamp"


class Plain:
    """The rules with every message kept, ids of what was observed, and a list of events; candidates are found anew for each pass."""

    def __init__(self, config, key, delay=1000, handler=W.always):
        self.c, self.key, self.delay, self.handler = config, key, delay, handler
        self.all, self.ids, self.chunks, self.events, self.log = [], set(), [], [], []
        self.p = self.o = self.lb = self.gen = self.no = self.oruns = self.rruns = 0
        self.active, self.cursor, self.bat, self.reflecting, self.buffering, self.refl = "", None, None, False, False, None

    def events_until(self, t):
        while True:
            due = sorted(e for e in self.events if e[0] <= t)
            if not due:
                return
            self.events.remove(due[0])
            self.event(*due[0])

    def event(self, at, no, kind, gen, tries, lost):
        tries += 1
        how = self.handler(kind, self.key, no, tries)
        if how == "lost":
            self.events.append((at + 300_000, no, kind, gen, tries, True))
        elif how == "failed":
            if tries < 6:
                self.events.append((at + 1000 * min(2 ** min(tries - 1, 6), 120), no, kind, gen, tries, False))
                how = "requeued"
            else:
                how = "dead_letter"
                if kind != "observe" and gen == self.gen:
                    self.reflecting = self.buffering = False
        elif gen != self.gen:
            how = "stale_generation"
        elif kind == "observe":
            how = "done" if self.observe([x for x in (self.cursor, self.bat) if x is not None], True) else "nothing_new"
        elif kind == "buffer":
            self.buffering = False
            if self.refl and self.refl[0].strip():
                how = "already_buffered"
            else:
                self.refl = (" ".join(self.active.split())[:1200], self.active)
        else:
            if self.refl and self.refl[0].strip():
                rest = self.active[len(self.refl[1]) :].strip()
                self.active = self.refl[0].strip() + ("\n\n" + rest if rest else "")
            else:
                self.active = " ".join(self.active.split())[:1200].strip()
            self.o, self.gen, self.reflecting, self.buffering, self.refl = (len(self.active) + 3) // 4, self.gen + 1, False, False, None
        self.note(kind, str(no), at, how, 0, None)

    def observe(self, cursors, strict):
        cut = max(cursors, default=None)
        pool = [m for m in self.all if cut is None or m.at > cut]
        if not pool and not strict:
            pool = self.all
        picked = sorted(m for m in pool if m.id.strip() and m.id not in self.ids)[-8:]
        context = (self.active + "\n\n" + "\n\n".join(c[0] for c in self.chunks)).strip()[:16000]
        known, lines = {" ".join(x.split()) for x in context.split("\n")}, []
        for m in picked:
            line = (f"[{' '.join(m.role.split())}] " if m.role.strip() else "") + " ".join(m.text.split())
            if m.text.strip() and line not in known and line not in lines:
                lines.append(line)
        if not lines:
            lines = [(f"[{' '.join(m.role.split())}] " if m.role.strip() else "") + " ".join(m.text.split()) for m in picked if m.text.strip()][:1]
        text, tokens = "\n".join(lines)[:4000].strip(), sum((len(m.text) + 3) // 4 for m in picked)
        if not text or not tokens:
            return False
        self.chunks.append((text, tokens, picked[-1].at))
        self.ids |= {m.id for m in picked}
        self.lb, self.bat = self.p, picked[-1].at
        return True

    def activate(self, threshold):
        target = max(self.p - threshold * float(W.np.float32(1) - W.np.float32(self.c.observation_activation or 0.8)), 0)
        sums = [sum(c[1] for c in self.chunks[: n + 1]) for n in range(len(self.chunks))]
        under = [s for s in sums if s <= target]
        n = sums.index(max(under)) + 1 if under else 1
        for text, tokens, at in self.chunks[:n]:
            self.active = (self.active + "\n\n" + text).strip()
            self.o, self.p, self.cursor = self.o + (len(text) + 3) // 4, max(self.p - tokens, 0), at
        self.chunks = self.chunks[n:]
        self.lb, self.bat = (min(self.lb, self.p), self.bat) if self.chunks else (0, None)
        return n

    def judged(self):
        every, threshold = self.c.buffer_tokens, self.c.threshold(self.o)
        reached = self.p >= threshold
        crossed = every is not None and self.p // every > self.lb // every and (reached or self.p - self.lb >= max(every // 2, 1))
        return threshold, reached, crossed, self.c.observation_block_after is not None and self.p >= self.c.observation_block_after

    def message(self, m):
        self.events_until(m.at)
        self.all.append(m)
        self.p += (len(m.text) + 3) // 4
        if self.c.buffer_tokens is not None:
            self.lb = min(self.lb, self.p)
        threshold, reached, crossed, blocked = self.judged()
        n, how, later = 0, "quiet", self.c.buffer_tokens is not None
        if reached or crossed:
            how = "waits"
            if later and self.chunks and reached:
                n = self.activate(threshold)
                threshold, reached, crossed, blocked = self.judged()
            after = reached and (blocked or not later)
            if later and crossed and not blocked:
                self.oruns, self.lb, how = self.oruns + 1, self.p, "queued"
                self.ask("observe", m.at)
            elif after or (later and crossed):
                self.oruns += 1
                how = "observed" if self.observe([self.cursor] if self.cursor is not None else [], False) else "nothing_new"
            if after and self.chunks:
                n += self.activate(threshold)
        kind, waits, over = None, bool(self.refl and self.refl[0].strip()), self.o > self.c.observation_tokens
        if not self.reflecting:
            share = self.c.reflection_activation
            if share is None:
                kind = "reflect" if over else None
            elif over:
                kind = "reflect" if waits or self.o >= self.c.reflection_block_after else None if self.buffering else "buffer"
            elif not waits and not self.buffering and self.o >= self.c.observation_tokens * share:
                kind = "buffer"
        if kind:
            self.rruns += 1
            self.reflecting, self.buffering = kind == "reflect", kind == "buffer"
            self.ask(kind, m.at)
        self.note("message", m.id, m.at, how, n, kind)

    def ask(self, kind, at):
        self.no += 1
        self.events.append((at + self.delay, self.no, kind, self.gen, 0, False))

    def note(self, kind, ref, at, how, n, asked):
        fresh = sum(1 for m in self.all if m.id.strip() and m.id not in self.ids)
        self.log.append((kind, ref, at, how, n, asked, self.p, self.o, len(self.chunks), fresh, self.gen, self.oruns, self.rruns))


def plain(rows, config, handler):
    out = {}
    for k in {r[0] for r in rows}:
        one, last = Plain(config, k, handler=handler), None
        for m in sorted(W.Message(int(r[4].timestamp() * 1000), *r[1:4]) for r in rows if r[0] == k):
            if not m.id or (m.at, m.id) != last:
                one.message(m)
            last = (m.at, m.id)
        one.events_until(float("inf"))
        out[k] = one.log
    return out


def taken(rows):
    out = {}
    for r in sorted(rows, key=lambda r: (r.session_id, r.step)):
        at = int(r.at.replace(tzinfo=timezone.utc).timestamp() * 1000)
        out.setdefault(r.session_id, []).append((r.kind, r.ref, at, r.outcome, r.activated, r.reflection, r.pending, r.observed, r.chunks, r.unobserved, r.generation, r.observer_runs, r.reflector_runs))
    return out


CONFIGS = {
    "async": CONFIG, "sync": Z.resolve(message_tokens=100, buffer_tokens=Z.DISABLED, observation_tokens=60), "shared": Z.resolve(message_tokens=80, buffer_tokens=Z.DISABLED, observation_tokens=60, share_token_budget=True),
    "tight": Z.resolve(message_tokens=50, buffer_tokens=45, buffer_activation=0.3, observation_tokens=30, reflection_activation=0.9, reflection_block_after=1.9),
}


@pytest.mark.parametrize("name", CONFIGS)
@pytest.mark.parametrize("how", HANDLERS)
def test_steps_equal_a_plain_model(spark, name, how):
    handler = HANDLERS[how]
    rows = [r for r in made(f"{name}:{how}") if r[1]]
    got = taken(S.steps(spark.createDataFrame(rows, SCHEMA), CONFIGS[name], handler=handler).collect())
    assert got == plain(rows, CONFIGS[name], handler)
    if handler is W.always:
        kinds = {s[0] for log in got.values() for s in log}
        assert "message" in kinds and kinds & {"reflect", "buffer"}


def test_rules_by_hand():
    one = W.Session(Z.resolve(message_tokens=10, buffer_tokens=Z.DISABLED, observation_tokens=1000), "k")
    steps = [r for i, text in enumerate(["a" * 20, "b" * 20, "c" * 4]) for r in one.write(W.Message(i, f"m{i}", "user", text))]
    assert [(s[4], s[8], s[10], s[12]) for s in steps] == [("quiet", 0, 5, 0), ("observed", 1, 0, 0), ("quiet", 0, 1, 0)]
    assert one.record.active == "[user] " + "a" * 20 + "\n[user] " + "b" * 20 and one.record.last_observed == 1 and not one.chunks
    chunks = [W.Chunk(n, "", 0, t, 0) for n, t in enumerate((40, 0, 30, 50), 1)]
    assert [W.boundary(chunks, 0.5, 100, p) for p in (60, 90, 120, 150, 400)] == [1, 1, 3, 3, 4]
    again = list(one.write(W.Message(2, "m2", "user", "other")))
    assert again == [] and one.record.pending == 1


def test_an_idle_key_begins_anew(spark):
    rows = [(1, "a", "user", "x" * 80, NOW), (1, "b", "user", "y" * 80, NOW + timedelta(hours=2))]
    got = S.steps(spark.createDataFrame(rows, SCHEMA), CONFIG, idle=3_600_000).orderBy("at").collect()
    assert [(r.kind, r.step, r.pending) for r in got if r.kind in ("message", "expire")] == [("message", 1, 20), ("expire", 2, 20), ("message", 1, 20), ("expire", 2, 20)]


def test_nulls_repeats_empty_tables_and_other_columns(spark):
    odd = spark.createDataFrame([(None, "a", "user", "t", NOW), (1, "a", "user", "t", None), (1, None, None, None, NOW), (1, "b", "user", "t", NOW), (1, "b", "user", "t", NOW)], SCHEMA)
    odd = odd.withColumn("key", F.lit("clash")).withColumn("at", F.lit(1)).withColumn("step", F.lit("x"))
    assert [(r.ref, r.pending) for r in S.steps(odd, CONFIG).orderBy("step").collect()] == [("", 0), ("b", 1)]
    assert S.steps(odd.limit(0), CONFIG).count() == 0


def test_a_key_of_any_size_goes_by_batches(spark):
    n = 30_000
    rows = spark.range(n).select(F.lit(7).cast("long").alias("session_id"), F.concat(F.lit("m"), F.col("id")).alias("id"), F.lit("user").alias("role"), F.repeat(F.lit("z"), (F.col("id") % 50).cast("int")).alias("text"), F.timestamp_seconds("id").alias("created_at"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    try:
        out = S.steps(rows, CONFIG)
        assert out.where("kind = 'message'").count() == n and out.agg(F.max("unobserved")).first()[0] < n
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_the_stream_equals_the_batch_over_restarts_and_disorder(spark, tmp_path):
    jitter = random.Random(3)
    rows = sorted((r for r in made("stream", keys=4, most=40) if r[1]), key=lambda r: r[4] + timedelta(seconds=jitter.randrange(300)))
    ends, handler = [0, len(rows) // 3, 2 * len(rows) // 3, len(rows)], HANDLERS["flaky"]
    for a, b in zip(ends, ends[1:], strict=False):
        spark.createDataFrame(rows[a:b], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        with S.state_store(spark):  # each round is a new query that goes on from the checkpoint
            out = S.step_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), CONFIG, late="10 minutes", handler=handler)
            run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").outputMode("append").trigger(availableNow=True).start()
            run.awaitTermination()
    mark = int(max(r[4] for r in rows).timestamp() * 1000) - 600_000
    want = S.steps(spark.createDataFrame(rows, SCHEMA), CONFIG, until=mark, handler=handler)
    got = spark.read.schema(want.schema).parquet(f"{tmp_path}/out")
    a, b = ([tuple(r) for r in x.orderBy("session_id", "step").collect()] for x in (got, want))
    assert a == b and len(a) > 20 and {"requeued", "queued", "quiet"} <= {r[5] for r in a}
