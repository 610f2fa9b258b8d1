"""The write path over many keys, as one pass over sorted rows or as a stream with typed state and timers."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.operators import writepath as W
from tessera.operators.om import Config

#: Types of the state's columns.
RECORD = (
    "pending int, observed int, active string, last_observed long, buffered_tokens int, buffered_at long, buffering boolean, reflecting boolean, buffering_reflection boolean, reflection string, covered int, "
    "generation int, observer_runs int, reflector_runs int, request_number int, steps int, newest long, last_step long, last_id string"
)
MESSAGE = "at long, id string, role string, text string"
CHUNK = "seq int, text string, tokens int, message_tokens int, last_at long"
REQUEST = "due long, number int, kind string, generation int, attempt int, status string"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _rows(messages: DataFrame, key: str) -> DataFrame:
    """Key, time and texts of messages; rows without a key or a time are none, null texts are empty."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    return messages.select(F.col(key).alias("key"), F.col("created_at").cast("timestamp").alias("created_at"), text("id"), text("role"), text("text")).where("key is not null and created_at is not null")


def _out(messages: DataFrame, key: str) -> str:
    return f"`{key}` {messages.schema[key].dataType.simpleString()}, {W.STEP}"


def _frame(rows: list[tuple], columns: list[str]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=columns)
    out["at"] = pd.to_datetime(out["at"].astype("int64"), unit="ms", utc=True)
    return out.astype({c: object for c in ("threshold_reached", "interval_triggered", "block_after_exceeded")})


def _columns(key: str) -> list[str]:
    return [key, *(c.split()[0] for c in W.STEP.split(", "))]


def steps(messages: DataFrame, config: Config, key: str = "session_id", until: int | None = None, delay: int = 1000, idle: int | None = None, handler: W.Handler = W.always) -> DataFrame:
    """Every step of every key: its messages and the requests that they lead to, with the record after each.

    ``messages``: the key, id, role, text, created_at; the config says when
    things happen. ``until`` (milliseconds) ends the time: what isn't before
    it doesn't happen, as in a stream whose watermark stands there. A request is due ``delay``
    milliseconds after it was made; a key that nothing happens to for ``idle`` milliseconds
    begins anew.

    Rows are sorted within hashed partitions and read once, so a task holds one
    key's state and one Arrow batch, however many messages the key has. Equal
    times go by id, role and text; a repeated time and id counts once.
    """
    rows = _rows(messages, key).withColumn("at", F.unix_millis("created_at"))
    if until is not None:
        rows = rows.where(F.col("at") < until)
    rows = rows.select("key", "at", "id", "role", "text").repartition("key").sortWithinPartitions("key", "at", "id", "role", "text")
    limit, columns = math.inf if until is None else until - 1, _columns(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        session, out = None, []
        for batch in batches:
            for k, *message in zip(*(batch[c].tolist() for c in ("key", "at", "id", "role", "text")), strict=True):
                if session is None or session.key != k:
                    out += [(session.key, *r) for r in session.until(limit)] if session else []
                    session = W.Session(config, k, delay, idle, handler)
                out += [(k, *r) for r in session.write(W.Message(*message))]
            if out:
                yield _frame(out, columns)
                out = []
        if session and (rest := [(session.key, *r) for r in session.until(limit)]):
            yield _frame(rest, columns)

    return rows.mapInPandas(run, _out(messages, key))


class Writer(StatefulProcessor):
    """The same over state: the record, chunks, unobserved messages, requests, and arrivals that the watermark hasn't passed yet."""

    def __init__(self, columns: list[str], config: Config, delay: int, idle: int | None, handler: W.Handler) -> None:
        self.columns, self.config, self.delay, self.idle, self.handler = columns, config, delay, idle, handler

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.record = handle.getValueState("record", RECORD)
        self.lists = {name: handle.getListState(name, schema) for name, schema in (("chunks", CHUNK), ("fresh", MESSAGE), ("requests", REQUEST), ("held", MESSAGE))}

    def _load(self, name: str, kind: type) -> list:
        return [kind(*row) for row in self.lists[name].get()]

    def _save(self, name: str, rows: list) -> None:
        if rows:
            self.lists[name].put([tuple(r) for r in rows])
        else:
            self.lists[name].clear()

    def _wake(self, times: list[int]) -> None:
        """One timer a key: at the first time that something is to be done."""
        first = min(times, default=None)
        there = list(self.handle.listTimers())
        for t in there:
            if t != first:
                self.handle.deleteTimer(t)
        if first is not None and first not in there:
            self.handle.registerTimer(first)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = [W.Message(*m) for batch in rows for m in zip(*(batch[c].tolist() for c in ("at", "id", "role", "text")), strict=True)]
        self.lists["held"].appendList([tuple(m) for m in new])
        self._wake([min(m.at for m in new), *self.handle.listTimers()])
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        mark = timerValues.getCurrentWatermarkInMs()
        held = sorted(self._load("held", W.Message))
        now, later = [m for m in held if m.at < mark], [m for m in held if m.at >= mark]
        record = W.Record(*self.record.get()) if self.record.exists() else W.Record()
        session = W.Session(self.config, key[0], self.delay, self.idle, self.handler, record, self._load("chunks", W.Chunk), self._load("fresh", W.Message), self._load("requests", W.Request))
        out = [r for m in now for r in session.write(m)]
        out += session.until(mark - 1)
        for name, values in (("chunks", session.chunks), ("fresh", session.fresh), ("requests", session.requests), ("held", later)):
            self._save(name, values)
        if session.record == W.Record():
            self.record.clear()
        else:
            self.record.update(tuple(getattr(session.record, c) for c in W.names(W.Record)))
        due = session.next_due()
        self._wake([m.at for m in later[:1]] + ([due] if due is not None else []))
        if out:
            yield _frame([(key[0], *r) for r in out], self.columns)

    def close(self) -> None:
        pass


def step_stream(messages: DataFrame, config: Config, key: str = "session_id", late: str = "0 seconds", delay: int = 1000, idle: int | None = None, handler: W.Handler = W.always) -> DataFrame:
    """``steps`` of a stream of messages. A row may come ``late`` behind the newest one; later ones are dropped.

    Arrivals wait in state until the watermark has passed them, then they are
    taken in order of time, together with the requests that fell due between;
    timers at the first waiting time or due time bring that about, for retries, lost workers and idle
    keys too, so state goes when a key's idle time is over. Rows
    come in append mode and equal those of ``steps`` with ``until`` at the watermark,
    whatever the micro-batches. The query must be started under ``state_store``.
    """
    rows = _rows(messages, key).withColumn("at", F.unix_millis("created_at")).withWatermark("created_at", late)
    return rows.groupBy("key").transformWithStateInPandas(Writer(_columns(key), config, delay, idle, handler), _out(messages, key), "append", "eventTime")


class state_store:  # noqa: N801
    """A context in which streams start with the state store that typed state needs."""

    NAME = "spark.sql.streaming.stateStore.providerClass"

    def __init__(self, spark: SparkSession) -> None:
        self.spark = spark

    def __enter__(self) -> None:
        self.before = self.spark.conf.get(self.NAME, None)
        self.spark.conf.set(self.NAME, ROCKSDB)

    def __exit__(self, *error: object) -> None:
        if self.before is None:
            self.spark.conf.unset(self.NAME)
        else:
            self.spark.conf.set(self.NAME, self.before)
