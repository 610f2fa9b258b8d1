"""Observer state of sessions: one fold, run in batch or as a stream.

A session's state is seven values. Each message adds its tokens; at the
threshold an observation chunk is written and pending tokens start anew, at an
interval's crossing the chunk is deferred; observed tokens over the reflection
threshold ask for a reflection, which raises the generation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

THRESHOLD, INTERVAL, REFLECT = 200, 50, 300
STATE = "pending int, observed int, chunks int, generation int, deferred int, reflections int, last_id string"
OUT = "session_id long, pending int, observed int, chunks int, deferred int, reflections int, generation int"


@dataclass
class State:
    pending: int = 0
    observed: int = 0
    chunks: int = 0
    generation: int = 0
    deferred: int = 0
    reflections: int = 0
    last: str = ""


def step(state: State, tokens: int) -> tuple[bool, bool]:
    """Take one message; (whether a chunk was deferred, whether a reflection ran)."""
    before, state.pending = state.pending, state.pending + tokens
    if state.pending >= THRESHOLD:
        state.chunks += 1
        state.observed += -(-state.pending // 4)
        state.pending = 0
    deferred = 0 < state.pending and state.pending // INTERVAL > before // INTERVAL
    reflect = state.observed > REFLECT
    if reflect:
        state.generation += 1
        state.observed //= 2
    return deferred, reflect


def _fold(session: int, rows: pd.DataFrame, state: State) -> pd.DataFrame:
    for row in rows.sort_values(["turn", "id"]).itertuples():
        d, r = step(state, -(-len(row.text or "") // 4))
        state.deferred, state.reflections, state.last = state.deferred + d, state.reflections + r, row.id
    return pd.DataFrame([(session, state.pending, state.observed, state.chunks, state.deferred, state.reflections, state.generation)], columns=[c.split()[0] for c in OUT.split(", ")])


def fold_batch(messages: DataFrame) -> DataFrame:
    """The state of each session after all its messages."""
    own = messages.dropDuplicates(["id"]).select("session_id", "id", "turn", "text")
    return own.groupBy("session_id").applyInPandas(lambda pdf: _fold(pdf["session_id"].iloc[0], pdf, State()), OUT)


def fold_stream(messages: DataFrame) -> DataFrame:
    """The same as a stream: state is kept between micro-batches; each emits the sessions it touched."""

    def run(key: tuple, pdfs: Iterator[pd.DataFrame], held) -> Iterator[pd.DataFrame]:
        state = State(*held.get) if held.exists else State()
        rows = pd.concat(list(pdfs))
        yield _fold(key[0], rows, state)
        held.update((state.pending, state.observed, state.chunks, state.generation, state.deferred, state.reflections, state.last))

    own = messages.select("session_id", "id", "turn", "text").dropDuplicates(["id"])
    return own.groupBy(F.col("session_id")).applyInPandasWithState(run, OUT, STATE, "update", "NoTimeout")
