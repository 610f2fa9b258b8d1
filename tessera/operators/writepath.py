"""The write path of observational memory: what a message, or a request that falls due, does to its key's record.

A message adds its tokens. Below the observer's threshold and without a crossed
interval only the reflection is decided. Else buffered chunks are activated
where the threshold is reached, then the observer runs, at once or, for a
crossed interval, by a request, then chunks may be activated again, and the
reflection is decided last. Requests (observe, buffer, reflect) are handled
when they fall due: they name the generation that they were made for, wait
between attempts, come back after a lost worker, and end as dead letters.

Times are milliseconds. Steps of a key go by time, requests before messages, so
that the outcome doesn't depend on how rows were cut into batches.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from typing import NamedTuple

import numpy as np

from tessera.operators import outbox as O
from tessera.operators.om import Config

#: Most messages of a pass, characters of an observation, of the known text and of a reflection. Fixed values.
MESSAGES, OBSERVATION_CHARS, KNOWN_CHARS, REFLECTION_CHARS = 8, 4000, 16000, 1200
#: The share of chunks to activate where the configuration names none. A fixed value.
ACTIVATION = 0.8
#: Seconds after which a request in work counts as lost. A fixed value.
LOST_SECONDS = 300
KINDS = {"observe": "om_observe_buffer_requested", "buffer": "om_reflect_buffer_requested", "reflect": "om_reflect_requested"}
_SPACE = re.compile(r"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")


class Message(NamedTuple):
    at: int
    id: str
    role: str
    text: str


class Chunk(NamedTuple):
    seq: int
    text: str
    tokens: int
    message_tokens: int
    last_at: int


class Request(NamedTuple):
    due: int
    number: int
    kind: str
    generation: int
    attempt: int
    status: str


@dataclass
class Record:
    pending: int = 0
    observed: int = 0
    active: str = ""
    last_observed: int | None = None
    buffered_tokens: int = 0
    buffered_at: int | None = None
    buffering: bool = False
    reflecting: bool = False
    buffering_reflection: bool = False
    reflection: str | None = None
    covered: int = 0
    generation: int = 0
    observer_runs: int = 0
    reflector_runs: int = 0
    request_number: int = 0
    steps: int = 0
    newest: int | None = None
    last_step: int | None = None
    last_id: str = ""


class Decision(NamedTuple):
    threshold: int
    reached: bool
    interval: bool
    blocked: bool
    observe: bool
    activate_after: bool


#: The columns of a step, after the key.
STEP = (
    "step int, kind string, ref string, at timestamp, outcome string, threshold_reached boolean, interval_triggered boolean, block_after_exceeded boolean, activated int, reflection string, "
    "pending int, observed int, chunks int, unobserved int, generation int, observer_runs int, reflector_runs int, active_sha256 string"
)

#: Whether a handler call succeeds: (kind, key, request number, attempt) -> "done", "failed" or "lost".
Handler = Callable[[str, object, int, int], str]


def always(kind: str, key: object, number: int, attempt: int) -> str:
    return "done"


def collapse(text: str) -> str:
    return _SPACE.sub(" ", text).strip(" ")


def estimate(text: str) -> int:
    """Tokens of a text: a quarter of its characters, rounded up."""
    return -(-len(text) // 4)


def decide(record: Record, config: Config) -> Decision:
    """Threshold, interval and block-after of a record.

    Below the threshold an interval counts only if half of it is new since the
    last buffering. With background buffering the observer runs on intervals,
    and at the threshold only beyond ``block_after``; without, at the threshold.
    """
    threshold, every = config.threshold(record.observed), config.buffer_tokens
    reached = record.pending >= threshold
    crossed = bool(every) and record.pending // every > record.buffered_tokens // every
    interval = crossed and (reached or record.pending - record.buffered_tokens >= max(every // 2, 1))
    blocked = config.observation_block_after is not None and record.pending >= config.observation_block_after
    if every is None:
        return Decision(threshold, reached, interval, blocked, reached, reached)
    return Decision(threshold, reached, interval, blocked, interval or (reached and blocked), reached and blocked)


def reflection_kind(record: Record, config: Config) -> str | None:
    """The request that a record's observations call for: reflect, buffer or none. The threshold is strict."""
    share, waits = config.reflection_activation, bool((record.reflection or "").strip())
    over = record.observed > config.observation_tokens
    if record.reflecting:
        return None
    if share is None:
        return "reflect" if over else None
    if over:
        limit = config.reflection_block_after
        if waits or (limit is not None and record.observed >= limit):
            return "reflect"
        return None if record.buffering_reflection else "buffer"
    if waits or record.buffering_reflection:
        return None
    return "buffer" if record.observed >= config.observation_tokens * float(np.float32(share)) else None


def boundary(chunks: list[Chunk], ratio: float, threshold: int, pending: int) -> int:
    """How many leading chunks to activate: the most that leave the share to keep, else the first alone."""
    keep = threshold * float(np.float32(1) - np.float32(min(max(ratio, 0.0), 1.0)))
    target, total, best, at = max(pending - keep, 0.0), 0, 0, 0
    for n, chunk in enumerate(chunks, 1):
        total += chunk.message_tokens
        if at == 0 or best < total <= target or (best > target and total < best):
            best, at = total, n
    return at


def draft(active: str) -> str:
    """A reflection without a model: all observations in one line, cut."""
    return collapse(active)[:REFLECTION_CHARS]


@dataclass
class Session:
    """One key's record, its buffered chunks, unobserved messages and open requests."""

    config: Config
    key: object = None
    delay: int = 1000
    idle: int | None = None
    handler: Handler = always
    record: Record = field(default_factory=Record)
    chunks: list[Chunk] = field(default_factory=list)
    fresh: list[Message] = field(default_factory=list)
    requests: list[Request] = field(default_factory=list)

    # What is due

    def next_due(self) -> int | None:
        """When something happens by itself: the first request, or else the end of an idle key."""
        if self.requests:
            return min(self.requests).due
        return self.record.last_step + self.idle if self.idle is not None and self.record.last_step is not None else None

    def until(self, limit: float) -> Iterator[tuple]:
        """Handle all that falls due up to ``limit``, in order of time and number."""
        while (due := self.next_due()) is not None and due <= limit:
            if self.requests:
                request = min(self.requests)
                self.requests.remove(request)
                yield self._handle(request)
            else:
                self.record.steps += 1
                yield self._row("expire", "", due, "done")
                self.record, self.chunks, self.fresh = Record(), [], []

    def _handle(self, request: Request) -> tuple:
        r, kind, now = self.record, KINDS[request.kind], request.due
        if request.status == "lost":  # its worker never came back: it is new again, and due at once
            request = request._replace(status="new")
        request = request._replace(attempt=request.attempt + 1)
        outcome = self.handler(request.kind, self.key, request.number, request.attempt)
        if outcome == "lost":
            self.requests.append(request._replace(due=now + LOST_SECONDS * 1000, status="lost"))
        elif outcome == "failed":
            most, longest = O.POLICY.get(kind, O.DEFAULT)
            if request.attempt < most:
                wait = min(2 ** min(max(request.attempt - 1, 0), 6), longest)
                self.requests.append(request._replace(due=now + wait * 1000))
                outcome = "requeued"
            else:
                outcome = "dead_letter"
                if request.kind != "observe" and request.generation == r.generation:
                    r.reflecting = r.buffering_reflection = False
        elif request.generation != r.generation:
            outcome = "stale_generation"
        elif request.kind == "observe":
            outcome = "done" if self._observe(r.buffered_at, strict=True) else "nothing_new"
        elif request.kind == "buffer":
            outcome = self._buffer_reflection()
        else:
            self._reflect()
        r.steps, r.last_step = r.steps + 1, now
        return self._row(request.kind, str(request.number), now, outcome)

    def _ask(self, kind: str, now: int) -> None:
        self.record.request_number += 1
        self.requests.append(Request(now + self.delay, self.record.request_number, kind, self.record.generation, 0, "new"))

    # A message

    def write(self, message: Message) -> Iterator[tuple]:
        """Take a message, after what was due before it. One that repeats the last one's time and id is left out."""
        yield from self.until(message.at)
        r, now = self.record, message.at
        if r.last_id and (r.newest, r.last_id) == (message.at, message.id):
            return
        r.newest, r.last_id, r.last_step, r.steps = now, message.id, now, r.steps + 1
        if message.id.strip():
            self.fresh.append(message)
        r.pending += estimate(message.text)
        if self.config.buffer_tokens is not None:
            r.buffered_tokens = min(r.buffered_tokens, r.pending)
        first = decision = decide(r, self.config)
        activated, outcome = 0, "quiet"
        if decision.reached or decision.interval:
            outcome = "waits"
            if self.chunks and self.config.buffer_tokens is not None and decision.reached:
                activated = self._activate(decision.threshold)
                decision = decide(r, self.config)
            if decision.observe and decision.interval and not decision.blocked:
                r.observer_runs, r.buffered_tokens, outcome = r.observer_runs + 1, r.pending, "queued"
                self._ask("observe", now)
            elif decision.observe:
                r.observer_runs += 1
                outcome = "observed" if self._observe(None, strict=False) else "nothing_new"
            if decision.activate_after and self.chunks:
                activated += self._activate(decision.threshold)
        kind = reflection_kind(r, self.config)
        if kind is not None:
            r.reflector_runs += 1
            r.reflecting, r.buffering_reflection = kind == "reflect", kind == "buffer"
            self._ask(kind, now)
        yield self._row("message", message.id, now, outcome, first, activated, kind)

    def _activate(self, threshold: int) -> int:
        r, ratio = self.record, self.config.observation_activation
        n = boundary(self.chunks, ACTIVATION if ratio is None else ratio, threshold, r.pending)
        taken, self.chunks = self.chunks[:n], self.chunks[n:]
        r.active = "\n\n".join(x for x in (r.active.strip(), *(c.text.strip() for c in taken)) if x)
        r.observed += sum(c.tokens for c in taken)
        r.pending = max(r.pending - sum(c.message_tokens for c in taken), 0)
        r.last_observed, r.buffering = taken[-1].last_at, bool(self.chunks)
        if self.chunks:
            r.buffered_tokens = min(r.buffered_tokens, r.pending)
        else:
            r.buffered_tokens, r.buffered_at = 0, None
        return n

    # The observer

    def _observe(self, after: int | None, strict: bool) -> bool:
        """A pass over the newest unobserved messages behind the cursor; whether it made a chunk.

        Where no message at all lies behind the cursor, a pass that isn't strict takes those before it.
        """
        r = self.record
        cursor = max((x for x in (r.last_observed, after) if x is not None), default=None)
        pool = self.fresh
        if cursor is not None and (strict or (r.newest is not None and r.newest > cursor)):
            pool = [m for m in pool if m.at > cursor]
        picked = sorted(pool)[-MESSAGES:]
        text, tokens = self._lines(picked), sum(estimate(m.text) for m in picked)
        if not text or tokens == 0:
            return False
        self.chunks.append(Chunk((self.chunks[-1].seq if self.chunks else 0) + 1, text, estimate(text), tokens, picked[-1].at))
        gone = {m.id for m in picked}
        self.fresh = [m for m in self.fresh if m.id not in gone]
        r.buffering, r.buffered_tokens, r.buffered_at = True, r.pending, picked[-1].at
        return True

    def _lines(self, picked: list[Message]) -> str:
        """One line a message, none that is known or repeats; the first alone where none is new."""
        known_text = "\n\n".join(x for x in (self.record.active.strip(), "\n\n".join(c.text for c in self.chunks)) if x)[:KNOWN_CHARS]
        known = {collapse(x) for x in known_text.split("\n")}
        lines = [f"[{role}] {text}" if (role := collapse(m.role)) else text for m in picked if (text := collapse(m.text))]
        new = [x for x in dict.fromkeys(lines) if x not in known] or lines[:1]
        return "\n".join(x for line in "\n".join(new)[:OBSERVATION_CHARS].split("\n") if (x := line.strip()))

    # Reflections

    def _buffer_reflection(self) -> str:
        r = self.record
        r.buffering_reflection = False
        if (r.reflection or "").strip():
            return "already_buffered"
        r.reflection, r.covered = draft(r.active), len(r.active)
        return "done"

    def _reflect(self) -> None:
        """The reflection, and the observations since it was buffered, become the record's text; a new generation begins."""
        r = self.record
        waits = (r.reflection or "").strip()
        text, rest = (waits, r.active[r.covered :].strip()) if waits else (draft(r.active).strip(), "")
        r.active = "\n\n".join(x for x in (text, rest) if x)
        r.observed, r.generation = estimate(r.active), r.generation + 1
        r.reflecting = r.buffering_reflection = False
        r.reflection, r.covered = None, 0

    def _row(self, kind: str, ref: str, at: int, outcome: str, d: Decision | None = None, activated: int = 0, reflection: str | None = None) -> tuple:
        r = self.record
        return (
            r.steps, kind, ref, at, outcome, d.reached if d else None, d.interval if d else None, d.blocked if d else None, activated, reflection,
            r.pending, r.observed, len(self.chunks), len(self.fresh), r.generation, r.observer_runs, r.reflector_runs, hashlib.sha256(r.active.encode("utf-8", "surrogatepass")).hexdigest(),
        )


def names(kind: type) -> list[str]:
    """The columns of a record, message, chunk or request."""
    return [f.name for f in fields(kind)] if kind is Record else list(kind._fields)
