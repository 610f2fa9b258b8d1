"""Audio feature columns.

Media is a column of WAV files: 8-bit unsigned mono samples behind a 44-byte
header, written and measured with Spark's binary functions. Features are read
from the stored bytes: polyphase resampling from ``RATE`` to ``TARGET``, then
log-mel energies of overlapped frames, then segments from frame energies with
hysteresis (a segment opens over ``OPEN`` and closes under ``CLOSE`` decibels
against the text's loudest frame). Each media value gives blocks of
``BLOCK_FRAMES`` x ``MELS`` energies as a fixed-shape Arrow tensor, with the
time span of every block, in one Arrow stream.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PAD = 64
HEADER = 44
RATE, TARGET = 12_000, 8_000
UP, DOWN = 2, 3
TAPS = 12  # of the filter, for each of its UP phases
FRAME, HOP, MELS = 256, 128, 24
BLOCK_FRAMES = 32
OPEN, CLOSE = -9.0, -15.0
#: Output samples or frames that are worked on at a time, which bounds memory.
CHUNK = 1 << 16
#: Media values whose features are handed over together.
ROWS = 512


def payload_of(text: Column | str) -> Column:
    """The text's bytes with zeros behind them up to a positive multiple of 64; null is empty."""
    c = F.col(text) if isinstance(text, str) else text
    raw = F.coalesce(c, F.lit("")).cast("binary")
    size = F.greatest(F.lit(PAD), F.ceil(F.octet_length(raw) / PAD) * PAD).cast("int")
    return F.call_function("rpad", raw, size, F.unhex(F.lit("00")))


def _le(value: Column, n: int) -> Column:
    """A number's bytes, the lowest first."""
    digits = F.lpad(F.hex(value.cast("long")), 2 * n, "0")
    return F.unhex(F.concat(*[F.substring(digits, 2 * (n - i) - 1, 2) for i in range(n)]))


def wav_of(payload: Column) -> Column:
    """The payload as a WAV file of 8-bit samples."""
    n = F.octet_length(payload)
    word = lambda s: F.lit(s).cast("binary")
    form = F.unhex(F.lit((1).to_bytes(2, "little").hex() + (1).to_bytes(2, "little").hex() + RATE.to_bytes(4, "little").hex() * 2 + (1).to_bytes(2, "little").hex() + (8).to_bytes(2, "little").hex()))
    return F.concat(word("RIFF"), _le(n + 36, 4), word("WAVEfmt "), _le(F.lit(16), 4), form, word("data"), _le(n, 4), payload)


def read_wav(media: bytes) -> np.ndarray:
    """The samples of a stored WAV file, as unsigned bytes."""
    if media[:4] != b"RIFF" or media[36:40] != b"data":
        raise ValueError("not a WAV file of this form")
    n = int.from_bytes(media[40:44], "little")
    return np.frombuffer(media, np.uint8, n, HEADER)


@lru_cache(1)
def _phases() -> np.ndarray:
    """The low-pass filter (windowed sinc), a row for each phase, TAPS columns."""
    n = UP * TAPS
    t = np.arange(n) - (n - 1) / 2
    cut = 0.9 / max(UP, DOWN)
    h = np.sinc(cut * t) * cut * np.hamming(n) * UP
    return h.reshape(TAPS, UP).T[:, ::-1].copy()


def resample(x: np.ndarray) -> Iterator[np.ndarray]:
    """x at UP / DOWN times its rate, chunk by chunk: one short filter for each output phase.

    Unsigned bytes are samples around 128. A chunk's input alone becomes floats.
    """
    n = len(x) * UP // DOWN
    h = _phases()
    for lo in range(0, n, CHUNK * UP):
        hi = min(n, lo + CHUNK * UP)
        a, b = lo * DOWN // UP - (TAPS - 1), (hi - 1) * DOWN // UP + 1  # the input that is looked at; zeros stand before it
        part = x[max(0, a) : b]
        part = part / 128.0 - 1 if part.dtype == np.uint8 else part
        windows = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(max(0, -a)), part]), TAPS)
        out = np.empty(hi - lo)
        for m in range(min(UP, hi - lo)):
            j = lo + m
            first, phase = j * DOWN // UP - lo * DOWN // UP, j * DOWN % UP
            count = (hi - lo - m + UP - 1) // UP
            out[m::UP] = windows[first : first + (count - 1) * DOWN + 1 : DOWN] @ h[phase]
        yield out


@lru_cache(1)
def _mel() -> np.ndarray:
    """Triangular filters, evenly spaced on the mel scale, bins x MELS."""
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    edges = 700 * (10 ** (np.linspace(mel(50.0), mel(TARGET / 2), MELS + 2) / 2595) - 1)
    bins = np.fft.rfftfreq(FRAME, 1 / TARGET)[:, None]
    up, down = (bins - edges[:-2]) / (edges[1:-1] - edges[:-2]), (edges[2:] - bins) / (edges[2:] - edges[1:-1])
    return np.maximum(0, np.minimum(up, down))


def log_mel(samples: np.ndarray) -> np.ndarray:
    """Log-mel energies in decibels, frames x MELS; at least one frame. Beside the result, memory is that of a chunk."""
    n = max(1, (len(samples) * UP // DOWN - FRAME) // HOP + 1)
    out, done, held = np.empty((n, MELS), np.float32), 0, np.zeros(0)
    window = np.hanning(FRAME)
    for chunk in resample(samples):
        held = np.concatenate([held, chunk])
        if len(held) < FRAME:
            continue
        frames = np.lib.stride_tricks.sliding_window_view(held, FRAME)[::HOP]
        for lo in range(0, len(frames), CHUNK // HOP):
            own = _energies(frames[lo : lo + CHUNK // HOP] * window)
            out[done : done + len(own)] = own
            done += len(own)
        held = held[len(frames) * HOP :]
    if not done:
        out[:] = _energies(np.concatenate([held, np.zeros(FRAME - len(held))])[None] * window)
    return out


def _energies(frames: np.ndarray) -> np.ndarray:
    spectrum = np.fft.rfft(frames, axis=1)
    return 10 * np.log10((spectrum.real**2 + spectrum.imag**2) @ _mel() + 1e-6)


def segments(energies: np.ndarray) -> list[tuple[int, int]]:
    """Frame ranges (end exclusive) of loud stretches, with hysteresis.

    A stretch of frames over CLOSE counts if one of its frames is over OPEN,
    both against the loudest frame.
    """
    level = energies.mean(axis=1)
    level = level - level.max()
    above = np.r_[False, level > CLOSE, False]
    edge = np.flatnonzero(above[1:] != above[:-1])
    starts, ends = edge[::2], edge[1::2]
    loud = [level[a:b].max() for a, b in zip(starts, ends)]
    return [(int(a), int(b)) for a, b, top in zip(starts, ends, loud) if top > OPEN]


def blocks(energies: np.ndarray) -> np.ndarray:
    """Energies in blocks of BLOCK_FRAMES x MELS, the last filled with the floor of -60 dB."""
    n = -(-len(energies) // BLOCK_FRAMES)
    out = np.full((n * BLOCK_FRAMES, MELS), -60, np.float32)
    out[: len(energies)] = energies
    return out.reshape(n, BLOCK_FRAMES, MELS)


def tensor_stream(energies: np.ndarray) -> bytes:
    """An Arrow stream: fixed-shape tensors of the blocks, and the seconds that each spans."""
    own = blocks(energies)
    starts = np.arange(len(own)) * BLOCK_FRAMES * HOP / TARGET
    ends = np.minimum(starts + BLOCK_FRAMES * HOP / TARGET, ((len(energies) - 1) * HOP + FRAME) / TARGET)
    batch = pa.RecordBatch.from_arrays([pa.array(starts), pa.array(ends), pa.FixedShapeTensorArray.from_numpy_ndarray(own)], ["start_s", "end_s", "log_mel"])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def feature_text(energies: np.ndarray) -> str:
    """Frames, blocks, segments and mean energies of one media value."""
    found = segments(energies)
    spans = ",".join(f"{a * HOP / TARGET:.3f}-{((b - 1) * HOP + FRAME) / TARGET:.3f}" for a, b in found)
    means = ",".join(f"{m:.1f}" for m in energies.mean(axis=0, dtype=np.float64))
    return f"frames={len(energies)};blocks={-(-len(energies) // BLOCK_FRAMES)}x{BLOCK_FRAMES}x{MELS};spans={spans};mel={means}"


def encode_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_bytes, media)``: every text as a WAV file."""
    n = F.octet_length(F.coalesce(F.col(text_col), F.lit("")))
    return docs.select(id_col, n.cast("long").alias("n_bytes"), wav_of(payload_of(text_col)).alias("media"))


def audio_features(media: DataFrame) -> DataFrame:
    """The columns of ``media`` with ``feature`` and ``tensors`` behind them.

    ``media`` has a binary column ``media``; each value is worked on by itself,
    so equal values give equal features. ``tensors`` is the Arrow stream of the
    log-mel blocks with their time spans (``tensor_stream``). Null media gives nulls.
    Columns of these names are replaced.
    """
    names = [c for c in media.columns if c not in ("feature", "tensors")]
    at = names.index("media")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                text, tensors = [], []
                for m in part.column(at):
                    raw = m.as_py()
                    e = None if raw is None else log_mel(read_wav(raw))
                    text.append(None if e is None else feature_text(e))
                    tensors.append(None if e is None else tensor_stream(e))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(text, pa.string()), pa.array(tensors, pa.binary())], [*names, "feature", "tensors"])

    own = media.select(*names)
    return own.mapInArrow(run, own.select(*names).schema.add("feature", "string").add("tensors", "binary"))


def audio_digests(docs: DataFrame) -> DataFrame:
    """Sizes, hashes and features of every text's stored media.

    Null texts are empty: a payload of 64 zeros. Null ids stay. Repeated rows
    give repeated rows, an empty table none; other columns are ignored. The payload's hashes
    are taken from the stored bytes behind the header, and ``feature`` ends with the hash of
    the Arrow stream of tensors.
    """
    size = F.octet_length("media")
    back = F.substring("media", HEADER + 1, size)
    return audio_features(encode_media(docs)).select(
        "doc_id", "n_bytes", (size - HEADER).cast("long").alias("payload_bytes"), F.sha2(back, 256).alias("payload_sha256"),
        F.crc32(F.substring("media", -PAD, PAD)).alias("tail_crc32"), size.cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"),
        F.concat("feature", F.lit(";tensors="), F.sha2("tensors", 256)).alias("feature"), F.octet_length("tensors").cast("long").alias("tensor_bytes"),
    )
