"""Secret scans: a character convolutional network over candidates in context.

Three base patterns give findings that always stay. Candidates are their values
and every longer token that mixes letters and digits or cases, or is long and
all letters. A network in numpy reads each candidate whole, whatever its
length, with the text before and behind it: a convolution over characters,
activations smoothed over ``SMOOTH`` places, a layer at each place, the maximum
over all places, one output. Nothing is cut, so a secret inside a long path
counts like one that stands by itself. Characters of the candidate and of its
context have codes of their own.

It is trained on labelled findings that a seeded generator writes: keys,
tokens, hashes and passphrases in the contexts in which they leak, against
identifiers, paths, dates, numbers, links and words. Scores are calibrated on a
held-out third; the threshold is a calibrated score of one half, or lower where
that is needed to keep ``RECALL`` of the held-out secrets. Base findings carry the network's score too; a candidate
that lies in a base finding adds no span.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string

from .common import FINDING, score_column, span_columns

KINDS = ["assign", "access", "hex"]
#: The base patterns, fixed values. Runs that are too short can't hold a longer one, so hex and access ask for the length at once.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Tokens that may be secrets: long ones, and shorter ones behind a sign of assignment or a quote.
CANDIDATE = re.compile(r"""[A-Za-z0-9+/_=~.-]{16,}|(?<=[=:"'])[A-Za-z0-9+/_=~.!@#$%^&*-]{8,15}""")
#: Letters alone are a candidate from this length on, or if they change case inside.
LETTERS = 24
#: Characters of context before and behind a candidate.
BEFORE, BEHIND = 24, 8
CODES, SPAN, FILTERS, SMOOTH, HIDDEN = 98, 4, 20, 16, 12
RECALL = 0.97
EXAMPLES, EPOCHS = 4500, 14
#: Ordinary words, of which the generator builds identifiers, paths and long words.
WORDS = """
about account action address after always answer apple array avenue balance basket before between black blue board body bottle bridge bright browser budget build button cache calendar cancel
carbon castle chapter check child circle cloud coffee column common company control copper corner create crystal customer damage dance dark default deliver desk device dinner direct document
domain double driver early east effect eight electric energy engine enough evening event every export extra factory family feature field filter finance finger flash floor flower football
forest format fresh friend frozen general glass global grade green ground guide handle happy health heavy helper holiday horse hotel image import index island jacket journey keeper kernel
kitchen ladder language large layer league letter library light limit little local machine manager market master memory message metal million minute mobile module money month mountain movie
museum native nature network night north number ocean office orange output owner package panel paper parent pattern people phone planet player please point police power price print private
profile project public python quality query quick quiet radio reader record region render repeat report result return river router sample school script search season section
"""
#: Characters that are scored together, and texts whose candidates are.
BLOCK, ROWS = 1 << 15, 256


@dataclass
class Network:
    kernel: np.ndarray  # SPAN x 2 CODES x FILTERS
    shift: np.ndarray
    inner: np.ndarray  # FILTERS x HIDDEN
    inner_shift: np.ndarray
    out: np.ndarray
    bias: float
    slope: float = 1.0  # of the calibration
    offset: float = 0.0
    threshold: float = 0.5


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, rank of kind, end, where the value begins) of the base findings."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans of all candidates of a text."""
    out = []
    for m in CANDIDATE.finditer(text):
        s = m[0].rstrip(".")
        letters = any(map(str.isalpha, s))
        if letters and (any(map(str.isdigit, s)) or len(s) >= LETTERS or not (s[1:].islower() or s.isupper() or len(s) < 16)):
            out.append((m.start(), m.start() + len(s)))
    return out


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Character codes of a whole candidate between its contexts; the candidate's codes stand above those of the contexts, 0 for nothing."""
    before, behind = text[max(0, start - BEFORE) : start].rjust(BEFORE, "\0"), text[end : end + BEHIND].ljust(BEHIND, "\0")
    codes = np.frombuffer((before + text[start:end] + behind).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    codes = np.where(codes == 0, 0, np.where((codes >= 32) & (codes < 127), codes - 30, 1))
    codes[BEFORE : len(codes) - BEHIND] += CODES
    return codes


def _smooth(z: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Sums over SMOOTH places that follow each other, within each segment, divided by SMOOTH."""
    total = np.concatenate([np.zeros((1, z.shape[1])), np.cumsum(z, axis=0)])
    at = np.arange(len(z))
    return (total[np.minimum(at + SMOOTH, np.repeat(first + size, size))] - total[at]) / SMOOTH


def _spread(g: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The transpose of ``_smooth``."""
    total = np.concatenate([np.zeros((1, g.shape[1])), np.cumsum(g, axis=0)])
    at = np.arange(len(g))
    return (total[at + 1] - total[np.maximum(at + 1 - SMOOTH, np.repeat(first, size))]) / SMOOTH


def forward(net: Network, rows: list[np.ndarray]) -> tuple[np.ndarray, dict]:
    """(logits, what the gradient needs) of candidates of any lengths, laid end to end."""
    sizes = np.array([len(r) for r in rows])
    codes, size = np.concatenate(rows), sizes - SPAN + 1
    start = np.cumsum(sizes) - sizes
    first = np.cumsum(size) - size
    at = np.repeat(start - first, size) + np.arange(size.sum())  # where each place's span begins
    x = codes[at[:, None] + np.arange(SPAN)]
    z = np.maximum(net.shift + sum(net.kernel[k][x[:, k]] for k in range(SPAN)), 0)
    smooth = _smooth(z, first, size)
    h = np.maximum(smooth @ net.inner + net.inner_shift, 0)
    top = np.maximum.reduceat(h, first, axis=0)
    return top @ net.out + net.bias, {"x": x, "z": z, "smooth": smooth, "h": h, "top": top, "first": first, "size": size}


def _probability(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -50, 50)))


def labelled(n: int, seed: int) -> tuple[list[tuple[str, int, int]], np.ndarray]:
    """``n`` labelled findings: (text, start, end) and whether it is a secret."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    some = lambda a, b: int(rng.integers(a, b))
    of = lambda alphabet, k: "".join(alphabet[i] for i in rng.integers(0, len(alphabet), k))
    digits, lower, upper, hexa = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"
    mixed = lower + upper + digits
    syllables = ["th", "er", "on", "an", "re", "tion", "en", "ing", "le", "de", "ung", "que", "ado", "ment", "st", "ra", "mi", "co", "pro", "ver", "sch", "ich", "el", "os", "ar", "ta", "user", "data", "file", "get", "index", "main", "node", "list"]
    words, consonants, vowels = WORDS.split(), "bcdfghjklmnpqrstvwxz", "aeiouy"
    spoken = lambda: "".join(pick(consonants) + pick(vowels) + pick(["", "", "n", "r", "s", "ll", "ch", "ck", "ft"]) for _ in range(some(1, 4)))
    word = lambda: pick(words) if rng.random() < 0.6 else spoken() if rng.random() < 0.3 else "".join(pick(syllables) for _ in range(some(1, 4)))
    prose = lambda: " ".join(word() for _ in range(some(3, 7)))
    path = lambda n: "/".join(word() for _ in range(n))
    camel = lambda n: "".join(word().title() for _ in range(n))
    random = lambda: of(mixed, some(20, 50))
    secret = [
        random, lambda: of(mixed + "+/", some(24, 90)) + pick(["", "=", "=="]), lambda: of(hexa, some(24, 65)), lambda: of(hexa.upper(), some(24, 65)), lambda: "AKIA" + of(upper + digits, 16),
        lambda: of(lower, some(2, 6)) + pick(["_", "-", "."]) + pick(["", of(lower, 4) + pick(["_", "-"])]) + of(mixed, some(20, 44)), lambda: of(mixed + "-_", some(16, 44)) + of(digits, 1),
        lambda: ".".join(of(mixed + "-_", some(18, 60)) for _ in range(3)), lambda: of(lower + upper, some(24, 44)), lambda: of(lower + digits, some(20, 44)), lambda: of(upper + digits, some(20, 44)),
        lambda: "-".join(of(hexa, k) for k in (8, 4, 4, 4, 12)), lambda: "-".join(of(digits, 12) for _ in range(2)) + "-" + of(mixed, some(20, 30)), lambda: of(mixed + "!@#$%^&*", some(10, 15)),
        lambda: path(some(1, 5)) + pick(["/", "=", "/key="]) + random() + pick(["", "/" + path(some(1, 3))]),
    ]
    leak = ['token = "', "Authorization: Bearer ", "api_key: ", 'password="', "secret=", "export KEY=", "client_secret: '", " key ", "aws_access_key_id = ", "credentials: ", "auth ", "pw: ", "pass=", "X-Api-Key: ", "bearer ", "private_key: ", "signature=", "access_token=", "passphrase: "]
    ordinary = ['id = "', "see ", "file: ", "name=", "from ", "version: ", "path = '", "import ", "url: ", "class ", "href=", "item ", "ref: ", "branch ", "label="]
    plain = [
        lambda: "_".join(word() for _ in range(some(2, 5))) + pick(["", "_" + of(digits, 2)]), lambda: path(some(2, 12)) + pick(["/" + of(digits, 4), "", ".py", ".html", "/index.html"]), lambda: "-".join([pick(["2024", "1999"]), of(digits, 2), of(digits, 2), word(), word()]),
        lambda: of(digits, 12) + word()[:3] + of(digits, 3), lambda: word() + word() + word() + of(digits, some(1, 4)) + word(), lambda: "v" + of(digits, 1) + "-" + "-".join([word(), word(), word()]),
        lambda: "-".join([of(digits, 4), of(digits, 4), of(digits, 4), word()]), lambda: word().upper() + "-" + of(digits, 8) + "-" + word().upper(), lambda: "=" * 12 + of(digits, 2) + word() + "=" * 8, lambda: word() + "=" + of(digits, 3) + "&" + word() + "=" + word() + of(digits, 12),
        lambda: camel(some(3, 6)), lambda: word() + camel(some(2, 5)), lambda: "".join(word() for _ in range(some(6, 12))), lambda: "".join(word() for _ in range(some(5, 9))).title(), lambda: path(some(3, 30)), lambda: "-".join(word() for _ in range(some(4, 14))),
        lambda: "www." + word() + "." + pick(["com", "org"]) + "/" + path(some(1, 5)), lambda: ".".join(word() for _ in range(some(3, 7))), lambda: "_".join(word().upper() for _ in range(some(3, 6))), lambda: word() + "-" + of(digits, 1) + "." + of(digits, 2) + "." + of(digits, 1) + "-" + word() + ".tar.gz",
        lambda: word() + of(digits, 2) + pick(["!", "#", ""]) + word(), lambda: "".join(pick(["ha", "na", "la", "xo", "-", "_", "="]) for _ in range(some(8, 30))), lambda: "T".join(["2024-" + of("01", 2) + "-" + of("12", 2), of("01", 2) + ":" + of("12345", 2)]).replace(":", "-") + "-" + word(),
    ]
    rows, y = [], []
    while len(rows) < n:
        good = rng.random() < 0.5
        own = (pick(secret) if good else pick(plain))()
        lead = pick(leak) if rng.random() < (0.65 if good else 0.08) else pick(ordinary) if rng.random() < 0.3 else ""
        before = prose() + " " + lead
        text = before + own + pick(["", '"', "'", ".", ";", ",", ")"]) + " " + prose()
        spans = [s for s in candidates(text) if s[0] < len(before) + len(own) and s[1] > len(before)]
        if spans:
            rows.append((text, *max(spans, key=lambda s: s[1] - s[0])))
            y.append(good)
    return rows, np.array(y)


def train(x: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 60, rate: float = 0.006, seed: int = 0) -> Network:
    """Fit by Adam on batches; the rate falls to a tenth. The maximum passes the gradient to one place."""
    rng = np.random.default_rng(seed)
    net = Network(rng.normal(0, 0.15, (SPAN, 2 * CODES, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.4, (FILTERS, HIDDEN)), np.full(HIDDEN, 0.05), rng.normal(0, 0.4, HIDDEN), 0.0)
    params = [net.kernel, net.shift, net.inner, net.inner_shift, net.out]
    m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    t, steps = 0, epochs * -(-len(x) // batch)
    for _ in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            i = order[lo : lo + batch]
            z, mem = forward(net, [x[j] for j in i])
            d = (_probability(z) - y[i]) / len(i)
            first, size, h, top = mem["first"], mem["size"], mem["h"], mem["top"]
            peak = (h == np.repeat(top, size, axis=0)) & (h > 0)
            number = np.cumsum(peak, axis=0)  # the first peak of each segment alone
            peak &= number == np.repeat(np.concatenate([np.zeros((1, HIDDEN)), number])[first], size, axis=0) + 1
            back = peak * np.repeat(d[:, None] * net.out, size, axis=0)
            g_smooth = back @ net.inner.T
            g_z = _spread(g_smooth, first, size) * (mem["z"] > 0)
            g_kernel = np.zeros_like(net.kernel)
            for k in range(SPAN):
                code = mem["x"][:, k]
                for f in range(FILTERS):
                    g_kernel[k, :, f] = np.bincount(code, g_z[:, f], 2 * CODES)
            t += 1
            step = rate * (1 - 0.9 * t / steps)
            for p, g, a, b in zip(params, (g_kernel + 1e-5 * net.kernel, g_z.sum(axis=0), mem["smooth"].T @ back, back.sum(axis=0), top.T @ d), m, v):
                a += 0.1 * (g - a)
                b += 0.001 * (g * g - b)
                p -= step * (a / (1 - 0.9**t)) / (np.sqrt(b / (1 - 0.999**t)) + 1e-8)
            net.bias -= step * d.sum()
    return net


def logits(net: Network, rows: list[np.ndarray]) -> np.ndarray:
    return np.concatenate([forward(net, rows[lo : lo + 64])[0] for lo in range(0, len(rows), 64)]) if rows else np.zeros(0)


def calibrate(net: Network, x: list[np.ndarray], y: np.ndarray, recall: float = RECALL) -> Network:
    """Fit slope and offset of the scores on held-out rows, and the threshold: one half, or less where ``recall`` asks for it."""
    z = logits(net, x)
    a, b = 1.0, 0.0
    for _ in range(50):  # Newton steps on the logistic loss, drawn towards the scores as they are
        p = _probability(a * z + b)
        w = p * (1 - p) + 1e-9
        g = np.array([((p - y) * z).sum() + 1.0 * (a - 1), (p - y).sum()])
        h = np.array([[(w * z * z).sum() + 1.0, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) - np.linalg.solve(h, g)
    net.slope, net.offset = float(a), float(b)
    p = np.sort(_probability(a * z + b)[y])
    net.threshold = min(0.5, float(p[int(np.floor((1 - recall) * len(p)))]))
    return net


@lru_cache(1)
def model() -> Network:
    """The network, trained once a process; equal in each, as all seeds are fixed."""
    rows, y = labelled(EXAMPLES, 11)
    x = [encode(*r) for r in rows]
    cut = len(x) * 2 // 3
    return calibrate(train(x[:cut], y[:cut]), x[cut:], y[cut:])


def scores(net: Network, text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """The calibrated score of each span, read whole."""
    return scores_of(net, [encode(text, a, b) for a, b in spans])


def scores_of(net: Network, rows: list[np.ndarray]) -> np.ndarray:
    out, lo = [], 0
    while lo < len(rows):
        hi, size = lo, 0
        while hi < len(rows) and (hi == lo or size + len(rows[hi]) <= BLOCK):
            size += len(rows[hi])
            hi += 1
        out.append(_long(net, rows[lo]) if size > 2 * BLOCK else forward(net, rows[lo:hi])[0])
        lo = hi
    return _probability(net.slope * np.concatenate(out) + net.offset) if out else np.zeros(0)


def _long(net: Network, row: np.ndarray) -> np.ndarray:
    """The logit of one very long candidate, in parts that overlap by all that one place looks at."""
    top = np.zeros(HIDDEN)
    for lo in range(0, len(row), BLOCK):
        part = row[lo : lo + BLOCK + SMOOTH + SPAN]
        if len(part) < SPAN:
            break
        mem = forward(net, [part])[1]
        own = mem["h"] if lo + len(part) == len(row) else mem["h"][:BLOCK]
        top = np.maximum(top, own.max(axis=0))
    return np.array([top @ net.out + net.bias])


def findings(texts: list[str | None], net: Network) -> list[list[dict]]:
    """All findings of each text, sorted: base ones, then candidates over the threshold that lie in no base finding."""
    found, rows, where = [], [], []
    for i, text in enumerate(texts):
        text = text or ""
        base = base_spans(text)
        own = [{"start": a, "rank": r, "end": b, "kind": KINDS[r], "base": True, "score": 0.0} for a, r, b, _ in base]
        for f, (_, _, b, value) in zip(own, base):
            rows.append(encode(text, value, b))
            where.append((i, f))
        reach, k = 0, 0
        for a, b in candidates(text):
            while k < len(base) and base[k][0] <= a:
                reach, k = max(reach, base[k][2]), k + 1
            if b > reach:
                rows.append(encode(text, a, b))
                where.append((i, {"start": a, "rank": len(KINDS), "end": b, "kind": "token", "base": False, "score": 0.0}))
        found.append(own)
    for (i, f), p in zip(where, scores_of(net, rows)):
        f["score"] = float(p)
        if not f["base"] and p >= net.threshold:
            found[i].append(f)
    return [sorted(own, key=lambda f: (f["start"], f["rank"])) for own in found]


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, findings)``: a sorted array of findings for every row.

    Offsets are code points of the whole text, end exclusive. Null texts are
    empty and have no findings. Repeated rows give repeated rows, an empty
    table none; other columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model())
    kind = to_arrow_type(_parse_datatype_string(f"array<{FINDING}>"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = sent.value
        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS):
                part = batch.slice(lo, ROWS)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(findings(part.column(1).to_pylist(), net), kind)], ["id", "findings"])

    name = docs.schema[id_col].dataType.simpleString()
    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).mapInArrow(run, f"id {name}, findings array<{FINDING}>")
    return out.withColumnRenamed("id", id_col)


def secret_digests(docs: DataFrame) -> DataFrame:
    """Counts, the base spans' hash, all spans and their scores of every row."""
    return find_secrets(docs).select("doc_id", *span_columns(F.col("findings"), KINDS), score_column(F.col("findings")))
