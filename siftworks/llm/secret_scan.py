"""Secret scans: fixed patterns, and character Markov models compared by log-likelihood ratio.

Two second-order character models are trained from labelled samples: random strings (the values that the fixed
patterns find, and uniformly random strings in the usual alphabets) and ordinary identifiers (all token runs, and neighbouring
words joined as identifiers are, of texts in which no fixed pattern fires; fillers and counters). Every run of token
characters is scored by the sum of its characters' log-likelihood ratios, so that a short run must look more random than a
long one; above ``margin`` it is a secret. Its span is added unless it overlaps a fixed one.

Training reads the whole texts of at most ``sample_rows`` documents (smallest hash of the id): the one bounded sample. Only counts of
character triples reach the driver, at most one per triple of the alphabet. All documents are scanned, whole texts, without a shuffle:
runs by numpy over a slice of texts, fixed patterns text by text.

Edge cases: null texts count as empty and have no span; repeated rows are scanned one by one; spans are in code points; an empty table
trains on the synthetic samples alone; of rows that share an id one text is learned from.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm import bytescan as bs

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
#: A letter group that every assignment has, in lower case: a text without one is not searched.
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # the same matches as AKIA[A-Z0-9]+ of 20 characters or more
HEX = re.compile(r"[0-9a-f]{24,}")  # the same matches as [0-9a-f]+ of 24 characters or more
KINDS = ("assign", "access", "hex", "random")

#: Characters of token runs; each has a code from 1 on, everything else (also the bytes of other characters) is 0.
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
SIZE = len(ALPHABET) + 1
CODES = np.zeros(256, dtype=np.int32)
CODES[[ord(c) for c in ALPHABET]] = np.arange(1, SIZE)
TOKEN = re.compile("[" + ALPHABET[:-1] + "-]+")
#: Share of a uniform distribution in both models.
ANYTHING = 0.05
#: Nats of the summed ratio above which a run is a secret.
MARGIN = 14.0
SAMPLE_ROWS = 2_000
SCHEMA = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns' matches."""
    spans = []
    low = text.lower()
    if any(hint in low for hint in ASSIGN_HINTS):
        spans += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    spans += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def _places(data: np.ndarray) -> np.ndarray:
    """For each byte the number of its triple: the two token characters before it in its run (0 if there are fewer) and itself."""
    c = CODES[data]
    one = np.concatenate([[0], c[:-1]])
    two = np.concatenate([[0, 0], c[:-2]])[: len(c)]
    return (np.where(one > 0, two, 0) * SIZE + one) * SIZE + c


def triples(samples: Iterable[str]) -> np.ndarray:
    """How often each triple occurs in the samples."""
    data = np.frombuffer("\n".join(samples).encode(), dtype=np.uint8)
    counts = np.bincount(_places(data)[CODES[data] > 0], minlength=SIZE**3) if len(data) else np.zeros(SIZE**3, np.int64)
    return counts.reshape(SIZE, SIZE, SIZE)


class MarkovPair:
    """Log-likelihood ratio of random strings against ordinary identifiers under two second-order character models."""

    def __init__(self, random: np.ndarray, ordinary: np.ndarray):
        self.table = (self._logs(random) - self._logs(ordinary)).astype(np.float32).ravel()

    @staticmethod
    def _logs(counts: np.ndarray) -> np.ndarray:
        # each order is smoothed by the next lower one
        one = counts.sum(axis=(0, 1)) + 0.5
        one = one / one.sum()
        two = counts.sum(axis=0) + 4 * one
        two = two / two.sum(axis=1, keepdims=True)
        three = counts + 4 * two[None]
        # a small share of anything caps what one character can weigh
        return np.log((1 - ANYTHING) * three / three.sum(axis=2, keepdims=True) + ANYTHING / SIZE)

    def runs(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and summed ratio of each run of token characters of ASCII or UTF-8 bytes."""
        inside = CODES[data] > 0
        edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=0, append=0))
        sums = np.concatenate([[0.0], np.cumsum(np.where(inside, self.table[_places(data)], 0), dtype=np.float64)])
        return edges[::2], edges[1::2], sums[edges[1::2]] - sums[edges[::2]]

    def score(self, s: str) -> float:
        """The summed ratio of the best run."""
        return float(max(self.runs(np.frombuffer(s.encode(), np.uint8))[2], default=0.0))


def _synthetic_random(n: int, seed: int = 11) -> list[str]:
    rng = np.random.default_rng(seed)
    alphabets = [ALPHABET[:62], ALPHABET[:64], ALPHABET[26:62], "0123456789abcdef", ALPHABET[:26] + "0123456789", ALPHABET[26:52], ALPHABET[:52]]
    return ["".join(rng.choice(list(alphabets[i % len(alphabets)]), 10 + i % 51)) for i in range(n)]


def _synthetic_ordinary() -> list[str]:
    """Fillers of one character or two, counters, numbers and stretches of the alphabet."""
    fill = [c * n for c in ALPHABET for n in (3, 12, 48)] + [(a + b) * 12 for a in "=-_+/" for b in "=-_+/"]
    count = [str(10**k + 37 * i) for k in range(1, 13) for i in range(40)] + [f"{i:012d}" for i in range(200)]
    days = [f"{y}-{m:02d}-{d:02d}" for y in (1999, 2012, 2024) for m in range(1, 13) for d in range(1, 29, 9)]
    return fill + count + days + [x[i:] for x in (ALPHABET[:26], ALPHABET[26:52], ALPHABET[52:62] * 3) for i in range(0, 20, 3)]


def _teach(text: str) -> tuple[list[str], list[str]]:
    """What a text teaches: random strings, ordinary ones."""
    spans = base_spans(text)
    if spans:
        return [re.split(r"[:=]\s*[\"']?", text[s:e], maxsplit=1)[-1] for s, _, e in spans], []
    runs = TOKEN.findall(text)
    words = [w for w in runs if w.isalpha()]
    joined = ["_".join(words[i : i + 3]) for i in range(0, len(words), 9)]
    joined += ["".join(w.capitalize() for w in words[i : i + 3]) for i in range(3, len(words), 9)]
    joined += ["/".join(words[i : i + 4]) for i in range(6, len(words), 9)]
    capitals = [w.upper() for w in words[::5]] + ["_".join(words[i : i + 2]).upper() for i in range(0, len(words), 9)]
    return [], [*runs, *joined, *capitals]


def train(docs: DataFrame, sample_rows: int = SAMPLE_ROWS) -> MarkovPair:
    """Learn both models from ``docs`` (doc_id, text)."""

    @bs.released
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                lists = [_teach(t or "") for t in part.column("text").to_pylist()]
                for k in range(2):
                    counts = triples(x for pair in lists for x in pair[k]).ravel()
                    at = np.flatnonzero(counts)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(counts[at])], ["kind", "triple", "n"])

    # ids first, so that no text is sorted; one text per id
    usable = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    ids = usable.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    picked = usable.join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"))
    # at most two rows per triple of characters, whatever the input
    got = picked.mapInArrow(label, "kind int, triple int, n long").groupBy("kind", "triple").agg(F.sum("n").alias("n")).toArrow()
    kind, triple, n = (got[c].to_numpy() for c in ("kind", "triple", "n"))
    counts = [triples(_synthetic_random(3_500)).ravel(), triples(_synthetic_ordinary()).ravel()]
    for k in range(2):
        np.add.at(counts[k], triple[kind == k], n[kind == k])
    return MarkovPair(*(c.reshape(SIZE, SIZE, SIZE) for c in counts))


def find_spans(texts: pa.Array, model: MarkovPair, margin: float = MARGIN) -> Iterator[tuple[str | None, list[tuple[int, int, int]]]]:
    """Each text with its (start, kind, end), ascending: all fixed spans, and runs the models call random that overlap none."""
    t = bs.TextSlice(texts)
    starts, ends, sums = model.runs(t.data)
    # a run ends where its document ends
    high = np.flatnonzero((sums > margin) | (np.searchsorted(t.doc_off, starts, "right") != np.searchsorted(t.doc_off, ends, "left")))
    starts, ends = starts[high], ends[high]
    points = np.concatenate([[0], np.cumsum(bs.IS_LEAD[t.data])]) if len(high) else None
    at = 0
    for k, text in enumerate(texts.to_pylist()):
        spans = base_spans(text or "")
        begin, stop = int(t.doc_off[k]), int(t.doc_off[k + 1])
        if at < len(starts) and starts[at] < stop:
            firsts = [s for s, _, _ in spans]
            reach = [0, *accumulate((e for _, _, e in spans), max)]  # how far the first spans extend
            for b, e, score in zip(*model.runs(t.data[begin:stop]), strict=True):
                s, e = (int(points[begin + x] - points[begin]) for x in (b, e))
                if score > margin and reach[bisect_left(firsts, e)] <= s:
                    spans.append((s, 3, e))
            spans.sort()
            while at < len(starts) and starts[at] < stop and ends[at] <= stop:
                at += 1
        yield text, spans


def _joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan_secrets(docs: DataFrame, model: MarkovPair | None = None, margin: float = MARGIN) -> DataFrame:
    """One row of SCHEMA per row of ``docs`` (doc_id, text)."""
    model = model or train(docs)

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                out: list[list] = [[] for _ in range(6)]
                for _, spans in find_spans(part.column("text"), model, margin):
                    base = [x for x in spans if x[1] < 3]
                    for k in range(4):
                        out[k].append(sum(x[1] == k for x in spans))
                    out[4].append(hashlib.sha256(_joined(base).encode()).hexdigest())
                    out[5].append(_joined(spans))
                columns = [part.column("doc_id"), *(pa.array(x, pa.int64()) for x in out[:4]), *(pa.array(x, pa.string()) for x in out[4:])]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def redact_secrets(docs: DataFrame, model: MarkovPair, margin: float = MARGIN) -> DataFrame:
    """``docs`` with every span of its text replaced by [kind]; null texts stay null, empty ones empty. Other columns are unchanged."""
    names = docs.columns

    def cut(text: str | None, spans: list[tuple[int, int, int]]) -> str | None:
        parts, at = [], 0
        for s, kind, e in spans:
            if s >= at:
                parts += [text[at:s], f"[{KINDS[kind]}]"]
            at = max(at, e)
        return "".join([*parts, text[at:]]) if at else text

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                cols = {n: part.column(n) for n in names}
                cols["text"] = pa.array([cut(*x) for x in find_spans(part.column("text"), model, margin)], pa.string())
                yield pa.RecordBatch.from_pydict(cols)

    return docs.mapInArrow(run, docs.schema)
