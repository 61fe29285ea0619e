"""Vectorized scanning of UTF-8 text columns: words, lines and rolling hashes over Arrow buffers with numpy.

A word is a run of bytes outside space and 0x09-0x0D. All of these separators are ASCII, so working on bytes
gives the same words as working on code points. Nulls count as empty texts.
"""

from __future__ import annotations

import ctypes
import functools
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401

#: Bytes scanned at once; longer single documents are scanned alone.
SLICE_BYTES = 2 << 20
#: Bytes hashed at once.
BLOCK_BYTES = 1 << 20

IS_WORD = np.ones(256, dtype=bool)
IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
#: True for the first byte of each code point.
IS_LEAD = (np.arange(256) & 0xC0) != 0x80

BASE = np.uint64(0x9E3779B97F4A7C15)
UNBASE = np.uint64(pow(int(BASE), -1, 1 << 64))
_BYTE_VALUE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_powers: dict[int, np.ndarray] = {}


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64; grown as needed and kept."""
    have = _powers.get(int(base))
    if have is None or len(have) < n:
        steps = np.full(max(n, BLOCK_BYTES), base, dtype=np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[int(base)] = have
    return have[:n]


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte span data[starts[i]:ends[i]]; spans ascend and don't overlap."""
    out = np.zeros(len(starts), dtype=np.uint64)
    at = 0
    while at < len(starts):
        begin = int(starts[at])
        stop = int(np.searchsorted(ends, begin + BLOCK_BYTES, "right"))
        if stop <= at:  # one span longer than a block
            digest = hashlib.blake2b(data[begin : ends[at]], digest_size=8).digest()
            out[at] = int.from_bytes(digest, "little")
            at += 1
            continue
        block = _BYTE_VALUE[data[begin : ends[stop - 1]]]
        sums = np.zeros(len(block) + 1, dtype=np.uint64)
        np.cumsum(block * powers(BASE, len(block)), out=sums[1:])
        s, e = starts[at:stop] - begin, ends[at:stop] - begin
        # the length enters too, so that no span is a scaled copy of another
        out[at:stop] = mix64((sums[e] - sums[s]) * powers(UNBASE, len(block) + 1)[s] + (e - s).astype(np.uint64))
        at = stop
    return out


class TextSlice:
    """Words of a run of documents. Offsets are into ``data``; ``word_off`` has the words' range of each document."""

    def __init__(self, texts: pa.Array):
        texts = texts.cast(pa.large_string()).fill_null("")
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        offsets = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
        buffer = texts.buffers()[2]
        whole = np.frombuffer(buffer, dtype=np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]] if len(offsets) else whole[:0]
        self.doc_off = (offsets - offsets[0]).astype(np.int64) if len(offsets) else np.zeros(1, np.int64)
        self.n_docs = len(texts)
        inside = IS_WORD[self.data]
        edges = self.doc_off[(self.doc_off > 0) & (self.doc_off < len(inside))]
        before = np.zeros(len(inside), dtype=bool)
        before[1:] = inside[:-1]
        before[edges] = False
        after = np.zeros(len(inside), dtype=bool)
        after[:-1] = inside[1:]
        after[edges - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.word_off = np.searchsorted(self.starts, self.doc_off)
        self.word_doc = np.repeat(np.arange(self.n_docs), np.diff(self.word_off))

    def word_hashes(self) -> np.ndarray:
        return hash_spans(self.data, self.starts, self.ends)

    def counts(self, table: np.ndarray) -> np.ndarray:
        """Per document, how many bytes have a true entry in the 256-entry ``table``."""
        return self.per_doc_bytes(table[self.data])

    def per_doc_bytes(self, flags: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=sums[1:])
        return np.diff(sums[self.doc_off])

    def per_doc_words(self, values: np.ndarray) -> np.ndarray:
        sums = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=sums[1:])
        return np.diff(sums[self.word_off])

    def word_chars(self) -> np.ndarray:
        """Code points of each word."""
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(IS_LEAD[self.data], out=sums[1:])
        return sums[self.ends] - sums[self.starts]

    def lines(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, start, end) of each \\n-split line that holds a word."""
        breaks = np.flatnonzero(self.data == 0x0A)
        starts = np.concatenate([self.doc_off[:-1], breaks + 1])
        ends = np.concatenate([breaks, self.doc_off[1:]])
        starts.sort()
        ends.sort()
        starts = np.minimum(starts, len(self.data))
        holds = np.searchsorted(self.starts, ends) > np.searchsorted(self.starts, starts)
        starts, ends = starts[holds], ends[holds]
        return np.searchsorted(self.doc_off, starts, "right") - 1, starts, ends


def window_hashes(hashes: np.ndarray, n: int, base: np.uint64 = BASE) -> np.ndarray:
    """Rolling hash of each run of n values (as if all values were one sequence); empty if there are fewer than n."""
    if len(hashes) < n:
        return np.zeros(0, dtype=np.uint64)
    out = np.zeros(len(hashes) - n + 1, dtype=np.uint64)
    step = BLOCK_BYTES
    unbase = np.uint64(pow(int(base), -1, 1 << 64))
    for at in range(0, len(out), step):
        part = hashes[at : at + step + n - 1]
        sums = np.zeros(len(part) + 1, dtype=np.uint64)
        np.cumsum(part * powers(base, len(part)), out=sums[1:])
        m = len(part) - n + 1
        out[at : at + m] = mix64((sums[n:] - sums[:-n]) * powers(unbase, m))
    return out


def window_starts(word_off: np.ndarray, n: int) -> np.ndarray:
    """Words at which a window of n words of one document begins, ascending."""
    counts = np.maximum(np.diff(word_off) - n + 1, 0)
    total = int(counts.sum())
    if not total:
        return np.zeros(0, dtype=np.int64)
    firsts = np.cumsum(counts) - counts
    return np.repeat(word_off[:-1] - firsts, counts) + np.arange(total)


def cover(starts: np.ndarray, n: int, total: int) -> np.ndarray:
    """Which of ``total`` words lie in a window of n words at one of ``starts``."""
    if not len(starts):
        return np.zeros(total, dtype=bool)
    marks = np.bincount(starts, minlength=total + 1) - np.bincount(starts + n, minlength=total + 1)
    return np.cumsum(marks[:total]) > 0


def repeated(keys: np.ndarray) -> np.ndarray:
    """True where a value occurs at least twice."""
    return member(keys, sorted_distinct(keys)[1])


def sorted_distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different values, ascending, and those that occur at least twice, ascending."""
    ordered = np.sort(keys)
    same = ordered[1:] == ordered[:-1]
    twice = ordered[1:][same]
    first = np.ones(len(twice), dtype=bool)
    first[1:] = twice[1:] != twice[:-1]
    return np.concatenate([ordered[:1], ordered[1:][~same]]), twice[first]


def member(values: np.ndarray, among: np.ndarray) -> np.ndarray:
    """Which values are in the ascending ``among``."""
    if not len(among):
        return np.zeros(len(values), dtype=bool)
    return among[np.minimum(np.searchsorted(among, values), len(among) - 1)] == values


def distinct_per_doc(docs: np.ndarray, hashes: np.ndarray, n_docs: int) -> np.ndarray:
    """How many different hashes each document has, told apart by 40 bits or more: a measure, not a proof."""
    shift = np.uint64(64 - min(24, int(n_docs).bit_length()))
    keys = np.sort((docs.astype(np.uint64) << shift) | (hashes >> (np.uint64(64) - shift)))
    first = np.ones(len(keys), dtype=bool)
    first[1:] = keys[1:] != keys[:-1]
    return np.bincount((keys[first] >> shift).astype(np.int64), minlength=n_docs)


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run`` for mapInArrow, which gives freed memory back to the system at its end: workers stay for later stages."""

    @functools.wraps(run)
    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            _powers.clear()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
            if trim is not None:
                trim(0)

    return wrapped


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch into runs of whole rows of about ``limit`` bytes of text."""
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(column)), 0), dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(lengths)])
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(sums, sums[at] + limit, "right")) - 1)
        yield batch.slice(at, stop - at)
        at = stop
