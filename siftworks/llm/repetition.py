"""Quality rules by repetition coverage: rolling hashes of several n-gram lengths, in numpy over Arrow batches.

For each document: how many characters lie inside word n-grams that occur twice or more in it (first occurrence
included), for each n of ``LIMITS``, and inside lines equal to an earlier line. A document is kept if it passes the
base rule (enough words, few words in repeated 8-word windows) and none of these shares exceeds its limit.

Edge cases: a null or empty text has no words, fails the base rule and is not kept; repeated rows each give a row;
further columns of the input are not read. Memory is bounded by a slice of about 2 MB of text (or one document).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from siftworks.llm import bytescan as bs

SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[[ord(c) for c in "#*$%&|<>"]] = True

MIN_WORDS = 20
BASE_WINDOW = 8
BASE_PERCENT = 30
#: Largest share (percent) of a document's word characters inside repeated n-grams of n words.
LIMITS = {5: 35, 6: 33, 7: 31, 8: 29, 9: 27, 10: 25}
#: Largest share (percent) of word characters inside lines equal to an earlier line.
LINE_LIMIT = 20

SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "base_failed boolean, kept boolean, dup_line_chars long, "
    + ", ".join(f"dup_{n}gram_chars long" for n in LIMITS)
)


def measure(texts: pa.Array, limits: dict[int, int] = LIMITS, line_limit: int = LINE_LIMIT) -> dict[str, np.ndarray]:
    """The columns of SCHEMA but doc_id, for a slice of texts."""
    t = bs.TextSlice(texts)
    words = np.diff(t.word_off)
    chars = t.word_chars()
    total = t.per_doc_words(chars)
    hashes = t.word_hashes()
    out = {"n_words": words, "word_chars": total, "n_symbols": t.counts(SYMBOLS)}

    docs, starts, ends = t.lines()
    keys = bs.mix64(bs.hash_spans(t.data, starts, ends) + bs.mix64(docs.astype(np.uint64)))
    order = np.argsort(keys, kind="stable")
    later = np.zeros(len(keys), dtype=bool)
    later[order[1:]] = keys[order[1:]] == keys[order[:-1]]
    out["n_dup_lines"] = np.bincount(docs[later], minlength=t.n_docs)
    word_sums = np.concatenate([[0], np.cumsum(chars)])
    line_chars = word_sums[np.searchsorted(t.starts, ends)] - word_sums[np.searchsorted(t.starts, starts)]
    out["dup_line_chars"] = np.bincount(docs[later], weights=line_chars[later], minlength=t.n_docs).astype(np.int64)

    bad = 100 * out["dup_line_chars"] > line_limit * total
    base_failed = words < MIN_WORDS
    for n in sorted({*limits, BASE_WINDOW}):
        at = bs.window_starts(t.word_off, n)
        keys = bs.window_hashes(hashes, n)[at] if len(at) else np.zeros(0, np.uint64)
        twice = bs.repeated(bs.mix64(keys + bs.mix64(t.word_doc[at].astype(np.uint64))))
        covered = bs.cover(at[twice], n, len(hashes))
        if n == BASE_WINDOW:
            out["n_repeat_words"] = t.per_doc_words(covered)
            base_failed |= 100 * out["n_repeat_words"] > BASE_PERCENT * words
        if n in limits:
            out[f"dup_{n}gram_chars"] = t.per_doc_words(np.where(covered, chars, 0))
            bad |= 100 * out[f"dup_{n}gram_chars"] > limits[n] * total
    out["base_failed"] = base_failed
    out["kept"] = ~base_failed & ~bad
    return out


def repetition_coverage(docs: DataFrame, text: str = "text", id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: SCHEMA, with ``id`` as doc_id. No shuffle."""
    names = [part.split()[0] for part in SCHEMA.split(", ")]

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                cols = {"doc_id": part.column("doc_id")} | measure(part.column("text"))
                yield pa.RecordBatch.from_pydict({n: pa.array(cols[n]) for n in names})

    return docs.selectExpr(f"cast(`{id}` as long) doc_id", f"`{text}` text").mapInArrow(run, SCHEMA)
