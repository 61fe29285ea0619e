"""Substring dedup by repeated-phrase automata.

A window is ``n`` consecutive words of one document. A word goes if a window covers it whose word sequence also starts
in a document with a smaller id. Documents are dealt into shards of whole documents by a hash of id and text, so that rows
of one id don't meet in one task; there are as many shards as keep one at about ``SHARD_BYTES``. Every later step sends
only short digests between shards:

1. Each shard lists the 40-bit hashes of its windows, packed and sorted; a reducer per hash range marks those seen
   in two documents or more and answers each list with a bit map. What is left are the candidates.
2. Candidates are confirmed by 128-bit digests of their words, with the smallest document id of the shard; the answer
   says which of them start in a smaller document of another shard.
3. Each shard compiles its confirmed passages into Aho-Corasick automata over word numbers (several small ones, so
   that memory is bounded), streams all of its documents through them, and locates every occurrence.

Edge cases: null texts have no words; empty texts and texts shorter than a window lose nothing; rows that repeat an id
count as one document's parts, in which no window makes another one go, unless a smaller id holds it; a null id
sorts before all others and such rows lose nothing to each other.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm import bytescan as bs
from siftworks.shared import materialize, shuffle_partitions

WINDOW = 13
#: Shards of documents for each shuffle partition, at least.
SHARDS_PER_PARTITION = 2
#: Text of one shard, about; a shard's texts and word hashes are held by one task.
SHARD_BYTES = 32 << 20
#: Phrases in one automaton: about 120 bytes for each of their words.
AUTOMATON_PHRASES = 80_000
HASH_BITS = 40
_BASE2 = np.uint64(0xD1342543DE82EF95)
_NULL_ID = np.iinfo(np.int64).min

SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


class Shard:
    """The documents of one shard with the digests of their windows; scanned in slices, so only words' hashes stay."""

    def __init__(self, table: pa.Table, n: int):
        table = table.combine_chunks()
        ids = table["doc_id"].combine_chunks() if isinstance(table["doc_id"], pa.ChunkedArray) else table["doc_id"]
        self.ids = np.asarray(ids.fill_null(_NULL_ID), dtype=np.int64)
        hashes, offsets = [np.zeros(0, np.uint64)], [np.zeros(1, np.int64)]
        for batch in table.select(["text"]).to_batches():
            for part in bs.slices(batch, "text"):
                t = bs.TextSlice(part.column("text"))
                hashes.append(t.word_hashes())
                offsets.append(t.word_off[1:] + offsets[-1][-1])
        self.words = np.concatenate(hashes)
        self.word_off = np.concatenate(offsets)
        self.n = n
        self.at = bs.window_starts(self.word_off, n)
        self.window = bs.window_hashes(self.words, n)[self.at] if len(self.at) else np.zeros(0, np.uint64)

    def doc_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.word_off, words, "right") - 1

    def short(self) -> tuple[np.ndarray, np.ndarray]:
        """The different 40-bit window hashes, ascending, and which occur in two documents of this shard."""
        keys = self.window >> np.uint64(64 - HASH_BITS)
        unique, twice = bs.sorted_distinct(keys)
        several = np.zeros(len(unique), dtype=bool)
        if len(twice):
            again = bs.member(keys, twice)
            k, d = keys[again], self.ids[self.doc_of(self.at[again])]
            order = np.lexsort((d, k))
            k, d = k[order], d[order]
            differ = (k[1:] == k[:-1]) & (d[1:] != d[:-1])
            several[np.searchsorted(unique, k[1:][differ])] = True
        return unique, several

    def long(self, candidates: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the windows with a candidate's 40-bit hash: each different one's two 64-bit digests (ascending), the smallest
        document id, and the word at which it begins there."""
        keys = self.window >> np.uint64(64 - HASH_BITS)
        hit = bs.member(keys, candidates)
        at, one = self.at[hit], self.window[hit]
        two = bs.window_hashes(bs.mix64(self.words + np.uint64(1)), self.n, _BASE2)[at] if len(at) else one
        ids = self.ids[self.doc_of(at)]
        order = np.lexsort((at, ids, two, one))
        at, one, two, ids = at[order], one[order], two[order], ids[order]
        first = np.ones(len(at), dtype=bool)
        first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
        self.several = np.zeros(int(first.sum()), dtype=bool)
        group = np.cumsum(first) - 1
        self.several[group[ids != ids[first][group]]] = True
        return one[first], two[first], ids[first], at[first]


def _pack_sorted(keys: np.ndarray) -> bytes:
    """Ascending values of one range as differences of three bytes each (a zero difference carries a skip of 2**24 - 1)."""
    gaps = np.diff(keys, prepend=np.uint64(0)).astype(np.uint64)
    wide = np.flatnonzero(gaps >= 1 << 24)
    head = np.array([len(keys), len(wide)], "<u4").tobytes()
    small = gaps.copy()
    small[wide] = 0
    body = small.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
    return head + wide.astype("<u4").tobytes() + gaps[wide].astype("<u8").tobytes() + body


def _unpack_sorted(blob: bytes) -> np.ndarray:
    n, w = np.frombuffer(blob, "<u4", 2)
    at = 8 + 4 * int(w)
    wide = np.frombuffer(blob, "<u4", w, 8)
    values = np.frombuffer(blob, np.uint8, offset=at + 8 * int(w)).reshape(-1, 3).astype(np.uint64)
    gaps = values[:, 0] | values[:, 1] << np.uint64(8) | values[:, 2] << np.uint64(16)
    gaps[wide] = np.frombuffer(blob, "<u8", w, at)
    assert len(gaps) == n
    return np.cumsum(gaps, dtype=np.uint64)


def _split(keys: np.ndarray, bits: int, ranges: int) -> Iterator[tuple[int, int, int]]:
    """(range, start, end) of ascending ``bits``-bit values, by ``ranges`` equal ranges of values."""
    of = ((keys >> np.uint64(bits - 26)) * np.uint64(ranges)) >> np.uint64(26)
    cuts = np.flatnonzero(np.diff(of)) + 1
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True):
        if e > s:
            yield int(of[s]), s, e


def _shared_between(lists: list[np.ndarray]) -> np.ndarray:
    """Values that at least two of the lists hold (each list has a value once)."""
    return bs.sorted_distinct(np.concatenate(lists))[1]


_BITS = "shard int, range int, bits binary"


def _answer_short(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For one range of 40-bit hashes: per shard a bit map of those that another shard has too."""
    lists = [_unpack_sorted(b) for b in table["keys"].to_pylist()]
    shared = _shared_between(lists)
    bits = [np.packbits(bs.member(x, shared)).tobytes() for x in lists]
    return pa.table({"shard": table["shard"], "range": table["range"], "bits": pa.array(bits, pa.binary())})


def _answer_long(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """For one range of digests: per shard a bit map of those that start in a smaller document of another shard."""
    parts = [np.frombuffer(b, dtype=[("one", "<u8"), ("two", "<u8"), ("id", "<i8")]) for b in table["keys"].to_pylist()]
    whole = np.concatenate(parts)
    order = np.lexsort((whole["id"], whole["two"], whole["one"]))
    one, two, ids = whole["one"][order], whole["two"][order], whole["id"][order]
    first = np.ones(len(whole), dtype=bool)
    first[1:] = (one[1:] != one[:-1]) | (two[1:] != two[:-1])
    smaller = np.zeros(len(whole), dtype=bool)
    smaller[order] = ids > ids[first][np.cumsum(first) - 1]
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    bits = [np.packbits(x).tobytes() for x in np.split(smaller, cuts)]
    return pa.table({"shard": table["shard"], "range": table["range"], "bits": pa.array(bits, pa.binary())})


def _read_bits(answers: pa.Table, sizes: dict[int, tuple[int, int]], total: int) -> np.ndarray:
    flags = np.zeros(total, dtype=bool)
    for r, b in zip(answers["range"].to_pylist(), answers["bits"].to_pylist(), strict=True):
        s, e = sizes[r]
        flags[s:e] = np.unpackbits(np.frombuffer(b, np.uint8), count=e - s).astype(bool)
    return flags


def locate(words: np.ndarray, word_off: np.ndarray, ids: np.ndarray, starts: np.ndarray, limits: np.ndarray, n: int) -> np.ndarray:
    """Which words are covered by a phrase: ``starts`` are words at which phrases of n words begin, and a phrase counts in
    documents with an id above its limit. All documents are streamed through each automaton."""
    import ahocorasick

    covered = np.zeros(len(words), dtype=bool)
    if not len(starts):
        return covered
    inner = np.unique(words[(starts[:, None] + np.arange(n)).ravel()])
    where = np.minimum(np.searchsorted(inner, words), len(inner) - 1)
    numbers = np.where(inner[where] == words, where + 1, 0)  # 0: in no phrase
    # a state's followers are searched one by one, so a word is two characters of an alphabet of twice the root's size
    side = int(len(inner) ** 0.5) + 1
    symbols = np.column_stack([numbers // side, numbers % side + side]).ravel() + 1
    symbols[symbols >= 0xD800] += 0x800  # these stand for no character
    text = symbols.astype("<u4").tobytes().decode("utf-32-le")
    # a word in no phrase sends an automaton back to its root: stretches between such words that are too short are passed over
    known = np.concatenate([[0], np.cumsum(numbers > 0)])
    at = bs.window_starts(word_off, n)
    near = bs.cover(at[known[at + n] - known[at] == n], n, len(words))
    edges = np.zeros(len(words) + 1, dtype=bool)
    edges[word_off] = True
    turns = np.diff(near.astype(np.int8), prepend=0, append=0) != 0
    cuts = np.flatnonzero(turns | edges)
    begins, stops = cuts[:-1][near[cuts[:-1]]], cuts[1:][near[cuts[:-1]]]
    owners = ids[np.searchsorted(word_off, begins, "right") - 1]
    for at in range(0, len(starts), AUTOMATON_PHRASES):
        machine = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for k, start in enumerate(starts[at : at + AUTOMATON_PHRASES].tolist(), at):
            machine.add_word(text[2 * start : 2 * (start + n)], k)
        machine.make_automaton()
        for s, e, owner in zip(begins.tolist(), stops.tolist(), owners.tolist(), strict=True):
            hits = np.array(list(machine.iter(text[2 * s : 2 * e])), dtype=np.int64).reshape(-1, 2)
            if len(hits):
                last = hits[limits[hits[:, 1]] < owner, 0] // 2
                covered[s:e] |= bs.cover(last - n + 1, n, e - s)
    return covered


def remove_repeated_phrases(docs: DataFrame, n: int = WINDOW) -> DataFrame:
    """One row of SCHEMA, with kept_text, per row of ``docs`` (doc_id, text)."""
    spark = docs.sparkSession
    ranges = shuffle_partitions(spark)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS_PER_PARTITION * ranges, -(-size // SHARD_BYTES))
    dealt = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn(
        "shard", F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int")
    )
    dealt = dealt.repartition("shard")

    def list_short(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        unique, _ = Shard(table, n).short()
        rows = [(key[0].as_py(), r, _pack_sorted(unique[s:e])) for r, s, e in _split(unique, HASH_BITS, ranges)]
        return _rows(rows)

    def _rows(rows: list[tuple]) -> pa.Table:
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        types = (pa.int32(), pa.int32(), pa.binary())
        return pa.table({c: pa.array(x, t) for c, x, t in zip(("shard", "range", "keys"), columns, types, strict=True)})

    def confirmed(shard: Shard, answers: pa.Table) -> tuple:
        unique, several = shard.short()
        seen = _read_bits(answers, {r: (s, e) for r, s, e in _split(unique, HASH_BITS, ranges)}, len(unique))
        return shard.long(unique[seen | several])

    def list_long(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        one, two, ids, _ = confirmed(Shard(table, n), answers)
        packed = np.rec.fromarrays([one, two, ids], dtype=[("one", "<u8"), ("two", "<u8"), ("id", "<i8")])
        return _rows([(key[0].as_py(), r, packed[s:e].tobytes()) for r, s, e in _split(one, 64, ranges)])

    def remove(key: tuple[pa.Scalar, ...], table: pa.Table, answers: pa.Table) -> pa.Table:
        shard = Shard(table, n)
        step = answers["step"].to_numpy()
        one, _, ids, at = confirmed(shard, answers.filter(pa.array(step == 1)))
        elsewhere = _read_bits(answers.filter(pa.array(step == 2)), {r: (s, e) for r, s, e in _split(one, 64, ranges)}, len(one))
        # a phrase goes from documents above its limit: all, if a smaller document elsewhere has it
        use = elsewhere | shard.several
        limits = np.where(elsewhere, _NULL_ID, ids)[use]
        covered = locate(shard.words, shard.word_off, shard.ids, at[use], limits, n)
        kept_text, digests = [], []
        row = 0
        for text in table["text"].to_pylist():
            s, e = shard.word_off[row : row + 2]
            words = (text or "").encode().split()
            kept = b" ".join([w for w, gone in zip(words, covered[s:e].tolist(), strict=True) if not gone])
            kept_text.append(kept.decode())
            digests.append(hashlib.sha256(kept).hexdigest())
            row += 1
        sums = np.concatenate([[0], np.cumsum(covered)])
        return pa.table(
            {
                "doc_id": table["doc_id"],
                "n_words": pa.array(np.diff(shard.word_off), pa.int64()),
                "n_removed": pa.array(np.diff(sums[shard.word_off]), pa.int64()),
                "kept_sha256": pa.array(digests),
                "kept_text": pa.array(kept_text),
            }
        )

    keys = "shard int, range int, keys binary"
    by_shard = dealt.groupBy("shard")
    short = by_shard.applyInArrow(list_short, keys)
    found = materialize(short.groupBy("range").applyInArrow(_answer_short, _BITS), "phrases-short")
    long = by_shard.cogroup(found.groupBy("shard")).applyInArrow(list_long, keys)
    owned = long.groupBy("range").applyInArrow(_answer_long, _BITS)
    answers = found.withColumn("step", F.lit(1)).unionByName(owned.withColumn("step", F.lit(2)))
    return by_shard.cogroup(answers.groupBy("shard")).applyInArrow(remove, f"{SCHEMA}, kept_text string")
