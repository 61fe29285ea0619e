"""Byte-level BPE by recursive queries: encoding inside each partition with DuckDB.

A text is cut into words and these into pieces by the vocabulary's pattern. Each different piece starts as one row per byte
(piece, position, token, next position, next token). A recursive query joins neighbouring tokens with the merge table,
contracts each piece's leftmost pair of minimum rank, and ends at the fixpoint, when no neighbours merge. The different words of
``BATCH_BYTES`` are coded as an Arrow dictionary, so that Python sees each once; their ids are gathered in the texts' order.
Decoding gathers each id's bytes from the vocabulary in the same way. Pieces encoded lately are remembered
in twice ``RECENT_BYTES`` a worker, so the recursion sees few rows; texts are streamed and nothing is shuffled.

A worker holds the vocabulary, what it remembers, the different words of ``BATCH_BYTES`` of text (or of one longer text)
and DuckDB's tables of ``QUERY_PIECES`` pieces.

Edge cases: a null text counts as empty (no tokens); repeated rows are encoded one by one; pieces of any length work,
those over ``long_piece`` bytes by a keyed recursion that holds one row per position instead of one per step (both
give the same ids at every length; the first needs a step for each merge).
"""

from __future__ import annotations

import base64
import hashlib
import itertools
import re
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm import bytescan as bs

#: Bytes from which on a piece is encoded by the keyed recursion.
LONG_PIECE = 128
#: Bytes of long pieces that take their steps together.
LONG_BYTES = 1 << 16
#: Pieces that take their steps together.
QUERY_PIECES = 1 << 15
#: Tokens decoded together; a longer text alone.
DECODE_TOKENS = 1 << 18
#: About as many bytes of words and pieces are remembered, twice: those met since the last turnover, and those before.
RECENT_BYTES = 16 << 20
#: Bytes of text whose words are encoded together.
BATCH_BYTES = 4 << 20
#: DuckDB's memory, and what it may use for each position of one longer piece.
DUCKDB_BYTES, DUCKDB_POSITION_BYTES = 96 << 20, 512
SCHEMA = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"

# public_tokenizers.PATTERN always cuts before a space that a visible character follows, whatever stands before it.
_LOOSE = re.compile(r" (?:\s|\Z)")
_CUT = re.compile(r" (?=\S)")
# It takes a run of letters whole, with one space before it.
_LETTERS = re.compile(r" ?[A-Za-z]+").fullmatch

_STEP = """
with recursive state(w, pos, tok, after, following, live) as (
    select w, pos, tok, after, following, true from pieces
  union all
    (with ranked as materialized (
        select s.w, s.pos, s.tok, s.after, s.following, m.merged
        from state s left join merges m on s.tok = m.lhs and s.following = m.rhs where s.live),
     best as materialized (
        select w, min((merged::bigint << 40) + (pos::bigint << 20) + after) as choice from ranked where merged is not null group by w),
     contracted as (
        select b.w, (b.choice >> 40)::int as merged, (b.choice >> 20 & 1048575)::int as left_pos, r.pos as right_pos, r.after, r.following
        from best b join ranked r on r.w = b.w and r.pos = (b.choice & 1048575)::int)
     select r.w, r.pos,
            case when r.pos = c.left_pos then c.merged else r.tok end,
            case when r.pos = c.left_pos then c.after else r.after end,
            case when r.pos = c.left_pos then c.following when r.after = c.left_pos then c.merged else r.following end,
            c.w is not null
     from ranked r left join contracted c on r.w = c.w
     where c.w is null or r.pos <> c.right_pos)
)
select w, tok from state where not live order by w, pos
"""

# One row per position, replaced in place: its token, null once merged away. A step contracts all pairs of a piece's minimum
# rank from left to right (every second one where they overlap), or the leftmost alone if its token begins or ends one of
# smaller rank: only then could the pairs that arise come before the others.
_KEYED = """
with recursive state(w, pos, tok) using key (w, pos) as (
    select w, pos, tok from pieces
  union
    (with pairs as (
        select w, pos, tok, lead(tok) over o as following, lead(pos) over o as after
        from recurring.state where tok is not null window o as (partition by w order by pos)),
     ranked as (
        select p.w, p.pos, p.after, m.merged, m.alone, min(m.merged) over (partition by p.w) as least
        from pairs p join near_merges m on p.tok = m.lhs and p.following = m.rhs),
     spots as (
        select w, pos, after, merged, alone, row_number() over o as k, lag(after) over o as reach
        from ranked where merged = least window o as (partition by w order by pos)),
     runs as (
        select *, k - max(case when reach is null or reach <> pos then k end) over (partition by w order by pos) as step
        from spots),
     chosen as (select * from runs where step % 2 = 0 and (k = 1 or not alone))
     select w, pos, merged from chosen union all select w, after, null::int from chosen)
)
select w, tok from state where tok is not null order by w, pos
"""


def load_ranks(path: str) -> dict[bytes, int]:
    """A rank file: lines of base64 bytes and a rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Recent:
    """A mapping that keeps about the last ``limit`` bytes' worth of what was put or found, and as much of what came before."""

    OVERHEAD = 210

    def __init__(self, limit: int):
        self.limit, self.size = limit, 0
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def find(self, keys: list[str]) -> list[bytes | None]:
        """What is remembered of each key, else None."""
        found = list(map(self.new.get, keys))
        again = [(i, v) for i, x in enumerate(found) if x is None and (v := self.old.get(keys[i])) is not None]
        for i, value in again:
            found[i] = value
            self.put(keys[i], value)
        return found

    def put(self, key: str, value: bytes) -> None:
        if self.size > self.limit:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += len(key) + len(value) + self.OVERHEAD


class Codec:
    """One process's DuckDB connection with the merge table, the vocabulary, and what is remembered."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, recent_bytes: int = RECENT_BYTES, long_piece: int = LONG_PIECE):
        import duckdb
        import regex

        self.ranks = ranks
        self.pattern = regex.compile(pattern)
        # known of this pattern; texts of any other are cut by the pattern alone
        self.cuts_at_spaces = pattern == public_tokenizers.PATTERN
        self.recent = Recent(recent_bytes)
        self.long_piece = long_piece
        self.byte_ids = np.array([ranks.get(bytes([i]), -1) for i in range(256)], dtype=np.int32)
        if (self.byte_ids < 0).any():
            raise ValueError("the vocabulary lacks a single byte")
        merges = np.fromiter(
            (
                x
                for token, rank in ranks.items()
                for i in range(1, len(token))
                if token[:i] in ranks and token[i:] in ranks
                for x in (ranks[token[:i]], ranks[token[i:]], rank)
            ),
            dtype=np.int32,
        )
        lhs, rhs, merged = merges.reshape(-1, 3).T
        sooner = np.union1d(lhs[merged < lhs], rhs[merged < rhs])
        self.db = duckdb.connect(config={"threads": 1})
        self._limit(DUCKDB_BYTES)
        self._table("merges", lhs=lhs, rhs=rhs, merged=merged, alone=np.isin(merged, sooner))
        self.longest = max(map(len, ranks))
        # pairs of bytes that some token holds side by side; between others no merge can happen
        self.joined = np.zeros(1 << 16, dtype=bool)
        self.joined[[t[i] << 8 | t[i + 1] for t in ranks for i in range(len(t) - 1)]] = True
        # by id; the last entry is for ids beyond the vocabulary, which stand for nothing
        vocabulary = [b""] * (max(ranks.values()) + 2)
        for token, rank in ranks.items():
            vocabulary[rank] = token
        self.vocabulary = pa.array(vocabulary, pa.large_binary())

    def _limit(self, size: int) -> None:
        self.db.execute(f"set memory_limit = '{size >> 20}MiB'")

    def _table(self, name: str, **columns) -> None:
        self.db.register("incoming", pa.table(columns))
        self.db.execute(f"create or replace table {name} as select * from incoming")
        self.db.unregister("incoming")

    def _recur(self, pieces: list[bytes], query: str) -> list[bytes]:
        """The ids of each piece, which ``query`` finds from the table of its bytes."""
        lengths = np.array([len(p) for p in pieces])
        which = np.repeat(np.arange(len(pieces), dtype=np.int32), lengths)
        pos = (np.arange(len(which)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype(np.int32)
        tok = self.byte_ids[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        last = pos == np.repeat(lengths, lengths) - 1
        self._table("pieces", w=which, pos=pos, tok=tok, after=pa.array(pos + 1, mask=last), following=pa.array(np.append(tok[1:], tok[:1]), mask=last))
        self._limit(DUCKDB_BYTES + DUCKDB_POSITION_BYTES * max(0, len(tok) - (1 << 19)))
        got = self.db.sql(query).to_arrow_table()
        ids = got["tok"].to_numpy().astype("<u4").tobytes()
        ends = 4 * np.cumsum(np.bincount(got["w"].to_numpy(), minlength=len(pieces)))
        return [ids[s:e] for s, e in zip([0, *ends[:-1].tolist()], ends.tolist(), strict=True)]

    def _segments(self, piece: bytes) -> list[bytes]:
        """A piece cut where no merge can happen."""
        data = np.frombuffer(piece, np.uint8).astype(np.int32)
        cuts = np.flatnonzero(~self.joined[data[:-1] << 8 | data[1:]]) + 1
        return [piece[s:e] for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(piece)], strict=True)]

    def _near_merges(self, pieces: list[bytes]) -> None:
        """The merges whose token occurs in one of the pieces, as a small table to join with."""
        inside = set()
        for p in pieces:
            for n in range(2, min(self.longest, len(p)) + 1):
                inside.update(map(self.ranks.get, {p[i : i + n] for i in range(len(p) - n + 1)}))
        self._table("inside", merged=np.array(sorted(x for x in inside if x is not None), np.int32))
        self.db.execute("create or replace table near_merges as select * from merges semi join inside using (merged)")

    def _encode_short(self, pieces: list[bytes]) -> list[bytes]:
        # pieces of a length take about as many steps
        done = {}
        ordered = sorted(pieces, key=len)
        for at in range(0, len(ordered), QUERY_PIECES):
            some = ordered[at : at + QUERY_PIECES]
            done.update(zip(some, self._recur(some, _STEP), strict=True))
        return [done[p] for p in pieces]

    def _encode_long(self, pieces: list[bytes]) -> Iterator[bytes]:
        parts = [self._segments(p) for p in pieces]
        todo = sorted(set().union(*parts), key=lambda x: (len(x), x))
        done = {x: self.ranks[x].to_bytes(4, "little") for x in todo if x in self.ranks}
        short = [x for x in todo if x not in done and len(x) <= self.long_piece]
        done.update(zip(short, self._encode_short(short), strict=True))
        long = [x for x in todo if x not in done]
        batch, size = [], 0
        for k, piece in enumerate(long):
            batch.append(piece)
            size += len(piece)
            if size >= LONG_BYTES or k == len(long) - 1:
                self._near_merges(batch)
                done |= dict(zip(batch, self._recur(batch, _KEYED), strict=True))
                batch, size = [], 0
        for segments in parts:
            yield b"".join([done[x] for x in segments])

    def encode_pieces(self, pieces: list[str]) -> list[bytes]:
        """The ids of each piece (none empty) as little-endian unsigned 32-bit integers."""
        raw = [p.encode() for p in pieces]
        out: list[bytes | None] = [None] * len(raw)
        short, long = [], []
        for i, b in enumerate(raw):
            rank = self.ranks.get(b)
            if rank is not None:
                out[i] = rank.to_bytes(4, "little")
            else:
                (short if len(b) <= self.long_piece else long).append(i)
        for indexes, encode in ((short, self._encode_short), (long, self._encode_long)):
            for i, ids in zip(indexes, encode([raw[i] for i in indexes]), strict=True):
                out[i] = ids
        return out

    def words(self, texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """The texts cut before single spaces that a visible character follows, these spaces left out, and where each text begins. One word a text if the pattern may join across them."""
        if not self.cuts_at_spaces:
            return pa.array(texts, pa.large_string()), np.arange(len(texts))
        if any(map(_LOOSE.search, texts)):
            cut = [_CUT.split(t) for t in texts]
            return pa.array(itertools.chain.from_iterable(cut), pa.large_string()), np.cumsum([0, *map(len, cut)])[:-1]
        cut = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
        return cut.values, cut.offsets.to_numpy()[:-1]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each of the different words, which are one piece of the pattern or several."""
        out = self.recent.find(words)
        todo = [i for i, ids in enumerate(out) if ids is None]
        cuts = [[w] if self.cuts_at_spaces and _LETTERS(w) else self.pattern.findall(w) for w in map(words.__getitem__, todo)]
        wanted = list(dict.fromkeys(itertools.chain.from_iterable(cuts)))
        pieces = dict(zip(wanted, self.recent.find(wanted), strict=True))
        new = [p for p, ids in pieces.items() if ids is None]
        for p, ids in zip(new, self.encode_pieces(new), strict=True):
            pieces[p] = ids
            self.recent.put(p, ids)
        for i, parts in zip(todo, cuts, strict=True):
            out[i] = pieces[parts[0]] if len(parts) == 1 else b"".join([pieces[p] for p in parts])
        return out

    def encode_texts(self, texts: list[str]) -> Iterator[bytes]:
        """The ids of each text."""
        words, starts = self.words(texts)
        coded = words.dictionary_encode()
        codes, different = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        # all words but the first of a text begin with the space before them
        heads, first = np.unique(codes[starts], return_inverse=True)
        inner = np.flatnonzero(np.bincount(codes, minlength=len(different)) > np.bincount(codes[starts], minlength=len(different)))
        ids = self.encode_words([*(different[i] for i in heads.tolist()), *(" " + different[i] for i in inner.tolist())])
        place = np.zeros(len(different), dtype=np.int64)
        place[inner] = len(heads) + np.arange(len(inner))
        rows = place[codes]
        rows[starts] = first
        return _gather(pa.array(ids, pa.large_binary()), rows, starts)

    def decode_sequences(self, sequences: list[bytes]) -> Iterator[bytes]:
        """The bytes that each sequence of ids stands for."""
        at = 0
        while at < len(sequences):
            # some sequences, or one long one
            stop, size = at, 0
            while stop < len(sequences) and (stop == at or size + len(sequences[stop]) <= 4 * DECODE_TOKENS):
                size += len(sequences[stop])
                stop += 1
            some = sequences[at:stop]
            tok = np.frombuffer(b"".join(some), dtype="<u4")
            starts = np.cumsum([0, *(len(x) // 4 for x in some)])[:-1]
            yield from _gather(self.vocabulary, np.minimum(tok, len(self.vocabulary) - 1), starts)
            at = stop


def _gather(values: pa.Array, rows: np.ndarray, starts: np.ndarray) -> Iterator[bytes]:
    """The values of the rows one after another, from each start to the next."""
    taken = values.take(pa.array(rows))
    ends = np.append(0, np.cumsum(pc.binary_length(taken).to_numpy()))[np.append(starts, len(rows))].tolist()
    data = memoryview(taken.buffers()[2] or b"")
    for s, e in itertools.pairwise(ends):
        yield bytes(data[s:e])


_codecs: dict[int, Codec] = {}


def _codec(shared: Broadcast, pattern: str) -> Codec:
    """This worker's codec for a broadcast vocabulary."""
    key = hash((shared.value["digest"], pattern))
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value["ranks"], pattern)
    return _codecs[key]


def share_vocabulary(spark, path: str) -> Broadcast:
    """Broadcast a rank file: a fixed table of some 50,000 short rows, whatever the input."""
    ranks = load_ranks(path)
    digest = hashlib.sha256(repr(sorted(ranks.items())).encode()).hexdigest()
    return spark.sparkContext.broadcast({"ranks": ranks, "digest": digest})


def _runs(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield from bs.slices(batch, column, BATCH_BYTES)


def encode(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """``docs`` (doc_id, text) as (doc_id, ids array<int>)."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for part in _runs(batches, "text"):
            ids = list(codec.encode_texts([t or "" for t in part.column("text").to_pylist()]))
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = np.frombuffer(b"".join(ids), dtype="<u4").astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(offsets, values)], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, vocabulary: str, pattern: str = "") -> DataFrame:
    """(doc_id, ids array<int>) as (doc_id, bytes binary); null or empty ids give no bytes."""
    shared = share_vocabulary(encoded.sparkSession, vocabulary)

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for batch in batches:
            sequences = [np.asarray(x or [], dtype="<u4").tobytes() for x in batch.column("ids").to_pylist()]
            out = pa.array(codec.decode_sequences(sequences), pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), out], ["doc_id", "bytes"])

    return encoded.select(F.col("doc_id").cast("long").alias("doc_id"), "ids").mapInArrow(run, "doc_id long, bytes binary")


def token_digests(docs: DataFrame, vocabulary: str, pattern: str) -> DataFrame:
    """One row of SCHEMA per row of ``docs`` (doc_id, text): encoded, and decoded again from the ids."""
    shared = share_vocabulary(docs.sparkSession, vocabulary)

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared, pattern)
        for part in _runs(batches, "text"):
            ids = list(codec.encode_texts([t or "" for t in part.column("text").to_pylist()]))
            columns = [
                part.column("doc_id"),
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids], pa.string()),
                pa.array([hashlib.sha256(x).hexdigest() for x in codec.decode_sequences(ids)], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in SCHEMA.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)
