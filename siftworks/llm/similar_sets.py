"""Near-duplicates by exact Jaccard likeness of word shingles: a prefix-filtered join, no candidate lost and none capped.

A text is the set of its shingles (64-bit hashes of runs of ``shingle`` words, ASCII letters lowered). Texts with equal sets
are grouped first. If two sets are alike by ``num / den`` or more, the first of their common shingles, in any order that all
texts share, is among the first ``n - ceil(n num / den) + 1`` of both; sets that share one of these form a block. Two sets
of a block are candidates if their sizes and positions allow enough common shingles and their parity bit maps differ in few
enough bits (a shingle that only one set has flips one bit, so the maps never differ by more bits than the sets by shingles).
Candidates are checked on the whole sets. The order puts shingles that a sample of texts repeats last; it decides how many
candidates there are, not which links are found.

A group of near copies gives as many checks as it has sets, not pairs: in each of the first rounds a set is checked only with
the nearest set (by bit maps) of another component, so that components grow as in a minimum spanning tree; the last
round checks what candidates of different components are left. A block of more than ``BLOCK_ROWS`` sets is cut into tiles.

What grows faster than the input: bit maps of different sets in one block are compared pair by pair, and in the last round
candidates that are nearly, but not quite alike are checked one by one.

With a ``radius``, fingerprints go first: sets whose SimHash fingerprints are equal, or linked by ``simhash.near_links``, are checked on the
whole sets, and what is alike forms the components that the join starts from. The join finds the rest, which fingerprints leave apart, so the
result is the same.

Edge cases: a text with fewer words than a shingle has one shingle of all words; null and empty texts and texts without a word
have the empty set and are equal; repeated rows share a component; with no rows the result is empty.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm import bytescan as bs
from siftworks.llm import simhash
from siftworks.llm.components import connected_components
from siftworks.shared import discard, materialize

SHINGLE = 5
#: Alike from 4 / 5 on.
ALIKE = (4, 5)
#: The order of shingles is learnt from about this many texts, and names at most this many common shingles.
SAMPLE_ROWS = 4_000
COMMON = 200_000
#: Bits of a parity map.
MAP_BITS = 1024
#: Rounds in which a set is checked with its nearest one only.
NEAREST_ROUNDS = 3
#: Sets of one block that one task compares.
BLOCK_ROWS = 16_384
#: Texts whose parity maps are made at once, and pairs compared at once.
_MAPS, _PAIRS = 1_024, 1 << 16
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32


def shingle_sets(texts: pa.Array, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of each text, ascending, one text after the other, and where each text's begin (and the end)."""
    s = bs.TextSlice(texts)
    s.data = _LOWER[s.data]
    words = s.word_hashes()
    starts = bs.window_starts(s.word_off, shingle)
    values, owner = bs.window_hashes(words, shingle)[starts], s.word_doc[starts]
    n_words = np.diff(s.word_off)
    short = np.flatnonzero((n_words > 0) & (n_words < shingle))
    if len(short):
        few = [bs.window_hashes(words[s.word_off[d] : s.word_off[d + 1]], int(n_words[d]))[0] for d in short]
        values, owner = np.concatenate([values, np.array(few, np.uint64)]), np.concatenate([owner, short])
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[fresh], owner[fresh]
    return values, np.searchsorted(owner, np.arange(s.n_docs + 1))


def _lists(values: np.ndarray, off: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(off.astype(np.int32)), pa.array(values.view(np.int64)))


def _set_ids(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    digests = [hashlib.blake2b(values[a:b].tobytes(), digest_size=8).digest() for a, b in zip(off[:-1], off[1:], strict=True)]
    return np.frombuffer(b"".join(digests), dtype=np.int64)


def parity_maps(values: np.ndarray, off: np.ndarray) -> np.ndarray:
    """A row of MAP_BITS / 8 bytes per set: each bit is the parity of the number of shingles that fall on it."""
    out = np.zeros((len(off) - 1, MAP_BITS // 8), dtype=np.uint8)
    for at in range(0, len(out), _MAPS):
        cut = off[at : at + _MAPS + 1]
        n = len(cut) - 1
        owner = np.repeat(np.arange(n), np.diff(cut))
        cells = owner * MAP_BITS + (values[cut[0] : cut[-1]] >> np.uint64(20)).astype(np.int64) % MAP_BITS
        out[at : at + n] = np.packbits(np.bincount(cells, minlength=n * MAP_BITS).reshape(n, MAP_BITS) & 1, axis=1)
    return out


def wide_map(values: np.ndarray) -> bytes:
    """A parity map of a set with eight to sixteen bits per shingle."""
    bits = 1 << max(6, (8 * len(values) - 1).bit_length())
    return np.packbits(np.bincount((values >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1, bitorder="little").tobytes()


def _folded(wide: bytes, size: int) -> np.ndarray:
    """The map with ``size`` bytes of the same set: parts that fall together are added."""
    return np.bitwise_xor.reduce(np.frombuffer(wide, np.uint8).reshape(-1, size), axis=0)


def _full_sets(rows: DataFrame, shingle: int) -> DataFrame:
    """(fp long, n int, wide binary, hashes array<long>) per row of ``rows`` (text)."""

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                values, off = shingle_sets(part.column("text"), shingle)
                wide = pa.array([wide_map(values[a:b]) for a, b in zip(off[:-1], off[1:], strict=True)], pa.binary())
                columns = [pa.array(_set_ids(values, off)), pa.array(np.diff(off).astype(np.int32)), wide, _lists(values, off)]
                yield pa.RecordBatch.from_arrays(columns, ["fp", "n", "wide", "hashes"])

    return rows.select("text").mapInArrow(run, "fp long, n int, wide binary, hashes array<long>")


def common_shingles(docs: DataFrame, shingle: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that a sample of texts repeats, ascending, and the rank of each: the rarest first, from 1 on."""
    rows = docs.count()
    sample = docs.select("text").sample(min(1.0, SAMPLE_ROWS / rows), seed=1) if rows else docs.select("text")
    counts = _full_sets(sample, shingle).select(F.explode("hashes").alias("h")).groupBy("h").count().filter("count > 2")
    got = counts.orderBy(F.desc("count"), "h").limit(COMMON).toArrow()
    hashes = got.column("h").to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], (len(hashes) - np.arange(len(hashes)))[order]


def _signed(docs: DataFrame, common: tuple[np.ndarray, np.ndarray], shingle: int, alike: tuple[int, int]) -> DataFrame:
    """(row, fp, size, prefix, bits) per row of ``docs`` (row, text); of equal sets in one task only the first has a prefix."""
    num, den = alike
    known, ranks = common

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in bs.slices(batch, "text"):
                values, off = shingle_sets(part.column("text"), shingle)
                n = np.diff(off)
                owner = np.repeat(np.arange(len(n)), n)
                rank = np.zeros(len(values), dtype=np.int64)
                if len(known):
                    at = np.minimum(np.searchsorted(known, values), len(known) - 1)
                    rank = np.where(known[at] == values, ranks[at], 0)
                ordered = values[np.lexsort((values, rank, owner))]
                fp = _set_ids(values, off)
                fresh = np.zeros(len(n), dtype=bool)
                for i, x in enumerate(fp.tolist()):
                    if x not in seen:
                        seen.add(x)
                        fresh[i] = True
                take = np.where(fresh & (n > 0), n - (n * num + den - 1) // den + 1, 0)
                first = ordered[np.arange(len(values)) - off[owner] < take[owner]]
                prefix = _lists(first, np.concatenate([[0], np.cumsum(take)]))
                bits = pa.array([x.tobytes() for x in parity_maps(values, off)], pa.binary())
                columns = [part.column("row"), pa.array(fp), pa.array(n.astype(np.int32)), prefix, bits]
                yield pa.RecordBatch.from_arrays(columns, ["row", "fp", "size", "prefix", "bits"])

    return docs.select("row", "text").mapInArrow(run, "row binary, fp long, size int, prefix array<long>, bits binary")


def _by_key(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[dict[str, np.ndarray | pa.Array]]:
    """Tables of whole runs of equal ``key`` (rows are sorted by it), as many runs at a time as a batch ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        cut = int(np.searchsorted(keys, keys[-1]))
        if held and held[-1].column(key)[-1].as_py() == keys[0] and cut == 0:
            held.append(batch)  # one key fills the batch
            continue
        yield pa.Table.from_batches([*held, batch.slice(0, cut)]).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _blocks(spread: DataFrame) -> DataFrame:
    """(block, fp, where) of the rows of ``spread`` (h, fp, where) whose h has another fp; blocks of the same sets are one.

    Of the places of a set in such blocks the first counts, which allows no fewer candidates.
    """

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, "h"):
            h, fp, where = (table[c].to_numpy() for c in ("h", "fp", "where"))
            if not len(h):
                continue
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (fp[1:] != fp[:-1])])
            h, fp, where = h[once], fp[once], where[once]
            starts = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            counts = np.diff(np.append(starts, len(h)))
            block = np.repeat(np.add.reduceat(bs.mix64(fp.view(np.uint64)), starts).view(np.int64), counts)
            keep = np.repeat(counts > 1, counts)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (block, fp, where)], ["block", "fp", "where"])

    found = spread.repartition("h").sortWithinPartitions("h", "fp").mapInArrow(run, "block long, fp long, where long")
    return found.groupBy("block", "fp").agg(F.min("where").alias("where"))


def _cells(blocks: DataFrame) -> DataFrame:
    """``blocks`` (block, fp, where, bits) as (cell, side, ...): a large block is cut into tiles, each of which compares two of its parts (sides 0 and 1) or one (-1)."""
    large = blocks.groupBy("block").count().filter(F.col("count") > BLOCK_ROWS).select("block", F.ceil(F.col("count") / (BLOCK_ROWS // 2)).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp"), F.coalesce("parts", F.lit(1))).cast("int")
    laid = blocks.join(large, "block", "left").select("*", own.alias("p"), F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("q"))
    side = F.when(F.col("p") == F.col("q"), -1).otherwise((F.col("p") > F.col("q")).cast("int"))
    return laid.select(F.xxhash64("block", F.least("p", "q"), F.greatest("p", "q")).alias("cell"), side.cast("int").alias("side"), "fp", "where", "bits")


def _pairs(cells: DataFrame, alike: tuple[int, int], nearest: bool) -> DataFrame:
    """Candidates (fpa < fpb, d: differing bits) of ``cells`` (cell, side, fp, where, bits, comp) in different components.

    ``nearest``: of each set only the one with the fewest differing bits.
    """
    num, den = alike

    def compare(table: pa.Table) -> Iterator[pa.RecordBatch]:
        cell, side, fp, where, comp = (table[c].to_numpy() for c in ("cell", "side", "fp", "where", "comp"))
        if not len(cell):
            return
        bits = np.frombuffer(b"".join(table["bits"].to_pylist()), dtype=np.uint64).reshape(len(cell), -1)
        size = where >> 32
        left = size - (where & 0xFFFFFFFF)
        best, partner = np.full(len(cell), MAP_BITS + 1), np.full(len(cell), -1)
        i = np.flatnonzero(cell[1:] == cell[:-1])
        step = 1

        while len(i):  # row i with the row that is ``step`` further on, as long as both are of one cell
            for at in range(0, len(i), _PAIRS):
                a = i[at : at + _PAIRS]
                b = a + step
                total = size[a] + size[b]
                ok = (np.minimum(left[a], left[b]) * (num + den) >= total * num) & (comp[a] != comp[b]) & ((side[a] < 0) | (side[a] != side[b]))
                a, b, total = a[ok], b[ok], total[ok]
                d = np.bitwise_count(bits[a] ^ bits[b]).sum(axis=1, dtype=np.int64)
                ok = d * (num + den) <= total * (den - num)
                a, b, d = a[ok], b[ok], d[ok]
                if not nearest:
                    if len(a):
                        columns = [np.minimum(fp[a], fp[b]), np.maximum(fp[a], fp[b]), d.astype(np.int32)]
                        yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], ["fp", "other", "d"])
                    continue
                for x, y in ((a, b), (b, a)):
                    less = d < best[x]
                    best[x[less]], partner[x[less]] = d[less], y[less]
            step += 1
            i = i[i + step < len(cell)]
            i = i[cell[i] == cell[i + step]]
        # of each set the nearest one of all blocks at hand
        a = np.flatnonzero(partner >= 0)
        order = np.lexsort((fp[partner[a]], best[a], fp[a]))
        a = a[order]
        a = a[np.concatenate([[True], fp[a][1:] != fp[a][:-1]])] if len(a) else a
        if len(a):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (fp[a], fp[partner[a]], best[a].astype(np.int32))], ["fp", "other", "d"])

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _by_key(batches, "cell"):
            yield from compare(table)

    found = cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, "fp long, other long, d int")
    if nearest:
        found = found.groupBy("fp").agg(F.min(F.struct("d", "other")).alias("x")).select("fp", "x.other")
    return found.select(F.least("fp", "other").alias("fpa"), F.greatest("fp", "other").alias("fpb")).distinct()


def _of_pairs(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("fpa", "fpb")).alias("fp")).distinct()


def _both(pairs: DataFrame, full: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` with the columns of both sets, as x_... and y_...; only sets of a pair are shipped."""
    some = full.select("fp", *columns).join(_of_pairs(pairs), "fp", "left_semi")
    side = lambda fp, mark: some.select(F.col("fp").alias(fp), *[F.col(c).alias(f"{mark}_{c}") for c in columns])
    return pairs.join(side("fpa", "x"), "fpa").join(side("fpb", "y"), "fpb")


def _checked(pairs: DataFrame, full: DataFrame, alike: tuple[int, int], scratch: list[DataFrame]) -> DataFrame:
    """The pairs (a, b) of ``pairs`` (fpa, fpb) that are alike by their whole sets; wide maps spare most others that check."""
    num, den = alike

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for m, n, x, y in zip(*(batch.column(c).to_pylist() for c in ("x_n", "y_n", "x_wide", "y_wide")), strict=True):
                size = min(len(x), len(y))
                differ = int(np.bitwise_count(_folded(x, size) ^ _folded(y, size)).sum())
                keep.append(differ * (num + den) <= (m + n) * (den - num))
            yield from pa.Table.from_batches([batch.select(["fpa", "fpb"])]).filter(pa.array(keep, pa.bool_())).to_batches()

    near = materialize(_both(pairs, full, "n", "wide").mapInArrow(run, "fpa long, fpb long"), "sets-near")
    scratch.append(near)
    same = F.size(F.array_intersect("x_hashes", "y_hashes")).cast("long") * (num + den) >= (F.size("x_hashes").cast("long") + F.size("y_hashes")) * num
    return _both(near, full, "hashes").filter(same).select(F.col("fpa").alias("a"), F.col("fpb").alias("b"))


def _fingerprint_pairs(docs: DataFrame, signed: DataFrame, shingle: int, radius: int) -> DataFrame:
    """Pairs (fpa < fpb) of sets that fingerprints link: a star for equal fingerprints, and links of those within the radius."""
    prints = materialize(simhash.fingerprints(docs.select("row", "text"), "row", shingle).withColumnRenamed("fp", "print"), "sets-prints")
    # repeated rows are told apart by nothing, so each counts once
    of_sets = materialize(signed.select("row", "fp").distinct().join(prints.distinct(), "row").groupBy("fp").agg(F.min("print").alias("print")), "sets-of-prints")
    unique = of_sets.groupBy("print").agg(F.min("fp").alias("rep"))
    equal = of_sets.join(unique, "print").select(F.col("fp").alias("a"), F.col("rep").alias("b"))
    near = simhash.near_links(unique.select(F.col("print").alias("fp"), "rep"), radius)
    pairs = equal.unionByName(near).filter("a <> b").select(F.least("a", "b").alias("fpa"), F.greatest("a", "b").alias("fpb")).distinct()
    pairs = materialize(pairs, "sets-print-pairs")
    discard(prints, of_sets)
    return pairs


def _texts_of(docs: DataFrame, unique: DataFrame, pairs: DataFrame) -> DataFrame:
    """One text of each set of a pair."""
    chosen = unique.join(_of_pairs(pairs), "fp", "left_semi").select("row")
    return docs.select("row", "text").dropDuplicates(["row"]).join(chosen, "row", "left_semi")


def set_components(docs: DataFrame, shingle: int = SHINGLE, alike: tuple[int, int] = ALIKE, radius: int | None = None) -> DataFrame:
    """(row, component long) per row of ``docs`` (row binary, text): rows joined by a path of sets that are alike.

    ``radius``: links of fingerprints at most so many bits apart are checked first.
    """
    signed = materialize(_signed(docs, common_shingles(docs, shingle), shingle, alike), "sets")
    unique = signed.groupBy("fp").agg(F.min(F.struct("row", "bits")).alias("x")).select("fp", "x.row", "x.bits")
    packed = F.shiftleft(F.col("size").cast("long"), 32) + F.col("at")
    spread = signed.select("fp", "size", F.posexplode("prefix").alias("at", "h")).select("h", "fp", packed.alias("where"))
    blocks = materialize(_blocks(spread), "sets-blocks")
    cells = materialize(_cells(blocks.join(unique.select("fp", "bits"), "fp")), "sets-cells")

    labels = cells.select(F.col("fp").alias("node"), F.col("fp").alias("component")).limit(0)
    tested = labels.select(F.col("node").alias("fpa"), F.col("component").alias("fpb"))
    full, scratch = None, [blocks, cells]
    if radius is not None:
        pairs = _fingerprint_pairs(docs, signed, shingle, radius)
        some = materialize(_full_sets(_texts_of(docs, unique, pairs), shingle), "sets-full")
        links = materialize(_checked(pairs, some, alike, scratch), "sets-links")
        labels = connected_components(links, "sets-links")
        tested = tested.unionByName(pairs)
        scratch += [pairs, some, links]
    nearest = NEAREST_ROUNDS
    while nearest >= 0:
        known = labels.select(F.col("node").alias("fp"), F.col("component").alias("comp"))
        pairs = _pairs(cells.join(known, "fp", "left").withColumn("comp", F.coalesce("comp", "fp")), alike, nearest > 0)
        pairs = materialize(pairs.join(tested, ["fpa", "fpb"], "left_anti"), "sets-pairs")
        if full is None:
            # the first round names every set that has a candidate; one text of each
            full = materialize(_full_sets(_texts_of(docs, unique, pairs), shingle), "sets-full")
        links = materialize(_checked(pairs, full, alike, scratch), "sets-links")
        if links.isEmpty():
            nearest = min(nearest, 1)  # the last round is next, or was this one
        else:
            labels = connected_components(links.unionByName(labels.select(F.col("node").alias("a"), F.col("component").alias("b"))), "sets-links")
        tested = tested.unionByName(pairs)
        scratch += [pairs, links]
        nearest -= 1
    discard(*scratch, full)
    return signed.select("row", "fp").join(labels, F.col("fp") == F.col("node"), "left").select("row", F.coalesce("component", "fp").alias("component"))
