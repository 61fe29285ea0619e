"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has a bit for each of the 64 bits that is set in over half of its shingles' XXH64 values. Equal
fingerprints are grouped first. The different ones are laid out in tiles by the population counts of their four
16-bit quarters: two fingerprints at most ``radius`` bits apart have counts that differ by at most ``radius`` in
sum, so all other pairs of tiles are skipped. Each remaining pair of tiles is compared in full with exclusive-or and bit counts in
numpy. No candidate is lost and none is capped.

A tile is held by one task in parts of at most ``tile_rows`` rows (a larger tile is split, and its neighbours are sent
to each part); the neighbours' rows are streamed past it. A task reports links as a forest, so a large group of near
copies gives as many links as it has rows, not pairs. Components come from ``connected_components``.

The work of comparing grows with the square of the number of different fingerprints, times the small share (a few
per cent) of tile pairs within reach; nothing else grows faster than the input.

Edge cases: null and empty texts and texts without a word have fingerprint zero and are linked like any other; fewer
than three words give one shingle of all words; repeated rows each give a row; rows without an id have a null component
unless their fingerprint is shared or linked.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm import bytescan as bs
from siftworks.llm.components import connected_components
from siftworks.shared import materialize

RADIUS = 3
SHINGLE = 3
SEED = 42
TILE_ROWS = 32_768
#: Shingles hashed at once.
_BLOCK = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """The 64-bit fingerprint of a text, as an unsigned integer. bytes.lower and bytes.split act on ASCII only."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    n = max(len(words) - shingle + 1, 1)
    starts = [0, *(ends[: n - 1] + 1).tolist()]
    stops = ends[-n:].tolist()
    ones = np.zeros(64, dtype=np.int64)
    digest = xxhash.xxh64_intdigest
    for at in range(0, n, _BLOCK):
        pairs = zip(starts[at : at + _BLOCK], stops[at : at + _BLOCK], strict=True)
        values = np.array([digest(joined[s:e], SEED) for s, e in pairs], dtype=np.uint64)
        bits = np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, key: str = "doc_id", shingle: int = SHINGLE) -> DataFrame:
    """(key, fp long) per row of ``docs`` (key, text); fp is the fingerprint's bits as a signed integer, a doc_id is a long."""
    keyed = docs.select(F.col(key).cast("long").alias(key) if key == "doc_id" else F.col(key), "text")

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in bs.slices(batch, "text"):
                values = np.array([fingerprint(t, shingle) for t in part.column("text").to_pylist()], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(key), pa.array(values.view(np.int64))], [key, "fp"])

    return keyed.mapInArrow(run, f"{key} {keyed.schema[key].dataType.simpleString()}, fp long")


def _forest(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Unite a[i] with b[i] in the array of parents, which stays flat (every parent is a root, the smallest index)."""
    while len(a):
        ra, rb = parent[a], parent[b]
        apart = ra != rb
        if not apart.any():
            return
        a, b, ra, rb = a[apart], b[apart], ra[apart], rb[apart]
        np.minimum.at(parent, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := parent[parent], parent):
            parent[:] = up


class _Tile:
    """The rows of one part of a tile, and the links found so far."""

    def __init__(self, key: tuple[int, int]):
        self.key, self.own, self.rep = key, [], []
        self.frozen = False

    def add(self, fp: np.ndarray, rep: np.ndarray) -> None:
        self.own.append(fp)
        self.rep.append(rep)

    def freeze(self) -> None:
        if not self.frozen:
            self.fps = np.concatenate(self.own) if self.own else np.zeros(0, np.uint64)
            self.reps = np.concatenate(self.rep) if self.rep else np.zeros(0, np.int64)
            self.parent = np.arange(len(self.fps))
            self.frozen = True

    def _near(self, fp: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (own row, given row) within the radius, some own rows at a time."""
        step = max(1, (1 << 21) // max(len(fp), 1))
        for at in range(0, len(self.fps), step):
            i, j = np.nonzero(np.bitwise_count(self.fps[at : at + step, None] ^ fp[None, :]) <= radius)
            yield i + at, j

    def compare(self, fp: np.ndarray, rep: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Stream other rows past: yields their links to an own row, and unites own rows that share a neighbour."""
        self.freeze()
        first = np.full(len(fp), -1)
        for i, j in self._near(fp, radius):
            fresh, where = np.unique(j, return_index=True)
            unseen = first[fresh] < 0
            first[fresh[unseen]] = i[where[unseen]]
            _forest(self.parent, i, first[j])
        linked = first >= 0
        yield rep[linked], self.reps[first[linked]]

    def finish(self, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        self.freeze()
        for at in range(0, len(self.fps), 4096):
            for i, j in self._near(self.fps[at : at + 4096], radius):
                _forest(self.parent, i, j + at)
        moved = self.parent != np.arange(len(self.parent))
        yield self.reps[moved], self.reps[self.parent[moved]]


def _quarter_counts(fp: str) -> list[str]:
    return [f"bit_count(shiftrightunsigned({fp}, {16 * q}) & 65535L)" for q in range(4)]


def near_links(unique: DataFrame, radius: int = RADIUS, tile_rows: int = TILE_ROWS) -> DataFrame:
    """Links (a long, b long) between the reps of ``unique`` (fp long, rep long; every fp once): a spanning set.

    Two reps are joined by a path of these links exactly if a path of pairs within the radius joins them.
    """
    width = 32  # a quarter has 0 to 16 bits; with the offsets it stays below this
    q = _quarter_counts("fp")
    tile = f"{q[0]} * {width**3} + {q[1]} * {width**2} + {q[2]} * {width} + {q[3]}"
    # steps to the tiles within reach, one of each two opposite ones
    steps = [
        sum(x * width**k for x, k in zip(d, (3, 2, 1, 0), strict=True))
        for d in product(range(-radius, radius + 1), repeat=4)
        if 0 < sum(map(abs, d)) <= radius and d > (0, 0, 0, 0)
    ]
    rows = unique.select("fp", "rep", F.expr(f"cast({tile} as int)").alias("tile"))
    # at most 17**4 tiles, and only those that need splitting are kept
    large = rows.groupBy("tile").count().filter(f"count > {tile_rows}").select("tile", F.ceil(F.col("count") / tile_rows).cast("int").alias("parts"))
    home = rows.join(F.broadcast(large), "tile", "left").selectExpr(
        "fp", "rep", "tile", "cast(pmod(xxhash64(fp), coalesce(parts, 1)) as int) part", "0 role"
    )
    moved = F.array(*[F.lit(s).cast("int") for s in steps])
    # the neighbours of a tile go to each of its parts; so do its own rows of later parts
    visits = rows.select("fp", "rep", F.explode(F.transform(moved, lambda s: F.col("tile") + s)).alias("tile"))
    visits = visits.join(F.broadcast(large), "tile", "left").selectExpr("fp", "rep", "tile", "explode(sequence(0, coalesce(parts, 1) - 1)) part", "1 role")
    within = home.join(F.broadcast(large), "tile").filter("part > 0").selectExpr("fp", "rep", "tile", "explode(sequence(0, part - 1)) part", "1 role")
    laid = home.unionByName(visits).unionByName(within)

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile: _Tile | None = None

        def out(links: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
            for a, b in links:
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fp = batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)
            rep, t, p, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("rep", "tile", "part", "role"))
            cuts = np.flatnonzero((np.diff(t) != 0) | (np.diff(p) != 0) | (np.diff(role) != 0)) + 1
            for s, e in zip([0, *cuts], [*cuts, batch.num_rows], strict=True):
                key = (int(t[s]), int(p[s]))
                if tile is None or tile.key != key:
                    if tile is not None:
                        yield from out(tile.finish(radius))
                    tile = _Tile(key)
                if role[s] == 0:
                    tile.add(fp[s:e].copy(), rep[s:e].copy())
                elif tile.own:
                    yield from out(tile.compare(fp[s:e], rep[s:e], radius))
        if tile is not None:
            yield from out(tile.finish(radius))

    return laid.repartition("tile", "part").sortWithinPartitions("tile", "part", "role").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Per row of ``docs`` (doc_id, text): doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable)."""
    signed = materialize(fingerprints(docs), "simhash")
    unique = materialize(signed.groupBy("fp").agg(F.min("doc_id").alias("rep")), "simhash-unique")
    # by fingerprint, not by id: one held by rows without an id joins others too
    links = near_links(unique.select("fp", F.col("fp").alias("rep")), radius)
    linked = connected_components(links, "simhash-links")
    roots = unique.join(linked, unique["fp"] == linked["node"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = roots.groupBy("root").agg(F.min("rep").alias("component_id"))
    classes = roots.join(least, "root").select("fp", "component_id")
    return signed.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
