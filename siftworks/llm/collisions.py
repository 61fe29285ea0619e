"""Nearest vectors by cosine with collision-counting hashing.

Vectors are scaled to length one, so the largest cosine is the smallest distance, and projected on ``PROJECTIONS`` random lines. Rows
are dealt into blocks; a task sorts the projections of a block, one array for each line. A query opens a window around
its own projection in every array. The windows grow with a radius (virtual rehashing: the arrays stay, the windows
widen), and each row is counted once for each window that it falls into. A row at a distance of the radius falls into a window
with a fixed chance, so one that collides less often than a row at the radius does with probability ``1 - MISS`` is left alone; the
others are verified with exact cosines. A query ends when its k-th best verified distance is within the radius that
its windows stand for; at the largest radius all rows collide.

First each query searches its own block, where it lies already. Its k-th score there bounds what other blocks
have to beat; query and bound then visit the other blocks, which report only what reaches the bound. A bound names the radius at which
the search would end at the latest, so a visit opens that radius' windows at once: they hold all rows of the narrower ones.

What grows faster than the input: queries are given as a part of the rows and each visits every block, so visits grow with queries times
blocks. No pairs are written but verified ones that reach the query's bound.

Edge cases: vectors that are null, empty, zero, or hold null or non-finite components take no part, as queries or candidates; a query's
candidates are all other rows, a repeated row included; ties go to the smaller id, null ids last; fewer candidates than k are all
returned; no query or no row gives an empty result; vectors of several lengths are an error. Further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftworks.llm import bytescan as bs
from siftworks.llm.vectors import common_length, finite
from siftworks.shared import discard, materialize

PROJECTIONS = 128
#: A window's half-width for a radius of one.
HALF_WIDTH = 1.25
#: Chance that a vector within the radius is not verified.
MISS = 0.01
#: Radii of the windows; the last one is beyond the largest distance of two unit vectors.
RADII = tuple(0.2 * 1.15**i for i in range(17))
BLOCK_ROWS = 8_192
#: The bound of a query that has none yet, below any cosine.
UNBOUNDED = -2.0
_QUERIES = 256
SEED = 12


@cache
def threshold(projections: int = PROJECTIONS) -> int:
    """The number of collisions that a row at the radius reaches with probability 1 - MISS."""
    p = 2 * NormalDist().cdf(HALF_WIDTH) - 1
    below = 0.0
    for n in range(projections + 1):
        below += comb(projections, n) * p**n * (1 - p) ** (projections - n)
        if below > MISS:
            return n
    return projections


def _unit_length(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows scaled by powers of two, which changes no cosine, and their norms."""
    scaled = np.ldexp(v, -np.frexp(np.abs(v).max(axis=1, initial=0))[1][:, None])
    return scaled, np.sqrt((scaled * scaled).sum(axis=1))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


class SortedArrays:
    """The rows of a block, sorted along each line."""

    def __init__(self, row: np.ndarray, ids: pa.Array, vectors: np.ndarray):
        self.row, self.ids = row, ids
        self.vectors, self.norms = _unit_length(vectors)
        self.lines = np.random.default_rng(SEED).standard_normal((vectors.shape[1], PROJECTIONS))
        along = (self.vectors / self.norms[:, None]) @ self.lines
        self.order = np.ascontiguousarray(np.argsort(along, axis=0).T)
        self.sorted = np.take_along_axis(along.T, self.order, axis=1)
        # single precision rules out rows that are clearly below a bound: a cosine of it is off by less than the margin
        self.narrow = (self.vectors / self.norms[:, None]).astype(np.float32)
        self.margin = (vectors.shape[1] + 8) * 2.0**-23

    def search(self, row: np.ndarray, vectors: np.ndarray, bound: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """(query, places, scores) of the k nearest rows found for each query, and of those that tie with the last, none below its bound."""
        queries, norms = _unit_length(vectors)
        along = (queries / norms[:, None]) @ self.lines
        half = np.array([*RADII[:-1], np.inf]) * HALF_WIDTH
        last = np.minimum(np.searchsorted([r * r for r in RADII], 2 - 2 * bound), len(RADII) - 1)
        bounded = bound != UNBOUNDED
        for some, levels in ((np.flatnonzero(~bounded), np.arange(len(RADII))[None]), (np.flatnonzero(bounded), last[bounded][:, None])):
            low = np.empty((len(some), levels.shape[1], PROJECTIONS), dtype=np.int64)
            high = np.empty_like(low)
            for j in range(PROJECTIONS):
                low[:, :, j] = np.searchsorted(self.sorted[j], along[some, j, None] - half[levels], "left")
                high[:, :, j] = np.searchsorted(self.sorted[j], along[some, j, None] + half[levels], "right")
            for i, q in enumerate(some.tolist()):
                radii = [RADII[x] for x in levels[i % len(levels)]]
                yield q, *self._one(row[q], queries[q], norms[q], bound[q], radii, low[i], high[i], k)

    def _collisions(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """How many of the windows each row lies in, counted by the rows in or out of them, whichever are fewer."""
        rows = len(self.row)
        windows = list(enumerate(zip(low.tolist(), high.tolist(), strict=True)))
        if 2 * int((high - low).sum()) <= rows * PROJECTIONS:
            return np.bincount(np.concatenate([self.order[j, a:b] for j, (a, b) in windows]), minlength=rows)
        outside = [part for j, (a, b) in windows for part in (self.order[j, :a], self.order[j, b:])]
        return PROJECTIONS - np.bincount(np.concatenate(outside), minlength=rows)

    def _one(self, row: int, query: np.ndarray, norm: float, bound: float, radii: list[float], low: np.ndarray, high: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        narrow = (query / norm).astype(np.float32)
        waiting = self.row != row
        places, scores = np.zeros(0, dtype=np.int64), np.zeros(0)
        for level, radius in enumerate(radii):
            if level == 0:
                count = self._collisions(low[0], high[0])
            else:  # what the windows have gained on both sides
                wide = zip(low[level].tolist(), low[level - 1].tolist(), high[level - 1].tolist(), high[level].tolist(), strict=True)
                cuts = [self.order[j, x:y] for j, (a, b, c, d) in enumerate(wide) for x, y in ((a, b), (c, d)) if x < y]
                count += np.bincount(np.concatenate([*cuts, places[:0]]), minlength=len(count))
            found = np.flatnonzero(waiting & (count >= threshold()))
            if len(found):
                waiting[found] = False
                if bound != UNBOUNDED:
                    found = found[self.narrow[found] @ narrow >= bound - self.margin]
                # summed row by row: equal vectors have equal scores
                score = (self.vectors[found] * query).sum(axis=1) / (self.norms[found] * norm)
                good = score >= bound
                places, scores = np.concatenate([places, found[good]]), np.concatenate([scores, score[good]])
                if len(scores) > k:
                    bound = max(bound, np.partition(scores, -k)[-k])
                    places, scores = places[scores >= bound], scores[scores >= bound]
            if len(scores) == k:
                bound = max(bound, scores.min())
            if 2 - 2 * bound <= radius * radius:
                break
        return places, scores


def _hits(found: Iterator[tuple[int, np.ndarray, np.ndarray]], row: np.ndarray, query_ids: pa.Array, block: SortedArrays) -> Iterator[pa.RecordBatch]:
    rows, owners, places, scores = [], [], [], []
    for q, p, s in found:
        rows.append(np.full(len(p), row[q]))
        owners.append(np.full(len(p), q))
        places.append(p)
        scores.append(s)
    if rows and sum(map(len, places)):
        at = np.concatenate(places)
        columns = [pa.array(np.concatenate(rows)), query_ids.take(pa.array(np.concatenate(owners))), block.ids.take(pa.array(at)), pa.array(np.concatenate(scores))]
        yield pa.RecordBatch.from_arrays(columns, ["row", "query_id", "id", "score"])


def _search(laid: DataFrame, id_type: str, k: int) -> DataFrame:
    """Hits of ``laid`` (block, role, row, id, bound, v): in each block the rows of role 0 are searched by those of role 1.

    A row of role 0 with a bound is a query of its own block.
    """

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        current, block = None, None

        def closed() -> SortedArrays | None:
            if not held:
                return None
            table = pa.Table.from_batches(held)
            held.clear()
            return SortedArrays(table.column("row").to_numpy(), table.column("id").combine_chunks(), _matrix(table.column("v")))

        def asked(part: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
            for at in range(0, part.num_rows, _QUERIES):
                some = part.slice(at, _QUERIES)
                row = some.column("row").to_numpy()
                found = block.search(row, _matrix(some.column("v")), some.column("bound").to_numpy(zero_copy_only=False), k)
                yield from _hits(found, row, some.column("id"), block)

        for batch in batches:
            if not batch.num_rows:
                continue
            b, role = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("block", "role"))
            cuts = np.flatnonzero((np.diff(b) != 0) | (np.diff(role) != 0)) + 1
            for start, stop in zip([0, *cuts], [*cuts, len(b)], strict=True):
                part = batch.slice(start, stop - start)
                if current != b[start]:
                    current, block = b[start], None
                    held.clear()
                if role[start] == 0:
                    held.append(part)
                    continue
                block = block or closed()
                if block is not None:
                    yield from asked(part)

    dealt = laid.repartition("block").sortWithinPartitions("block", "role")
    return dealt.mapInArrow(run, f"row long, query_id {id_type}, id {id_type}, score double")


def nearest(rows: DataFrame, is_query: Column, k: int = 5, id: str = "vec_id", vector: str = "embedding", block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(query_id, rank, id, score) of the k nearest found for each row of ``rows`` that ``is_query`` (of null: no) holds for."""
    kept = rows.filter(finite(vector) & F.exists(vector, lambda x: x != 0))
    kept = kept.select(F.monotonically_increasing_id().alias("row"), F.col(id).alias("id"), F.coalesce(is_query, F.lit(False)).alias("asks"), F.col(vector).alias("v"))
    kept = materialize(kept, "nearest-rows")
    common_length(kept, "v")
    blocks = max(1, -(-kept.count() // block_rows))
    placed = kept.withColumn("block", F.pmod(F.xxhash64("row"), F.lit(blocks)).cast("int"))
    id_type = dict(rows.dtypes)[id]
    unbounded = F.lit(UNBOUNDED)
    own = placed.select("block", F.lit(0).alias("role"), "row", "id", unbounded.alias("bound"), "v")
    asked = placed.filter("asks").select("block", F.lit(1).alias("role"), "row", "id", unbounded.alias("bound"), "v")
    home = materialize(_search(own.unionByName(asked), id_type, k), "nearest-home")
    # at most k scores and ties of one block
    bounds = home.groupBy("row").agg(F.when(F.count("*") >= k, F.min("score")).alias("least"))
    visits = placed.filter("asks").join(bounds, "row", "left")
    others = F.filter(F.sequence(F.lit(0), F.lit(blocks - 1)), lambda b: b != F.col("block"))
    visits = visits.select(F.explode(others).alias("block"), F.lit(1).alias("role"), "row", "id", F.coalesce("least", unbounded).alias("bound"), "v")
    away = _search(own.unionByName(visits), id_type, k)
    order = Window.partitionBy("row").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    ranked = home.unionByName(away).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    found = materialize(ranked.select("query_id", "rank", "id", "score"), "nearest")
    discard(kept, home)
    return found


def nearest_vectors(rows: DataFrame) -> DataFrame:
    """The 5 nearest found of each row of ``rows`` (vec_id, embedding) whose vec_id is divisible by 50: query_id, rank, vec_id, score."""
    return nearest(rows, F.col("vec_id") % 50 == 0).withColumnRenamed("id", "vec_id")
