"""Product codes of vectors, by Lloyd's rounds over cover trees that each partition builds once.

Vectors become integers (``vectors.fixed_point``) and are cut into equal parts; each part position has a codebook of its own. A task
cuts its rows into blocks of ``BLOCK_ROWS`` and builds a cover tree of each block and part position: a node covers points
within its radius, its children lie more than half of that apart and cover all its points within half of it. The trees are
written to the shared folder once and read in each round. The points of a node are a run of the tree's order, so that
cumulative sums give the count and the sum of any subtree at once.

A round brings the codebook to the trees. If the distance of a node's centre to one entry is smaller than that to every
other by more than twice the node's radius, no point of it can have another nearest entry (nor a tie): the whole subtree
is assigned. Other nodes hand the question to their children, and the leaves compare their points exactly, ties to
the lower entry. A task adds up its blocks and reports one row per entry; the sums meet in Spark, and the driver holds the
codebooks alone (parts x entries).

Edge cases: rows whose vector is null, empty, or holds null or non-finite components are dropped; fewer rows than entries
give a smaller codebook; equal ids are ordered by their vectors, null ids come last; repeated rows each count and each get a code; an
empty table gives an empty result; vectors of several lengths, or of a length that the parts don't divide, are an error.
Further columns are not read. Components beyond 2**30 in fixed point are out of range.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftworks.llm import bytescan as bs
from siftworks.llm.vectors import common_length, finite, fixed_point
from siftworks.shared import discard, materialize

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows of one tree.
BLOCK_ROWS = 4_096
#: A node with this many points or fewer is a leaf.
LEAF_POINTS = 8


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of each row of ``a`` to each row of ``b`` (integers, exact)."""
    out = np.zeros((len(a), len(b)), dtype=np.int64)
    for j in range(a.shape[1]):
        gap = a[:, j, None] - b[None, :, j]
        out += gap * gap
    return out


@dataclass
class CoverTree:
    """Points in tree order with their weights; node i holds points[low[i]:high[i]], its centre first, and its children are nodes first[i]:last[i]."""

    points: np.ndarray
    weight: np.ndarray
    low: np.ndarray
    high: np.ndarray
    radius2: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def sums(self) -> tuple[np.ndarray, np.ndarray]:
        """Cumulative weights and weighted sums of the points in order, from 0."""
        count = np.concatenate([[0], np.cumsum(self.weight)])
        total = np.zeros((len(self.points) + 1, self.points.shape[1]), dtype=np.int64)
        np.cumsum(self.points * self.weight[:, None], axis=0, out=total[1:])
        return count, total

    def nearest(self, book: np.ndarray) -> np.ndarray:
        """The nearest entry of each point, ties to the lower one."""
        label = np.zeros(len(self.points), dtype=np.int64)
        at = np.zeros(min(1, len(self.low)), dtype=np.int64)
        while len(at):
            gap2 = squared(self.points[self.low[at]], book)
            best = gap2.argmin(axis=1)
            gap = np.sqrt(gap2)
            reach = gap[np.arange(len(at)), best] + 2 * np.sqrt(self.radius2[at])
            sure = (gap <= reach[:, None] * (1 + 1e-12) + 1e-9).sum(axis=1) == 1
            label[_runs(self.low[at[sure]], self.high[at[sure]])] = np.repeat(best[sure], self.high[at[sure]] - self.low[at[sure]])
            at = at[~sure]
            leaf = self.first[at] == self.last[at]
            open_ = _runs(self.low[at[leaf]], self.high[at[leaf]])
            if len(open_):
                label[open_] = squared(self.points[open_], book).argmin(axis=1)
            at = _runs(self.first[at[~leaf]], self.last[at[~leaf]])
        return label


def _runs(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """low[0] .. high[0]-1, low[1] .. high[1]-1, and so on."""
    n = high - low
    ends = np.cumsum(n)
    return np.repeat(low - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)


def cover_tree(values: np.ndarray) -> tuple[CoverTree, np.ndarray]:
    """The tree of the rows of ``values`` (at least one) and the place of each row in its order."""
    points, inverse, weight = np.unique(values, axis=0, return_inverse=True, return_counts=True)
    order = np.arange(len(points))
    low, high = [np.zeros(1, np.int64)], [np.array([len(points)])]
    radius2 = [((points - points[0]) ** 2).sum(axis=1).max(keepdims=True)]
    first, last = [], []
    made = 1
    while True:
        # the nodes of the level above: which are split, and their points
        split = high[-1] - low[-1] > LEAF_POINTS
        a, b, r2 = low[-1][split], high[-1][split], radius2[-1][split]
        if not len(a):
            first.append(np.full(len(split), made))
            last.append(np.full(len(split), made))
            break
        at = _runs(a, b)
        node = np.repeat(np.arange(len(a)), b - a)
        turn = np.zeros(len(at), dtype=np.int64)
        gap2 = np.zeros(len(at), dtype=np.int64)
        left, k = np.arange(len(at)), 0
        while len(left):  # of each node the first point without a centre becomes one, and takes those within half of the radius
            own = node[left]
            heads = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            centre = left[np.repeat(heads, np.diff(np.append(heads, len(left))))]
            d2 = ((points[order[at[left]]] - points[order[at[centre]]]) ** 2).sum(axis=1)
            near = 4 * d2 <= r2[own]
            turn[left[near]], gap2[left[near]] = k, d2[near]
            left, k = left[~near], k + 1
        placed = np.lexsort((turn, node))  # stable: a centre stays the first of its points
        order[at] = order[at[placed]]
        key = (node * k + turn)[placed]
        heads = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        children = np.bincount(node[placed][heads], minlength=len(a))
        ends = np.zeros(len(split), dtype=np.int64)
        ends[split] = children
        stop = made + np.cumsum(ends)
        first.append(stop - ends)
        last.append(stop)
        low.append(at[heads])
        high.append(np.append(at[heads[1:] - 1], at[-1]) + 1)
        radius2.append(np.maximum.reduceat(gap2[placed], heads))
        made += len(heads)
    place = np.empty(len(points), dtype=np.int64)
    place[order] = np.arange(len(points))
    tree = CoverTree(points[order], weight[order], *map(np.concatenate, (low, high, radius2, first, last)))
    return tree, place[inverse.reshape(-1)]


def _packed(trees: list[tuple[CoverTree, np.ndarray]]) -> bytes:
    out = io.BytesIO()
    arrays = {f"{i}.{name}": x for i, (tree, place) in enumerate(trees) for name, x in (vars(tree) | {"place": place}).items()}
    np.savez(out, **{k: x.astype(np.int32) if np.abs(x).max(initial=0) < 1 << 31 else x for k, x in arrays.items()})
    return out.getvalue()


def _unpacked(data: bytes, parts: int) -> list[tuple[CoverTree, np.ndarray]]:
    names = [*CoverTree.__dataclass_fields__, "place"]
    with np.load(io.BytesIO(data)) as held:
        rows = [[held[f"{i}.{name}"].astype(np.int64) for name in names] for i in range(parts)]
    return [(CoverTree(*row[:-1]), row[-1]) for row in rows]


def _trees(rows: DataFrame, parts: int) -> DataFrame:
    """(ids, tags, trees) per block of ``rows`` (id, tag, x)."""
    kinds = dict(rows.dtypes)

    def block(table: pa.Table) -> pa.RecordBatch:
        flat = table.column("x").combine_chunks()
        x = flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, parts, -1)
        trees = _packed([cover_tree(x[:, i]) for i in range(parts)])
        whole = [pa.ListArray.from_arrays([0, table.num_rows], table.column(c).combine_chunks()) for c in ("id", "tag")]
        return pa.RecordBatch.from_arrays([*whole, pa.array([trees], pa.binary())], ["ids", "tags", "trees"])

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                held.append(batch.slice(at, BLOCK_ROWS))
                n += held[-1].num_rows
                while n >= BLOCK_ROWS:
                    table = pa.Table.from_batches(held)
                    yield block(table.slice(0, BLOCK_ROWS))
                    rest = table.slice(BLOCK_ROWS)
                    held, n = rest.to_batches(), rest.num_rows
        if n:
            yield block(pa.Table.from_batches(held))

    return rows.mapInArrow(run, f"ids array<{kinds['id']}>, tags array<{kinds['tag']}>, trees binary")


def _sums(trees: DataFrame, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How many parts each entry of ``books`` (parts x entries x width) has, and their sums."""
    parts, entries, width = books.shape

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros((parts, entries), dtype=np.int64)
        total = np.zeros((parts, entries, width), dtype=np.int64)
        for batch in batches:
            for data in batch.column("trees"):
                for i, (tree, _) in enumerate(_unpacked(data.as_py(), parts)):
                    label = tree.nearest(books[i])
                    n, s = tree.sums()
                    cuts = np.flatnonzero(np.concatenate([[True], label[1:] != label[:-1], [True]]))  # runs of one entry
                    np.add.at(count[i], label[cuts[:-1]], np.diff(n[cuts]))
                    np.add.at(total[i], label[cuts[:-1]], np.diff(s[cuts], axis=0))
        part, entry = np.nonzero(count)
        sums = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1) * width, pa.int32()), pa.array(total[part, entry].reshape(-1)))
        yield pa.RecordBatch.from_arrays([pa.array(part.astype(np.int32)), pa.array(entry.astype(np.int32)), pa.array(count[part, entry]), sums], ["part", "entry", "n", "sums"])

    found = trees.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = [F.sum(F.col("sums")[j]).alias(f"s{j}") for j in range(width)]
    count, total = np.zeros((parts, entries), dtype=np.int64), np.zeros((parts, entries, width), dtype=np.int64)
    for row in found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *each).collect():  # parts x entries rows
        count[row["part"], row["entry"]], total[row["part"], row["entry"]] = row["n"], [row[f"s{j}"] for j in range(width)]
    return count, total


def _codes(trees: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, tag, code, error) of each row."""
    parts = len(books)
    kinds = dict(trees.dtypes)

    @bs.released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                ids, tags = (batch.column(c)[k].values for c in ("ids", "tags"))
                error = np.zeros(len(ids), dtype=np.int64)
                code = np.zeros((len(ids), parts), dtype=np.uint8)
                for i, (tree, place) in enumerate(_unpacked(batch.column("trees")[k].as_py(), parts)):
                    label = tree.nearest(books[i])
                    error += ((tree.points - books[i][label]) ** 2).sum(axis=1)[place]
                    code[:, i] = label[place]
                digits = code.tobytes().hex()
                text = [digits[at : at + 2 * parts] for at in range(0, len(digits), 2 * parts)]
                yield pa.RecordBatch.from_arrays([ids, tags, pa.array(text), pa.array(error)], ["id", "tag", "code", "error"])

    item = lambda c: kinds[c].removeprefix("array<").removesuffix(">")
    return trees.mapInArrow(run, f"id {item('ids')}, tag {item('tags')}, code string, error long")


def compress(
    rows: DataFrame, id: str = "vec_id", vector: str = "embedding", tag: str = "label", parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> tuple[DataFrame, np.ndarray]:
    """(id, tag, code, error) per kept row, and the codebooks (parts x entries x width). The codebooks start from the rows with the smallest ids.

    At most 256 entries: a code has two hex digits for each part.
    """
    if not 0 < entries <= 256:
        raise ValueError("1 to 256 entries")
    kept = rows.filter(finite(vector)).select(F.col(id).alias("id"), F.col(tag).alias("tag"), fixed_point(vector).alias("x"))
    length = common_length(kept, "x")
    if length % parts:
        raise ValueError(f"{parts} parts don't divide {length} components")
    start = [r["x"] for r in kept.orderBy(F.col("id").asc_nulls_last(), "x").limit(entries).select("x").collect()]
    books = np.array(start, dtype=np.int64).reshape(len(start), parts, -1).transpose(1, 0, 2) if start else np.zeros((parts, 0, 1), dtype=np.int64)
    trees = materialize(_trees(kept, parts), "codes-trees")
    for _ in range(rounds):
        count, total = _sums(trees, books)
        books = np.where(count[:, :, None] > 0, total // np.maximum(count, 1)[:, :, None], books)
    coded = materialize(_codes(trees, books), "codes")
    discard(trees)
    return coded, books


def code_digests(rows: DataFrame) -> DataFrame:
    """Per kept row of ``rows`` (vec_id, embedding, label): vec_id, code, error, label_error and the digest of all codebooks."""
    coded, books = compress(rows)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    sums = coded.groupBy("tag").agg(F.sum("error").alias("label_error")).withColumnRenamed("tag", "_tag")
    joined = coded.join(sums, F.col("tag").eqNullSafe(F.col("_tag")))
    return joined.select(F.col("id").alias("vec_id"), "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))
