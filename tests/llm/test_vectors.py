"""Operators on vectors against brute force: whitening, nearest search, product codes."""

import hashlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from siftworks.llm import collisions, queries, vector_codes, whitening

SCHEMA = "vec_id long, embedding array<float>, label string, x string, id string, row string, block string, index string, at string, tag string, code string"
DIMS = 16


def made(n=700, seed=1):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(9, DIMS))
    v = (centres[rng.integers(0, 9, n)] + rng.normal(size=(n, DIMS)) * 0.3) * 0.4
    v[50:250] = v[50]  # hot copies
    v[300] = v[301] * 2
    v[310] = 0
    return v.astype(np.float32)


VECTORS = made()
BAD = [None, [], [None] * DIMS, [1.0] * (DIMS - 1) + [None], [float("nan")] + [0.0] * (DIMS - 1), [float("-inf")] + [0.0] * (DIMS - 1)]


@pytest.fixture(scope="module")
def table(spark):
    rows = [(i, v.tolist(), None if i % 7 == 0 else f"l{i % 3}") for i, v in enumerate(VECTORS)]
    rows += [(1000 + i, v, "bad") for i, v in enumerate(BAD)]
    rows += [(5, VECTORS[5].tolist(), "l2"), (None, VECTORS[6].tolist(), "l0")]
    return spark.createDataFrame([(*r, *["clash"] * 8) for r in rows], SCHEMA).repartition(5)


def kept(table):
    rows = [r for r in table.collect() if r.embedding and all(x is not None and np.isfinite(x) for x in r.embedding)]
    return rows, np.array([r.embedding for r in rows], dtype=np.float64)


def test_whitening_against_brute_force(table, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 64)
    rows, v = kept(table)
    got = whitening.whitened_components(table).collect()
    assert len(got) == 4 * len(rows) == 4 * 702
    x = np.floor(v * 256).astype(np.int64)
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    values, axes = np.linalg.eigh(np.cov(fit.T, bias=True))
    values, axes = values[::-1], axes[:, ::-1]
    whitened = ((n * x - s) / n) @ (axes[:, :4] / np.sqrt(values[:4]))
    deviation = ((n * x - s) ** 2).sum(axis=1)
    by = {}
    for r in got:
        by.setdefault((r.vec_id, r.component), []).append(r)
    signs = [np.sign(by[(0, k + 1)][0].whitened * whitened[next(i for i, r in enumerate(rows) if r.vec_id == 0), k]) for k in range(4)]
    for i, r in enumerate(rows):
        for k in range(4):
            for g in by[(r.vec_id, k + 1)]:
                assert (g.n, g.deviation) == (n, deviation[i])
                assert abs(g.whitened * signs[k] - whitened[i, k]) < 1e-9 and abs(g.explained - values[k] / values.sum()) < 1e-9 and g.identity_error < 1e-9


def test_whitening_of_flat_tables(spark, table):
    assert whitening.whitened_components(table.limit(0)).count() == 0
    assert whitening.whitened_components(table.filter("label = 'bad'")).count() == 0
    assert whitening.whitened_components(table.filter("vec_id between 60 and 70")).count() == 0  # one different vector
    line = spark.createDataFrame([(i, [i / 256.0, 2 * i / 256.0, 0.0]) for i in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whitened_components(line).collect()
    assert len(got) == 10 and {r.component for r in got} == {1} and abs(got[0].explained - 1) < 1e-12
    huge = spark.createDataFrame([(i, [float(i << 40), 0.0]) for i in range(3)], "vec_id long, embedding array<double>")
    assert [r.deviation for r in whitening.whitened_components(huge).collect() if r.vec_id != 1] == [None, None]
    with pytest.raises(ValueError):
        whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "vec_id long, embedding array<double>"))


def test_search_against_brute_force(table):
    got = collisions.nearest(table, F.col("vec_id") % 50 == 0, block_rows=100).collect()
    rows, v = kept(table)
    rows, v = zip(*[(r, x) for r, x in zip(rows, v, strict=True) if x.any()], strict=True)
    v = np.array(v)
    norms = np.sqrt((v * v).sum(axis=1))
    hits = asked = 0
    found = {(r.query_id, r.rank): r for r in got}
    for i, r in enumerate(rows):
        if r.vec_id is None or r.vec_id % 50:
            continue
        score = (v * v[i]).sum(axis=1) / (norms * norms[i])
        order = sorted((j for j in range(len(v)) if j != i), key=lambda j: (-score[j], rows[j].vec_id is None, rows[j].vec_id or 0))[:5]
        mine = [found[(r.vec_id, k)] for k in range(1, 6)]
        assert [m.score for m in mine] == sorted((m.score for m in mine), reverse=True)
        asked += 5
        hits += len({m.id for m in mine} & {rows[j].vec_id for j in order})
        for m in mine:
            assert any(abs(m.score - score[j]) < 1e-12 for j, x in enumerate(rows) if x.vec_id == m.id)
    assert len(got) == asked and hits >= 0.98 * asked
    # ties of copies go to the smaller ids
    assert [found[(50, k)].id for k in range(1, 6)] == [51, 52, 53, 54, 55] and [found[(100, k)].id for k in range(1, 6)] == [50, 51, 52, 53, 54]


def test_search_of_few_rows(spark, table):
    search = collisions.nearest_vectors
    assert search(table.limit(0)).count() == 0 and search(table.filter("vec_id = 1")).count() == 0 and search(table.filter("vec_id = 50")).count() == 0
    few = spark.createDataFrame([(50, [1.0, 0.0]), (50, [1.0, 0.0]), (1, [-1.0, 0.0]), (None, [-3.0, 0.0]), (2, [0.0, 0.0])], "vec_id long, embedding array<double>")
    got = [tuple(r) for r in search(few).orderBy("query_id", "rank", "vec_id").collect()]
    assert got == [(50, 1, 50, 1.0), (50, 1, 50, 1.0), (50, 2, 1, -1.0), (50, 2, 1, -1.0), (50, 3, None, -1.0), (50, 3, None, -1.0)]
    tiny = spark.createDataFrame([(50, [1e-300, 1e-300]), (1, [1e300, 1e300])], "vec_id long, embedding array<double>")
    assert abs(search(tiny).first().score - 1) < 1e-12


@pytest.mark.parametrize("spread", [1, 4, 900])
def test_cover_tree(spread):
    values = np.random.default_rng(3).integers(-spread, spread + 1, (900, 4))
    tree, place = vector_codes.cover_tree(values)
    assert (tree.points[place] == values).all() and tree.weight.sum() == 900
    gap = lambda i: ((tree.points[tree.low[i] : tree.high[i]] - tree.points[tree.low[i]]) ** 2).sum(axis=1)
    for i in range(len(tree.low)):
        assert tree.radius2[i] == gap(i).max()
        children = range(tree.first[i], tree.last[i])
        assert (tree.high[i] - tree.low[i] > vector_codes.LEAF_POINTS) == bool(children)
        if children:
            assert tree.low[children[0]] == tree.low[i] and tree.high[children[-1]] == tree.high[i]
            centres = tree.points[tree.low[list(children)]]
            apart = vector_codes.squared(centres, centres) + (tree.radius2[i] + 1) * np.eye(len(centres), dtype=np.int64)
            assert (4 * apart > tree.radius2[i]).all() and (4 * tree.radius2[list(children)] <= tree.radius2[i]).all()
    for book in (values[:1], values[:64], np.repeat(values[:3], 2, axis=0)):
        assert (tree.nearest(book) == vector_codes.squared(tree.points, book).argmin(axis=1)).all()


def codes(rows, v, parts, entries, rounds):
    """(code, error) of each row, and the codebooks, by comparing everything."""
    x = np.floor(v * 256).astype(np.int64).reshape(len(v), parts, -1)
    first = sorted(range(len(rows)), key=lambda i: (rows[i].vec_id is None, rows[i].vec_id or 0, x[i].tolist()))[:entries]
    books = x[first].transpose(1, 0, 2).copy()
    nearest = lambda: np.stack([vector_codes.squared(x[:, p], books[p]).argmin(axis=1) for p in range(parts)], axis=1)
    for _ in range(rounds):
        label = nearest()
        for p in range(parts):
            for e in set(label[:, p].tolist()):
                own = x[label[:, p] == e, p]
                books[p, e] = own.sum(axis=0) // len(own)
    label = nearest()
    error = sum(((x[:, p] - books[p][label[:, p]]) ** 2).sum(axis=1) for p in range(parts))
    return ["".join(f"{e:02x}" for e in row) for row in label], error, books


def test_codes_against_brute_force(table, monkeypatch):
    monkeypatch.setattr(vector_codes, "BLOCK_ROWS", 37)
    rows, v = kept(table)
    code, error, books = codes(rows, v, 16, 64, 2)
    got = vector_codes.code_digests(table).collect()
    by_label = {}
    for r, e in zip(rows, error, strict=True):
        by_label[r.label] = by_label.get(r.label, 0) + int(e)
    want = sorted((-1 if r.vec_id is None else r.vec_id, c, int(e), by_label[r.label]) for r, c, e in zip(rows, code, error, strict=True))
    assert sorted((-1 if r.vec_id is None else r.vec_id, r.code, r.error, r.label_error) for r in got) == want
    assert {r.codebooks_sha256 for r in got} == {hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()}


def test_codes_of_few_rows(table):
    assert vector_codes.code_digests(table.limit(0)).count() == 0
    few = table.filter("vec_id < 3")
    rows, v = kept(few)
    code, error, _ = codes(rows, v, 16, 64, 2)
    assert {(r.vec_id, r.code, r.error) for r in vector_codes.code_digests(few).collect()} == {(r.vec_id, c, e) for r, c, e in zip(rows, code, error.tolist(), strict=True)}
    with pytest.raises(ValueError):
        vector_codes.compress(few, parts=5)


def test_codes_sql(table, spark):
    db = duckdb.connect()
    db.register("embeddings", table.filter("vec_id is not null").select("vec_id", "embedding", "label").toArrow())
    want = db.sql(queries.op13_sql()).fetchall()
    got = vector_codes.code_digests(table.filter("vec_id is not null"))
    assert sorted(want) == sorted(map(tuple, got.select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def test_a_bounded_visit_opens_one_radius(monkeypatch):
    rng = np.random.default_rng(3)
    vectors = rng.standard_normal((1500, 24))
    vectors[700:720] = vectors[:20]  # ties
    block = collisions.SortedArrays(np.arange(1500), pa.array(np.arange(1500)), vectors)
    asked, rows = vectors[:20] + 0.3 * rng.standard_normal((20, 24)), np.arange(5000, 5020)
    free = {q: (places, scores) for q, places, scores in block.search(rows, asked, np.full(20, collisions.UNBOUNDED), 5)}
    bound = np.array([free[q][1].min() for q in range(20)])
    calls, counted = [], np.bincount
    monkeypatch.setattr(collisions.np, "bincount", lambda *args, **kwargs: (calls.append(1), counted(*args, **kwargs))[1])
    held = {q: (places, scores) for q, places, scores in block.search(rows, asked, bound, 5)}
    assert len(calls) == 20 and held.keys() == free.keys()
    for q, (places, scores) in held.items():
        assert dict(zip(places.tolist(), scores.tolist())) == dict(zip(free[q][0].tolist(), free[q][1].tolist()))
