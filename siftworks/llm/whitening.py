"""Whitening of vectors with MLlib's distributed block matrices.

Vectors become integers (``vectors.fixed_point``), and each different one counts once: the fit list. Its rows, centred, are indexed and
laid into a ``BlockMatrix``; the transposed matrix times itself is the scatter, whose products Spark adds up over splits of
the rows. The scatter is one small matrix (dimensions squared), which numpy decomposes on the driver. A second product,
of the centred rows and the whitening matrix, projects every row of the fit list, and a join brings its projection to each row
that has its vector. Counts and sums are exact integers; a row's deviation is exact too.

The driver holds the sums, the scatter and the keys of the blocks (``BLOCK_ROWS`` rows each).

Edge cases: rows whose vector is null, empty, or holds null or non-finite components are dropped; repeated rows and equal
vectors give a row each; null ids stay; components whose variance is no more than rounding noise (all vectors equal, or fewer different
vectors than dimensions) are left out, so a table of one different vector has no rows; a deviation beyond 64 bits is null; an empty table
gives an empty result; vectors of several lengths are an error. Further columns are not read.
"""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftworks.llm.vectors import common_length, finite, fixed_point
from siftworks.shared import discard, materialize, shuffle_partitions

COMPONENTS = 4
#: Rows of one block of a matrix.
BLOCK_ROWS = 4_096
#: Least share of the largest variance that a component must have.
NOISE = 1e-12


def _numbered(distinct: DataFrame) -> tuple[DataFrame, int]:
    """``distinct`` (at long, ...) with index 0 .. n-1 for at, and n; at is monotonically_increasing_id's, so only a count per partition is gathered."""
    part = F.shiftright("at", 33)
    counts = distinct.groupBy(part.alias("p")).count().orderBy("p").collect()
    ends = np.cumsum([0, *(r["count"] for r in counts)]).tolist()
    starts = distinct.sparkSession.createDataFrame([(r["p"], s) for r, s in zip(counts, ends, strict=False)], "p long, start long")
    numbered = distinct.join(F.broadcast(starts), part == F.col("p")).drop("p")  # a row per partition
    return numbered.withColumn("index", F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))).drop("start", "at"), ends[-1]


def _matrix(rows: DataFrame, n: int, width: int) -> BlockMatrix:
    """The block matrix of ``rows`` (index, v array<double>)."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("index", array_to_vector("v").alias("v")), "v")
    return IndexedRowMatrix(vectors, n, width).toBlockMatrix(BLOCK_ROWS, width)


def scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """The transposed matrix times itself; its products are added up over ``splits`` groups of row blocks."""
    turned = matrix.transpose()
    product = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def project(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> DataFrame:
    """(index, w array<double>): each row of the matrix times ``weights``."""
    local = DenseMatrix(*weights.shape, weights.reshape(-1, order="F").tolist())
    right = BlockMatrix(spark.sparkContext.parallelize([((0, 0), local)], 1), matrix.colsPerBlock, weights.shape[1])
    product = matrix.multiply(right).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("w"))


def whiten(rows: DataFrame, id: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(id, n, deviation, w, explained, identity_error) per kept row of ``rows``: w and explained are arrays, a value for each component."""
    spark = rows.sparkSession
    kept = rows.filter(finite(vector)).select(F.col(id).alias("id"), fixed_point(vector).alias("x"))
    distinct = materialize(kept.select("x").distinct().withColumn("at", F.monotonically_increasing_id()), "whiten-fit")
    d = common_length(distinct, "x")
    empty = spark.createDataFrame([], f"id {dict(kept.dtypes)['id']}, n long, deviation long, w array<double>, explained array<double>, identity_error double")
    if not d:
        return empty
    numbered, n = _numbered(distinct)
    summed = distinct.select(F.posexplode("x").alias("at", "v")).groupBy("at").agg(F.sum("v").alias("s")).collect()  # a row per dimension
    sums = [r["s"] for r in sorted(summed)]
    total = F.array(*map(F.lit, sums))
    apart = F.transform(F.arrays_zip(F.col("x").alias("x"), total.alias("s")), lambda e: F.try_subtract(F.try_multiply(e["x"], F.lit(n)), e["s"]))
    # n * x - S is exact, and so is its quotient but for one rounding
    numbered = numbered.withColumn("apart", apart)
    matrix = _matrix(numbered.select("index", F.transform("apart", lambda a: a / F.lit(float(n))).alias("v")), n, d)
    blocks = -(-n // BLOCK_ROWS)
    covariance = scatter(matrix, min(blocks, shuffle_partitions(spark))) / n
    values, axes = np.linalg.eigh((covariance + covariance.T) / 2)
    values, axes = values[::-1][:components], axes[:, ::-1][:, :components]
    shown = int((values > NOISE * max(values[0], 0)).sum()) if values[0] > 0 else 0
    if not shown:
        return empty
    projected = project(spark, matrix, axes[:, :shown] / np.sqrt(values[:shown]))
    square = F.aggregate("apart", F.lit(0).cast("long"), lambda s, a: F.try_add(s, F.try_multiply(a, a)))
    fitted = materialize(numbered.select("index", "x", square.alias("deviation")).join(projected, "index").drop("index"), "whiten-rows")
    pairs = [(i, j) for i in range(shown) for j in range(i, shown)]
    spread = fitted.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(spread[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    explained = F.array(*[F.lit(float(v / np.trace(covariance))) for v in values[:shown]])
    whole = kept.join(fitted, "x").select("id", F.lit(n).cast("long").alias("n"), "deviation", "w", explained.alias("explained"), F.lit(float(error)).alias("identity_error"))
    result = materialize(whole, "whitened")
    discard(distinct, fitted)
    return result


def whitened_components(rows: DataFrame) -> DataFrame:
    """Per kept row of ``rows`` (vec_id, embedding) and component: vec_id, component, n, deviation, whitened, explained, identity_error."""
    each = F.posexplode(F.arrays_zip(F.col("w").alias("whitened"), F.col("explained").alias("explained"))).alias("at", "c")
    flat = whiten(rows).select(F.col("id").alias("vec_id"), "n", "deviation", "identity_error", each)
    return flat.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "c.whitened", "c.explained", "identity_error")
