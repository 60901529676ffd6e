"""Embedding whitening with MLlib's distributed block matrices.

Components are quantised to long numbers, each different vector enters the fit once, and the principal components of
these vectors whiten every row:

1. one aggregate gives the number of different vectors and the sum of each dimension, all in exact integers;
2. the centred vectors, indexed without gaps, become a ``BlockMatrix``, and transpose times itself is the scatter.  The
   middle dimension is cut into splits, so that blocks are multiplied where they lie and only products of
   dimension x dimension are added up;
3. the scatter, bounded by the dimension and not by the rows, is decomposed in the driver;
4. a second product projects the rows, and a third one, over the fitted rows, measures how far their covariance is from
   the identity.

Everything but step 3 stays in the JVM.  Copies of one vector collapse before they meet, and all rows, copies included,
are projected by their own index, so that no join has a hot key.

Defined results.  Rows take no part if the vector is null, empty, holds null or non-finite entries, or has another length
than most rows (of equally frequent lengths the longest counts).  Null and repeated ids are kept as they are.  Components
without variance (eigenvalue at most 1e-12 of the trace) cannot be whitened and are left out, as are all of them if no
two vectors differ.  ``deviation`` beyond a long raises an arithmetic error.  Extra columns are ignored.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from topicflow.scratch import Scratch

#: Rows of a block: at least and at most.  In between a block holds 2^-18 of the rows, as the driver keeps a list of blocks.
BLOCK_ROWS, MOST_BLOCK_ROWS = 1 << 10, 1 << 16
#: Most columns of a block.
BLOCK_COLS = 1024
#: Eigenvalues up to this share of the trace count as zero.
NO_VARIANCE = 1e-12


class Whitening(NamedTuple):
    """A fitted whitening: counts and sums are exact, ``matrix`` is dimension x components."""

    n: int
    sums: list[int]
    matrix: np.ndarray
    explained: np.ndarray
    identity_error: float


def quantised(vector: Column, scale: int = 64, shift: int = 1_000_000) -> Column:
    """``floor(scale * c) + shift`` of every entry, as long."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale) + F.lit(shift).cast("long"))


def _finite(vector: Column) -> Column:
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & ~bad


def _indexed(scratch: Scratch, df: DataFrame, name: str) -> DataFrame:
    """``df`` saved with ``idx``, 0 to rows - 1: place in the partition plus the rows of the partitions before."""
    saved = scratch.save(df.withColumn("at", F.monotonically_increasing_id()), name)
    part = F.shiftright(F.col("at"), 33)
    # one row per partition that has rows
    sizes = saved.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()
    first = dict(zip([s["part"] for s in sizes], np.cumsum([0, *[s["n"] for s in sizes]]).tolist()))
    offset = F.get(F.lit([first.get(p, 0) for p in range(max(first, default=-1) + 1)]).cast("array<bigint>"), part.cast("int"))
    return saved.withColumn("idx", offset + F.col("at").bitwiseAND((1 << 33) - 1)).drop("at")


def _centred(n: int, sums: list[int]) -> Column:
    """``x - sums / n``: the integer difference first, then one division."""
    total = F.lit(sums).cast("array<bigint>")
    return F.zip_with("x", total, lambda x, s: (x * n - s).cast("double") / n)


def _block_matrix(rows: DataFrame, vector: Column, count: int, width: int) -> BlockMatrix:
    vectors = rows.select("idx", array_to_vector(vector).alias("vector"))
    indexed = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    height = min(max(BLOCK_ROWS, count >> 18), MOST_BLOCK_ROWS)
    matrix = IndexedRowMatrix(indexed, count, width).toBlockMatrix(height, min(BLOCK_COLS, width))
    # every product looks at the blocks twice; a lost one is built again from the saved rows
    return matrix.persist(StorageLevel.MEMORY_AND_DISK)


def _release(matrix: BlockMatrix) -> None:
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def _gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times matrix; the middle dimension is cut into as many splits as there are row blocks or partitions."""
    java = matrix._java_matrix_wrapper._java_model
    splits = max(1, min(matrix.numRowBlocks, java.blocks().getNumPartitions()))
    product = matrix.transpose()._java_matrix_wrapper.call("multiply", java, splits)
    return BlockMatrix(product, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _times(spark: SparkSession, matrix: BlockMatrix, weights: np.ndarray) -> BlockMatrix:
    """The rows times a small matrix, whose blocks are as high as the blocks of the rows are wide."""
    height = matrix.colsPerBlock
    parts = [weights[i : i + height] for i in range(0, weights.shape[0], height)]
    blocks = [((i, 0), Matrices.dense(*part.shape, part.ravel(order="F"))) for i, part in enumerate(parts)]
    small = BlockMatrix(spark.sparkContext.parallelize(blocks, 1), height, weights.shape[1], *weights.shape)
    return matrix.multiply(small)


def usable_vectors(vectors: DataFrame, id_col: str, vector: str) -> DataFrame:
    """``id`` and ``vector`` of the rows that take part."""
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector).alias("vector")).filter(_finite(F.col("vector")))
    widths = rows.groupBy(F.size("vector").alias("width")).agg(F.count(F.lit(1)).alias("n"))
    most = widths.orderBy(F.desc("n"), F.desc("width")).first()
    return rows.filter(F.size("vector") == (most["width"] if most else -1))


def fit_whitening(rows: DataFrame, components: int, scratch: Scratch) -> Whitening:
    """The whitening of the different vectors ``x`` (arrays of longs, all of one length) of ``rows``."""
    spark = rows.sparkSession
    fitted = _indexed(scratch, rows.select("x").distinct(), "fit-list")
    width = (fitted.agg(F.max(F.size("x"))).first() or [None])[0] or 0
    total = fitted.agg(F.count(F.lit(1)), *[F.sum(F.get("x", F.lit(j))) for j in range(width)]).first()
    n, sums = total[0], list(total[1:])
    if n < 2:
        return Whitening(n, sums, np.zeros((width, 0)), np.zeros(0), 0.0)
    matrix = _block_matrix(fitted, _centred(n, sums), n, width)
    values, vectors = np.linalg.eigh(_gram(matrix) / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = values.sum()
    used = min(components, int((values > NO_VARIANCE * trace).sum()))
    vectors = vectors[:, :used]
    # either sign is right; the largest entry is made positive so that runs agree
    vectors = vectors * np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(used)])
    weights = vectors / np.sqrt(values[:used])
    covariance = _gram(_times(spark, matrix, weights)) / n
    _release(matrix)
    return Whitening(n, sums, weights, values[:used] / trace, float(np.abs(covariance - np.eye(used)).max()))


def apply_whitening(rows: DataFrame, fit: Whitening, scratch: Scratch) -> DataFrame:
    """``id``, exact ``deviation`` and ``whitened`` (an array) of saved rows with ``idx``, ``id`` and ``x``."""
    spark = rows.sparkSession
    last = rows.agg(F.max("idx")).first()[0]
    if last is None or not fit.matrix.shape[1]:
        return rows.limit(0).select("id", F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("whitened"))
    matrix = _block_matrix(rows, _centred(fit.n, fit.sums), last + 1, len(fit.sums))
    product = _times(spark, matrix, fit.matrix)
    projected = callMLlibFunc("getIndexedRows", product.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    projected = scratch.save(projected.toDF("idx", "vector").select("idx", vector_to_array("vector").alias("whitened")), "projected")
    _release(matrix)
    gap = F.zip_with("x", F.lit(fit.sums).cast("array<bigint>"), lambda x, s: x * fit.n - s)
    far = F.aggregate(gap, F.lit(0.0), lambda a, g: a + g.cast("double") * g)
    exact = F.aggregate(gap, F.lit(0).cast("long"), lambda a, g: a + g * g)
    deviation = F.when(far < 9.2e18, exact).otherwise(F.raise_error("a squared deviation does not fit a long"))
    return rows.select("idx", "id", deviation.alias("deviation")).join(projected, "idx").drop("idx")


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", components: int = 16) -> DataFrame:
    """One row per usable vector and component: ``id_col``, component, n, deviation, whitened, explained, identity_error."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "whitening")
    usable = usable_vectors(vectors, id_col, vector)
    rows = _indexed(scratch, usable.select("id", quantised(F.col("vector")).alias("x")), "rows")
    fit = fit_whitening(rows, components, scratch)
    done = apply_whitening(rows, fit, scratch)
    parts = F.arrays_zip(F.col("whitened"), F.lit(fit.explained.tolist()).cast("array<double>").alias("explained"))
    return done.select("id", "deviation", F.posexplode(parts).alias("at", "c")).select(
        F.col("id").alias(id_col),
        (F.col("at") + 1).cast("int").alias("component"),
        F.lit(fit.n).cast("long").alias("n"),
        "deviation",
        F.col("c.whitened").alias("whitened"),
        F.col("c.explained").alias("explained"),
        F.lit(fit.identity_error).alias("identity_error"),
    )
