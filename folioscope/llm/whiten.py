"""Whitening of embeddings with MLlib's distributed block matrices.

Entries become whole numbers, x = floor(scale * entry) + offset, so sums and deviations are exact.
The rows, centred by those sums, are the rows of a BlockMatrix. Its transpose times itself is the
scatter, of which one small matrix, dimensions by dimensions, comes to the driver for `eigh`. The
BlockMatrix times the whitening matrix gives the projected rows, and their own scatter shows how far
their covariance is from the identity.

A block holds `BLOCK_ROWS` rows. A product's result of one block would be summed in one task, so its
middle dimension is split (`multiply` of the JVM class takes the number of splits, its Python twin
does not). Rows are numbered partition by partition, blocks in turn over the partitions, which
spreads the blocks over the splits; numbers may have gaps, whose rows are zero and change nothing.
Vectors of any source or label are dealt alike, so no key is hot. The driver gets dimensions x
dimensions numbers and, inside MLlib, the number of each block.

Defined results: rows whose vector is null or holds null or non-finite entries are left out, so are
those with an entry of 2**46 or more in size, whose x a double cannot hold; shorter vectors, empty
ones too, are filled up with zeros to the longest; repeated rows count each; a null id stays; rows
come back as struct `row`, whatever their other columns are called; directions without variance (all of
them for a single row) have no component, so a table without rows or variance gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark import SparkContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, functions as F

from folioscope.llm import common

#: Rows of a block; 64 dimensions make it 2 MB.
BLOCK_ROWS = 4096
#: Eigenvalues under this share of the largest are rounding errors.
FLAT = 1e-13

_LOCAL = (1 << 33) - 1


@dataclass
class Fit:
    """What all rows give: their number, sums and the components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    #: A column per component: the eigenvector over the root of its eigenvalue.
    projection: np.ndarray
    trace: float
    #: The largest entry of the whitened rows' covariance minus the identity.
    identity_error: float = 0.0


def _sound(entry: Column) -> Column:
    return entry.isNotNull() & ~F.isnan(entry) & (F.abs(entry) < float(1 << 46))


def numbered(
    frame: DataFrame, vector: str, scale: int, offset: int, keep: tuple[str, ...] | None
) -> DataFrame:
    """The rows that take part, stored: struct `row`, whole numbers `x` and a place."""
    rows = frame.select(F.struct(*(keep or "*")).alias("row"), F.col(vector).alias("held"))
    rows = rows.where(F.col("held").isNotNull() & F.forall("held", _sound))
    whole = F.transform("held", lambda entry: F.floor(scale * entry.cast("double")) + offset)
    return common.stored(rows.select("row", whole.alias("x"), F.monotonically_increasing_id().alias("place")))


def _sums(rows: DataFrame) -> tuple[int, list[tuple[int, int]], int, int]:
    """Rows, sum and count by dimension, the largest entry in size, and the write's partitions."""
    row = rows.agg(
        F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("dims"),
        F.max(F.array_max(F.transform("x", F.abs))).alias("most"),
        F.max(F.shiftright("place", 33)).alias("last"),
    ).first()
    sums = [(0, 0)] * max(row.dims or 0, 0)
    added = rows.select(F.posexplode("x").alias("at", "x")).groupBy("at")
    for part in added.agg(F.sum(F.col("x").cast("decimal(20,0)")).alias("s"), F.count("x").alias("k")).collect():
        sums[part["at"]] = (int(part.s), part.k)
    return row.n, sums, row.most or 0, (row.last or 0) + 1


def _centred(fit_n: int, sums: list[int], offset: int, wide: bool) -> Column:
    """n * x - S for every dimension, exactly; short vectors are filled up."""
    kind = "decimal(38,0)" if wide else "long"
    filled = F.concat("x", F.array_repeat(F.lit(offset).cast("long"), F.lit(len(sums)) - F.size("x")))
    total = F.array(*[F.lit(str(s)).cast(kind) for s in sums])
    return F.zip_with(filled, total, lambda x, s: x.cast(kind) * F.lit(fit_n).cast(kind) - s)


def _matrix(rows: DataFrame, values: Column, blocks: int, dims: int) -> BlockMatrix:
    """A block matrix of the rows, numbered by column index."""
    vectors = MLUtils.convertVectorColumnsFromML(
        rows.select("index", array_to_vector(values).alias("vector")), "vector"
    )
    return IndexedRowMatrix(vectors, blocks * BLOCK_ROWS, dims).toBlockMatrix(BLOCK_ROWS, dims)


def _scatter(matrix: BlockMatrix, splits: int) -> np.ndarray:
    """Transpose times matrix, its long middle dimension split over tasks."""
    turned = matrix.transpose()
    model = turned._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, splits)
    product = BlockMatrix(model, turned.rowsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()
    return (product + product.T) / 2


def _times(matrix: BlockMatrix, small: np.ndarray, context: SparkContext) -> DataFrame:
    """The rows of matrix times a small matrix: index and array of doubles."""
    factor = DenseMatrix(*small.shape, small.ravel(order="F").tolist())
    block = BlockMatrix(context.parallelize([((0, 0), factor)], 1), small.shape[0], small.shape[1])
    product = matrix.multiply(block).toIndexedRowMatrix()
    rows = callMLlibFunc("getIndexedRows", product._java_matrix_wrapper._java_model)
    return rows.select("index", vector_to_array("vector").alias("whitened"))


def whiten(
    frame: DataFrame,
    vector: str = "vector",
    components: int = 32,
    scale: int = 64,
    offset: int = 1_000_000,
    keep: tuple[str, ...] | None = None,
) -> tuple[DataFrame, Fit]:
    """Each sound row as struct `row` with its deviation and whitened values, and the fit.

    deviation is the sum over dimensions of (n * x - S) ** 2, a decimal, null beyond 38 digits; whitened holds a value for
    each of the first components. V is the covariance of x over all rows, divisor n.
    """
    rows = numbered(frame, vector, scale, offset, keep)
    n, added, most, partitions = _sums(rows)
    dims = len(added)
    # Rows that are too short hold the number of a zero.
    sums = [s + (n - k) * offset for s, k in added]
    wide = 2 * n * max(most, offset) >= 1 << 62
    local = F.col("place").bitwiseAND(_LOCAL)
    block = F.floor(local / BLOCK_ROWS) * partitions + F.shiftright("place", 33)
    exact = _centred(n, sums, offset, wide)
    kind = "decimal(38,0)" if wide else "decimal(19,0)"
    squared = F.transform(exact, lambda d: F.try_multiply(d.cast(kind), d.cast(kind)).cast("decimal(38,0)"))
    deviation = F.aggregate(squared, F.lit(0).cast("decimal(38,0)"), F.try_add)
    described = rows.select(
        "row", (block * BLOCK_ROWS + local % BLOCK_ROWS).alias("index"), deviation.alias("deviation"),
        F.transform(exact, lambda d: d.cast("double") / n).alias("centred"),
    )
    blocks = partitions * (-(-_longest(rows) // BLOCK_ROWS))
    if not n or not dims:
        none = described.select("row", "deviation", F.array().cast("array<double>").alias("whitened"))
        return none, Fit(n, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    context = rows.sparkSession.sparkContext
    splits = max(partitions, context.defaultParallelism)
    matrix = _matrix(described, F.col("centred"), blocks, dims)
    covariance = _scatter(matrix, splits) / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    kept = np.flatnonzero(values > max(values[0], 0) * FLAT * dims)[:components]
    fit = Fit(n, sums, values[kept], vectors[:, kept] / np.sqrt(values[kept]), float(np.trace(covariance)))
    if not len(kept):
        return described.select("row", "deviation", F.array().cast("array<double>").alias("whitened")), fit
    projected = common.stored(_times(matrix, fit.projection, context))
    result = common.stored(described.select("row", "index", "deviation").join(projected, "index"))
    fit.identity_error = _identity_error(result, n, len(kept), blocks, splits)
    return result.select("row", "deviation", "whitened"), fit


def _longest(rows: DataFrame) -> int:
    """Rows of the write's largest partition."""
    return (rows.agg(F.max(F.col("place").bitwiseAND(_LOCAL)).alias("last")).first().last or 0) + 1


def _identity_error(result: DataFrame, n: int, width: int, blocks: int, splits: int) -> float:
    """How far the covariance of the whitened rows, centred again, is from the identity."""
    means = result.agg(F.array(*[F.avg(F.col("whitened")[k]) for k in range(width)]).alias("m")).first().m
    shift = F.array(*[F.lit(float(m)) for m in means])
    centred = F.zip_with("whitened", shift, lambda w, m: w - m)
    covariance = _scatter(_matrix(result, centred, blocks, width), splits) / n
    return float(np.abs(covariance - np.eye(width)).max())
