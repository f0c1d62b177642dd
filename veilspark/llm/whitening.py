"""Whitening of embeddings with Spark MLlib's BlockMatrix.

An entry c becomes the whole number ``x = floor(64 * c) + 1000000``; the covariance V of the x-vectors of all rows is
taken about their mean, divisor n. A component is a unit eigenvector of V; components are numbered by falling eigenvalue,
each with its largest entry positive.

Method: rows get consecutive indices, and their centred x-vectors become an ``IndexedRowMatrix`` and from that blocks of
``ROWS`` by ``COLUMNS``. The scatter is ``transpose().multiply()`` of those blocks, with the sum over row blocks split over
many tasks (its middle dimension); only the finished square of the dimension reaches the driver, where ``eigh`` takes it
apart. Multiplying the blocks by the whitening matrix projects all rows, and a second transpose-multiply of the result
measures how far its covariance is from the identity. Besides blocks of fixed size the driver holds the block numbers
(n / ROWS of them) and matrices of the dimension squared.

Counts and sums are whole numbers of any size, so the mean and ``deviation`` are exact.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import Matrices
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.session import store

SCALE, SHIFT = 64, 1_000_000
COMPONENTS = 32
ROWS, COLUMNS = 1024, 1024      # of a block
BLOCKS_PER_TASK = 16            # row blocks that one task of the scatter adds up
NOTHING = 1e-12                 # an eigenvalue under this part of the trace is no variance but rounding
_HALF = 31                      # low bits of a split sum
_TOP = float(2**62)

RESULT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _dense(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold ``width`` finite numbers whose x is a 64-bit number, and their x-vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = np.asarray(column.offsets)
    values = column.values.cast(pa.float64()).fill_null(float("nan")).to_numpy(zero_copy_only=False)
    with np.errstate(invalid="ignore", over="ignore"):
        scaled = np.floor(SCALE * values)
        bad = np.concatenate([[0], np.cumsum(~(np.abs(scaled) < _TOP))])
    good = (np.diff(offsets) == width) & np.asarray(column.is_valid()) & (bad[offsets[1:]] == bad[offsets[:-1]])
    at = (offsets[:-1][good][:, None] + np.arange(width)).ravel()
    return good, (scaled[at].astype(np.int64) + SHIFT).reshape(-1, width)


def _lists(x: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1], pa.array(x.ravel()))


def _whole(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, x = _dense(batch.column(1), width)
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(pa.array(good)), _lists(x)], ["id", "x"])
    return run


def _partial(width: int):
    """Sums of a task by dimension, each as two numbers, so that no row count overflows them."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(width, np.int64), np.zeros(width, np.int64)
        for batch in batches:
            x = np.asarray(batch.column(0).values).reshape(-1, width)
            n, high, low = n + len(x), high + (x >> _HALF).sum(0), low + (x & ((1 << _HALF) - 1)).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(np.full(width, n)), pa.array(high), pa.array(low)],
                                         ["dimension", "n", "high", "low"])
    return run


def _centred(n: int, sums: list[int]):
    """(index, id, deviation, x - S / n), computed from n * x - S in whole numbers."""
    width, largest = len(sums), max(map(abs, sums))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.asarray(batch.column(2).values).reshape(-1, width)
            spread = n * int(np.abs(x).max(initial=0)) + largest
            if spread < 2**62:
                y = n * x - np.array(sums, dtype=np.int64)
                spread = int(np.abs(y).max(initial=0))
            else:
                y = n * x.astype(object) - np.array(sums, dtype=object)
            square = y if y.dtype != object and width * spread**2 < 2**63 else y.astype(object)
            deviation = (square * square).sum(axis=1) if len(x) else np.zeros(0, np.int64)
            deviation = pa.array([int(v) if v < 2**63 else None for v in deviation], type=pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), deviation, _lists((y / n).astype(np.float64))],
                                             ["index", "id", "deviation", "centred"])
    return run


def _indexed(rows: DataFrame) -> DataFrame:
    """Adds ``index``, consecutive from 0: the row's place in the task that wrote it, after the rows of the tasks before."""
    tasks = rows.groupBy(F.shiftrightunsigned("row", 33).alias("task")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(W.orderBy("task").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    tasks = store(tasks.select(F.col("task"), before.alias("before")), "whitening-tasks")      # one row per task
    place = F.col("row").bitwiseAND(F.lit(2**33 - 1))
    return rows.join(tasks, F.shiftrightunsigned("row", 33) == F.col("task")).select((F.col("before") + place).alias("index"), "id", "x")


def whiten(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per remaining row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows go whose vector is null or empty, holds null or non-finite entries or one whose x exceeds 2 ** 62, or is of another
    length than most (of equally frequent lengths the smaller counts). Null and repeated ids and repeated rows are rows of
    their own; of other columns none is looked at. Components without variance are left out, so equal vectors and a single
    one give no rows, as does an empty table. Equal eigenvalues are ordered as eigh returns them. deviation is null where it
    exceeds 64 bits. Vectors may be as long as a square matrix of that size fits the driver.
    """
    spark = df.sparkSession
    kind = dict(df.dtypes)[id_col]
    empty = spark.createDataFrame([], f"`{id_col}` {kind}, {RESULT}")
    given = df.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    usual = given.where("size(vector) > 0").groupBy(F.size("vector").alias("width")).count().orderBy(F.desc("count"), "width").first()
    if usual is None:
        return empty
    width = usual["width"]
    rows = given.mapInArrow(_whole(width), f"id {kind}, x array<bigint>")
    rows = store(rows.withColumn("row", F.monotonically_increasing_id()), "whitening-rows")

    partial = rows.select("x").mapInArrow(_partial(width), "dimension int, n long, high long, low long")
    total = (F.sum(F.col("high").cast("decimal(30,0)")) * F.lit(2**_HALF) + F.sum(F.col("low").cast("decimal(30,0)"))).cast("decimal(38,0)")
    summed = partial.groupBy("dimension").agg(F.sum("n").alias("n"), total.alias("s")).orderBy("dimension").collect()   # width rows
    n = int(summed[0]["n"]) if summed else 0
    if not n:
        return empty
    centred = store(_indexed(rows).mapInArrow(_centred(n, [int(r["s"]) for r in summed]),
                                              f"index long, id {kind}, deviation long, centred array<double>"), "whitening-centred")

    vectors = centred.select("index", array_to_vector("centred").alias("vector"))
    matrix = IndexedRowMatrix(MLUtils.convertVectorColumnsFromML(vectors, "vector"), n, width).toBlockMatrix(ROWS, COLUMNS)
    scatter = _gram(matrix)
    values, directions = np.linalg.eigh((scatter + scatter.T) / (2 * n))
    values, directions = values[::-1], directions[:, ::-1]
    trace = np.trace(scatter) / n
    most = int(min(components, (values > NOTHING * trace).sum()))
    if not most:
        return empty
    values, directions = values[:most], directions[:, :most]
    directions = directions * np.sign(directions[np.abs(directions).argmax(0), np.arange(most)])

    projected = matrix.multiply(_blocks(spark, directions / np.sqrt(values)))
    error = float(np.abs(_gram(projected) / n - np.eye(most)).max())
    scores = callMLlibFunc("getIndexedRows", projected.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    scores = scores.select("index", vector_to_array("vector").alias("scores"))
    explained = F.array(*[F.lit(float(v / trace)) for v in values])
    each = centred.select("index", "id", "deviation").join(scores, "index").select("id", "deviation", F.posexplode("scores").alias("place", "whitened"))
    return each.select(F.col("id").alias(id_col), (F.col("place") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(explained, F.col("place") + 1).alias("explained"), F.lit(error).alias("identity_error"))


def _gram(matrix: BlockMatrix) -> np.ndarray:
    """Transpose times itself. The wrapper's multiply has no number of splits, without which one task would add up all blocks."""
    blocks = matrix._java_matrix_wrapper._java_model
    splits = max(1, -(-matrix.numRowBlocks // BLOCKS_PER_TASK))
    product = BlockMatrix(blocks.transpose().multiply(blocks, splits), matrix.colsPerBlock, matrix.colsPerBlock)
    return product.toLocalMatrix().toArray()


def _blocks(spark, matrix: np.ndarray) -> BlockMatrix:
    """A local matrix as blocks that fit the columns of the rows' blocks."""
    parts = []
    for i, first in enumerate(range(0, len(matrix), COLUMNS)):
        part = matrix[first:first + COLUMNS]
        parts.append(((i, 0), Matrices.dense(*part.shape, part.ravel(order="F").tolist())))
    return BlockMatrix(spark.sparkContext.parallelize(parts, len(parts)), COLUMNS, matrix.shape[1], *matrix.shape)
