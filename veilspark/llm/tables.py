"""Reading the given tables, and names that cannot clash with a caller's."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilspark.llm import text as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


TEXTS_PER_BATCH = 512     # of texts handed to a Python worker at once; by default it would be 10,000, however long they are


def small_batches(df: DataFrame) -> None:
    """Bounds the memory of Python workers that read texts."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(TEXTS_PER_BATCH))


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, which gives back its memory when its part of the rows is done.

    Python workers outlive their tasks and wait for others; what they hold meanwhile, freed but not returned, counts against
    the executor.
    """
    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            release()
    return whole


def release() -> None:
    T.forget()
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)      # of glibc; other allocators return memory by themselves
    if trim is not None:
        trim(0)


def bucket(column: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts."""
    return F.crc32(F.col(column).cast("string")) % parts
