"""Which event ids are stored already, without reading them all.

Ids lie in hash buckets, ordered by day.  For each bucket and day of an append
there is a Bloom filter of ``BITS`` bits an id beside them.  A batch of ids is
tested against the filters of its buckets; only buckets and days in which some
id may occur are opened, and there ids are compared in full, so the answer is
exact, over all days.

A filter takes a twelfth of its ids.  Choose ``buckets`` so that the filters of
one (ids / buckets * 3 bytes) fit a task with ease.
"""

from __future__ import annotations

import sys

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilspark.session import store
from veilspark.sources.versioned import SEQUENCE, VersionedTable

# Task functions of this module travel inside the plan: workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

BUCKETS = 256
BITS, HASHES = 24, 16       # of a filter for each id: about 1 in 100,000 foreign ids looks known

_IDS = f"event_id string, event_day date, bucket int, {SEQUENCE} bigint"
_FILTERS = "bucket int, event_day date, bits binary"


def positions(first: np.ndarray, second: np.ndarray, size: int) -> np.ndarray:
    """The bits of each id in a filter of ``size`` bits: one row for each hash."""
    step = second | np.uint64(1)
    return (first[None, :] + np.arange(HASHES, dtype=np.uint64)[:, None] * step[None, :]) % np.uint64(size)


def build_filter(first: np.ndarray, second: np.ndarray) -> bytes:
    size = -(-len(first) * BITS // 64) * 64
    bits = np.zeros(size // 8, dtype=np.uint8)
    at = positions(first, second, size).ravel()
    np.bitwise_or.at(bits, (at >> np.uint64(3)).astype(np.int64), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))
    return bits.tobytes()


def may_hold(bits: bytes, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    table = np.frombuffer(bits, dtype=np.uint8)
    at = positions(first, second, 8 * len(table))
    return ((table[(at >> np.uint64(3)).astype(np.int64)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=0)


def _filters(batches):
    """A filter for each (bucket, day) of a task's ids."""
    parts = list(batches)
    if not parts:
        return
    bucket, day, h, g = (np.concatenate([b.column(i).cast(pa.int32() if i < 2 else pa.int64()).to_numpy() for b in parts]) for i in range(4))
    h, g = h.view(np.uint64), g.view(np.uint64)
    order = np.lexsort((day, bucket))
    bucket, day, h, g = bucket[order], day[order], h[order], g[order]
    ends = np.append(np.flatnonzero((np.diff(bucket) != 0) | (np.diff(day) != 0)) + 1, len(bucket)) if len(bucket) else np.zeros(0, np.int64)
    for start, end in zip(np.append(0, ends[:-1]), ends, strict=False):
        yield pa.RecordBatch.from_arrays([pa.array([bucket[start]], pa.int32()), pa.array([day[start]], pa.int32()).cast(pa.date32()),
                                          pa.array([build_filter(h[start:end], g[start:end])], pa.binary())], ["bucket", "event_day", "bits"])


def _test(ids: pa.Table, filters: pa.Table) -> pa.Table:
    h, g = (ids[c].to_numpy().view(np.uint64) for c in ("h", "g"))
    names, found = ids["event_id"].combine_chunks(), []
    for row in range(filters.num_rows):
        at = np.flatnonzero(may_hold(filters["bits"][row].as_py(), h, g))
        if len(at):
            found.append(pa.table({"event_id": names.take(pa.array(at)), "event_day": pa.repeat(filters["event_day"][row], len(at)),
                                   "bucket": pa.repeat(filters["bucket"][row], len(at))}))
    shape = pa.schema([("event_id", pa.string()), ("event_day", pa.date32()), ("bucket", pa.int32())])
    return pa.concat_tables(found).cast(shape) if found else shape.empty_table()


class IdStore:
    """``known`` and ``append`` take rows with ``event_id`` and ``timestamp``; null ids are never known."""

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS) -> None:
        self.buckets = buckets
        self.table = VersionedTable(spark, path, write=self._write, parts=("ids", "filters"), ddl=_IDS)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64("event_id"), F.lit(self.buckets)).cast("int")

    def _write(self, ids: DataFrame, name: str) -> None:
        rows = ids.withColumn("bucket", self._bucket()) if "bucket" not in ids.columns else ids
        (rows.select("event_id", "event_day", SEQUENCE, "bucket").repartition("bucket").sortWithinPartitions("bucket", "event_day")
         .write.partitionBy("bucket").parquet(self.table.folder(name)))
        written = ids.sparkSession.read.schema(_IDS).parquet(self.table.folder(name))
        (written.select("bucket", F.col("event_day").alias("day"), *self._hashes()).mapInArrow(_filters, _FILTERS)
         .write.parquet(self.table.folder(name, "filters")))

    @staticmethod
    def _hashes() -> list[Column]:
        return [F.xxhash64(F.lit(1), "event_id").alias("h"), F.xxhash64(F.lit(2), "event_id").alias("g")]

    def append(self, rows: DataFrame, source: str, epoch: int) -> None:
        self.table.append(rows.select("event_id", F.to_date("timestamp").alias("event_day")), source, epoch)
        self.table.maintain()

    def candidates(self, rows: DataFrame, without: tuple[str, int] | None = None, days: tuple | None = None) -> DataFrame | None:
        """(event_id, event_day, bucket) where a filter says that the id may be stored."""
        filters = self.table.read(without=without, part="filters", ddl=_FILTERS)
        if filters is None:
            return None
        if days is not None:
            filters = filters.where(F.col("event_day").between(*days))
        ids = rows.select("event_id").where("event_id IS NOT NULL").distinct().withColumn("bucket", self._bucket())
        ids = ids.select("event_id", "bucket", *self._hashes())
        found = ids.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(_test, "event_id string, event_day date, bucket int")
        return store(found, "id-candidates")

    def known(self, rows: DataFrame, without: tuple[str, int] | None = None, days: tuple | None = None) -> DataFrame:
        """Distinct ids of ``rows`` that are stored; with ``days``, on those days (first, last).  Reads only the buckets
        and days that may hold one; their names, at most buckets times days, go through the driver into the scan's filters."""
        spark = self.table.spark
        maybe = self.candidates(rows, without, days)
        if maybe is None:
            return spark.createDataFrame([], "event_id string")
        open_ = maybe.select("bucket", "event_day").distinct().collect()
        if not open_:
            return spark.createDataFrame([], "event_id string")
        stored = self.table.read(without=without, part="ids", ddl=_IDS)
        stored = stored.where(F.col("bucket").isin(sorted({r["bucket"] for r in open_}))
                              & F.col("event_day").isin(sorted({r["event_day"] for r in open_})))
        return stored.join(maybe, ["event_id", "event_day", "bucket"], "left_semi").select("event_id").distinct()
