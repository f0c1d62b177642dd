"""Connected components of a large graph of links."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veilspark.session import store

PART = 1 << 17        # links that a task connects by itself


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a part as (id, least id it is connected with in this part)."""
    table = pa.Table.from_batches(list(batches), schema=pa.schema([("u", pa.int64()), ("v", pa.int64())]))
    ids, code = np.unique(np.concatenate([table["u"].to_numpy(), table["v"].to_numpy()]), return_inverse=True)
    a, b = code[:len(table)], code[len(table):]
    root = np.arange(len(ids))
    while True:
        low, high = np.minimum(root[a], root[b]), np.maximum(root[a], root[b])
        if (low == high).all():
            break
        np.minimum.at(root, high, low)
        while True:
            further = root[root]
            if (further == root).all():
                break
            root = further
    below = np.flatnonzero(root != np.arange(len(ids)))
    yield pa.RecordBatch.from_arrays([pa.array(ids[below]), pa.array(ids[root[below]])], names=["u", "v"])


def _toward_least(links: DataFrame, whole: bool) -> DataFrame:
    """Links (u, v) with u > v moved onto the least neighbour of u: of its larger ones (whole), or of its smaller ones."""
    if whole:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        least = store(least, "least")           # so that the join is of plain shuffles, which Spark can split at a hub
        moved = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = store(links.groupBy("u").agg(F.min("v").alias("m")), "least")
        moved = (links.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
                 .union(least.select("u", F.col("m").alias("v"))))
    return moved.where("u != v").distinct()


def components(links: DataFrame) -> DataFrame:
    """(id, component): for every id in links (u, v), the smallest id it is connected with.

    Links are dealt into parts of ``PART``, and each is first reduced to its own
    trees. If there is more than one part, alternating large-star and small-star
    steps follow: each moves links onto least neighbours until all of them point at
    the least id of their component. The number of steps grows with the logarithm of
    the graph's size; nothing but a count comes to the driver.
    """
    now = store(links.where("u != v").select(F.col("u").cast("long"), F.col("v").cast("long")), "links")
    parts = max(1, -(-now.count() // PART))
    now = store(now.repartition(parts).mapInArrow(_forest, "u long, v long"), "links")
    while parts > 1:
        # Done when each id has one link upwards at most, and none that is pointed at has any.
        ends = now.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(
            now.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("down")))
        chained = ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("down").alias("down")).where("up > 1 OR (up = 1 AND down = 1)")
        if chained.isEmpty():
            break
        large = store(_toward_least(now, True), "links")
        now = store(_toward_least(large, False), "links")
    return now.select(F.col("u").alias("id"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
