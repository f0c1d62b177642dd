"""The daily rollup as a continuous aggregate.

Ingest logs the days that a batch has changed.  A refresh computes those days
anew from the event table, which is partitioned by day, and overwrites their
partitions of the rollup; all other days stay as they are, however old the
table is.  Only whole days within the refresh window count; the log keeps the
others until they fall into it, or for good if they are older.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.operators.events import latest_by
from veilspark.operators.stats import daily_rollup
from veilspark.sources.versioned import VersionedTable, read_table

# How far back and up to when a refresh goes.
START, END = "30 days", "1 hour"

_SHAPE = "org_id string, llm string, action string, n bigint, total_prompt_length bigint, day date"


def pending(spark: SparkSession, invalidated: str, rollup: str, now=None, start: str = START, end: str = END) -> DataFrame:
    """(day, upto): days changed since they were last refreshed, with the number of their last change; with ``now``, those
    that lie within the window as a whole."""
    log = read_table(spark, invalidated)
    if log is None:
        return spark.createDataFrame([], "day date, upto bigint")
    changed = log.groupBy("day").agg(F.max("epoch").alias("upto"))
    done = read_table(spark, rollup + "_done")
    if done is not None:
        newest = done.groupBy("day").agg(F.max("upto").alias("seen"))
        changed = changed.join(newest, "day", "left").where(F.col("seen").isNull() | (F.col("upto") > F.col("seen"))).drop("seen")
    if now is None:
        return changed
    at, begins = F.lit(now).cast("timestamp"), F.col("day").cast("timestamp")
    return changed.where((begins >= at - F.expr(f"INTERVAL {start}")) & (begins + F.expr("INTERVAL 1 DAY") <= at - F.expr(f"INTERVAL {end}")))


def refresh(spark: SparkSession, events: str, invalidated: str, rollup: str, now, start: str = START, end: str = END) -> list[date]:
    """Brings the rollup up to date and returns the days it has computed anew, which the window bounds.

    The log is read before the events, so an event that comes in between is counted now and once more by the next refresh.
    A refresh that breaks off is repeated: days are marked when they have been written.
    """
    due = pending(spark, invalidated, rollup, now, start, end).collect()
    if not due:
        return []
    days = sorted(r["day"] for r in due)
    rows = daily_rollup(read_table(spark, events).where(F.col("event_date").isin(days)))
    rows = rows.select("org_id", "llm", "action", "n", "total_prompt_length", F.to_date("day").alias("day"))
    (rows.repartition("day").sortWithinPartitions("day", "org_id")
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(rollup))
    done = VersionedTable(spark, rollup + "_done", fold=lambda df: latest_by(df, ["day"], F.col("upto")))
    run = done.current()[0] + 1
    done.append(spark.createDataFrame([(r["day"], r["upto"]) for r in due], "day date, upto bigint"), "refresh", run)
    done.maintain()
    return days


def rolled_up(spark: SparkSession, rollup: str) -> DataFrame:
    """The rollup as of its last refresh."""
    return spark.read.schema(_SHAPE).parquet(rollup)


def current(spark: SparkSession, events: str, invalidated: str, rollup: str) -> DataFrame:
    """The rollup with days that still wait for a refresh, or lie outside its window, counted on the spot."""
    waiting = [r["day"] for r in pending(spark, invalidated, rollup).collect()]       # as many as days that changed
    live = daily_rollup(read_table(spark, events).where(F.col("event_date").isin(waiting)))
    live = live.select("org_id", "llm", "action", "n", "total_prompt_length", F.to_date("day").alias("day"))
    if read_table(spark, rollup + "_done") is None:
        return live
    return rolled_up(spark, rollup).where(~F.col("day").isin(waiting)).unionByName(live)
