"""Failed-authentication limiter over a log of (ip, ts, failed)."""

from __future__ import annotations

import sys
from collections.abc import Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilspark.session import store

# Task functions of this module travel inside the plan: workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

# Failures that block an address, and the window they must fall in.
LIMIT, WINDOW_SECONDS = 10, 60
_OUT = "ip string, window_start timestamp, blocked_at timestamp"


def step(state: tuple[int, int] | None, ts: int, failures: int, success: bool, limit: int, window: int):
    """Next (window_start, failures) and whether this step crossed the limit.

    A failure opens a window; one that comes more than ``window`` after the
    opening starts a new one.  Success forgets the address.  Microseconds.
    """
    crossed = False
    if failures:
        if state is None or ts - state[0] > window:
            state = (ts, 0)
        crossed = state[1] < limit <= state[1] + failures
        state = (state[0], state[1] + failures)
    return (None if success else state), (state[0] if crossed else None)


def _chains(log: DataFrame, window_seconds: int) -> DataFrame:
    """Label rows with the chain they belong to.

    State never crosses a success or a silence longer than the window, so such
    points cut an address's history into independent chains.  They are found
    per (address, hour); what an hour inherits comes from a table with one row
    per address and hour, so no task holds the history of a busy address.
    """
    cut_up = log.withColumn("hour", F.date_trunc("hour", "ts"))
    ends = cut_up.groupBy("ip", "hour").agg(F.max("ts").alias("last"), F.max_by("success", "ts").alias("last_success"))
    by_ip = W.partitionBy("ip").orderBy("hour")
    before = ends.select("ip", "hour", F.lag("last").over(by_ip).alias("hour_prev"),
                         F.lag("last_success").over(by_ip).alias("hour_prev_success"))
    in_hour = W.partitionBy("ip", "hour").orderBy("ts")
    rows = cut_up.withColumns({"prev": F.lag("ts").over(in_hour), "prev_success": F.lag("success").over(in_hour)})
    rows = rows.join(before, ["ip", "hour"])
    prev, prev_success = F.coalesce("prev", "hour_prev"), F.coalesce("prev_success", "hour_prev_success")
    silent = F.unix_micros("ts") - F.unix_micros(prev) > window_seconds * 1_000_000
    rows = rows.withColumn("cut", F.when(prev.isNull() | silent | prev_success, F.col("ts")))
    local = F.max("cut").over(in_hour.rowsBetween(W.unboundedPreceding, W.currentRow))
    carried = rows.groupBy("ip", "hour").agg(F.max("cut").alias("hour_cut")).select(
        "ip", "hour", F.max("hour_cut").over(by_ip.rowsBetween(W.unboundedPreceding, -1)).alias("inherited"))
    return rows.withColumn("local", local).join(carried, ["ip", "hour"]).select(
        "ip", F.coalesce("local", "inherited").alias("chain"), "ts", "failures", "success")


def auth_blocks(log: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS) -> DataFrame:
    """Every window in which an address reached the limit.

    Simultaneous attempts are counted before anything moves; chains are then
    folded in time order with constant memory.
    """
    counted = log.groupBy("ip", "ts").agg(
        F.count_if(F.col("failed")).alias("failures"), F.max(~F.col("failed")).alias("success"))
    # Only addresses, and then chains, with enough failures can reach the limit; the others never leave the engine.
    likely = counted.groupBy("ip").agg(F.sum("failures").alias("n")).where(F.col("n") >= limit).select("ip")
    chains = store(_chains(counted.join(likely, "ip", "left_semi"), window_seconds), "chains")      # read twice: to count and to fold
    enough = chains.groupBy("ip", "chain").agg(F.sum("failures").alias("n")).where(F.col("n") >= limit).select("ip", "chain")
    chains = chains.join(enough, ["ip", "chain"], "left_semi")
    span = window_seconds * 1_000_000

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain, state = None, None
        for batch in batches:
            out = []
            for ip, start, ts, failures, success in batch.itertuples(index=False):
                if (ip, start) != chain:
                    chain, state = (ip, start), None
                state, crossed = step(state, ts, failures, success, limit, span)
                if crossed is not None:
                    out.append((ip, pd.Timestamp(crossed, unit="us"), pd.Timestamp(ts, unit="us")))
            yield pd.DataFrame(out, columns=["ip", "window_start", "blocked_at"])

    micros: Column = F.unix_micros("ts")
    ordered = (chains.select("ip", F.unix_micros("chain").alias("chain"), micros.alias("ts"), "failures", "success")
               .repartition("ip", "chain").sortWithinPartitions("ip", "chain", "ts"))
    return ordered.mapInPandas(fold, _OUT)
