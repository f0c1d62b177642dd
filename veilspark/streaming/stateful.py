"""Stateful jobs with timers: the breach clock and the ordered auth limiter.

Both keep their state in RocksDB, so it is bounded by disk and not by memory,
and drop it by event time.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from veilspark import schema
from veilspark.operators.compliance import BREACH_TYPES, BREACH_WINDOW
from veilspark.operators.events import latest_by
from veilspark.operators.limiter import LIMIT, WINDOW_SECONDS, step
from veilspark.streaming.jobs import Sink

# Task functions of this module travel inside the plan: workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(sys.modules["veilspark.operators.limiter"])

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
SALTS = 8           # parts of an organisation's breach state
SLOTS = 60          # of the limiter's buffer in a window; a slot is a second at least
LIMITER_BUCKETS = 256   # of addresses that share the limiter's state


@contextmanager
def rocksdb(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


# ------------------------------------------------------------------ breach clock

class BreachState(StatefulProcessor):
    """Critical findings by second of one part of an organisation, kept hour by hour until a timer drops the hour."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.hours = handle.getMapState("hours", "hour bigint", "second array<bigint>, critical array<bigint>, first array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            # Sums of a batch first: a second that occurs often costs one entry.
            sums = batch.groupby("second").agg(critical=("critical", "sum"), first=("micros", "min")).reset_index()
            for hour, part in sums.groupby(sums["second"] // 3600):
                name = (int(hour),)
                old = self.hours.getValue(name) if self.hours.containsKey(name) else None
                if old is None:
                    self.handle.registerTimer((int(hour) + 1) * 3_600_000)
                else:
                    part = pd.concat([part, pd.DataFrame({"second": list(old[0]), "critical": list(old[1]), "first": list(old[2])})])
                    part = part.groupby("second").agg(critical=("critical", "sum"), first=("first", "min")).reset_index()
                self.hours.updateValue(name, tuple([int(x) for x in part[c]] for c in ("second", "critical", "first")))
                touched = part[part["second"].isin(sums["second"])]
                yield pd.DataFrame({"org_id": key[0], "salt": key[1], "second": pd.to_datetime(touched["second"], unit="s"),
                                    "critical": touched["critical"], "first": pd.to_datetime(touched["first"], unit="us")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        name = (expiredTimerInfo.getExpiryTimeInMs() // 3_600_000 - 1,)
        if self.hours.containsKey(name):
            self.hours.removeKey(name)
        return iter([])

    def close(self) -> None:
        pass


def breach_state_stream(ev: DataFrame, path: str, checkpoint: str, every: str | None = None, time_range: str = "30d",
                        salts: int = SALTS, id_col: str = "event_id", versioned: bool = True) -> StreamingQuery:
    """Critical findings per organisation and second, for :func:`veilspark.streaming.jobs.breach_clocks`.

    State and sink are bounded: an hour leaves the state by a timer, and the sink when its folders are merged, once it lies
    the look-back of 72 hours plus ``time_range`` behind the newest event, where no clock looks any more. An organisation is
    dealt over ``salts`` parts by its events' ids, so the largest one is not one task's work. Null ids are one more value.
    """
    horizon = f"{BREACH_WINDOW} {schema.RANGES[time_range]}"
    critical = F.filter("findings", lambda f: F.lower(f["type"]).isin(BREACH_TYPES))
    weight = F.aggregate("critical", F.lit(0).cast("bigint"), lambda acc, f: acc + f["count"])
    rows = ev.select("timestamp", "org_id", critical.alias("critical"), F.pmod(F.xxhash64(id_col), F.lit(salts)).cast("int").alias("salt"))
    rows = rows.where("size(critical) > 0").withWatermark("timestamp", horizon).select(
        "timestamp", "org_id", "salt", F.unix_seconds("timestamp").alias("second"), F.unix_micros("timestamp").alias("micros"),
        weight.alias("critical"))

    def handle(batch: DataFrame, epoch: int) -> None:
        sink = Sink(batch.sparkSession, path, checkpoint, versioned)
        if sink.table is not None:
            sink.table.fold = newest_seconds(horizon)
        sink.put(latest_in_batch(batch), epoch)

    with rocksdb(ev.sparkSession):
        counted = rows.groupBy("org_id", "salt").transformWithStateInPandas(
            BreachState(), "org_id string, salt int, second timestamp, critical bigint, first timestamp", "Update", "eventTime")
        writer = counted.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handle)
        return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def newest_seconds(horizon: str):
    """Folds versions of the table: the last sum of each second, without what lies the horizon behind the newest."""
    def fold(df: DataFrame) -> DataFrame:
        kept = latest_by(df, ["second", "org_id", "salt"], F.col("epoch"))
        last = F.broadcast(df.agg(F.max("second").alias("last")))       # one row
        return kept.join(last, F.col("second") >= F.col("last") - F.expr(f"INTERVAL {horizon}")).drop("last")
    return fold


def latest_in_batch(batch: DataFrame) -> DataFrame:
    """Of the rows that a part emits for a second in one batch the last one: its sum is the largest."""
    return batch.groupBy("org_id", "salt", "second").agg(F.max("critical").alias("critical"), F.min("first").alias("first"))


# ------------------------------------------------------------------ auth limiter

class LimiterState(StatefulProcessor):
    """Attempts of a bucket of addresses wait in slots until the watermark has passed; then they are folded in order of time.

    A slot holds counts by address and microsecond, so an address with very many attempts costs its distinct times, a slot at
    a time. State is asked for once a slot and not once an address, and one timer is pending at a time.
    """

    def __init__(self, limit: int, span: int) -> None:
        self.limit, self.span = limit, span
        self.slot_ms = max(1000, span // 1000 // SLOTS)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.slots = handle.getMapState("slots", "slot bigint", "ip array<string>, at array<bigint>, failures array<bigint>, success array<boolean>")
        self.windows = handle.getValueState("windows", "ip array<string>, start array<bigint>, failures array<bigint>")
        self.due = handle.getValueState("due", "at bigint")

    def _wake(self, at: int) -> None:
        """One pending timer, the earliest one that was asked for."""
        pending = self.due.get() if self.due.exists() else None
        if pending is not None:
            if pending[0] <= at:
                return
            self.handle.deleteTimer(pending[0])
        self.handle.registerTimer(at)
        self.due.update((at,))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        for batch in rows:
            batch = batch.assign(failures=batch["failed"].astype("int64"), success=~batch["failed"].astype(bool))
            counts = _counted(batch)
            slot_of = (counts["at"] // (self.slot_ms * 1000)).to_numpy()
            for slot, part in counts.groupby(slot_of):
                name = (int(slot),)
                if self.slots.containsKey(name):
                    old = dict(zip(("ip", "at", "failures", "success"), map(list, self.slots.getValue(name))))
                    part = _counted(pd.concat([part, pd.DataFrame(old)]))
                self.slots.updateValue(name, tuple(part[c].tolist() for c in ("ip", "at", "failures", "success")))
            if len(slot_of):
                self._wake((int(slot_of.min()) + 1) * self.slot_ms)
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        upto = timerValues.getCurrentWatermarkInMs() // self.slot_ms        # the timer takes all slots that are over
        self.due.clear()
        waiting = sorted(k[0] for k in self.slots.keys())
        states = {ip: (start, n) for ip, start, n in zip(*self.windows.get())} if self.windows.exists() else {}
        rows = []
        for slot in waiting:
            if slot >= upto:
                break
            ips, at, failures, success = self.slots.getValue((slot,))
            for i in np.argsort(np.array(at, dtype=np.int64), kind="stable"):
                states[ips[i]], crossed = step(states.get(ips[i]), int(at[i]), int(failures[i]), bool(success[i]), self.limit, self.span)
                if crossed is not None:
                    rows.append((ips[i], pd.Timestamp(crossed, unit="us"), pd.Timestamp(int(at[i]), unit="us")))
            self.slots.removeKey((slot,))
        # Windows that no later attempt can fall into are forgotten, by a timer of their own if no slot waits.
        states = {ip: s for ip, s in states.items() if s is not None and upto * self.slot_ms * 1000 <= s[0] + self.span}
        if states:
            self.windows.update((list(states), [int(s[0]) for s in states.values()], [int(s[1]) for s in states.values()]))
        else:
            self.windows.clear()
        left = [slot for slot in waiting if slot >= upto]
        if left:
            self._wake((left[0] + 1) * self.slot_ms)
        elif states:
            self._wake((min(s[0] for s in states.values()) + self.span) // 1000 + 2 * self.slot_ms)
        if rows:
            yield pd.DataFrame(rows, columns=["ip", "window_start", "blocked_at"])

    def close(self) -> None:
        pass


def _counted(attempts: pd.DataFrame) -> pd.DataFrame:
    """Failures of each address and microsecond, and whether one attempt succeeded; a null address is one more."""
    return attempts.groupby(["ip", "at"], sort=False, dropna=False).agg(failures=("failures", "sum"), success=("success", "max")).reset_index().astype(
        {"ip": object}).pipe(lambda f: f.assign(ip=f["ip"].where(f["ip"].notna(), None)))


def auth_blocks_ordered(log: DataFrame, limit: int = LIMIT, window_seconds: int = WINDOW_SECONDS,
                        lateness: str = "1 minute", buckets: int = LIMITER_BUCKETS) -> DataFrame:
    """Streaming twin of :func:`veilspark.operators.limiter.auth_blocks` for attempts that come out of order.

    Attempts are judged in order of time once the watermark has passed them, so the result is that of the batch operator,
    whatever the batches; later ones are dropped. Addresses share state by ``buckets``: as many as there are tasks at least, and
    never changed for one checkpoint. Start the query inside :func:`rocksdb`.
    """
    bucket = F.pmod(F.xxhash64("ip"), F.lit(buckets)).cast("int").alias("bucket")
    keyed = log.withWatermark("ts", lateness).select(bucket, "ip", "ts", F.unix_micros("ts").alias("at"), "failed")
    return keyed.groupBy("bucket").transformWithStateInPandas(
        LimiterState(limit, window_seconds * 1_000_000), "ip string, window_start timestamp, blocked_at timestamp", "Append", "eventTime")
