"""Structured Streaming jobs.

Sinks write one folder per micro-batch (``epoch=N``, overwritten on a retry),
so a batch that is run twice after a failure leaves the same data.  With
``versioned=True`` they are versioned tables instead: small batches are merged as
the stream goes on, and readers see one version (:mod:`veilspark.sources.versioned`).
"""

from __future__ import annotations

import os
import sys
from collections.abc import Iterator
from datetime import timedelta

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from veilspark import schema
from veilspark.operators import limiter
from veilspark.operators.compliance import BREACH_THRESHOLD, BREACH_TYPES, BREACH_WINDOW
from veilspark.operators.devices import upsert_devices
from veilspark.operators.events import (
    keep_newest, latest_by, latest_per_device, split_new, to_stored,
)
from veilspark.operators.scan import evaluate
from veilspark.operators.vault import anonymize, build_vault, extend_vault, plan, values_to_replace
from veilspark.sources.idstore import BUCKETS, IdStore
from veilspark.sources.readers import parse_events, split_valid
from veilspark.sources.versioned import VersionedTable, read_table
from veilspark.sources.writers import by_day, write_events

# Task functions of this module travel inside the plan: workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

LATENESS = "30 days"


def _empty(spark: SparkSession, shape: dict[str, str], **more: str) -> DataFrame:
    """No rows; the planner knows it and leaves out joins with them."""
    return spark.range(0).select(*[F.lit(None).cast(kind).alias(name) for name, kind in {**shape, **more}.items()]).limit(0)


def read_or_empty(spark: SparkSession, path: str, shape: dict[str, str], **more: str) -> DataFrame:
    found = read_table(spark, path)
    return _empty(spark, shape, **more) if found is None else found


def _start(stream: DataFrame, checkpoint: str, handle, mode: str = "append", every: str | None = None) -> StreamingQuery:
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(handle)
    return (writer.trigger(processingTime=every) if every else writer.trigger(availableNow=True)).start()


def _write_epoch(df: DataFrame, path: str, epoch: int, partition_by: list[str] | None = None) -> None:
    df.write.mode("overwrite").partitionBy(*(partition_by or [])).parquet(os.path.join(path, f"epoch={epoch}"))


class Sink:
    """Where the batches of a query go: ``epoch=N`` folders, or a versioned table."""

    def __init__(self, spark: SparkSession, path: str, checkpoint: str, versioned: bool, keys: tuple[str, ...] = (),
                 partition_by: list[str] | None = None) -> None:
        self.path, self.checkpoint, self.partition_by, self.spark = path, checkpoint, partition_by, spark
        fold = (lambda df: latest_by(df, list(keys), F.col("epoch"))) if keys else None
        self.table = VersionedTable(spark, path, partition_by, fold) if versioned else None

    def put(self, df: DataFrame, epoch: int) -> None:
        """Writes a batch; in place of an earlier attempt at it."""
        if self.table is None:
            _write_epoch(df, self.path, epoch, self.partition_by)
        else:
            self.table.append(df, self.checkpoint, epoch)
            self.table.maintain()

    def before(self, epoch: int, shape: dict[str, str]) -> DataFrame:
        """What earlier batches have put."""
        if self.table is None:
            return read_or_empty(self.spark, self.path, shape, epoch="bigint").where(F.col("epoch") < epoch)
        found = self.table.read(without=(self.checkpoint, epoch))
        return _empty(self.spark, shape, epoch="bigint") if found is None else found


def ingest_stream(lines: DataFrame, paths: dict[str, str], checkpoint: str, ingested_at=None,
                  dedup_within: str | None = None, every: str | None = None, resent_within_days: int | None = None,
                  versioned: bool = False, buckets: int = BUCKETS) -> StreamingQuery:
    """Idempotent ingest of event JSON (``value`` column).

    ``paths``: ``events`` (day-partitioned table), ``rejected``, and optionally
    ``devices`` (changed rows per epoch, read with :func:`latest_rows`) and
    ``feed`` (accepted events per organisation).  Ids are checked against everything stored;
    with ``resent_within_days``, against the days of the batch and so many before and after
    them, which prunes the table's partitions: an event keeps its time when it is sent again.
    ``dedup_within`` adds stream-side de-duplication, which drops events later
    than that bound.  ``versioned`` tables also keep the ids of all events in ``buckets`` with Bloom filters (in ``paths["ids"]``,
    by default beside the events), so that a batch opens only what may hold its ids instead of the whole
    table; and with ``paths["invalidated"]`` the days that a batch has changed are logged for
    :func:`veilspark.streaming.rollup.refresh`.
    """
    source = lines
    if dedup_within:
        keyed = lines.withColumns({
            "__ts": F.get_json_object("value", "$.timestamp").cast("timestamp"),
            "__id": F.get_json_object("value", "$.eventId")})
        source = keyed.withWatermark("__ts", dedup_within).dropDuplicatesWithinWatermark(["__id"]).drop("__ts", "__id")

    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        at = ingested_at or pd.Timestamp.now(tz="UTC").to_pydatetime()

        def sink(name: str, keys: tuple[str, ...] = (), partition_by: list[str] | None = None) -> Sink:
            return Sink(spark, paths[name], checkpoint, versioned, keys, partition_by)

        def kept(df: DataFrame, what: str) -> DataFrame:
            """Computed once, then read back per use; the next batch overwrites it."""
            path = f"{paths['events']}_{what}"
            df.write.mode("overwrite").parquet(path)
            return spark.read.schema(df.schema).parquet(path)

        # Of valid rows the text is not read again.
        parsed = parse_events(batch).withColumns({"value": F.when(F.size("errors") > 0, F.col("value")), "position": F.monotonically_increasing_id()})
        valid, rejected = split_valid(kept(parsed, "staged"))
        sink("rejected").put(rejected, epoch)
        tag = f"{checkpoint}#{epoch}"
        staged = to_stored(valid, at, "position", ingest_id=tag)
        # Which rows are new is found from ids, times and positions alone; the rows themselves are joined with the
        # positions only if some of them go.
        keys = staged.groupBy("event_id", "timestamp").agg(F.max("position").alias("position"))          # the one written last
        if versioned:
            days = None
            if resent_within_days is not None:
                first, last = staged.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()      # two dates
                days = None if first is None else (first - timedelta(resent_within_days), last + timedelta(resent_within_days))
            ids = IdStore(spark, paths.get("ids", paths["events"] + "_ids"), buckets)
            fresh = keys.join(ids.known(keys, without=(checkpoint, epoch), days=days), "event_id", "left_anti")
        else:
            fresh = unstored(spark, staged, keys, tag)
        positions = kept(fresh.select("position"), "positions")
        if positions.count() == staged.count():
            new = staged.drop("position")
        else:
            new = kept(staged.join(positions, "position", "left_semi").drop("position"), "new")
        if "feed" in paths:
            sink("feed", partition_by=["org_id"]).put(new, epoch)
        if "devices" in paths:
            # Only the devices of this batch are read, merged and written.
            latest = kept(latest_per_device(staged.select("device_id", "org_id", "user_hint", "extension_version", "timestamp", "position")), "latest")
            devices = sink("devices", ("id",))
            touched = devices.before(epoch, schema.DEVICES).join(latest.select(F.col("device_id").alias("id")), "id", "left_semi")
            known_devices = latest_by(touched, ["id"], F.col("epoch")).drop("epoch")
            devices.put(upsert_devices(known_devices, latest, at), epoch)
        if versioned:
            sink("events", partition_by=["event_date"]).put(by_day(new), epoch)
            ids.append(new, checkpoint, epoch)
            if "invalidated" in paths:
                sink("invalidated").put(new.select(F.to_date("timestamp").alias("day")).distinct(), epoch)
        else:
            # What an earlier attempt has written, of this batch's days only: seldom anything, and then known to be small.
            done = kept(days_of(spark, staged, 0).where(F.col("ingest_id") == tag).select("event_id", "timestamp"), "done")
            write_events(new.join(done, ["event_id", "timestamp"], "left_anti"), paths["events"])

    # Without versions the table itself is read for ids.
    def mine(tag: str) -> Column:
        return F.coalesce("ingest_id", F.lit("")) == tag

    def days_of(spark: SparkSession, staged: DataFrame, more: int | None) -> DataFrame:
        stored = read_or_empty(spark, paths["events"], schema.EVENTS)
        if more is None or "event_date" not in stored.columns:
            return stored
        first, last = staged.agg(F.min(F.to_date("timestamp")), F.max(F.to_date("timestamp"))).first()      # two dates
        return stored if first is None else stored.where(F.col("event_date").between(first - timedelta(more), last + timedelta(more)))

    def unstored(spark: SparkSession, staged: DataFrame, keys: DataFrame, tag: str) -> DataFrame:
        # Rows an earlier attempt of this very batch appended do not count as stored.
        stored = days_of(spark, staged, resent_within_days)
        return split_new(keys, stored.where(~mine(tag)))[0]

    return _start(source, checkpoint, handle, every=every)


def live_feed(spark: SparkSession, path: str, org: str, newest: int = 200) -> DataFrame:
    """Newest accepted events of one organisation (reads that partition only)."""
    feed = read_table(spark, path).where(F.col("org_id") == org)
    return keep_newest(feed, newest, "timestamp", "event_id")


def _upserted(stream: DataFrame, path: str, checkpoint: str, every: str | None, versioned: bool, *keys: str) -> StreamingQuery:
    def handle(batch: DataFrame, epoch: int) -> None:
        Sink(batch.sparkSession, path, checkpoint, versioned, keys).put(batch, epoch)

    return _start(stream, checkpoint, handle, "update", every)


def latest_rows(spark: SparkSession, path: str, *keys: str) -> DataFrame:
    """Current state of an update-mode sink: the last version of every key."""
    table = read_table(spark, path)
    return latest_by(table, list(keys), F.col("epoch")).drop("epoch")


def daily_rollup_stream(ev: DataFrame, path: str, checkpoint: str, every: str | None = None, versioned: bool = False) -> StreamingQuery:
    """Day × organisation × service × action, kept current for 30 days back."""
    rolled = (ev.withWatermark("timestamp", LATENESS)
              .groupBy(F.window("timestamp", "1 day"), "org_id", "llm", "action")
              .agg(F.count("*").alias("n"), F.sum("prompt_length").alias("total_prompt_length"))
              .select(F.col("window.start").alias("day"), "org_id", "llm", "action", "n", "total_prompt_length"))
    return _upserted(rolled, path, checkpoint, every, versioned, "day", "org_id", "llm", "action")


def _bounded(stream: DataFrame, ts: str, lateness: str | None) -> DataFrame:
    return stream if lateness is None else stream.withWatermark(ts, lateness)


def counters_stream(detections: DataFrame, path: str, checkpoint: str, every: str | None = None,
                    lateness: str | None = None, versioned: bool = False) -> StreamingQuery:
    """Detections per day and action.  With a ``lateness``, later rows are dropped and old days leave the state;
    without, a count is kept for every day ever seen."""
    counted = (_bounded(detections, "ts", lateness).groupBy(F.window("ts", "1 day"), "action")
               .agg(F.count("*").alias("n")).select(F.col("window.start").alias("day"), "action", "n"))
    return _upserted(counted, path, checkpoint, every, versioned, "day", "action")


def breach_stream(ev: DataFrame, path: str, checkpoint: str, every: str | None = None,
                  lateness: str | None = None, versioned: bool = False) -> StreamingQuery:
    """Critical findings per organisation and second.

    Kept as a partial aggregate rather than per-organisation state, so that the
    largest organisation is summed by every task instead of by one.  Seconds are
    fine enough that a look-back never cuts one.  With a ``lateness``, later rows are dropped; without,
    a count is kept for every second ever seen (:mod:`veilspark.streaming.breach` bounds it).
    """
    critical = F.filter("findings", lambda f: F.lower(f["type"]).isin(BREACH_TYPES))
    rows = ev.select("timestamp", "org_id", critical.alias("critical")).where(F.size("critical") > 0)
    weight = F.aggregate("critical", F.lit(0).cast("bigint"), lambda acc, f: acc + f["count"])
    counted = (_bounded(rows, "timestamp", lateness).groupBy(F.window("timestamp", "1 second"), "org_id")
               .agg(F.sum(weight).alias("critical"), F.min("timestamp").alias("first"))
               .select(F.col("window.start").alias("second"), "org_id", "critical", "first"))
    return _upserted(counted, path, checkpoint, every, versioned, "second", "org_id")


def breach_clocks(counted: DataFrame, now, threshold: int = BREACH_THRESHOLD, time_range: str = "30d") -> DataFrame:
    """Per organisation: is the clock running at ``now`` (a whole second), and its deadline.

    Critical findings count from ``now - time_range`` on; the clock starts at
    the first one of the last 72 hours.
    """
    if pd.Timestamp(now).microsecond:
        raise ValueError("now must be a whole second")
    at = F.lit(now).cast("timestamp")

    def within(span: str) -> Column:
        return F.col("second") >= at - F.expr(f"INTERVAL {span}")

    grouped = counted.groupBy("org_id").agg(
        F.coalesce(F.sum(F.when(within(schema.RANGES[time_range]), F.col("critical"))), F.lit(0).cast("bigint")).alias("critical"),
        F.min(F.when(within(BREACH_WINDOW), F.col("first"))).alias("first"))
    active = (F.col("critical") >= threshold) & F.col("first").isNotNull()
    return grouped.select("org_id", "critical", active.alias("active"),
                          F.when(active, F.col("first")).alias("triggered_at"),
                          F.when(active, F.col("first") + F.expr(f"INTERVAL {BREACH_WINDOW}")).alias("deadline"))


def auth_blocks_stream(log: DataFrame, limit: int = limiter.LIMIT, window_seconds: int = limiter.WINDOW_SECONDS,
                       lateness: str = "1 minute") -> DataFrame:
    """Streaming twin of :func:`veilspark.operators.limiter.auth_blocks`: one row
    the moment an address reaches the limit.  State is an opening time and a
    count per address, dropped two windows after the opening."""
    span = window_seconds * 1_000_000
    shape, out = "window_start bigint, failures bigint", "ip string, window_start timestamp, blocked_at timestamp"

    def advance(key, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        current, rows = (tuple(state.get) if state.exists else None), []
        attempts = pd.concat(list(batches)).sort_values(["at", "failed"], ascending=[True, False])
        for at, failed in zip(attempts["at"], attempts["failed"]):
            current, crossed = limiter.step(current, int(at), int(failed), not failed, limit, span)
            if crossed is not None:
                rows.append((key[0], pd.Timestamp(crossed, unit="us"), pd.Timestamp(int(at), unit="us")))
        if current is None:
            if state.exists:
                state.remove()
        else:
            state.update(current)
            expiry = (current[0] + 2 * span) // 1000
            state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(rows, columns=["ip", "window_start", "blocked_at"])

    keyed = log.withWatermark("ts", lateness).select("ip", "ts", F.unix_micros("ts").alias("at"), "failed")
    return keyed.groupBy("ip").applyInPandasWithState(
        advance, out, shape, "append", GroupStateTimeout.EventTimeTimeout)


def scan_stream(docs: DataFrame, rules, paths: dict[str, str], checkpoint: str, salt: str,
                id_col: str = "doc_id", text_col: str = "text", session: str = "session", order: str = "order",
                every: str | None = None, versioned: bool = False) -> StreamingQuery:
    """Scan and pseudonymise a stream of texts.

    The scan needs no state.  The vault is an append-only table: a batch adds its
    new values (as ``epoch=N``), and known ones keep their placeholder.
    """
    def handle(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        found_path = os.path.join(paths["found"], f"epoch={epoch}")
        evaluate(batch, text_col, rules).write.mode("overwrite").parquet(found_path)
        found = spark.read.parquet(found_path)
        values = values_to_replace(found, session, order)
        vault = Sink(spark, paths["vault"], checkpoint, versioned)
        if versioned:
            stored = vault.table.read(without=(checkpoint, epoch))
        else:
            stored = read_table(spark, paths["vault"])
            stored = None if stored is None else stored.where(F.col("epoch") < epoch)
        existing = None if stored is None else stored.drop("epoch")                  # the first batch has no vault yet
        entries = (build_vault(values, salt, session, order).withColumn("generation", F.lit(epoch))
                   if existing is None else extend_vault(values, salt, existing, epoch, session, order))
        entries.write.mode("overwrite").parquet(paths["vault"] + "_known")           # the next batch overwrites it
        known = spark.read.schema(entries.schema).parquet(paths["vault"] + "_known")
        vault.put(known.where(F.col("generation") == epoch), epoch)
        planned = plan(anonymize(found, known, salt, id_col, text_col, session), text_col)
        Sink(spark, paths["out"], checkpoint, versioned).put(planned.select(id_col, session, "decision", "outcome", "result"), epoch)

    return _start(docs, checkpoint, handle, every=every)
