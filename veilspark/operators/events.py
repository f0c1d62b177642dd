"""Detection events: filters, checks, de-duplication, paging."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilspark import schema

UUID = r"\A[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}\z"


def since(df: DataFrame, time_range: str = "24h", now: datetime | str | None = None,
          ts: str = "timestamp") -> DataFrame:
    """Rows at or after ``now - range`` (no upper bound); unknown ranges are an error.

    On the day-partitioned event table the bound also prunes partitions.
    """
    if time_range not in schema.RANGES:
        raise ValueError(f"range must be one of {', '.join(schema.RANGES)}")
    at = F.current_timestamp() if now is None else F.lit(now).cast("timestamp")
    bound = at - F.expr(f"INTERVAL {schema.RANGES[time_range]}")
    rows = df.where(F.col("event_date") >= F.to_date(bound)) if "event_date" in df.columns else df
    return rows.where(F.col(ts) >= bound)


def for_org(df: DataFrame, org: str) -> DataFrame:
    return df.where(F.col("org_id") == org)


def has_severity(df: DataFrame, severity: str) -> DataFrame:
    return df.where(F.coalesce(F.exists("findings", lambda f: f["severity"] == severity), F.lit(False)))


def to_wire(df: DataFrame) -> DataFrame:
    """The 15 fields a reader gets (organisation and ingest time stay inside)."""
    have = {name: F.col(name) if name in df.columns else F.lit(None).cast(schema.EVENTS[name])
            for name in schema.WIRE_NAMES}
    return df.select(*[column.alias(schema.WIRE_NAMES[name]) for name, column in have.items()])


def page(df: DataFrame, org: str, time_range: str = "24h", llm: str | None = None, action: str | None = None,
         severity: str | None = None, limit: int = 50, offset: int = 0, now=None) -> DataFrame:
    """Newest first.  Offsets snap down to a multiple of the page size, and the
    severity filter runs on the page, so a page may come back short."""
    size = max(1, min(schema.MAX_BATCH, limit))
    skip = max(0, offset) // size * size
    rows = since(for_org(df, org), time_range, now)
    for name, value in (("llm", llm), ("action", action)):
        if value is not None:
            rows = rows.where(F.col(name) == value)
    rows = rows.orderBy(F.desc("timestamp"), "event_id").offset(skip).limit(size)
    return rows if severity is None else has_severity(rows, severity)


def without_nulls(*reasons: Column) -> Column:
    """The reasons that hold, each once.  ``array_compact`` is a function of higher order, below which nothing is compiled:
    every test would be interpreted for every row."""
    return F.array_except(F.array(*reasons), F.array(F.lit(None).cast("string")))


def validate_events(df: DataFrame) -> DataFrame:
    """Add ``errors``: one entry per broken constraint of a wire event."""
    c = F.col
    tests: list[tuple[str, Column]] = []

    def required(name: str) -> None:
        tests.append((f"{name}: required", c(name).isNull()))

    def text(name: str, longest: int, pattern: str | None = None, blank: bool = False) -> None:
        if not blank:
            tests.append((f"{name}: required", c(name).isNull() | (F.trim(name) == "")))
        tests.append((f"{name}: longer than {longest}", F.length(name) > longest))
        if pattern:
            tests.append((f"{name}: malformed", ~c(name).rlike(pattern)))

    def choice(name: str, allowed: list[str]) -> None:
        tests.append((f"{name}: not allowed", c(name).isNull() | ~c(name).isin(allowed)))

    for name in ("eventId", "deviceId"):
        tests.append((f"{name}: not a uuid", c(name).isNull() | ~c(name).rlike(UUID)))
    text("orgId", 64, r"\A[a-zA-Z0-9_-]+\z")
    text("userHint", 254, blank=True)
    required("timestamp")
    text("hostname", 253)
    choice("llm", schema.SERVICES)
    choice("action", schema.EVENT_ACTIONS)
    text("endpoint", 512, blank=True)
    choice("mode", schema.MODES)
    for name in ("promptLength", "mappingsCount"):
        tests.append((f"{name}: must be at least 0", c(name).isNull() | (c(name) < 0)))
    text("anonymizedPreview", 200, blank=True)
    required("findings")
    tests.append(("findings: more than 50", F.size("findings") > schema.MAX_FINDINGS))
    tests.append(("findings: bad element", ~F.forall("findings", lambda f: F.coalesce(
        (F.trim(f["type"]) != "") & (F.length(f["type"]) <= 128)
        & f["severity"].isin(schema.SEVERITY_NAMES) & (f["count"] >= 1), F.lit(False)))))
    a = c("attachment")
    tests.append(("attachment: malformed", ~a["sha256"].rlike(r"\A[a-f0-9]*\z") | (F.length(a["sha256"]) > 64)
                  | (F.length(a["mimeType"]) > 128) | (F.length(a["extractorId"]) > 32)
                  | (a["sizeBytes"] < 0) | (a["extractedChars"] < 0)))
    text("extensionVersion", 32, r"\A[0-9]+\.[0-9]+\.[0-9]+\z")
    tests.append(("schemaVersion: must be 1", c("schemaVersion").isNull() | (c("schemaVersion") != 1)))
    return df.withColumn("errors", without_nulls(*[F.when(bad, F.lit(why)) for why, bad in tests]))


def to_stored(df: DataFrame, ingested_at, *keep: str, ingest_id: str | None = None) -> DataFrame:
    """Wire event → stored row (plus the columns in ``keep``)."""
    renamed = df.select(*[F.col(wire).alias(stored) for stored, wire in schema.WIRE_NAMES.items()], *keep,
                        F.col("orgId").alias("org_id"), F.lit(ingested_at).cast("timestamp").alias("ingested_at"),
                        F.lit(ingest_id).cast("string").alias("ingest_id"))
    return renamed.select(*schema.EVENTS, *keep)


def existing_ids(batch: DataFrame, stored: DataFrame) -> DataFrame:
    """Distinct ids of the batch that are stored already.

    The stored table is the probing side: when the batch is small its ids are
    broadcast and the table is read in place instead of being shuffled.
    """
    return stored.select("event_id").join(batch.select("event_id").distinct(), "event_id", "left_semi").distinct()


def split_new(batch: DataFrame, stored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows whose id is not stored yet, distinct stored ids among the batch).

    The id sets are reduced to distinct ids first, so a batch that repeats one
    id many times does not overload the task that owns that id.
    """
    known = existing_ids(batch, stored)
    return batch.join(known, "event_id", "left_anti"), known


def one_per_key(df: DataFrame, position: str = "position") -> DataFrame:
    """One row per (event_id, timestamp): the one written last.  A plain
    aggregate, so repeats are folded before the shuffle."""
    others = [name for name in df.columns if name not in ("event_id", "timestamp")]
    best = df.groupBy("event_id", "timestamp").agg(F.max_by(F.struct(*others), F.col(position)).alias("row"))
    return best.select("event_id", "timestamp", "row.*").select(*df.columns)


def latest_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The row with the greatest ``order`` per key, combined map-side (a hot key
    sends one row per task, where a window would sort all its rows in one)."""
    others = [name for name in df.columns if name not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(*order)).alias("row"))
    return best.select(*keys, "row.*").select(*df.columns)


def latest_per_device(batch: DataFrame, position: str = "position") -> DataFrame:
    """Newest event per device; the first one in the batch wins a tie."""
    return latest_by(batch, ["device_id"], F.col("timestamp"), -F.col(position))


def keep_newest(df: DataFrame, n: int = 500, ts: str = "ts", *ties: str) -> DataFrame:
    return df.orderBy(F.desc(ts), *ties).limit(n)


def recent(df: DataFrame, n: int = 10, ts: str = "ts", *ties: str) -> DataFrame:
    return keep_newest(df, n, ts, *ties)


def top_n(df: DataFrame, column: str, n: int, *ties: str) -> DataFrame:
    return df.orderBy(F.desc(column), *ties).limit(n)


def newest_per_key(df: DataFrame, keys: list[str], n: int, *order: Column, salts: int = 64) -> DataFrame:
    """The ``n`` first rows per key under ``order``, exactly, in two rounds: each
    salt of a key keeps its own best ``n``, then those few compete."""
    others = [F.col(name) for name in df.columns]
    salted = df.withColumn("__salt", F.pmod(F.xxhash64(*others), F.lit(salts)))
    first = W.partitionBy(*keys, "__salt").orderBy(*order)
    final = W.partitionBy(*keys).orderBy(*order)
    few = salted.withColumn("__rank", F.row_number().over(first)).where(F.col("__rank") <= n)
    return (few.withColumn("__rank", F.row_number().over(final)).where(F.col("__rank") <= n)
            .drop("__salt", "__rank"))
