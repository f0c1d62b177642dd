"""Usage statistics over detection events."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilspark.operators.events import for_org, since

TOP_TYPES = 50


def _scope(ev: DataFrame, org: str | None, time_range: str | None, now) -> DataFrame:
    rows = ev if org is None else for_org(ev, org)
    return rows if time_range is None else since(rows, time_range, now)


def count_by_action(ev, org=None, time_range=None, now=None) -> DataFrame:
    return _scope(ev, org, time_range, now).groupBy("action").agg(F.count("*").alias("count"))


def count_by_llm(ev, org=None, time_range=None, now=None) -> DataFrame:
    return _scope(ev, org, time_range, now).groupBy("llm").agg(F.count("*").alias("count"))


def count_by_device(ev, org=None, time_range=None, now=None) -> DataFrame:
    return _scope(ev, org, time_range, now).groupBy("device_id").agg(F.count("*").alias("count"))


def count_by_finding_type(ev, org=None, time_range=None, now=None, limit: int | None = TOP_TYPES) -> DataFrame:
    """Occurrences per finding type, most frequent first; ``limit`` None lists every type."""
    rows = _scope(ev, org, time_range, now).select(F.explode("findings").alias("f"))
    totals = rows.groupBy(F.col("f.type").alias("type")).agg(F.sum("f.count").alias("count"))
    return totals if limit is None else totals.orderBy(F.desc("count"), "type").limit(limit)


def daily_rollup(ev: DataFrame) -> DataFrame:
    return ev.groupBy(F.date_trunc("day", "timestamp").alias("day"), "org_id", "llm", "action").agg(
        F.count("*").alias("n"), F.sum("prompt_length").alias("total_prompt_length"))


def stats(ev, org=None, time_range=None, now=None) -> DataFrame:
    """One row: totals, four action buckets, ``by_llm`` and ``by_type`` maps.

    ``total`` covers every action, also those without a bucket, and ``by_type``
    every finding type: scores and reports are computed from it.  Two scans that
    read disjoint columns (action and service; findings), each aggregated to a
    handful of rows before anything is put side by side.
    """
    rows = _scope(ev, org, time_range, now)
    cells = rows.groupBy("action", "llm").agg(F.count("*").alias("n"))

    def bucket(action: str):
        return F.coalesce(F.sum(F.when(F.col("action") == action, F.col("n"))), F.lit(0).cast("bigint"))

    by_llm = cells.groupBy("llm").agg(
        F.sum("n").alias("n"), *[bucket(a).alias(b) for a, b in (
            ("CLEAN", "clean"), ("PII_DETECTED", "flagged"), ("BLOCKED", "blocked"), ("ANONYMIZED", "anonymized"))])
    by_type = count_by_finding_type(ev, org, time_range, now, None).agg(F.map_from_entries(
        F.collect_list(F.struct("type", "count"))).alias("by_type"))
    whole = [F.coalesce(F.sum(name), F.lit(0).cast("bigint")).alias(alias) for name, alias in (
        ("n", "total"), ("clean", "clean"), ("flagged", "flagged"), ("blocked", "blocked"),
        ("anonymized", "anonymized"))]
    return by_llm.agg(*whole, F.map_from_entries(F.collect_list(F.struct("llm", "n"))).alias("by_llm")).withColumn(
        "by_type", by_type.scalar())


def by_llm_rows(stats_row: DataFrame) -> DataFrame:
    return stats_row.select(F.explode("by_llm").alias("llm", "count"))


def by_type_rows(stats_row: DataFrame) -> DataFrame:
    return stats_row.select(F.explode("by_type").alias("type", "count"))


def percent_1dp(part, whole):
    """Half-up rounded percentage with one decimal."""
    return F.floor(part / whole * 1000 + 0.5) / 10


def llm_shares(by_llm: DataFrame) -> DataFrame:
    """Share per service."""
    total = by_llm.agg(F.sum("count")).scalar()
    return by_llm.withColumn("total", total).where(F.col("total") > 0).select(
        "llm", "count", percent_1dp(F.col("count"), F.col("total")).alias("pct")
    ).orderBy(F.desc("count"), "llm")


def scale_to_max(df: DataFrame, column: str, into: str = "pct") -> DataFrame:
    """Bar lengths: percent of the largest value."""
    largest = F.greatest(df.agg(F.max(column)).scalar(), F.lit(1))
    return df.withColumn(into, F.col(column) / largest * 100)


def headline_rates(stats_row: DataFrame) -> DataFrame:
    def rate(part: str):
        return F.when(F.col("total") > 0, F.floor(F.col(part) / F.col("total") * 100 + 0.5)).otherwise(0)

    return stats_row.select(F.size("by_llm").alias("distinct_llms"), rate("anonymized").alias("anonymized_pct"),
                            rate("blocked").alias("blocked_pct"))


def action_counters(detections: DataFrame, tz: str = "UTC") -> DataFrame:
    """Detections per day and action, plus a grand total per action (day NULL)."""
    day = F.to_date(F.from_utc_timestamp("ts", tz))
    return detections.withColumn("day", day).rollup("action", "day").agg(F.count("*").alias("n")).where(
        F.col("action").isNotNull()).select("day", "action", "n")


def handled_on(counters: DataFrame, day) -> DataFrame:
    """Anonymised plus blocked on one day."""
    return counters.where((F.col("day") == F.lit(day).cast("date")) & F.col("action").isin("anonymized", "blocked")
                          ).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("handled"))
