"""Access-audit rollups."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def audit_rollup(audit: DataFrame, *by: str) -> DataFrame:
    """Requests, errors (status >= 400) and latency by principal, path or status."""
    return audit.groupBy(*by).agg(
        F.count("*").alias("requests"), F.count_if(F.col("status") >= 400).alias("errors"),
        F.sum("latency_ms").alias("total_latency_ms"), F.max("latency_ms").alias("max_latency_ms"),
        F.percentile("latency_ms", 0.95).alias("p95_latency_ms"))


SKETCH_K = 800      # a quantile's rank is off by 0.4 % of the rows at most, 99 times of 100


def latency_sketches(audit: DataFrame, *by: str, k: int = SKETCH_K) -> DataFrame:
    """Requests and a KLL sketch of the latencies of each group (say path and day).

    A sketch has a few kilobytes however many requests it stands for, where the exact
    percentile keeps a count for every distinct latency. Sketches of parts merge, so a
    stored table of them answers for any set of groups without the log. Null latencies do not count.
    """
    return audit.groupBy(*by).agg(F.count("latency_ms").alias("requests"), F.kll_sketch_agg_bigint(F.col("latency_ms").cast("bigint"), k).alias("sketch"))


def latency_quantiles(sketches: DataFrame, *by: str, quantile: float = 0.95) -> DataFrame:
    """A quantile of the merged sketches of each group, within the sketches' rank error."""
    merged = sketches.groupBy(*by).agg(F.sum("requests").alias("requests"), F.kll_merge_agg_bigint("sketch").alias("sketch"))
    return merged.select(*by, "requests", F.kll_sketch_get_quantile_bigint("sketch", F.lit(float(quantile))).alias("latency_ms"))
