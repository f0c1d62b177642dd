"""Organisations and devices."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from veilspark import schema
from veilspark.operators.events import for_org, since


def ensure_orgs(events: DataFrame, orgs: DataFrame, created_at) -> DataFrame:
    """``orgs`` plus a row (name = id) for every organisation seen for the first time."""
    missing = (events.select(F.col("org_id").alias("id")).distinct().join(orgs, "id", "left_anti")
               .select("id", F.col("id").alias("name"), F.lit(created_at).cast("timestamp").alias("created_at")))
    return orgs.select("id", "name", "created_at").unionByName(missing)


def upsert_devices(devices: DataFrame, latest: DataFrame, seen_at) -> DataFrame:
    """Merge the newest event per device: unknown devices are added, known ones
    get a new last-seen time and keep what the event leaves empty."""
    at = F.lit(seen_at).cast("timestamp")
    new = latest.select(F.col("device_id").alias("id"), F.col("org_id").alias("n_org"),
                        F.col("user_hint").alias("n_hint"), F.col("extension_version").alias("n_version"),
                        F.lit(True).alias("n_seen"))
    return devices.join(new, "id", "full_outer").select(
        "id", F.coalesce("org_id", "n_org").alias("org_id"),
        F.coalesce("n_hint", "user_hint").alias("user_hint"),
        F.coalesce("n_version", "extension_version").alias("extension_version"),
        F.coalesce("token_hash", F.lit("")).alias("token_hash"),
        F.when(F.col("org_id").isNull(), at).otherwise(F.col("created_at")).alias("created_at"),
        F.when(F.col("n_seen"), at).otherwise(F.col("last_seen_at")).alias("last_seen_at"),
        F.coalesce("revoked", F.lit(False)).alias("revoked")).select(*schema.DEVICES)


def revoke(devices: DataFrame, revocations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(devices with revocations by (id, org_id) applied, revocations that found none)."""
    wanted = revocations.select("id", "org_id").distinct()
    marked = devices.join(wanted.withColumn("hit", F.lit(True)), ["id", "org_id"], "left").withColumn(
        "revoked", F.col("revoked") | F.coalesce("hit", F.lit(False)))
    return (marked.select(*schema.DEVICES),
            wanted.join(devices.select("id", "org_id"), ["id", "org_id"], "left_anti"))


def devices_by_recency(devices: DataFrame, org: str) -> DataFrame:
    return for_org(devices, org).orderBy(F.desc_nulls_first("last_seen_at"), "id")


def devices_with_counts(devices: DataFrame, events: DataFrame, org: str, now) -> DataFrame:
    """Devices of an organisation with their events of the last 24 hours."""
    counts = since(for_org(events, org), "24h", now).groupBy(F.col("device_id").alias("id")).agg(
        F.count("*").alias("events_24h"))
    joined = for_org(devices, org).join(counts, "id", "left")
    return joined.select("id", "user_hint", "extension_version", "created_at", "last_seen_at", "revoked",
                         F.coalesce("events_24h", F.lit(0).cast("bigint")).alias("events_24h")
                         ).orderBy(F.desc_nulls_first("last_seen_at"), "id")
