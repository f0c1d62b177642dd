"""Writers: the event table, RoPA files, purge."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark.operators.compliance import ROPA_COLUMNS
from veilspark.operators.events import one_per_key
from veilspark.schema import ddl

def write_events(df: DataFrame, path: str) -> None:
    """Append to the table partitioned by day.

    The rebalance lets adaptive execution split a busy day over several writers
    and merge quiet ones; rows are clustered by organisation, so that file
    statistics prune organisation and time filters.
    """
    rows = one_per_key(df) if "position" in df.columns else df
    by_day(rows.drop("position")).write.mode("append").partitionBy("event_date").parquet(path)


def by_day(df: DataFrame) -> DataFrame:
    """Rows with their day, laid out for a table partitioned by it."""
    dated = df.withColumn("event_date", F.to_date("timestamp"))
    return dated.hint("rebalance", F.col("event_date")).sortWithinPartitions("event_date", "org_id", "timestamp")


def ropa_lines(ropa: DataFrame, org: str, day: str, product: str = "veilspark") -> DataFrame:
    """The CSV as text lines with their order: comment, header, quoted rows."""
    def quoted(value):
        return F.concat(F.lit('"'), F.replace(value, F.lit('"'), F.lit('""')), F.lit('"'))

    spark = ropa.sparkSession
    head = spark.createDataFrame(
        [(0, f"\ufeff# RoPA {product} — {org} — {day}"), (1, ",".join(f'"{c}"' for c in ROPA_COLUMNS))],
        "part int, value string")
    body = ropa.select(F.lit(2).alias("part"), F.concat_ws(",", *[quoted(F.col(f"`{c}`")) for c in ROPA_COLUMNS]
                                                          ).alias("value"))
    return head.unionByName(body)


def write_ropa(ropa: DataFrame, path: str, org: str, day: str, product: str = "veilspark") -> None:
    """One CSV file (services × top-50 types: a few hundred lines at most)."""
    (ropa_lines(ropa, org, day, product).orderBy("part", "value").coalesce(1).select("value")
     .write.mode("overwrite").text(path))


def purge(spark: SparkSession, tables: dict[str, dict[str, str]], partition_by: dict[str, str] | None = None) -> None:
    """Empty every table (path → schema) but keep it readable, with its partition column (path → name) if it has one."""
    for path, shape in tables.items():
        nothing = spark.createDataFrame([], ddl(shape))
        by = (partition_by or {}).get(path)
        if by is None:
            nothing.write.mode("overwrite").parquet(path)
            continue
        nothing.write.mode("overwrite").partitionBy(by).parquet(path)
        # An empty file in the partition of nulls carries the columns and the layout.
        nothing.drop(by).write.parquet(f"{path}/{by}=__HIVE_DEFAULT_PARTITION__")
