import random

from pyspark.sql import functions as F

from veilspark.operators import limiter
from veilspark.session import new_path
from veilspark.sources.versioned import VersionedTable, read_table
from veilspark.streaming import jobs, stateful


def put(spark, path, rows, shape):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)


FINDINGS = "event_id long, t string, org_id string, findings array<struct<type:string,severity:string,count:int>>"


def breach(spark, root, source):
    stream = spark.readStream.schema(FINDINGS).parquet(source).withColumn("timestamp", F.col("t").cast("timestamp"))
    stateful.breach_state_stream(stream, f"{root}/out", f"{root}/cp", time_range="7d", salts=4).awaitTermination()


def test_breach_clock_with_state(spark):
    root, source = new_path(spark, "b"), new_path(spark, "src")
    put(spark, source, [(i, "2024-01-30 10:00:00.25", "o", [("SSN", "critical", 2), ("email", "low", 9)]) for i in range(8)]
        + [(100, "2024-01-30 10:00:00", "p", [("health", "critical", 19)]), (None, "2024-01-30 09:00:00", "o", [("email", "low", 50)])], FINDINGS)
    breach(spark, root, source)
    put(spark, source, [(50, "2024-01-30 10:00:00.1", "o", [("SSN", "critical", 3)]), (51, "2024-01-30 10:00:09", "o", [("SSN", "critical", 1)])], FINDINGS)
    breach(spark, root, source)
    counted = jobs.latest_rows(spark, f"{root}/out", "second", "org_id", "salt")
    clocks = {r.org_id: r for r in jobs.breach_clocks(counted, "2024-01-31 00:00:00").collect()}
    assert clocks["o"].active and clocks["o"].critical == 20 and str(clocks["o"].triggered_at) == "2024-01-30 10:00:00.100000"
    assert clocks["p"].critical == 19 and not clocks["p"].active


def test_breach_state_and_table_forget_what_no_clock_reads(spark):
    root, source = new_path(spark, "b"), new_path(spark, "src")
    for day in range(1, 31, 7):         # 7 days and 72 hours are kept
        put(spark, source, [(10 * day + i, f"2024-01-{day:02} {i:02}:00:00", "o", [("SSN", "critical", 1)]) for i in range(5)], FINDINGS)
        breach(spark, root, source)
    state = spark.read.format("statestore").option("stateVarName", "hours").option("operatorId", 0).load(f"{root}/cp")
    hours = {r.hour for r in state.select(F.col("key.*"), "user_map_key.hour").collect()} if "user_map_key" in state.columns else set()
    newest = 30 * 24
    first = 1704067200 // 3600
    assert hours and min(hours) - first >= newest - 24 - 24 * 11 and len(hours) <= 2 * 5
    VersionedTable(spark, f"{root}/out", fold=stateful.newest_seconds("72 HOURS 7 DAYS"), fan=2).compact()
    days = {str(r.day) for r in read_table(spark, f"{root}/out").select(F.to_date("second").alias("day")).distinct().collect()}
    assert "2024-01-29" in days and min(days) >= "2024-01-15"
    counted = jobs.latest_rows(spark, f"{root}/out", "second", "org_id", "salt")
    assert jobs.breach_clocks(counted, "2024-01-29 12:00:00", time_range="7d").first().critical == 5


LOG = "ip string, t double, failed boolean"


def blocks(spark, batches, limit=3, window=60, lateness="30 seconds"):
    root, source = new_path(spark, "l"), new_path(spark, "src")
    last = max(t for batch in batches for _, t, _ in batch) + 10_000
    for rows in [*batches, [("end", last, True)], [("end", last + 1, True)]]:
        put(spark, source, rows, LOG)
        stream = spark.readStream.schema(LOG).parquet(source).select("ip", F.col("t").cast("timestamp").alias("ts"), "failed")
        with stateful.rocksdb(spark):
            found = stateful.auth_blocks_ordered(stream, limit=limit, window_seconds=window, lateness=lateness)
            (found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
             .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema("ip string, window_start timestamp, blocked_at timestamp").parquet(f"{root}/out")
    return sorted(map(tuple, rows.select("ip", F.unix_seconds("window_start"), F.unix_seconds("blocked_at")).collect()))


def test_limiter_judges_attempts_in_order_of_time_whatever_the_batches(spark):
    rng = random.Random(4)
    log = [(10_000 + i // 3, rng.choice("abc"), rng.random() < 0.8) for i in range(400)]
    log += [(10_000 + i // 8, "hot", i % 50 != 7) for i in range(900)]           # one address with most of the rows
    rows = spark.createDataFrame([(ip, float(t), f) for t, ip, f in log], LOG).select("ip", F.col("t").cast("timestamp").alias("ts"), "failed")
    want = limiter.auth_blocks(rows, 3, 60).select("ip", F.unix_seconds("window_start"), F.unix_seconds("blocked_at"))
    want = sorted(map(tuple, want.collect()))
    late = sorted(log, key=lambda r: r[0] + rng.random() * 20)                    # up to 20 seconds out of order
    batches = [[(ip, float(t), f) for t, ip, f in late[i:i + 700]] for i in range(0, len(late), 700)]
    assert blocks(spark, batches) == want and len(want) > 5


def test_limiter_forgets_windows(spark):
    first = [("a", 10_000.0, True), ("a", 10_001.0, True)]
    assert blocks(spark, [first, [("a", 10_500.0, True), ("a", 10_501.0, True)]]) == []
    assert blocks(spark, [first, [("a", 10_030.0, True)]]) == [("a", 10_000, 10_030)]


def test_provider_setting_comes_back(spark):
    before = spark.conf.get(stateful._PROVIDER, None)
    with stateful.rocksdb(spark):
        assert spark.conf.get(stateful._PROVIDER).endswith("RocksDBStateStoreProvider")
    assert spark.conf.get(stateful._PROVIDER, None) == before
    assert VersionedTable(spark, new_path(spark, "none")).read() is None
