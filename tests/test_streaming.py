import json
import os

from pyspark.sql import functions as F

from model import fnv6
from test_events import VALID, python_blocks
from veilspark.operators import vault as vt
from veilspark.rules import compile_rules
from veilspark.session import new_path
from veilspark.streaming import jobs


def put(spark, path, rows, shape):
    spark.createDataFrame(rows, shape).coalesce(1).write.mode("append").parquet(path)


def test_ingest_over_several_batches(spark):
    root, source = new_path(spark, "i"), new_path(spark, "src")
    paths = {n: f"{root}/{n}" for n in ("events", "rejected", "devices", "feed")}

    def send(*events):
        spark.createDataFrame([(json.dumps(e),) for e in events], "value string").coalesce(1).write.mode("append").text(source)
        jobs.ingest_stream(spark.readStream.text(source), paths, f"{root}/cp", ingested_at="2024-02-01").awaitTermination()

    other = {**VALID, "eventId": VALID["eventId"].replace("0b7f", "1b7f"), "timestamp": "2024-01-06T00:00:00Z", "userHint": "zoe"}
    send(VALID, VALID, {**VALID, "action": "HACK"})
    send(VALID, other)
    assert spark.read.parquet(paths["events"]).count() == 2
    assert spark.read.parquet(paths["rejected"]).count() == 1
    assert jobs.live_feed(spark, paths["feed"], "acme").count() == 2
    latest = spark.read.parquet(paths["devices"]).where("epoch = 1").collect()
    assert [(d.id, d.user_hint) for d in latest] == [(VALID["deviceId"], "zoe")]


def test_ingest_batch_repeated_after_a_crash(spark):
    """Forget that batch 0 was committed: it runs again and leaves the same data."""
    root, source = new_path(spark, "i"), new_path(spark, "src")
    paths = {n: f"{root}/{n}" for n in ("events", "rejected", "devices", "feed")}
    spark.createDataFrame([(json.dumps(VALID),)], "value string").write.text(source)
    for attempt in (1, 2):
        jobs.ingest_stream(spark.readStream.text(source), paths, f"{root}/cp", ingested_at="2024-02-01").awaitTermination()
        assert spark.read.parquet(paths["events"]).count() == 1
        assert jobs.live_feed(spark, paths["feed"], "acme").count() == 1
        assert jobs.latest_rows(spark, paths["devices"], "id").count() == 1
        if attempt == 1:
            for name in os.listdir(f"{root}/cp/commits"):
                os.remove(f"{root}/cp/commits/{name}")


def test_ingest_with_stream_side_dedup(spark):
    root, source = new_path(spark, "i"), new_path(spark, "src")
    paths = {n: f"{root}/{n}" for n in ("events", "rejected")}
    spark.createDataFrame([(json.dumps(VALID),)] * 3, "value string").write.text(source)
    jobs.ingest_stream(spark.readStream.text(source), paths, f"{root}/cp", "2024-02-01", dedup_within="1 day").awaitTermination()
    assert spark.read.parquet(paths["events"]).count() == 1


def test_rollup_updates_and_drops_only_beyond_30_days(spark):
    root, source = new_path(spark, "r"), new_path(spark, "src")
    shape = "t string, org_id string, llm string, action string, prompt_length int"

    def send(*days):
        put(spark, source, [(f"{d} 05:00:00", "o", "Claude", "CLEAN", 10) for d in days], shape)
        stream = spark.readStream.schema(shape).parquet(source).withColumn("timestamp", F.col("t").cast("timestamp"))
        jobs.daily_rollup_stream(stream, f"{root}/out", f"{root}/cp").awaitTermination()

    send("2024-01-01", "2024-01-01", "2024-03-01")
    send("2024-02-10", "2024-03-01", "2024-01-01")
    rows = {str(r.day)[:10]: r.n for r in jobs.latest_rows(spark, f"{root}/out", "day", "org_id", "llm", "action").collect()}
    assert rows == {"2024-01-01": 2, "2024-02-10": 1, "2024-03-01": 2}


def test_limiter_state_spans_batches(spark):
    root, source = new_path(spark, "l"), new_path(spark, "src")
    shape = "ip string, t int, failed boolean"
    log = [(10 * i, "a", True) for i in range(12)] + [(15, "b", True), (25, "b", False), (35, "b", True), (45, "b", True), (300, "a", True)]
    log = [(t + 10_000, ip, failed) for t, ip, failed in log]
    for part in (sorted(log)[:9], sorted(log)[9:]):
        put(spark, source, [(ip, t, f) for t, ip, f in part], shape)
        stream = spark.readStream.schema(shape).parquet(source).select("ip", F.timestamp_seconds("t").alias("ts"), "failed")
        blocks = jobs.auth_blocks_stream(stream, limit=3, window_seconds=60, lateness="10 minutes")
        (blocks.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
         .trigger(availableNow=True).start().awaitTermination())
    got = spark.read.parquet(f"{root}/out").select("ip", F.unix_seconds("window_start"), F.unix_seconds("blocked_at")).collect()
    assert sorted(map(tuple, got)) == python_blocks(log, 3, 60)


def test_breach_and_counters(spark):
    root, source = new_path(spark, "b"), new_path(spark, "src")
    shape = "t string, org_id string, findings array<struct<type:string,severity:string,count:int>>"
    put(spark, source, [("2024-01-01 00:00:00", "o", [("SSN", "critical", 15)]), ("2024-01-30 10:00:00", "o", [("health", "critical", 5), ("email", "low", 9)]),
                        ("2024-01-30 10:00:00", "p", [("health", "critical", 19)]), ("2024-01-30 09:00:00", "o", [("email", "low", 50)])], shape)
    stream = spark.readStream.schema(shape).parquet(source).withColumn("timestamp", F.col("t").cast("timestamp"))
    jobs.breach_stream(stream, f"{root}/out", f"{root}/cp").awaitTermination()
    clocks = {r.org_id: r for r in jobs.breach_clocks(jobs.latest_rows(spark, f"{root}/out", "second", "org_id"), "2024-01-31 00:00:00").collect()}
    assert clocks["o"].active and clocks["o"].critical == 20 and str(clocks["o"].triggered_at) == "2024-01-30 10:00:00"
    assert not clocks["p"].active


def test_scan_stream_keeps_placeholders(spark):
    root, source = new_path(spark, "s"), new_path(spark, "src")
    shape = "doc_id int, text string, session string, `order` int"
    rules = compile_rules({"rules": [{"id": "a", "kind": "regex", "placeholder": "A", "pattern": r"(?<=a:)\w+"},
                                     {"id": "b", "kind": "regex", "placeholder": "B", "pattern": r"(?<=b:)\w+"}]})
    paths = {k: f"{root}/{k}" for k in ("found", "vault", "out")}
    for rows in ([(1, "a:rose", "s", 1)], [(2, "b:rose b:lily", "s", 2)], [(3, "a:lily a:rose", "s", 3)]):
        put(spark, source, rows, shape)
        jobs.scan_stream(spark.readStream.schema(shape).parquet(source), rules, paths, f"{root}/cp", "k").awaitTermination()
    rose, lily = f"[A_{fnv6('k:rose')}]", f"[B_{fnv6('k:lily')}]"
    got = {r.doc_id: r.result for r in spark.read.parquet(paths["out"]).collect()}
    assert got == {1: f"a:{rose}", 2: f"b:{rose} b:{lily}", 3: f"a:{lily} a:{rose}"}
    vault = spark.read.parquet(paths["vault"]).drop("epoch")
    assert vault.count() == 2
    back = vt.reveal(spark.read.parquet(paths["out"]), vault, text_col="result")
    assert back.where("doc_id = 3").first().revealed == "a:lily a:rose"
