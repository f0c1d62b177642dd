import json
import random

import pytest
from pyspark.sql import functions as F

from veilspark import schema
from veilspark.operators import audit, devices as dv, events as ev, limiter, stats as st
from veilspark.session import new_path
from veilspark.sources import readers, writers

VALID = {
    "eventId": "0b7f9a52-6f0d-4d0f-9d3f-0a4c6f0e8a11", "deviceId": "5d3c2b1a-0000-4000-8000-000000000001", "orgId": "acme",
    "userHint": None, "timestamp": "2024-01-05T10:00:00Z", "hostname": "chat.example.com", "llm": "Claude",
    "action": "ANONYMIZED", "endpoint": "/x", "mode": "anonymize", "promptLength": 12, "mappingsCount": 1,
    "anonymizedPreview": "[EMAIL_1]", "findings": [{"type": "email", "severity": "high", "count": 1}], "attachment": None,
    "extensionVersion": "2.0.1", "schemaVersion": 1}


def parsed(spark, records):
    lines = spark.createDataFrame([(r if isinstance(r, str) else json.dumps(r),) for r in records], "value string")
    return readers.parse_events(lines)


@pytest.mark.parametrize("change, error", [
    ({}, None), ({"attachment": {"sha256": "ab12", "sizeBytes": 3}}, None), ({"action": "HACK"}, "action"),
    ({"promptPreview": "x"}, "unknown field"), ({"eventId": "x"}, "eventId"), ({"orgId": "a b"}, "orgId"), ({"orgId": "a" * 65}, "orgId"),
    ({"timestamp": "soon"}, "timestamp"), ({"hostname": " "}, "hostname"), ({"llm": "Nobody"}, "llm"), ({"mode": "x"}, "mode"),
    ({"promptLength": -1}, "promptLength"), ({"findings": None}, "findings"), ({"schemaVersion": 2}, "schemaVersion"),
    ({"findings": [{"type": "e", "severity": "high", "count": 0}]}, "findings"), ({"extensionVersion": "2.0"}, "extensionVersion"),
    ({"findings": [{"type": "e", "severity": "high", "count": 1, "x": 1}]}, "findings: unknown"), ({"userHint": "u" * 255}, "userHint"),
    ({"findings": [{"type": "e", "severity": "high", "count": 1}] * 51}, "findings: more"), ({"attachment": {"zip": 1}}, "attachment: unknown"),
    ({"attachment": {"sha256": "XYZ"}}, "attachment"), ({"anonymizedPreview": "p" * 201}, "anonymizedPreview")])
def test_closed_schema(spark, change, error):
    errors = parsed(spark, [{**VALID, **change}]).first().errors
    assert (not errors) if error is None else any(e.startswith(error) for e in errors)


def test_missing_attachment_and_garbage(spark):
    without = {k: v for k, v in VALID.items() if k != "attachment"}
    good, bad = readers.split_valid(parsed(spark, [without, "not json", "[1]", ""]))
    assert good.count() == 1 and bad.count() == 3


def test_read_events_path_and_batches(spark):
    path = new_path(spark, "lines")
    spark.createDataFrame([(json.dumps(VALID),), (json.dumps({**VALID, "x": 1}),)], "value string").write.text(path)
    good, bad = readers.read_events(path, spark)
    assert good.count() == 1 and bad.count() == 1
    body = lambda n: json.dumps({"events": [VALID] * n})                                 # noqa: E731
    lines = spark.createDataFrame([(1, body(2)), (2, body(501)), (3, body(0)), (4, body(500))], "batch_id int, value string")
    kept, refused = readers.check_batches(readers.unfold_batches(lines, "batch_id"))
    assert {r.batch_id: r["count"] for r in kept.groupBy("batch_id").count().collect()} == {1: 2, 4: 500}
    assert {tuple(r) for r in refused.collect()} == {(2, 501), (3, 0)}


def test_ranges(spark):
    df = spark.createDataFrame([("2024-01-30 00:00:00",), ("2024-01-29 23:59:59",)], "t string").select(F.col("t").cast("timestamp").alias("timestamp"))
    assert ev.since(df, "24h", "2024-01-31 00:00:00").count() == 1
    with pytest.raises(ValueError, match="1h, 24h, 7d, 30d"):
        ev.since(df, "2h", "2024-01-31")


def test_page_snaps_offset_and_filters_after(spark):
    rows = [(i, f"2024-01-30 00:00:{i:02d}", "o", "Claude", "CLEAN", [("t", "high" if i % 2 else "low", 1)]) for i in range(20)]
    df = spark.createDataFrame(rows, f"event_id int, t string, org_id string, llm string, action string, findings array<{schema.FINDING}>"
                               ).withColumn("timestamp", F.col("t").cast("timestamp"))
    got = ev.page(df, "o", severity="high", limit=6, offset=11, now="2024-01-31 00:00:00")
    assert [r.event_id for r in got.collect()] == [13, 11, 9]
    assert ev.page(df, "o", limit=0, now="2024-01-31 00:00:00").count() == 1
    assert ev.page(df, "o", llm="Grok", now="2024-01-31 00:00:00").count() == 0


def test_latest_per_device_ties(spark):
    df = spark.createDataFrame([("d", 1, "a", 0), ("d", 2, "b", 1), ("d", 2, "c", 2)], "device_id string, timestamp int, x string, position int")
    assert ev.latest_per_device(df).first().x == "b"


def test_repeats_inside_a_batch(spark):
    batch = spark.createDataFrame([(1, 5, "x", 0), (1, 5, "y", 1), (1, 6, "z", 2), (2, 5, "w", 3)], "event_id int, timestamp int, v string, position int")
    stored = spark.createDataFrame([(2,), (9,)], "event_id int")
    new, known = ev.split_new(batch, stored)
    assert new.count() == 3 and [r.event_id for r in known.collect()] == [2]
    assert {(r.timestamp, r.v) for r in ev.one_per_key(new).collect()} == {(5, "y"), (6, "z")}


def test_device_merge(spark):
    known = spark.createDataFrame([("a", "o", "hint", "1.0.0", "h", None, None, True)], schema.ddl(schema.DEVICES))
    latest = spark.createDataFrame([("a", "other", None, "2.0.0"), ("b", "o", "new", "1.1.1")], "device_id string, org_id string, user_hint string, extension_version string")
    rows = {r.id: r for r in dv.upsert_devices(known, latest, "2024-01-02").collect()}
    assert (rows["a"].org_id, rows["a"].user_hint, rows["a"].extension_version, rows["a"].revoked, rows["a"].created_at) == ("o", "hint", "2.0.0", True, None)
    assert rows["b"].created_at == rows["b"].last_seen_at is not None and rows["b"].token_hash == "" and not rows["b"].revoked
    after, missing = dv.revoke(dv.upsert_devices(known, latest, "2024-01-02"),
                               spark.createDataFrame([("b", "o"), ("b", "x"), ("zz", "o")], "id string, org_id string"))
    assert {r.id: r.revoked for r in after.collect()} == {"a": True, "b": True}
    assert {tuple(r) for r in missing.collect()} == {("b", "x"), ("zz", "o")}
    assert [r.id for r in dv.devices_by_recency(known.unionByName(after.where("id = 'b'")), "o").collect()] == ["a", "b"]


def test_generator_is_valid_and_repeatable(spark):
    made = readers.generate_events(spark, 3000, seed=5)
    checked = ev.validate_events(made)
    assert checked.where(F.size("errors") > 0).count() == 0
    assert made.select("eventId").distinct().count() == 3000
    again = readers.generate_events(spark, 3000, seed=5).repartition(7)
    assert made.exceptAll(again).count() == 0
    share = made.where("action = 'CLEAN'").count() / 3000
    assert 0.6 < share < 0.7 and made.where("action = 'CLEAN' AND size(findings) > 0").count() == 0
    assert made.where("size(array_distinct(findings.type)) <> size(findings)").count() == 0


def test_write_purge(spark):
    path = new_path(spark, "ev")
    rows = ev.to_stored(readers.generate_events(spark, 200), "2024-02-01")
    writers.write_events(rows, path)
    assert spark.read.parquet(path).count() == 200
    week = ev.since(ev.for_org(spark.read.parquet(path), "default"), "7d", "2024-01-31")
    scan = [x for x in week._jdf.queryExecution().executedPlan().toString().splitlines() if "FileScan" in x][0]
    assert "PartitionFilters: [isnotnull(event_date" in scan and ">= 2024-01-24" in scan
    assert "EqualTo(org_id,default)" in scan and "GreaterThanOrEqual(timestamp" in scan
    assert 0 < week.count() == ev.since(rows, "7d", "2024-01-31").count() < 200
    flat = new_path(spark, "dev")
    spark.createDataFrame([("a",)], "id string").write.parquet(flat)
    writers.purge(spark, {flat: {"id": "string"}})
    assert spark.read.parquet(flat).count() == 0 and spark.read.parquet(flat).columns == ["id"]


def test_audit_lines(spark):
    lines = ['2024 INFO audit - method=GET path=/v1/stats query=a=b&c=d status=200 remote=::1 ua="Mozilla/5.0 (X11) x=y" principal=device:1/org:o latencyMs=7',
             'method=GET path=/v1/health query=- status=200 remote=- ua="-" principal=anonymous latencyMs=1', "noise",
             'method=POST path=/v1/events query=- status=500 remote=1.2.3.4 ua="q "quoted" z" principal=jwt:u latencyMs=9']
    rows = readers.read_audit(spark.createDataFrame([(x,) for x in lines], "value string"))
    got = {r.path: r for r in rows.collect()}
    assert set(got) == {"/v1/stats", "/v1/events"} and got["/v1/stats"].query == "a=b&c=d" and got["/v1/events"].query is None
    assert got["/v1/stats"].ua == "Mozilla/5.0 (X11) x=y" and got["/v1/events"].ua == 'q "quoted" z'
    rolled = {r.path: (r.requests, r.errors) for r in audit.audit_rollup(rows, "path").collect()}
    assert rolled == {"/v1/stats": (1, 0), "/v1/events": (1, 1)}


def python_blocks(log, limit, window):
    out, state = [], {}
    for ts, ip, failed in sorted(log):
        if not failed:
            state.pop(ip, None)
            continue
        opened, n = state.get(ip, (ts, 0))
        if ts - opened > window:
            opened, n = ts, 0
        state[ip] = (opened, n + 1)
        if n + 1 == limit:
            out.append((ip, opened, ts))
    return sorted(out)


def test_limiter_against_plain_loop(spark):
    rng = random.Random(2)
    log = [(t, rng.choice(["a", "a", "a", "b", "c"]), rng.random() < 0.93) for t in rng.sample(range(400_000), 4000)]
    df = spark.createDataFrame(log, "t int, ip string, failed boolean").select("ip", F.timestamp_seconds("t").alias("ts"), "failed").repartition(5)
    for limit, window in ((3, 600), (10, 3600), (2, 100_000)):
        got = limiter.auth_blocks(df, limit, window).select("ip", F.unix_seconds("window_start"), F.unix_seconds("blocked_at")).collect()
        assert sorted(map(tuple, got)) == python_blocks(log, limit, window)


def test_counters_and_newest(spark):
    df = spark.createDataFrame([("2024-01-01 23:30:00", "anonymized"), ("2024-01-01 12:00:00", "blocked"), ("2024-01-02 01:00:00", "warned")],
                               "t string, action string").select(F.col("t").cast("timestamp").alias("ts"), "action")
    counters = st.action_counters(df)
    assert st.handled_on(counters, "2024-01-01").first().handled == 2
    assert {(str(r.day), r.action, r.n) for r in st.action_counters(df, "Europe/Brussels").collect()} >= {("2024-01-02", "anonymized", 1), ("None", "warned", 1)}
    assert ev.keep_newest(df, 1).first().action == "warned"
    rng = random.Random(4)
    rows = [(rng.choice("ab" if i % 3 else "a"), i) for i in range(500)]
    got = ev.newest_per_key(spark.createDataFrame(rows, "k string, v int"), ["k"], 7, F.desc("v"), salts=5)
    want = {(k, v) for k in "ab" for v in sorted((v for kk, v in rows if kk == k), reverse=True)[:7]}
    assert {tuple(r) for r in got.collect()} == want


def test_empty_stats(spark):
    none = spark.createDataFrame([], schema.ddl(schema.EVENTS))
    row = st.stats(none)
    assert row.first().asDict() == {"total": 0, "clean": 0, "flagged": 0, "blocked": 0, "anonymized": 0, "by_llm": {}, "by_type": {}}
    assert st.headline_rates(row).first().asDict() == {"distinct_llms": 0, "anonymized_pct": 0, "blocked_pct": 0}
    assert st.llm_shares(st.by_llm_rows(row)).count() == 0
