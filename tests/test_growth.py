"""Larger tables: folders of files, long texts, and steps whose tasks must not grow with the whole table."""
import json
import os
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from test_events import VALID
from veilspark.operators import ner
from veilspark.plans import oracle
from veilspark.plans import queries as q
from veilspark.session import new_path
from veilspark.sources import readers
from veilspark.streaming import jobs, stateful


def in_folders(spark, sf, *names):
    """The tables as folders of several files, other tables as they are."""
    root = new_path(spark, "folders")
    os.makedirs(root)
    for name in names:
        spark.read.parquet(f"{sf}/{name}.parquet").repartition(3).write.parquet(f"{root}/{name}.parquet")
    return root


def test_streams_read_tables_that_are_folders(spark, sf):
    root = in_folders(spark, sf, "documents", "events")
    for name in ("stream_scan", "stream_action_counters"):
        assert sorted(map(tuple, q.QUERIES[name](spark, root).collect())) == sorted(map(tuple, q.QUERIES[name](spark, sf).collect()))


ODD_ADDRESSES = [
    "to ann@example.com_old, bob@example.com-x, cy@example.com1, dan@example.com.9", "ann@b.com.x@y.org", "é@b.com.x@y.org.z@w.net",
    "müller@example.com éa@b.com a@é.com", "a@b.c a@b.co@c.de @x.com a@@b.com", "x" * 3000 + " " + "y" * 3000 + "@z.org%", "a@b-.com a@.com a@-b.c.d",
    "ann@example.com\nbob@example.com\x85eve@example.comé", "日本a@b.com ann@例.com 😀a@b.com a😀b@c.de", None, "", "@", "ann@example.com\ufdd0b@c.de",
]


@pytest.mark.parametrize("name", ["scan_emails", "scan_overlap_anti_join"])
def test_addresses_are_those_of_the_sql_on_odd_texts(spark, name):
    root = new_path(spark, "odd")
    rows = list(enumerate(ODD_ADDRESSES))
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    want = duck.execute(oracle.oracle_sql()[name]).fetchall()
    assert Counter(map(tuple, q.QUERIES[name](spark, root).collect())) == Counter(want) and len(want) > 12


def test_anti_join_keeps_the_addresses_that_its_sql_keeps(spark):
    """Beside cards and network addresses, and where rows share an id."""
    root = new_path(spark, "beside")
    rows = [(1, "a@10.0.0.1.example.com"), (2, "4111 1111 1111 1111@example.com"), (3, "4111111111111111@example.com x@192.168.0.1.de"),
            (4, "é@b.com.x@y.org"), (4, "ann@y.org bob@z.org"), (4, "ann@y.org bob@z.org"), (None, "a@b.com"), (None, "é@b.com"), (5, None)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{root}/documents.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{root}/documents.parquet/*.parquet'")
    want = duck.execute(oracle.oracle_sql()["scan_overlap_anti_join"]).fetchall()
    assert Counter(map(tuple, q.QUERIES["scan_overlap_anti_join"](spark, root).collect())) == Counter(want) and len(want) > 8


def test_long_texts_are_not_stored_and_copies_are_tagged_once(spark):
    texts = ["the der " * 30_000, "the der " * 30_000, " " * 90_000, "les with " * 9_000, "the", None]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(2)
    before = set(os.listdir(new_path(spark, "x").rsplit("/", 1)[0])) if os.path.exists(new_path(spark, "x").rsplit("/", 1)[0]) else set()
    dealt = ner.detect_entities_dealt(df, "text", q.dictionary_model)
    whole = ner.detect_entities(df, "text", q.dictionary_model)
    found, want = ({r.id: (r.text, r.n, r.failed) for r in d.select("id", "text", F.hash("entities").alias("n"), F.col("entities_failed").alias("failed")).collect()}
                   for d in (dealt, whole))
    assert found == want and dealt.columns == whole.columns
    folder = new_path(spark, "x").rsplit("/", 1)[0]
    assert (set(os.listdir(folder)) if os.path.exists(folder) else set()) == before


def test_limiter_asks_for_state_by_bucket_and_slot(spark):
    """Many addresses share the entries of few buckets, and one timer is pending for each."""
    root, source = new_path(spark, "l"), new_path(spark, "src")
    rows = [(str(i) if i else None, 10_000.0 + t, True) for i in range(300) for t in (0, 1, 2, 70)] + [("last", 99_999.0, False)]
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, "ip string, t double, failed boolean").coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema("ip string, t double, failed boolean").parquet(source).select("ip", F.col("t").cast("timestamp").alias("ts"), "failed")
        with stateful.rocksdb(spark):
            found = stateful.auth_blocks_ordered(stream, limit=3, window_seconds=60, lateness="40 days", buckets=4)
            (found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
             .trigger(availableNow=True).start().awaitTermination())
    slots = spark.read.format("statestore").option("stateVarName", "slots").option("operatorId", 0).load(f"{root}/cp")
    assert 0 < slots.count() <= 4 * 5
    # a later batch far ahead ends the waiting
    for t in (9e6, 9e6 + 1):
        spark.createDataFrame([("end", t, False)], "ip string, t double, failed boolean").write.mode("append").parquet(source)
        stream = spark.readStream.schema("ip string, t double, failed boolean").parquet(source).select("ip", F.col("t").cast("timestamp").alias("ts"), "failed")
        with stateful.rocksdb(spark):
            found = stateful.auth_blocks_ordered(stream, limit=3, window_seconds=60, lateness="40 days", buckets=4)
            (found.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/cp")
             .trigger(availableNow=True).start().awaitTermination())
    blocked = spark.read.schema("ip string, window_start timestamp, blocked_at timestamp").parquet(f"{root}/out")
    assert sorted((r.ip or "0", r.s) for r in blocked.select("ip", F.unix_seconds("blocked_at").alias("s")).collect()) == sorted((str(i), 10_002) for i in range(300))


def test_wire_lines_of_a_batch_are_written_by_all_tasks(spark, sf):
    root = new_path(spark, "many")
    spark.read.parquet(f"{sf}/events.parquet").repartition(6).write.parquet(f"{root}/events.parquet")
    sources = []

    def seen(spark, name, made=new_path):
        path = made(spark, name)
        sources.extend([path] if name == "wire" else [])
        return path

    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(q, "new_path", seen)
        assert q.QUERIES["stream_ingest_rows"](spark, root).count() == q.QUERIES["stream_ingest_rows"](spark, sf).count()
    assert sum(name.endswith(".txt") for name in os.listdir(sources[0])) > 3 * 2


def test_generated_events_are_parsed_once(spark, sf):
    plan = q.QUERIES["events_generated"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("from_json(") <= 4


def test_patterns_ask_for_their_first_character_before_their_edges():
    patterns = [p for m in (*q.builtin_rules().matchers, *q.word_rules().matchers) for group in m.conditions for p in group]
    assert len(patterns) > 10 and all(p.startswith("(?=") for p in patterns)


def test_plain_lines_are_parsed_once_with_the_same_errors(spark):
    """A line without white space takes the short way, the same line with it the long one."""
    finding, many = {"type": "email", "severity": "high", "count": 1}, [{"type": "e", "severity": "low", "count": 1}] * 3000
    changes = [{}, {"x": 1}, {"findings": [{**finding, "x": 1}]}, {"findings": [finding, finding]}, {"findings": many}, {"findings": []}, {"findings": "[]"},
               {"findings": None}, {"findings": [None]}, {"attachment": {"sha256": "ab", "truncated": True}}, {"attachment": {"zip": 1}}, {"attachment": {}},
               {"timestamp": "2024-01-05T10:00:00"}, {"timestamp": "2024-01-05T10:00+01:00"}, {"timestamp": 5}, {"timestamp": None}, {"timestamp": "soon"},
               {"hostname": 'a"b'}, {"hostname": "\u00e9"}, {"hostname": "x" * 5000}, {"promptLength": "12"}, {"promptLength": 1.5}, {"promptLength": -0}]
    texts = [(i, json.dumps({**VALID, **change}, ensure_ascii=False, separators=between)) for i, change in enumerate(changes)
             for between in ((",", ":"), (", ", " : "))]
    whole = json.dumps(VALID, separators=(",", ":"))
    broken = [whole[:-1], whole + "}", whole.replace(":12,", ":012,"), whole.replace(":12,", ":12"), whole.replace("{", "{,", 1), whole[:-1] + ",}", whole.replace("chat", "a\x01"), "{}", ""]
    texts += [(100 + i, text) for i, line in enumerate(broken) for text in (line, line + "  ")]
    rows = readers.parse_events(spark.createDataFrame(texts, "i int, value string")).drop("value").collect()
    assert all(len(set(map(str, (r for r in rows if r.i == i)))) == 1 for i in {i for i, _ in texts})
    plain = [bool(r.p) for r in spark.createDataFrame(texts, "i int, value string").select(F.col("value").rlike(readers._plain_line()).alias("p")).collect()]
    assert plain[0] and not any(plain[1:2 * len(changes):2]) and sum(plain) >= 8
    assert "filter(" not in readers.parse_events(spark.range(1).select(F.lit(whole).alias("value")))._jdf.queryExecution().analyzed().toString()


def test_ingest_moves_rows_only_if_some_of_them_go(spark):
    root, source = new_path(spark, "i"), new_path(spark, "src")
    paths = {n: f"{root}/{n}" for n in ("events", "rejected", "devices", "feed")}
    events = [{**VALID, "eventId": f"00000000-0000-4000-8000-{i:012d}"} for i in range(40)]

    def send(*lines):
        spark.createDataFrame([(json.dumps(e),) for e in lines], "value string").coalesce(1).write.mode("append").text(source)
        jobs.ingest_stream(spark.readStream.text(source), paths, f"{root}/cp", ingested_at="2024-02-01").awaitTermination()

    send(*events[:20], {**VALID, "action": "HACK"})
    assert not os.path.exists(paths["events"] + "_new") and spark.read.parquet(paths["events"]).count() == 20
    staged = spark.read.parquet(paths["events"] + "_staged")
    assert [(r.bad, r.texts, r.n) for r in staged.groupBy((F.size("errors") > 0).alias("bad")).agg(F.count("value").alias("texts"), F.count("*").alias("n")).orderBy("bad").collect()] == [
        (False, 0, 20), (True, 1, 1)]
    # known ids, an id twice (the last one stays) and new ones
    send(*events[10:30], {**events[30], "promptLength": 1}, {**events[30], "promptLength": 2}, *events[31:])
    stored = spark.read.parquet(paths["events"])
    assert stored.count() == 40 and stored.select("event_id").distinct().count() == 40
    assert [r.prompt_length for r in stored.where(F.col("event_id") == events[30]["eventId"]).collect()] == [2]
    assert jobs.live_feed(spark, paths["feed"], "acme").count() == 40
    assert spark.read.parquet(paths["events"] + "_new").count() == 20
    send(*events)
    assert spark.read.parquet(paths["events"]).count() == 40
