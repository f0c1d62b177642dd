import glob
import json
import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from test_events import VALID
from veilspark.operators.events import latest_by
from veilspark.session import new_path
from veilspark.sources.idstore import IdStore, build_filter, may_hold
from veilspark.sources.versioned import VersionedTable, read_table
from veilspark.streaming import jobs, rollup


def numbers(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id int").coalesce(1)


def ids_of(df):
    return sorted(r.id for r in df.select("id").collect())


def test_many_batches_leave_few_folders(spark):
    path = new_path(spark, "v")
    table = VersionedTable(spark, path, fan=3, keep=4)
    for epoch in range(30):
        table.append(numbers(spark, epoch), "q", epoch)
        table.maintain()
    entries = table.current()[1]["entries"]
    assert ids_of(read_table(spark, path)) == list(range(30))
    assert len(entries) <= 2 * 3 + 2 and len(table.versions()) <= 6
    assert len(glob.glob(f"{path.removeprefix('file://')}/__rows=*")) <= len(entries) + 3 * 4        # those of the kept versions


def test_a_repeated_append_takes_the_place_of_the_first(spark):
    table = VersionedTable(spark, new_path(spark, "v"), fan=2)
    for epoch, ids in [(0, (1,)), (1, (2, 3)), (1, (4,)), (2, (5,))]:
        table.append(numbers(spark, *ids), "q", epoch)
        table.compact()
    table.append(numbers(spark, 6), "q", 2)
    table.append(numbers(spark, 7), "other", 0)
    assert ids_of(table.read()) == [1, 4, 6, 7]
    assert ids_of(table.read(without=("q", 2))) == [1, 4, 7]
    assert table.read().where("id = 7").first().epoch > table.read().where("id = 6").first().epoch


def test_a_reader_keeps_its_version_while_the_table_is_merged(spark):
    table = VersionedTable(spark, new_path(spark, "v"), fan=2, keep=50)
    for epoch in range(5):
        table.append(numbers(spark, epoch), "q", epoch)
    version, reader = table.current()[0], table.read()
    seen, stop = [], threading.Event()

    def watch():
        while not stop.is_set():
            seen.append(ids_of(table.read()))

    watcher = threading.Thread(target=watch)
    watcher.start()
    for epoch in range(5, 9):
        table.append(numbers(spark, epoch), "q", epoch)
        table.maintain()
    stop.set()
    watcher.join()
    assert ids_of(reader) == ids_of(table.read(version)) == [0, 1, 2, 3, 4]
    assert seen and all(s == list(range(len(s))) for s in seen)       # never a part of a batch, never a row twice


def test_two_writers_lose_nothing(spark):
    path = new_path(spark, "v")

    def write(name, ids):
        for epoch, i in enumerate(ids):
            VersionedTable(spark, path).append(numbers(spark, i), name, epoch)

    writers = [threading.Thread(target=write, args=(n, ids)) for n, ids in (("a", range(6)), ("b", range(6, 12)))]
    for w in writers:
        w.start()
    for w in writers:
        w.join()
    assert ids_of(read_table(spark, path)) == list(range(12))


def test_folding_keeps_the_newest_row_of_a_key(spark):
    table = VersionedTable(spark, new_path(spark, "v"), fold=lambda df: latest_by(df, ["id"], F.col("epoch")), fan=2)
    for epoch in range(9):
        table.append(spark.createDataFrame([(1, epoch), (epoch % 3 + 2, epoch)], "id int, n int").coalesce(1), "q", epoch)
        table.compact()
    rows = latest_by(table.read(), ["id"], F.col("epoch")).collect()
    assert {r.id: r.n for r in rows} == {1: 8, 2: 6, 3: 7, 4: 8}
    assert table.read().count() < 18


# ------------------------------------------------------------------ ids

def test_filters_know_all_their_ids_and_few_others():
    rng = np.random.default_rng(3)
    h, g = rng.integers(0, 2**63, (2, 20_000)).astype(np.uint64)
    bits = build_filter(h[:2000], g[:2000])
    assert may_hold(bits, h[:2000], g[:2000]).all()
    assert may_hold(bits, h[2000:], g[2000:]).sum() <= 5
    assert len(bits) == 6000


def events(spark, ids, day="2024-01-05"):
    return spark.createDataFrame([(f"e{i}", day) for i in ids], "event_id string, day string").select("event_id", F.col("day").cast("timestamp").alias("timestamp"))


def test_only_buckets_that_may_hold_an_id_are_opened(spark):
    ids = IdStore(spark, new_path(spark, "ids"), buckets=16)
    for epoch in range(3):
        ids.append(events(spark, range(100 * epoch, 100 * epoch + 100), f"2024-01-0{epoch + 1}"), "q", epoch)
    assert ids.known(events(spark, range(1000, 1200))).count() == 0
    found = ids.known(events(spark, [5, 250, 250, 1001]))
    assert sorted(r.event_id for r in found.collect()) == ["e250", "e5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    maybe = ids.candidates(events(spark, [5, 250, 1001])).collect()
    assert len({r.bucket for r in maybe}) <= 3 < 16
    assert "PartitionFilters: [bucket#" in plan and "event_day" in plan.split("PushedFilters")[1][:200]


def test_ids_stay_known_when_folders_are_merged(spark):
    ids = IdStore(spark, new_path(spark, "ids"), buckets=4)
    ids.table.fan = 2
    for epoch in range(6):
        ids.append(events(spark, range(10 * epoch, 10 * epoch + 10)), "q", epoch)
    assert any(e["level"] for e in ids.table.current()[1]["entries"])
    assert ids.known(events(spark, range(200))).count() == 60
    assert ids.known(events(spark, range(200)), without=("q", 5)).count() == 50


def test_ids_of_a_day_only(spark):
    ids = IdStore(spark, new_path(spark, "ids"), buckets=4)
    ids.append(events(spark, range(10)), "q", 0)
    assert ids.known(events(spark, range(10)), days=("2024-01-06", "2024-01-09")).count() == 0
    assert ids.known(events(spark, [])).count() == 0
    nulls = spark.createDataFrame([(None, None)], "event_id string, timestamp timestamp")
    assert ids.known(nulls).count() == 0


# ------------------------------------------------------------------ streams

def event(n, day="2024-01-05", **more):
    return {**VALID, "eventId": f"{n:08x}" + VALID["eventId"][8:], "timestamp": f"{day}T10:00:00Z", **more}


@pytest.fixture
def ingest(spark):
    root, source = new_path(spark, "i"), new_path(spark, "src")
    paths = {n: f"{root}/{n}" for n in ("events", "rejected", "devices", "feed", "invalidated")}

    def send(*rows, checkpoint="cp"):
        spark.createDataFrame([(json.dumps(e),) for e in rows], "value string").coalesce(1).write.mode("append").text(source)
        jobs.ingest_stream(spark.readStream.text(source), paths, f"{root}/{checkpoint}", ingested_at="2024-02-01", versioned=True,
                           buckets=4).awaitTermination()
    send.root, send.paths = root, paths
    return send


def test_versioned_ingest_over_several_batches(spark, ingest):
    ingest(event(1), event(1), event(2), {**event(3), "action": "HACK"})
    ingest(event(2, "2024-01-02"), event(4, "2024-01-06", userHint="zoe"))       # 2 is known, though on another day
    ingest(event(5), checkpoint="another")                                       # reads everything from the start
    rows = read_table(spark, ingest.paths["events"]).collect()
    assert sorted(r.event_id[:8] for r in rows) == [f"{n:08x}" for n in (1, 2, 4, 5)]
    assert jobs.live_feed(spark, ingest.paths["feed"], VALID["orgId"]).count() == 4
    devices = jobs.latest_rows(spark, ingest.paths["devices"], "id").collect()
    assert [(d.id, d.user_hint) for d in devices] == [(VALID["deviceId"], "zoe")]
    assert {str(r.day) for r in read_table(spark, ingest.paths["invalidated"]).collect()} == {"2024-01-05", "2024-01-06"}


def test_versioned_ingest_batch_repeated_after_a_crash(spark, ingest):
    ingest(event(1), event(2))
    commits = f"{ingest.root}/cp/commits".removeprefix("file://")
    for name in os.listdir(commits):
        os.remove(f"{commits}/{name}")
    ingest(event(3))
    assert sorted(r.event_id[:8] for r in read_table(spark, ingest.paths["events"]).collect()) == [f"{n:08x}" for n in (1, 2, 3)]
    assert jobs.live_feed(spark, ingest.paths["feed"], VALID["orgId"]).count() == 3


def test_a_late_event_refreshes_one_day(spark, ingest):
    out, now = f"{ingest.root}/rollup", "2024-02-03 12:00:00"
    ingest(event(1, "2023-12-01"), event(2, "2024-01-10"), event(3, "2024-01-11"), event(4, "2024-02-03"))
    paths = (ingest.paths["events"], ingest.paths["invalidated"], out)
    days = rollup.refresh(spark, *paths, now)
    assert [str(d) for d in days] == ["2024-01-10", "2024-01-11"]        # whole days from 30 days to an hour ago
    assert rollup.refresh(spark, *paths, now) == []
    ingest(event(5, "2024-01-10"))
    before = {f for f in rollup.rolled_up(spark, out).inputFiles() if "2024-01-11" in f}
    assert [str(d) for d in rollup.refresh(spark, *paths, now)] == ["2024-01-10"]
    assert before == {f for f in rollup.rolled_up(spark, out).inputFiles() if "2024-01-11" in f}
    assert {str(r.day): r.n for r in rollup.rolled_up(spark, out).collect()} == {"2024-01-10": 2, "2024-01-11": 1}
    whole = {str(r.day): r.n for r in rollup.current(spark, *paths).collect()}
    assert whole == {"2023-12-01": 1, "2024-01-10": 2, "2024-01-11": 1, "2024-02-03": 1}
    assert [str(d) for d in rollup.refresh(spark, *paths, "2024-02-04 02:00:00")] == ["2024-02-03"]
