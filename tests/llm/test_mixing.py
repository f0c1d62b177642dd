import math
from collections import defaultdict
from hashlib import md5

import pytest

from veilspark.llm import mixing
from veilspark.llm.queries import op11_mixing


def brute_targets(sizes, ratios=(3, 1, 2), share=1.5, cap=2.0):
    """Shares the excess of full sources again and again until none is above its cap."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: ratios[i % len(ratios)] for i, s in enumerate(names)}
    target, free, left = dict.fromkeys(names, 0.0), set(names), share * sum(sizes.values())
    while left > 1e-9 and free:
        total = sum(weight[s] for s in free)
        for s in free:
            target[s] += left * weight[s] / total
        left = 0.0
        for s in sorted(free, key=names.index):
            if target[s] > cap * sizes[s]:
                left += target[s] - cap * sizes[s]
                target[s] = cap * sizes[s]
                free = free - {s}
    return target


def brute_mix(rows, **options):
    """rows: (id, source, size, weight). A list of (id, size, taken), sorted."""
    sizes = defaultdict(int)
    for _, source, size, _ in rows:
        sizes[source] += max(size or 0, 0)
    target, out = brute_targets(sizes, **options), []
    for source in sizes:
        def key(row):
            name = "" if row[0] is None else str(row[0])
            w = 1.0 if row[3] is None or math.isnan(row[3]) else min(row[3], 1e12)
            u = (int(md5(name.encode()).hexdigest()[:13], 16) + 0.5) / 2**52
            return (-math.log(u) / w if w > 0 else math.inf, name, max(row[2] or 0, 0))
        epochs = int(target[source] // sizes[source]) if sizes[source] else 0
        rest, before = target[source] - epochs * sizes[source], 0
        for row in sorted((r for r in rows if r[1] == source), key=key):
            size = max(row[2] or 0, 0)
            out.append((row[0], size, size * (epochs + (2 * (rest - before) > size))))
            before += size
    return sorted(out, key=str)


def mixed(frame, rows, **options):
    docs = frame(rows, "doc_id long, source string, size long, w double")
    found = mixing.mix(docs, weight_col="w", **options)
    return sorted(((r["doc_id"], r["size"] if r["size"] and r["size"] > 0 else 0, r["taken"]) for r in found.collect()), key=str)


def test_word_count(frame):
    texts = ["a  b\tc\n", None, "", " \x0b\x0c\r ", " x y", "x" * 100_000 + " y"]
    found = frame(list(enumerate(texts))).select("doc_id", mixing.word_count("text").alias("n")).collect()
    assert {r["doc_id"]: r["n"] for r in found} == {0: 3, 1: 0, 2: 0, 3: 0, 4: 2, 5: 2}


def test_targets_share_what_full_sources_leave(frame):
    sizes = {"a": 10, "b": 1000, "c": 7, None: 400, "d": 90}
    found = mixing.targets(frame([(s, n) for s, n in sizes.items()], "source string, source_size long")).collect()
    assert {r["source"]: r["target"] for r in found} == pytest.approx(brute_targets(sizes))
    assert sum(r["target"] for r in found) == pytest.approx(1.5 * sum(sizes.values()))


def test_small_table_is_brute_force(frame):
    rows = [(i, ["x", "y", None, "z"][i * i % 4 if i % 3 else 0], (i * 37) % 91, [1.0, 2.0, 0.5, None, 0.0, float("nan")][i % 6])
            for i in range(300)]
    rows += [(None, "y", 12, 1.0), (5, "y", None, 1.0), (6, "y", -4, 1.0), (7, "y", 5000, -1.0)]
    assert mixed(frame, rows) == brute_mix(rows)


def test_repeated_rows_are_cut_exactly_and_alike_for_any_partitioning(frame):
    rows = [(1, "a", 10, 1.0)] * 120 + [(i, "a", 3, 1.0) for i in range(2, 30)] + [(i, "b", 50, 1.0) for i in range(100, 104)]
    docs = frame(rows, "doc_id long, source string, size long, w double")
    found = []
    for parts in (1, 7):
        result = mixing.mix(docs.repartition(parts)).select("doc_id", "size", "taken").collect()
        found.append(sorted(map(tuple, result), key=str))
    assert found[0] == found[1] == brute_mix(rows)


def test_empty_tables_and_clashing_columns(frame):
    assert mixed(frame, []) == []
    assert [r[2] for r in mixed(frame, [(1, "a", 0, 1.0), (2, None, None, None)])] == [0, 0]
    docs = frame([(1, "a", 4, "t", 9, "k", "p", 7.0)], "doc_id long, source string, size long, text string, taken long, key string, place string, target double")
    row = mixing.mix(docs).collect()[0].asDict()
    assert row == {"doc_id": 1, "source": "a", "size": 4, "text": "t", "key": "k", "place": "p", "source_size": 4, "target": 6.0,
                   "repeats": 1, "taken": 4}


def test_heavier_documents_are_preferred(frame):
    rows = [(i, "a" if i % 2 else "b", 10, 8.0 if i % 4 < 2 else 0.1) for i in range(2000)]
    taken = {r[0]: r[2] for r in mixed(frame, rows, share=0.5)}
    heavy = sum(taken[i] for i in range(2000) if i % 4 < 2)
    assert heavy > 0.9 * sum(taken.values()) and sum(taken.values()) == pytest.approx(10_000, abs=20)


def test_query_meets_its_targets(spark, sf):
    rows = op11_mixing(spark, sf).collect()
    taken, target, most = defaultdict(int), {}, defaultdict(int)
    for r in rows:
        key = (r["source_size"], r["target"])
        taken[key] += r["taken"]
        target[key], most[key] = r["target"], max(most[key], r["size"])
        assert r["taken"] % max(r["size"], 1) == 0 and r["taken"] <= 2 * r["size"]
    assert all(abs(taken[k] - target[k]) <= most[k] / 2 for k in target)
