import random
import re
from collections import defaultdict

import pytest

from veilspark.llm import components as C
from veilspark.llm import near_dedup as N
from veilspark.llm.queries import QUERIES

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingled(text):
    w = WORD.findall((text or "").translate(LOWER))
    return [tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))] if w else []


def matched(a, b):
    """Longest common subsequence, plainly."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], last + 1 if x == y else max(row[j], row[j - 1])
    return row[-1]


def brute_groups(docs, threshold=0.8):
    seqs, at = {i: shingled(t) for i, t in docs}, defaultdict(set)
    for i, s in seqs.items():
        for x in set(s):
            at[x].add(i)
    parent = {i: i for i in seqs}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = {(a, b) for ids in at.values() for a in ids for b in ids if a < b}
    for a, b in pairs:
        n, m = len(seqs[a]), len(seqs[b])
        if min(n, m) >= threshold * max(n, m) and len(set(seqs[a]) & set(seqs[b])) > 0.3 * min(n, m):
            k = matched(seqs[a], seqs[b])
            if k >= threshold * (n + m - k) - 1e-9:
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {i: find(i) for i in seqs}


def test_query_finds_the_groups_of_brute_force(spark, sf, docs):
    rows = QUERIES["op1_near_dedup"](spark, sf).collect()
    assert {r["doc_id"]: r["group_id"] for r in rows} == brute_groups(docs)
    assert len(rows) == len(docs) and all(r["kept"] == (r["doc_id"] == r["group_id"]) for r in rows)


@pytest.mark.parametrize("seed", range(4))
def test_banded_alignment(seed):
    rng = random.Random(seed)
    for _ in range(300):
        a = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        b = [rng.randint(0, 6) for _ in range(rng.randint(0, 40))]
        assert N.aligned(a, b, 50) == matched(a, b)
        n, m, k = len(a), len(b), matched(a, b)
        assert N.similar(a, b, 0.5) == (bool(n and m) and k >= 0.5 * (n + m - k))


def test_long_alignment_crosses_blocks():
    rng = random.Random(9)
    a = [rng.randint(0, 300) for _ in range(1500)]
    b = list(a)
    for _ in range(25):
        b.insert(rng.randrange(len(b)), -1)
        del b[rng.randrange(len(b))]
    assert N.aligned(a, b, 60) == matched(a, b)


def edited(words, rng, share):
    return [f"x{rng.random()}" if rng.random() < share else w for w in words]


def test_a_large_group_of_near_copies_is_one_group(frame, monkeypatch):
    monkeypatch.setattr(N, "SMALL", 6)          # so that the buckets here are compared in blocks
    monkeypatch.setattr(N, "BLOCK", 16)
    rng = random.Random(5)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(120)]
    rows = [(i, " ".join(edited(base, rng, 0.016))) for i in range(50)]
    rows += [(1000 + i, " ".join(f"v{rng.randint(0, 5000)}" for _ in range(90))) for i in range(10)]
    want = brute_groups(rows)
    got = {r["doc_id"]: r["group_id"] for r in N.near_duplicates(frame(rows)).collect()}
    assert all(got[i] >= want[i] for i in got)              # no link that is none
    assert sum(got[i] != want[i] for i in got) <= 1         # a pair just above the threshold may share no band
    assert 1 < len({want[i] for i in range(50)}) < 25


def test_moved_parts_are_no_near_duplicate(frame):
    a, b = " ".join(f"a{k}" for k in range(100)), " ".join(f"b{k}" for k in range(100))
    got = {r["doc_id"]: r["group_id"] for r in N.near_duplicates(frame([(1, f"{a} {b}"), (2, f"{b} {a}"), (3, f"{a}, {b.upper()}!")])).collect()}
    assert got == {1: 1, 2: 2, 3: 1}


def test_edges(frame):
    text = " ".join(f"w{k}" for k in range(50))
    rows = [(5, text, "x"), (3, text.upper(), "x"), (3, text.upper(), "x"), (7, None, "x"), (8, None, "x"), (9, "", None), (10, "...", None),
            (None, text, "x"), (11, "one two", "x"), (12, "one  TWO", "x"), (13, "one", "x"), (14, "word " * 30000, "x"), (15, "word " * 30000 + "end", "x")]
    got = N.near_duplicates(frame(rows, "doc_id long, text string, version string")).collect()
    assert len(got) == len(rows)
    groups = {r["doc_id"]: (r["group_id"], r["kept"]) for r in got}
    assert groups == {5: (3, False), 3: (3, True), 7: (7, True), 8: (8, True), 9: (9, True), 10: (10, True), None: (None, True),
                      11: (11, True), 12: (11, False), 13: (13, True), 14: (14, True), 15: (14, False)}
    assert N.near_duplicates(frame([])).count() == 0
    with pytest.raises(ValueError):
        N.near_duplicates(frame([]), threshold=0)


def test_components_of_few_links_need_no_steps(spark, monkeypatch):
    rng = random.Random(3)
    links = [(i, i + 1) for i in range(0, 200)] + [(rng.randint(300, 800), rng.randint(300, 800)) for _ in range(400)] + [(7, 7), (200, 0), (0, 200)]
    least = {i: i for pair in links for i in pair}
    for _ in range(len(least)):
        for u, v in links:
            least[u] = least[v] = min(least[u], least[v])
    want = {(i, c) for i, c in least.items() if i != 7 or c != 7}
    stored = []
    monkeypatch.setattr(C, "store", lambda df, name="stage", made=C.store: stored.append(name) or made(df, name))
    made = spark.createDataFrame(links, "u long, v long").repartition(7)
    assert {tuple(r) for r in C.components(made).collect()} == want and len(stored) <= 2
    monkeypatch.setattr(C, "PART", 50)                      # in parts, the rest by steps
    found = [tuple(r) for r in C.components(made).collect()]
    assert set(found) == want and len(found) == len(want)
    assert C.components(made.where("u < 0")).count() == 0
