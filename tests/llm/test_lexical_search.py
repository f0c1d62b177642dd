import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import lexical_search
from veilspark.llm.lexical_search import Best, Lists, Queries, search_block

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(docs, items, top=50):
    """Scores every document for every item; sorted (item, rank, id, score)."""
    bags = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    big_n, total = sum(bool(b) for _, b in bags), sum(b.total() for _, b in bags)
    df = Counter(term for _, b in bags for term in b)
    out = []
    for item, text in items:
        terms, scored = set(TERM.findall((text or "").translate(LOWER))), []
        for i, bag in bags:
            m = 100 - 50 + (50 * bag.total() * big_n) // total if total else 0
            score = sum(math.floor(1000 * math.log((2 * big_n + 2) / (2 * df[t] + 1))) * (1_000_000_000 * bag[t] // (1000 * bag[t] + 20 * m))
                        for t in terms if bag[t])
            if score > 0:
                scored.append((-score, i is None, i))
        out += [(item, k + 1, i, -s) for k, (s, _, i) in enumerate(sorted(scored, key=lambda x: (x[0], x[1], x[2] or 0))[:top])]
    return sorted(out, key=str)


def found(frame, docs, items, **options):
    rows = lexical_search.search(frame(docs).repartition(3), frame(items, "item_id long, text string"), **options)
    return sorted(map(tuple, rows.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture
def corpus():
    rng = random.Random(5)
    words = [f"w{min(int(rng.paretovariate(0.6)), 400)}" for _ in range(20_000)]
    docs = [(i, " ".join(rng.choices(words, k=rng.choice([0, 1, 5, 40, 200])))) for i in range(600)]
    items = [(i, " ".join(rng.choices(words, k=k))) for i, k in enumerate([1, 2, 5, 12, 40, 300])]
    docs += [(600 + i, items[3][1] + " copy") for i in range(150)]          # one large group of equal scores
    docs += [(900, "W1, w2; W3 é" * 5), (901, None), (902, ""), (903, "w7 " * 30_000), (5, "w2 w2 w3"), (5, "w2 w2 w3")]
    items += [(20, None), (21, "..."), (22, "nothing like it"), (23, "é W1"), (3, items[3][1])]
    return docs, items


def test_small_tables_are_brute_force(frame, corpus):
    assert found(frame, *corpus) == brute(*corpus)


def test_many_blocks_of_documents_and_of_queries(frame, corpus, monkeypatch):
    monkeypatch.setattr(lexical_search, "BLOCK_DOCS", 37)
    monkeypatch.setattr(lexical_search, "QUERY_TERMS", 100)
    monkeypatch.setattr(lexical_search, "SALTS", 3)
    assert found(frame, *corpus, top=7) == brute(*corpus, top=7)


def test_null_ids_rank_last_and_names_may_clash(frame):
    docs = frame([(None, "a b", 1), (7, "a b", 2), (9, "c", 3)], "doc_id long, text string, score long")
    items = frame([(None, "a", "x"), (1, "c", "y")], "item_id long, text string, doc_id string")
    rows = lexical_search.search(docs, items).orderBy("item_id", "rank").collect()
    assert [(r["item_id"], r["rank"], r["doc_id"]) for r in rows] == [(None, 1, 7), (None, 2, None), (1, 1, 9)]


@pytest.mark.parametrize(("docs", "items"), [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "a")], [(1, "b")]), ([], [])])
def test_nothing_to_find(frame, docs, items):
    result = lexical_search.search(frame(docs), frame(items, "item_id long, text string"))
    assert result.collect() == [] and result.columns == ["item_id", "rank", "doc_id", "score"]


def block_of(lists, width):
    docs = np.array([d for one in lists for d in sorted(one)], np.int64)
    impact = np.array([one[d] for one in lists for d in sorted(one)], np.int64)
    return Lists(docs, np.cumsum([0, *map(len, lists)]), impact, width)


def test_ranges_of_the_sparse_table():
    rng = random.Random(1)
    lists = [{rng.randrange(200): rng.randrange(50) + 1 for _ in range(n)} for n in (1, 0, 3, 60, 150)]
    block = block_of(lists, 200)
    asked = [(t, a, b) for t in range(len(lists)) for a, b in (sorted(rng.sample(range(201), 2)) for _ in range(200))]
    at, impact = block.greatest(*(np.array(c) for c in zip(*asked, strict=True)))
    for (t, a, b), where, value in zip(asked, at, impact, strict=True):
        inside = {d: v for d, v in lists[t].items() if a <= d < b}
        assert value == max(inside.values(), default=0)
        assert not inside or inside[int(block.docs[where])] == value


def test_most_intervals_are_never_opened():
    rng = random.Random(2)
    width = 20_000
    lists = [{d: rng.randrange(1, 1000) for d in rng.sample(range(width), n)} for n in (30, 80, 400, 15_000)]
    block, weight = block_of(lists, width), np.array([9000, 7000, 4000, 300])
    best = Best(1, 50)
    opened = search_block(block, Queries(np.zeros(4, np.int64), np.arange(4), weight, 1), np.arange(width), best, 1)
    scores = Counter()
    for one, w in zip(lists, weight, strict=True):
        for d, v in one.items():
            scores[d] += int(w) * v
    want = sorted(((-s, d) for d, s in scores.items()))[:50]
    assert [(-s, d) for s, d in zip(best.score, best.id, strict=True)] == want and opened < width / 10
