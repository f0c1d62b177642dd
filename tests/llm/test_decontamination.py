import re

import pytest

from veilspark.llm import decontamination as D
from veilspark.llm.queries import QUERIES, SQL

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words(text):
    return WORD.findall((text or "").translate(LOWER))


def brute(docs, items, window=13):
    out = {}
    for i, text in docs:
        w, hit, found = words(text), set(), set()
        for item, other in items:
            v = words(other)
            n = min(window, len(v))
            spans = {tuple(v[p:p + n]) for p in range(len(v) - n + 1)} if n else set()
            for p in range(len(w) - n + 1):
                if spans and tuple(w[p:p + n]) in spans:
                    hit.update(range(p, p + n))
                    found.add(str(item))
        out[i] = (len(w), len(hit), len(found), ",".join(sorted(found)), bool(hit) and 20 * len(hit) >= len(w))
    return out


def test_query_is_its_sql(spark, sf, duck):
    frame = QUERIES["op2_decontamination"](spark, sf)
    want = duck.execute(SQL["op2_decontamination"])
    names = [c[0] for c in want.description]
    rows = sorted(tuple(r[n] for n in names) for r in frame.collect())
    assert rows == sorted(want.fetchall()) and any(r[2] for r in rows)


ITEM = " ".join(f"w{k}" for k in range(30))
SHARED = [
    (1, ITEM), (2, "x " + " ".join(f"W{k}" for k in range(5, 18)) + " y"), (3, " ".join(f"w{k}" for k in range(12)) + " z"),
    (4, " ".join(f"w{k}" for k in range(13)) + " gap " + " ".join(f"w{k}" for k in range(12, 29))), (5, None), (6, ""),
    (7, "short item"), (8, "a short item here, SHORT-ITEM!"), (9, "single"), (10, f"{ITEM} {ITEM} tail {ITEM}"),
    (11, "pad " * 400 + "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10 w11 w12"), (12, "rep " * 40), (13, "é" * 20 + " " + ITEM.replace("w", "W")),
    (14, "long " * 50000 + ITEM)]
ITEMS = [(1, ITEM), (2, " ".join(f"w{k}" for k in range(20)) + " other end"), (3, "short item"), (4, "single"), (5, None), (6, " .. "),
         (7, "rep " * 15), (1, "one two three")]


def digest(rows):
    return {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in rows}


def test_every_kind_of_window(frame, spark):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    rows = D.contamination(frame(SHARED), items).collect()
    want = {i: (a, b, c, e) for i, (a, b, c, _, e) in brute(SHARED, ITEMS).items()}
    assert digest(rows) == want


@pytest.mark.parametrize(("window", "k"), [(13, 13), (13, 1), (5, 2), (3, 3)])
def test_other_sizes(frame, spark, window, k):
    docs, items = SHARED[:-1], [i for i in ITEMS if i[0] != 6]
    rows = D.contamination(frame(docs), spark.createDataFrame(items, "item_id long, text string"), window=window, k=k).collect()
    assert digest(rows) == {i: (a, b, c, e) for i, (a, b, c, _, e) in brute(docs, items, window).items()}


def test_short_items_of_every_length_are_found_everywhere(frame, spark):
    """Also those of exactly k words, which winnowing would keep at window minima only."""
    items = [(n, " ".join(f"s{n}_{j}" for j in range(n))) for n in range(1, 14)]
    docs = [(100 * n + pad, " ".join([*(f"p{j}" for j in range(pad)), text, *(f"q{j}" for j in range(pad))]))
            for n, text in items for pad in (0, 1, 3, 40)]
    docs.append((9000, items[5][1] + " x " + items[5][1]))
    rows = D.contamination(frame(docs), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert digest(rows) == {i: (a, b, c, e) for i, (a, b, c, _, e) in brute(docs, items).items()}
    assert all(r["n_items"] == 1 for r in rows)


def test_repeated_rows_clashing_columns_and_no_rows(frame, spark):
    items = spark.createDataFrame([(1, ITEM, "a")], "item_id long, text string, hash string")
    rows = [(1, ITEM, "r", "i"), (1, ITEM, "r", "i"), (None, ITEM, None, None)]
    got = D.contamination(frame(rows, "doc_id long, text string, row string, items string"), items).collect()
    assert [r["n_hit"] for r in got] == [30, 30, 30]
    assert D.contamination(frame([]), items).count() == 0
    assert [r["contaminated"] for r in D.contamination(frame([(1, ITEM)]), items.limit(0)).collect()] == [False]
    with pytest.raises(ValueError):
        D.contamination(frame([]), items, k=14)
