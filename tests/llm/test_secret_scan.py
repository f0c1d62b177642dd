import random
import re

from veilspark.llm import secret_scan as S
from veilspark.llm.queries import QUERIES


def test_query_is_a_full_scan(spark, duck):
    sf = "/root/testdata/sf0.01"            # the smallest tables hold no secrets
    docs = duck.execute(f"SELECT doc_id, text FROM '{sf}/documents.parquet'").fetchall()
    rows = {r["doc_id"]: r for r in QUERIES["op10_secret_scan"](spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, text in docs:
        base = S.spans_by_full_scan(text)
        assert rows[i]["base_sha256"] == S.sha256(base)
        assert rows[i]["spans"] == S.spans_by_full_scan(text, S.BASE + S.EXTRA)
        for kind in ("assign", "access", "hex"):
            assert rows[i][f"n_{kind}"] == base.count(kind)
    assert sum(r["n_assign"] + r["n_access"] + r["n_hex"] for r in rows.values()) > 0


def test_queries_of_patterns():
    assert S.trigram_query("abcd") == ("and", (b"abc", b"bcd"))
    assert S.trigram_query("a+b") is None and S.trigram_query("[0-9a-f]+") is None
    assert S.trigram_query("(foo|bar)x*") == ("or", (b"foo", b"bar"))
    assert S.trigram_query("x*(?:foo|a)") is None
    assert {b"pik", b"pi_", b"api", b"swd"} <= S.trigrams_of(S.trigram_query(S.BASE[0].pattern, True))


def matches(query, text):
    if query is None:
        return True
    if isinstance(query, bytes):
        return query in text
    return (all if query[0] == "and" else any)(matches(p, text) for p in query[1])


def test_no_query_loses_a_match():
    rng = random.Random(3)
    patterns = ["ab?c+d", "(abc|bcd){2}", "a(b|cd)?abd", "[ab]cda", "(?:ab){2,3}c", "abc|d", "ABc(?i:d)"]
    for pattern in patterns:
        query, rule = S.trigram_query(pattern), re.compile(pattern)
        for _ in range(3000):
            text = "".join(rng.choice("abcdABD") for _ in range(rng.randint(1, 12)))
            assert not rule.search(text) or matches(query, text.lower().encode())


def test_edges(frame):
    key = "AKIA" + "Z" * 16
    texts = [None, "", "é PASSWORD : 'abc123' token=short api_key=\"A.b-c=9\"", f"x{key} akia{'0' * 16}", "f" * 23 + "g" + "a" * 24,
             "paſſword=abcdef to\u212aen=abcdef", "secret=" + "q" * 300000, "pass\nword=abcdef", "token=abc secret=abcdefg"]
    rows = {r["doc_id"]: r for r in S.digest(S.scan(frame([*enumerate(texts), (0, None)]))).collect()}
    for i, text in enumerate(texts):
        assert rows[i]["base_sha256"] == S.sha256(S.spans_by_full_scan(text)), i
    assert rows[2]["n_assign"] == 2 and rows[2]["spans"].startswith("assign:2:")
    assert (rows[3]["n_access"], rows[4]["n_hex"], rows[5]["n_assign"], rows[6]["n_assign"]) == (1, 1, 0, 1)
    assert rows[8]["n_assign"] == 1
    assert S.scan(frame([])).count() == 0
