import random

import pytest
from pyspark.sql import functions as F

from model import Model, fnv6
from samples import FIRING
from veilspark.functions.placeholders import fnv1a6, mint
from veilspark.operators import scan, vault as vt
from veilspark.rules import compile_rules, default_rules
from veilspark.rules.pack import pack_document
from veilspark.session import store

EMAIL = {"id": "email", "kind": "regex", "pattern": r"[\w.%+-]+@[\w.-]+\.[A-Za-z]{2,}"}
WARN = {"id": "codename", "kind": "words", "action": "warn", "words": ["Bluebird"]}
BLOCK = {"id": "secret", "kind": "words", "action": "block", "words": ["Project Titan"]}


def pipeline(spark, texts, rules, salt="s", sessions=None):
    rows = [(i, t, (sessions or ["x"] * len(texts))[i], i) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id int, text string, session string, `order` int").repartition(3)
    found = store(scan.evaluate(df, "text", rules), "found")
    vault = store(vt.build_vault(vt.values_to_replace(found, "session", "order"), salt), "vault")
    done = store(vt.plan(vt.anonymize(found, vault, salt)), "done")
    return found, vault, done


def reference_session(texts, model, salt):
    """Sequential restatement: one map per session, first label wins, collisions numbered."""
    forward, back, out = {}, {}, []
    for text in texts:
        found = model.findings(text)
        decision = model.decision(found)
        if decision == "block":
            out.append("")
            continue
        result, at = "", 0
        for _, a, b, value, action, _, label in found:
            if action != "anonymize":
                continue
            if value not in back:
                base, n = fnv6(f"{salt}:{value}"), 1
                name = f"[{label}_{base}]"
                while name in forward:
                    n += 1
                    name = f"[{label}_{base}_{n}]"
                forward[name], back[value] = value, name
            result += text[at:a] + back[value]
            at = b
        out.append(result + text[at:])
    return out, forward


def test_hash(spark):
    values = ["", "abc", "s:john@acme.com", "é中𝒳", "x" * 300]
    df = spark.createDataFrame([(v,) for v in values], "v string").select("v", fnv1a6(F.col("v")), mint(F.lit("L"), F.col("v"), F.lit("z")))
    for v, h, m in df.collect():
        assert h == fnv6(v) and m == f"[L_{fnv6('z:' + v)}]"


def test_corpus_equals_sequential_session(spark):
    rng = random.Random(1)
    parts = list(FIRING.values())
    texts = [" ; ".join(rng.choice(parts) for _ in range(4)) for _ in range(120)]
    _, vault, done = pipeline(spark, texts, default_rules())
    expected, forward = reference_session(texts, Model(pack_document()), "s")
    got = {r.doc_id: r.result for r in done.collect()}
    assert [got[i] for i in range(len(texts))] == expected
    entries = {r.placeholder: r.value for r in vault.collect()}
    assert entries == forward and len(set(entries.values())) == len(entries)


def test_first_label_wins_across_documents(spark):
    rules = compile_rules({"rules": [
        {"id": "a", "kind": "regex", "placeholder": "A", "pattern": r"(?<=a:)\w+"},
        {"id": "b", "kind": "regex", "placeholder": "B", "pattern": r"(?<=b:)\w+"}]})
    texts = ["b:rose", "a:rose b:lily", "a:lily a:rose"]
    _, vault, done = pipeline(spark, texts, rules)
    results = {r.doc_id: r.result for r in done.collect()}
    rose, lily = f"[B_{fnv6('s:rose')}]", f"[B_{fnv6('s:lily')}]"
    assert results == {0: f"b:{rose}", 1: f"a:{rose} b:{lily}", 2: f"a:{lily} a:{rose}"}
    assert vt.exceptions(vault).count() == 2
    shown = vt.reveal(done.withColumnRenamed("result", "r"), vault, text_col="r")
    assert {r.doc_id: r.revealed for r in shown.collect()} == dict(enumerate(texts))


def test_collisions_are_numbered(spark):
    entries = spark.createDataFrame(
        [("s", "L", "aaaaaa", (3, 0), "c"), ("s", "L", "aaaaaa", (1, 5), "b"), ("s", "L", "aaaaaa", (1, 2), "a"),
         ("s", "M", "aaaaaa", (9, 0), "d"), ("t", "L", "aaaaaa", (9, 0), "e")],
        "session string, label string, base string, first_seen struct<order:int,start:int>, value string")
    got = {r.value: r.number for r in vt.number_collisions(entries).collect()}
    assert got == {"a": 1, "b": 2, "c": 3, "d": 1, "e": 1}


def test_collision_suffix_reaches_texts(spark, monkeypatch):
    """Force equal hashes: the second and third value get _2 and _3 in the texts."""
    monkeypatch.setattr(vt, "base_of", lambda value, salt: F.lit("abcdef"))
    monkeypatch.setattr(vt, "mint", lambda label, value, salt: F.concat(F.lit("["), label, F.lit("_abcdef]")))
    texts = ["a@x.com b@x.com", "c@x.com a@x.com"]
    _, vault, done = pipeline(spark, texts, compile_rules({"rules": [EMAIL]}))
    assert {r.doc_id: r.result for r in done.collect()} == {
        0: "[EMAIL_abcdef] [EMAIL_abcdef_2]", 1: "[EMAIL_abcdef_3] [EMAIL_abcdef]"}
    shown = vt.reveal(done, vault, text_col="result")
    assert {r.doc_id: r.revealed for r in shown.collect()} == dict(enumerate(texts))


def test_plans(spark):
    rules = compile_rules({"rules": [EMAIL, WARN, BLOCK]})
    texts = ["just a normal sentence", "a@x.com then b@x.com then a@x.com", "the Bluebird flies",
             "Project Titan — john@acme.com", "Bluebird — john@acme.com", None]
    found, vault, done = pipeline(spark, texts, rules)
    rows = {r.doc_id: r for r in done.collect()}
    assert [rows[i].outcome for i in range(6)] == ["clean", "pseudonymised", "warned", "blocked", "pseudonymised", "clean"]
    a, b, john = (f"[EMAIL_{fnv6('s:' + v)}]" for v in ("a@x.com", "b@x.com", "john@acme.com"))
    assert [rows[i].result for i in range(6)] == [texts[0], f"{a} then {b} then {a}", texts[2], "", f"Bluebird — {john}", None]
    assert {r.value for r in vault.collect()} == {"a@x.com", "b@x.com", "john@acme.com"}
    reps = {(r.doc_id, r.value): (r["count"], r.label, r.placeholder) for r in vt.replacements(found, vault).collect()}
    assert reps[(1, "a@x.com")] == (2, "EMAIL", a) and reps[(1, "b@x.com")][0] == 1 and len(reps) == 3
    log = {r.doc_id: r for r in vt.detections(found, service=F.lit("chatgpt"), ts=F.lit("2024-01-01").cast("timestamp")).collect()}
    assert {i: r.action for i, r in log.items()} == {1: "anonymized", 2: "warned", 3: "blocked", 4: "anonymized"}
    assert log[1].total == 3 and [tuple(f) for f in log[1].findings] == [("email", "medium", 3)]
    counts = {r.doc_id: r.replaced for r in vt.reveal_counts(done, vault, text_col="result").collect()}
    assert counts[1] == 3 and counts[4] == 1 and counts[0] == 0


def test_sessions_do_not_share(spark):
    rules = compile_rules({"rules": [EMAIL]})
    _, vault, done = pipeline(spark, ["a@x.com", "a@x.com"], rules, sessions=["p", "q"])
    assert vault.count() == 2
    other = done.withColumn("session", F.lit("nobody"))
    assert {r.revealed for r in vt.reveal(other, vault, text_col="result").collect()} == {f"[EMAIL_{fnv6('s:a@x.com')}]"}


def test_existing_vault_keeps_placeholders(spark):
    shape = "session string, `order` int, start int, value string, label string"
    first = spark.createDataFrame([("s", 1, 0, "v1", "A"), ("s", 2, 0, "v2", "A")], shape)
    old = store(vt.build_vault(first, "z"), "v")
    again = spark.createDataFrame([("s", 0, 0, "v3", "A"), ("s", 0, 1, "v1", "B")], shape)
    new = vt.extend_vault(again, "z", old, 1)
    before, after = ({r.value: r.placeholder for r in v.collect()} for v in (old, new))
    assert set(after) == {"v1", "v3"} and after["v1"] == before["v1"]
    assert {r.value: r.generation for r in new.collect()} == {"v1": 0, "v3": 1}


def test_new_values_are_numbered_after_the_taken_ones(spark, monkeypatch):
    monkeypatch.setattr(vt, "base_of", lambda value, salt: F.lit("abcdef"))
    shape = "session string, `order` int, start int, value string, label string"
    old = store(vt.build_vault(spark.createDataFrame([("s", 1, 0, "v1", "A"), ("s", 2, 0, "v2", "A")], shape), "z"), "v")
    new = vt.extend_vault(spark.createDataFrame([("s", 9, 0, "v4", "A"), ("s", 8, 0, "v3", "A"), ("s", 8, 1, "v2", "B"),
                                                 ("s", 8, 2, "v5", "B")], shape), "z", old, 1)
    assert {r.value: r.placeholder for r in new.collect()} == {
        "v2": "[A_abcdef_2]", "v3": "[A_abcdef_3]", "v4": "[A_abcdef_4]", "v5": "[B_abcdef]"}


def test_cap_keeps_newest(spark):
    found = spark.createDataFrame([("s", i, 0, f"v{i}", "A") for i in range(20)] + [("t", 0, 0, "w", "A")],
                                  "session string, `order` int, start int, value string, label string")
    kept = vt.cap_vault(vt.build_vault(found, "z"), 5)
    assert {r.value for r in kept.collect()} == {"w", *(f"v{i}" for i in range(15, 20))}


def test_lookup_with_hot_keys(spark):
    """Half of all rows on one key: same result as a plain join."""
    rows = spark.createDataFrame([(i, "hot" if i % 2 else f"k{i % 97}") for i in range(4000)], "id int, key string")
    vault = spark.createDataFrame([("hot", 1, 10 ** 6)] + [(f"k{i}", i, 5) for i in range(90)], "key string, v int, uses bigint")
    got = {r.id: r.v for r in vt.lookup(rows, vault, ["key"], ["v"], "id").collect()}
    want = {r.id: r.v for r in rows.join(vault, "key", "left").collect()}
    assert got == want and len(got) == 4000


@pytest.mark.parametrize("text, spans, result", [
    ("4242 4242 4242 4242", [(0, 19, "[C]"), (5, 9, "[N]")], "[C]"), ("abc", [], "abc"), ("abc", [(0, 1, "X"), (2, 3, "Y")], "XbY"),
])
def test_replace_skips_overlaps(spark, text, spans, result):
    df = spark.createDataFrame([(text, spans)], "t string, s array<struct<start:int,end:int,put:string>>")
    assert df.select(vt.replace_spans(F.col("t"), F.col("s"))).first()[0] == result


def test_stored_hidden_texts_do_not_move_when_revealed(spark):
    docs = spark.createDataFrame([(i, "s", f"card [CARD_{i % 7:06x}] and [NO_000000]") for i in range(200)] + [(None, "s", "x"), (3, "s", "twice")],
                                 "doc_id int, session string, anonymized string")
    vault = spark.createDataFrame([("s", f"v{k}", f"[CARD_{k:06x}]", 30) for k in range(7)], "session string, value string, placeholder string, uses long")
    hidden = vt.store_hidden(docs)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        back = vt.reveal(hidden, vault)
        plan = back._jdf.queryExecution().executedPlan().toString()
        rows = {(r.doc_id, r.revealed) for r in back.collect()}
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert rows == {(i, f"card v{i % 7} and [NO_000000]") for i in range(200)} | {(None, "x"), (3, "twice")}
    join = plan[plan.index("SortMergeJoin"):]
    left = join[:join.index("Bucketed: true")]
    assert "Exchange" not in left and "anonymized" in left
