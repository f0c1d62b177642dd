from collections import Counter
import random

import pytest
from pyspark.sql import functions as F

from model import Model
from samples import FIRING, LEGAL_NOTE, NOTE, TRICKY
from veilspark.functions import spans
from veilspark.functions.validators import ipv4_ok, jwt_ok, luhn_ok, mask_value
from veilspark.operators import scan
from veilspark.rules import compile_rules, default_rules
from veilspark.rules.pack import pack_document


def run(spark, texts, rules, **kwargs):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string").repartition(4)
    rows = scan.evaluate(df, "text", rules, **kwargs).orderBy("i").collect()
    return [([tuple(f) for f in r.findings], r.decision, r.max_severity) for r in rows]


def test_every_bundled_rule_fires(spark):
    results = run(spark, FIRING.values(), default_rules())
    missing = [rule for rule, (found, _, _) in zip(FIRING, results) if rule not in {f[0] for f in found}]
    assert not missing and len(FIRING) == 69


def mixes(n):
    rng = random.Random(7)
    parts = list(FIRING.values()) + TRICKY + ["le client demeure responsable", "Peux-tu resumer", "\n", "—"]
    for _ in range(n):
        text = rng.choice([" ", "\n", ", ", ""]).join(rng.choice(parts) for _ in range(rng.randint(1, 8)))
        if rng.random() < 0.3:
            cut = rng.randrange(len(text) + 1)
            text = text[:cut] + rng.choice(["", "x", "1", "É", "_"]) + text[cut:]
        yield text


def test_pack_equals_plain_model(spark, sf):
    documents = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts = TRICKY + [NOTE] + list(FIRING.values()) + list(mixes(400)) + documents
    model = Model(pack_document())
    for text, (found, decision, _) in zip(texts, run(spark, texts, default_rules())):
        expected = model.findings(text)
        assert found == expected, text[:300]
        assert decision == model.decision(expected)


def test_note(spark):
    found, decision, severity = run(spark, [NOTE], default_rules())[0]
    assert (decision, severity) == ("anonymize", "critical")
    assert {f[0] for f in found} >= {
        "matter-name", "person-title-fullname", "birth-info", "address-street-first", "phone-be", "email", "nrn-be",
        "iban", "vat-be", "builtin-card", "case-financial-amount", "employee-or-client-id", "builtin-ip", "internal-host"}


def test_whole_note_has_exactly_its_findings(spark):
    found, decision, severity = run(spark, [LEGAL_NOTE], default_rules())[0]
    assert (decision, severity) == ("anonymize", "critical")
    assert Counter(f[0] for f in found) == {
        "matter-name": 1, "person-title-fullname": 1, "birth-info": 1, "address-street-first": 1, "phone-be": 2, "email": 2, "nrn-be": 1,
        "iban": 1, "person-context-explicit": 1, "company-legal-form": 1, "vat-be": 1, "builtin-card": 1, "case-financial-amount": 2,
        "employee-or-client-id": 3, "builtin-ip": 1, "internal-host": 1}
    assert len(found) == 21


def test_clean_prose(spark):
    texts = ["la forêt se renouvelle ainsi en permanence ; le client reste responsable, la prédation est disputée.",
             "Peux-tu m'expliquer la difference entre une clause penale et des arrhes ?"]
    assert run(spark, texts, default_rules()) == [([], None, None)] * 2


def one(kind, **rule):
    return {"id": "r", "kind": kind, **rule}


@pytest.mark.parametrize("doc, text, values, decision", [
    ({"rules": [one("words", words=["Bluebird", "Project Falcon"])]}, "the bluebird and BLUEBIRD fly", ["bluebird", "BLUEBIRD"], "anonymize"),
    ({"rules": [one("words", words=["Bluebird"])]}, "Bluebirds are plural", [], None),
    ({"rules": [one("regex", pattern=r"EMP-\d{5}")]}, "EMP-12345 and EMP-67890", ["EMP-12345", "EMP-67890"], "anonymize"),
    ({"rules": [one("combination", action="warn", all=[one("words", words=["salaire"]), one("regex", pattern=r"\d+\s?k€")])]},
     "le salaire est 45 k€", ["salaire", "45 k€"], "warn"),
    ({"rules": [one("combination", all=[one("words", words=["salaire"]), one("regex", pattern=r"\d+\s?k€")])]},
     "budget de 45 k€", [], None),
    ({"whitelist": ["safe@acme.com"], "rules": [one("regex", pattern=r"[\w.]+@[\w.]+")]},
     "safe@acme.com and other@evil.com", ["other@evil.com"], "anonymize"),
    ({"blacklist": {"values": ["Project Titan"]}, "rules": []}, "we discussed project titan", ["project titan"], "block"),
    ({"rules": [one("regex", pattern="abc def"), {**one("regex", pattern="abc"), "id": "s"}]}, "abc def", ["abc def"], "anonymize"),
    ({"rules": [one("regex", pattern="a*")]}, "baab", ["aa"], "anonymize"),
    ({"rules": [one("regex", pattern=r"(a)(b)\2")]}, "abb ab", ["abb"], "anonymize"),
    ({"rules": [one("regex", pattern=r"x\${2}y")]}, "x$$y", ["x$$y"], "anonymize"),
    ({"rules": [one("regex", pattern=r"'\\'")]}, "a '\\' b", ["'\\'"], "anonymize"),
    ({"rules": [one("words", words=["alpha"], action="warn"), {**one("words", words=["bravo"]), "id": "b"},
                {**one("words", words=["charlie"], action="block"), "id": "c"}]}, "alpha bravo charlie",
     ["alpha", "bravo", "charlie"], "block"),
])
def test_rule_semantics(spark, doc, text, values, decision):
    found, got, _ = run(spark, [text], compile_rules(doc))[0]
    assert [f[3] for f in found] == values and got == decision


def test_severity_independent_of_action(spark):
    rules = compile_rules({"rules": [one("words", words=["nuclear"], action="warn", severity="critical")]})
    assert run(spark, ["the nuclear option"], rules)[0][1:] == ("warn", "critical")


def test_gates(spark):
    rules = compile_rules({"rules": [one("words", words=["x"])]})
    got = run(spark, ["x", " ", "x" + " " * 50, None, ""], rules, max_chars=20)
    assert [len(f) for f, _, _ in got] == [1, 0, 0, 0, 0]


def test_custom_validator(spark):
    import dataclasses
    rules = compile_rules({"rules": [one("regex", pattern=r"\d+")]}, builtins=False)
    even = dataclasses.replace(rules.matchers[0], validate=lambda v: v.cast("int") % 2 == 0)
    got = run(spark, ["1 2 3 44"], dataclasses.replace(rules, matchers=(even,)))
    assert [f[3] for f in got[0][0]] == ["2", "44"]


def test_standalone_span_scans(spark):
    df = spark.createDataFrame([("Ab ab 12 abc",)], "t string")
    row = df.select(
        scan.regex_spans("t", r"\d+").alias("r"), scan.words_spans("t", ["AB"]).alias("w"),
        scan.combination_spans(scan.words_spans("t", ["ab"]), scan.regex_spans("t", "[0-9]")).alias("c"),
        scan.combination_spans(scan.words_spans("t", ["zz"]), scan.regex_spans("t", "[0-9]")).alias("n"),
        scan.blacklist_spans("t", {"blacklist": {"values": ["abc"]}}).alias("b"),
        scan.whitelist_spans("t", {"whitelist": ["12"]}).alias("wl")).first()
    flat = lambda spans_: [tuple(s) for s in spans_]                                    # noqa: E731
    assert flat(row.r) == [(6, 8, "12")] and flat(row.w) == [(0, 2, "Ab"), (3, 5, "ab")]
    assert len(row.c) == 4 and row.n == [] and flat(row.b) == [(9, 12, "abc")] and flat(row.wl) == [(6, 8, "12")]


def test_validators(spark):
    values = {"4242 4242 4242 4242": (True, False), "4242 4242 4242 4243": (False, False), "5": (False, False),
              "192.168.1.1": (None, True), "0.0.0.0": (None, True), "256.1.1.1": (None, False), "01.0.0.1": (None, False),
              "1.2.3": (None, False), "1.2.3.4.5": (None, False), "1.2.3.": (None, False)}
    rows = spark.createDataFrame([(v,) for v in values], "v string").select("v", luhn_ok(F.col("v")), ipv4_ok(F.col("v"))).collect()
    for value, luhn, ip in rows:
        want = values[value]
        assert (want[0] is None or luhn == want[0]) and ip == want[1], value
    tokens = {"eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.x": True, "eyJhbGciOm51bGx9.eyJ9.x": True,
              "eyJ0eXAiOiJKV1QifQ.eyJ9.x": False, "notajwt.at.all": False, "": False}
    got = dict(spark.createDataFrame([(v,) for v in tokens], "v string").select("v", jwt_ok(F.col("v"))).collect())
    assert got == tokens


def test_mask(spark):
    rows = spark.createDataFrame([("abcd",), (" abcde ",), ("a-very-long-value",)], "v string").select(mask_value(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["••••", "ab••e", "a-••••••••e"]


def test_exploded_overlap_twin(spark):
    rng = random.Random(3)
    cands = [(d, s, s + rng.randint(1, 9)) for d in range(8) for s in rng.sample(range(200), 25)]
    whites = [(d, s, s + rng.randint(1, 9)) for d in range(6) for s in rng.sample(range(200), 8)]
    c = spark.createDataFrame(cands, "doc int, start int, end int")
    w = spark.createDataFrame(whites, "doc int, start int, end int")
    got = {tuple(r) for r in scan.drop_overlaps_df(c, w, "doc").collect()}
    assert got == {x for x in cands if not any(x[0] == y[0] and x[1] < y[2] and y[1] < x[2] for y in whites)}


def test_resolve_overlaps_column(spark):
    rng = random.Random(5)
    rows = [[(s, s + rng.randint(1, 12), rng.randint(0, 5)) for s in rng.sample(range(60), 12)] for _ in range(40)]
    df = spark.createDataFrame([(r,) for r in rows], "a array<struct<start:int,end:int,priority:int>>")
    got = df.select(spans.resolve_overlaps(F.col("a"), "struct<start:int,end:int,priority:int>").alias("r")).collect()
    for source, row in zip(rows, got):
        kept, last = [], -1
        for s in sorted(source, key=lambda x: (x[0], x[0] - x[1], x[2])):
            if s[0] >= last:
                kept.append(s)
                last = s[1]
        assert [tuple(x) for x in row.r] == kept


def test_rollup_and_rule_ids(spark):
    df = spark.createDataFrame([(1, "a@x.com 10.0.0.7 b@x.com")], "doc int, text string")
    found = scan.evaluate(df, "text", default_rules())
    assert found.select(spans.rule_ids(F.col("findings"))).first()[0] == ["email", "builtin-ip"]
    assert {tuple(r) for r in scan.finding_rollup(found, "doc").collect()} == {(1, "email", "high", 2), (1, "builtin-ip", "low", 1)}


def test_scan_runs_once_per_text(spark):
    """Exploding or deciding must not duplicate the scan below a pushed filter."""
    df = spark.createDataFrame([("a@x.com", 1)], "text string, n int")
    found = scan.evaluate(df, "text", compile_rules({"rules": []}))
    for later in (scan.explode_findings(found), found.where("decision = 'anonymize'"), found.where("n = 2")):
        plan = later._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count(r"eyJ[A-Za-z0-9_-]+\.eyJ") == 2          # one test, one marking pass
    lines = plan.splitlines()
    assert "Filter" not in lines[0] and any("Filter" in x for x in lines[-2:])      # n = 2 went below the scan
