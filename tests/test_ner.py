from pyspark import TaskContext
from pyspark.sql import functions as F

from veilspark.functions.spans import FINDINGS_TYPE
from veilspark.operators import ner
from veilspark.plans.queries import dictionary_model

TEXT = "Maître Dupont représente Acme à Lyon."
PER, ORG, LOC = ("PER", "Dupont", 7, 13, 0.99), ("ORG", "Acme", 25, 29, 0.95), ("LOC", "Lyon", 32, 36, 0.97)
WITH_LOC = {**ner.DEFAULT_POLICY, "LOC": {**ner.DEFAULT_POLICY["LOC"], "enabled": True, "threshold": 0.5}}


def merged(spark, entities, findings=(), text=TEXT, **kwargs):
    df = spark.createDataFrame([(text, list(findings), list(entities))], f"text string, findings {FINDINGS_TYPE}, entities {ner.ENTITIES_TYPE}")
    df = df.withColumns({"decision": F.lit("kept"), "max_severity": F.lit("kept")})
    return ner.merge_ner(df, **kwargs).first()


def ids(row):
    return [f.rule_id for f in row.findings]


def test_entities_become_findings(spark):
    row = merged(spark, [LOC, PER, ORG], policy=WITH_LOC)
    assert ids(row) == ["ner:PER", "ner:ORG", "ner:LOC"] and (row.decision, row.max_severity) == ("anonymize", "high")
    assert row.findings[0].label == "PERSON"


def test_policy(spark):
    assert ids(merged(spark, [PER, ORG, LOC])) == ["ner:PER", "ner:ORG"]
    assert ids(merged(spark, [(*PER[:4], 0.5), ("MISC", "Acme", 25, 29, 0.99), ("DATE", "Lyon", 32, 36, 0.99),
                              ("PER", "x", 30, 99, 0.99), ("PER", "x", 9, 9, 0.99)])) == []
    warn = {**ner.DEFAULT_POLICY, "ORG": {"enabled": True, "action": "warn", "severity": "low", "label": "ORG", "threshold": 0.5}}
    row = merged(spark, [ORG], policy=warn)
    assert row.decision == "warn" and row.findings[0].label is None
    assert merged(spark, [PER], enabled=False).decision == "kept"


def test_overlaps(spark):
    base = [("email", 7, 13, "Dupont", "anonymize", "high", "EMAIL")]
    assert ids(merged(spark, [PER, LOC], base, policy=WITH_LOC)) == ["email", "ner:LOC"]
    assert ids(merged(spark, [ORG, LOC], policy=WITH_LOC, whitelist=["acme"])) == ["ner:LOC"]
    pair = [("PER", "Jean Dupont", 0, 11, 0.99), ("LOC", "Dupont", 5, 11, 0.70)]
    assert ids(merged(spark, pair, text="Jean Dupont went home", policy=WITH_LOC)) == ["ner:PER"]
    tie = [("LOC", "Jean", 0, 4, 0.90), ("PER", "Jean", 0, 4, 0.95)]
    assert ids(merged(spark, tie, text="Jean Dupont", policy=WITH_LOC)) == ["ner:PER"]


def python_chunks(text, size=1200):
    if len(text) <= size:
        return [(0, text)]
    out, i = [], 0
    while i < len(text):
        end = min(i + size, len(text))
        if end < len(text):
            space = text.rfind(" ", 0, end + 1)
            end = space if space > i + size / 2 else end
        out.append((i, text[i:end]))
        i = end
    return out


def test_chunks(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()]
    texts += ["a" * 5000, "ab " * 2000, "é𝒳 " * 1500, "x" * 1200, "x" * 1201, " " * 3000, "b" * 1200 + " " + "c" * 1200]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for i, chunks in df.select("i", ner.chunk_text(F.col("t"))).collect():
        assert [tuple(c) for c in chunks] == python_chunks(texts[i]), texts[i][:40]


def test_detect_and_normalise(spark):
    def factory():
        def model(text):
            if "boom" in text:
                raise ValueError
            return [{"entity_group": "PER", "word": "Dupont", "start": 7, "end": 13, "score": 0.9},
                    {"entity": "B-ORG", "word": "##Acme", "score": 0.8}, {"entity": "I-LOC", "word": "absent", "score": 0.9},
                    {"entity": "", "word": "Dupont", "start": 1, "end": 2}, {"entity_group": "MISC", "word": "", "start": 0, "end": 6}]
        return model

    df = spark.createDataFrame([(1, TEXT), (2, "short"), (3, "boom " * 5), (4, None)], "i int, text string")
    rows = {r.i: [tuple(e) for e in r.entities] for r in ner.detect_entities(df, "text", factory).collect()}
    assert rows[1] == [("PER", "Dupont", 7, 13, 0.9), ("ORG", "Acme", 25, 29, 0.8), ("MISC", "Maître", 0, 6, 0.0)]
    assert rows[2] == rows[3] == rows[4] == []
    long = "x " * 700 + TEXT
    offsets = ner.detect_entities(spark.createDataFrame([(long,)], "text string"), "text", factory).first().entities
    assert [e for e in offsets if e.entity == "ORG"][-1].value == "Acme"
    assert long[[e for e in offsets if e.entity == "ORG"][-1].start:].startswith("Acme")


def test_long_texts_are_dealt_out_with_equal_entities(spark):
    rows = [(1, "one the two les " * 9000), (2, "les the short"), (3, None), (4, " " * 90_000), (5, "x" * 80_000 + " the"), (1, "one the two les " * 9000)]
    df = spark.createDataFrame(rows, "id int, text string")
    plain = ner.detect_entities(df, "text", dictionary_model)
    dealt = ner.detect_entities_dealt(df, "text", dictionary_model)
    assert sorted(map(str, dealt.select(plain.columns).collect())) == sorted(map(str, plain.collect()))
    text = rows[0][1]
    chunks = spark.createDataFrame([(text,)], "text string").select(ner.chunk_text(F.col("text")).alias("c")).first().c
    assert [(c.offset, c.text) for c in chunks] == [(a, text[a:b]) for a, b in ner.cut_points(text)]


def test_one_long_text_is_spread_over_tasks(spark):
    def model():
        task = TaskContext.get().partitionId()
        return lambda chunk: [{"entity_group": f"P{task}", "word": chunk[:3], "start": 0, "end": 3, "score": 1.0}]

    df = spark.createDataFrame([(1, "some words " * 100_000)], "id int, text string")
    found = ner.detect_entities_dealt(df, "text", model).first()
    assert len({e.entity for e in found.entities}) > 1 and found.entities_failed == 0
    assert [e.start for e in found.entities] == sorted(e.start for e in found.entities) and len(found.entities) > 900
