import pytest

from veilspark import dims
from veilspark.operators import compliance as co, stats as st
from veilspark.session import new_path
from veilspark.sources import writers


def row(spark, total=0, clean=0, flagged=0, blocked=0, anonymized=0, by_llm=None, by_type=None):
    return spark.createDataFrame(
        [(total, clean, flagged, blocked, anonymized, by_llm or {}, by_type or {})],
        "total bigint, clean bigint, flagged bigint, blocked bigint, anonymized bigint, by_llm map<string,bigint>, by_type map<string,bigint>")


def test_score_of_nothing(spark):
    s = co.compliance_score(row(spark), dims.jurisdictions(spark)).first()
    assert (s.score, s.grade, s.anonymization_rate, s.block_rate) == (90, "A", 1.0, 0.0)


@pytest.mark.parametrize("kwargs, score, grade", [
    (dict(total=100, clean=100, by_llm={"Mistral": 100}), 100, "A"),
    (dict(total=100, clean=50, anonymized=30, blocked=10, flagged=10, by_llm={"ChatGPT": 60, "DeepSeek": 40}, by_type={"ssn": 1, "email": 9}), 71, "C"),
    (dict(total=10, flagged=10, by_llm={"DeepSeek": 10}, by_type={"health": 5}), 0, "F"),
    (dict(total=10, clean=5, anonymized=5, by_llm={"Nobody": 10}), 95, "A"),
])
def test_score(spark, kwargs, score, grade):
    s = co.compliance_score(row(spark, **kwargs), dims.jurisdictions(spark)).first()
    assert (s.score, s.grade) == (score, grade)
    parts = co.score_details(row(spark, **kwargs), dims.jurisdictions(spark)).collect()
    assert [p.weight for p in parts] == [45, 25, 20, 10]


def test_breach_boundaries(spark):
    now = "2024-01-31 00:00:00"
    at = spark.createDataFrame([("2024-01-28 12:00:00",)], "t string").selectExpr("cast(t as timestamp) as first_critical")
    never = spark.createDataFrame([(None,)], "first_critical timestamp")
    on = co.breach_status(row(spark, by_type={"ssn": 19, "health": 1, "password": 500}), at, now).first()
    assert on.active and on.remaining_ms == 12 * 3600 * 1000 and (on.hours, on.minutes, on.seconds) == ("12", "00", "00")
    assert not co.breach_status(row(spark, by_type={"ssn": 19}), at, now).first().active
    off = co.breach_status(row(spark, by_type={"ssn": 99}), never, now).first()
    assert (off.active, off.triggered_at, off.remaining_ms, off.reason) == (False, None, 0, "")
    late = co.breach_status(row(spark, by_type={"ssn": 20}), at, "2024-02-05 00:00:00").first()
    assert late.active and late.remaining_ms == 0


@pytest.mark.parametrize("n, types, llm, tier", [
    (51, {"biometric": 1}, "Claude", "unacceptable"), (50, {"biometric": 1}, "Claude", "minimal"), (101, {"ssn": 1}, "Claude", "high"),
    (100, {"ssn": 1}, "Claude", "limited"), (1, {}, "DeepSeek", "high"), (51, {}, "Nobody", "limited"), (50, {}, "Nobody", "minimal"),
    (51, {"emotion": 0}, "Claude", "limited")])
def test_tiers(spark, n, types, llm, tier):
    tiers = co.risk_tiers(row(spark, by_llm={llm: n}, by_type=types), dims.jurisdictions(spark), dims.prohibited(spark))
    assert tiers.first().tier == tier
    assert {r.tier: r.services for r in co.tier_summary(tiers, dims.risk_tiers(spark)).collect()}[tier] == 1


def test_article_defaults_and_severity(spark):
    types = spark.createDataFrame([("EMAIL", 1), ("email", 2), ("weird", 3), ("Health", 4), ("iban", 5)], "type string, count bigint")
    rows = {r.type: (r.article_ids, r.severity) for r in co.finding_rows(types, dims.type_articles(spark)).collect()}
    assert rows == {"EMAIL": (["gdpr-4", "gdpr-5-1-c"], "low"), "email": (["gdpr-4", "gdpr-5-1-c"], "medium"), "weird": (["gdpr-4"], "low"),
                    "Health": (["gdpr-9"], "critical"), "iban": (["gdpr-4", "gdpr-5-1-c"], "high")}
    index = {r.article_id: r.types for r in co.article_index(dims.type_articles(spark)).collect()}
    assert index["aia-5"] == sorted(["biometric", "emotion", "emotion_workplace", "social_scoring", "predictive_policing"])
    assert co.articles_by_framework(dims.articles(spark), "GDPR").count() == 9
    alerts = co.prohibited_alerts(spark.createDataFrame([("Biometric", 9), ("biometric", 1), ("emotion", 0)], "type string, count bigint"), dims.prohibited(spark))
    assert [r.type for r in alerts.collect()] == ["biometric"]


def test_transfers_and_adequacy(spark):
    rows = co.transfer_rows(row(spark, total=10, by_llm={"Claude": 6, "Zed": 4}), dims.jurisdictions(spark))
    got = {r.llm: (r.company, r.country, r.adequacy, r.share) for r in rows.collect()}
    assert got["Zed"] == ("Zed", "Inconnu", "scc_required", 0.4) and got["Claude"][2:] == ("dpf", 0.6)
    assert {r.adequacy: r.pct for r in co.adequacy_summary(rows).collect()} == {"dpf": 60.0, "scc_required": 40.0}
    assert co.adequacy_summary(rows.limit(0)).count() == 0


def test_ropa_file_and_fallback(spark):
    args = (dims.jurisdictions(spark), dims.type_articles(spark), dims.articles(spark))
    lone = co.ropa(row(spark, by_llm={"Claude": 3}), *args).first()
    assert lone[2] == "Volume : 3" and lone[3] == "Claude" and lone[8] == ""
    frame = co.ropa(row(spark, by_llm={"Zed": 1, "Mistral": 2}, by_type={'a "b"': 2, "biometric": 1}), *args, org="o")
    path = new_path(spark, "ropa")
    writers.write_ropa(frame, path, "o", "2024-01-31")
    raw = b"".join(bytes(r.content) for r in spark.read.format("binaryFile").load(path).collect())
    lines = raw.decode("utf-8").splitlines()
    assert lines[0] == "﻿# RoPA veilspark — o — 2024-01-31" and lines[1].startswith('"Responsable","Finalité"')
    assert len(lines) == 6 and any('"a ""b"" (2 occurrences)"' in x for x in lines)
    assert any('"Zed — inconnu","Non"' in x for x in lines) and any('"Art. 9; Art. 5"' in x for x in lines)


def test_preview_limits(spark):
    llms, types = {f"l{i}": i for i in range(1, 8)}, {f"t{i}": i for i in range(1, 9)}
    rows = co.ropa_preview(row(spark, total=28, by_llm=llms, by_type=types), dims.jurisdictions(spark), dims.type_articles(spark), dims.articles(spark)).collect()
    assert len(rows) == 24 and (rows[0].llm, rows[0].type, rows[0].transfer) == ("l7", "t8", "Hors UE — SCC")


def test_bars_and_shares(spark):
    df = spark.createDataFrame([("a", 2), ("b", 8)], "llm string, count bigint")
    assert {r.llm: r.pct for r in st.scale_to_max(df, "count").collect()} == {"a": 25.0, "b": 100.0}
    assert {r.llm: r.pct for r in st.llm_shares(df).collect()} == {"a": 20.0, "b": 80.0}
