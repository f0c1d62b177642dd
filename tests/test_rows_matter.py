"""Rows whose data must trigger the step that they test."""
from pyspark.sql import functions as F

from veilspark.operators import audit, ner, scan
from veilspark.plans import queries as q


def test_values_have_two_labels_and_collide(spark, sf):
    labels = q.QUERIES["vault_first_labels"](spark, sf)
    assert labels.where("labels = 2").count() > 10
    assert q.QUERIES["vault_collisions"](spark, sf).agg(F.max("number")).first()[0] > 1


def test_some_entities_touch_findings(spark, sf):
    found = scan.evaluate(q._docs(spark, sf).select("doc_id", "text"), "text", q.builtin_rules())
    alone = ner.detect_entities(found, "text", q.number_model).select(F.explode("entities")).count()
    kept = q.QUERIES["entities_beside_findings"](spark, sf).where("rule_id = 'ner:PER'").count()
    assert 0 < kept < alone


def test_the_gate_lies_at_200000_characters(spark, sf):
    rules = q.builtin_rules()
    text = "card 4242 4242 4242 4242 "
    df = spark.createDataFrame([(n, text + "x" * (n - len(text))) for n in (199_999, 200_000, 200_001)] + [(0, " \n")], "id int, text string")
    rows = {r.id: (r.scanned, len(r.findings or [])) for r in scan.evaluate(df, "text", rules, max_chars=scan.MAX_SCAN_CHARS).collect()}
    assert rows == {199_999: (True, 1), 200_000: (True, 1), 200_001: (False, 0), 0: (False, 0)}
    assert q.QUERIES["scan_gated"](spark, sf).count() < q.QUERIES["scan_builtins"](spark, sf).select("doc_id").distinct().count()


def test_sketches_merge_within_their_error(spark):
    log = spark.range(200_000).select((F.col("id") % 40).alias("part"), F.pmod(F.xxhash64("id"), F.lit(100_000)).alias("latency_ms"))
    sketches = audit.latency_sketches(log, "part")
    for quantile in (0.01, 0.5, 0.95, 0.999):
        found = audit.latency_quantiles(sketches, quantile=quantile).first()
        rank = log.where(F.col("latency_ms") <= found.latency_ms).count() / 200_000
        assert abs(rank - quantile) < 0.006 and found.requests == 200_000
    assert audit.latency_quantiles(audit.latency_sketches(log.limit(0), "part"), "part").count() == 0
