"""Compliance analytics on top of the statistics row.

``stats`` is the one-row frame of :func:`veilspark.operators.stats.stats`; the
per-service and per-type frames have a few rows each.  Dimensions are the fixed
tables of :mod:`veilspark.dims`.  One-row facts are read as scalar subqueries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilspark import dims
from veilspark.operators.stats import by_llm_rows, by_type_rows, percent_1dp

# Finding types, thresholds, weights and wording of the reports.
CRITICAL_EXPOSURE_TYPES = ["health", "biometric", "ssn", "credit_card", "password"]
BREACH_TYPES = ["health", "biometric", "ssn", "credit_card"]
TIER_CRITICAL_TYPES = ["health", "biometric", "ssn"]
HIGH_TYPES = ["credit_card", "ssn", "password", "nir", "iban"]
MEDIUM_TYPES = ["email", "phone", "phone_fr", "address", "name"]
BREACH_THRESHOLD, BREACH_WINDOW = 20, "72 hours"
WEIGHTS = {"coverage": 45, "critical": 25, "transfer": 20, "hygiene": 10}
GRADES = [("A", 90), ("B", 75), ("C", 60), ("D", 45)]
TIER_REASONS = {
    "prohibited": "Usage intensif couplé à des signaux de pratiques interdites.",
    "critical": "Flux important avec données Art. 9 RGPD (santé/biométrie).",
    "jurisdiction": "Transfert vers juridiction sans décision d'adéquation.",
    "volume": "Usage courant — obligations de transparence applicables.",
    "none": "Faible volume, aucun signal de risque élevé.",
}
ROPA_COLUMNS = ["Responsable", "Finalité", "Catégorie de données", "Destinataire", "Transfert hors UE",
                "Base légale", "Durée de conservation", "Mesures de sécurité", "Articles"]
SCORE_PARTS = {
    "coverage": ("Couverture anonymisation / blocage", " anonymisés, ", " bloqués"),
    "critical": ("Exposition de données critiques", " détections santé/biométrie/SSN/CB/mdp"),
    "transfer": ("Risque de transfert hors UE", " du trafic vers juridictions non-adéquates"),
    "hygiene": ("Hygiène globale", "% de prompts propres"),
}
BREACH_REASON = " détections de catégories particulières (Art. 9 RGPD) dépassant le seuil de "
ROPA_PURPOSE, ROPA_PREVIEW_PURPOSE = "Assistance IA (%s)", "Assistance IA via %s"
ROPA_CATEGORY, ROPA_VOLUME = "%s (%s occurrences)", "Volume : %s"
ROPA_UNKNOWN, ROPA_NO_TRANSFER = "inconnu", "Non"
ROPA_BASIS = ("Intérêt légitime", "Intérêt légitime (Art. 6(1)(f))")
ROPA_RETENTION = ("30 jours", "30 jours (télémétrie)")
ROPA_MEASURES = "Anonymisation "
TRANSFER_LABELS = {"inside": "Intra-UE", "no_adequate": "Hors UE — non adéquat", "dpf": "Hors UE — DPF", "other": "Hors UE — SCC"}
RESIDUAL_RISK = {"A": "acceptable", "B": "acceptable", "C": "modéré — plan d'action recommandé"}
RESIDUAL_RISK_OTHER = "élevé — mesures correctives requises"


def half_up(x: Column) -> Column:
    return F.floor(x + 0.5)


def _type_sum(types: list[str]) -> Column:
    entries = F.filter(F.map_entries("by_type"), lambda e: e["key"].isin(types))
    return F.aggregate(entries, F.lit(0).cast("bigint"), lambda acc, e: acc + e["value"])


# ----------------------------------------------------------------- lookups

def with_articles(types: DataFrame, dim: DataFrame) -> DataFrame:
    """Add ``article_ids``; the key is lower-cased, unknown types get the default."""
    keyed = F.broadcast(dim.select(F.col("type").alias("__type"), "article_ids"))
    joined = types.join(keyed, F.lower("type") == F.col("__type"), "left").drop("__type")
    default = F.array(*map(F.lit, dims.DEFAULT_ARTICLES))
    return joined.withColumn("article_ids", F.coalesce("article_ids", default))


def with_article_numbers(types: DataFrame, dim: DataFrame, article_dim: DataFrame) -> DataFrame:
    """Add ``numbers``: article numbers in the order of the mapping."""
    numbers = article_dim.agg(F.map_from_entries(F.collect_list(F.struct("article_id", "number")))).scalar()
    rows = with_articles(types, dim).withColumn("__numbers", numbers)
    return rows.withColumn("numbers", F.transform("article_ids", lambda a: F.element_at("__numbers", a))).drop("__numbers")


def with_jurisdiction(llms: DataFrame, dim: DataFrame) -> DataFrame:
    """Add where a service's provider sits; unknown services get the cautious default."""
    joined = llms.join(F.broadcast(dim), "llm", "left")
    defaults = {"company": F.col("llm"), "country": F.lit(dims.UNKNOWN_COUNTRY),
                "country_code": F.lit(dims.UNKNOWN_CODE), "region": F.lit(dims.UNKNOWN_REGION),
                "adequacy": F.lit(dims.UNKNOWN_ADEQUACY), "basis": F.lit(dims.UNKNOWN_BASIS),
                "lat": F.lit(0.0), "lng": F.lit(0.0)}
    return joined.withColumns({name: F.coalesce(F.col(name), value) for name, value in defaults.items()})


def with_prohibited(types: DataFrame, dim: DataFrame) -> DataFrame:
    return types.join(F.broadcast(dim), "type")


def article_index(type_dim: DataFrame) -> DataFrame:
    """Article → finding types that trigger it."""
    return type_dim.select(F.explode("article_ids").alias("article_id"), "type").groupBy("article_id").agg(
        F.array_sort(F.collect_set("type")).alias("types"))


def articles_by_framework(article_dim: DataFrame, framework: str) -> DataFrame:
    return article_dim.where(F.col("framework") == framework)


# ------------------------------------------------------------------- score

def compliance_score(stats: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """One row: score 0-100, grade, the four parts and the rates behind them."""
    adequacy = jurisdictions.agg(F.map_from_entries(F.collect_list(F.struct("llm", "adequacy")))).scalar()
    weights = F.create_map(*[F.lit(x) for pair in dims.TRANSFER_WEIGHTS.items() for x in pair])
    total = F.greatest(F.col("total"), F.lit(1))
    sensitive = F.col("total") - F.col("clean")

    def share_of_sensitive(part: str, when_none: float) -> Column:
        return F.when(sensitive > 0, F.col(part) / sensitive).otherwise(F.lit(when_none))

    weighted = F.aggregate(
        F.map_entries("by_llm"), F.lit(0.0),
        lambda acc, e: acc + e["value"] * F.coalesce(
            F.element_at(weights, F.coalesce(F.element_at("adequacy", e["key"]), F.lit(""))), F.lit(0.0)))
    rates = stats.withColumn("adequacy", adequacy).select(
        "*", share_of_sensitive("anonymized", 1.0).alias("anonymization_rate"),
        share_of_sensitive("blocked", 0.0).alias("block_rate"),
        _type_sum(CRITICAL_EXPOSURE_TYPES).alias("critical"), (weighted / total).alias("transfer_risk"))
    one = F.lit(1.0)
    parts = rates.withColumn("critical_exposure", F.col("critical") / total).withColumns({
        "coverage": F.least(one, F.col("anonymization_rate") + F.col("block_rate")) * WEIGHTS["coverage"],
        "critical_part": (1 - F.least(one, F.col("critical_exposure") * 20)) * WEIGHTS["critical"],
        "transfer_part": (1 - F.least(one, F.col("transfer_risk"))) * WEIGHTS["transfer"],
        "hygiene": F.col("clean") / total * WEIGHTS["hygiene"]})
    scored = parts.withColumn("score", half_up(
        F.col("coverage") + F.col("critical_part") + F.col("transfer_part") + F.col("hygiene")))
    grade = F.lit("F")
    for letter, floor in reversed(GRADES):
        grade = F.when(F.col("score") >= floor, letter).otherwise(grade)
    return scored.select(
        "score", grade.alias("grade"), "anonymization_rate", "block_rate", "critical_exposure", "transfer_risk",
        half_up(F.col("coverage")).alias("coverage_points"), half_up(F.col("critical_part")).alias("critical_points"),
        half_up(F.col("transfer_part")).alias("transfer_points"), half_up(F.col("hygiene")).alias("hygiene_points"),
        "critical", half_up(F.col("clean") / total * 100).alias("clean_pct"))


def score_details(stats: DataFrame, jurisdictions: DataFrame) -> DataFrame:
    """The four parts of the score as rows (label, points, weight, note)."""
    def pct(name: str) -> Column:
        return F.concat(half_up(F.col(name) * 100).cast("string"), F.lit("%"))

    rows = [
        (SCORE_PARTS["coverage"][0], "coverage_points", WEIGHTS["coverage"],
         F.concat(pct("anonymization_rate"), F.lit(SCORE_PARTS["coverage"][1]), pct("block_rate"), F.lit(SCORE_PARTS["coverage"][2]))),
        (SCORE_PARTS["critical"][0], "critical_points", WEIGHTS["critical"],
         F.concat(F.col("critical").cast("string"), F.lit(SCORE_PARTS["critical"][1]))),
        (SCORE_PARTS["transfer"][0], "transfer_points", WEIGHTS["transfer"],
         F.concat(pct("transfer_risk"), F.lit(SCORE_PARTS["transfer"][1]))),
        (SCORE_PARTS["hygiene"][0], "hygiene_points", WEIGHTS["hygiene"],
         F.concat(F.col("clean_pct").cast("string"), F.lit(SCORE_PARTS["hygiene"][1]))),
    ]
    parts = F.array(*[F.struct(F.lit(label).alias("label"), F.col(points).alias("points"),
                               F.lit(weight).alias("weight"), note.alias("note"))
                      for label, points, weight, note in rows])
    return compliance_score(stats, jurisdictions).select(F.inline(parts))


# ------------------------------------------------------------ alerts, breach

def prohibited_alerts(by_type: DataFrame, dim: DataFrame) -> DataFrame:
    return (with_prohibited(by_type, dim).where(F.col("count") > 0)
            .select("type", "reason", "count", F.lit("aia-5").alias("article_id"))
            .orderBy(F.desc("count"), "type"))


def first_critical(ev: DataFrame, now, lookback: str = BREACH_WINDOW, max_events: int | None = None) -> DataFrame:
    """Time of the earliest critical event in the look-back window (NULL if none).

    ``max_events`` restricts the search to the newest so many events.
    """
    rows = ev.select("timestamp", "findings", "event_id")
    if max_events is not None:
        rows = rows.orderBy(F.desc("timestamp"), "event_id").limit(max_events)
    recent = rows.where(F.col("timestamp") >= F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {lookback}"))
    critical = F.exists("findings", lambda f: F.lower(f["type"]).isin(BREACH_TYPES))
    return recent.where(F.coalesce(critical, F.lit(False))).agg(F.min("timestamp").alias("first_critical"))


def breach_status(stats: DataFrame, first: DataFrame, now, threshold: int = BREACH_THRESHOLD) -> DataFrame:
    """One row: is the 72-hour notification clock running, and how much is left."""
    base = stats.select(_type_sum(BREACH_TYPES).alias("critical")).withColumn("first_critical", first.scalar())
    active = (F.col("critical") >= threshold) & F.col("first_critical").isNotNull()
    deadline = F.when(active, F.col("first_critical") + F.expr(f"INTERVAL {BREACH_WINDOW}"))
    left = F.coalesce(F.greatest(F.lit(0), F.unix_millis("deadline") - F.unix_millis(F.lit(now).cast("timestamp"))),
                      F.lit(0))
    reason = F.concat(F.col("critical").cast("string"),
                      F.lit(f"{BREACH_REASON}{threshold}"))

    def two(x: Column) -> Column:
        return F.lpad(x.cast("string"), 2, "0")

    return base.withColumns({"active": active, "deadline": deadline}).withColumn("remaining_ms", left).select(
        "active", F.when(F.col("active"), F.col("first_critical")).alias("triggered_at"), "deadline", "remaining_ms",
        F.when(F.col("active"), reason).otherwise("").alias("reason"),
        *[F.when(F.length(text) < 2, two(text)).otherwise(text).alias(name) for name, text in (
            ("hours", F.floor(F.col("remaining_ms") / 3600000).cast("string")),
            ("minutes", F.floor(F.col("remaining_ms") % 3600000 / 60000).cast("string")),
            ("seconds", F.floor(F.col("remaining_ms") % 60000 / 1000).cast("string")))])


# -------------------------------------------------------------- risk tiers

def risk_tiers(stats: DataFrame, jurisdictions: DataFrame, prohibited: DataFrame) -> DataFrame:
    """One tier per service; the first rule that applies decides."""
    bad_types = prohibited.agg(F.collect_set("type")).scalar()
    flags = stats.withColumn("bad_types", bad_types).select(
        F.explode("by_llm").alias("llm", "count"),
        F.exists(F.map_entries("by_type"), lambda e: (e["value"] > 0) & F.array_contains("bad_types", e["key"])
                 ).alias("has_prohibited"),
        F.exists(F.map_keys("by_type"), lambda t: t.isin(TIER_CRITICAL_TYPES)).alias("has_critical"))
    rows = flags.join(F.broadcast(jurisdictions.select("llm", "adequacy")), "llm", "left")
    outcome = (
        F.when(F.col("has_prohibited") & (F.col("count") > 50), _tier("unacceptable", "prohibited"))
        .when(F.col("has_critical") & (F.col("count") > 100), _tier("high", "critical"))
        .when(F.col("adequacy") == "no_adequate", _tier("high", "jurisdiction"))
        .when(F.col("count") > 50, _tier("limited", "volume"))
        .otherwise(_tier("minimal", "none")))
    return rows.withColumn("o", outcome).select("llm", "count", "o.tier", "o.reason").orderBy(F.desc("count"), "llm")


def _tier(tier: str, reason: str) -> Column:
    return F.struct(F.lit(tier).alias("tier"), F.lit(TIER_REASONS[reason]).alias("reason"))


def tier_summary(tiers: DataFrame, dim: DataFrame) -> DataFrame:
    """Every tier with its label, obligations and how many services and prompts it has."""
    counted = tiers.groupBy("tier").agg(F.count("*").alias("services"), F.sum("count").alias("prompts"))
    zero = F.lit(0).cast("bigint")
    return dim.join(F.broadcast(counted), "tier", "left").select(
        "tier_order", "tier", "label", "obligations", F.coalesce("services", zero).alias("services"),
        F.coalesce("prompts", zero).alias("prompts")).orderBy("tier_order")


# --------------------------------------------------------------- transfers

def transfer_rows(stats: DataFrame, dim: DataFrame) -> DataFrame:
    rows = stats.select(F.explode("by_llm").alias("llm", "count"), F.greatest("total", F.lit(1)).alias("total"))
    return with_jurisdiction(rows, dim).withColumn("share", F.col("count") / F.col("total")).drop("total").orderBy(
        F.desc("count"), "llm")


def adequacy_summary(rows: DataFrame) -> DataFrame:
    """Prompts and percentage per adequacy class (at most a handful of classes)."""
    grouped = rows.groupBy("adequacy").agg(F.sum("count").alias("count"))
    total = F.sum("count").over(W.partitionBy())
    return grouped.withColumn("pct", percent_1dp(F.col("count"), F.when(total == 0, F.lit(1)).otherwise(total)))


# ---------------------------------------------------------- finding tables

def finding_rows(by_type: DataFrame, dim: DataFrame) -> DataFrame:
    """Finding types with articles and severity class.  The severity lists are
    matched as written; only the article lookup ignores case."""
    mapped = with_articles(by_type, dim).join(
        F.broadcast(dim.select(F.col("type").alias("__known"))), F.lower("type") == F.col("__known"), "left")
    ids = F.when(F.col("__known").isNotNull(), F.col("article_ids")).otherwise(F.array().cast("array<string>"))
    severity = (F.when(F.array_contains(ids, "aia-5") | F.array_contains(ids, "gdpr-9"), "critical")
                .when(F.col("type").isin(HIGH_TYPES), "high").when(F.col("type").isin(MEDIUM_TYPES), "medium")
                .otherwise("low"))
    return mapped.select("type", "count", "article_ids", severity.alias("severity")).orderBy(F.desc("count"), "type")


def finding_totals(rows: DataFrame) -> DataFrame:
    def total(when: Column, name: str) -> Column:
        return F.coalesce(F.sum(F.when(when, F.col("count"))), F.lit(0).cast("bigint")).alias(name)

    return rows.agg(total(F.lit(True), "total_occurrences"),
                    total(F.array_contains("article_ids", "gdpr-9"), "special_category"),
                    total(F.exists("article_ids", lambda a: a.startswith("aia-")), "ai_act"))


# ------------------------------------------------------------ RoPA and DPIA

def ropa_cross(by_llm: DataFrame, by_type: DataFrame) -> DataFrame:
    """Every (service, finding type); a service with no types at all keeps one row.

    Both sides are aggregates (services are an enumeration, types a top-50
    list), so the types travel as one array and are unfolded per service.
    """
    types = by_type.agg(F.array_sort(F.collect_list(F.struct("type", F.col("count").alias("type_count"))))).scalar()
    return by_llm.withColumnRenamed("count", "llm_count").withColumn("t", F.explode_outer(types)).select(
        "llm", "llm_count", "t.type", "t.type_count")


def ropa(stats: DataFrame, jurisdictions: DataFrame, type_dim: DataFrame, article_dim: DataFrame,
         org: str = "demo-org", product: str = "veilspark") -> DataFrame:
    """Record of processing activities: nine text columns, one row per service and type."""
    pairs = ropa_cross(by_llm_rows(stats), by_type_rows(stats))
    named = with_article_numbers(pairs, type_dim, article_dim).join(
        F.broadcast(jurisdictions.select("llm", "company", "country", "region", "basis")), "llm", "left")
    has_type = F.col("type").isNotNull()
    transfer = F.when(F.col("region") != "EU", F.concat_ws(" — ", "country", "basis")).otherwise(ROPA_NO_TRANSFER)
    cells = [
        F.lit(org),
        F.format_string(ROPA_PURPOSE, "llm"),
        F.when(has_type, F.format_string(ROPA_CATEGORY, "type", "type_count"))
        .otherwise(F.format_string(ROPA_VOLUME, "llm_count")),
        F.when(has_type, F.concat_ws(" — ", "llm", F.coalesce("company", F.lit(ROPA_UNKNOWN)))).otherwise(F.col("llm")),
        transfer,
        F.when(has_type, ROPA_BASIS[1]).otherwise(ROPA_BASIS[0]),
        F.when(has_type, ROPA_RETENTION[1]).otherwise(ROPA_RETENTION[0]),
        F.lit(f"{ROPA_MEASURES}{product}"),
        F.when(has_type, F.concat_ws("; ", "numbers")).otherwise(""),
    ]
    return named.orderBy("llm", "type").select(*[c.alias(n) for n, c in zip(ROPA_COLUMNS, cells)])


def ropa_preview(stats: DataFrame, jurisdictions: DataFrame, type_dim: DataFrame, article_dim: DataFrame,
                 n_llm: int = 4, n_type: int = 6) -> DataFrame:
    """The largest services by the most frequent types, with a transfer label."""
    llms = transfer_rows(stats, jurisdictions).limit(n_llm)
    types = by_type_rows(stats).orderBy(F.desc("count"), "type").limit(n_type)
    pairs = ropa_cross(llms.select("llm", "count"), types).where(F.col("type").isNotNull())
    named = with_article_numbers(pairs, type_dim, article_dim).join(F.broadcast(
        with_jurisdiction(llms.select("llm"), jurisdictions)), "llm")
    outside = F.col("region") != "EU"
    label = (F.when(~outside, TRANSFER_LABELS["inside"]).when(F.col("adequacy") == "no_adequate", TRANSFER_LABELS["no_adequate"])
             .when(F.col("adequacy") == "dpf", TRANSFER_LABELS["dpf"]).otherwise(TRANSFER_LABELS["other"]))
    return named.select(
        F.format_string(ROPA_PREVIEW_PURPOSE, "llm").alias("purpose"),
        F.format_string("%s (%s)", "type", "type_count").alias("category"),
        F.concat_ws(" — ", "company", "country").alias("recipient"), label.alias("transfer"),
        outside.alias("is_transfer"), F.concat_ws(", ", "numbers").alias("articles"),
        "llm", "llm_count", "type", "type_count").orderBy(F.desc("llm_count"), "llm", F.desc("type_count"), "type")


def dpia_facts(stats: DataFrame, jurisdictions: DataFrame, type_dim: DataFrame, article_dim: DataFrame,
               prohibited: DataFrame, tier_dim: DataFrame, org: str = "demo-org") -> DataFrame:
    """Facts of the impact assessment as (section, position, item, value) rows."""
    score = compliance_score(stats, jurisdictions)
    residual = F.create_map(*[F.lit(x) for pair in RESIDUAL_RISK.items() for x in pair])

    def rows(section: str, frame: DataFrame, item: Column, value: Column, *order: Column) -> DataFrame:
        position = F.row_number().over(W.orderBy(*order)) if order else F.lit(1)   # a dozen report lines
        return frame.select(F.lit(section).alias("section"), position.cast("int").alias("position"),
                            item.cast("string").alias("item"), value.cast("string").alias("value"))

    def melt(section: str, frame: DataFrame, names: dict[str, Column]) -> DataFrame:
        entries = F.array(*[F.struct(F.lit(i).alias("position"), F.lit(k).alias("item"), v.cast("string").alias("value"))
                            for i, (k, v) in enumerate(names.items(), 1)])
        return frame.select(F.inline(entries)).select(F.lit(section).alias("section"), "position", "item", "value")

    by_type = by_type_rows(stats).orderBy(F.desc("count"), "type").limit(10)
    transfers = transfer_rows(stats, jurisdictions)
    clean_pct = half_up(F.col("clean") / F.greatest("total", F.lit(1)) * 100)
    tiers = risk_tiers(stats, jurisdictions, prohibited).join(F.broadcast(tier_dim.select("tier", "label")), "tier")
    parts = [
        melt("summary", score, {"organisation": F.lit(org), "score": F.col("score"), "grade": F.col("grade"),
                                "residual_risk": F.coalesce(F.try_element_at(residual, F.col("grade")),
                                                            F.lit(RESIDUAL_RISK_OTHER))}),
        melt("volume", stats, {"total": F.col("total"), "clean": F.col("clean"), "clean_pct": clean_pct,
                               "anonymized": F.col("anonymized"), "blocked": F.col("blocked"),
                               "flagged": F.col("flagged")}),
        rows("data_categories", with_article_numbers(by_type, type_dim, article_dim), F.col("type"),
             F.concat_ws(" | ", F.col("count").cast("string"), F.concat_ws(", ", "numbers")),
             F.desc("count"), F.col("type")),
        rows("recipients", transfers, F.col("llm"),
             F.concat_ws(" | ", "company", "country", F.col("count").cast("string"), "basis"),
             F.desc("count"), F.col("llm")),
        rows("without_adequacy", transfers.where(F.col("adequacy").isin("no_adequate", "scc_required")),
             F.col("llm"), F.col("adequacy"), F.desc("count"), F.col("llm")),
        rows("risk", tiers, F.col("llm"), F.concat_ws(" | ", "label", "reason"), F.desc("count"), F.col("llm")),
        rows("prohibited", prohibited_alerts(by_type_rows(stats), prohibited), F.col("type"),
             F.concat_ws(" | ", F.col("count").cast("string"), "reason"), F.desc("count"), F.col("type")),
    ]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
