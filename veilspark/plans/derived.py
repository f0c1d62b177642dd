"""Inputs the registered queries derive from the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from veilspark import schema

NOW = "2024-01-31 00:00:00"
TYPES = ["email", "phone", "name", "address", "ip", "iban", "credit_card", "ssn", "password", "health", "biometric",
         "emotion_workplace"]
SEVERITIES = ["medium"] * 4 + ["low", "high"] + ["critical"] * 6
ACTION_OF = {"view": "CLEAN", "click": "ANONYMIZED", "purchase": "PII_DETECTED", "error": "BLOCKED",
             "signup": "ATTACHMENT_BLOCKED"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def texts(spark: SparkSession, sf_dir: str, name: str, key: str) -> DataFrame:
    """A text table spread over the cluster: its CPU-heavy scans would otherwise
    run in as many tasks as the table happens to have splits.  Rows are dealt
    by their key, so a retried task gets the same rows."""
    return table(spark, sf_dir, name).repartition(F.col(key))


def _pick(values: list[str], index: Column) -> Column:
    return F.get(F.array(*map(F.lit, values)), index)


def det_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection events: the generic event table seen as scanner telemetry."""
    return as_detections(table(spark, sf_dir, "events"))


def as_detections(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    action = None
    for event_type, name in ACTION_OF.items():
        test = F.col("event_type") == event_type
        action = F.when(test, name) if action is None else action.when(test, name)
    finding = F.struct(_pick(TYPES, k % 12).alias("type"), _pick(SEVERITIES, k % 12).alias("severity"),
                       (k % 3 + 1).alias("count"))
    findings = F.when(F.col("event_type") == "view", F.array().cast(f"array<{schema.FINDING}>")).otherwise(
        F.array(finding))
    return events.select(
        "event_id", F.col("ts").cast("timestamp").alias("timestamp"), F.col("user_id").alias("device_id"),
        F.when(F.col("user_id") % 10 == 0, "acme").otherwise("default").alias("org_id"),
        _pick(schema.SERVICES, (F.col("user_id") % 9).cast("int")).alias("llm"), action.alias("action"),
        F.when(F.col("event_type") == "error", "block").otherwise("anonymize").alias("mode"),
        (F.col("event_id") * 7919 % 1800 + 80).alias("prompt_length"), findings.alias("findings"),
        F.when(F.col("event_type") == "view", 0).otherwise(k % 3 + 1).alias("mappings_count"),
        F.concat(F.lit("2.0."), (F.col("user_id") % 3).cast("string")).alias("extension_version"))


def _uuid(prefix: str, number: str) -> Column:
    return F.concat(F.lit(f"{prefix}-0000-4000-8000-"), F.lpad(F.col(number).cast("string"), 12, "0"))


def wire_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detection events in wire form, with every kind of flaw at fixed ids."""
    def broken(every: int) -> Column:
        return F.col("event_id") % every == 1

    ev = det_events(spark, sf_dir)
    return ev.select(
        "event_id",
        F.when(broken(41), "not-a-uuid").otherwise(_uuid("00000000", "event_id")).alias("eventId"),
        _uuid("00000001", "device_id").alias("deviceId"),
        F.when(broken(43), "bad org!").otherwise(F.col("org_id")).alias("orgId"),
        F.lit(None).cast("string").alias("userHint"), "timestamp", F.lit("chat.example.com").alias("hostname"),
        F.when(broken(47), "Nobody").otherwise(F.col("llm")).alias("llm"),
        F.when(broken(53), "HACK").otherwise(F.col("action")).alias("action"),
        F.lit("/conversation").alias("endpoint"), "mode",
        F.when(broken(59), F.lit(-5)).otherwise(F.col("prompt_length").cast("int")).alias("promptLength"),
        F.col("mappings_count").alias("mappingsCount"), F.lit(None).cast("string").alias("anonymizedPreview"),
        F.when(broken(79), F.array(F.struct(F.lit("email").alias("type"), F.lit("fatal").alias("severity"), F.lit(1).alias("count"))))
        .otherwise(F.col("findings")).cast(f"array<{schema.FINDING}>").alias("findings"),
        F.when(broken(83), F.from_json(F.lit('{"sha256":"XYZ"}'), schema.ATTACHMENT)).alias("attachment"),
        F.when(broken(61), "2.0").otherwise(F.col("extension_version")).alias("extensionVersion"),
        F.when(broken(67), 2).otherwise(1).alias("schemaVersion"))


def wire_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as JSON text; some records carry a field nobody declared, some a time without an offset."""
    wire = wire_events(spark, sf_dir)
    text = F.to_json(F.struct(*[c for c in wire.columns if c != "event_id"]))
    text = F.when(F.col("event_id") % 73 == 1, F.regexp_replace(text, r'("timestamp":"[^"]*)Z"', '$1"')).otherwise(text)
    return wire.select("event_id", F.when(
        F.col("event_id") % 71 == 1, F.concat(F.lit('{"promptPreview":"x",'), F.substring(text, 2, 1 << 30))
    ).otherwise(text).alias("value"))


def audit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Access-audit lines made from the event table."""
    e = table(spark, sf_dir, "events")
    path = _pick(["/v1/stats", "/v1/events", "/v1/devices", "/v1/health", "/actuator/info"], (F.col("event_id") % 5).cast("int"))
    status = F.when(F.col("event_type") == "error", 429).otherwise(200)
    return e.select("event_id", F.format_string(
        'method=GET path=%s query=%s status=%d remote=10.0.0.%d ua="agent v1" principal=jwt:user%d latencyMs=%d',
        path, F.when(F.col("event_id") % 2 == 0, "range=24h").otherwise("-"), status, F.col("user_id") % 250,
        F.col("user_id"), F.col("event_id") % 97).alias("value"))


SERVICE_KEYS = ["chatgpt", "claude", "gemini", "copilot", "mistral", "perplexity", "deepseek", "grok"]
_HOSTS = ["chatgpt.com", "claude.ai", "gemini.google.com", "copilot.microsoft.com", "chat.mistral.ai",
          "www.perplexity.ai", "eu.chat.deepseek.com", "x.ai"]
_URLS = ["/backend-api/conversation", "/api/organizations/x/chat_conversations", "/v1/models/x:streamGenerate",
         "/sydney/UpdateConversation", "/api/chat/completions", "/rest/sse/perplexity_ask",
         "/api/v0/chat/completion", "/rest/app-chat/conversations/new"]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One chat request per conversation turn, in the body shape of its service;
    every body also holds an assistant message that must never be touched."""
    c = table(spark, sf_dir, "conversations").withColumn("n", ((F.col("conv_id") + F.col("turn")) % 8).cast("int"))
    role, text, other = F.col("role"), F.col("text"), F.lit("noted")

    def messages(build, key: str = "messages", **top) -> Column:
        pair = F.array(build(role, text), build(F.lit("assistant"), other))
        return F.to_json(F.struct(*[v.alias(k) for k, v in top.items()], pair.alias(key)))

    bodies = [
        messages(lambda r, t: F.struct(F.struct(r.alias("role")).alias("author"),
                                       F.struct(F.array(t).alias("parts")).alias("content"))),
        messages(lambda r, t: F.struct(r.alias("role"), t.alias("content"))),
        messages(lambda r, t: F.struct(r.alias("role"), F.array(F.struct(t.alias("text"))).alias("parts")), "contents"),
        messages(lambda r, t: F.struct(r.alias("author"), t.alias("text"))),
        messages(lambda r, t: F.struct(r.alias("role"), F.array(F.struct(
            F.lit("text").alias("type"), t.alias("text"))).alias("content"))),
        F.to_json(F.struct(F.when(role == "user", text).alias("query_str"),
                           F.array(F.struct(F.lit("assistant").alias("role"), other.alias("content"))).alias("messages"))),
        messages(lambda r, t: F.struct(r.alias("role"), t.alias("content"))),
        messages(lambda r, t: F.struct(r.alias("role").alias("sender"), t.alias("message"))),
    ]
    body = None
    for index, sql in enumerate(bodies):
        body = F.when(F.col("n") == index, sql) if body is None else body.when(F.col("n") == index, sql)
    return c.select("conv_id", "turn", (F.col("conv_id") * 1000 + F.col("turn")).alias("request_id"),
                    F.col("conv_id").cast("string").alias("session"), _pick(_HOSTS, F.col("n")).alias("host"),
                    _pick(_URLS, F.col("n")).alias("url"), body.alias("body"))


def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as texts of a session (their language) in a stable order."""
    return texts(spark, sf_dir, "documents", "doc_id").select(
        "doc_id", "text", F.col("lang").alias("session"), F.col("doc_id").alias("order"))


def auth_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where(F.col("event_type").isin("error", "signup"))
    return e.select(F.col("user_id").cast("string").alias("ip"), F.col("ts").cast("timestamp").alias("ts"),
                    (F.col("event_type") == "error").alias("failed"))
