"""Readers: event batches, request logs, access-audit lines; synthetic events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from veilspark import schema
from veilspark.operators.events import validate_events, without_nulls

_ALLOWED = list(schema.WIRE_EVENT)
_FINDING_KEYS = ["type", "severity", "count"]
_ATTACHMENT_KEYS = ["sha256", "mimeType", "sizeBytes", "extractedChars", "truncated", "extractorId",
                    "unavailable", "passwordProtected"]


#: A time names a moment only with its offset.
_MOMENT = r"[+-]?\d{4,9}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:[.,]\d{1,9})?)?(?:Z|[+-]\d{2}(?::\d{2}){0,2})"
_TIME = rf"\A{_MOMENT}\z"


def _plain_line() -> str:
    """Lines written plainly (members in the declared order, no white space, no escapes), which cannot have the faults that
    :func:`parse_events` looks for in the members as they are written: every name is declared and the time has its offset.
    Its repeats are possessive, so that long lists need no stack."""
    scalar = r'(?:"[^"\\\x00-\x1F]{0,4096}+"|-?(?:0|[1-9][0-9]{0,17}+)|null|true|false)'

    def members(names: list[str], **own: str) -> str:
        return r"\{" + "".join(rf'(?:"{name}":{own.get(name, scalar)}(?:,(?=")|(?=\}})))?+' for name in names) + r"\}"

    finding = members(_FINDING_KEYS)
    line = members(_ALLOWED, timestamp=f'"{_MOMENT}"', findings=rf"(?:\[(?:{finding}(?:,{finding})*+)?+\]|null)",
                   attachment=f"(?:null|{members(_ATTACHMENT_KEYS)})")
    return rf"\A{line}\z"


def _unknown(keys, allowed):
    return F.size(F.array_except(keys, F.array(*map(F.lit, allowed)))) > 0


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """JSON text → wire event columns plus ``errors`` (closed schema: a field
    nobody declared is an error, at the top, in findings and in the attachment)."""
    raw = F.col(column)
    # One parse for the values, one for the members as they are written: the
    # names at the top come from the latter, deeper names from its short parts.
    # A plain line needs the first only.
    marked = lines.withColumn("__plain", F.coalesce(raw.rlike(_plain_line()), F.lit(False)))
    parsed = marked.withColumns({
        "e": F.from_json(raw, schema.ddl(schema.WIRE_EVENT)),
        "__members": F.when(~F.col("__plain"), F.from_json(raw, "map<string,string>"))})
    members = F.col("__members")
    finding_keys = F.flatten(F.transform(F.from_json(members["findings"], "array<map<string,string>>"), lambda m: F.map_keys(m)))
    extra = without_nulls(
        F.when(members.isNull() & ~F.col("__plain"), F.lit("not a JSON object")),
        F.when(_unknown(F.map_keys(members), _ALLOWED), F.lit("unknown field")),
        F.when(~members["timestamp"].rlike(_TIME), F.lit("timestamp: no date, time and offset")),
        F.when(_unknown(finding_keys, _FINDING_KEYS), F.lit("findings: unknown field")),
        F.when(_unknown(F.json_object_keys(members["attachment"]), _ATTACHMENT_KEYS), F.lit("attachment: unknown field")))
    checked = validate_events(parsed.select("*", "e.*").drop("e"))
    return checked.withColumn("errors", F.concat(extra, "errors")).drop("__plain", "__members")


def split_valid(parsed: DataFrame, column: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid events, rejected raw records with their errors)."""
    bad = F.size("errors") > 0
    return parsed.where(~bad).drop("errors", column), parsed.where(bad).select(column, "errors")


def read_events(source: str | DataFrame, spark: SparkSession | None = None) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected) from a path of one-event-per-line JSON, or from a frame
    (batch or streaming) with a ``value`` column."""
    lines = spark.read.text(source) if isinstance(source, str) else source
    return split_valid(parse_events(lines))


def unfold_batches(lines: DataFrame, batch_id: str) -> DataFrame:
    """``{"events": [...]}`` bodies → one row per event, numbered inside its batch."""
    events = F.from_json(F.get_json_object("value", "$.events"), "array<string>")
    return lines.select(batch_id, F.posexplode_outer(events).alias("position", "value"))


def check_batches(df: DataFrame, batch_id: str = "batch_id", largest: int = schema.MAX_BATCH):
    """(events of batches with 1..500 events, sizes of the batches refused)."""
    sizes = df.groupBy(batch_id).agg(F.count("value").alias("events"))
    refused = sizes.where(~F.col("events").between(1, largest))
    return df.join(refused.select(batch_id), batch_id, "left_anti"), refused


def read_requests(df: DataFrame, body: str = "body") -> DataFrame:
    """Chat request log (host, url, body): parse the body once, keep JSON objects and arrays."""
    parsed = df.withColumn("json", F.try_parse_json(body))
    return parsed.where(F.schema_of_variant("json").rlike("^(OBJECT|ARRAY)"))


_AUDIT_LINE = (r'method=(\S*) path=(\S*) query=(.*?) status=(\d+) remote=(.*?) '
               r'ua="(.*)" principal=(.*) latencyMs=(\d+)$')
# Paths that are never audited.
UNAUDITED_PATHS = r"^(/v1/health|/actuator|/v1/live)"


def read_audit(lines: DataFrame, column: str = "value") -> DataFrame:
    """``key=value`` access-audit lines → columns; probes and live sockets skipped."""
    def part(group: int):
        return F.regexp_extract(column, _AUDIT_LINE, group)

    rows = lines.where(F.col(column).rlike(_AUDIT_LINE)).select(
        part(1).alias("method"), part(2).alias("path"), F.nullif(part(3), F.lit("-")).alias("query"),
        part(4).cast("int").alias("status"), part(5).alias("remote"), part(6).alias("ua"),
        part(7).alias("principal"), part(8).cast("bigint").alias("latency_ms"))
    return rows.where(~F.col("path").rlike(UNAUDITED_PATHS))


# Weights of the synthetic event generator.
_LLMS = [("ChatGPT", 50, "chatgpt.com"), ("Claude", 25, "claude.ai"), ("Gemini", 13, "gemini.google.com"),
         ("Copilot", 8, "copilot.microsoft.com"), ("Mistral", 2, "chat.mistral.ai"),
         ("DeepSeek", 1, "chat.deepseek.com"), ("Perplexity", 1, "www.perplexity.ai")]
_ACTIONS = [("CLEAN", 65), ("PII_DETECTED", 22), ("ANONYMIZED", 11), ("BLOCKED", 2)]
FINDING_TYPES = [
    ("email", "medium", 60), ("phone", "medium", 40), ("name", "medium", 50), ("address", "medium", 20),
    ("ip", "low", 25), ("iban", "high", 10), ("credit_card", "critical", 5), ("ssn", "critical", 3),
    ("password", "critical", 4), ("health", "critical", 8), ("biometric", "critical", 2),
    ("emotion_workplace", "critical", 1)]
_DEVICES = 6


def _weighted(draw, values, weights):
    """Pick a value by cumulative weight from a uniform draw in [0, 1)."""
    reached, choice, total = 0, None, sum(weights)
    for value, weight in zip(values, weights):
        reached += weight
        test = draw * total < reached
        choice = F.when(test, value) if choice is None else choice.when(test, value)
    return choice.otherwise(values[-1])


def _uuid_from(*parts):
    digest = F.md5(F.concat_ws("/", *parts))
    return F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def generate_events(spark: SparkSession, n: int, seed: int = 42, now="2024-01-31 00:00:00", org: str = "default",
                    spread_days: int = 30, version: str = "2.0.0") -> DataFrame:
    """``n`` synthetic wire events; same seed, same rows, whatever the partitioning."""
    types, severities, weights = zip(*FINDING_TYPES)
    severity_of = F.create_map(*[F.lit(x) for t, s in zip(types, severities) for x in (t, s)])
    # Every draw is a column, and so is every list that is read more than once: an expression is computed at each mention.
    names = ["llm", "action", "device", "picks", "time", "length", *[f"{what}{i}" for i in range(3) for what in ("type", "count")]]
    draws = spark.range(n).select("id", *[
        (F.pmod(F.xxhash64(F.lit(seed), F.lit(name), "id"), F.lit(1 << 40)) / float(1 << 40)).alias(f"u_{name}") for name in names])

    def draw(name: str):
        return F.col(f"u_{name}")

    picks = F.array(*[F.struct(_weighted(draw(f"type{i}"), types, weights).alias("type"),
                               (F.floor(draw(f"count{i}") * 3) + 1).cast("int").alias("count")) for i in range(3)])
    base = draws.select(
        "id", _weighted(draw("llm"), *zip(*[(x[0], x[1]) for x in _LLMS])).alias("llm"),
        _weighted(draw("action"), *zip(*_ACTIONS)).alias("action"), F.floor(draw("device") * _DEVICES).cast("int").alias("d"),
        F.slice(picks, F.lit(1), F.floor(draw("picks") * 3).cast("int") + 1).alias("drawn"), draw("time"), draw("length"))
    first_of_type = F.filter("drawn", lambda p, i: F.array_position(F.col("drawn")["type"], p["type"]) == i + 1)
    findings = F.when(F.col("action") == "CLEAN", F.array().cast(f"array<{schema.FINDING}>")).otherwise(
        F.transform(first_of_type, lambda p: F.struct(
            p["type"].alias("type"), severity_of[p["type"]].alias("severity"), p["count"].alias("count"))))
    host = F.create_map(*[F.lit(x) for llm, _, h in _LLMS for x in (llm, h)])
    seconds = (draw("time") * spread_days * 86400).cast("bigint")
    clean = F.col("action") == "CLEAN"
    rows = base.withColumn("findings", findings)
    return rows.select(
        _uuid_from(F.lit(str(seed)), F.lit("event"), "id").alias("eventId"),
        _uuid_from(F.lit(str(seed)), F.lit("device"), "d").alias("deviceId"), F.lit(org).alias("orgId"),
        F.format_string("user-%d@example.org", F.col("d")).alias("userHint"),
        (F.lit(now).cast("timestamp") - F.make_dt_interval(secs=seconds)).alias("timestamp"),
        host[F.col("llm")].alias("hostname"), "llm", "action",
        F.concat(F.lit("/backend-api/conversation/"), _uuid_from(F.lit(str(seed)), F.lit("path"), "id")).alias("endpoint"),
        F.when(F.col("action") == "BLOCKED", "block").otherwise("anonymize").alias("mode"),
        (F.floor(draw("length") * 1800) + 80).cast("int").alias("promptLength"),
        F.aggregate("findings", F.lit(0), lambda acc, f: acc + f["count"]).alias("mappingsCount"),
        F.when(clean, "no finding").otherwise(F.concat(F.lit("found: "), F.array_join("findings.type", ", "))).alias("anonymizedPreview"),
        "findings", F.lit(None).cast(schema.ATTACHMENT).alias("attachment"),
        F.lit(version).alias("extensionVersion"), F.lit(1).alias("schemaVersion"))


