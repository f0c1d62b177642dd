"""The registered queries restated as SQL over the same tables."""

from __future__ import annotations

from veilspark import dims
from veilspark.operators import compliance as co
from veilspark.plans.derived import ACTION_OF, NOW, SEVERITIES, TYPES
from veilspark.schema import SERVICES


def _lit(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(_lit(v) for v in value) + "]"
    return str(value) if isinstance(value, (int, float)) else "'" + value.replace("'", "''") + "'"


def _values(name: str, columns: str, rows) -> str:
    body = ", ".join("(" + ", ".join(_lit(v) for v in row) + ")" for row in rows)
    return f"{name}({columns}) AS (VALUES {body})"


_ACTION = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ACTION_OF.items()) + " END"
_K = "CAST(regexp_extract(props, '\"k\": ?([0-9]+)', 1) AS INTEGER)"
DET = f"""det AS (
  SELECT event_id, ts AS "timestamp", user_id AS device_id,
    CASE WHEN user_id % 10 = 0 THEN 'acme' ELSE 'default' END AS org_id,
    ({_lit(SERVICES)})[CAST(user_id % 9 AS INTEGER) + 1] AS llm, {_ACTION} AS action,
    CASE WHEN event_type = 'error' THEN 'block' ELSE 'anonymize' END AS mode,
    80 + (event_id * 7919) % 1800 AS prompt_length, event_type <> 'view' AS has_finding,
    CASE WHEN event_type <> 'view' THEN ({_lit(TYPES)})[{_K} % 12 + 1] END AS f_type,
    CASE WHEN event_type <> 'view' THEN ({_lit(SEVERITIES)})[{_K} % 12 + 1] END AS f_severity,
    CASE WHEN event_type <> 'view' THEN 1 + {_K} % 3 END AS f_count,
    '2.0.' || (user_id % 3) AS extension_version
  FROM events)"""
_SINCE = {"24h": "INTERVAL 1 DAY", "7d": "INTERVAL 7 DAYS", "30d": "INTERVAL 30 DAYS"}
_NOW = f"TIMESTAMP '{NOW}'"
SCOPE = f"""{DET}, scope AS (
  SELECT * FROM det WHERE org_id = 'default' AND "timestamp" >= {_NOW} - {_SINCE["30d"]})"""
STATS = f"""{SCOPE},
by_llm AS (SELECT llm, count(*) AS "count" FROM scope GROUP BY llm),
by_type AS (SELECT f_type AS type, CAST(sum(f_count) AS BIGINT) AS "count" FROM scope WHERE has_finding
            GROUP BY f_type ORDER BY 2 DESC, 1 LIMIT 50),
totals AS (SELECT count(*) AS total, count(*) FILTER (action = 'CLEAN') AS clean,
  count(*) FILTER (action = 'PII_DETECTED') AS flagged, count(*) FILTER (action = 'BLOCKED') AS blocked,
  count(*) FILTER (action = 'ANONYMIZED') AS anonymized FROM scope)"""
DIMS = ", ".join([
    _values("articles", "article_id, framework, number, title", dims.ARTICLES),
    _values("type_articles", "type, article_ids", dims.TYPE_ARTICLES.items()),
    _values("jurisdictions", "llm, company, country, country_code, region, adequacy, basis, lat, lng", dims.JURISDICTIONS),
    _values("tiers", "tier_order, tier, label, obligations", [(i, *t) for i, t in enumerate(dims.RISK_TIERS)]),
    _values("prohibited", "type, reason", dims.PROHIBITED),
])
TYPED = """typed AS (
  SELECT b.type, b."count", coalesce(a.article_ids, ['gdpr-4']) AS article_ids, a.type IS NOT NULL AS known
  FROM by_type b LEFT JOIN type_articles a ON lower(b.type) = a.type),
numbered AS (
  SELECT type, "count", list_transform(article_ids, lambda a: number_of[a]) AS numbers
  FROM typed, (SELECT map_from_entries(list((article_id, number))) AS number_of FROM articles))"""
SCORE = f"""parts AS (
  SELECT t.*, greatest(1, total) AS n,
    CASE WHEN total - clean > 0 THEN anonymized / (total - clean) ELSE 1 END AS anonymization_rate,
    CASE WHEN total - clean > 0 THEN blocked / (total - clean) ELSE 0 END AS block_rate,
    (SELECT coalesce(sum("count"), 0) FROM by_type WHERE type IN ({_lit(co.CRITICAL_EXPOSURE_TYPES)[1:-1]})) AS critical,
    (SELECT coalesce(sum("count" * CASE adequacy WHEN 'no_adequate' THEN 1.0 WHEN 'scc_required' THEN 0.5
       WHEN 'dpf' THEN 0.2 ELSE 0 END), 0) FROM by_llm JOIN jurisdictions USING (llm)) AS weighted
  FROM totals t),
points AS (
  SELECT *, critical / n AS critical_exposure, weighted / n AS transfer_risk,
    least(1, anonymization_rate + block_rate) * 45 AS coverage,
    (1 - least(1, critical / n * 20)) * 25 AS critical_part,
    (1 - least(1, weighted / n)) * 20 AS transfer_part, clean / n * 10 AS hygiene FROM parts),
scored AS (
  SELECT *, CAST(floor(coverage + critical_part + transfer_part + hygiene + 0.5) AS BIGINT) AS score,
    CAST(floor(coverage + 0.5) AS BIGINT) AS coverage_points, CAST(floor(critical_part + 0.5) AS BIGINT) AS critical_points,
    CAST(floor(transfer_part + 0.5) AS BIGINT) AS transfer_points, CAST(floor(hygiene + 0.5) AS BIGINT) AS hygiene_points
  FROM points),
graded AS (SELECT *, CASE WHEN score >= 90 THEN 'A' WHEN score >= 75 THEN 'B' WHEN score >= 60 THEN 'C'
  WHEN score >= 45 THEN 'D' ELSE 'F' END AS grade FROM scored)"""
PLACED = f"""placed AS (
  SELECT b.llm, b."count", coalesce(j.company, b.llm) AS company, coalesce(j.country, {_lit(dims.UNKNOWN_COUNTRY)}) AS country,
    coalesce(j.country_code, {_lit(dims.UNKNOWN_CODE)}) AS country_code, coalesce(j.region, {_lit(dims.UNKNOWN_REGION)}) AS region,
    coalesce(j.adequacy, {_lit(dims.UNKNOWN_ADEQUACY)}) AS adequacy, coalesce(j.basis, {_lit(dims.UNKNOWN_BASIS)}) AS basis,
    j.llm IS NOT NULL AS known
  FROM by_llm b LEFT JOIN jurisdictions j USING (llm))"""
_TIER_RULES = [("unacceptable", "prohibited", """has_prohibited AND "count" > 50"""),
               ("high", "critical", """has_critical AND "count" > 100"""),
               ("high", "jurisdiction", "coalesce(adequacy = 'no_adequate', false)"),
               ("limited", "volume", '"count" > 50'), ("minimal", "none", "true")]
TIERED = f"""tiered AS (
  SELECT b.llm, b."count", CASE {" ".join(f"WHEN {c} THEN '{t}'" for t, _, c in _TIER_RULES)} END AS tier,
    CASE {" ".join(f"WHEN {c} THEN {_lit(co.TIER_REASONS[r])}" for _, r, c in _TIER_RULES)} END AS reason
  FROM by_llm b LEFT JOIN jurisdictions j USING (llm),
    (SELECT count(*) FILTER (type IN (SELECT type FROM prohibited) AND "count" > 0) > 0 AS has_prohibited,
            count(*) FILTER (type IN ({_lit(co.TIER_CRITICAL_TYPES)[1:-1]})) > 0 AS has_critical FROM by_type))"""
FIRST = f"""first_one AS (
  SELECT min("timestamp") AS first_critical FROM det WHERE org_id = 'default'
    AND "timestamp" >= {_NOW} - INTERVAL 72 HOURS AND f_type IN ({_lit(co.BREACH_TYPES)[1:-1]}))"""

# ---------------------------------------------------------------- text scans
CARD, IP = r"\b(?:\d{4}[\s-]?){3}\d{4}\b", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"
_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_DIGITS = "regexp_replace(v, '[^0-9]', '', 'g')"
_DOUBLED = f"CAST(substr({_DIGITS}, i, 1) AS INTEGER) * (1 + i % 2)"
LUHN = (f"list_sum(list_transform(range(1, 17), lambda i: {_DOUBLED} - CASE WHEN {_DOUBLED} > 9 THEN 9 ELSE 0 END)) % 10 = 0")


def _matches(name: str, pattern: str, valid: str, source: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"""{name} AS (
  SELECT {key}, v, CAST(pos AS INTEGER) AS "start", CAST(pos + length(v) AS INTEGER) AS "end" FROM (
    SELECT {key}, vals[n] AS v, list_sum(list_transform(gaps[1:n], lambda g: length(g)))
      + coalesce(list_sum(list_transform(vals[1:n - 1], lambda g: length(g))), 0) AS pos
    FROM (SELECT {key}, regexp_extract_all({text}, '{pattern}') AS vals, string_split_regex({text}, '{pattern}') AS gaps
          FROM {source} WHERE regexp_matches({text}, '{pattern}')), unnest(range(1, len(vals) + 1)) AS r(n))
  WHERE {valid})"""


_IP_OK = f"regexp_matches(v, '^{_OCTET}(\\.{_OCTET}){{3}}$')"
BUILTIN = f"""{_matches("cards", CARD, LUHN)}, {_matches("ips", IP, _IP_OK)},
found AS (
  SELECT doc_id, 'builtin-card' AS rule_id, "start", "end", v AS value, 'anonymize' AS action, 'critical' AS severity,
    'CARD' AS label FROM cards
  UNION ALL SELECT doc_id, 'builtin-ip', "start", "end", v, 'anonymize', 'low', 'IP' FROM ips)"""


def _fnv(text: str) -> str:
    """First six hex digits of 32-bit FNV-1a over an ASCII expression."""
    codes = f"list_transform(range(1, length({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    folded = f"list_reduce(list_prepend(CAST(2166136261 AS BIGINT), {codes}), lambda h, c: (xor(h, c) * 16777619) % 4294967296)"
    return f"substr(printf('%08x', {folded}), 1, 6)"


VAULT = f"""{BUILTIN}, entries AS (
  SELECT d.lang AS session, f.value, arg_min(f.label, (f.doc_id, f."start")) AS label, count(*) AS uses,
    min((f.doc_id, f."start")) AS first_seen
  FROM found f JOIN documents d USING (doc_id) GROUP BY 1, 2),
based AS (SELECT *, {_fnv("('s1:' || value)")} AS base FROM entries),
vault AS (
  SELECT session, value, label, uses, first_seen, CASE WHEN number = 1 THEN '[' || label || '_' || base || ']'
    ELSE '[' || label || '_' || base || '_' || number || ']' END AS placeholder
  FROM (SELECT *, row_number() OVER (PARTITION BY session, label, base ORDER BY first_seen, value) AS number FROM based))"""
HIDDEN = f"""{VAULT}, pieces AS (
  SELECT doc_id, lang, text, regexp_extract_all(text, '{CARD}|{IP}') AS vals, string_split_regex(text, '{CARD}|{IP}') AS gaps
  FROM documents),
hidden AS (
  SELECT p.doc_id, string_agg(gaps[n] || coalesce(v.placeholder, vals[n], ''), '' ORDER BY n) AS anonymized
  FROM pieces p, unnest(range(1, len(gaps) + 1)) AS r(n)
  LEFT JOIN vault v ON v.session = p.lang AND v.value = vals[n] GROUP BY p.doc_id)"""
WORD_SPLIT = r"[^\p{L}\p{N}_]+"

_REQ_TURNS = "conversations WHERE role = 'user'"


def _with(*ctes: str) -> str:
    return "WITH " + ", ".join(ctes) + " "


def _breach(select: str) -> str:
    return _with(STATS, FIRST) + f"""SELECT {select} FROM (
      SELECT *, critical >= 20 AND first_critical IS NOT NULL AS active, first_critical + INTERVAL 72 HOURS AS due,
        greatest(0, epoch_ms(first_critical + INTERVAL 72 HOURS) - epoch_ms({_NOW})) AS ms
      FROM first_one, (SELECT coalesce(sum("count"), 0)::BIGINT AS critical FROM by_type
                       WHERE type IN ({_lit(co.BREACH_TYPES)[1:-1]})))"""


_PCT = "CAST(floor({0} * 100 + 0.5) AS BIGINT) || '%'"
_FLAWS = [(41, "eventId: not a uuid"), (43, "orgId: malformed"), (47, "llm: not allowed"), (53, "action: not allowed"),
          (59, "promptLength: must be at least 0"), (79, "findings: bad element"), (83, "attachment: malformed"), (61, "extensionVersion: malformed"), (67, "schemaVersion: must be 1")]
_ERRORS = "list_filter([" + ", ".join(
    ["CASE WHEN event_id % 71 = 1 THEN 'unknown field' END", "CASE WHEN event_id % 73 = 1 THEN 'timestamp: no date, time and offset' END"]
    + [f"CASE WHEN event_id % {n} = 1 THEN '{e}' END" for n, e in _FLAWS]) + "], lambda e: e IS NOT NULL)"
_VALID = " AND ".join(f"event_id % {n} <> 1" for n, _ in [*_FLAWS, (71, ""), (73, "")])
_HALVES = f"""{DET}, halves AS (
  SELECT *, CASE WHEN device_id % 4 = 0 THEN 'user' || event_id END AS user_hint FROM det),
early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY "timestamp" DESC, event_id) AS rn
  FROM halves WHERE "timestamp" < TIMESTAMP '2024-01-02') WHERE rn = 1),
late AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY "timestamp" DESC, event_id) AS rn
  FROM halves WHERE "timestamp" >= TIMESTAMP '2024-01-02') WHERE rn = 1),
merged AS (
  SELECT coalesce(e.device_id, l.device_id) AS id, coalesce(e.org_id, l.org_id) AS org_id,
    coalesce(l.user_hint, e.user_hint) AS user_hint, coalesce(l.extension_version, e.extension_version) AS extension_version,
    '' AS token_hash, epoch_us(CASE WHEN e.device_id IS NULL THEN {_NOW} ELSE TIMESTAMP '2024-01-15' END) AS created_at,
    epoch_us(CASE WHEN l.device_id IS NULL THEN TIMESTAMP '2024-01-15' ELSE {_NOW} END) AS last_seen_at, false AS revoked
  FROM early e FULL JOIN late l USING (device_id))"""
_LIMITER = """RECURSIVE log AS (
  SELECT CAST(user_id AS VARCHAR) AS ip, epoch_us(ts) AS ts, event_type = 'error' AS failed,
    row_number() OVER (PARTITION BY user_id ORDER BY ts) AS rn FROM events WHERE event_type IN ('error', 'signup')),
walk AS (
  SELECT ip, rn, CASE WHEN failed THEN ts END AS opened, CASE WHEN failed THEN 1 ELSE 0 END AS failures, ts FROM log WHERE rn = 1
  UNION ALL
  SELECT l.ip, l.rn,
    CASE WHEN NOT l.failed THEN NULL WHEN w.opened IS NULL OR l.ts - w.opened > 604800000000 THEN l.ts ELSE w.opened END,
    CASE WHEN NOT l.failed THEN 0 WHEN w.opened IS NULL OR l.ts - w.opened > 604800000000 THEN 1 ELSE w.failures + 1 END, l.ts
  FROM walk w JOIN log l ON l.ip = w.ip AND l.rn = w.rn + 1)"""
_BLOCKS = f"WITH {_LIMITER} SELECT ip, opened AS window_start, ts AS blocked_at FROM walk WHERE failures = 3"
_ROLLUP = _with(DET) + """SELECT epoch_us(date_trunc('day', "timestamp")) AS day, org_id, llm, action, count(*) AS n,
  CAST(sum(prompt_length) AS BIGINT) AS total_prompt_length FROM det GROUP BY 1, 2, 3, 4"""
_LABELLED = """labelled AS (SELECT lang AS session, doc_id AS at_, source AS value, CASE WHEN doc_id % 3 = 0 THEN 'EVEN' ELSE 'ODD' END AS label
  FROM documents)"""
_DIGITS = _matches("digits", "[0-9]+", "true", "(SELECT * FROM documents WHERE length(text) >= 12)")
_CLOCK = _with(DET) + f"""SELECT org_id, CAST(critical AS BIGINT) AS critical, critical >= 20 AND f IS NOT NULL AS active,
    CASE WHEN critical >= 20 THEN epoch_us(f) END AS triggered_at,
    CASE WHEN critical >= 20 THEN epoch_us(f + INTERVAL 72 HOURS) END AS deadline FROM (
      SELECT org_id, coalesce(sum(f_count) FILTER ("timestamp" >= TIMESTAMP '2024-01-30 12:30:07' - INTERVAL 7 DAYS), 0) AS critical,
        min("timestamp") FILTER ("timestamp" >= TIMESTAMP '2024-01-30 12:30:07' - INTERVAL 72 HOURS) AS f
      FROM det WHERE f_type IN ({_lit(co.BREACH_TYPES)[1:-1]}) GROUP BY 1)"""
_AUDIT = """audit AS (SELECT *, (['/v1/stats','/v1/events','/v1/devices','/v1/health','/actuator/info'])[event_id % 5 + 1] AS path,
  CASE WHEN event_type = 'error' THEN 429 ELSE 200 END AS status, 'jwt:user' || user_id AS principal,
  event_id % 97 AS latency FROM events WHERE event_id % 5 < 3)"""
_AUDIT_AGG = """count(*) AS requests, count(*) FILTER (status >= 400) AS errors, CAST(sum(latency) AS BIGINT) AS total_latency_ms,
  max(latency) AS max_latency_ms, round(quantile_cont(latency, 0.95), 6) AS p95_latency_ms"""
_ROPA_CELLS = f"""'default' AS controller, 'Assistance IA (' || llm || ')' AS purpose,
  type || ' (' || type_count || ' occurrences)' AS category, llm || ' — ' || coalesce(company, 'inconnu') AS recipient,
  CASE WHEN region <> 'EU' THEN country || ' — ' || basis ELSE 'Non' END AS transfer,
  'Intérêt légitime (Art. 6(1)(f))' AS basis, '30 jours (télémétrie)' AS retention,
  'Anonymisation veilspark' AS measures, array_to_string(numbers, '; ') AS articles"""
_ROPA = f"""SELECT {_ROPA_CELLS} FROM (
  SELECT b.llm, n.type, n."count" AS type_count, n.numbers, j.company, j.country, j.region, j.basis
  FROM by_llm b LEFT JOIN jurisdictions j USING (llm) CROSS JOIN numbered n)"""
_ROPA_ALIASES = ["controller", "purpose", "category", "recipient", "transfer", "basis", "retention", "measures", "articles"]
_MASK = """CASE WHEN length(trim(value)) <= 4 THEN '••••' ELSE substr(trim(value), 1, 2)
  || repeat('•', least(8, length(trim(value)) - 3)) || right(trim(value), 1) END"""


def _word_hits(*words: str) -> str:
    return f"len(list_filter(tokens, lambda t: lower(t) IN ({_lit(list(words))[1:-1]})))"


_WORDS = f"""tokenized AS (SELECT doc_id, string_split_regex(text, '{WORD_SPLIT}') AS tokens FROM documents),
counted AS (
  SELECT doc_id, {_word_hits("thsh", "elle")} AS black, {_word_hits("the", "les", "der")} AS arts,
    CASE WHEN {_word_hits("that")} > 0 AND {_word_hits("which", "with")} > 0 THEN {_word_hits("that", "which", "with")} ELSE 0 END AS near
  FROM tokenized)"""
_EMAIL = r"[\p{L}\p{N}._%+-]+@[a-zA-Z0-9.-]+\.[a-zA-Z]{2,}"
_EMAILS = f"""SELECT doc_id, v AS value FROM (
  SELECT doc_id, unnest(regexp_extract_all(text, '{_EMAIL}')) AS v FROM documents)
  WHERE regexp_matches(v, '^[a-zA-Z0-9._%+-]+@')"""


_NUMBERS = _matches("numbers", r"\b[0-9]{3,}\b", "true")
_TAGGED = f"""tagged AS (SELECT doc_id, unnest(string_split_regex(text, '{WORD_SPLIT}')) AS word
  FROM documents WHERE length(text) >= 12)"""
_PLACEHOLDER_OF = f"""CASE WHEN contains(v, '.') THEN CASE WHEN {_IP_OK} THEN '[IP_' || {_fnv("('s1:' || v)")} || ']' ELSE v END
  WHEN {LUHN} THEN '[CARD_' || {_fnv("('s1:' || v)")} || ']' ELSE v END"""
_TURNS_HIDDEN = f"""turn_pieces AS (
  SELECT conv_id, turn, regexp_extract_all(text, '{CARD}|{IP}') AS vals, string_split_regex(text, '{CARD}|{IP}') AS gaps
  FROM {_REQ_TURNS}),
turns_hidden AS (
  SELECT conv_id, turn, string_agg(gap || CASE WHEN v IS NULL THEN '' ELSE {_PLACEHOLDER_OF} END, '' ORDER BY n) AS prompt
  FROM (SELECT conv_id, turn, n, gaps[n] AS gap, vals[n] AS v FROM turn_pieces, unnest(range(1, len(gaps) + 1)) AS r(n))
  GROUP BY 1, 2)"""


def _dpia() -> str:
    residual = " ".join(f"WHEN '{k}' THEN {_lit(v)}" for k, v in co.RESIDUAL_RISK.items())
    score = [("organisation", "'default'"), ("score", "score"), ("grade", "grade"),
             ("residual_risk", f"CASE grade {residual} ELSE {_lit(co.RESIDUAL_RISK_OTHER)} END")]
    volume = [("total", "total"), ("clean", "clean"), ("clean_pct", "CAST(floor(clean / greatest(1, total) * 100 + 0.5) AS BIGINT)"),
              ("anonymized", "anonymized"), ("blocked", "blocked"), ("flagged", "flagged")]

    def singles(section, source, items):
        return [f"SELECT '{section}' AS section, {i} AS position, '{k}' AS item, CAST({v} AS VARCHAR) AS value FROM {source}"
                for i, (k, v) in enumerate(items, 1)]

    def ranked(section, source, item, value, order):
        return (f"SELECT '{section}', CAST(row_number() OVER (ORDER BY {order}) AS INTEGER), {item}, {value} FROM {source}")

    by = '"count" DESC, llm'
    parts = singles("summary", "graded", score) + singles("volume", "totals", volume) + [
        ranked("data_categories", '(SELECT * FROM numbered ORDER BY "count" DESC, type LIMIT 10)', "type",
               """"count" || ' | ' || array_to_string(numbers, ', ')""", '"count" DESC, type'),
        ranked("recipients", "placed", "llm", """company || ' | ' || country || ' | ' || "count" || ' | ' || basis""", by),
        ranked("without_adequacy", "(SELECT * FROM placed WHERE adequacy IN ('no_adequate', 'scc_required'))", "llm", "adequacy", by),
        ranked("risk", "tiered JOIN tiers USING (tier)", "llm", "label || ' | ' || reason", by),
        ranked("prohibited", "by_type JOIN prohibited USING (type)", "type", """"count" || ' | ' || reason""", '"count" DESC, type')]
    return _with(STATS, DIMS, TYPED, SCORE, PLACED, TIERED) + " UNION ALL ".join(parts)


def oracle_sql() -> dict[str, str]:
    stats = _with(STATS, DIMS)
    return {
        "events_since_7d": _with(DET) + f"""SELECT event_id, llm, action FROM det WHERE org_id = 'default'
            AND "timestamp" >= {_NOW} - INTERVAL 7 DAYS""",
        "events_has_severity": _with(DET) + "SELECT event_id, org_id FROM det WHERE f_severity = 'critical'",
        "events_wire_projection": _with(DET) + """SELECT event_id AS "eventId", epoch_us("timestamp") AS "timestamp",
            device_id AS "deviceId", CAST(NULL AS VARCHAR) AS "userHint", CAST(NULL AS VARCHAR) AS hostname, llm, action, CAST(NULL AS VARCHAR) AS endpoint, mode,
            prompt_length AS "promptLength", coalesce(f_count, 0) AS "mappingsCount", CAST(NULL AS VARCHAR) AS "anonymizedPreview",
            f_type AS finding_type, f_severity AS finding_severity, f_count AS finding_count,
            extension_version AS "extensionVersion" FROM det""",
        "events_page": _with(SCOPE) + """SELECT event_id, epoch_us("timestamp") AS "timestamp", action FROM (
            SELECT * FROM scope WHERE llm = 'ChatGPT' ORDER BY "timestamp" DESC, event_id LIMIT 50 OFFSET 50)
            WHERE f_severity = 'critical'""",
        "events_validation_errors": "SELECT event_id, unnest(" + _ERRORS.replace(
            "CASE WHEN event_id % 71 = 1 THEN 'unknown field' END, CASE WHEN event_id % 73 = 1 THEN 'timestamp: no date, time and offset' END, ", "") + ") AS error FROM events",
        "events_read_closed_schema": f"""SELECT array_to_string({_ERRORS}, '; ') AS errors, count(*) AS n,
            CAST(sum(CASE WHEN event_id % 59 = 1 THEN -5 ELSE 80 + (event_id * 7919) % 1800 END) AS BIGINT) AS prompt_length
            FROM events GROUP BY 1""",
        "events_batch_sizes": """SELECT event_id % 3 * (event_id % 7) AS batch_id, count(*) AS events,
            count(*) <= 500 AS accepted FROM events GROUP BY 1""",
        "events_new_and_duplicate": """WITH batch AS (SELECT event_id, ts, 1 AS copy FROM events WHERE ts >= TIMESTAMP '2024-01-10'
              UNION ALL SELECT event_id, ts, 2 FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND event_id % 7 = 0)
            SELECT count(*) FILTER (ts >= TIMESTAMP '2024-01-15') AS n, 'accepted' AS what FROM batch
            UNION ALL SELECT count(DISTINCT event_id) FILTER (ts < TIMESTAMP '2024-01-15'), 'duplicates' FROM batch
            UNION ALL SELECT count(DISTINCT event_id) FILTER (ts >= TIMESTAMP '2024-01-15'), 'stored' FROM batch""",
        "events_existing_ids": "SELECT event_id FROM events WHERE event_type = 'view'",
        "events_table_round_trip": _with(DET) + """SELECT org_id, CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS event_date,
            count(*) AS n, CAST(sum(prompt_length) AS BIGINT) AS prompt_length FROM det
            WHERE CAST("timestamp" AS DATE) BETWEEN DATE '2024-01-08' AND DATE '2024-01-14' GROUP BY 1, 2""",
        "events_stored_range": _with(DET) + f"""SELECT f_type AS type, CAST(sum(f_count) AS BIGINT) AS "count" FROM det
            WHERE has_finding AND org_id = 'default' AND "timestamp" >= {_NOW} - INTERVAL 7 DAYS GROUP BY 1""",
        "events_purged": "SELECT count(*) AS before, CAST(0 AS BIGINT) AS after, true AS same_columns FROM events",
        "events_newest_500": """SELECT event_id, epoch_us(ts) AS "timestamp" FROM events ORDER BY ts DESC, event_id LIMIT 500""",
        "events_recent_10": _with(DET) + """SELECT event_id, action FROM det ORDER BY "timestamp" DESC, event_id LIMIT 10""",
        "events_newest_20_per_org": _with(DET) + """SELECT org_id, event_id FROM (SELECT *, row_number() OVER (
            PARTITION BY org_id ORDER BY "timestamp" DESC, event_id) AS rn FROM det) WHERE rn <= 20""",
        "devices_latest_event": _with(DET) + """SELECT device_id, event_id, epoch_us("timestamp") AS "timestamp", action FROM (
            SELECT *, row_number() OVER (PARTITION BY device_id ORDER BY "timestamp" DESC, event_id) AS rn FROM det) WHERE rn = 1""",
        "devices_upsert": _with(_HALVES) + "SELECT * FROM merged",
        "devices_counts_24h": _with(_HALVES) + f"""SELECT e.device_id AS id, e.user_hint, e.extension_version,
            epoch_us(TIMESTAMP '2024-01-15') AS last_seen_at, false AS revoked, coalesce(c.n, 0) AS events_24h
            FROM early e LEFT JOIN (SELECT device_id, count(*) AS n FROM det WHERE org_id = 'default'
              AND "timestamp" >= {_NOW} - INTERVAL 1 DAY GROUP BY 1) c USING (device_id) WHERE e.org_id = 'default'""",
        "devices_by_recency": _with(_HALVES) + "SELECT id, last_seen_at FROM merged WHERE org_id = 'default'",
        "devices_revoked": _with(_HALVES) + """, asked AS (SELECT DISTINCT user_id AS id FROM events WHERE event_type = 'signup')
            SELECT org_id, CAST(device_id IN (SELECT id FROM asked) AND org_id = 'default' AS VARCHAR) AS state, count(*) AS n FROM early GROUP BY 1, 2
            UNION ALL SELECT 'default', 'not found', count(*) FROM asked
            WHERE id NOT IN (SELECT device_id FROM early WHERE org_id = 'default')""".replace(") , asked", "), asked"),
        "orgs_ensured": f"""SELECT 'default' AS id, 'Default Organization' AS name, epoch_us(TIMESTAMP '2024-01-01') AS created_at
            UNION ALL SELECT 'acme', 'acme', epoch_us({_NOW}) FROM (SELECT 1 FROM events WHERE user_id % 10 = 0 LIMIT 1)""",
        "stats_count_by_action": _with(SCOPE) + 'SELECT action, count(*) AS "count" FROM scope GROUP BY 1',
        "stats_count_by_llm": _with(STATS) + "SELECT * FROM by_llm",
        "stats_top_finding_types": _with(STATS) + "SELECT * FROM by_type",
        "stats_count_by_device": _with(DET) + f"""SELECT device_id, count(*) AS "count" FROM det WHERE org_id = 'default'
            AND "timestamp" >= {_NOW} - INTERVAL 1 DAY GROUP BY 1""",
        "stats_daily_rollup": _ROLLUP,
        "stats_every_type": _with(SCOPE) + """SELECT 't' || (event_id % 80) AS type, CAST(sum(f_count) AS BIGINT) AS "count" FROM scope
            WHERE has_finding GROUP BY 1""",
        "stats_summary": _with(STATS) + " UNION ALL ".join(
            [f"""SELECT 'total' AS kind, '{c}' AS key, {c} AS "count" FROM totals"""
             for c in ("total", "clean", "flagged", "blocked", "anonymized")]
            + ["""SELECT 'by_llm', llm, "count" FROM by_llm""", """SELECT 'by_type', type, "count" FROM by_type"""]),
        "stats_llm_shares": _with(STATS) + """SELECT llm, "count", floor("count" / sum("count") OVER () * 1000 + 0.5) / 10 AS pct FROM by_llm""",
        "stats_headline_rates": _with(STATS) + """SELECT CAST((SELECT count(*) FROM by_llm) AS INTEGER) AS distinct_llms,
            CAST(floor(anonymized / total * 100 + 0.5) AS BIGINT) AS anonymized_pct,
            CAST(floor(blocked / total * 100 + 0.5) AS BIGINT) AS blocked_pct FROM totals""",
        "stats_type_bars": _with(STATS) + """SELECT type, "count", round("count" / greatest(1, max("count") OVER ()) * 100, 6) AS pct
            FROM (SELECT * FROM by_type ORDER BY "count" DESC, type LIMIT 10)""",
        "stats_llm_by_count": _with(STATS) + """SELECT llm, "count", round("count" / greatest(1, max("count") OVER ()) * 100, 6) AS pct FROM by_llm""",
        "compliance_type_articles": _with(STATS, DIMS, TYPED) + """SELECT type, "count", array_to_string(article_ids, ',') AS articles FROM typed""",
        "compliance_jurisdictions": _with(STATS, DIMS, PLACED) + """SELECT llm, "count", company, country, region, adequacy FROM placed""",
        "compliance_article_index": stats + """SELECT article_id, CAST(sum("count") AS BIGINT) AS "count" FROM (
            SELECT type, unnest(article_ids) AS article_id FROM type_articles) JOIN by_type USING (type) GROUP BY 1""",
        "compliance_articles_by_framework": _with(STATS, DIMS, TYPED) + """SELECT article_id, number, title,
            CAST(coalesce((SELECT sum("count") FROM typed WHERE list_contains(article_ids, article_id)), 0) AS BIGINT) AS "count"
            FROM articles WHERE framework = 'GDPR'""",
        "compliance_score": _with(STATS, DIMS, SCORE) + """SELECT score, grade, round(anonymization_rate, 6) AS anonymization_rate,
            round(block_rate, 6) AS block_rate, round(critical_exposure, 6) AS critical_exposure,
            round(transfer_risk, 6) AS transfer_risk, coverage_points, critical_points, transfer_points, hygiene_points FROM graded""",
        "compliance_score_details": _with(STATS, DIMS, SCORE) + f"""
            SELECT 'Couverture anonymisation / blocage' AS label, coverage_points AS points, 45 AS weight,
              {_PCT.format("anonymization_rate")} || ' anonymisés, ' || {_PCT.format("block_rate")} || ' bloqués' AS note FROM graded
            UNION ALL SELECT 'Exposition de données critiques', critical_points, 25, critical || ' détections santé/biométrie/SSN/CB/mdp' FROM graded
            UNION ALL SELECT 'Risque de transfert hors UE', transfer_points, 20,
              {_PCT.format("transfer_risk")} || ' du trafic vers juridictions non-adéquates' FROM graded
            UNION ALL SELECT 'Hygiène globale', hygiene_points, 10, {_PCT.format("(clean / n)")} || ' de prompts propres' FROM graded""",
        "compliance_prohibited_alerts": stats + """SELECT type, reason, "count", 'aia-5' AS article_id FROM by_type JOIN prohibited USING (type)""",
        "compliance_first_critical": _with(DET, FIRST) + "SELECT epoch_us(first_critical) AS first_critical FROM first_one",
        "compliance_first_critical_newest_200": _with(DET) + f"""SELECT epoch_us(min("timestamp")) AS first_critical FROM (
            SELECT * FROM det WHERE org_id = 'default' ORDER BY "timestamp" DESC, event_id LIMIT 200)
            WHERE "timestamp" >= {_NOW} - INTERVAL 24 HOURS AND f_type IN ({_lit(co.BREACH_TYPES)[1:-1]})""",
        "compliance_breach_status": _breach("""active, CASE WHEN active THEN epoch_us(first_critical) END AS triggered_at,
            CASE WHEN active THEN epoch_us(due) END AS deadline, CAST(CASE WHEN active THEN ms ELSE 0 END AS BIGINT) AS remaining_ms,
            CASE WHEN active THEN critical || ' détections de catégories particulières (Art. 9 RGPD) dépassant le seuil de 20' ELSE '' END AS reason,
            lpad(CAST(CASE WHEN active THEN ms // 3600000 ELSE 0 END AS VARCHAR), 2, '0') AS hours,
            lpad(CAST(CASE WHEN active THEN ms % 3600000 // 60000 ELSE 0 END AS VARCHAR), 2, '0') AS minutes,
            lpad(CAST(CASE WHEN active THEN ms % 60000 // 1000 ELSE 0 END AS VARCHAR), 2, '0') AS seconds"""),
        "compliance_risk_tiers": _with(STATS, DIMS, TIERED) + "SELECT * FROM tiered",
        "compliance_tier_summary": _with(STATS, DIMS, TIERED) + """SELECT tier_order, t.tier, label, obligations, count(x.llm) AS services,
            CAST(coalesce(sum(x."count"), 0) AS BIGINT) AS prompts FROM tiers t LEFT JOIN tiered x USING (tier) GROUP BY 1, 2, 3, 4""",
        "compliance_transfer_rows": _with(STATS, DIMS, PLACED) + """SELECT llm, company, country, country_code, region, adequacy, basis, "count",
            round("count" / (SELECT greatest(1, total) FROM totals), 6) AS share FROM placed""",
        "compliance_adequacy_summary": _with(STATS, DIMS, PLACED) + """SELECT adequacy, CAST(sum("count") AS BIGINT) AS "count",
            floor(sum("count") / sum(sum("count")) OVER () * 1000 + 0.5) / 10 AS pct FROM placed GROUP BY 1""",
        "compliance_finding_rows": _with(STATS, DIMS, TYPED) + f"""SELECT type, "count", array_to_string(article_ids, ',') AS articles,
            CASE WHEN known AND (list_contains(article_ids, 'aia-5') OR list_contains(article_ids, 'gdpr-9')) THEN 'critical'
              WHEN type IN ({_lit(co.HIGH_TYPES)[1:-1]}) THEN 'high' WHEN type IN ({_lit(co.MEDIUM_TYPES)[1:-1]}) THEN 'medium'
              ELSE 'low' END AS severity FROM typed""",
        "compliance_finding_totals": _with(STATS, DIMS, TYPED) + """SELECT CAST(sum("count") AS BIGINT) AS total_occurrences,
            CAST(coalesce(sum("count") FILTER (list_contains(article_ids, 'gdpr-9')), 0) AS BIGINT) AS special_category,
            CAST(coalesce(sum("count") FILTER (array_to_string(article_ids, ',') LIKE '%aia-%'), 0) AS BIGINT) AS ai_act FROM typed""",
        "compliance_ropa": _with(STATS, DIMS, TYPED) + _ROPA,
        "compliance_ropa_csv": _with(STATS, DIMS, TYPED) + f"""SELECT '# RoPA veilspark — default — 2024-01-31' AS line
            UNION ALL SELECT {_lit(",".join(f'"{c}"' for c in co.ROPA_COLUMNS))}
            UNION ALL SELECT {" || ',' || ".join(f"'\"' || replace({a}, '\"', '\"\"') || '\"'" for a in _ROPA_ALIASES)} FROM ({_ROPA})""",
        "compliance_ropa_preview": _with(STATS, DIMS, TYPED, PLACED) + """
            SELECT 'Assistance IA via ' || p.llm AS purpose, n.type || ' (' || n."count" || ')' AS category,
              p.company || ' — ' || p.country AS recipient,
              CASE WHEN region = 'EU' THEN 'Intra-UE' WHEN adequacy = 'no_adequate' THEN 'Hors UE — non adéquat'
                WHEN adequacy = 'dpf' THEN 'Hors UE — DPF' ELSE 'Hors UE — SCC' END AS transfer,
              region <> 'EU' AS is_transfer, array_to_string(n.numbers, ', ') AS articles, p.llm, p."count" AS llm_count,
              n.type, n."count" AS type_count
            FROM (SELECT * FROM placed ORDER BY "count" DESC, llm LIMIT 4) p
            CROSS JOIN (SELECT * FROM numbered ORDER BY "count" DESC, type LIMIT 6) n""",
        "compliance_dpia_facts": _dpia(),
        "audit_by_path": _with(_AUDIT) + f"SELECT path, status, {_AUDIT_AGG} FROM audit GROUP BY 1, 2",
        "audit_by_principal": _with(_AUDIT) + f"SELECT principal, {_AUDIT_AGG} FROM audit GROUP BY 1",
        "auth_blocks": _BLOCKS,
        "scan_builtins": _with(BUILTIN) + "SELECT * FROM found",
        "scan_decisions": _with(BUILTIN) + """SELECT lang, CASE WHEN n > 0 THEN 'anonymize' END AS decision,
            CASE WHEN cards > 0 THEN 'critical' WHEN n > 0 THEN 'low' END AS max_severity, count(*) AS docs, CAST(sum(n) AS BIGINT) AS findings
            FROM (SELECT d.doc_id, d.lang, count(f.value) AS n, count(*) FILTER (f.severity = 'critical') AS cards
                  FROM documents d LEFT JOIN found f USING (doc_id) GROUP BY 1, 2) GROUP BY 1, 2, 3""",
        "scan_words": _with(_WORDS) + """SELECT doc_id, rule_id, CASE WHEN black > 0 THEN 'block' WHEN near > 0 THEN 'anonymize'
              ELSE 'warn' END AS decision, n FROM (
            SELECT *, unnest(['blacklist', 'articles', 'near']) AS rule_id, unnest([black, arts, near]) AS n FROM counted) WHERE n > 0""",
        "scan_emails": _EMAILS,
        "scan_whitelisted": f"""SELECT doc_id, CASE WHEN lower(t) = 'les' THEN 'articles' ELSE 'letters' END AS rule_id, count(*) AS n
            FROM (SELECT doc_id, unnest(string_split_regex(text, '{WORD_SPLIT}')) AS t FROM documents)
            WHERE lower(t) = 'les' OR (regexp_matches(t, '^th[a-z]$') AND t <> 'the') GROUP BY 1, 2""",
        "scan_tokens": """SELECT doc_id, 'eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxIn0.' || md5(CAST(doc_id AS VARCHAR)) AS value, 'JWT' AS label
            FROM documents WHERE doc_id % 2 = 0""",
        "scan_overlaps": """SELECT doc_id, CASE WHEN regexp_matches(value, '[.-]') THEN 'wide' ELSE 'digits' END AS rule_id, value FROM (
            SELECT doc_id, unnest(regexp_extract_all(text, '[0-9]{3,}(?:[.-][0-9]+)?')) AS value FROM documents)""",
        "texts_outcomes": _with(_WORDS) + """SELECT CASE WHEN length(text) > 200000 OR (doc_id % 10 = 7 AND length(text) > 0) OR NOT regexp_matches(text, '[^\\s]') THEN 'unscanned'
              WHEN black > 0 THEN 'blocked' WHEN near > 0 THEN 'pseudonymised' WHEN arts > 0 THEN 'warned' ELSE 'clean' END AS outcome,
            count(*) AS docs FROM counted JOIN documents USING (doc_id) GROUP BY 1""",
        "scan_gated": _with(BUILTIN) + """SELECT f.doc_id, CAST(count(*) AS INTEGER) AS n FROM found f JOIN documents d USING (doc_id)
            WHERE length(d.text) <= 200000 AND doc_id % 10 <> 7 GROUP BY 1""",
        "scan_rollup_per_rule": _with(BUILTIN) + """SELECT doc_id, rule_id AS type, max(severity) AS severity, count(*) AS "count"
            FROM found GROUP BY 1, 2""",
        "scan_regex_spans": _with(_NUMBERS) + """SELECT doc_id, "start", "end", v AS value FROM numbers""",
        "scan_custom_validator": _with(_NUMBERS) + """SELECT doc_id, v AS value, 'warn' AS action, CAST(NULL AS VARCHAR) AS label
            FROM numbers WHERE regexp_matches(v, '[02468]$')""",
        "scan_rule_ids": _with(BUILTIN) + """SELECT doc_id, string_agg(rule_id, ',' ORDER BY at_) AS rule_ids FROM (
            SELECT doc_id, rule_id, min("start") AS at_ FROM found GROUP BY 1, 2) GROUP BY 1""",
        "scan_overlap_anti_join": _EMAILS,
        "values_masked": _with(BUILTIN) + f"SELECT doc_id, value, {_MASK} AS masked FROM found",
        "values_hashed": f"SELECT DISTINCT c_name, {_fnv("('s1:' || c_name)")} AS hash FROM customer",
        "vault_entries": _with(VAULT) + "SELECT session, value, label, placeholder, uses FROM vault",
        "vault_capped": _with(VAULT) + """SELECT session, value FROM (SELECT *, row_number() OVER (
            PARTITION BY session ORDER BY first_seen DESC, value) AS rn FROM vault) WHERE rn <= 3""",
        "texts_anonymized": _with(HIDDEN) + "SELECT doc_id, md5(anonymized) AS digest FROM hidden",
        "texts_revealed": "SELECT doc_id, md5(text) AS digest FROM documents",
        "texts_reveal_counts": _with(BUILTIN) + "SELECT doc_id, CAST(count(*) AS INTEGER) AS replaced FROM found GROUP BY 1",
        "texts_replacements": _with(VAULT) + """SELECT f.doc_id, f.value, f.label, count(*) AS "count", v.placeholder FROM found f
            JOIN documents d USING (doc_id) JOIN vault v ON v.session = d.lang AND v.value = f.value GROUP BY 1, 2, 3, 5""",
        "detection_counters": _with(BUILTIN) + """, hit AS (SELECT DISTINCT doc_id FROM found)
            SELECT CAST(DATE '2024-01-01' + CAST(doc_id % 5 AS INTEGER) AS VARCHAR) AS day, 'anonymized' AS action, count(*) AS n FROM hit GROUP BY 1
            UNION ALL SELECT NULL, 'anonymized', count(*) FROM hit""",
        "entities_merged": _with(BUILTIN, _TAGGED) + """SELECT doc_id, rule_id, count(*) AS n FROM (
              SELECT doc_id, rule_id FROM found UNION ALL SELECT doc_id, 'ner:ORG' FROM tagged WHERE word = 'the'
              UNION ALL SELECT doc_id, 'ner:PER' FROM tagged WHERE word = 'les') GROUP BY 1, 2""",
        "texts_chunked": "SELECT doc_id, md5(text) AS digest, true AS short FROM documents",
        "prompts_routed": """SELECT (['chatgpt','claude','gemini','copilot','mistral','perplexity','deepseek','grok'])[(conv_id + turn) % 8 + 1]
            AS service, count(*) AS requests FROM conversations GROUP BY 1""",
        "prompts_extracted": f"SELECT conv_id, turn, text AS prompt FROM {_REQ_TURNS}",
        "prompts_injected": f"SELECT conv_id, turn, '<' || text || '>' AS prompt FROM {_REQ_TURNS}",
        "prompts_anonymized": _with(_TURNS_HIDDEN) + "SELECT * FROM turns_hidden",
        "prompts_by_conversation": f"""SELECT conv_id, count(*) AS prompts, CAST(sum(length(text)) AS BIGINT) AS chars
            FROM {_REQ_TURNS} GROUP BY 1""",
        "stream_ingest": _with(DET) + f"""SELECT org_id, action, count(*) AS n, CAST(sum(prompt_length) AS BIGINT) AS prompt_length
            FROM det WHERE {_VALID} GROUP BY 1, 2""",
        "stream_devices_and_feed": f"""SELECT count(DISTINCT user_id) AS n, 'devices' AS what FROM events WHERE {_VALID}
            UNION ALL SELECT least(200, count(*)), 'feed' FROM events WHERE user_id % 10 = 0 AND {_VALID}
            UNION ALL SELECT count(*), 'rejected' FROM events WHERE NOT ({_VALID})""",
        "stream_daily_rollup": _ROLLUP,
        "stream_action_counters": _with(DET) + """SELECT epoch_us(date_trunc('day', "timestamp")) AS day, action, count(*) AS n FROM det GROUP BY 1, 2""",
        "stream_breach_clock": _CLOCK,
        "stream_breach_clock_state": _CLOCK,
        "stream_ingest_rows": _with(DET) + f"""SELECT event_id, epoch_us(date_trunc('milliseconds', "timestamp")) AS "timestamp", org_id, llm, action,
            CAST(prompt_length AS BIGINT) AS prompt_length FROM det WHERE {_VALID}""",
        "stream_device_rows": _with(DET) + f"""SELECT device_id AS id, org_id, extension_version, epoch_us({_NOW}) AS last_seen_at, count(*) AS events
            FROM det WHERE {_VALID} GROUP BY 1, 2, 3""",
        "stream_rollup_refreshed": _with(DET) + f"""SELECT CAST(CAST("timestamp" AS DATE) AS VARCHAR) AS day, org_id, llm, action, count(*) AS n,
            CAST(sum(prompt_length) AS BIGINT) AS total_prompt_length, CAST("timestamp" AS DATE) = DATE '2024-01-10' AS refreshed_again
            FROM det WHERE {_VALID} AND CAST("timestamp" AS DATE) >= {_NOW} - INTERVAL 30 DAYS
              AND CAST("timestamp" AS DATE) + INTERVAL 1 DAY <= {_NOW} - INTERVAL 1 HOUR GROUP BY 1, 2, 3, 4, 7""",
        "stream_auth_blocks_ordered": _BLOCKS,
        "audit_p95_sketched": _with(_AUDIT) + "SELECT path, count(*) AS requests, true AS within FROM audit GROUP BY 1",
        "events_generated": "SELECT count(*) AS events, count(*) AS ids, true AS recent, count(*) AS valid, 0 AS rejected FROM events",
        "vault_first_labels": _with(_LABELLED) + """SELECT session, value, arg_min(label, at_) AS label, CAST(count(DISTINCT label) AS INTEGER) AS labels,
            count(*) AS uses FROM labelled GROUP BY 1, 2""",
        "vault_collisions": _with(_LABELLED) + """SELECT session, value, label, base, CAST(row_number() OVER (
              PARTITION BY session, label, base ORDER BY seen, value) AS INTEGER) AS number
            FROM (SELECT session, value, arg_min(label, at_) AS label, substr(md5(value), 1, 1) AS base, min(at_) AS seen FROM labelled GROUP BY 1, 2)""",
        "texts_planned_rows": _with(HIDDEN) + """SELECT doc_id, CASE WHEN EXISTS (SELECT 1 FROM found f WHERE f.doc_id = hidden.doc_id)
            THEN 'pseudonymised' ELSE 'clean' END AS outcome, md5(anonymized) AS digest FROM hidden""",
        "entities_beside_findings": _with(BUILTIN, _DIGITS) + """SELECT doc_id, rule_id, "start", "end", value FROM found
            UNION ALL SELECT doc_id, 'ner:PER', "start", "end", v FROM digits n WHERE NOT EXISTS (
              SELECT 1 FROM found f WHERE f.doc_id = n.doc_id AND f."start" < n."end" AND n."start" < f."end")""",
        "entities_of_long_texts": f"""WITH long AS (SELECT doc_id, CASE WHEN doc_id % 10 = 7 AND length(text) > 0
              THEN repeat(text, CAST(200000 // length(text) + 1 AS INTEGER)) ELSE text END AS text FROM documents),
            words AS (SELECT doc_id, unnest(string_split_regex(text, '{WORD_SPLIT}')) AS word FROM long WHERE length(text) >= 12)
            SELECT doc_id, CASE word WHEN 'the' THEN 'ORG' WHEN 'der' THEN 'LOC' ELSE 'PER' END AS entity, count(*) AS n
            FROM words WHERE word IN ('the', 'les', 'der', 'with') GROUP BY 1, 2""",
        "texts_revealed_in_place": _with(BUILTIN) + """SELECT doc_id, md5(text) AS digest,
            CAST((SELECT count(*) FROM found WHERE found.doc_id = documents.doc_id) AS INTEGER) AS hidden FROM documents""",
        "stream_auth_blocks": _BLOCKS,
        "stream_scan": _with(HIDDEN) + "SELECT doc_id, md5(anonymized) AS digest FROM hidden",
    }
