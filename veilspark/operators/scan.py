"""Scan text for rule matches.

A rule set becomes one expression over the text column: no shuffle, no UDF, no
join.  Per pattern the work is a literal test, then ``rlike`` (stops at the
first hit), and only for texts that do match a marking pass whose pieces carry
the offsets.  Everything after that touches the handful of spans found.

The part that repeats per pattern is written as SQL text: one parse instead of
thousands of calls.
"""

from __future__ import annotations

from dataclasses import dataclass
from weakref import WeakKeyDictionary

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilspark.functions.spans import (
    FINDINGS_TYPE, drop_overlaps, fold_blocks, let, max_action, max_severity, rank_of, resolve_overlaps,
)
from veilspark.rules.dialect import JS_SPACE, to_java, word_pattern
from veilspark.rules.model import SEVERITIES, Matcher, RuleSet

MAX_SCAN_CHARS = 200_000
# Two Unicode noncharacters: MARK is put around matches, SPARE stands in for a
# MARK already present in the text (same length, same regex properties).
MARK, SPARE = "\uFDD0", "\uFDD1"
_EXPRESSIONS: WeakKeyDictionary = WeakKeyDictionary()
_SPAN = "struct<unit:int,start:int,end:int,value:string>"
_CANDIDATE = "struct<start:int,end:int,priority:int,value:string>"


@dataclass(frozen=True)
class _Unit:
    """One pattern to run: its matcher (-1 = whitelist) and condition number."""

    pattern: str
    owner: int
    condition: int
    hint: str | None
    matcher: Matcher | None


def _units(rules: RuleSet) -> list[_Unit]:
    units = [_Unit(p, -1, 0, h, None) for p, h in zip(rules.whitelist, rules.whitelist_hints)]
    for index, matcher in enumerate(rules.matchers):
        for number, (patterns, hints) in enumerate(zip(matcher.conditions, matcher.hints)):
            units.extend(_Unit(p, index, number, h, matcher) for p, h in zip(patterns, hints))
    return units


def _quote(text: str | None) -> str:
    """SQL string literal (``$`` is escaped so that no variable is substituted)."""
    if text is None:
        return "NULL"
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'").replace("$", "\\u0024") + "'"


def _array(values) -> str:
    return "array(" + ", ".join(str(v) if isinstance(v, int) else _quote(v) for v in values) + ")"


def _any_contains(variable: str, literals) -> list[str]:
    return [f"contains({variable}, {_quote(x)})" for x in literals]


def _any_token(tokens) -> list[str]:
    if not tokens:
        return []
    return [f"array_contains(aid.tokens, {_quote(tokens[0])})" if len(tokens) == 1
            else f"arrays_overlap(aid.tokens, {_array(dict.fromkeys(tokens))})"]


def _guard(unit: _Unit) -> list[str]:
    """Cheap conditions every match of the unit implies, cheapest first."""
    tests: list[list[str]] = []
    matcher = unit.matcher
    if unit.hint:
        tests.append(_any_token([unit.hint]))
    if matcher is not None:
        # The other conditions of a combination must hit as well.
        tests += [_any_token(hints) for number, hints in enumerate(matcher.hints)
                  if number != unit.condition and all(hints)]
        if matcher.needs_digit:
            tests.append(["aid.digit"])
        if matcher.needs_underscore:
            tests.append(["aid.underscore"])
        if matcher.kind != "combination":
            tests.append(_any_token(matcher.tokens) + _any_contains("scan", matcher.literals))
            tests.append(_any_contains("aid.low", matcher.low_literals))
    return ["(" + " OR ".join(test) + ")" for test in tests if test]


def _wanted_tokens(units: list[_Unit]) -> list[str]:
    wanted = [u.hint for u in units if u.hint]
    for unit in units:
        wanted += unit.matcher.tokens if unit.matcher else ()
    return list(dict.fromkeys(wanted))


def _pieces(pattern: str, guards: list[str]) -> str:
    """gap, match, gap, match, ..., gap; NULL when the pattern does not occur."""
    tests = " AND ".join([*guards, f"scan RLIKE {_quote(pattern)}"])
    marked = f"regexp_replace(scan, {_quote(pattern)}, {_quote(MARK + '$0' + MARK)})"
    return f"CASE WHEN {tests} THEN split({marked}, {_quote(MARK)}, -1) END"


def _all_pieces(text: str, pieces: list[str], tokens: list[str] = (), gate: str = "true") -> Column:
    """array<pieces> of all patterns over ``text`` (an SQL expression).

    ``aid`` holds what the guards test: the lower-cased text, the tokens of
    interest that occur in it, and whether it has digits or underscores.
    """
    present = ("array_intersect(split(low, '[^\\\\p{L}\\\\p{N}]+'), " + _array(tokens) + ")") if tokens else "array('')"
    return F.expr(f"""CASE WHEN {gate} THEN
element_at(transform(array(replace({text}, {_quote(MARK)}, {_quote(SPARE)})), scan ->
  element_at(transform(transform(array(replace(lower(scan), 'ſ', 's')), low -> named_struct(
      'low', low, 'tokens', {present}, 'digit', scan RLIKE '[0-9]', 'underscore', contains(scan, '_'))), aid ->
    array({", ".join(pieces)})), 1)), 1) END""")


def _spans_of(pieces: Column, unit: Column) -> Column:
    """Non-empty matches of one unit: offsets are the running lengths of its pieces."""
    def step(acc: Column, piece: Column):
        end = acc["at"] + F.length(piece)
        span = F.struct(unit.alias("unit"), acc["at"].alias("start"), end.alias("end"), piece.alias("value"))
        return {"at": end, "hit": ~acc["hit"]}, F.when(acc["hit"] & (F.length(piece) > 0), span)

    return fold_blocks(pieces, {"at": F.lit(0), "hit": F.lit(False)}, _SPAN, step)


def _located(all_pieces: Column) -> Column:
    return F.flatten(F.transform(all_pieces, lambda pieces, unit: F.when(
        pieces.isNull(), F.array().cast(f"array<{_SPAN}>")).otherwise(_spans_of(pieces, unit))))


def _plain_spans(text_col: str, patterns: list[str]) -> Column:
    spans = _located(_all_pieces(f"`{text_col}`", [_pieces(p, []) for p in patterns]))
    return F.transform(spans, lambda s: F.struct(s["start"], s["end"], s["value"]))


def regex_spans(text_col: str, pattern: str, rule_id: str = "pattern") -> Column:
    """All non-empty, non-overlapping matches of one ECMAScript pattern."""
    return _plain_spans(text_col, [to_java(pattern, rule_id)])


def words_spans(text_col: str, words) -> Column:
    """Whole-word, case-insensitive hits; each word is searched on its own."""
    return _plain_spans(text_col, [word_pattern(w) for w in words])


def blacklist_spans(text_col: str, rules_doc: dict) -> Column:
    return words_spans(text_col, rules_doc["blacklist"]["values"])


def whitelist_spans(text_col: str, rules_doc: dict) -> Column:
    return words_spans(text_col, rules_doc["whitelist"])


def combination_spans(*conditions: Column) -> Column:
    """Spans of every condition, provided each condition hits at least once."""
    return let(F.array(*conditions), lambda all_: F.when(
        F.forall(all_, lambda spans: F.size(spans) > 0), F.flatten(all_)
    ).otherwise(F.array().cast("array<struct<start:int,end:int,value:string>>")))


def _by_index(values, index: Column) -> Column:
    """The entry of a fixed list (written as one SQL literal)."""
    return F.get(F.expr(_array(values)), index)


def _candidates(hits: Column, rules: RuleSet, units: list[_Unit]) -> Column:
    """``hits`` minus unmet combinations and minus anything touching the whitelist."""
    def owner(span: Column) -> Column:
        return _by_index([u.owner for u in units], span["unit"])

    wanted = F.filter(hits, lambda s: owner(s) >= 0)
    combinations = [i for i, m in enumerate(rules.matchers) if m.kind == "combination"]
    if combinations:
        # A combination counts once every one of its conditions has a hit.
        conditions = [u.owner * 16 + u.condition for u in units]
        needed = ", ".join(f"named_struct('rule', {i}, 'all', sequence({i * 16}, {i * 16 + len(rules.matchers[i].conditions) - 1}))"
                           for i in combinations)
        wanted = let(F.array_distinct(F.transform(hits, lambda s: _by_index(conditions, s["unit"]))), lambda seen: let(
            F.filter(F.expr(f"array({needed})"), lambda c: F.size(F.array_except(c["all"], seen)) > 0), lambda unmet: F.filter(
                hits, lambda s: (owner(s) >= 0) & ~F.array_contains(unmet["rule"], owner(s)))))
    if rules.whitelist:
        allowed = F.filter(hits, lambda s: owner(s) < 0)
        wanted = let(wanted, lambda c: let(allowed, lambda w: drop_overlaps(c, w, _SPAN)))
    return F.transform(wanted, lambda s: F.struct(
        s["start"].alias("start"), s["end"].alias("end"), owner(s).alias("priority"), s["value"].alias("value")))


def _findings(text: Column, hits: Column, rules: RuleSet, units: list[_Unit]) -> Column:
    """Resolve overlaps and attach what each matcher says."""
    matchers = rules.matchers
    labels = [m.placeholder if m.action == "anonymize" else None for m in matchers]

    def labelled(s: Column, marked: Column) -> Column:
        value = F.when(marked, F.substring(text, s["start"] + 1, s["end"] - s["start"]))
        return F.struct(
            _by_index([m.rule_id for m in matchers], s["priority"]).alias("rule_id"), s["start"].alias("start"),
            s["end"].alias("end"), value.otherwise(s["value"]).alias("value"),
            _by_index([m.action for m in matchers], s["priority"]).alias("action"),
            _by_index([m.severity for m in matchers], s["priority"]).alias("severity"),
            _by_index(labels, s["priority"]).alias("label"))

    none = F.array().cast(FINDINGS_TYPE)
    # Whether the text holds the marker itself is asked once a text, not once a finding.
    return let(hits, lambda found: F.when(F.coalesce(F.size(found), F.lit(0)) == 0, none).otherwise(let(
        F.contains(text, F.lit(MARK)), lambda marked: F.transform(
            let(_candidates(found, rules, units), lambda c: resolve_overlaps(c, _CANDIDATE)), lambda s: labelled(s, marked)).cast(FINDINGS_TYPE))))


def _validated(hits: Column, units: list[_Unit]) -> Column:
    checks = [(i, u.matcher.validate) for i, u in enumerate(units) if u.matcher and u.matcher.validate]
    if not checks:
        return hits

    def valid(span: Column) -> Column:
        verdict = F.when(span["unit"] == checks[0][0], checks[0][1](span["value"]))
        for number, check in checks[1:]:
            verdict = verdict.when(span["unit"] == number, check(span["value"]))
        return verdict.otherwise(True)

    return F.filter(hits, valid)


def with_findings(df: DataFrame, text_col: str, rules: RuleSet, max_chars: int | None = None,
                  into: str = "findings") -> DataFrame:
    """Add the resolved, non-overlapping findings of a text column, by start."""
    units = _units(rules)
    if not units:
        return df.withColumn(into, F.array().cast(FINDINGS_TYPE))
    text = f"`{text_col}`"
    gate = f"{text} != ''"
    if max_chars is not None:
        gate += f" AND length({text}) <= {int(max_chars)} AND {text} RLIKE {_quote(f'[^{JS_SPACE}]')}"
    # The expression is built once per application: it costs more to write than to plan,
    # and streams hand over a new session object with every batch.
    built = _EXPRESSIONS.setdefault(df.sparkSession.sparkContext, {})
    if (text_col, rules, gate) not in built:
        pieces = _all_pieces(text, [_pieces(u.pattern, _guard(u)) for u in units], _wanted_tokens(units), gate)
        hits = let(pieces, lambda p: F.when(p.isNotNull(), _validated(_located(p), units)))
        built[text_col, rules, gate] = _findings(F.col(text_col), hits, rules, units)
    # Unfolding a one-element array keeps the scan where it is: a later filter on
    # findings is not pushed below it (running every pattern twice), while
    # filters on other columns still reach the source.
    return df.select("*", F.explode_outer(F.array(built[text_col, rules, gate])).alias(into))


def decide(df: DataFrame, findings_col: str = "findings") -> DataFrame:
    findings = F.col(findings_col)
    return df.withColumns({"decision": max_action(findings), "max_severity": max_severity(findings)})


def evaluate(df: DataFrame, text_col: str, rules: RuleSet, max_chars: int | None = None) -> DataFrame:
    """Add ``findings``, ``decision`` and ``max_severity``.

    ``max_chars`` switches on the interactive gates: blank texts and texts
    longer than the limit are left unscanned (no findings), and ``scanned`` says so.
    """
    found = decide(with_findings(df, text_col, rules, max_chars))
    if max_chars is None:
        return found
    gated = (F.length(text_col) <= max_chars) & F.col(text_col).rlike(f"[^{JS_SPACE}]")
    return found.withColumn("scanned", F.coalesce(gated, F.lit(False)))


def explode_findings(df: DataFrame, *keep: str, findings_col: str = "findings") -> DataFrame:
    """One row per finding."""
    return df.select(*keep, F.posexplode(findings_col).alias("position", "f")).select(*keep, "position", "f.*")


def finding_rollup(df: DataFrame, *keys: str) -> DataFrame:
    """Findings per rule id: occurrences and highest severity."""
    ranked = explode_findings(df, *keys).groupBy(*keys, "rule_id").agg(
        F.count("*").alias("count"), F.max(rank_of(F.col("severity"), SEVERITIES)).alias("rank"))
    return ranked.select(*keys, F.col("rule_id").alias("type"),
                         F.get(F.array(*map(F.lit, SEVERITIES)), (F.col("rank") - 1).cast("int")).alias("severity"),
                         "count")


def drop_overlaps_df(candidates: DataFrame, spans: DataFrame, *keys: str) -> DataFrame:
    """Exploded twin of :func:`drop_overlaps`: one ordered sweep per key.

    No pair is ever formed: a candidate is dropped when the furthest end among
    the spans that start before its end lies beyond its start.
    """
    columns = candidates.columns
    left = candidates.select(*keys, F.col("end").alias("at"), F.lit(0).alias("side"),
                             F.lit(None).cast("int").alias("reach"), F.struct(*columns).alias("row"))
    right = spans.select(*keys, F.col("start").alias("at"), F.lit(1).alias("side"), F.col("end").alias("reach"),
                         F.lit(None).cast(left.schema["row"].dataType).alias("row"))
    sweep = W.partitionBy(*keys).orderBy("at", "side").rowsBetween(W.unboundedPreceding, W.currentRow)
    merged = left.unionByName(right).withColumn("reach", F.max("reach").over(sweep))
    kept = merged.where((F.col("side") == 0) & (F.col("reach").isNull() | (F.col("reach") <= F.col("row.start"))))
    return kept.select("row.*")
