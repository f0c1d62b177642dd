"""Span algebra inside one row: arrays of structs with ``start``, ``end`` (half open)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F

from veilspark.rules.model import ACTIONS, SEVERITIES

FINDING_TYPE = (
    "struct<rule_id:string,start:int,end:int,value:string,"
    "action:string,severity:string,label:string>"
)
FINDINGS_TYPE = f"array<{FINDING_TYPE}>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def union_spans(*columns: Column) -> Column:
    return columns[0] if len(columns) == 1 else F.concat(*columns)


def union_findings(left: Column, right: Column) -> Column:
    """Both finding lists as one, by start."""
    keyed = F.transform(F.concat(left, right), lambda f: F.struct(
        f["start"].alias("at"), f["end"].alias("till"), f.alias("f")))
    return F.transform(F.array_sort(keyed), lambda k: k["f"])


BLOCK = 256


def fold_blocks(source: Column, state: dict[str, Column], out_type: str,
                step: Callable[[Column, Column], tuple[dict[str, Column], Column]],
                finish: Callable[[Column, Column], Column] | None = None) -> Column:
    """Left fold over an array that emits elements.

    ``step(state, element)`` gives the next state and what to emit (NULL for
    nothing); ``finish(state, emitted)`` makes the result.  Appending to an
    array copies it, so elements are collected in blocks: a text with very many
    spans costs its length times the block size, not its length squared.
    """
    def opened(values, kind: str) -> Column:
        return F.struct(*[values[name].alias(name) for name in state], F.array().cast(kind).alias("out"))

    def one(acc: Column, element: Column) -> Column:
        new, emit = step(acc, element)
        return F.struct(*[new[name].alias(name) for name in state], F.when(
            emit.isNull(), acc["out"]).otherwise(F.array_append(acc["out"], emit)).alias("out"))

    def block(acc: Column, elements: Column) -> Column:
        return let(F.aggregate(elements, opened(acc, f"array<{out_type}>"), one), lambda done: F.struct(
            *[done[name].alias(name) for name in state], F.array_append(acc["out"], done["out"]).alias("out")))

    def folded(items: Column) -> Column:
        last = F.floor((F.greatest(F.size(items), F.lit(1)) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), last), lambda b: F.slice(items, b * BLOCK + 1, F.lit(BLOCK)))
        end = finish or (lambda _, emitted: emitted)
        return F.aggregate(blocks, opened(state, f"array<array<{out_type}>>"), block,
                           lambda acc: end(acc, F.flatten(acc["out"])))

    return let(source, folded)


def drop_overlaps(candidates: Column, spans: Column, element_type: str) -> Column:
    """Candidates that touch none of ``spans`` (ordered by their end).

    One sweep over both lists: a candidate goes when the furthest end among the
    spans starting before its end lies beyond its start.  ``element_type`` is
    the DDL of one candidate.
    """
    none = F.lit(None).cast(element_type)
    points = F.concat(
        F.transform(candidates, lambda c: F.struct(
            c["end"].alias("at"), F.lit(0).alias("side"), F.lit(-1).alias("reach"), c.alias("span"))),
        F.transform(spans, lambda s: F.struct(
            s["start"].alias("at"), F.lit(1).alias("side"), s["end"].alias("reach"), none.alias("span"))))

    def step(acc: Column, p: Column):
        kept = (p["side"] == 0) & (acc["reach"] <= p["span"]["start"])
        return {"reach": F.greatest(acc["reach"], p["reach"])}, F.when(kept, p["span"])

    return F.when(F.size(spans) == 0, candidates).otherwise(
        fold_blocks(F.array_sort(points), {"reach": F.lit(-1)}, element_type, step))


def resolve_overlaps(spans: Column, element_type: str) -> Column:
    """Earliest start, then longest, then lowest ``priority``; greedy sweep.

    ``element_type`` is the DDL of one span struct and must contain ``start``,
    ``end`` and ``priority``.
    """
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(
        s["start"].alias("start"), (s["start"] - s["end"]).alias("minus_length"),
        s["priority"].alias("priority"), s.alias("span"))))

    def step(acc: Column, s: Column):
        kept = s["start"] >= acc["last"]
        return {"last": F.when(kept, s["span"]["end"]).otherwise(acc["last"])}, F.when(kept, s["span"])

    return F.when(F.size(spans) == 0, F.array().cast(f"array<{element_type}>")).otherwise(
        fold_blocks(ordered, {"last": F.lit(-1)}, element_type, step))


def rank_of(value: Column, scale: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*map(F.lit, scale)), value)


def _highest(values: Column, scale: tuple[str, ...]) -> Column:
    best = F.array_max(F.transform(values, lambda v: rank_of(v, scale)))
    return F.try_element_at(F.array(*map(F.lit, scale)), best.cast("int"))


def max_action(findings: Column) -> Column:
    return _highest(findings["action"], ACTIONS)


def max_severity(findings: Column) -> Column:
    return _highest(findings["severity"], SEVERITIES)


def rule_ids(findings: Column) -> Column:
    return F.array_distinct(findings["rule_id"])


PAGE = 512


def pages_of(text: Column) -> Column:
    """A text as pieces of ``PAGE`` code points, so that a part of it is found without counting from its start."""
    return F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % PAGE), F.lit(0))


def paged_substring(pages: Column, start: Column, end: Column) -> Column:
    """The code points from start to end (exclusive) of a text given as its pages."""
    first, last = F.floor(start / PAGE).cast("int"), F.floor(end / PAGE).cast("int")
    page, offset = F.coalesce(F.get(pages, first), F.lit("")), (start - first * PAGE).cast("int")
    tail = F.substring(F.coalesce(F.get(pages, last), F.lit("")), F.lit(1), (end - last * PAGE).cast("int"))
    between = F.array_join(F.slice(pages, first + 2, F.greatest(last - first - 1, F.lit(0))), "")
    return F.when(first == last, F.substring(page, offset + 1, (end - start).cast("int"))).otherwise(
        F.concat(F.substring(page, offset + 1, F.lit(PAGE)), between, tail))
