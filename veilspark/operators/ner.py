"""Model entities: chunking, model calls, normalising, merging with rule findings."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, functions as F

from veilspark.functions.spans import FINDINGS_TYPE, drop_overlaps, let, resolve_overlaps, union_findings
from veilspark.operators.scan import decide, words_spans

# Task functions of this module travel inside the plan: workers need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

CHUNK_CHARS, MIN_CHARS = 1200, 12
LONG_CHARS = 64 * CHUNK_CHARS       # from here on a text is dealt out
ENTITIES_TYPE = "array<struct<entity:string,value:string,start:int,end:int,score:double>>"
RAW_TYPE = "array<struct<group:string,word:string,start:int,end:int,score:double>>"
# Default policy per entity group.
DEFAULT_POLICY = {
    "PER": {"enabled": True, "action": "anonymize", "severity": "high", "label": "PERSON", "threshold": 0.85},
    "ORG": {"enabled": True, "action": "anonymize", "severity": "medium", "label": "ORG", "threshold": 0.85},
    "LOC": {"enabled": False, "action": "anonymize", "severity": "medium", "label": "LOC", "threshold": 0.85},
    "MISC": {"enabled": False, "action": "warn", "severity": "low", "label": "MISC", "threshold": 0.9},
}
_CANDIDATE = "struct<start:int,end:int,priority:int,value:string,entity:string>"


def chunk_text(text: Column, size: int = CHUNK_CHARS) -> Column:
    """array<struct<offset,text>>: pieces of at most ``size`` characters, cut at
    the last space when that lies in the second half of the piece."""
    # The length is counted once a text, not once a piece: counting reads the whole text.
    return let(F.length(text), lambda length: _pieces(text, length, size))


def _pieces(text: Column, length: Column, size: int) -> Column:
    half = size // 2

    def cut(state: Column, _: Column) -> Column:
        at = state["at"]
        hard = F.least(at + size, length)
        window = F.substring(text, at + 1, F.lit(size + 1))
        space = at + F.length(window) - F.instr(F.reverse(window), " ")
        soft = (hard < length) & (F.instr(window, " ") > 0) & (space > at + half)
        end = F.when(soft, space).otherwise(hard)
        return F.when(at >= length, state).otherwise(let(end, lambda e: F.struct(
            e.alias("at"), F.array_append(state["cuts"], F.struct(at.alias("a"), e.alias("b"))).alias("cuts"))))

    steps = F.sequence(F.lit(0), F.floor(length / half).cast("int"))
    none = F.array().cast("array<struct<a:int,b:int>>")
    cuts = F.aggregate(steps, F.struct(F.lit(0).alias("at"), none.alias("cuts")), cut, lambda s: s["cuts"])
    many = F.transform(cuts, lambda c: F.struct(
        c["a"].alias("offset"), F.substring(text, c["a"] + 1, c["b"] - c["a"]).alias("text")))
    whole = F.array(F.struct(F.lit(0).alias("offset"), text.alias("text")))
    return F.when(length <= size, whole).otherwise(many)


def normalize_entities(chunks: Column, raw: Column) -> Column:
    """Model output per chunk → entities with offsets into the whole text.

    Tag prefixes and word-piece marks go; entities without usable offsets are
    located by their word; what still has none is dropped.
    """
    def one(chunk: Column, entities: Column) -> Column:
        def tidy(e: Column) -> Column:
            group = F.regexp_replace(F.coalesce(e["group"], F.lit("")), "^[BI]-", "")
            word = F.trim(F.regexp_replace(F.coalesce(e["word"], F.lit("")), "^##", ""))
            usable = e["start"].isNotNull() & e["end"].isNotNull() & (e["end"] > e["start"])
            found = F.instr(chunk["text"], word) - 1
            searched = ~F.coalesce(usable, F.lit(False)) & (word != "") & (found >= 0)
            start = F.when(searched, found).otherwise(e["start"])
            end = F.when(searched, found + F.length(word)).otherwise(e["end"])
            return F.struct(
                group.alias("entity"),
                F.when(word != "", word).otherwise(F.substring(chunk["text"], start + 1, end - start)).alias("value"),
                (start + chunk["offset"]).alias("start"), (end + chunk["offset"]).alias("end"),
                F.coalesce(e["score"], F.lit(0.0)).alias("score"))

        return F.filter(F.transform(F.coalesce(entities, F.array().cast(RAW_TYPE)), tidy), lambda e: (
            e["entity"] != "") & e["start"].isNotNull() & e["end"].isNotNull() & (e["end"] > e["start"]))

    return F.flatten(F.zip_with(chunks, raw, one)).cast(ENTITIES_TYPE)


def _tagger(model_factory: Callable[[], Callable[[str], list[dict]]], fail: bool):
    """Raw entities of each of a row's chunks; null for a call that failed."""

    @F.pandas_udf(f"array<{RAW_TYPE}>")
    def tag(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        model = model_factory()

        def safe(chunk: str) -> list[dict] | None:
            try:
                return [{"group": e.get("entity_group") or e.get("entity"), "word": e.get("word"),
                         "start": e.get("start"), "end": e.get("end"), "score": e.get("score")} for e in model(chunk)]
            except Exception:
                if fail:
                    raise
                return None

        for batch in batches:
            yield batch.map(lambda chunks: [safe(c) for c in chunks])

    return tag.asNondeterministic()


def detect_entities(df: DataFrame, text_col: str, model_factory: Callable[[], Callable[[str], list[dict]]],
                    min_chars: int = MIN_CHARS, into: str = "entities", fail: bool = False) -> DataFrame:
    """Add model entities, and ``<into>_failed``: how many calls of the model failed.

    The model is built once per Python worker and called per chunk.  A failed
    call yields no entities, so a text with failed calls is incomplete; with
    ``fail`` the first one ends the job.  Texts stay where they are.
    """

    text = F.col(text_col)
    eligible = (F.length(text) >= min_chars) & (F.trim(text) != "")
    chunks = F.when(eligible, chunk_text(text)).otherwise(
        F.array().cast("array<struct<offset:int,text:string>>"))
    tagged = df.withColumn("__chunks", chunks).withColumn("__raw", _tagger(model_factory, fail)(F.col("__chunks")["text"]))
    failed = F.size(F.filter("__raw", lambda entities: entities.isNull()))
    return tagged.withColumns({into: normalize_entities(F.col("__chunks"), F.col("__raw")), f"{into}_failed": failed}).drop("__chunks", "__raw")


def cut_points(text: str, size: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """(start, end) of the pieces of :func:`chunk_text`, in time proportional to the text."""
    at, half = 0, size // 2
    while at < len(text):
        hard = min(at + size, len(text))
        space = text.rfind(" ", at, at + size + 1)
        end = space if hard < len(text) and space > at + half else hard
        yield at, end
        at = end


def detect_entities_dealt(df: DataFrame, text_col: str, model_factory: Callable[[], Callable[[str], list[dict]]],
                          min_chars: int = MIN_CHARS, into: str = "entities", fail: bool = False, long_chars: int = LONG_CHARS) -> DataFrame:
    """:func:`detect_entities`, with texts of more than ``long_chars`` spread over tasks.

    Short texts are tagged where they lie. A long one is cut into chunks that become rows and are dealt out evenly,
    whatever text they come from; their entities come together again by offset, a list for each text. Long texts are known by
    their digest, so copies are tagged once, and none is stored: a columnar reader would hold thousands of them at once.
    ``df`` is computed three times, and must be the same each time.
    """
    long = F.length(text_col) > long_chars
    short = detect_entities(df.where(F.coalesce(~long, F.lit(True))), text_col, model_factory, min_chars, into, fail)
    rows = df.where(long).withColumn("__digest", F.sha2(F.col(text_col), 256))

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for digest, text in zip(batch["__digest"], batch["text"]):
                if len(text.strip(" ")) > 0 and len(text) >= min_chars:
                    points = list(cut_points(text))
                    for first in range(0, len(points), 1000):
                        some = points[first:first + 1000]
                        yield pd.DataFrame({"digest": digest, "offset": [a for a, _ in some], "chunk": [text[a:b] for a, b in some]})

    chunks = rows.select("__digest", F.col(text_col).alias("text")).mapInPandas(cut, "digest string, offset int, chunk string")
    # A fixed number: adaptive execution would merge partitions by their bytes, but it is the model that takes the time.
    dealt = chunks.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), "digest", "offset").dropDuplicates(["digest", "offset"])
    piece = F.array(F.struct(F.col("offset"), F.col("chunk").alias("text")))
    tagged = dealt.withColumn("raw", _tagger(model_factory, fail)(F.array("chunk")))
    found = tagged.select("digest", "offset", normalize_entities(piece, F.col("raw")).alias("entities"), F.col("raw")[0].isNull().cast("int").alias("failed"))
    whole = found.groupBy("digest").agg(F.array_sort(F.collect_list(F.struct("offset", "entities"))).alias("__parts"), F.sum("failed").cast("int").alias("__failed"))
    joined = rows.join(whole, F.col("__digest") == F.col("digest"), "left").select(
        *[F.col(f"`{c}`") for c in df.columns], F.coalesce(F.flatten(F.col("__parts")["entities"]), F.array().cast(ENTITIES_TYPE)).alias(into),
        F.coalesce("__failed", F.lit(0)).alias(f"{into}_failed"))
    return short.unionByName(joined)


def merge_ner(df: DataFrame, text_col: str = "text", entities_col: str = "entities", policy: dict | None = None,
              whitelist: list[str] = (), enabled: bool = True) -> DataFrame:
    """Merge entities into ``findings``; rule findings and the whitelist win every overlap."""
    if not enabled:
        return df
    active = {g: s for g, s in (policy or DEFAULT_POLICY).items() if s["enabled"]}
    if not active:
        return df

    def setting(key: str) -> Column:
        return F.create_map(*[F.lit(x) for group, s in active.items() for x in (group, s[key])])

    allowed = let(F.length(text_col), lambda length: F.filter(entities_col, lambda e: e["entity"].isin(list(active)) & (
        e["score"] >= F.element_at(setting("threshold"), e["entity"]))
        & (e["end"] > e["start"]) & (e["end"] <= length)))
    candidates = F.transform(allowed, lambda e: F.struct(
        e["start"].alias("start"), e["end"].alias("end"),
        F.floor((1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), e["score"]))) * 1000 + 0.5).cast("int").alias("priority"),
        e["value"].alias("value"), e["entity"].alias("entity")))
    kept = drop_overlaps(candidates, F.col("findings"), _CANDIDATE)
    if whitelist:
        kept = let(kept, lambda c: let(words_spans(text_col, whitelist), lambda w: drop_overlaps(c, w, _CANDIDATE)))
    resolved = let(kept, lambda c: resolve_overlaps(c, _CANDIDATE))
    action, severity, label = setting("action"), setting("severity"), setting("label")
    findings = F.transform(resolved, lambda c: F.struct(
        F.concat(F.lit("ner:"), c["entity"]).alias("rule_id"), c["start"].alias("start"), c["end"].alias("end"),
        c["value"].alias("value"), F.element_at(action, c["entity"]).alias("action"),
        F.element_at(severity, c["entity"]).alias("severity"),
        F.when(F.element_at(action, c["entity"]) == "anonymize", F.element_at(label, c["entity"])).alias("label")
    )).cast(FINDINGS_TYPE)
    merged = df.withColumn("__found", F.coalesce(findings, F.array().cast(FINDINGS_TYPE)))
    return decide(merged.withColumn("findings", union_findings(F.col("findings"), F.col("__found"))).drop("__found"))
