"""Pseudonymisation: the vault, replacing values, putting them back.

The vault has one row per (session, value).  A placeholder is a hash of salt
and value under the label the value was first seen with, plus a number when
two values of a session share label and hash.  That makes almost every
placeholder computable inside the row that holds the text; only *exceptions*
(another first label, a numbered one) have to be looked up.  Texts therefore
never move for the lookup itself: what is shuffled are (document, value) pairs,
and what meets the texts again is the short list of documents with exceptions.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from veilspark.functions.placeholders import PLACEHOLDER, base_of, compose, mint
from veilspark.functions.spans import fold_blocks, let, paged_substring, pages_of, rank_of
from veilspark.operators.events import newest_per_key
from veilspark.operators.scan import finding_rollup
from veilspark.rules.model import SEVERITIES
from veilspark.schema import FINDING
from veilspark.session import new_path, store

HOT_SHARE = 1000          # a key is hot above 1/1000 of all rows: at most 1000 such keys
VAULT_CAP = 5000


# ------------------------------------------------------------------- plans

def anonymize_spans(findings: Column) -> Column:
    return F.filter(findings, lambda f: f["action"] == "anonymize")


def outcome(decision: Column, findings: Column, scanned: Column | None = None) -> Column:
    """clean / blocked / warned / pseudonymised; unscanned where ``scanned`` is false."""
    start = F.when(F.lit(False) if scanned is None else ~scanned, "unscanned")
    return (start.when(decision.isNull() | (F.size(findings) == 0), "clean").when(decision == "block", "blocked")
            .when(F.size(anonymize_spans(findings)) == 0, "warned").otherwise("pseudonymised"))


def values_to_replace(docs: DataFrame, *keep: str) -> DataFrame:
    """One row per finding to replace; blocked documents contribute nothing."""
    kept = docs.where(F.coalesce(F.col("decision"), F.lit("")) != "block")
    rows = kept.select(*keep, F.explode(anonymize_spans(F.col("findings"))).alias("f"))
    return rows.select(*keep, "f.start", "f.end", "f.value", "f.label")


# ------------------------------------------------------------------- vault

def first_label(found: DataFrame, session: str = "session", order: str = "order") -> DataFrame:
    """Per (session, value): the label it was first given, and where; map-side combined."""
    at = F.struct(F.col(order).alias("order"), F.col("start").alias("start"))
    return found.groupBy(session, "value").agg(
        F.min_by("label", at).alias("label"), F.min(at).alias("first_seen"),
        F.collect_set("label").alias("labels"), F.count("*").alias("uses"))


def number_collisions(entries: DataFrame, session: str = "session") -> DataFrame:
    """Number the values of a session that share label and hash, by first sight.

    The window key contains a 24-bit hash of the value: even one huge session
    is spread over millions of tiny groups.
    """
    shared = W.partitionBy(session, "label", "base").orderBy("first_seen", "value")
    return entries.withColumn("number", F.row_number().over(shared))


def _entries(numbered: DataFrame, session: str, generation: int) -> DataFrame:
    return numbered.select(session, "value", "label", "base", "number",
                           compose(F.col("label"), F.col("base"), F.col("number")).alias("placeholder"),
                           "labels", "uses", "first_seen", F.lit(generation).alias("generation"))


def _salted(salt: str | Column) -> Column:
    return F.lit(salt) if isinstance(salt, str) else salt


def build_vault(found: DataFrame, salt: str | Column, session: str = "session", order: str = "order") -> DataFrame:
    """(session, value, label, base, number, placeholder, labels, uses, first_seen, generation).

    ``found`` holds ``session``, ``order``, ``start``, ``value``, ``label``.
    """
    fresh = first_label(found, session, order).withColumn("base", base_of(F.col("value"), _salted(salt)))
    return _entries(number_collisions(fresh, session), session, 0)


def extend_vault(found: DataFrame, salt: str | Column, existing: DataFrame, generation: int,
                 session: str = "session", order: str = "order") -> DataFrame:
    """Vault rows for the values of a new batch (a stored ``found``).

    Known values come back with the placeholder they have; rows of the given
    ``generation`` are new and numbered after those taken: append only these.
    The vault is probed in place (the batch is the small side), not rewritten.
    """
    fresh = first_label(found, session, order)
    keys = [session, "value"]
    known = existing.join(fresh.select(*keys), keys, "left_semi").select(
        *keys, F.col("label").alias("k_label"), F.col("first_seen").alias("k_seen"), "base", "number",
        F.col("generation").alias("k_generation"))
    seen = fresh.join(known, keys).select(
        *keys, F.col("k_label").alias("label"), "base", "number",
        compose(F.col("k_label"), F.col("base"), F.col("number")).alias("placeholder"), "labels", "uses",
        F.col("k_seen").alias("first_seen"), F.col("k_generation").alias("generation"))
    new = fresh.join(known.select(*keys), keys, "left_anti").withColumn("base", base_of(F.col("value"), _salted(salt)))
    group = [session, "label", "base"]
    taken = existing.join(new.select(*group).distinct(), group, "left_semi").groupBy(*group).agg(
        F.max("number").alias("taken"))
    numbered = number_collisions(new, session).join(taken, group, "left").withColumn(
        "number", F.col("number") + F.coalesce("taken", F.lit(0)))
    return seen.unionByName(_entries(numbered, session, generation))


def cap_vault(vault: DataFrame, n: int = VAULT_CAP, session: str = "session") -> DataFrame:
    """Keep the newest ``n`` entries per session (oldest leave first)."""
    return newest_per_key(vault, [session], n, F.desc("generation"), F.desc("first_seen"), F.col("value"))


# ----------------------------------------------------------------- lookups

def lookup(rows: DataFrame, vault: DataFrame, keys: list[str], take: list[str], spread: str) -> DataFrame:
    """Left join of many rows to vault entries that holds up under hot keys.

    Vault entries used by more than 1/1000 of all findings are at most 1000
    rows, so broadcasting them is bounded; rows they serve get a key of their
    own (by ``spread``) and so stay out of the shuffle join's hot partitions.
    """
    entries = vault.select(*keys, *take, "uses")
    total = entries.agg(F.coalesce(F.sum("uses"), F.lit(0))).scalar()
    hot = entries.where(F.col("uses") * HOT_SHARE > total)
    cold = entries.where(F.col("uses") * HOT_SHARE <= total)
    hot_side = hot.select(*keys, *[F.col(c).alias(f"hot_{c}") for c in take], F.lit(True).alias("is_hot"))
    first = rows.join(F.broadcast(hot_side), keys, "left")
    served = F.coalesce("is_hot", F.lit(False))
    cold_side = cold.select(F.lit("").alias("__spread"), *[F.col(k).alias(f"__{k}") for k in keys],
                            *[F.col(c).alias(f"cold_{c}") for c in take])
    spread_key = F.when(served, F.col(spread).cast("string")).otherwise(F.lit(""))
    on = [F.col("__row_spread") == F.col("__spread")] + [F.col(k) == F.col(f"__{k}") for k in keys]
    # A served row carries its own id in the join key: it matches nothing and spreads.
    joined = first.withColumn("__row_spread", F.when(served, F.concat(F.lit("#"), spread_key)).otherwise("")).join(
        cold_side, on, "left")
    return joined.select(*rows.columns, *[F.coalesce(f"hot_{c}", f"cold_{c}").alias(c) for c in take])


def exceptions(vault: DataFrame, session: str = "session") -> DataFrame:
    """(session, value, found label) whose placeholder is not simply ``[label_base]``."""
    rows = vault.select(session, "value", F.explode("labels").alias("found_label"), "label", "base", "number",
                        "placeholder", "uses")
    return rows.where((F.col("found_label") != F.col("label")) | (F.col("number") > 1))


def _exceptions_by_document(docs: DataFrame, vault: DataFrame, id_col: str, session: str) -> DataFrame:
    pairs = values_to_replace(docs, id_col, session).select(
        id_col, session, "value", F.col("label").alias("found_label")).distinct()
    found = lookup(pairs, exceptions(vault, session), [session, "value", "found_label"], ["placeholder"], id_col)
    return found.where(F.col("placeholder").isNotNull()).groupBy(id_col).agg(
        F.map_from_entries(F.collect_set(F.struct("value", "placeholder"))).alias("__special"))


def replace_spans(text: Column, spans: Column) -> Column:
    """Rebuild ``text`` with each span's ``put`` in place of it, left to right;
    a span that starts before the last replaced end is skipped."""
    def rebuilt(pages: Column) -> Column:
        def step(acc: Column, s: Column):
            kept = s["start"] >= acc["at"]
            gap = paged_substring(pages, acc["at"], s["start"])
            return {"at": F.when(kept, s["end"]).otherwise(acc["at"])}, F.when(kept, F.concat(gap, s["put"]))

        return fold_blocks(F.array_sort(spans), {"at": F.lit(0)}, "string", step, lambda acc, pieces: F.concat(
            F.array_join(pieces, ""), paged_substring(pages, acc["at"], F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(pages_of(text), rebuilt))


def anonymize(docs: DataFrame, vault: DataFrame, salt: str | Column, id_col: str = "doc_id", text_col: str = "text",
              session: str = "session", into: str = "anonymized") -> DataFrame:
    """Replace every value to be anonymised by its vault placeholder.

    ``docs`` carries ``findings`` and ``decision`` (store it first: it is read
    for the exceptions and for the texts).
    """
    salt_column = _salted(salt)
    # Stored, so that its real size decides: a short list is broadcast and the
    # texts stay in place, only a long one makes them move.
    special = store(_exceptions_by_document(docs, vault, id_col, session), "exceptions")
    joined = docs.join(special, id_col, "left")
    chosen = F.coalesce(F.col("__special"), F.expr("cast(map() AS map<string,string>)"))
    spans = F.transform(
        F.when(F.coalesce(F.col("decision"), F.lit("")) != "block", anonymize_spans(F.col("findings"))).otherwise(
            F.filter("findings", lambda f: F.lit(False))),
        lambda f: F.struct(
            f["start"].alias("start"), f["end"].alias("end"),
            F.coalesce(F.try_element_at(chosen, f["value"]), mint(f["label"], f["value"], salt_column)).alias("put")))
    return joined.withColumn("__spans", spans).withColumn(
        into, replace_spans(F.col(text_col), F.col("__spans"))).drop("__spans", "__special")


def store_hidden(docs: DataFrame, name: str = "hidden", id_col: str = "doc_id", buckets: int | None = None) -> DataFrame:
    """Stores hidden texts bucketed and sorted by document, for :func:`reveal`.

    What a reveal joins them with, a short list for each document, is dealt into the same buckets, so the texts stay
    where they are. ``buckets`` must not be under ``spark.sql.shuffle.partitions``, which it is by default: Spark would
    deal both sides anew. Rows that share an id lie in one bucket; null ids too.
    """
    spark = docs.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = f"{name}_{uuid.uuid4().hex}"
    (docs.repartition(buckets, id_col).write.bucketBy(buckets, id_col).sortBy(id_col)
     .option("path", new_path(spark, name)).saveAsTable(table))
    return spark.table(table)


def tokens_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0))


def _restored(docs: DataFrame, vault: DataFrame, id_col: str, text_col: str, session: str) -> DataFrame:
    """``docs`` plus ``__known``: placeholder → value for the placeholders in the text."""
    tokens = docs.select(id_col, session, F.explode_outer(F.array_distinct(tokens_of(F.col(text_col)))
                                                          ).alias("placeholder")).where(F.col("placeholder").isNotNull())
    found = lookup(tokens, vault.withColumnRenamed("value", "original"), [session, "placeholder"], ["original"], id_col)
    known = found.where(F.col("original").isNotNull()).groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("placeholder", "original"))).alias("__known"))
    return docs.join(store(known, "known"), id_col, "left")


def reveal(docs: DataFrame, vault: DataFrame, id_col: str = "doc_id", text_col: str = "anonymized",
           session: str = "session", into: str = "revealed") -> DataFrame:
    """Put the values back.  One pass: restored text is not searched again."""
    text = F.col(text_col)
    gaps, tokens = F.split(text, PLACEHOLDER, -1), tokens_of(text)
    pieces = F.zip_with(gaps, tokens, lambda gap, token: F.concat(
        gap, F.coalesce(F.try_element_at("__known", token), token, F.lit(""))))
    joined = _restored(docs, vault, id_col, text_col, session)
    return joined.withColumn(into, F.when(F.col("__known").isNull(), text).otherwise(
        F.array_join(pieces, ""))).drop("__known")


def reveal_counts(docs: DataFrame, vault: DataFrame, id_col: str = "doc_id", text_col: str = "anonymized",
                  session: str = "session") -> DataFrame:
    """Occurrences of known placeholders per document (what a reveal replaces and a hide restores)."""
    joined = _restored(docs, vault, id_col, text_col, session)
    known = F.coalesce(F.map_keys("__known"), F.array().cast("array<string>"))
    return joined.select(id_col, F.size(F.filter(tokens_of(F.col(text_col)),
                                                 lambda t: F.array_contains(known, t))).alias("replaced"))


# ------------------------------------------------------------------ reports

def plan(docs: DataFrame, text_col: str = "text", anonymized_col: str = "anonymized") -> DataFrame:
    """Add ``outcome`` and ``result`` (empty when blocked, rewritten when pseudonymised, as it came when unscanned)."""
    what = outcome(F.col("decision"), F.col("findings"), F.col("scanned") if "scanned" in docs.columns else None)
    return docs.withColumn("outcome", what).withColumn("result", F.when(F.col("outcome") == "blocked", "").when(
        F.col("outcome") == "pseudonymised", F.col(anonymized_col)).otherwise(F.col(text_col)))


def replacements(docs: DataFrame, vault: DataFrame, id_col: str = "doc_id", session: str = "session") -> DataFrame:
    """Per document and distinct value: placeholder, label, count, order of first sight."""
    per_value = values_to_replace(docs, id_col, session).groupBy(id_col, session, "value").agg(
        F.count("*").alias("count"), F.min_by("label", "start").alias("label"), F.min("start").alias("first_start"))
    return lookup(per_value, vault, [session, "value"], ["placeholder"], id_col).select(
        id_col, "value", "label", "count", "first_start",
        F.coalesce("placeholder", F.concat(F.lit("["), "label", F.lit("]"))).alias("placeholder"))


# Outcome → action name in the activity log.
LOG_ACTIONS = {"pseudonymised": "anonymized", "blocked": "blocked", "warned": "warned", "clean": "clean"}


def detections(docs: DataFrame, id_col: str = "doc_id", service: Column | None = None, host: Column | None = None,
               source: str = "paste", ts: Column | None = None) -> DataFrame:
    """One activity row per document that was not clean, findings rolled up per rule."""
    names = F.create_map(*[F.lit(x) for pair in LOG_ACTIONS.items() for x in pair])
    ids = F.array_distinct(F.col("findings")["rule_id"])
    rolled = F.transform(ids, lambda r: F.struct(
        r.alias("type"),
        F.get(F.array(*map(F.lit, SEVERITIES)), (F.array_max(F.transform(
            F.filter("findings", lambda f: f["rule_id"] == r), lambda f: rank_of(f["severity"], SEVERITIES))) - 1
        ).cast("int")).alias("severity"),
        F.size(F.filter("findings", lambda f: f["rule_id"] == r)).alias("count"))).cast(f"array<{FINDING}>")
    rows = docs.withColumn("__outcome", outcome(F.col("decision"), F.col("findings")))
    host_column = host if host is not None else F.lit(None).cast("string")
    return rows.where(F.col("__outcome") != "clean").select(
        id_col, F.coalesce(service if service is not None else F.lit(None).cast("string"), host_column).alias("service"),
        host_column.alias("host"), names[F.col("__outcome")].alias("action"), rolled.alias("findings"),
        F.size("findings").alias("total"), F.lit(source).alias("source"),
        (ts if ts is not None else F.current_timestamp()).alias("ts"))


__all__ = ["anonymize", "build_vault", "cap_vault", "detections", "exceptions", "finding_rollup", "first_label",
           "lookup", "number_collisions", "outcome", "plan", "replacements", "reveal", "reveal_counts"]
