"""Benchmark decontamination by winnowed fingerprints.

An item's windows are its runs of ``window`` consecutive words (13); an item of
fewer words is one window. A document word is hit if it lies in an occurrence of
any window.

Method: winnowing. Of every ``window - k + 1`` consecutive k-grams of a document
the one with the smallest hash is kept, so that every shared span of ``window``
words holds a kept k-gram. Kept k-grams are joined with all k-grams of the items
and each match is extended word by word in both directions, which also checks
it; an extension of at least ``window`` words is a hit. Items too short for the
guarantee are joined by the hash of their whole text instead, at every position
of a document, of which there are as many kinds as there are such lengths. Their
hashes are salted apart from those of k-grams, also where they have k words.

Before the join, a bit table of fixed size over the items' hashes drops document
k-grams that no item can match. It only saves work: a false bit costs a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import text as T
from veilspark.llm.tables import lean, small_batches
from veilspark.session import store

WINDOW = 13
K = 6
FILTER_BITS = 23

_GRAM = pa.struct([("hash", pa.int64()), ("at", pa.int32()), ("before", pa.list_(pa.string())), ("after", pa.list_(pa.string()))])
_SCHEMA = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("n_words", pa.int64()), ("grams", pa.list_(_GRAM))])
_DDL = ("id long, row long, n_words long, "
        "grams array<struct<hash: bigint, at: int, before: array<string>, after: array<string>>>")


def kept(values: np.ndarray, owner: np.ndarray, span: int) -> np.ndarray:
    """Positions of the smallest value of every span of values of one owner; all minima of a span if several are equal."""
    n = len(values) - span + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least = values[:n].copy()
    for j in range(1, span):
        np.minimum(least, values[j:j + n], out=least)
    whole = owner[:n] == owner[span - 1:]
    chosen = np.zeros(len(values), dtype=bool)
    for j in range(span):
        chosen[j:j + n] |= whole & (values[j:j + n] == least)
    return np.flatnonzero(chosen)


def _grams(words: T.Words, lengths: list[int], k: int, window: int, winnow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first word, number of words) of the grams to look up; lengths are those of whole short items."""
    owner = T.owners(words.bounds)
    found = []
    for n, short in [(k, False), *((n, True) for n in sorted(set(lengths)))]:
        value = T.grams(words.hash, n)
        if not len(value):
            continue
        inside = owner[:len(value)] == owner[n - 1:n - 1 + len(value)]
        if winnow and not short:
            at = kept(np.where(inside, value, np.uint64(2**64 - 1)), _grams_owner(owner, inside), window - k + 1)
            at = at[inside[at]]
        else:
            at = np.flatnonzero(inside)
        found.append((value[at] + _salt(n, window if short else 0), at, np.full(len(at), n)))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(parts) for parts in zip(*found, strict=True))


def _salt(n: int, kind: int) -> np.uint64:
    """Keeps the hashes of k-grams (kind 0) and of whole short items (kind: the window) apart."""
    return np.uint64(n + kind)


def _grams_owner(owner: np.ndarray, inside: np.ndarray) -> np.ndarray:
    return np.where(inside, owner[:len(inside)], -1 - np.arange(len(inside)))


def _batch(words: T.Words, ids, rows, at, value, size, window: int, k: int) -> list[dict]:
    out = [{"id": ids[r], "row": rows[r], "n_words": int(n), "grams": []} for r, n in zip(words.rows, words.counts, strict=True)]
    if len(at):
        which = np.searchsorted(words.bounds, at, side="right") - 1
        signed = value.view(np.int64)
        for i in range(len(at)):
            t, p, n = int(which[i]), int(at[i]), int(size[i])
            a = max(int(words.bounds[t]), p - (window - k))
            b = min(int(words.bounds[t + 1]), p + max(n, window))
            out[t]["grams"].append({"hash": int(signed[i]), "at": p - int(words.bounds[t]),
                                    "before": [words.word(j) for j in range(p - 1, a - 1, -1)], "after": [words.word(j) for j in range(p, b)]})
    return out


def _emit(rows: list[dict]) -> Iterator[pa.RecordBatch]:
    for at in range(0, len(rows), 2000):
        yield pa.RecordBatch.from_pylist(rows[at:at + 2000], schema=_SCHEMA)


def _document_grams(bits: np.ndarray, lengths: list[int], k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for words in T.words(batch.column(2)):
                value, at, size = _grams(words, lengths, k, window, winnow=True)
                slot = value >> np.uint64(64 - FILTER_BITS)
                hit = (bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1
                keep = np.flatnonzero(hit)
                yield from _emit(_batch(words, ids, rows, at[keep], value[keep], size[keep], window, k))
    return run


def _item_grams(k: int, window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, rows = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for words in T.words(batch.column(2)):
                counts, short = words.counts, []
                value, at, size = _grams(words, [], k, window, winnow=False)
                long = counts[np.searchsorted(words.bounds, at, side="right") - 1] >= window
                parts = [(value[long], at[long], size[long])]
                for t in np.flatnonzero((counts > 0) & (counts < window)):
                    n, first = int(counts[t]), int(words.bounds[t])
                    short.append((int(T.grams(words.hash[first:first + n], n)[0] + _salt(n, window)), first, n))
                if short:
                    parts.append((np.array([s[0] for s in short], np.uint64), np.array([s[1] for s in short]), np.array([s[2] for s in short])))
                value, at, size = (np.concatenate(p) for p in zip(*parts, strict=True))
                yield from _emit(_batch(words, ids, rows, at, value, size, window, k))
    return run


def _filter(items: DataFrame) -> np.ndarray:
    """The bit table: at most 2 ** (FILTER_BITS - 5) rows come to the driver, however many items there are."""
    slot = F.shiftrightunsigned("hash", 64 - FILTER_BITS)
    words = items.groupBy(F.shiftright(slot, 5).alias("word")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), (slot % 32).cast("int"))).alias("bits")).toPandas()
    table = np.zeros(1 << (FILTER_BITS - 5), dtype="<u4")
    table[words["word"].to_numpy(dtype=np.int64)] = words["bits"].to_numpy(dtype=np.int64).astype(np.uint32)
    return table.view(np.uint8)


def hits(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
         item_text_col: str = "text", window: int = WINDOW, k: int = K) -> tuple[DataFrame, DataFrame]:
    """(documents: id, row, n_words; hits: row, item, first, last) with word positions, last exclusive."""
    small_batches(docs)
    if not 1 <= k <= window:
        raise ValueError("k must be from 1 to window")
    benchmark = items.select(F.col(item_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                             F.col(item_text_col).cast("string").alias("text")).where("id IS NOT NULL")
    grams = store(benchmark.mapInArrow(lean(_item_grams(k, window)), _DDL)
                  .select(F.col("id").alias("item"), "n_words", F.inline("grams")), "benchmark-grams")
    lengths = [r["n_words"] for r in grams.where(F.col("n_words") < window).select("n_words").distinct().collect()]   # under window of them
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).cast("string").alias("text"))
    found = store(rows.mapInArrow(lean(_document_grams(_filter(grams), lengths, k, window)), _DDL), "document-grams")

    # Equal contexts of items are one row with a list of items, and an item is listed once for each.
    contexts = (grams.groupBy("hash", "before", "after", F.least("n_words", F.lit(window)).alias("need"))
                .agg(F.collect_set("item").alias("items")))
    contexts = store(contexts.select("hash", F.col("before").alias("item_before"), F.col("after").alias("item_after"), "need", "items"),
                     "benchmark-contexts")
    pairs = found.select("row", F.inline("grams")).join(contexts, "hash")
    extended = pairs.withColumn("left", _common("before", "item_before")).withColumn("right", _common("after", "item_after"))
    good = extended.where((F.col("right") > 0) & (F.col("left") + F.col("right") >= F.col("need")))
    spans = good.select("row", (F.col("at") - F.col("left")).alias("first"), (F.col("at") + F.col("right")).alias("last"), "items")
    return found.select("id", "row", "n_words"), spans


def _common(a: str, b: str):
    """How many leading elements two arrays share."""
    same = F.zip_with(a, b, lambda x, y: F.coalesce(x == y, F.lit(False)))
    miss = F.array_position(same, False)
    return F.when(miss == 0, F.size(same)).otherwise((miss - 1).cast("int"))


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
                  item_text_col: str = "text", window: int = WINDOW, k: int = K, share: int = 20) -> DataFrame:
    """One row per document: id, n_words, n_hit, n_items, items_sha256, contaminated.

    contaminated: some word is hit and ``share * n_hit >= n_words``. Null and
    empty texts have no words and no hits; items without an id or words are left out, and
    items that share an id count once. Repeated rows are each judged for themselves. Other columns are not looked at.
    Equal smallest hashes of a window are all kept. Texts may be of any length; an empty table gives an empty result.
    """
    rows, spans = hits(docs, items, id_col, text_col, item_col, item_text_col, window, k)
    spans = store(spans, "contamination-spans")
    # Words in the union of spans: what each span adds beyond the end of all before it.
    reach = F.max("last").over(W.partitionBy("row").orderBy("first", "last").rowsBetween(W.unboundedPreceding, -1))
    covered = (spans.select("row", "first", "last").distinct().withColumn("reach", F.coalesce(reach, F.lit(0)))
               .withColumn("new", F.greatest(F.lit(0), F.col("last") - F.greatest("first", "reach")))
               .groupBy("row").agg(F.sum("new").alias("n_hit")))
    listed = (spans.select("row", F.explode("items").alias("item")).distinct()
              .groupBy("row").agg(F.sort_array(F.collect_list(F.col("item").cast("string"))).alias("items")))
    per_row = covered.join(listed, "row")
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    names = F.coalesce("items", F.array().cast("array<string>"))
    return (rows.join(per_row, "row", "left")
            .select(F.col("id").alias(id_col), "n_words", n_hit.alias("n_hit"), F.size(names).cast("long").alias("n_items"),
                    F.sha2(F.array_join(names, ","), 256).alias("items_sha256"),
                    ((n_hit > 0) & (F.lit(share) * n_hit >= F.col("n_words"))).alias("contaminated"), "row"))
