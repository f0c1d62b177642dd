"""Removal of runs of lines that stand earlier in the corpus.

A run is a stretch of consecutive lines with at least ``min_words`` words
(split at white space). Of each run that occurs more than once, the first
occurrence in (id, line) order stays and the later ones are deleted, also
inside one document.

Method: winnowing over line hashes. Every shortest run with ``min_words`` words
is a window; the line with the smallest hash in it is its fingerprint, so two
documents that share a run share a fingerprint. Fingerprints that occur twice
select the windows to compare; windows are joined by their whole content, which
also checks the match, and the first position of each is kept. Windows are
taken forwards from each line and backwards from each line, so the matched
ones together reach both ends of a repeated run however it is cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StringType

from veilspark.llm.tables import lean, small_batches
from veilspark.session import store

MIN_WORDS = 50

_FOUND = "id long, version long, fingerprint long, windows array<struct<content: binary, first: int, last: int>>"
_ARROW = pa.schema([
    ("id", pa.int64()), ("version", pa.int64()), ("fingerprint", pa.int64()),
    ("windows", pa.list_(pa.struct([("content", pa.binary()), ("first", pa.int32()), ("last", pa.int32())])))])


def windows(lines: list[str], min_words: int) -> set[tuple[int, int]]:
    """(first, last) of every shortest run with min_words words, seen from either end."""
    total = np.concatenate([[0], np.cumsum([len(line.split()) for line in lines])])
    n = len(lines)
    found = set()
    ends = np.searchsorted(total, total[:-1] + min_words)        # first prefix with enough words
    found.update((i, int(e) - 1) for i, e in enumerate(ends) if e <= n)
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1
    found.update((int(s), j) for j, s in enumerate(starts) if s >= 0)
    return found


def fingerprints(text: str, min_words: int) -> dict[int, list[tuple[bytes, int, int]]]:
    """For each selected line hash, the windows it was selected in, with their content hashes."""
    lines = text.split("\n")
    spans = windows(lines, min_words)
    if not spans:
        return {}
    digests = [blake2b(line.encode("utf-8", "surrogatepass"), digest_size=16).digest() for line in lines]
    order = [int.from_bytes(d[:8], "little", signed=True) for d in digests]
    out: dict[int, list[tuple[bytes, int, int]]] = {}
    for first, last in sorted(spans):
        if last == first:
            out.setdefault(order[first], []).append((digests[first], first, last))
        else:
            content = blake2b(b"".join(digests[first:last + 1]), digest_size=16).digest()
            out.setdefault(min(order[first:last + 1]), []).append((content, first, last))
    return out


def _select(min_words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i, version, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                for fingerprint, spans in fingerprints(text, min_words).items():
                    rows.append({"id": i, "version": version, "fingerprint": fingerprint,
                                 "windows": [{"content": c, "first": a, "last": b} for c, a, b in spans]})
                if len(rows) > 5000:
                    yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)
    return run


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   min_words: int = MIN_WORDS) -> DataFrame:
    """(id, version, first, last): line ranges that repeat an earlier run. version is xxhash64 of the text."""
    small_batches(docs)
    keyed = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"),
                        F.col(text_col).alias("text")).where("text IS NOT NULL AND id IS NOT NULL")
    found = store(keyed.mapInArrow(lean(_select(min_words)), _FOUND), "line-fingerprints")
    # The same fingerprint twice in one document is one row with several windows.
    shared = store(found.groupBy("fingerprint").agg(F.sum(F.size("windows")).alias("n")).where("n > 1")
                   .select("fingerprint"), "line-shared")
    each = found.join(shared, "fingerprint").select("id", "version", F.inline("windows"))
    # Stored, so that both sides of the join below are plain shuffles, which Spark can split at a hot key.
    earliest = store(each.groupBy("content").agg(F.min(F.struct("id", "first")).alias("kept"), F.count("*").alias("n"))
                     .where("n > 1").select("content", "kept"), "line-earliest")
    return (each.join(earliest, "content")
            .where(F.struct("id", "first") != F.col("kept"))
            .select("id", "version", "first", "last"))


@F.pandas_udf(StringType())
def _without(texts: pd.Series, ranges: pd.Series) -> pd.Series:
    """Texts without the given line ranges; null where the text is null."""
    out = []
    for text, spans in zip(texts, ranges, strict=True):
        if text is None:
            out.append(None)
            continue
        lines = text.split("\n")
        kept = np.ones(len(lines), dtype=bool)
        for span in spans:
            kept[span["first"]:span["last"] + 1] = False
        out.append("\n".join(lines[i] for i in np.flatnonzero(kept)))
    return pd.Series(out, dtype=object)


@F.pandas_udf(IntegerType())
def _covered(ranges: pd.Series) -> pd.Series:
    return ranges.map(lambda spans: 0 if spans is None else len({i for s in spans for i in range(s["first"], s["last"] + 1)}))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                min_words: int = MIN_WORDS) -> DataFrame:
    """The documents with later repeated runs deleted, and ``n_deleted_lines``.

    All other columns stay as they are. Null and empty texts, texts of fewer
    than ``min_words`` words and rows without an id stay unchanged. Rows that
    share an id are ordered by line alone; rows equal in id and text count as
    one document and are treated alike. A clashing ``n_deleted_lines`` column is
    replaced. Texts may have any length and number of lines; an empty table gives
    an empty result.
    """
    cut = (repeated_lines(docs, id_col, text_col, min_words)
           .groupBy("id", "version")
           .agg(F.collect_set(F.struct("first", "last")).alias("ranges"))
           .select(F.col("id").alias("__cut_id"), F.col("version").alias("__cut_version"), F.col("ranges").alias("__cut")))
    rows = docs.drop("n_deleted_lines")
    joined = rows.join(cut.hint("shuffle_hash"), (rows[id_col].cast("long") == cut["__cut_id"])
                       & (F.xxhash64(rows[text_col]) == cut["__cut_version"]), "left")
    kept = {c: F.col(c) for c in rows.columns}
    changed = _without(F.when(F.col("__cut").isNotNull(), F.col(text_col)), F.col("__cut"))
    kept[text_col] = F.coalesce(changed, F.col(text_col)).alias(text_col)     # only changed texts go to Python
    return joined.select(*kept.values(), _covered(F.col("__cut")).alias("n_deleted_lines"))
