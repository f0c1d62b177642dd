"""Near-duplicate documents by Order MinHash and banded alignment.

A document is the sequence of its shingles of five words. Two documents are
near duplicates if an alignment of the two sequences, in order, matches m
shingles with m / (n1 + n2 - m) >= 0.8: for texts without moved parts the
Jaccard similarity of their occurrence-labelled shingles.

Method: Order MinHash. Shingles are labelled by their occurrence number. Each
sketch takes the two labelled shingles with the smallest hashes and keeps them
in text order; three sketches make a band, and twenty bands are compared, so a
pair at 0.8 is missed about twice in a thousand and one at 0.9 practically never.
Candidates are verified by an alignment within the band of shifts that the
threshold allows.

Texts with the same words are one class and only its first document takes part.
In a band's bucket each member is compared with one hub; members whose components
still differ afterwards are all compared. In buckets of more than ``SMALL``
members that happens in blocks: a unit of two blocks counts common shingles
for all its pairs at once, aligns only those that can reach the threshold and are
not yet connected, and returns the links that connect something, never all pairs.
No link between components is lost.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import text as T
from veilspark.llm.components import components
from veilspark.llm.tables import lean, small_batches
from veilspark.session import store

SHINGLE = 5
SIMILARITY = 0.8
BANDS, SKETCHES = 20, 3
SMALL, BLOCK = 64, 256

_SCHEMA = pa.schema([("id", pa.int64()), ("version", pa.int64()), ("same_1", pa.int64()), ("same_2", pa.int64()), ("n_words", pa.int32()),
                     ("bands", pa.list_(pa.int64()))])
_DDL = "id long, version long, same_1 long, same_2 long, n_words int, bands array<long>"


def shingles(words: T.Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of each text's shingles; a text of fewer words, but not none, is one shingle."""
    counts = words.counts
    sizes = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    padded = np.concatenate([words.hash, np.zeros(k, np.uint64)])
    first = np.repeat(words.bounds[:-1] - bounds[:-1], sizes) + np.arange(bounds[-1])
    out = padded[first].copy()
    ends = np.repeat(words.bounds[1:], sizes)
    for j in range(1, k):
        out *= np.uint64(T._BASE)
        out += np.where(first + j < ends, padded[first + j], np.uint64(0))
    return T.mix(out), bounds


def labelled(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Shingles with their occurrence number in their text mixed in."""
    owner = T.owners(bounds)
    order = np.argsort(T.mix(values + T.mix(owner.astype(np.uint64) + np.uint64(1))), kind="stable")
    v, o = values[order], owner[order]
    same = np.zeros(len(v), dtype=bool)
    same[1:] = (v[1:] == v[:-1]) & (o[1:] == o[:-1])
    start = np.maximum.accumulate(np.where(same, 0, np.arange(len(v)))) if len(v) else np.zeros(0, int)
    occurrence = np.empty(len(v), np.uint64)
    occurrence[order] = np.arange(len(v), dtype=np.uint64) - start.astype(np.uint64)
    return T.mix(values + occurrence * np.uint64(0xD1B54A32D192ED03))


def sketches(values: np.ndarray, bounds: np.ndarray, bands: int = BANDS, per_band: int = SKETCHES) -> np.ndarray:
    """A row of band hashes for each text that has shingles (others: zeros)."""
    n = len(bounds) - 1
    out = np.zeros((n, bands), dtype=np.uint64)
    full = np.flatnonzero(np.diff(bounds))
    if not len(full):
        return out
    starts = bounds[:-1][full]
    sizes = np.diff(bounds)[full]
    top = np.uint64(2**64 - 1)
    for band in range(bands):
        value = np.full(len(full), band + 1, dtype=np.uint64)
        for k in range(per_band):
            seed = T.mix(np.array([band * per_band + k + 1], dtype=np.uint64) * np.uint64(T._BASE))
            ranked = (values ^ seed) * (seed | np.uint64(1))
            ranked ^= ranked >> np.uint64(29)
            ranked *= np.uint64(0x94D049BB133111EB)
            first = np.minimum.reduceat(ranked, starts)
            at_first = ranked == np.repeat(first, sizes)
            ranked[at_first] = top
            second = np.minimum.reduceat(ranked, starts)
            hits = np.flatnonzero(at_first)
            where_first = hits[np.searchsorted(hits, starts)]
            again = np.flatnonzero(ranked == np.repeat(second, sizes))
            where_second = again[np.searchsorted(again, starts)]
            a, b = np.minimum(where_first, where_second), np.maximum(where_first, where_second)
            pair = T.mix(values[a] * np.uint64(3) + T.mix(values[b]))          # in text order
            value = T.mix(value * np.uint64(T._BASE) + np.where(sizes > 1, pair, values[a]))
        out[full, band] = value
    return out


def _sketch(bands: int, per_band: int, shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in T.words(batch.column(2)):
                values, bounds = shingles(w, shingle)
                found = sketches(labelled(values, bounds), bounds, bands, per_band)
                place = np.arange(len(w.hash)) - np.repeat(w.bounds[:-1], w.counts)
                same = []
                for salt in (1, 2):
                    each = np.concatenate([T.mix(w.hash + np.uint64(salt)) * T.powers(T._BASE, int(place.max(initial=0)) + 1)[place], [np.uint64(0)]])
                    total = np.concatenate([[np.uint64(0)], np.cumsum(each, dtype=np.uint64)])
                    same.append(T.mix(total[w.bounds[1:]] - total[w.bounds[:-1]]).view(np.int64))
                lists = pa.ListArray.from_arrays(np.arange(0, found.size + 1, bands, dtype=np.int32), pa.array(found.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(w.rows[0], len(w.rows)), batch.column(1).slice(w.rows[0], len(w.rows)),
                     pa.array(same[0]), pa.array(same[1]), pa.array(w.counts.astype(np.int32)), lists], schema=_SCHEMA)
    return run


def _sequences(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for w in T.words(batch.column(1)):
                values, bounds = shingles(w, shingle)
                lists = pa.ListArray.from_arrays(bounds.astype(np.int32), pa.array((values >> np.uint64(32)).astype(np.uint32).view(np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(w.rows[0], len(w.rows)), lists], names=["id", "seq"])
    return run


def aligned(a: list, b: list, band: int) -> int:
    """The most elements that an in-order alignment of a and b matches with shifts of at most band places.

    Bit-parallel: bit i of the row stands for a[i], and a row is taken for each element of b; only the bits within the
    band are held.
    """
    n, m = len(a), len(b)
    block = max(band, 256)
    row, done = 0, 0                       # bits from position `done` on: 0 where the row steps up
    matched = 0
    size = 0
    for first in range(0, m, block):
        last = min(m, first + block)
        low, high = max(0, first - band), min(n, last + band)
        if low >= n:
            break
        if low > done:                     # these bits can't change any more
            gone = low - done
            cut = min(gone, size)
            matched += cut - (row & ((1 << cut) - 1)).bit_count()
            row >>= cut
            size -= cut
            done = low
        if high - done > size:
            row |= ((1 << (high - done - size)) - 1) << size
            size = high - done
        at: dict = {}
        for i in range(low, high):
            at[a[i]] = at.get(a[i], 0) | 1 << (i - done)
        for j in range(first, last):
            here = at.get(b[j])
            if here is None:
                continue
            lo = j - band - done
            if lo > 0:
                here = (here >> lo) << lo
            here &= (1 << max(0, j + band + 1 - done)) - 1
            hit = row & here
            if hit:
                row = ((row + hit) | (row - hit)) & ((1 << size) - 1)
    return matched + size - row.bit_count()


def similar(a: list, b: list, threshold: float = SIMILARITY) -> bool:
    """Whether an alignment of a and b reaches the threshold."""
    n, m = len(a), len(b)
    if not n or not m or min(n, m) < threshold * max(n, m) - 1e-9:
        return False
    need = int(np.ceil(threshold * (n + m) / (1 + threshold) - 1e-9))
    head = 0
    while head < min(n, m) and a[head] == b[head]:
        head += 1
    tail = 0
    while tail < min(n, m) - head and a[n - 1 - tail] == b[m - 1 - tail]:
        tail += 1
    if head + tail >= need:
        return True
    a, b = a[head:n - tail], b[head:m - tail]
    if head + tail + sum((Counter(a) & Counter(b)).values()) < need:      # an alignment matches no more than this
        return False
    return head + tail + aligned(a, b, n + m - 2 * need) >= need


def _verify(threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            good = [similar(left[i].values.to_numpy().tolist(), right[i].values.to_numpy().tolist(), threshold) for i in range(len(left))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(good, pa.bool_()))
    return run


def _occurrences(values: np.ndarray) -> np.ndarray:
    """Values of one sequence with their occurrence number, so that equal ones are told apart."""
    order = np.argsort(values, kind="stable")
    ordered = values[order]
    start = np.maximum.accumulate(np.where(np.concatenate([[True], ordered[1:] != ordered[:-1]]), np.arange(len(ordered)), 0))
    number = np.empty(len(values), np.int64)
    number[order] = np.arange(len(values)) - start
    return (values.astype(np.int64) << 32) | number


def _unit(threshold: float):
    """Links between two blocks that connect something not yet connected."""
    def run(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        _, first, second = key
        own = frame[frame["block"] == first]
        other = own if first == second else frame[frame["block"] == second]
        seqs, seqs2 = list(own["seq"]), list(other["seq"])
        ids, ids2 = own["id"].tolist(), other["id"].tolist()
        group, group2 = own["component"].tolist(), other["component"].tolist()
        parent = {c: c for c in [*group, *group2]}

        def find(c: int) -> int:
            while parent[c] != c:
                parent[c] = parent[parent[c]]
                c = parent[c]
            return c

        marked = np.concatenate([_occurrences(x) for x in seqs])
        row = np.repeat(np.arange(len(seqs)), [len(x) for x in seqs])
        order = np.argsort(marked, kind="stable")
        marked, row = marked[order], row[order]
        size = np.array([len(x) for x in seqs])
        links = []
        for j, x in enumerate(seqs2):
            mine = _occurrences(x)
            low, high = np.searchsorted(marked, mine), np.searchsorted(marked, mine, side="right")
            n = high - low
            at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
            common = np.bincount(row[at], minlength=len(seqs))
            can = np.flatnonzero(common * (1 + threshold) >= threshold * (size + len(x)) - 1e-9)
            for i in can[np.argsort(-common[can], kind="stable")].tolist():
                a, b = find(group[i]), find(group2[j])
                if a != b and similar(seqs[i].tolist(), x.tolist(), threshold):
                    parent[b] = a
                    links.append((ids[i], ids2[j]))
        return pd.DataFrame(links, columns=["u", "v"], dtype="int64")
    return run


def _links(pairs: DataFrame, sequences: DataFrame, threshold: float) -> DataFrame:
    """The pairs (u, v) that are similar."""
    both = (store(pairs, "pairs").join(sequences.select(F.col("id").alias("u"), F.col("seq").alias("a")), "u")
            .join(sequences.select(F.col("id").alias("v"), F.col("seq").alias("b")), "v").select("u", "v", "a", "b"))
    return both.mapInArrow(lean(_verify(threshold)), "u long, v long")


def _ids(column: str) -> Column:
    return F.col("id").alias(column)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = SIMILARITY,
                    shingle: int = SHINGLE, bands: int = BANDS, per_band: int = SKETCHES) -> DataFrame:
    """One row per document: id, ``group_id``, ``kept``.

    group_id is the smallest id of the documents that are connected with it;
    kept says that it is that document. Texts without words (null, empty) are
    alone in their group, and so are rows without an id (group null, kept).
    Rows that share an id are one document with several texts, linked if one of
    them is. Other columns are not looked at. Texts of any length are compared
    whole; equal sketches of different texts only make them candidates; an
    empty table gives an empty result.
    """
    small_batches(docs)
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be above 0 and at most 1")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text_col).alias("version"),
                       F.col(text_col).cast("string").alias("text"))
    sketched = store(rows.mapInArrow(lean(_sketch(bands, per_band, shingle)), _DDL), "sketches")
    worded = sketched.where("n_words > 0 AND id IS NOT NULL")
    same = ["same_1", "same_2"]
    first = store(worded.groupBy(*same).agg(F.min(F.struct("id", "version")).alias("first"))
                  .select(*same, F.col("first.id").alias("first"), F.col("first.version").alias("version")), "classes")
    copies = worded.join(first.select(*same, "first"), same).where("id != first").select(F.col("first").alias("u"), _ids("v"))

    one = first.select(F.col("first").alias("id"), "version")
    n = F.greatest(F.col("n_words") - (shingle - 1), F.lit(1)).alias("n")         # how many shingles
    entries = worded.join(one, ["id", "version"], "left_semi").select("id", n, F.posexplode("bands").alias("band", "value"))
    entries = entries.select("id", "n", F.xxhash64("band", "value").alias("bucket"))
    shared = store(entries.groupBy("bucket").agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a != b").select("bucket"), "buckets")
    members = store(entries.join(shared, "bucket").distinct(), "members")

    wanted = one.join(members.select("id").distinct(), "id", "left_semi")
    texts = rows.join(wanted.hint("shuffle_hash"), ["id", "version"], "left_semi").select("id", "text")
    sequences = store(texts.mapInArrow(lean(_sequences(shingle)), "id long, seq array<int>"), "sequences")

    def near(a: str, b: str) -> Column:
        """Sequences of very different length need no comparison."""
        return F.least(a, b) >= F.lit(threshold) * F.greatest(a, b) - 1e-9

    first_of = F.min(F.struct(F.xxhash64("id"), "id", "n"))
    hubs = store(members.groupBy("bucket").agg(first_of["id"].alias("hub"), first_of["n"].alias("hub_n")), "hubs")
    pairs = (members.join(hubs, "bucket").where((F.col("id") != F.col("hub")) & near("n", "hub_n"))
             .select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct())
    links = store(_links(pairs, sequences, threshold), "links")
    part = store(members.join(components(links), "id", "left").select("id", "n", "bucket", F.coalesce("component", "id").alias("component")), "parts")
    # Whatever is still apart in a bucket is compared.
    mixed = part.groupBy("bucket").agg(F.count("*").alias("size"), F.min("component").alias("c0"), F.max("component").alias("c1"))
    mixed = store(mixed.where("c0 != c1").select("bucket", "size"), "mixed")
    rest = store(part.join(mixed, "bucket"), "rest")
    few, many = rest.where(F.col("size") <= SMALL), rest.where(F.col("size") > SMALL)
    pairs = (few.select("bucket", _ids("u"), F.col("n").alias("nu"), F.col("component").alias("cu"))
             .join(few.select("bucket", _ids("v"), F.col("n").alias("nv"), F.col("component").alias("cv")), "bucket")
             .where(F.expr("u < v AND cu != cv") & near("nu", "nv")).select("u", "v").distinct())
    blocks = F.ceil(F.col("size") / BLOCK).cast("int")
    placed = many.withColumn("block", F.pmod(F.xxhash64("id"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
    units = placed.select("bucket", "id", "component", "block", F.least("block", "other").alias("first"), F.greatest("block", "other").alias("second"))
    close = (units.join(sequences.select("id", "seq"), "id").groupBy("bucket", "first", "second")
             .applyInPandas(_unit(threshold), "u long, v long"))
    links = store(links.union(_links(pairs, sequences, threshold)).union(close).union(copies), "links")
    groups = components(links).select(_ids("member"), "component")
    group = F.coalesce("component", "id")
    return (sketched.select("id").join(groups, F.col("id") == F.col("member"), "left")
            .select(F.col("id").alias(id_col), group.alias("group_id"), (F.col("id").isNull() | (group == F.col("id"))).alias("kept")))
