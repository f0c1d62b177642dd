"""Ranked lexical search with range-maximum sparse tables.

Terms are runs of letters and digits (and any character beyond ASCII), A-Z lower-cased. All scores are whole numbers:

    w = floor(1000 * ln((2 * N + 2) / (2 * df + 1)))             weight of a term
    m = 100 - 50 + (50 * n * N) div L                            length factor of a document
    score = sum of w * ((1000000000 * tf) div (1000 * tf + 20 * m)) over the query's terms, once each

Method: documents are dealt into blocks of bounded size, each with the posting lists of the terms that some query has.
The factor beside w is a posting's impact. Over each list lies a sparse table that gives the posting of greatest impact in
any range at once. A query starts with one interval, its whole block; the maxima of its lists within an interval, weighted
and summed, bound every score in it. Best first, an interval is split at the document of greatest impact, that document is
scored, and what lies on either side becomes an interval with a bound of its own; intervals whose bound cannot reach the
documents found so far are never opened. Documents of a block lie by id, so that of equal scores the smaller ids win and a
group of copies of any size is left after the first of them. The best of all blocks are merged in two rounds.

Queries come in blocks too: at most ``QUERY_TERMS`` terms are sent along with one pass over the index, however many
queries there are. Before the index is built, a bit table of fixed size drops terms that no query has.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import text as T
from veilspark.llm.decontamination import FILTER_BITS, _filter
from veilspark.llm.tables import small_batches
from veilspark.session import store

TOP = 50
BLOCK_BYTES, BLOCK_DOCS = 8 << 20, 8192     # of a block of documents; a longer document is a block of its own
QUERY_TERMS = 1 << 19                       # about so many terms of queries go with one pass over the index
OPENED = 32                                 # intervals of a query that are split at a time
SLICE = 1 << 20                             # (interval, term) pairs looked at together
SALTS = 256                                 # parts of a query's results in the first round of merging

_INDEX = pa.schema([("block", pa.int64()), ("hash", pa.int64()), ("docs", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())),
                    ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_INDEX_DDL = "block long, hash long, docs array<bigint>, counts array<bigint>, n_docs long, n_terms long"
_NO_ID = np.iinfo(np.int64).max             # stands for a null id, which comes last


def _item_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        queries = batch.column(0).to_numpy()
        for words in T.words(batch.column(1)):
            pairs = np.unique(np.stack([queries[words.rows][T.owners(words.bounds)], words.hash.view(np.int64)], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["query", "hash"])


class _Builder:
    """Collects the documents of a block and writes its posting lists."""

    def __init__(self) -> None:
        self.ids, self.lengths, self.terms, self.size, self.name = [], [], [], 0, None

    def add(self, words: T.Words, ids: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> None:
        slot = words.hash >> np.uint64(64 - FILTER_BITS)
        hit = ((bits[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8)) & 1).astype(bool)
        before = sum(map(len, self.ids))
        self.terms.append((words.hash[hit].view(np.int64), T.owners(words.bounds)[hit] + before))
        self.name = int(rows[words.rows[0]]) if self.name is None else self.name
        self.ids.append(ids[words.rows])
        self.lengths.append(words.counts)
        self.size += len(words.bytes)

    @property
    def full(self) -> bool:
        return self.size >= BLOCK_BYTES or sum(map(len, self.ids)) >= BLOCK_DOCS

    def write(self) -> pa.RecordBatch:
        ids, lengths = np.concatenate(self.ids), np.concatenate(self.lengths)
        order = np.argsort(ids, kind="stable")
        place = np.empty(len(ids), np.int64)
        place[order] = np.arange(len(ids))
        hashes, docs = (np.concatenate(part) for part in zip(*self.terms, strict=True))
        docs = place[docs]
        sort = np.lexsort((docs, hashes))
        hashes, docs = hashes[sort], docs[sort]
        new = np.ones(len(docs), bool)
        new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
        at = np.flatnonzero(new)                                       # one posting each
        counts = np.diff(np.append(at, len(docs)))
        hashes, docs = hashes[at], docs[at]
        lists = np.flatnonzero(np.append(True, hashes[1:] != hashes[:-1])) if len(hashes) else np.zeros(0, np.int64)
        offsets = np.concatenate([[0], [len(ids)], len(ids) + np.append(lists[1:], len(hashes))] if len(lists) else [[0], [len(ids)]]).astype(np.int32)
        rows = len(offsets) - 1
        first = [pa.array([None], pa.int64()), pa.array(hashes[lists], pa.int64())]
        columns = [pa.array(np.full(rows, self.name)), pa.concat_arrays(first),
                   pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([ids[order], docs]))),
                   pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([lengths[order], counts]))),
                   pa.array([int((lengths > 0).sum())] + [None] * (rows - 1), pa.int64()),
                   pa.array([int(lengths.sum())] + [None] * (rows - 1), pa.int64())]
        return pa.RecordBatch.from_arrays(columns, schema=_INDEX)


def _index(bits: np.ndarray):
    """Blocks of documents: a row of ids and lengths (hash null), and a row for each posting list."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _Builder()
        for batch in batches:
            ids, rows = batch.column(0).fill_null(_NO_ID).to_numpy(), batch.column(1).to_numpy()
            for words in T.words(batch.column(2)):
                block.add(words, ids, rows, bits)
                if block.full:
                    yield block.write()
                    block = _Builder()
        if block.ids:
            yield block.write()
    return run


class Lists:
    """The posting lists of a block, end to end, under one sparse table."""

    def __init__(self, docs: np.ndarray, offsets: np.ndarray, impact: np.ndarray, width: int) -> None:
        self.width, self.docs, self.impact = width, docs, impact
        sizes = np.diff(offsets)
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * width + docs
        levels = max(int(sizes.max(initial=1)).bit_length(), 1)
        self.table = np.zeros((levels, len(docs)), dtype=np.int32)      # [k, i]: where the maximum of i … i + 2 ** k - 1 stands
        self.table[0] = np.arange(len(docs))
        for k in range(1, levels):
            half, n = 1 << (k - 1), len(docs) - (1 << k) + 1
            a, b = self.table[k - 1, :n], self.table[k - 1, half:half + n]
            self.table[k, :n] = np.where(impact[a] >= impact[b], a, b)

    def greatest(self, lists: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each list, where within documents first … last - 1 its greatest impact stands, and that impact (0: no posting)."""
        if not len(self.docs):
            return np.zeros(len(lists), np.int64), np.zeros(len(lists), np.int64)
        left = np.searchsorted(self.keys, lists * self.width + first)
        size = np.searchsorted(self.keys, lists * self.width + last) - left
        some = size > 0
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        left = np.where(some, left, 0)
        a = self.table[level, left]
        b = self.table[level, np.where(some, left + size - (1 << level), 0)]
        at = np.where(self.impact[a] >= self.impact[b], a, b)
        return at, np.where(some, self.impact[at], 0)


class Queries:
    """Queries with at least one term in the block: their lists and weights, end to end."""

    def __init__(self, query: np.ndarray, lists: np.ndarray, weight: np.ndarray, n: int) -> None:
        self.lists, self.weight = lists, weight
        self.count = np.bincount(query, minlength=n)
        self.start = np.concatenate([[0], np.cumsum(self.count)[:-1]])

    def bounds(self, block: Lists, query: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each interval the sum of its lists' maxima, and the document of the greatest of them. Exact for one document."""
        bound, split = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
        upto, at = np.cumsum(self.count[query]), 0
        while at < len(query):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + SLICE, side="right")))
            q, count = query[at:to], self.count[query[at:to]]
            begin = np.cumsum(count) - count
            term = np.repeat(self.start[q] - begin, count) + np.arange(count.sum())
            where, impact = block.greatest(self.lists[term], np.repeat(first[at:to], count), np.repeat(last[at:to], count))
            part = self.weight[term] * impact
            bound[at:to] = np.add.reduceat(part, begin)
            best = np.flatnonzero(part == np.repeat(np.maximum.reduceat(part, begin), count))
            owner = np.searchsorted(begin, best, side="right") - 1
            lead = best[np.append(True, owner[1:] != owner[:-1])]
            split[at:to] = block.docs[where[lead]] if len(block.docs) else 0
            at = to
        return bound, split


class Best:
    """The ``top`` best documents of each query so far: by score, then by id."""

    def __init__(self, n: int, top: int) -> None:
        self.top, self.n = top, n
        self.query, self.score, self.id, self.block = (np.zeros(0, np.int64) for _ in range(4))
        self.least, self.least_id = np.ones(n, np.int64), np.full(n, _NO_ID)

    def add(self, query: np.ndarray, score: np.ndarray, ids: np.ndarray, block: int) -> None:
        good = score > 0
        query, score = np.append(self.query, query[good]), np.append(self.score, score[good])
        ids, block = np.append(self.id, ids[good]), np.append(self.block, np.full(good.sum(), block))
        order = np.lexsort((ids, -score, query))
        query, score, ids, block = query[order], score[order], ids[order], block[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query)
        kept = rank < self.top
        self.query, self.score, self.id, self.block = query[kept], score[kept], ids[kept], block[kept]
        last = rank == self.top - 1
        self.least[query[last]], self.least_id[query[last]] = score[last], ids[last]

    def hopeful(self, query: np.ndarray, bound: np.ndarray, least_id: np.ndarray) -> np.ndarray:
        """Whether a document with this score and id would still be among the best."""
        return (bound > self.least[query]) | ((bound == self.least[query]) & (least_id <= self.least_id[query]))


def search_block(block: Lists, queries: Queries, ids: np.ndarray, best: Best, name: int) -> int:
    """Adds the block's documents to the best, and says how many intervals it has opened."""
    query = np.flatnonzero(queries.count)
    first, last = np.zeros(len(query), np.int64), np.full(len(query), block.width)
    bound, split = queries.bounds(block, query, first, last)
    opened = 0
    while True:
        alive = best.hopeful(query, bound, ids[first])
        query, first, last, bound, split = (v[alive] for v in (query, first, last, bound, split))
        if not len(query):
            return opened
        order = np.lexsort((first, -bound, query))
        rank = np.empty(len(query), np.int64)
        rank[order] = np.arange(len(query)) - np.searchsorted(query[order], query[order])
        now = rank < np.clip(SLICE // queries.count[query], 1, OPENED)
        q, a, b, d = query[now], first[now], last[now], split[now]
        opened += len(q)
        score, _ = queries.bounds(block, q, d, d + 1)
        best.add(q, score, ids[d], name)
        q, a, b = np.concatenate([q, q]), np.concatenate([a, d + 1]), np.concatenate([d, b])
        some = a < b
        q, a, b = q[some], a[some], b[some]
        new_bound, new_split = queries.bounds(block, q, a, b)
        query, first, last = np.concatenate([query[~now], q]), np.concatenate([first[~now], a]), np.concatenate([last[~now], b])
        bound, split = np.concatenate([bound[~now], new_bound]), np.concatenate([split[~now], new_split])


def read_block(table: pa.Table, n_docs: int, n_terms: int) -> tuple[np.ndarray, np.ndarray, Lists]:
    """(ids by place, hash of each list in order, the lists) of a block's rows."""
    table = table.combine_chunks().sort_by([("hash", "ascending")])     # nulls come last
    hashes = table["hash"].combine_chunks()
    docs, counts = table["docs"].combine_chunks(), table["counts"].combine_chunks()
    ids, lengths = np.asarray(docs[-1].values), np.asarray(counts[-1].values)
    docs, counts = docs[:-1], counts[:-1]
    offsets = np.asarray(docs.offsets) - (docs.offsets[0].as_py() if len(docs) else 0)
    where, tf = np.asarray(docs.flatten()), np.asarray(counts.flatten())
    m = 100 - 50 + (50 * lengths * n_docs) // n_terms
    return ids, np.asarray(hashes[:-1]), Lists(where, offsets, (1_000_000_000 * tf) // (1000 * tf + 20 * m[where]), len(ids))


def _searcher(names: np.ndarray, query: np.ndarray, hashes: np.ndarray, weight: np.ndarray, n_docs: int, n_terms: int, top: int):
    """Of each block the documents that are among the best of all blocks this task has seen so far."""
    state: list[Best] = []

    def run(table: pa.Table) -> pa.Table:
        if not state:
            state.append(Best(len(names), top))
        best, name = state[0], table["block"][0].as_py()
        ids, known, lists = read_block(table, n_docs, n_terms)
        at = np.minimum(np.searchsorted(known, hashes), max(len(known) - 1, 0))
        there = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
        search_block(lists, Queries(query[there], at[there], weight[there], len(names)), ids, best, name)
        mine = best.block == name
        return pa.table({"query": names[best.query[mine]], "id": best.id[mine], "score": best.score[mine]})
    return run


def search(docs: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
           item_text_col: str = "text", top: int = TOP) -> DataFrame:
    """One row per query row and document among its ``top`` best with a score above 0: item, rank, id, score.

    Equal scores rank by ascending id, null ids last. Repeated rows and rows that share an id are documents of their own, as
    are repeated queries. Null and empty texts have no terms: such documents and queries are in no result. Texts may be of any
    length; one longer than a block is searched alone. Other columns are not looked at. Without documents, queries or terms
    in common the result is empty.
    """
    small_batches(docs)
    items = store(queries.select(F.monotonically_increasing_id().alias("query"), F.col(item_col).alias("item"),
                                 F.col(item_text_col).cast("string").alias("text")), "search-queries")
    terms = store(items.select("query", "text").mapInArrow(_item_terms, "query long, hash long").distinct(), "search-terms")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).cast("string").alias("text"))
    index = store(rows.mapInArrow(_index(_filter(terms)), _INDEX_DDL), "search-index")

    sizes = index.agg(F.sum("n_docs").alias("n_docs"), F.sum("n_terms").alias("n_terms")).first()
    n_docs, n_terms = sizes["n_docs"] or 0, sizes["n_terms"] or 0
    found = index.where("hash IS NOT NULL").groupBy("hash").agg(F.sum(F.size("docs")).alias("df"))
    weight = F.floor(1000 * F.log((2.0 * n_docs + 2) / (2 * F.col("df") + 1))).cast("long")
    parts = max(1, -(-terms.count() // QUERY_TERMS))
    weighted = store(terms.join(found, "hash").select(F.pmod(F.xxhash64("query"), F.lit(parts)).alias("part"), "query", "hash", weight.alias("weight"))
                     .where("weight > 0"), "search-weights")

    hits = []
    for part in range(parts):                       # one pass over the index for each block of queries
        some = weighted.where(F.col("part") == part).select("query", "hash", "weight").toPandas()
        names, query = np.unique(some["query"].to_numpy(np.int64), return_inverse=True)
        order = np.argsort(query, kind="stable")
        run = _searcher(names, query[order], some["hash"].to_numpy(np.int64)[order], some["weight"].to_numpy(np.int64)[order], n_docs, n_terms, top)
        hits.append(index.groupBy("block").applyInArrow(run, "query long, id long, score long"))
    hits = store(reduce(DataFrame.unionByName, hits), "search-hits")

    by_score = [F.desc("score"), F.asc("id")]
    salt = F.pmod(F.xxhash64("id", "score"), F.lit(SALTS))
    best = _first(hits.withColumn("salt", salt), ["query", "salt"], by_score, top).drop("salt", "rank")
    best = _first(best, ["query"], by_score, top)
    named = best.join(items.select("query", "item"), "query")
    return named.select(F.col("item").alias(item_col), F.col("rank").alias("rank"),
                        F.when(F.col("id") < _NO_ID, F.col("id")).alias(id_col), "score")


def _first(rows: DataFrame, keys: list[str], order: list, top: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= top)
