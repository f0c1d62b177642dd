"""Best-fit-decreasing packing of tokenised documents into sequences.

A document is its token ids followed by one end token. One that is longer than
a sequence is cut into pieces of full length and a rest; nothing else is cut.

Method: best-fit decreasing with a segment tree over remaining capacities,
which finds the tightest open sequence in logarithmic time. Pieces of one
length are alike, so the tree works on numbers of pieces and numbers of
sequences: its input is how many pieces there are of each length, at most as
many numbers as a sequence has tokens, whatever the size of the corpus. The
result is the one that packing piece by piece gives. Its placements go back to
the pieces by (length, rank), and rank comes from counts for each task, so no
group of pieces meets in one task and the token ids themselves never move.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from contextlib import suppress
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from veilspark.llm import text as T
from veilspark.llm.tables import lean, small_batches
from veilspark.session import store

LENGTH = 2048
CACHED_WORDS = 300_000      # token ids kept for up to twice so many different words in each Python worker

_SCHEMA = pa.schema([("id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                     ("length", pa.int64()), ("ids_crc32", pa.int64())])


@lru_cache(maxsize=2)
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Ids of texts, as little-endian uint32 bytes, through a bounded table of words.

    The tokenizer splits at white space before all else, so a text's ids are
    those of its words one after another; only words not seen lately are encoded.
    """

    def __init__(self, path: str, cached: int = CACHED_WORDS):
        self.tokenizer, self.cached = _tokenizer(path), cached
        self.marks = {m: np.array(self.tokenizer.encode(m, add_special_tokens=False).ids, dtype="<u4").tobytes() for m in ".,;:!?"}
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}      # the table that was full last; words still in use move on from it

    def _learn(self, words: set[str]) -> None:
        known, before = self.known, self.before
        new, marked = [], []
        for word in words:
            ids = before.get(word)
            if ids is not None:
                known[word] = ids
            elif word[-1:] in self.marks and word[:-1].isalpha() and max(word) <= "\xff":
                marked.append(word)
            else:
                new.append(word)
        if marked:          # letters and a mark are split before all else, so the word is mostly known without its mark
            bare = {w[:-1] for w in marked}.difference(known, new)
            for word in bare:
                ids = before.get(word)
                if ids is None:
                    new.append(word)
                else:
                    known[word] = ids
        for at in range(0, len(new), 512):
            part = new[at:at + 512]
            starts = np.concatenate([[0], np.cumsum([len(w) + 1 for w in part])])
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ids = np.array(encoded.ids, dtype="<u4").tobytes()
            offsets = np.fromiter((a for a, _ in encoded.offsets), dtype=np.int64, count=len(ids) // 4)
            cuts = (4 * np.searchsorted(offsets, starts)).tolist()
            known.update(zip(part, map(ids.__getitem__, map(slice, cuts[:-1], cuts[1:])), strict=True))
        for word in marked:
            known[word] = known[word[:-1]] + self.marks[word[-1]]

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of some texts; hand over a few at a time."""
        split = []
        for text in texts:
            with suppress(UnicodeEncodeError):
                text.encode("latin-1")          # where lower-casing is beyond doubt, do it first: fewer words to know
                text = text.lower()
            # Only these four are white space to every part of the tokenizer; anything else stays in a word.
            split.append(text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" "))
        if len(self.known) > self.cached:
            self.known, self.before = {}, self.known
        missing = set().union(*split).difference(self.known)
        if missing:
            self._learn(missing)
        return [b"".join(map(self.known.__getitem__, parts)) for parts in split]


def _pieces(path: str, end_id: int, size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        end = int(end_id).to_bytes(4, "little")
        for batch in batches:
            rows, keys, rank = [], batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for first, last, _, _ in T.chunks(batch.column(2), 1 << 18):
                texts = [text or "" for text in batch.column(2).slice(first, last - first).to_pylist()]
                for k, ids in enumerate(encoder.encode(texts), first):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * size)):
                        part = ids[at:at + 4 * size]
                        rows.append((keys[k], rank[k], piece, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = zip(*rows, strict=True) if rows else [[]] * len(_SCHEMA)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _SCHEMA, strict=True)], schema=_SCHEMA)
    return run


class Capacities:
    """A segment tree over remaining capacities 0..size: which of them has an open sequence."""

    def __init__(self, size: int):
        self.leaves = 1 << size.bit_length()
        self.any = np.zeros(2 * self.leaves, dtype=bool)

    def set(self, capacity: int, there: bool) -> None:
        at = capacity + self.leaves
        self.any[at] = there
        while at > 1:
            at //= 2
            self.any[at] = self.any[2 * at] or self.any[2 * at + 1]

    def tightest(self, length: int) -> int | None:
        """The smallest capacity of at least length that has an open sequence."""
        at = length + self.leaves
        while not self.any[at]:
            while at % 2 and at > 1:        # a right child: go up to where there is something to the right
                at //= 2
            if at <= 1:
                return None
            at += 1
        while at < self.leaves:
            at = 2 * at if self.any[2 * at] else 2 * at + 1
        return at - self.leaves


def best_fit(counts: dict[int, int], size: int = LENGTH) -> list[tuple[int, int, int, int, int]]:
    """Placements (length, first rank, first sequence, pieces in each, offset) of best-fit decreasing.

    Pieces of one length with ranks from first rank on fill sequences from first
    sequence on, so many in each, the first at offset.
    """
    tree, opened = Capacities(size), {}      # capacity -> stretches of sequences (first, number)
    used, moves = 0, []

    def leave(capacity: int, first: int, number: int) -> None:
        if number and capacity:
            opened.setdefault(capacity, []).append((first, number))
            tree.set(capacity, True)

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            capacity = tree.tightest(length)
            if capacity is None:
                each = size // length
                number = -(-left // each)
                first, capacity = used, size
                used += number
            else:
                first, number = opened[capacity].pop()
                if not opened[capacity]:
                    tree.set(capacity, False)
                each = capacity // length
            full, rest = divmod(left, each)
            full = min(full, number)
            moves.append((length, rank, first, each, size - capacity))
            leave(capacity - each * length, first, full)
            placed = full * each
            if full < number and rest and placed < left:
                leave(capacity - rest * length, first + full, 1)
                placed += rest
                full += 1
            leave(capacity, first + full, number - full)
            rank += placed
            left -= placed
    return moves


def _place(moves: list[tuple[int, int, int, int, int]]):
    by: dict[int, list[tuple]] = {}
    for move in moves:
        by.setdefault(move[0], []).append(move[1:])
    tables = {n: np.array(sorted(rows), dtype=np.int64) for n, rows in by.items()}

    @F.pandas_udf("sequence_id long, offset long")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        n, r = length.to_numpy(), rank.to_numpy()
        out = np.zeros((2, len(n)), dtype=np.int64)
        for value in np.unique(n):
            at = np.flatnonzero(n == value)
            table = tables[int(value)]
            move = table[np.searchsorted(table[:, 0], r[at], side="right") - 1]
            beyond = r[at] - move[:, 0]
            out[0, at] = move[:, 1] + beyond // move[:, 2]
            out[1, at] = move[:, 3] + value * (beyond % move[:, 2])
        return pd.DataFrame({"sequence_id": out[0], "offset": out[1]})

    return place


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
         size: int = LENGTH) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    tokenizer is the path of a tokenizer file that executors can read. A null
    text is empty: its document is the end token alone. Repeated rows, and rows
    that share an id or have none, are packed each for itself. Other columns are not looked at.
    Pieces of one length are placed in the order of rows; a text of any length is cut into pieces. An empty table gives an empty result.
    """
    small_batches(docs)
    if not 0 < size < 1 << 20:
        raise ValueError("size must be from 1 to 1048575")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"),
                       F.col(text_col).cast("string").alias("text"))
    schema = "id long, row long, piece int, start long, length long, ids_crc32 long"
    pieces = store(rows.mapInArrow(lean(_pieces(tokenizer, end_id, size)), schema), "pieces")
    # Rank within a length: counts for each block of rows first, then a running sum over blocks.
    block = F.shiftright("row", 33)
    held = pieces.groupBy("length", block.alias("block")).agg(F.count("*").alias("n"))
    before = store(held.withColumn("before", F.sum("n").over(W.partitionBy("length").orderBy("block")) - F.col("n")), "blocks")
    counts = {r["length"]: r["n"] for r in before.groupBy("length").agg(F.sum("n").alias("n")).collect()}   # at most size rows
    in_block = W.partitionBy("length", "block").orderBy("row", "piece")
    ranked = (pieces.withColumn("block", block)
              .withColumn("nth", F.row_number().over(in_block) - 1)
              .join(before.select("length", "block", "before").hint("merge"), ["length", "block"])     # grows with the tasks: no broadcast
              .withColumn("at", _place(best_fit(counts, size))(F.col("length"), F.col("before") + F.col("nth"))))
    return ranked.select(F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset")
