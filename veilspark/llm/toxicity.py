"""Toxicity scores from a convolutional text classifier.

Method: a word's vector is the sum of hashed embeddings of the word and of its
first 4, 5 and 6 bytes, so inflected forms share a part. Filters over 1, 2 and 3
consecutive words, the largest response of each filter over the whole text, and
one output. Trained in numpy on all labelled rows: they are dealt into parts of
about ``part_rows``, at most ``MOST_PARTS``, by a hash of the id. In each epoch
every part trains from the same network, and their changes are averaged, those of
a word's vector over the parts that changed it. Rows count by how rare their label
is. Thresholds are calibrated by language on the fifth of the labelled rows that
the network does not see, the language being guessed from the words alone; the
score is shifted so that 0.5 is the threshold. Only counts and network weights,
of fixed size, come to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from copy import deepcopy
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import text as T
from veilspark.llm.tables import lean, small_batches
from veilspark.session import store

SLOTS = 1 << 18
DIM = 8
FILTERS = 8
WIDTHS = (1, 2, 3)
PART_ROWS = 5000
MOST_PARTS = 128
_EPOCHS = 6               # over few rows; over many, all are seen twice at least
_VISITS = 30_000          # of rows, until two epochs do
_MOST_WEIGHT = 10.0       # of a row with a rare label
_UNIT = 1 << 32           # changes are summed as whole numbers, so that their order does not matter
_STEP = 1000              # logits are counted by thousandths to find thresholds
_LANG_SLOTS = 1 << 14
_PREFIXES = (4, 5, 6)
_RARE = 3                 # parts of words in fewer training texts have no vector


def slots(words: T.Words) -> np.ndarray:
    """A row for each word: places of its parts in the embedding table."""
    parts = [words.hash, *[T.mix(words.prefix(n) + np.uint64(n)) for n in _PREFIXES]]
    return np.stack([(p >> np.uint64(46)).astype(np.int64) for p in parts], axis=1)


@dataclass
class Texts:
    """Words of several texts, each followed by empty words so that no filter spans two texts."""

    slots: np.ndarray
    bounds: np.ndarray

    @classmethod
    def of(cls, words: T.Words) -> Texts:
        pad, n = max(WIDTHS) - 1, len(words.counts)
        sizes = words.counts + pad
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        out = np.full((bounds[-1], 1 + len(_PREFIXES)), SLOTS, dtype=np.int64)      # the last row of the table is zero
        out[np.arange(len(words.hash)) + pad * np.repeat(np.arange(n), words.counts)] = slots(words)
        return cls(out, bounds)


@dataclass
class Model:
    table: np.ndarray
    filters: list[np.ndarray] = field(default_factory=list)
    filter_bias: list[np.ndarray] = field(default_factory=list)
    out: np.ndarray | None = None
    out_bias: np.ndarray | None = None
    languages: list[str] = field(default_factory=list)
    lang_table: np.ndarray | None = None
    shift: np.ndarray | None = None             # a threshold for each language, and for none
    known: np.ndarray | None = None             # slots that have a vector
    moments: list[np.ndarray] = field(default_factory=list)      # of the dense weights, for Adam: means, then squares
    steps: int = 0

    def dense(self) -> list[np.ndarray]:
        return [*self.filters, *self.filter_bias, self.out, self.out_bias]

    def flat(self) -> np.ndarray:
        """All but the table, as rows of DIM numbers."""
        values = np.concatenate([*[a.ravel() for a in [*self.dense(), *self.moments]], [self.steps]]).astype(np.float64)
        return np.pad(values, (0, -len(values) % DIM)).reshape(-1, DIM)

    def unflatten(self, rows: np.ndarray) -> None:
        values, at = rows.ravel(), 0
        for a in [*self.dense(), *self.moments]:
            a[...] = values[at:at + a.size].reshape(a.shape)
            at += a.size
        self.steps = int(round(values[at]))

    def hidden(self, texts: Texts):
        x = self.table[texts.slots].sum(1)
        best, where = [], []
        starts = texts.bounds[:-1]
        for width, w, b in zip(WIDTHS, self.filters, self.filter_bias, strict=True):
            reach = x @ w[:DIM] + b
            for k in range(1, width):
                reach[:len(x) - k] += x[k:] @ w[k * DIM:(k + 1) * DIM]
            top = np.maximum.reduceat(reach, starts, axis=0)
            best.append(np.maximum(top, 0))
            where.append(reach)
        return np.concatenate(best, axis=1), where, x

    def logits(self, texts: Texts) -> np.ndarray:
        if len(texts.bounds) < 2:
            return np.zeros(0, np.float32)
        return self.hidden(texts)[0] @ self.out + self.out_bias[0]

    def guess(self, words: T.Words) -> np.ndarray:
        """For each text the position of its language, by its words; the last position if it has none."""
        n = len(self.languages)
        if not n:
            return np.zeros(len(words.counts), int)
        each = self.lang_table[(words.hash >> np.uint64(50)).astype(np.int64)]
        total = np.vstack([np.zeros((1, n)), np.cumsum(each, axis=0, dtype=np.float64)])
        sums = total[words.bounds[1:]] - total[words.bounds[:-1]]
        return np.where(words.counts > 0, sums.argmax(1), n)


def _odds(seen: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Smoothed log odds of each slot, from the texts of each label that hold it (seen) and all texts of each label (n); 0 for rare ones."""
    p = n[1] / n.sum() if n.sum() else 0.5
    odds = np.log((seen[1] + 5 * p + 1e-9) / (seen[0] + 5 * (1 - p) + 1e-9)) - np.log((p + 1e-9) / (1 - p + 1e-9))
    odds[(seen.sum(0) < _RARE)] = 0
    odds[SLOTS] = 0
    return odds


def _join(texts: list[Texts]) -> Texts:
    return Texts(np.concatenate([t.slots for t in texts]), np.concatenate([[0], np.cumsum([t.bounds[-1] for t in texts])]))


def _single(texts: Texts) -> list[Texts]:
    return [Texts(texts.slots[a:b], np.array([0, b - a])) for a, b in zip(texts.bounds[:-1], texts.bounds[1:], strict=True)]


def _initial(odds: np.ndarray) -> Model:
    rng = np.random.default_rng(11)
    table = np.zeros((SLOTS + 1, DIM), np.float32)
    known = odds != 0
    table[known] = rng.normal(0, 0.02, (int(known.sum()), DIM))
    table[:, 0] += 0.25 * odds
    model = Model(table, known=known)
    for width in WIDTHS:
        w = rng.normal(0, 0.1, (width * DIM, FILTERS)).astype(np.float32)
        w[::DIM] += 0.5 / width
        model.filters.append(w)
        model.filter_bias.append(np.full(FILTERS, -0.5, np.float32))
    total = FILTERS * len(WIDTHS)
    model.out, model.out_bias = np.full(total, 2.0 / total, np.float32), np.full(1, -1.0, np.float32)
    model.moments = [np.zeros_like(a) for _ in range(2) for a in model.dense()]
    return model


def _learn(model: Model, batch: Texts, y: np.ndarray, weight: np.ndarray) -> None:
    """One step on a few texts, in place."""
    h, reach, x = model.hidden(batch)
    z = h @ model.out + model.out_bias[0]
    d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * weight / len(y)).astype(np.float32)
    model.steps += 1
    dh = d[:, None] * model.out[None] * (h > 0)
    slopes, biases = [], []
    for j, width in enumerate(WIDTHS):
        mine = dh[:, j * FILTERS:(j + 1) * FILTERS]
        arg = np.stack([reach[j][a:b].argmax(0) + a for a, b in zip(batch.bounds[:-1], batch.bounds[1:], strict=True)])
        gw = np.zeros_like(model.filters[j])
        for k in range(width):
            pos = np.minimum(arg + k, len(x) - 1)
            there = mine * (arg + k < len(x))
            gw[k * DIM:(k + 1) * DIM] = np.einsum("bfd,bf->df", x[pos], there)
            push = there[:, :, None] * model.filters[j].T[None, :, k * DIM:(k + 1) * DIM]
            rows = batch.slots[pos]                                    # text, filter, part of word
            for q in range(rows.shape[2]):
                np.add.at(model.table, rows[:, :, q], -0.5 * push * model.known[rows[:, :, q]][:, :, None])
        slopes.append(gw)
        biases.append(mine.sum(0))
    dense, half = model.dense(), len(model.moments) // 2
    for i, slope in enumerate([*slopes, *biases, h.T @ d, d.sum(keepdims=True)]):
        m, v = model.moments[i], model.moments[half + i]
        m += 0.1 * (slope - m)
        v += 0.01 * (slope * slope - v)
        dense[i] -= 0.02 * m / (np.sqrt(v) + 1e-7) * np.sqrt(1 - 0.99 ** model.steps) / (1 - 0.9 ** model.steps)


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[T.Words, np.ndarray]]:
    """The words of a batch's texts, and the positions of the texts."""
    for w in T.words(batch.column("text")):
        yield w, w.rows


def _counted(languages: list[str]):
    """How many texts of each label hold each slot (without held-out rows), and the words of each language."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, spoken = np.zeros((2, SLOTS + 1), np.int64), np.zeros((len(languages), _LANG_SLOTS), np.int64)
        position = {lang: i for i, lang in enumerate(languages)}
        for batch in batches:
            label, held, lang = batch.column("y").to_numpy(), batch.column("held").to_numpy(zero_copy_only=False), batch.column("lang").to_pylist()
            for w, at in _texts(batch):
                for one, a, b, i in zip(_single(Texts.of(w)), w.bounds[:-1], w.bounds[1:], at, strict=True):
                    if not held[i]:
                        seen[label[i], np.unique(one.slots)] += 1
                    if lang[i] is not None:
                        np.add.at(spoken[position[lang[i]]], (w.hash[a:b] >> np.uint64(50)).astype(np.int64), 1)
        for what, counts in enumerate([*seen, *spoken]):
            slot = np.flatnonzero(counts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(slot), what, np.int32)), pa.array(slot.astype(np.int32)), pa.array(counts[slot])],
                                             names=["what", "slot", "n"])
    return run


_CHANGES = [f"x{i}" for i in range(DIM)]


def _epoch(model: Model, number: int, weights: np.ndarray):
    """The changes that an epoch over each part makes: rows of the table, and below zero those of the other weights."""
    def changes(mine: Model) -> pa.RecordBatch:
        slot = np.flatnonzero((mine.table != model.table).any(1))
        dense = mine.flat() - model.flat()
        moved = np.vstack([mine.table[slot].astype(np.float64) - model.table[slot], dense])
        place = np.concatenate([slot, -1 - np.arange(len(dense))]).astype(np.int32)
        return pa.RecordBatch.from_arrays([pa.array(place), *[pa.array(np.rint(moved[:, i] * _UNIT).astype(np.int64)) for i in range(DIM)]],
                                          names=["slot", *_CHANGES])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, mine = None, None
        rng = np.random.default_rng(number)
        for batch in batches:
            parts = batch.column("part").to_numpy()
            texts = [one for w, _ in _texts(batch) for one in _single(Texts.of(w))]
            label = batch.column("y").to_numpy()
            for now in dict.fromkeys(parts.tolist()):
                if now != part:
                    if mine is not None:
                        yield changes(mine)
                    part, mine, rng = now, deepcopy(model), np.random.default_rng([number, now])
                order = rng.permutation(np.flatnonzero(parts == now))
                for at in range(0, len(order), 32):
                    some = order[at:at + 32]
                    _learn(mine, _join([texts[i] for i in some]), label[some], weights[label[some]])
        if mine is not None:
            yield changes(mine)
    return run


def _train(rows: DataFrame, n: float, model: Model, weights: np.ndarray) -> None:
    """Epochs over all n rows, which are stored by part; the model changes in place."""
    for number in range(int(min(_EPOCHS, max(2, -(-_VISITS // max(n, 1)))))):
        moved = rows.mapInArrow(lean(_epoch(model, number, weights)), "slot int, " + ", ".join(f"{x} long" for x in _CHANGES))
        total = moved.groupBy("slot").agg(*[F.sum(x).alias(x) for x in _CHANGES], F.count("*").alias("n")).toArrow().to_pandas()
        place = total["slot"].to_numpy()
        mean = total[_CHANGES].to_numpy(np.float64) / _UNIT / total["n"].to_numpy()[:, None]
        if len(place):
            flat = model.flat()
            flat[-1 - place[place < 0]] += mean[place < 0]
            model.unflatten(flat)
            model.table[place[place >= 0]] += mean[place >= 0].astype(np.float32)


def _judged(model: Model):
    """How many held-out texts there are of each guessed language, logit and label."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("y").to_numpy()
            for w, at in _texts(batch):
                z = np.rint(np.clip(model.logits(Texts.of(w)), -30, 30) * _STEP).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(model.guess(w).astype(np.int32)), pa.array(z), pa.array(label[at].astype(np.int32))],
                                                 names=["guess", "z", "y"])
    return run


def _threshold(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> float | None:
    """The logit that gives the largest weighted share of right answers, midway between its neighbours."""
    if not len(z) or y.all() or not y.any():
        return None
    z, at = np.unique(z, return_inverse=True)
    good = np.bincount(at, weights=np.where(y == 1, -1.0, 1.0) * weight)
    gain = np.concatenate([[0], np.cumsum(good)])
    best = np.flatnonzero(gain >= gain.max() - 1e-12)
    cuts = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    return float(np.median(cuts[best]))


def _probably_in(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows whose id is marked, and few others: a bit table of 1 MB keeps most other texts out of the shuffle."""
    place = F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1 << 23))
    row, bit = F.expr("__place div 32768"), F.expr("__place % 32768")
    bits = marked.select(place.alias("__place")).select(row.alias("__row"), bit.alias("__bit")).groupBy("__row").agg(
        F.bitmap_construct_agg("__bit").alias("__bits"))
    byte = F.conv(F.hex(F.expr("substring(__bits, int(__place % 32768 div 8) + 1, 1)")), 16, 10).cast("int")
    found = rows.withColumn("__place", place).withColumn("__row", row).join(F.broadcast(bits), "__row")
    return found.where(F.getbit(byte, F.expr("int(__place % 8)")) == 1).select(*rows.columns)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
        lang_col: str = "lang", part_rows: int = PART_ROWS) -> Model | None:
    """Learns from all documents that have a label of 0 or 1; None if there are none. lang_col only serves to calibrate."""
    marked = labels.select(F.col(id_col).cast("string").alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    marked = marked.groupBy("id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"),
                       F.col(lang_col).cast("string").alias("lang"))
    # Ids alone tell how many rows there are; then the texts are dealt into parts.
    total = rows.select("id").join(marked, "id").count()
    if not total:
        return None
    parts = min(MOST_PARTS, -(-total // part_rows))
    dealt = F.pmod(F.xxhash64("id", F.lit(7)), F.lit(parts)).cast("int").alias("part")
    held = (F.pmod(F.xxhash64("id", F.lit(5)), F.lit(5)) == 4).alias("held")
    known = _probably_in(rows, marked).join(marked.hint("shuffle_hash"), "id").select("text", "y", "lang", held, dealt, F.xxhash64("id", F.lit(3)).alias("order"), "id")
    known = store(known.repartition(parts, "part").sortWithinPartitions("part", "order", "id", F.xxhash64("text")).drop("order", "id"), "labelled")
    told = {(r["held"], r["y"]): r["count"] for r in known.groupBy("held", "y").count().collect()}
    n = np.array([told.get((False, y), 0) for y in (0, 1)], float)
    weights = np.minimum(n.sum() / (2 * np.maximum(n, 1)), _MOST_WEIGHT)

    languages = sorted(r["lang"] for r in known.select("lang").distinct().collect() if r["lang"] is not None)
    counts = known.mapInArrow(lean(_counted(languages)), "what int, slot int, n long").groupBy("what", "slot").agg(F.sum("n").alias("n")).toArrow().to_pandas()
    seen, spoken = np.zeros((2, SLOTS + 1)), np.full((_LANG_SLOTS, len(languages)), 0.5)
    of_label = counts["what"].to_numpy() < 2
    seen[counts["what"][of_label], counts["slot"][of_label]] = counts["n"][of_label]
    spoken[counts["slot"][~of_label], counts["what"][~of_label] - 2] += counts["n"][~of_label]
    model = _initial(_odds(seen, n))
    model.languages, model.lang_table = languages, np.log(spoken / spoken.sum(0)).astype(np.float32)
    _train(known.where("NOT held").select("text", "y", "part"), n.sum(), model, weights)
    model.moments, model.known = [], None

    judged = known.where("held").select("text", "y").mapInArrow(lean(_judged(model)), "guess int, z int, y int")
    judged = judged.groupBy("guess", "z", "y").count().toArrow().to_pandas()
    guess, z, y, count = (judged[c].to_numpy() for c in ("guess", "z", "y", "count"))
    z = z / _STEP
    overall = _threshold(z, y, count)
    overall = 0.0 if overall is None else overall
    model.shift = np.full(len(languages) + 1, overall)
    for k in range(len(languages)):
        mine = guess == k
        own = _threshold(z[mine], y[mine], count[mine])
        if own is not None:                      # few rows say little: draw towards the common threshold
            trust = count[mine].sum() / (count[mine].sum() + 50)
            model.shift[k] = trust * own + (1 - trust) * overall
    return model


def _score(model: Model | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            column = pa.array(texts, pa.string(), from_pandas=True)
            out = np.zeros(len(column))
            if model is not None:
                for w in T.words(column):
                    z = model.logits(Texts.of(w)) - model.shift[model.guess(w)]
                    out[w.rows] = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pd.Series(out)
    return run


def score(model: Model | None, text: Column) -> Column:
    """The score of a text, 0 to 1. Null and empty texts have no word and get the score of none; without a model all get 0."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        return _score(model)(batches)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")(text)


def score_documents(docs: DataFrame, training: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
                    lang_col: str = "lang", part_rows: int = PART_ROWS) -> DataFrame:
    """docs with ``score`` and ``predicted`` (1 from a score of 0.5 on); columns of these names are replaced.

    training has ids, texts and languages, labels has ids and labels; an id with
    several labels counts as 1 if one of them is. Repeated rows are scored each for itself.
    Equal scores are predicted alike, 0.5 as toxic. Whole texts are scored, of any length; an empty table gives an empty result.
    """
    small_batches(docs)
    model = fit(training, labels, id_col, text_col, label_col, lang_col, part_rows)
    kept = [c for c in docs.columns if c not in ("score", "predicted")]
    return (docs.withColumn("score", score(model, F.col(text_col)))
            .select(*kept, "score", (F.col("score") >= 0.5).cast("int").alias("predicted")))
