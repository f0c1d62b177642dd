"""Language identification with error-correcting output codes.

Method: every language gets a binary codeword, far from the others. For each
bit a logistic classifier on hashed character n-grams learns which side of it a
text is on. A text's margins are compared with all codewords, each bit's
logistic loss weighted by how well that bit was learned; the nearest codeword
wins, and a text whose second-nearest is about as near is flagged.

The classifiers are trained on a bounded sample of labelled rows (``sample_rows``,
about as many of each language, chosen by a hash of the id); prediction reads every text whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import text as T
from veilspark.llm.tables import lean, small_batches

BUCKETS = 1 << 12
SAMPLE_ROWS = 2400
UNKNOWN = "und"
AMBIGUOUS = 0.2          # a lead of the nearest codeword below this is ambiguous
_WINDOW = 96             # bytes of the short training stretches beside whole texts
_EPOCHS = 12

_letters = np.where(T._word, np.arange(256), 32).astype(np.uint32)
_letters[65:91] = np.arange(97, 123)
_letters[48:58] = 32     # digits say nothing about the language


def features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row for each text: square roots of hashed 1- to 3-byte counts within words, of length 1."""
    n = len(at) - 1
    low = _letters[raw]
    owner = np.repeat(np.arange(n, dtype=np.int64) * BUCKETS, np.diff(at))
    out = np.zeros(n * BUCKETS, dtype=np.int64)
    code = low
    for order in (1, 2, 3):
        if order > 1:
            if len(low) < order:
                break
            code = code[:-1] * np.uint32(257) + low[order - 1:]
        here = owner[:len(code)]
        good = (low[:len(code)] != 32) | (low[order - 1:] != 32)
        good &= here == owner[order - 1:]
        slot = (code * np.uint32(2654435761) + np.uint32(order * 40503)) >> np.uint32(20)
        out += np.bincount(here[good] + slot[good], minlength=n * BUCKETS)
    dense = np.sqrt(out.reshape(n, BUCKETS)).astype(np.float32)
    dense /= np.maximum(np.linalg.norm(dense, axis=1, keepdims=True), 1e-9)
    return dense


def has_letter(column: pa.Array) -> np.ndarray:
    raw, at = T.buffers(column)
    ascii_letter = np.concatenate([[0], np.cumsum((raw < 128) & T._word[T._lower[raw]] & ~((raw >= 48) & (raw < 58)))])
    out = ascii_letter[at[1:]] > ascii_letter[at[:-1]]
    for i in np.flatnonzero(~out & (at[1:] > at[:-1])):
        out[i] = any(c.isalpha() for c in raw[at[i]:at[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def codewords(n: int) -> np.ndarray:
    """n rows of -1 and 1. Few languages: every way to split them in two; more: random words far apart."""
    if n <= 1:
        return np.ones((n, 0), dtype=np.float32)
    if n <= 5:
        splits = np.arange(1, 2 ** (n - 1))
        return np.where((splits[None, :] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.float32)
    rng, best, most = np.random.default_rng(7), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(50):
        words = rng.choice(np.array([-1, 1], dtype=np.float32), size=(n, bits))
        apart = (bits - words @ words.T) / 2 + np.eye(n) * bits
        if min(apart.min(), np.abs(words.sum(0)).max() < n) > most and np.abs(words.sum(0)).max() < n:
            best, most = words, apart.min()
    return best if best is not None else words


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    trust: np.ndarray            # weight of each bit

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each row: position of the language, score 0 to 1, and the lead over the second."""
        n = len(self.languages)
        if n == 1:
            return np.zeros(len(x), int), np.ones(len(x)), np.ones(len(x))
        margin = x @ self.weights + self.bias
        loss = np.logaddexp(0, -margin[:, None, :] * self.code[None]) @ self.trust
        p = np.exp(loss.min(1, keepdims=True) - loss)
        p /= p.sum(1, keepdims=True)
        two = np.partition(p, -2, axis=1)
        return p.argmax(1), p.max(1), two[:, -1] - two[:, -2]


def _rows(column: pa.Array, at_most: int = 256):
    for first, last, raw, at in T.chunks(column, most=at_most):
        yield first, last, raw, at


def _train(x: np.ndarray, label: np.ndarray, languages: list[str]) -> Model:
    code = codewords(len(languages))
    bits = code.shape[1]
    weights, bias = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    rng, target = np.random.default_rng(1), code[label]
    moment = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(bias), np.zeros_like(bias)]
    step = 0
    for _ in range(_EPOCHS if bits else 0):
        order = rng.permutation(len(x))
        for at in range(0, len(order), 256):
            part = order[at:at + 256]
            margin = x[part] @ weights + bias
            push = -target[part] / (1 + np.exp(np.clip(target[part] * margin, -30, 30))) / len(part)
            step += 1
            for k, (value, slope) in enumerate(((weights, x[part].T @ push + 1e-6 * weights), (bias, push.sum(0)))):
                m, v = moment[2 * k], moment[2 * k + 1]
                m += 0.1 * (slope - m)
                v += 0.01 * (slope * slope - v)
                value -= (0.3 / np.sqrt(step)) * m / (np.sqrt(v) + 1e-8) * np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
    good = ((x @ weights + bias) * target > 0).mean(0) if len(x) and bits else np.zeros(bits)
    trust = np.log((good + 0.01) / (1.01 - good)) if bits else np.zeros(0)
    trust = np.maximum(trust, 0.05)
    return Model(languages, code, weights, bias, (trust / trust.mean() if bits else trust).astype(np.float32))


def fit(rows: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id",
        sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Learns from rows with a text and a language; None if there are none."""
    labelled = rows.select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.col(id_col).alias("id")
                           ).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}     # one row per language
    if not counts:
        return None
    languages = sorted(counts)
    each = max(20, sample_rows // len(languages))
    share = F.create_map(*[F.lit(v) for k in languages for v in (k, min(1.0, each / counts[k]))])
    dice = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(8)), F.lit(1 << 20)) / F.lit(1 << 20)
    sample = labelled.where(dice < share[F.col("lang")]).select("text", "lang").toPandas()
    place = {k: i for i, k in enumerate(languages)}
    xs, ys = [], []
    rng = np.random.default_rng(5)
    for first, last, raw, at in _rows(pa.array(sample["text"], pa.string())):
        label = sample["lang"].iloc[first:last].map(place).to_numpy()
        xs.append(features(raw, at))
        ys.append(label)
        sizes = np.diff(at)
        for _ in range(2):                  # short stretches, so that short texts are learned too
            start = at[:-1] + (rng.random(len(sizes)) * np.maximum(sizes - _WINDOW, 0)).astype(np.int64)
            stop = np.minimum(start + rng.integers(12, _WINDOW, len(sizes)), at[1:])
            piece = np.concatenate([raw[a:b] for a, b in zip(start, stop, strict=True)])
            xs.append(features(piece, np.concatenate([[0], np.cumsum(stop - start)])))
            ys.append(label)
    return _train(np.concatenate(xs), np.concatenate(ys), languages)


def _predict(model: Model | None):
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            column = pa.array(texts, pa.string(), from_pandas=True)
            lang = np.full(len(column), UNKNOWN, dtype=object)
            score, lead = np.zeros(len(column)), np.zeros(len(column))
            if model is not None:
                letters = has_letter(column)
                for first, last, raw, at in _rows(column):
                    best, p, gap = model.decode(features(raw, at))
                    good = letters[first:last]
                    lang[first:last][good] = np.array(model.languages, dtype=object)[best[good]]
                    score[first:last][good], lead[first:last][good] = p[good], gap[good]
            yield pd.DataFrame({"lang_pred": lang, "score": np.clip(score, 0, 1), "ambiguous": (lead < AMBIGUOUS) & (lang != UNKNOWN)})
    return run


def predict(model: Model | None, text: Column) -> Column:
    """struct<lang_pred, score, ambiguous> of a text. Null and letterless texts are ``und`` with score 0."""
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        return lean(_predict(model))(batches)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
    return F.pandas_udf(run, "lang_pred string, score double, ambiguous boolean")(text)


def identify(docs: DataFrame, training: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
             sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """docs with ``lang_pred``, ``score`` and ``ambiguous``; columns of these names are replaced.

    Languages are those of the training rows with a text and a language; without
    any, every text is ``und``. Repeated rows are predicted each for itself. A tie between
    languages goes to the first in alphabetical order. Whole texts are read, of any length; an empty table gives an empty result.
    """
    small_batches(docs)
    model = fit(training, text_col, lang_col, id_col, sample_rows)
    new = ["lang_pred", "score", "ambiguous"]
    kept = [c for c in docs.columns if c not in new]
    return (docs.withColumn("__found", predict(model, F.col(text_col)))
            .select(*kept, *[F.col(f"__found.{c}") for c in new]))
