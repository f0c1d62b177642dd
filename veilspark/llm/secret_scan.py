"""Secret scan with a trigram index.

Method: each rule's pattern is turned into a Boolean query over trigrams of
A-Z lower-cased bytes that every match must contain. Each block of texts gets an
inverted index (trigram -> texts) for the trigrams that some rule asks for; the
postings are intersected and united as the queries say, and only the texts that
remain are searched with the pattern. A rule without a mandatory trigram
searches every text. The index of a block lives beside its texts, so neither
texts nor postings move between machines.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilspark.llm import text as T
from veilspark.llm.tables import small_batches

try:                                    # the public name since Python 3.11 is re._parser
    from re import _constants as _c
    from re import _parser
except ImportError:                     # pragma: no cover
    import sre_constants as _c
    import sre_parse as _parser


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    min_length: int = 0                 # of the group below; shorter matches are dropped but still consume their text
    group: int = 0
    either_case: bool = False
    compiled: re.Pattern = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        flags = re.ASCII | (re.IGNORECASE if self.either_case else 0)
        object.__setattr__(self, "compiled", re.compile(self.pattern, flags))

    def spans(self, value: str) -> list[tuple[int, int]]:
        return [m.span() for m in self.compiled.finditer(value) if len(m[self.group]) >= self.min_length]


# The three base kinds, then public formats of well-known credentials.
BASE = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 6, 2, True),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]+", 24),
)
EXTRA = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)

# A query is None (no condition), a trigram (bytes), or ("and" | "or", parts).


def _grams(run: bytes):
    parts = tuple(dict.fromkeys(run[i:i + 3] for i in range(len(run) - 2)))
    return None if not parts else parts[0] if len(parts) == 1 else ("and", parts)


def _both(parts):
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(dict.fromkeys(parts)))


def _either(parts):
    parts = list(dict.fromkeys(parts))
    return None if not parts or None in parts else parts[0] if len(parts) == 1 else ("or", tuple(parts))


def _exact(items, limit: int = 64) -> list[bytes] | None:
    """All lower-cased strings that a short stretch of a pattern matches, or None if it is open or has many."""
    found = [b""]
    for op, value in items:
        if op is _c.LITERAL:
            more = [chr(value).encode().lower() if value < 128 else chr(value).encode()]
        elif op is _c.SUBPATTERN:
            more = _exact(value[-1], limit)
        elif op is _c.BRANCH:
            each = [_exact(branch, limit) for branch in value[1]]
            more = None if None in each else [x for e in each for x in e]
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and value[1] <= 2:
            once = _exact(value[2], limit)
            more = None if once is None else [x * n for n in range(value[0], value[1] + 1) for x in once]
        else:
            more = None
        if more is None or len(found) * len(more) > limit:
            return None
        found = [a + b for a in found for b in dict.fromkeys(more)]
    return list(dict.fromkeys(found))


def _query(items):
    """The condition on trigrams for a sequence of pattern items."""
    parts, stretch = [], []

    def close():
        if stretch:
            parts.append(_either([_grams(s) for s in _exact(stretch)]))
            stretch.clear()

    for item in items:
        if _exact([*stretch, item]) is not None:
            stretch.append(item)
            continue
        close()
        if _exact([item]) is not None:
            stretch.append(item)
            continue
        op, value = item
        if op is _c.SUBPATTERN:
            parts.append(_query(value[-1]))
        elif op is _c.BRANCH:
            parts.append(_either([_query(branch) for branch in value[1]]))
        elif op in (_c.MAX_REPEAT, _c.MIN_REPEAT) and value[0] > 0:
            parts.append(_query(value[2]))
    close()
    return _both(parts)


def trigram_query(pattern: str, either_case: bool = False):
    """The Boolean query of a pattern; None if it has no mandatory trigram."""
    return _query(list(_parser.parse(pattern, re.ASCII | (re.IGNORECASE if either_case else 0))))


def trigrams_of(query) -> set[bytes]:
    if query is None:
        return set()
    return {query} if isinstance(query, bytes) else set().union(*map(trigrams_of, query[1]))


class Index:
    """Postings of one block of texts for the trigrams asked for."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, wanted: np.ndarray, names: list[bytes]):
        self.n = len(offsets) - 1
        low = T._lower[raw].astype(np.uint32)
        self.postings = {g: np.zeros(0, np.int64) for g in names}
        if len(low) < 3 or not names:
            return
        code = (low[:-2] << 16) | (low[1:-1] << 8) | low[2:]
        hit = np.flatnonzero(wanted[code])
        which, doc = wanted[code[hit]] - 1, np.searchsorted(offsets, hit, side="right") - 1
        inside = hit + 3 <= offsets[doc + 1]
        pair = np.unique(which[inside].astype(np.int64) * self.n + doc[inside])
        cuts = np.searchsorted(pair, np.arange(len(names) + 1) * self.n)
        for i, name in enumerate(names):
            self.postings[name] = pair[cuts[i]:cuts[i + 1]] - i * self.n

    def find(self, query) -> np.ndarray:
        if query is None:
            return np.arange(self.n)
        if isinstance(query, bytes):
            return self.postings[query]
        kind, parts = query
        found = [self.find(p) for p in parts]
        out = found[0]
        for other in found[1:]:
            out = np.intersect1d(out, other, assume_unique=True) if kind == "and" else np.union1d(out, other)
        return out


def _names(rules: tuple[Rule, ...]) -> tuple[list, list[bytes], np.ndarray]:
    queries = [trigram_query(r.pattern, r.either_case) for r in rules]
    names = sorted(set().union(*map(trigrams_of, queries)))
    wanted = np.zeros(1 << 24, dtype=np.uint8 if len(names) < 256 else np.uint16)
    for i, name in enumerate(names):
        wanted[int.from_bytes(name, "big")] = i + 1
    return queries, names, wanted


def _scan(rules: tuple[Rule, ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, names, wanted = _names(rules)
        for batch in batches:
            column = batch.column(1)
            found: list[list[tuple[int, int, int]]] = [[] for _ in range(len(column))]
            for first, last, raw, at in T.chunks(column):
                index = Index(raw, at, wanted, names)
                data, texts = raw.tobytes(), {}
                for number, (rule, query) in enumerate(zip(rules, queries, strict=True)):
                    for doc in index.find(query).tolist():
                        value = texts.get(doc)
                        if value is None:
                            value = texts[doc] = data[at[doc]:at[doc + 1]].decode("utf-8", "replace")
                        found[first + doc] += [(a, number, b) for a, b in rule.spans(value)]
            for spans in found:
                spans.sort()
            kinds = [[rules[k].kind for _, k, _ in spans] for spans in found]
            flat = {"kind": [k for row in kinds for k in row], "start": [a for row in found for a, _, _ in row],
                    "end": [b for row in found for _, _, b in row]}
            each = pa.StructArray.from_arrays([pa.array(flat["kind"], pa.string()), pa.array(flat["start"], pa.int32()),
                                               pa.array(flat["end"], pa.int32())], names=["kind", "start", "end"])
            lists = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum([len(s) for s in found])]).astype(np.int32), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], names=["id", "found"])
    return run


def scan(docs: DataFrame, rules: tuple[Rule, ...] = BASE + EXTRA, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, found): one row per document with its spans as array<struct<kind, start, end>>.

    Offsets are code points, the end exclusive; matches of one rule do not
    overlap, and spans are in order of start, then of the rules. Null texts are
    empty and have no spans. Repeated rows are scanned each for itself; other columns are not read.
    Of matches of several rules at one place all are given. Texts may be of any length; an empty table gives an empty result.
    """
    small_batches(docs)
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(_scan(tuple(rules)), "id long, found array<struct<kind: string, start: int, end: int>>")
    return found.select(F.col("id").alias(id_col), "found")


def joined(spans) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def digest(found: DataFrame) -> DataFrame:
    """Counts and hashes of the base kinds beside all spans, for the registered query."""
    kinds = [r.kind for r in BASE]
    base = F.filter("found", lambda s: s["kind"].isin(kinds))

    def count(kind: str) -> Column:
        return F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, kinds), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("found")).alias("spans"))


def spans_by_full_scan(value: str | None, rules: tuple[Rule, ...] = BASE) -> str:
    """What an unindexed search of one text gives; for tests."""
    found = sorted((a, k, b) for k, r in enumerate(rules) for a, b in r.spans(value or ""))
    return ",".join(f"{rules[k].kind}:{a}:{b}" for a, k, b in found)


def sha256(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()
