import random
import zlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from veilspark.llm import packing
from veilspark.llm.queries import QUERIES

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 0]


def by_piece(counts, size):
    """Best-fit decreasing one piece at a time: how many sequences, and what remains in them."""
    free = []
    for n in sorted(Counter(counts).elements(), reverse=True):
        fits = [f for f in free if f >= n]
        if fits:
            free.remove(min(fits))
            free.append(min(fits) - n)
        else:
            free.append(size - n)
    return sorted(free)


def check_layout(rows, size):
    at = defaultdict(list)
    for r in rows:
        at[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in at.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= size
    return at


@pytest.mark.parametrize("seed", range(6))
def test_counts_give_what_packing_by_piece_gives(seed):
    rng = random.Random(seed)
    size = rng.choice([7, 40, 100])
    counts = Counter(rng.randint(1, size) for _ in range(300))
    free = {}
    for length, rank, first, each, offset in packing.best_fit(counts, size):
        later = [m[1] for m in packing.best_fit(counts, size) if m[0] == length and m[1] > rank]
        for k in range((min(later) if later else counts[length]) - rank):
            assert free.get(first + k // each, size) == size - offset - length * (k % each)
            free[first + k // each] = size - offset - length * (k % each + 1)
    assert sorted(free.values()) == by_piece(counts, size)


def test_query_round_trip(spark, sf, docs):
    rows = QUERIES["op5_best_fit_packing"](spark, sf).collect()
    check_layout(rows, packing.LENGTH)
    tokenizer = Tokenizer.from_file(PATH)
    got = {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows}
    want = {}
    for i, text in docs:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), packing.LENGTH)):
            part = ids[at:at + packing.LENGTH]
            want[i, piece] = (at, len(part), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in part)))
    assert got == want and len(rows) == len(want)
    assert len({r["sequence_id"] for r in rows}) == len(by_piece([n for _, n, _ in want.values()], packing.LENGTH))


def test_odd_texts(frame):
    texts = [None, "", " \n\t ", "a" * 30000, "Œuvre é ́x ΑΣ ΣΑΣ. İi x y\x1cz", "x<|endoftext|>y <|startoftext|> it's 12's",
             "&&&don't 3.14 日本語 🎉🎉 ‍﻿"] + ["word " * 9000]
    rows = packing.pack(frame(list(enumerate(texts)) + [(0, None), (None, "x")]), PATH).collect()
    check_layout(rows, packing.LENGTH)
    got = defaultdict(int)
    for r in rows:
        got[r["doc_id"]] += r["length"]
    assert got.pop(0) == 2 and got.pop(None) == len(ids_of("x"))
    assert got == {i: len(ids_of(t)) for i, t in enumerate(texts) if i}
    crc = {r["doc_id"]: r["ids_crc32"] for r in rows if r["length"] < 200 and r["doc_id"] in (4, 5, 6)}
    assert crc == {i: zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids_of(texts[i]))) for i in (4, 5, 6)}


def test_no_rows_and_small_sequences(frame):
    assert packing.pack(frame([]), PATH).count() == 0
    rows = packing.pack(frame([(1, "the cat sat on the mat")], "doc_id long, text string"), PATH, size=3).collect()
    assert [r["length"] for r in sorted(rows, key=lambda r: r["piece"])] == [3, 3, 1]
    with pytest.raises(ValueError):
        packing.pack(frame([]), PATH, size=0)


def test_word_table_is_bounded():
    encoder = packing.Encoder(PATH, cached=50)
    for i in range(20):
        text = " ".join(f"w{i // 2}x{j}" for j in range(40))
        assert encoder.encode([text, text.upper()]) == [b"".join(x.to_bytes(4, "little") for x in ids_of(text)[:-1])] * 2
        assert len(encoder.known) <= 50 + 40 and len(encoder.before) <= 50 + 40
