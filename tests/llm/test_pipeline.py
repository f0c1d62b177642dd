import re
import zlib
from collections import Counter

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as P
from veilspark.session import store

from test_decontamination import brute as contaminated
from test_line_dedup import brute as without_repeats
from test_near_dedup import brute_groups
from test_packing import by_piece, check_layout


def test_every_stage_is_its_plain_version(spark, sf, duck):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    now = {r["doc_id"]: r.asDict() for r in docs.collect()}
    frame = docs
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    for name, stage in P.STAGES[:-1]:
        frame = store(stage(spark, frame, sf))
        assert frame.columns == columns
        texts = [(i, d["text"]) for i, d in now.items()]
        if name == "language ID":
            now = {i: d for i, d in now.items() if d["text"] is not None and re.search(r"[^\W\d_]", d["text"])}
        elif name == "line dedup":
            left = without_repeats(texts, 50)
            now = {i: d | {"text": left[i], "n_chars": d["n_chars"] if left[i] == d["text"] else len(left[i])}
                   for i, d in now.items() if left[i] == d["text"] or left[i].strip()}
        elif name == "near dedup":
            group = brute_groups(texts)
            now = {i: d for i, d in now.items() if group[i] == i}
        else:
            bad = contaminated(texts, items)
            now = {i: d for i, d in now.items() if not bad[i][4]}
        assert {r["doc_id"]: r.asDict() for r in frame.collect()} == now, name
    rows = P.STAGES[-1][1](spark, frame, sf).collect()
    check_layout(rows, 2048)
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = Counter()
    for i, d in now.items():
        ids = [*tokenizer.encode(d["text"], add_special_tokens=False).ids, 0]
        for piece, at in enumerate(range(0, len(ids), 2048)):
            want[i, piece, len(ids[at:at + 2048]), zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids[at:at + 2048]))] += 1
    assert Counter((r["doc_id"], r["piece"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert len({r["sequence_id"] for r in rows}) == len(by_piece([k[2] for k in want.elements()], 2048))


def test_stages_on_odd_rows(spark, sf):
    schema = "doc_id long, text string, lang string, source string, n_chars long, row string, id long"
    text = " ".join(f"word{k}" for k in range(70))
    rows = [(1, text, "en", "s", len(text), "r", 9), (2, text, None, None, None, None, None), (3, None, None, "s", None, "r", 1), (4, "", "en", "s", 0, "r", 2),
            (5, "12 !", "en", "s", 4, "r", 3), (1, text, "en", "s", len(text), "r", 9), (None, "no id", "en", "s", 5, "r", 4)]
    docs = spark.createDataFrame(rows, schema)
    for _, stage in P.STAGES[:-1]:
        docs = store(stage(spark, docs, sf))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "row", "id"]
    assert sorted(str(r["doc_id"]) for r in docs.collect()) == ["1", "1", "None"]
    empty = docs.limit(0)
    for _, stage in P.STAGES:
        assert stage(spark, empty, sf).count() == 0


def test_run_is_registered(spark, sf):
    import __spark_entry__ as entry
    assert entry.queries()["pipeline"] is P.run and len(P.STAGES) == 5
    assert P.run(spark, sf).count() > 0
