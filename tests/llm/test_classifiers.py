import zlib

import numpy as np
import pyarrow as pa
import pytest

from veilspark.llm import language_id as L
from veilspark.llm import text as T
from veilspark.llm import toxicity as X
from veilspark.llm.queries import QUERIES


def test_language_query_held_out(spark, sf, duck):
    truth = dict(duck.execute("SELECT doc_id, lang FROM documents").fetchall())
    rows = QUERIES["op8_language_id"](spark, sf).collect()
    assert len(rows) == len(truth)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["lang_pred"] == truth[r["doc_id"]] for r in held]) > 0.97
    assert all(0 <= r["score"] <= 1 for r in rows)


def test_toxicity_query_held_out(spark, duck):
    sf = "/root/testdata/sf0.01"
    truth = dict(duck.execute(f"SELECT doc_id, toxic FROM '{sf}/labels.parquet'").fetchall())
    rows = QUERIES["op7_toxicity"](spark, sf).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) for r in rows)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows)
    labelled = [(truth[r["doc_id"]], r["predicted"]) for r in rows if r["doc_id"] in truth]
    assert np.mean([a == b for a, b in labelled]) > 0.9
    held = [(truth[r["doc_id"]], r["score"]) for r in rows if r["held_out"] and r["doc_id"] in truth]
    toxic, clean = [s for y, s in held if y], [s for y, s in held if not y]
    assert np.mean([a > b for a in toxic for b in clean]) > 0.9


def test_codewords_are_far_apart():
    for n in (2, 3, 4, 5, 9, 30):
        code = L.codewords(n)
        apart = [(code[i] != code[j]).sum() for i in range(n) for j in range(i)]
        assert min(apart) >= (1 if n < 4 else 3)
        assert all(abs(code[:, b].sum()) < n for b in range(code.shape[1]))       # every bit splits the languages


def test_language_edges(frame):
    en, fr = "the cat and the dog were in the house with other animals ", "le chat et le chien sont dans la maison avec des amis "
    train = [(i, (en if i % 2 else fr) * (1 + i % 3), "en" if i % 2 else "fr") for i in range(40)] + [(90, None, "en"), (91, en, None)]
    schema = "doc_id long, text string, lang string"
    docs = [(1, en, "x"), (2, fr, "x"), (3, None, "x"), (4, "", "x"), (5, "123 !! \n", "x"), (6, "日本", "x"), (7, en * 4000, "x"), (1, en, "x"),
            (None, fr, None)]
    got = L.identify(frame(docs, "doc_id long, text string, score string"), frame(train, schema)).collect()
    found = {r["doc_id"]: r["lang_pred"] for r in got}
    assert len(got) == len(docs)
    assert (found[1], found[2], found[7], found[None]) == ("en", "fr", "en", "fr")
    assert {found[k] for k in (3, 4, 5)} == {"und"} and found[6] in ("en", "fr")
    assert all(r["score"] == 0 and not r["ambiguous"] for r in got if r["lang_pred"] == "und")
    assert {r["lang_pred"] for r in L.identify(frame(docs, "doc_id long, text string, x string"), frame([], schema)).collect()} == {"und"}
    one = L.identify(frame(docs, "doc_id long, text string, x string"), frame([(1, en, "en")], schema)).collect()
    assert {r["lang_pred"] for r in one} == {"en", "und"}
    assert L.identify(frame([]), frame(train, schema)).count() == 0


def test_toxicity_edges(frame):
    rng = np.random.default_rng(0)
    plain = lambda: " ".join(f"w{k}" for k in rng.integers(0, 60, 40))      # noqa: E731
    train = [(i, plain() + (" badword here" if i % 2 else " fine here"), "en" if i % 3 else None, i % 2) for i in range(200)]
    schema = "doc_id long, text string, lang string, toxic int"
    docs = [(1, plain() + " badword here"), (2, plain()), (3, None), (4, ""), (5, "... "), (6, (plain() + " ") * 3000 + "badword"), (1, "badword here")]
    def score(rows, trained, more=""):
        made = frame(trained, schema)
        return X.score_documents(frame(rows, "doc_id long, text string" + more), made.drop("toxic"), made.select("doc_id", "toxic"))

    got = score([(*d, 1.0) for d in docs], train, ", score double").collect()
    assert len(got) == len(docs)
    assert [r["predicted"] for r in got] == [1, 0, 0, 0, 0, 1, 1]
    none = score(docs, []).collect()
    assert {(r["score"], r["predicted"]) for r in none} == {(0.0, 0)}
    same = score(docs, [(1, "a b c", "en", 0), (2, None, None, 0), (3, "x", "en", None)]).collect()
    assert {r["predicted"] for r in same} == {0}
    assert score([], train).count() == 0


def test_toxicity_learns_from_all_labelled_rows(frame, monkeypatch):
    """A word that few of many rows hold counts, in several parts as in one."""
    rng = np.random.default_rng(1)
    plain = lambda: " ".join(f"w{k}" for k in rng.integers(0, 60, 12))      # noqa: E731
    train = [(i, plain() + (f" bad{i % 40}" if i % 4 == 0 else ""), "en", int(i % 4 == 0)) for i in range(1200)]
    made = frame(train, "doc_id long, text string, lang string, toxic int")
    model = X.fit(made.drop("toxic"), made.select("doc_id", "toxic"), part_rows=300)
    held = frame([], "doc_id long, text string").sparkSession.createDataFrame([(str(r[0]),) for r in train], "id string")
    held = held.selectExpr("int(id) AS i", "pmod(xxhash64(id, 5), 5) = 4 AS held").collect()
    trained = [train[r["i"]][1] for r in held if not r["held"]]
    words = next(T.words(pa.array([f"bad{k}" for k in range(0, 40, 4)])))
    slots = X.slots(words)[:, 0]
    assert all(sum(f" bad{k}" in text + " " for text in trained) >= 3 for k in range(0, 40, 4)) and (model.table[slots, 0] > 0).all()
    scored = X.score_documents(frame([(k, f"w1 w2 bad{4 * k} w3") for k in range(10)] + [(99, "w1 w2 w3")], "doc_id long, text string"),
                               made.drop("toxic"), made.select("doc_id", "toxic"), part_rows=300).collect()
    assert [r["predicted"] for r in scored] == [1] * 10 + [0]
    again = X.fit(made.drop("toxic").repartition(3), made.select("doc_id", "toxic"), part_rows=300)
    assert (again.table == model.table).all() and (again.shift == model.shift).all()


@pytest.mark.parametrize("texts", [["Hello, wörld x1", None, "", "a-b_c"], ["z" * 10, "z" * 10], []])
def test_words_of_a_column(texts):
    import re
    word, found = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), []
    for w in T.words(pa.array(texts, pa.string())):
        found += [[w.word(i) for i in range(a, b)] for a, b in zip(w.bounds[:-1], w.bounds[1:], strict=True)]
    assert found == [word.findall((t or "").lower()) for t in texts]
