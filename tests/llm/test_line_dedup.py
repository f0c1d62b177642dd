from veilspark.llm import line_dedup
from veilspark.llm.queries import QUERIES


def brute(docs, min_words):
    """Deletes every line of every run of min_words words that stands earlier in (id, line) order."""
    first, runs = {}, []
    for i, text in sorted(docs):
        lines = text.split("\n")
        for a in range(len(lines)):
            for b in range(a, len(lines)):
                if sum(len(x.split()) for x in lines[a:b + 1]) >= min_words:
                    key = tuple(lines[a:b + 1])
                    first.setdefault(key, (i, a))
                    runs.append((key, i, a, b))
                    if b - a > 12:
                        break
    gone = {(i, k) for key, i, a, b in runs if first[key] != (i, a) for k in range(a, b + 1)}
    return {i: "\n".join(x for k, x in enumerate(text.split("\n")) if (i, k) not in gone) for i, text in docs}


def words(n, tag):
    return " ".join(f"{tag}{k}" for k in range(n))


def test_query_is_brute_force_over_all_documents(spark, sf, docs):
    rows = {r["doc_id"]: r["text"] for r in QUERIES["op3_line_dedup"](spark, sf).collect()}
    want = brute([d for d in docs if d[1] is not None], line_dedup.MIN_WORDS)
    assert rows == want
    assert any(rows[i] != t for i, t in docs)


def test_runs_reach_both_ends_and_first_stays(frame):
    run = "\n".join([words(4, "a"), words(60, "b"), words(3, "c")])
    rows = [(1, f"one\n{run}\nend"), (2, f"two\n{run}\nlast"), (3, words(49, "x")), (4, words(49, "x")),
            (5, f"{words(50, 'q')}\n{words(50, 'q')}"), (6, None), (7, ""), (8, words(4, "a"))]
    got = {r["doc_id"]: (r["text"], r["n_deleted_lines"]) for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert got[1] == (rows[0][1], 0) and got[2] == ("two\nlast", 3)
    assert got[3][1] == got[4][1] == 0                                # too short to be a passage
    assert got[5] == (words(50, "q"), 1)
    assert got[6] == (None, 0) and got[7] == ("", 0) and got[8] == (words(4, "a"), 0)


def test_a_hub_with_other_neighbours_hides_no_link(frame):
    short, tail = words(30, "s"), words(30, "t")
    rows = [(1, f"{short}\nother"), (2, f"{short}\n{tail}"), (3, f"{short}\n{tail}")]
    got = {r["doc_id"]: r["text"] for r in line_dedup.dedup_lines(frame(rows)).collect()}
    assert got == {1: rows[0][1], 2: rows[1][1], 3: ""}


def test_repeated_rows_extra_and_clashing_columns_and_no_rows(frame):
    text = words(80, "r")
    rows = [(1, text, 5, "v", "w"), (1, text, 5, "v", "w"), (2, text, 6, "v", "w"), (None, text, 7, "v", "w")]
    made = frame(rows, "doc_id long, text string, n_deleted_lines int, version string, id string")
    got = line_dedup.dedup_lines(made)
    assert got.columns == ["doc_id", "text", "version", "id", "n_deleted_lines"]
    assert sorted((str(r["doc_id"]), r["text"]) for r in got.collect()) == [("1", text), ("1", text), ("2", ""), ("None", text)]
    assert line_dedup.dedup_lines(made.limit(0)).count() == 0


def test_very_long_text(frame):
    text = "\n".join(words(20, f"l{k}_") for k in range(5000))
    got = {r["doc_id"]: r["n_deleted_lines"] for r in line_dedup.dedup_lines(frame([(1, text), (2, text)])).collect()}
    assert got == {1: 0, 2: 5000}
