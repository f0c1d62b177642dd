from collections import Counter

import numpy as np
import pytest

from veilspark.llm import vector_dedup as V
from veilspark.llm.queries import QUERIES


def brute(rows, threshold=0.98):
    """{id: (links, component)} of (id, vector, label) with distinct ids."""
    good = {}
    for i, v, label in rows:
        if v is None or label is None or any(x is None for x in v):
            continue
        x = np.array(v, dtype=np.float64)
        if len(x) and np.isfinite(x).all() and x.any():
            good[i] = (x / np.linalg.norm(x), label)
    out, parent, ids = Counter(), {r[0]: r[0] for r in rows}, sorted(good)

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for n, a in enumerate(ids):
        for b in ids[n + 1:]:
            if good[a][1] == good[b][1] and len(good[a][0]) == len(good[b][0]) and good[a][0] @ good[b][0] >= threshold:
                out[a] += 1
                out[b] += 1
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {r[0]: (out[r[0]], find(r[0])) for r in rows}


def test_query_recall(spark, sf, duck):
    rows = duck.execute("SELECT vec_id, embedding, label FROM embeddings").fetchall()
    want = brute(rows)
    got = QUERIES["op9_vector_dedup"](spark, sf).collect()
    assert len(got) == len(rows)
    assert all(r["n_links"] <= want[r["vec_id"]][0] for r in got)
    assert sum(r["n_links"] for r in got) >= 0.9 * sum(n for n, _ in want.values())
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in got)


def test_large_groups_and_edges(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=24)
    rows = [(i, [float(x) for x in base + 0.06 * rng.normal(size=24)], 1) for i in range(700)]         # more than a block
    rows += [(1000 + i, [float(x) for x in rng.normal(size=24)], 1 + i % 2) for i in range(300)]
    rows += [(2000 + i, rows[3][1], 1) for i in range(40)] + [(2100 + i, rows[3][1], 2) for i in range(3)]
    nan, inf = float("nan"), float("inf")
    odd = [None, [], [0.0] * 24, [nan] + [1.0] * 23, [inf] + [1.0] * 23, [None] + [1.0] * 23, [1e-200] * 24]
    rows += [(3000 + i, v, 1) for i, v in enumerate(odd)] + [(3100, rows[3][1], None), (3101, rows[3][1][:12], 1), (3102, rows[4][1][:12], 1)]
    made = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<double>, label int, list string")
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in V.near_vectors(made).collect()}
    rows = [r for r in rows if r[0] != 3006]           # the square of 1e-200 is zero in doubles, so its length is too
    assert {i: got[i] for i, _, _ in rows} == brute(rows) and got[3006] == (0, 3006)


def test_repeated_rows_no_rows_and_arguments(spark):
    schema = "vec_id long, embedding array<float>, label int"
    made = spark.createDataFrame([(2, [1.0, 0.0], 1), (2, [1.0, 0.0], 1), (1, [1.0, 0.001], 1), (None, [1.0, 0.0], 1), (5, [0.0, 1.0], 1)], schema)
    got = sorted((str(r["vec_id"]), r["n_links"], r["component_id"], r["kept"]) for r in V.near_vectors(made).collect())
    assert got == [("1", 1, 1, True), ("2", 1, 1, False), ("2", 1, 1, False), ("5", 0, 5, True), ("None", 0, None, True)]
    assert V.near_vectors(made.limit(0)).count() == 0
    with pytest.raises(ValueError):
        V.near_vectors(made, shared=9)
