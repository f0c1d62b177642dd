import math

import numpy as np
import pytest

from veilspark.llm import whitening
from veilspark.llm.queries import op13_whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def brute(rows, most=32):
    """{component: ...} by plain numpy; rows: (id, vector) of one length, all finite."""
    x = np.array([[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in rows], dtype=object)
    n, s = len(x), x.sum(0)
    y = n * x - s
    centred = (y / n).astype(float)
    cov = centred.T @ centred / n
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1][:most], vectors[:, ::-1][:, :most]
    return n, (y * y).sum(1), centred @ vectors / np.sqrt(values), values / np.trace(cov)


def compare(found, rows, most=32):
    n, deviation, whitened, explained = brute(rows, most)
    by = {(r["vec_id"], r["component"]): r for r in found}
    assert len(by) == len(found) == n * whitened.shape[1]
    for j in range(whitened.shape[1]):
        got = np.array([by[i, j + 1]["whitened"] for i, _ in rows])
        sign = np.sign(got @ whitened[:, j])
        assert np.allclose(got * sign, whitened[:, j], atol=1e-7)
        assert [by[i, j + 1]["deviation"] for i, _ in rows] == list(deviation)
        assert all(math.isclose(by[i, j + 1]["explained"], explained[j], rel_tol=1e-9) and by[i, j + 1]["n"] == n for i, _ in rows)
    assert {r["identity_error"] for r in found} == {found[0]["identity_error"]} and 0 <= found[0]["identity_error"] < 1e-9


def vectors(n, d, seed=1):
    rng = np.random.default_rng(seed)
    mixing = rng.normal(size=(d, d)) * np.geomspace(1, 0.1, d)
    return [(i, [float(c) for c in v]) for i, v in enumerate((rng.normal(size=(n, d)) @ mixing).astype(np.float32))]


def test_small_table_is_brute_force(frame):
    rows = vectors(300, 12)
    compare(whitening.whiten(frame([(i, v, 1) for i, v in rows], SCHEMA)).collect(), rows)


def test_many_blocks_in_both_directions(frame, monkeypatch):
    monkeypatch.setattr(whitening, "ROWS", 16)
    monkeypatch.setattr(whitening, "COLUMNS", 5)
    monkeypatch.setattr(whitening, "BLOCKS_PER_TASK", 2)
    rows = vectors(203, 13)
    compare(whitening.whiten(frame([(i, v, 1) for i, v in rows], SCHEMA).repartition(5), components=6).collect(), rows, 6)


def test_rows_without_a_whole_vector_go(frame):
    rows = vectors(60, 4)
    bad = [(900, None), (901, []), (902, [1.0, None, 2.0, 3.0]), (903, [float("nan")] * 4), (904, [float("inf"), 0.0, 0.0, 0.0]),
           (905, [1.0, 2.0]), (906, [1e30, 0.0, 0.0, 0.0])]
    compare(whitening.whiten(frame([(i, v, 1) for i, v in rows + bad], SCHEMA)).collect(), rows)


def test_ids_need_not_be_unique_and_names_may_clash(frame):
    rows = [(None if i < 3 else i // 2, v, float(i)) for i, v in vectors(50, 3)]
    found = whitening.whiten(frame([(i, v, x, 1, "c") for i, v, x in rows],
                                   "vec_id long, embedding array<float>, whitened double, n long, row string")).collect()
    assert len(found) == 150 and sum(r["vec_id"] is None for r in found) == 9 and {r["n"] for r in found} == {50}


@pytest.mark.parametrize("rows", [[], [(1, None, 1)], [(1, [1.0, 2.0], 1)], [(i, [1.0, 2.0], 1) for i in range(20)]])
def test_nothing_to_whiten(frame, rows):
    found = whitening.whiten(frame(rows, SCHEMA))
    assert found.collect() == [] and found.columns[:3] == ["vec_id", "component", "n"]


def test_directions_without_variance_are_left_out(frame):
    rows = [(i, [v[0], v[0], v[1]], 1) for i, v in vectors(80, 2)]
    assert {r["component"] for r in whitening.whiten(frame(rows, SCHEMA)).collect()} == {1, 2}


def test_very_large_entries_stay_exact(frame):
    rows = [(i, [float(np.float32(2.0**48 * (i - 20))), float(i * i)]) for i in range(40)]
    found = whitening.whiten(frame([(i, v, 1) for i, v in rows], SCHEMA)).collect()
    _, deviation, _, _ = brute(rows)
    assert max(deviation) > 2**63
    assert {r["vec_id"]: r["deviation"] for r in found} == {i: (d if d < 2**63 else None) for (i, _), d in zip(rows, deviation)}


def test_query_is_brute_force_over_all_embeddings(spark, sf, duck):
    rows = duck.execute("SELECT vec_id, embedding FROM embeddings WHERE embedding IS NOT NULL ORDER BY vec_id").fetchall()
    compare(op13_whitening(spark, sf).collect(), rows)
