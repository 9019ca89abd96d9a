import numpy as np
import pytest

from tarn.llm import ann


def brute(ids, x, queries, k=20):
    out = {}
    for i in queries:
        own = ids != i
        score = (x[own] * x[ids == i][0]).sum(axis=1)
        order = np.lexsort((ids[own], -score))[:k]
        out[i] = list(zip(ids[own][order].tolist(), score[order].tolist(), strict=True))
    return out


def recall_of(spark, path):
    rows = spark.read.parquet(f"{path}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, ids[ids % 20 == 0].tolist())
    got = {}
    for r in ann.op5_multiprobe(spark, path).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    assert set(got) == set(want)
    hits = total = 0
    for i, true in want.items():
        mine = sorted(got[i])
        assert [m[0] for m in mine] == list(range(1, len(true) + 1))
        assert [(-m[2], m[1]) for m in mine] == sorted((-m[2], m[1]) for m in mine)
        exact = dict(zip(ids.tolist(), (x * x[ids == i][0]).sum(axis=1).tolist(), strict=True))
        assert all(np.isclose(m[2], exact[m[1]], rtol=1e-12) for m in mine)
        hits += len({m[1] for m in mine} & {t[0] for t in true})
        total += len(true)
    return hits / total


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_recall_of_the_query(spark, sf):
    assert recall_of(spark, f"/root/testdata/{sf}") >= 0.9


def test_recall_beyond_the_sample_with_salted_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "SAMPLE", 512)
    monkeypatch.setattr(ann, "CELL_ROWS", 5)
    assert recall_of(spark, "/root/testdata/sf0.1") >= 0.9


def test_perturbations_are_sets_of_projections_in_order_of_cost():
    sets = ann.perturbations(4, 1000)
    assert len(sets) == 3**4 == len({tuple(s) for s in sets.tolist()}) and not sets[0].any()
    assert (sets + sets[:, ::-1] <= 1).all()
    m = 4
    cost = [j * (j + 1) / (4 * (m + 1) * (m + 2)) if j <= m else 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2)) for j in range(1, 2 * m + 1)]
    total = sets @ np.array(cost)
    assert (np.diff(total) >= -1e-12).all()


def test_a_query_visits_its_own_cell_first_and_each_cell_once():
    draw = np.random.default_rng(0)
    h = ann.Hashes.of(8, 2.0, 6, 40)
    q = draw.standard_normal((5, 8))
    visited = h.visit(q)
    own = h.index(q / np.linalg.norm(q, axis=1, keepdims=True) * 2.0)
    assert (visited[:, :, 0] == own).all()
    assert all(len(set(cells)) == 40 for row in visited.tolist() for cells in row)


@pytest.mark.parametrize("length", [4, 64])
def test_few_candidates_all_come_back(spark, length):
    draw = np.random.default_rng(length)
    rows = [(i, draw.standard_normal(length).tolist()) for i in range(12)]
    found = {}
    for r in ann.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    assert found == {i: set(range(12)) - {i} for i in range(12)}


def test_edge_cases_and_ties(spark):
    draw = np.random.default_rng(2)
    rows = [(i, [float(v) for v in draw.standard_normal(4)]) for i in range(1, 60)]
    rows += [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(100, 160)]  # one vector, many times
    bad = [(500, None), (501, []), (502, [0.0] * 4), (503, [1.0, None, 1.0, 1.0]), (504, [float("nan")] * 4), (505, [float("inf")] * 4), (506, [1.0, 2.0]), (None, [1.0] * 4), (100, [1.0, 2.0, 3.0, 4.0])]
    frame = spark.createDataFrame([(*r, 0.0, 1) for r in rows + bad], "vec_id long, embedding array<double>, score double, rank int")
    got = {}
    for r in ann.search(frame, is_query=ann.F.col("vec_id") % 20 == 0).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
    assert set(got) == {20, 40, 100, 120, 140}
    assert [v for _, v in sorted(got[100])] == [i for i in range(100, 122) if i != 100][:20]
    assert ann.search(frame.limit(0)).count() == 0
    assert ann.search(frame.filter("vec_id = 1")).count() == 0
