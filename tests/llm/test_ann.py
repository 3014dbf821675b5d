import numpy as np
import pytest

from papyrion.llm import ann

SCHEMA = "vec_id long, embedding array<float>, rank string, cell int"


def brute(vectors, queries, k):
    """{(query, rank): (vec_id, score)} with ties to the smaller id."""
    ids = np.array(sorted(vectors))
    m = np.array([vectors[i] for i in ids], np.float64)
    out = {}
    for q in queries:
        score = ann.cosine(np.array(vectors[q], np.float64), m)
        order = [i for i in np.lexsort((ids, -score)) if ids[i] != q][:k]
        out |= {(q, r + 1): (int(ids[i]), float(score[i])) for r, i in enumerate(order)}
    return out


def searched(spark, rows, every=50, k=5, **more):
    return {(r.query_id, r.rank): (r.vec_id, r.score) for r in ann.search(spark.createDataFrame(rows, SCHEMA), every, k, **more).collect()}


def recall(got, want):
    return len({(q, v) for (q, _), (v, _) in got.items()} & {(q, v) for (q, _), (v, _) in want.items()}) / len(want)


def test_recall_of_the_query(spark):
    from papyrion.llm.queries import op10_ann

    vectors = {r.vec_id: r.embedding for r in spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").collect()}
    want = brute(vectors, [i for i in vectors if i % 50 == 0], 5)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in op10_ann(spark, "/root/testdata/sf0.1").collect()}
    assert set(got) == set(want) and recall(got, want) >= 0.9
    exact = {(q, v): s for (q, _), (v, s) in got.items()}
    for (q, v), s in exact.items():
        a, b = np.array(vectors[q], np.float64), np.array(vectors[v], np.float64)
        assert s == pytest.approx(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b), abs=1e-12)


@pytest.mark.parametrize("spread, most", [(0.05, 0.2), (10.0, 1.0)])
def test_share_is_measured(spark, spread, most):
    """Clustered vectors need few cells, random ones many; both meet their neighbours."""
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(40, 16))
    vectors = {i: (centres[i % 40] + rng.normal(size=16) * spread).astype(np.float32).tolist() for i in range(4000)}
    rows = ann.search(spark.createDataFrame([(i, v, "x", 1) for i, v in vectors.items()], SCHEMA), 20, 5).collect()
    got = {(r.query_id, r.rank): (r.vec_id, r.score) for r in rows}
    assert recall(got, brute(vectors, range(0, 4000, 20), 5)) >= 0.9
    assert 0 < rows[0].share <= most


def test_walking_all_cells_is_exact(spark):
    rng = np.random.default_rng(3)
    vectors = {int(i): rng.normal(size=9).astype(np.float32).tolist() for i in range(0, 900, 3)}
    for i in range(30, 300, 30):
        vectors[i] = vectors[0]  # ties
    rows = [(i, v, "x", 1) for i, v in vectors.items()]
    assert searched(spark, rows, share=1.0) == brute(vectors, [i for i in vectors if i % 50 == 0], 5)


@pytest.mark.parametrize("part, asking", [(40, 10**6), (10**6, 10**6), (40, 3), (10**6, 4)])
def test_groups_of_a_large_shard_lose_nothing(spark, monkeypatch, part, asking):
    monkeypatch.setattr(ann, "PART", part)
    monkeypatch.setattr(ann, "ASKING", asking)
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(3, 8))
    vectors = {i: (centres[i % 3 and 1] + rng.normal(size=8) * 0.1).astype(np.float32).tolist() for i in range(500)}
    assert searched(spark, [(i, v, "x", 1) for i, v in vectors.items()], share=1.0) == brute(vectors, range(0, 500, 50), 5)


def test_one_vector_many_times(spark):
    rows = [(i, [1.0, 2.0, 3.0, 4.0], "x", 1) for i in range(400)] + [(1000, [4.0, 3.0, 2.0, 1.0], "x", 1)]
    got = searched(spark, rows)
    assert {r: v for (q, r), (v, _) in got.items() if q == 0} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 5}
    assert {r: v for (q, r), (v, _) in got.items() if q == 50} == {1: 0, 2: 1, 3: 2, 4: 3, 5: 4}


def test_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0], None, None), (50, [0.0, 0.0], "x", 1), (100, [nan, 1.0], "x", 1), (150, [inf, 1.0], "x", 1), (200, None, "x", 1), (250, [None, 1.0], "x", 1), (None, [1.0, 0.0], "x", 1),
            (300, [1.0], "x", 1), (1, [1.0, 1.0], "x", 1), (1, [1.0, 1.0], "x", 1), (2, [-1.0, 0.0], "x", 1)]
    got = searched(spark, rows)
    assert {k: v for k, (v, _) in got.items()} == {(0, 1): 1, (0, 2): 2}
    assert got[(0, 1)][1] == pytest.approx(0.5**0.5) and got[(0, 2)][1] == -1.0
    assert searched(spark, []) == {} and searched(spark, [(0, [1.0, 2.0], "", 0)]) == {}
    assert searched(spark, [(0, [1.0, 2.0], "", 0), (50, [1.0, 2.0], "", 0)]) == {(0, 1): (50, pytest.approx(1)), (50, 1): (0, pytest.approx(1))}
