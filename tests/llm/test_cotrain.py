import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.llm import cotrain

SCHEMA = "doc_id long, text string, source string, lang string, score double, _terms string"
WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def made(i):
    """Every third document is bad; bad ones come from their own source four times in five."""
    bad = i % 3 == 0
    words = [WORDS[(i * 7 + k * (1 + i % 5)) % len(WORDS)] for k in range(40)]
    if bad:
        words[i % 40] = "awful"
    return (i, " ".join(words), "s1" if bad and i % 5 else "s2", "en", 0.5, "x"), (i, 0.0 if bad else 1.0)


@pytest.fixture(scope="module")
def corpus():
    rows, labels = zip(*(made(i) for i in range(900)), strict=True)
    return list(rows), list(labels)


@pytest.fixture(scope="module")
def model(spark, corpus):
    rows, labels = corpus
    return cotrain.train(spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:600], "doc_id long, label double"), handed=60)


def test_both_views_learn(spark, corpus, model):
    rows, labels = corpus
    out = model.score(spark.createDataFrame(rows[600:], SCHEMA)).collect()
    truth = dict(labels)
    right = lambda c: sum((r[c] >= 0.5) == (truth[r.doc_id] == 1) for r in out) / len(out)
    assert right("text_score") > 0.97 and right("meta_score") > 0.85 and right("score") > 0.97
    assert all(0 <= r[c] <= 1 for r in out for c in ("text_score", "meta_score", "score"))


def test_rows_handed_over_are_the_surest():
    """One round on a small pool, by going through all rows."""
    rng = np.random.default_rng(2)
    for n_good, n_bad in ((5, 3), (2, 0), (40, 20)):
        t, m, free = rng.normal(size=30).round(1), rng.normal(size=30).round(1), rng.random(30) < 0.8
        got = cotrain.surest(t, m, np.arange(30), free, n_good, n_bad)
        share = n_bad / (n_good + n_bad)
        cut = lambda x: sorted(x)[int(share * 29)] + (share * 29 % 1) * (sorted(x)[min(29, int(share * 29) + 1)] - sorted(x)[int(share * 29)])  # noqa: B023, E731
        good = sorted((i for i in range(30) if free[i] and t[i] >= cut(t) and m[i] >= cut(m)), key=lambda i: (-t[i], i))[:n_good]  # noqa: B023
        bad = sorted((i for i in range(30) if free[i] and t[i] < cut(t) and m[i] < cut(m)), key=lambda i: (t[i], i))[:n_bad]  # noqa: B023
        assert (got[0].tolist(), got[1].tolist()) == (good, bad)
    assert [len(x) for x in cotrain.surest(np.empty(0), np.empty(0), np.arange(0), np.empty(0, bool), 3, 1)] == [0, 0]


def test_one_round_by_hand(spark, corpus, model):
    """What one round hands over, from the models of no round, by brute force; and every round hands over rows of both classes."""
    assert len(model.handed) == cotrain.ROUNDS and all(min(moved) > 0 for moved in model.handed)
    rows, labels = corpus
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:600], "doc_id long, label double")
    before, after = (cotrain.train(docs, known, rounds=k, handed=50) for k in (0, 1))
    assert before.handed == ()
    pool = sorted(before.score(docs.where("doc_id >= 600")).collect(), key=lambda r: r.doc_id)
    margin = lambda score, line: (np.log(score / (1 - score)) - line[0]) / line[1]
    t, m = (margin(np.array([r[c] for r in pool]), line).round(6) for c, line in (("text_score", before.text_line), ("meta_score", before.meta_line)))
    want = [{pool[i].doc_id for i in x} for a, b in ((t, m), (m, t)) for x in cotrain.surest(a, b, np.arange(len(pool)), np.ones(len(pool), bool), 33, 17)]
    # The very rows; where rounded scores tie at the edge, others of the same score.
    for name, got, of in zip("ttmm", after.handed_ids[0], want, strict=True):
        value = {r.doc_id: x for r, x in zip(pool, {"t": t, "m": m}[name], strict=True)}
        odd = [value[i] for i in set(got) ^ of]
        assert len(got) == len(of) and (not odd or max(odd) - min(odd) < 1e-4)


def test_rows_that_repeat_an_id_are_fitted_to_once(spark, corpus):
    """However many rows one labelled and one other document have, the fit is bounded and the same."""
    rows, labels = corpus
    docs, known = spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels[:600], "doc_id long, label double")
    again = docs.where("doc_id IN (3, 700)").join(spark.range(15000)).select(*docs.columns)
    one, many = (cotrain.train(d, known, fit_rows=200, pool_rows=200, handed=20) for d in (docs, docs.unionByName(again)))
    assert one.fit_rows == many.fit_rows <= 400 and one.handed_ids == many.handed_ids
    a, b = ([[r[c] for c in ("doc_id", "text_score", "meta_score", "score")] for r in m.score(docs).orderBy("doc_id").collect()] for m in (one, many))
    assert np.abs(np.array(a) - np.array(b)).max() < 1e-6


def test_edges_are_scored(spark, model):
    rows = [(1, None, None, None, None, None), (2, "", "s2", "en", 0.1, "x"), (None, "alpha beta", "s2", "xx", 0.1, "x"), (4, "alpha " * 50000, "new", "en", 0.1, "x"), (5, "beta", "s2", "en", 1.0, "x"), (5, "beta", "s2", "en", 1.0, "x")]
    out = model.score(spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "source", "lang", "_terms", "text_score", "meta_score", "score"]
    assert out.where("score IS NULL OR isnan(score)").count() == 0 and out.count() == len(rows)
    assert out.where("doc_id = 5").select("score").distinct().count() == 1


@pytest.mark.parametrize("labels", [[], [(1, 1.0), (2, 1.0)], [(None, 1.0), (3, None)]])
def test_nothing_to_learn_keeps_all(spark, corpus, labels):
    out = cotrain.classify(spark.createDataFrame(corpus[0][:20], SCHEMA), spark.createDataFrame(labels, "doc_id long, label double"))
    assert out.where("kept AND score = 1").count() == 20


def test_empty_table(spark, corpus):
    out = cotrain.classify(spark.createDataFrame([], SCHEMA), spark.createDataFrame(corpus[1][:50], "doc_id long, label double"))
    assert out.count() == 0 and "kept" in out.columns


def test_labels(spark):
    rows = [(1, 1, 0), (2, 1, 1), (3, 0, 0), (4, 1, None), (5, None, 1)]
    got = {r.doc_id: r.label for r in cotrain.clean_labels(spark.createDataFrame(rows, "doc_id long, quality int, toxic int")).collect()}
    assert got == {1: 1.0, 2: 0.0, 3: 0.0, 4: 1.0, 5: None}


def test_held_out_labels(spark):
    """Of labelled documents that it was not fitted to, it keeps clean ones and rejects others."""
    d = "/root/testdata/sf0.1"
    docs, labels = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "labels"))
    docs = docs.join(labels.select("doc_id"), "doc_id", "left_semi").select("doc_id", "text", "source", "lang")
    clean = cotrain.clean_labels(labels)
    known = clean.where("doc_id % 5 <> 0")
    model = cotrain.train(docs, known, pool_rows=2000, handed=100)
    assert len(model.handed) == cotrain.ROUNDS and all(min(moved) >= 20 for moved in model.handed)
    out = model.score(docs).withColumn("kept", F.col("score") >= cotrain.KEEP_AT).join(clean.where("doc_id % 5 = 0"), "doc_id")
    share = {r.label: r.kept for r in out.groupBy("label").agg(F.avg(F.col("kept").cast("int")).alias("kept")).collect()}
    assert share[1.0] > 0.97 and share[0.0] < 0.06


def test_logistic_line_is_the_minimum():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 2))
    y = (rng.random(500) < 1 / (1 + np.exp(-(0.5 + 2 * x[:, 0] - x[:, 1])))).astype(float)
    a, b, c = cotrain.logistic_line(x, y)
    p = 1 / (1 + np.exp(-(a + b * x[:, 0] + c * x[:, 1])))
    assert abs((y - p).sum()) < 1e-6 and np.abs(x.T @ (y - p) - 0.5 * np.array([b, c])).max() < 1e-6
    assert np.isfinite(cotrain.logistic_line(np.array([-50.0, -40.0, 40.0, 50.0]), np.array([0.0, 0.0, 1.0, 1.0]))).all()
