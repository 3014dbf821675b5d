"""Frames kept under their inputs' signature, scope maps, topic runs on disk, and validation tables on hand data."""

import os
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.clustering import KMeans
from pyspark.sql import functions as F

from papyrion.operators import composition, graph, runs, topics, validation
from papyrion.plans import freshness
from papyrion.plans.registry import Panel, Scope
from papyrion.sources.sinks import filter_scopes

D = "/root/testdata/sf0.001"


def test_a_stored_frame_follows_its_files(spark, tmp_path):
    source, built = str(tmp_path / "in"), []
    spark.range(5).coalesce(1).write.parquet(source)
    store = freshness.FrameStore(spark, str(tmp_path / "store"))

    def build():
        built.append(1)
        return spark.read.parquet(source).select((F.col("id") * 2).alias("x"))

    get = lambda: sorted(r.x for r in store.frame("twice", [source], build).collect())
    assert store.status("twice", [source]) == "missing"
    assert get() == get() == [0, 2, 4, 6, 8] and len(built) == 1 and store.status("twice", [source]) == "current"
    part = next(str(p) for p in (tmp_path / "in").glob("part-*.parquet"))
    os.utime(part, (1, 2_000_000_000))
    assert store.status("twice", [source]) == "stale"
    assert get() == [0, 2, 4, 6, 8] and len(built) == 2 and store.status("twice", [source]) == "current"
    spark.range(5, 7).coalesce(1).write.mode("append").parquet(source)
    assert get() == [0, 2, 4, 6, 8, 10, 12] and len(built) == 3


def test_inputs_that_change_while_they_are_read(spark, tmp_path):
    """The frame read before the change is never served; inputs that never rest are an error."""
    source, left = str(tmp_path / "in"), [1]
    spark.range(3).coalesce(1).write.parquet(source)
    store = freshness.FrameStore(spark, str(tmp_path / "store"))

    def build():
        df = spark.read.parquet(source)
        if left:
            left.pop()
            spark.range(3, 4).coalesce(1).write.mode("append").parquet(source)
        return df

    assert store.frame("f", [source], build).count() == 4
    assert len(list((tmp_path / "store/f/states").iterdir())) == 1
    left.extend([1] * 3)
    spark.range(9, 10).coalesce(1).write.mode("append").parquet(source)
    with pytest.raises(RuntimeError):
        store.frame("f", [source], build)


def test_a_build_that_breaks_off_leaves_no_frame(spark, tmp_path):
    source = str(tmp_path / "in")
    spark.range(3).write.parquet(source)
    store = freshness.FrameStore(spark, str(tmp_path / "store"))
    broken = lambda: spark.read.parquet(source).select(F.raise_error(F.lit("no")).cast("long").alias("id"))
    with pytest.raises(Exception, match="no"):
        store.frame("f", [source], broken)
    assert store.status("f", [source]) == "missing" and store.frame("f", [source], lambda: spark.read.parquet(source)).count() == 3


def test_signature_of_files(spark, tmp_path):
    sign = lambda *p: freshness.signature(spark, [str(tmp_path / x) for x in p])
    (tmp_path / "a").write_text("one")
    (tmp_path / "b").write_text("two")
    assert sign("a", "b") == sign("b", "a") == sign("a", "b", "a") != sign("a")
    assert sign("none") == sign("none", "nor this") != sign("a")
    first = sign("a")
    (tmp_path / "a").write_text("ONE!")
    assert sign("a") != first


def test_scopes_are_split_by_current_maps(spark, tmp_path):
    corpus = spark.createDataFrame([(1, "10.1234/A", 1, 1), (2, "https://doi.org/10.1234/b", 1, 0), (3, None, 1, 1), (4, "10.1234/d", 0, 1), (5, "10.1234/a", 1, 1)], "id int, DOI string, s int, t int")
    reference = tmp_path / "corpus.csv"
    reference.write_text("x")
    maps = {}
    for name, text, age in (("one", "label,url\nq,https://doi.org/10.1234/a\nr,10.1234/zz\nr,10.1234/A\n", 0), ("old", "url\n10.1234/a\n", -50)):
        path = tmp_path / f"{name}.csv"
        path.write_text(text)
        os.utime(path, (1, reference.stat().st_mtime + age + 5))
        maps[name] = str(path)
    maps["gone"] = str(tmp_path / "gone.csv")
    scopes = [Scope("one", lambda: F.col("s") == 1), Scope("old", lambda: F.col("t") == 1), Scope("gone", lambda: F.lit(True)), Scope("unmapped", lambda: F.lit(True))]
    got = {r.scope: tuple(r)[1:] for r in filter_scopes(corpus, F.col("DOI"), scopes, maps, str(reference), str(tmp_path / "out")).collect()}
    none = (None,) * 5
    assert got == {"one": ("filtered", 2, 4, 2, 2, 0.5), "old": ("stale", *none), "gone": ("missing", *none), "unmapped": ("missing", *none)}
    rows = spark.read.parquet(str(tmp_path / "out/one"))
    assert {(r.id, r.retained == 'true') for r in rows.collect()} == {(1, True), (5, True), (2, False), (3, False)} and set(rows.columns) == {*corpus.columns, "retained"}
    assert not (tmp_path / "out/old").exists()
    empty = filter_scopes(corpus.limit(0), F.col("DOI"), scopes[:1], maps, str(reference), str(tmp_path / "none")).first()
    assert tuple(empty)[1:] == ("filtered", 2, 0, 0, 0, 0.0)


def test_a_run_is_applied_again_without_a_fit(spark, tmp_path, monkeypatch):
    """Topics are those of the nearest stored centre; new rows get theirs; moved rows are named."""
    vectors = spark.read.parquet(f"{D}/embeddings.parquet").select("vec_id", "embedding")
    folder = str(tmp_path / "run")
    terms = {"a": vectors.select("vec_id", (F.col("vec_id") % 4).alias("n")), "b": vectors.select("vec_id", (F.col("vec_id") % 3).alias("n"))}
    runs.save_run(vectors, "vec_id", "embedding", folder, 6, terms, dimensions=8)
    monkeypatch.setattr(KMeans, "fit", lambda *a: pytest.fail("fitted again"))
    kept = {r.vec_id: r for r in runs.assignments(spark, folder).collect()}
    again = {r.vec_id: r for r in runs.rerun(spark, folder, vectors).collect()}
    assert {k: r.topic for k, r in kept.items()} == {k: r.topic for k, r in again.items()}
    assert all(kept[k].probability == pytest.approx(again[k].probability) for k in kept)
    model = PipelineModel.load(f"{folder}/model")
    centres, axes = np.array(model.stages[1].clusterCenters()), model.stages[0].pc.toArray()
    rows = {r.vec_id: np.array(r.embedding, float) @ axes for r in vectors.collect()}
    for i, x in rows.items():
        apart = ((centres - x) ** 2).sum(1)
        assert again[i].topic == apart.argmin() and again[i].probability == pytest.approx((1 / apart).max() / (1 / apart).sum())
    assert runs.moved(spark, folder, vectors).count() == 0
    turned = vectors.withColumn("embedding", F.when(F.col("vec_id") == 3, F.transform("embedding", lambda x: -x)).otherwise(F.col("embedding"))).where("vec_id <> 5")
    new = turned.unionByName(vectors.where("vec_id = 7").withColumn("vec_id", F.lit(10**6).cast("long")))
    moved = {r.vec_id: (r.stored_topic, r.topic) for r in runs.moved(spark, folder, new).collect()}
    assert set(moved) == {3, 5, 10**6} and moved[10**6] == (None, kept[7].topic) and moved[5] == (kept[5].topic, None)
    want = Counter(kept[i].topic for i in kept if i % 4 >= 2 and i % 3 >= 2)
    assert {r.topic: r.papers for r in runs.refiltered(spark, folder, "a", "b", 2).collect()} == want


def test_a_run_without_settings_is_not_read(spark, tmp_path):
    vectors = spark.read.parquet(f"{D}/embeddings.parquet")
    topics.topic_fit(vectors, "vec_id", "embedding", 3).write().save(f"{tmp_path}/model")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        runs.rerun(spark, str(tmp_path), vectors)


RATINGS = [
    (1, "a", "x", "p"), (1, "b", "x", "p"), (1, "c", "x", "q"), (2, "a", "x", "q"), (2, "b", "x", None), (3, "a", "x", "p"), (3, "b", "x", "r"), (3, "c", "x", "p"),
    (1, "a", "y", "1"), (1, "b", "y", "1"), (1, "c", "y", "1"), (3, "a", "y", "0"), (3, "b", "y", "1"), (3, "c", "y", "0"), (4, "c", "y", "1"),
]


@pytest.fixture
def ratings(spark):
    return spark.createDataFrame([(*r, float(r[0])) for r in RATINGS], "unit int, rater string, dimension string, value string, w double")


def test_confusion_is_a_full_cross_table(ratings):
    got = {tuple(r)[:5]: r.n for r in validation.confusion_tables(ratings).collect()}
    want = {}
    for left, right in combinations("abc", 2):
        for d in "xy":
            sides = [{u: v or "" for u, r, dd, v in RATINGS if r == s and dd == d} for s in (left, right)]
            both = sides[0].keys() & sides[1].keys()
            for lv in {sides[0][u] for u in both}:
                for rv in {sides[1][u] for u in both}:
                    want[left, right, d, lv, rv] = sum(sides[0][u] == lv and sides[1][u] == rv for u in both)
    assert got == want and 0 in want.values()


def test_intersections_of_every_set(ratings):
    got = {(r.raters, r.rater_count): r.units for r in validation.intersections(ratings.where("dimension = 'x'"), ["a", "b", "c", "none"]).collect()}
    own = {s: {u for u, r, d, v in RATINGS if r == s and d == "x" and v} for s in ("a", "b", "c", "none")}
    assert got == {("|".join(s), k): len(set.intersection(*(own[x] for x in s))) for k in (2, 3, 4) for s in combinations(("a", "b", "c", "none"), k)}
    with pytest.raises(ValueError, match="at most"):
        validation.intersections(ratings, [str(i) for i in range(13)])


def test_prevalence_by_weight(ratings):
    got = {(r.rater, r.dimension, r.category): r for r in validation.prevalence(ratings, "w").collect()}
    r = got["a", "x", "p"]
    assert (r.n, r.denominator, r.prevalence, r.weighted_prevalence) == (2, 3, 2 / 3, 4 / 6)
    assert r.normalized_entropy == pytest.approx(-(4 / 6 * np.log(4 / 6) + 2 / 6 * np.log(2 / 6)) / np.log(2))
    assert got["b", "y", "1"].normalized_entropy == 0 and ("b", "x", None) not in got


def test_grounding_and_confidence(spark):
    rows = [("m", "Alpha, beta  GAMMA.", "stated", "beta gamma", "0.5"), ("m", "Alpha", "stated", "delta", "x"), ("m", "Alpha", "stated", " . ", "1"), ("m", None, "inferred", "q", None), ("n", "A", "absent", None, None)]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "id int, rater string, text string, d_evidence_type string, d_evidence string, d_confidence string")
    long = validation.long_evidence(df, "id", F.col("rater"), ["d"], F.col("text"))
    assert {tuple(r) for r in validation.grounding(long).collect()} == {("m", "d", 2, 1, 0.5), ("n", "d", 0, 0, None)}
    found = {r.rater: tuple(r)[2:] for r in validation.confidence(long).collect()}
    assert found == {"m": (4, 0.75, 0.75, 0.75, 0.25, 0.0), "n": (1, None, None, 0.0, 0.0, 1.0)}


def test_reliability_and_catalog(ratings):
    pairs, dimensions = validation.pair_reliability(ratings, ["y"])
    one = {(r.left_rater, r.right_rater): r for r in pairs.collect()}
    parts = {(r.left_rater, r.right_rater, r.dimension): r for r in dimensions.collect()}
    assert {r.balanced_units for r in one.values()} == {2} and set(one) == {("a", "b"), ("a", "c"), ("b", "c")}
    assert one["a", "c"].mean_percent_agreement == 1 == one["a", "c"].mean_alpha and one["a", "b"].mean_percent_agreement == 0.5
    assert parts["a", "c", "x"].disagreements == 1 and parts["a", "c", "x"].classification == "Exploratory"
    got = {r.rater: (r.available_units, r.completed_units, r.kind, r.provisional) for r in validation.rater_catalog(ratings, {"a": "human", "c": "model"}, 2, 3).collect()}
    assert got == {"a": (3, 2, "human", True), "b": (3, 2, None, False), "c": (3, 2, "model", False)}


def test_populations_against_a_benchmark(spark):
    rows = [("p", "1", 1, 0), ("p", "2", 1, 1), ("q", "1", 1, 0), ("p", "1", 1, 0), ("r", "1", 0, 1), ("p", "", 1, 1), ("none", "1", 1, 1), ("p", "1", 0, 0)]
    df = spark.createDataFrame(rows, "a string, b string, s int, t int")
    panels = [Panel("a", "a", ("none",)), Panel("b", "b")]
    populations = [Scope("s", lambda: F.col("s") == 1), Scope("t", lambda: F.col("t") == 1), Scope("nobody", lambda: F.lit(False))]
    got = {(r.population, r.value): tuple(r)[2:] for r in composition.population_comparison(df, panels[0], populations, "s").collect()}
    assert {k: v[:3] for k, v in got.items()} == {("s", "p"): (4, 0.8, 0.8), ("s", "q"): (1, 0.2, 0.2), ("t", "p"): (2, 2 / 3, 0.8), ("t", "r"): (1, 1 / 3, 0.0)}
    assert got["t", "r"][3] == pytest.approx(100 / 3) and got["s", "p"][3] == 0
    found = {tuple(r) for r in composition.population_configurations(df, panels, populations, "s", "observed", 2).collect()}
    assert found == {("p", "1", "s", 2, 4, 0.5), ("p", "1", "t", 0, 2, 0.0), ("p", "1", "nobody", 0, 0, 0.0)}
    with pytest.raises(ValueError, match="min_support"):
        composition.population_configurations(df, panels, populations, "s", "full", 0)


def test_graph_of_the_most_cited(spark):
    nodes = spark.createDataFrame([(f"P::{i}", "P", str(i)) for i in range(4)] + [("J::a", "J", "a"), ("J::b", "J", "b"), ("T::x", "T", "x")], "node string, label string, value string")
    edges = spark.createDataFrame([("P::0", "J::a", "IN"), ("P::0", "J::a", "IN"), ("P::1", "J::b", "IN"), ("P::2", "J::a", "IN"), ("P::3", "J::b", "IN"), ("P::1", "T::x", "ON"), ("P::1", "J::gone", "IN"), ("P::1", "P::0", "CITES")], "src string, dst string, type string")
    cited = spark.createDataFrame([("P::0", 100), ("P::1", 7), ("P::2", 7), ("P::3", None)], "node string, citations int")
    got, links = graph.cited_graph(nodes, edges, cited, 2, ["J", "P"])
    assert {(r.node, r.size) for r in got.collect()} == {("P::0", 68), ("P::1", 15), ("J::a", 5), ("J::b", 5)} and got.count() == 4
    assert {tuple(r) for r in links.collect()} == {("P::0", "J::a", "IN", 2), ("P::1", "J::b", "IN", 1), ("P::1", "P::0", "CITES", 1)}
    alone, none = graph.cited_graph(nodes, edges, cited.where("node = 'P::3'"), 5, [])
    assert [tuple(r) for r in alone.collect()] == [("P::3", "P", "3", 8)] and none.count() == 0
