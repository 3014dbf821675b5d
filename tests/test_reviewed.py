"""Topic fits and their choice, sampling stability, rater frames, reviews and rule files."""

from collections import Counter
from datetime import date

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.operators import graph, growth, raters, records, sampling, topics
from papyrion.queries import QUERIES
from papyrion.sources import rules


def test_tertiles_of_many_values(spark):
    rng = np.random.default_rng(4)
    for values in (rng.normal(size=1500), rng.integers(0, 3, 700).astype(float), np.zeros(10)):
        rows = [(i, float(v)) for i, v in enumerate(values)]
        order = sorted(rows, key=lambda r: (r[1], r[0]))
        edges = [growth.rank_quantile(s, len(rows)) for s in (1 / 3, 2 / 3)]
        want = {i: 1 + sum(k + 1 > e for e in edges) for k, (i, _) in enumerate(order)}
        got = growth.tertiles(spark.createDataFrame(rows, "id int, v double"), "v", [F.col("id")], len(rows)).collect()
        assert {r.id: r.tertile for r in got} == want


def plain_metrics(pairs):
    """Agreement and nominal alpha of (left, right) pairs, by the definitions."""
    n = len(pairs)
    counts = Counter(v for p in pairs for v in p)
    observed = sum(a != b for a, b in pairs) / n
    expected = 1 - sum(c * (c - 1) for c in counts.values()) / (2 * n * (2 * n - 1))
    return 1 - observed, (1.0 if observed == 0 else np.nan) if abs(expected) < 1e-15 else 1 - observed / expected


def test_stability_is_that_of_drawn_rows(spark):
    """Both metrics and the coverage of rare categories over 1,000 replicates, against drawn rows; a
    sample's size is that of the whole frame, allocated to strata."""
    rng = np.random.default_rng(8)
    rows = [(s, i, v, v if rng.random() < p else "xyz"[rng.integers(3)]) for s, n, p in (("a", 400, 0.9), ("b", 90, 0.5), ("c", 7, 0.2), ("d", 1, 1)) for i in range(n) for v in ["xyyy"[i % 4]]]
    rows[3] = ("a", 3, "rare", None)
    df = spark.createDataFrame(rows, "stratum string, id int, l string, r string").withColumn("k", F.lit("same"))
    find = lambda: sampling.stability(df, {"code": ("l", "r"), "k": ("k", "k")}, [0.1, 0.4], 1000, 5)
    got = {(r.fraction, r.dimension, r.metric): r for r in find().collect()}
    text = [(s, (a or "", b or "")) for s, _, a, b in rows]
    truth = dict(zip(("percent_agreement", "alpha"), plain_metrics([p for _, p in text]), strict=True))
    sizes = Counter(s for s, _ in text)
    sides = [Counter(p[i] for _, p in text) for i in (0, 1)]
    rare = [(i, v) for i in (0, 1) for v, n in sides[i].items() if n / len(text) < 0.01]
    for fraction in (0.1, 0.4):
        take = sampling.proportional_allocation(dict(sizes), int(np.ceil(len(text) * fraction)))
        draws, covered = [], []
        for _ in range(600):
            sample = [own[i] for s in sizes for own in [[p for t, p in text if t == s]] for i in rng.permutation(len(own))[: take[s]]]
            draws.append(plain_metrics(sample))
            covered.append(np.mean([any(p[i] == v for p in sample) for i, v in rare]))
        for metric, values in zip(("percent_agreement", "alpha"), np.array(draws).T, strict=True):
            r = got[fraction, "code", metric]
            assert r.sample_size == sum(take.values()) == int(np.ceil(len(text) * fraction)) and r.full_value == pytest.approx(truth[metric])
            assert abs(r["mean"] - values.mean()) < 5 * values.std() / 20 and r.bias == pytest.approx(r["mean"] - truth[metric])
            assert r.sd == pytest.approx(values.std(ddof=1), rel=0.15) and r.width_95 == pytest.approx(np.subtract(*np.percentile(values, [97.5, 2.5])), rel=0.2)
            assert abs(r.rare_coverage - np.mean(covered)) < 0.06 and r.rmse >= abs(r.bias)
        assert [got[fraction, "k", m]["mean"] for m in truth] == [1.0, 1.0] and got[fraction, "k", "alpha"].passes
    assert {(r.fraction, r.dimension, r.metric): r for r in find().collect()} == got
    with pytest.raises(ValueError):
        sampling.stability(df, {"code": ("l", "r")}, [0.1], 10, 5, population=10)


def test_the_smallest_fraction_that_passes_everywhere(spark):
    rows = [(0.1, "a", True), (0.1, "b", False), (0.2, "a", True), (0.2, "b", True), (0.4, "a", True), (0.4, "b", True)]
    df = spark.createDataFrame(rows, "fraction double, dimension string, passes boolean")
    assert {r.fraction for r in sampling.recommend_fraction(df).where("recommended").collect()} == {0.2}
    assert sampling.recommend_fraction(df.where("fraction < 0.2")).where("recommended").count() == 0


def test_bootstrap_is_that_of_resampled_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(v, v if rng.random() < 0.7 else "abc"[rng.integers(3)], float(rng.integers(1, 9))) for v in rng.choice(list("aabc"), 300).tolist()]
    df = spark.createDataFrame(rows + [(None, "a", 1.0), (" ", "b", 1.0)], "l string, r string, w double")
    found = raters.bootstrap_interval(df, "l", "r", "w")
    pairs = [(a, b) for a, b, _ in rows]
    agreement, alpha = plain_metrics(pairs)
    assert (found["comparable"], found["agreements"]) == (300, sum(a == b for a, b in pairs))
    assert found["percent_agreement"] == pytest.approx(agreement) and found["alpha"] == pytest.approx(alpha)
    assert found["weighted_percent_agreement"] == pytest.approx(sum(w for a, b, w in rows if a == b) / sum(w for *_, w in rows))
    draws = np.array([plain_metrics([pairs[i] for i in rng.integers(0, 300, 300)]) for _ in range(2000)])
    for name, values in zip(("agreement", "alpha"), draws.T, strict=True):
        for end, q in (("low", 2.5), ("high", 97.5)):
            assert abs(found[f"{name}_{end}"] - np.percentile(values, q)) < 0.012
    same = raters.bootstrap_interval(spark.createDataFrame([("a", "a")] * 5, "l string, r string"), "l", "r")
    assert (same["alpha"], same["alpha_low"], same["alpha_high"], same["weighted_percent_agreement"]) == (1.0, 1.0, 1.0, 1.0)
    assert raters.bootstrap_interval(df.limit(0), "l", "r") == {"comparable": 0, "agreements": 0} | dict.fromkeys(list(found)[2:])


def by_hand(centres, sizes, least, most):
    """Topics merged pair by pair until the count before the largest jump, by going through all pairs."""
    cosine = lambda a, b: 1 - a @ b / np.sqrt((a @ a) * (b @ b))
    state, found = {t: (c, sizes[t], [t]) for t, c in centres.items()}, []
    while len(state) > 1:
        apart, a, b = min((round(cosine(state[a][0], state[b][0]), 12), a, b) for a in state for b in state if a < b)
        (ca, na, ma), (cb, nb, mb) = state[a], state.pop(b)
        state[a] = ((ca * na + cb * nb) / (na + nb), na + nb, ma + mb)
        found.append((len(state), apart, {m: t for t, (_, _, members) in state.items() for m in members}))
    able = [x for x in found if least <= x[0] <= most]
    jumps = [b[1] - a[1] for a, b in zip(able, able[1:], strict=False)]
    return able[int(np.argmax(jumps))][2] if jumps else {t: t for t in centres}


def test_reduction_query_stops_at_the_largest_jump(spark):
    d = "/root/testdata/sf0.001"
    fitted = topics.fit_topics(spark.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding", 20, dimensions=16).collect()
    points = {t: np.array([r.features.toArray() for r in fitted if r.topic == t]) for t in {r.topic for r in fitted}}
    want = by_hand({t: p.mean(axis=0) for t, p in points.items()}, {t: len(p) for t, p in points.items()}, 5, 15)
    got = {r.topic: r for r in QUERIES["topic_reduction"](spark, d).collect()}
    assert {t: r.reduced_topic for t, r in got.items()} == want and {t: r.papers for t, r in got.items()} == {t: len(p) for t, p in points.items()}


def test_topic_count_query_scores_every_candidate(spark):
    """Silhouette, diversity, outliers and balance of each candidate of the query, from all points."""
    d = "/root/testdata/sf0.001"
    df = spark.read.parquet(f"{d}/embeddings.parquet")
    texts = {r.doc_id: r.w for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", topics.tokens(F.col("text")).alias("w")).collect()}
    got = {r["size"]: r for r in QUERIES["topic_count_choice"](spark, d).collect()}
    for k, row in got.items():
        fitted = topics.fit_topics(df, "vec_id", "embedding", k, dimensions=16).collect()
        x, label = np.array([r.features.toArray() for r in fitted]), np.array([r.topic for r in fitted])
        apart = ((x[:, None] - x[None]) ** 2).sum(axis=2)
        silhouette = []
        for i, t in enumerate(label):
            mean = {s: apart[i, label == s].sum() / (max(1, (label == s).sum() - (s == t))) for s in set(label.tolist())}
            a, b = mean.pop(int(t)), min(mean.values())
            silhouette.append(0.0 if (label == t).sum() == 1 else (b - a) / max(a, b))
        words = {int(t): [w for r in fitted if r.topic == t for w in texts.get(r.vec_id, [])] for t in set(label.tolist())}
        everywhere = Counter(w for ws in words.values() for w in ws)
        average = sum(everywhere.values()) / sum(bool(ws) for ws in words.values())
        tops = []
        for ws in words.values():
            tf = Counter(ws)
            weight = {w: round(n / len(ws) * np.log(1 + average / everywhere[w]), 12) for w, n in tf.items() if everywhere[w] >= 2}
            tops += sorted(weight, key=lambda w: (-weight[w], w.encode()))[:10]
        sizes = np.array(list(Counter(label.tolist()).values()))
        figures = [np.mean(silhouette), len(set(tops)) / len(tops), 0.0, sizes.std() / sizes.mean()]
        assert [row.silhouette, row.diversity, row.outlier_rate, row.size_cv] == pytest.approx(figures, abs=1e-6)
        assert row.score == pytest.approx(topics.fit_score(*figures)) and row.topics == len(sizes)
    able = [r for r in got.values() if r.topics >= 5]
    assert [r["size"] for r in got.values() if r.recommended] == [max(able, key=lambda r: r.score)["size"]]


def clusters(spark, n=6):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(n, 5)) * 10
    rows = [(i, (centres[i % n] + rng.normal(size=5)).tolist(), [f"t{i % n}", f"u{i % n}"]) for i in range(60 * n)]
    return spark.createDataFrame(rows, "id int, v array<double>, w array<string>")


def test_probability_is_the_part_of_inverse_distances(spark):
    fitted = topics.fit_topics(clusters(spark), "id", "v", 6).collect()
    assert len({r.topic for r in fitted}) == 6 and all(r.topic == fitted[0].topic for r in fitted if r.id % 6 == fitted[0].id % 6)
    centres = {t: np.mean([r.features.toArray() for r in fitted if r.topic == t], axis=0) for t in range(6)}
    for r in fitted[:50]:
        inverse = {t: 1 / ((r.features.toArray() - c) ** 2).sum() for t, c in centres.items()}
        assert r.probability == pytest.approx(inverse[r.topic] / sum(inverse.values()), rel=1e-6)


def test_topic_count_choice(spark):
    out = topics.choose_topic_count(clusters(spark), "id", "v", F.col("w"), [3, 6, 12]).collect()
    for r in out:
        assert r.score == pytest.approx((r.silhouette + 1) / 2 * 0.25 + r.diversity * 0.25 + (1 - r.outlier_rate) * 0.35 + 0.15 / (1 + r.size_cv))
    assert [r["size"] for r in out if r.recommended] == [max((r for r in out if r.topics >= 5), key=lambda r: r.score)["size"]] == [6]
    with pytest.raises(ValueError):
        topics.choose_topic_count(clusters(spark), "id", "v", F.col("w"), [2, 3])


def test_merges_take_the_closest_pair():
    centres = {0: [1, 0], 1: [1, 0.1], 2: [0, 1], 3: [-1, 0.05]}
    got = topics.merge_sequence({t: np.array(c, float) for t, c in centres.items()}, {0: 1, 1: 3, 2: 1, 3: 1})
    assert [(n, kept, merged) for n, _, kept, merged in got] == [(3, 0, 1), (2, 0, 2), (1, 0, 3)]
    a, b = np.array([1, 0.0]), np.array([1, 0.1])
    assert got[0][1] == pytest.approx(1 - a @ b / np.sqrt(b @ b))
    mean = np.array([1, 0.075])
    assert got[1][1] == pytest.approx(1 - mean[1] / np.sqrt(mean @ mean))
    assert topics.merge_sequence({5: np.zeros(2)}, {5: 1}) == []


def test_reduced_topics(spark):
    fitted = topics.fit_topics(clusters(spark), "id", "v", 12, seed=1)
    out = topics.reduced_topics(fitted, 2, 11).select("topic", "reduced_topic").distinct().collect()
    assert len(out) == 12 and {r.reduced_topic for r in out} <= {r.topic for r in out} and len({r.reduced_topic for r in out}) <= 11
    assert topics.reduced_topics(fitted, 100, 200).where("topic <> reduced_topic").count() == 0


def test_rater_frame_takes_no_column_from_the_corpus(spark):
    corpus = spark.createDataFrame([(1, "old", "kept"), (2, "old", "kept")], "id int, code string, year string")
    rater = spark.createDataFrame([(1, None)], "id int, code string")
    assert [tuple(r) for r in records.rater_frame(corpus, rater, "id").select("id", "code", "year").collect()] == [(1, None, "kept")]
    with pytest.raises(Exception, match="twice"):
        records.rater_frame(corpus, rater.unionByName(rater), "id").collect()


def test_rater_registry(spark):
    rows = [("a", 1, "x"), ("b", 1, "x"), ("b", 2, "x"), ("c", 2, None), ("d", 2, "x"), ("d", 2, "y")]
    got = records.rater_registry(spark.createDataFrame(rows, "rater string, unit int, value string"), ["a"], {"b": 2, "d": 2}).collect()
    assert {(r.rater, r.coded, r.coverage, r.eligible) for r in got} == {("a", 1, 0.5, True), ("b", 2, 1.0, True), ("d", 1, 0.5, False)}


def test_pairs_at_the_limit(spark):
    rows = [(g, m) for g, n in ((1, 25), (2, 26), (3, 1)) for m in range(n)]
    got = graph.member_pairs(spark.createDataFrame(rows, "g int, m int"), "g", "m")
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {1: 25 * 24 // 2}


@pytest.mark.parametrize("text, want", [("10.1000/a;b(c)[1]", ["10.1000/a;b(c"]), ("x 10.1000/AB-1_2:3, 10.99/no", ["10.1000/ab-1_2:3"]), ("10.1234/é", []), (None, [])])
def test_dois(spark, text, want):
    df = spark.createDataFrame([(1, text)], "id int, t string")
    got = graph.resolve_references(df, "id", F.col("t"), F.lit(None).cast("string"), F.col("id")).collect()
    assert [r.target.rstrip(")") for r in got] == want


def test_rule_files(spark, tmp_path):
    (tmp_path / "r.yaml").write_text('date_updated: 2026-07-08\nseeds: [ai, "deep learning"]\nqueries:\n  q1:\n    scopus_query: \'( LIMIT-TO ( EXACTSRCTITLE,"A Journal" ) OR LIMIT-TO(EXACTSRCTITLE, "B") )\'\n  q2: {scopus_query: }\n')
    (tmp_path / "a.json").write_text('{"aliases": {"A.I. ": "Artificial  Intelligence"}}')
    (tmp_path / "bad.json").write_text("[1]")
    found = rules.load_rules(spark, str(tmp_path / "r.yaml"))
    assert rules.term_groups(found, {"primary": "seeds", "broad": "absent"}) == {"primary": ["ai", "deep learning"], "broad": []}
    assert {tuple(r) for r in rules.source_titles(spark, found).collect()} == {(q, t) for q in ("q1", "combined") for t in ("A Journal", "B")}
    assert rules.cutoff(found) == date(2026, 7, 8) and rules.aliases(rules.load_rules(spark, str(tmp_path / "a.json"))) == {"a.i.": "artificial intelligence"}
    with pytest.raises(ValueError):
        rules.cutoff({})
    with pytest.raises(ValueError):
        rules.load_rules(spark, str(tmp_path / "bad.json"))
