"""Rules that the queries' tables don't reach: blanks, unknown names, ties, limits, seeds."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from papyrion.functions import expressions as E
from papyrion.functions.unicode import fold_title, nfkc_casefold
from papyrion.operators import composition, domains, graph, growth, raters, robustness, sampling, topics
from papyrion.plans.registry import Panel, Scope, assert_same_ids, assert_unique, scope_frame

ROLE = Panel("role", "role", ("not observed",), fallback="old_role")


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("x")).first().x


def test_cleaning_rules_differ_on_purpose(spark):
    assert one(spark, "\xa0 a b 　", E.clean) == "a b" and one(spark, None, E.clean) == ""
    assert one(spark, " nan ", E.clean_or_null) == "nan" and one(spark, " nan ", E.graph_clean) is None
    assert [one(spark, v, E.number) for v in ("1.5", " 2 ", "1e3", "nan", "", "1,000", None)] == [1.5, 2.0, 1000.0, None, None, None, None]
    assert [one(spark, v, E.flag) for v in ("1", "1.0", "0", "yes", None)] == [True, True, False, False, False]
    assert one(spark, "a; ;b;a", E.distinct_codes) == ["a", "b"] and one(spark, "x y:0.5; z:1;", E.strip_scores) == "x y;z"
    assert one(spark, "https://dx.doi.org/10.1/AB c.", E.norm_doi) == "10.1/abc" and one(spark, "1234-567x", E.norm_issn) == "1234567X"


def test_unicode_rules(spark):
    df = spark.createDataFrame([("Straße ﬁn",), (None,), ("Café & Bar!",)], "v string")
    assert [r.x for r in df.select(nfkc_casefold("v").alias("x")).collect()][:2] == ["strasse fin", None]
    assert [r.x for r in df.select(fold_title("v").alias("x")).collect()][2] == "cafe and bar"


ROWS = [("a", "x"), ("a", "x"), ("b", "y"), ("not observed", "x"), ("", "z"), (None, "z")]


def test_two_views_have_their_own_denominators(spark):
    df = spark.createDataFrame(ROWS, "role string, kind string")
    full = {r.value: (r.papers, r.share) for r in composition.distribution(df, ROLE, "full").collect()}
    seen = {r.value: (r.papers, r.share) for r in composition.distribution(df, ROLE, "observed").collect()}
    assert full["Missing value"] == (2, pytest.approx(1 / 3)) and full["not observed"][0] == 1 and sum(s for _, s in full.values()) == pytest.approx(1)
    assert seen == {"a": (2, pytest.approx(2 / 3)), "b": (1, pytest.approx(1 / 3))}


def test_unknown_names_are_errors_and_absent_columns_give_no_rows(spark):
    df = spark.createDataFrame(ROWS, "role string, kind string")
    with pytest.raises(ValueError, match="unknown view"):
        composition.distribution(df, ROLE, "partial")
    with pytest.raises(ValueError, match="unknown status"):
        composition.filter_status(df, "new", "kind", ("x",))
    with pytest.raises(ValueError, match="unknown columns"):
        composition.evidence(df, {"nothing": "x"}, strict=True)
    with pytest.raises(ValueError, match="unknown scope"):
        scope_frame(df, {}, "core")
    with pytest.raises(ValueError, match="needs columns"):
        Scope("s", lambda: F.col("flag") == 1, needs=("flag",)).frame(df)
    assert composition.distribution(df, Panel("p", "nothing")).count() == 0
    assert composition.evidence(df, {"nothing": "x", "kind": "x"}).count() == 3
    assert composition.distribution(df.withColumnRenamed("role", "old_role"), ROLE).count() == 4


def test_gates(spark):
    a, b = (spark.createDataFrame([(i,) for i in ids], "id int") for ids in ((1, 2), (1, 2, 2)))
    assert assert_unique(a, ["id"]) is a
    with pytest.raises(ValueError, match="share"):
        assert_unique(b, ["id"])
    assert_same_ids(a, b, "id")
    with pytest.raises(ValueError, match="one frame only"):
        assert_same_ids(a, b.where("id = 1"), "id")


@given(st.lists(st.lists(st.sampled_from("abc"), max_size=4), min_size=1, max_size=8))
@settings(max_examples=12, deadline=None)
def test_alpha_is_that_of_all_pairs(spark, units):
    rows = [(u, f"r{i}", "d", v) for u, values in enumerate(units) for i, v in enumerate(values)]
    got = raters.nominal_alpha(spark.createDataFrame(rows, "unit int, rater string, dimension string, value string")).collect()
    pairs = [(a, b) for values in units for i, a in enumerate(values) for b in values[:i]]
    pooled = [v for values in units for v in values]
    if not rows:
        assert got == []
        return
    every = [(a, b) for i, a in enumerate(pooled) for b in pooled[:i]]
    if not pairs:
        assert got[0].alpha is None
        return
    d_o, d_e = (sum(a != b for a, b in p) / len(p) for p in (pairs, every))
    assert got[0].alpha == (pytest.approx(1 - d_o / d_e) if d_e else 1.0)


def test_agreement_of_nothing_is_null(spark):
    row = raters.percent_agreement(spark.createDataFrame([(None, "a"), ("", "a")], "l string, r string"), "l", "r").first()
    assert (row.comparable, row.agreements, row.percent_agreement) == (0, 0, None)


@given(st.dictionaries(st.text("abc", min_size=1, max_size=3), st.integers(1, 200), min_size=1, max_size=8), st.floats(0, 1))
@settings(max_examples=200, deadline=None)
def test_allocation_is_exact(sizes, share):
    n = int(len(sizes) + share * (sum(sizes.values()) - len(sizes)))
    got = sampling.proportional_allocation(sizes, n)
    assert sum(got.values()) == n and all(1 <= got[k] <= v for k, v in sizes.items())


def test_allocation_limits():
    for n in (1, 301):
        with pytest.raises(ValueError):
            sampling.proportional_allocation({"a": 100, "b": 200}, n)


@pytest.mark.parametrize("n", [3, 10, 11, 22])
def test_tertiles_are_those_of_quantile_bins(spark, n):
    values = [(i, (i * 7) % 5) for i in range(n)]
    got = {r.id: r.tertile for r in growth.tertiles(spark.createDataFrame(values, "id int, v int"), "v", [F.col("id")], n).collect()}
    rank = pd.Series([v for _, v in values]).rank(method="first")
    assert [got[i] for i in range(n)] == (pd.qcut(rank, 3, labels=False) + 1).tolist()


def test_growth_from_nothing_is_null(spark):
    df = spark.createDataFrame([(2001,), (2003,), (0,), (None,)], "year int")
    got = {r.start_year: (r.start_stock, r.end_stock, r.growth) for r in growth.growth_periods(df, "year", [(2000, 2003), (2001, 2003)]).collect()}
    assert got == {2000: (0, 2, None), 2001: (1, 2, 1.0)}
    assert [(r.year, r.papers, r.cumulative) for r in growth.annual_production(df, "year").orderBy("year").collect()] == [(2001, 1, 1), (2002, 0, 1), (2003, 1, 2)]


def test_draws_are_exact_and_repeat(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 else "b") for i in range(90)], "id int, stratum string")
    draw = lambda d: {r.id for r in sampling.draw_stratified(d, "id", {"a": 12, "b": 5}, 7).collect()}
    got = draw(df)
    assert len(got) == 17 and sum(i % 3 == 0 for i in got) == 5 and got == draw(df.repartition(6))


def test_large_groups_make_no_pairs(spark):
    rows = [(1, m) for m in range(30)] + [(2, m) for m in range(4)] + [(3, 1), (3, 1)]
    got = graph.member_pairs(spark.createDataFrame(rows, "g int, m int"), "g", "m", 25).collect()
    assert {r.g for r in got} == {2} and len(got) == 6 and all(r.left_member < r.right_member for r in got)


def test_seed_limits(spark):
    nodes = spark.createDataFrame([("J::a", "J", "a")], "node string, label string, value string")
    with pytest.raises(ValueError, match="between"):
        graph.seed(nodes, nodes.limit(0).selectExpr("node AS src", "node AS dst", "label AS type"), "J", F.lit(0), 101)
    with pytest.raises(ValueError, match="least"):
        robustness.agreement_evidence(nodes, 3, 4)


def test_topics_over_time_needs_dates(spark):
    df = spark.createDataFrame([("t", i) for i in range(9)], "topic string, t long")
    assert topics.topics_over_time(df, "topic", "t").count() == 0
    assert topics.topics_over_time(df.unionByName(df), "topic", "t", bins=3).count() == 3


def test_empty_evidence_overlaps_fully(spark):
    df = spark.createDataFrame([("", "a b"), ("A c", "a b"), (None, None)], "e string, s string")
    assert [r.x for r in df.select(domains.token_overlap(F.col("e"), F.col("s")).alias("x")).collect()] == [1.0, 0.5, 1.0]
