"""Findings of round 3: units with the same ratings count as one, and no step explodes before it counts."""

import math
import re
import time
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from papyrion.operators import ingest, phrases, raters, records, robustness, topics, validation
from papyrion.plans import tables
from papyrion.queries import graph as graph_queries
from papyrion.queries import keywords as keyword_queries
from papyrion.queries import raters as rater_queries
from papyrion.queries import validation as validation_queries

D = "/root/testdata/sf0.001"
UNITS = [(i, "p" if i % 3 else "q", " p " if i % 2 else None, "q" if i % 5 else "", "1" if i % 4 else None, "1", "0" if i % 2 else "1", float(i)) for i in range(60)]


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(UNITS, "unit int, ax string, bx string, cx string, ay string, by string, cy string, w double")
    return raters.unit_rows(df, {r: {"x": F.col(f"{r}x"), "y": F.col(f"{r}y")} for r in "abc"}, ["w"])


@pytest.fixture(scope="module")
def long(rows):
    parts = rows.select("unit", "w", F.explode("x").alias("c")).select("unit", "w", "c.rater", "c.dimension", F.nullif(F.trim("c.value"), F.lit("")).alias("value"))
    return parts.cache()


BOTH = {
    "F2": lambda r: validation.pair_reliability(r, ["x"])[0],
    "F3": lambda r: validation.pair_reliability(r, ["x"])[1],
    "F4": validation.confusion_tables,
    "F5": lambda r: validation.rater_catalog(r, {"a": "human"}, 2, 60),
    "F6": raters.pair_matrix,
    "F9": lambda r: records.rater_progress(r, 60, 2),
    "F14": raters.multirater_summary,
    "F16": lambda r: validation.intersections(r, ["a", "b", "c"]),
    "F17": lambda r: raters.balanced_units(raters.rated(r), 3),
    "F19": lambda r: robustness.agreement_evidence(raters.pattern_agreement(r, {"x": "p", "y": "1"}), 3, 1),
    "F20": lambda r: raters.agreement_curve(raters.pattern_agreement(r, {"x": "p", "y": "1"}), 3),
    "F21": lambda r: validation.prevalence(r, "w"),
}


def plain(df):
    return sorted((tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*sorted(df.columns)).collect()), key=repr)


@pytest.mark.parametrize("finding", BOTH)
def test_unit_rows_give_what_long_ratings_give(rows, long, finding):
    want = plain(BOTH[finding](long))
    assert want and plain(BOTH[finding](rows)) == want


def test_units_alike_are_one_that_counts(rows):
    got = raters.counted(rows, "w")
    units = got.select("unit", "n", "w").distinct()
    assert units.count() == len({u[1:7] for u in UNITS}) < 60
    assert units.agg(F.sum("n"), F.sum("w")).first() == (60, float(sum(range(60))))
    assert plain(raters.agreement_curve(raters.pattern_agreement(got, {"x": "p"}), 3)) == plain(raters.agreement_curve(raters.pattern_agreement(rows, {"x": "p"}), 3))


@pytest.mark.parametrize("f", [rater_queries.ratings, validation_queries.coded])
def test_queries_meet_units_once(spark, f):
    """One row a unit, after one shuffle, without a join or an explode; what is counted is patterns."""
    found = f(spark, D)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan and "Generate" not in plan
    assert found.count() == found.select("unit").distinct().count() > 20 * raters.counted(found).select("unit").distinct().count()


def test_keywords_are_spread_by_rows(spark, monkeypatch):
    """F8 F10 F12 F13: the partitions of the bridge grow with the line items, so that a task's share does not."""
    monkeypatch.setattr(tables, "ROWS_A_TASK", 500)
    n = spark.read.parquet(f"{D}/lineitem.parquet").count()
    for f in (keyword_queries.bridge, keyword_queries.domain_assignment_multilabel):
        assert f(spark, D).rdd.getNumPartitions() == -(-n // 500)


def test_patterns_are_searched_where_a_text_may_match():
    """thousands of phrases that no token spells cost a text one pass, and count as their patterns do."""
    listed = [f"v{i}.0_x-{i}" for i in range(4000)] + ["by-nc_4.0", "ma\u017fs-i", "K.\u03c2", "stra\u00dfe-1", "it's_so"]
    text = ("cc BY-NC 4.0, V17.0 x-17 v17.0_X-17 v3999.0 x-39990 MASS-\u0130 mass-\u0131 \u212a.\u03a3 STRA\u1e9eE-1 strasse-1 It's so " + "word " * 200) * 3
    matcher = phrases.PhraseMatcher([*listed, "a.b"], ["a.b"])
    began = time.perf_counter()
    for _ in range(20):
        got = matcher.counts(text + " A.B a.b")
    assert time.perf_counter() - began < 1
    want = {p: n for p in listed if (n := len(re.findall(rf"\b{re.escape(p)}\b|\b{re.escape(p.replace('_', ' '))}\b", text, re.IGNORECASE)))}
    assert got == want | {"a.b": 1} and len(want) >= 5


def test_folding_is_wider_than_a_patterns_case():
    """whatever a pattern takes for one letter is folded to one."""
    cased = "".join(c for c in map(chr, range(0x110000)) if c.isalpha() and (c.lower() != c or c.upper() != c or c.casefold() != c))
    for c in cased:
        assert {phrases._folded(x) for x in re.findall(re.escape(c), cased, re.IGNORECASE)} == {phrases._folded(c)}, hex(ord(c))


def test_white_space_is_collapsed_once_a_text(spark):
    """however many terms are looked for, a text is brought into shape once."""
    df = spark.createDataFrame([(1, " AI \n and  firms"), (2, None)], "id int, text string")
    out = ingest.score_relevance(df, F.col("text"), {"primary": ["ai", "firm*", "x"], "secondary": ["and firms", "y"]})
    got = {r.id: (r.primary_count, r.secondary_count, r.strict) for r in out.collect()}
    assert got == {1: (2, 1, False), 2: (0, 0, False)} and "_body" not in out.columns
    out = out.select("id", "primary_count", "secondary_count", "strict", "broad")
    assert out._jdf.queryExecution().executedPlan().toString().count("coalesce(text") <= 1


def test_f7_pairs_are_counted_by_block_and_never_a_row_each(spark, monkeypatch):
    """Blocks and buckets of a few words give a fold's texts; a text's words are dealt once a round."""
    from test_phrases import merged

    monkeypatch.setattr(phrases, "BLOCK_WORDS", 40)
    monkeypatch.setattr(phrases, "BUCKET_WORDS", 10)
    texts = [["x", "y", "z"], ["state", "of", "the", "art", "end"], ["p", "q", "p", "q", "p"], ["x_y", "of", "the", "é"], [], ["the"], [""]] * 8
    df = spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>")
    out, tables_ = phrases.detect_phrases(df, "id", "words", 5, 0.3)
    assert [r.words for r in out.orderBy("id").collect()] == merged(merged(texts, 5, 0.3), 5, 0.3)
    assert {r.phrase: r.n for r in tables_[0].collect()}["state_of_the_art"] == 8
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Join" not in plan.replace("CoGroup", "")
    with pytest.raises(Exception, match="line feed"):
        phrases.merge_phrases(df.withColumn("words", F.array(F.lit("a\nb"))), "id", "words").collect()


def test_tokens_lose_the_punctuation_at_their_ends(spark):
    """in one pass over a text, whatever stands between the marks, and in a time that long runs do not square."""
    text = "..a_b.. (x-y) --- _- -_ é! «q» a.b., 'tis\u2003--it\u0085x1--\n" + "-" * 300_000 + "end " + "z" + "-" * 300_000
    began = time.perf_counter()
    got = spark.createDataFrame([(text,), (None,)], "t string").select(topics.tokens(F.col("t")).alias("w")).collect()
    assert time.perf_counter() - began < 20
    assert got[0].w == ["a_b", "x-y", "«q»", "a.b", "tis", "it", "x1", "end"] and got[1].w == []


def test_f15_candidates_share_one_reading_of_the_texts(spark, monkeypatch):
    """words are dealt by themselves once for many topics, whatever topics they fall to, and top words stay those of ctfidf()."""
    rows = [(i, [float(i % 7), float(i % 5 * 3)], ["w%d" % (i % 7), "v%d" % (i % 3), "all"] if i % 11 else None) for i in range(140)]
    df = spark.createDataFrame(rows, "id int, v array<double>, w array<string>")
    models = [topics.topic_fit(df, "id", "v", k) for k in (3, 6)]
    monkeypatch.setattr(topics, "TOPICS_A_PASS", 4)
    got = topics.top_words(models, df, "id", "v", F.col("w"), 2, 10)
    for i, model in enumerate(models):
        fitted = topics.assigned_by(model, df, "id", "v").select("id", "topic").join(df.select("id", "w"), "id")
        want = {(r.topic, r.term, r.n, r["rank"]) for r in topics.ctfidf(fitted, "topic", F.col("w"), 2, 10).collect()}
        assert {(r.topic, r.term, r.n, r["rank"]) for r in got.where(F.col("fit") == i).collect()} == want and len(want) > 20
    monkeypatch.undo()
    plan = topics.top_words(models, df, "id", "v", F.col("w"), 2, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode(") <= 3 and "Expand" not in plan


ODD = ["a.b. A.B. (x-y) \u00bd\u00bd \u2163\u2163 \u24d0\u24d0 \u203f\u203f \u0301\u0301", "\x1c\x1cab\x1fcd\u2003ef\xa0gh\x85ij\u2028kl\u200bmn", "_ __ _- -_- z zz \u20ac\u20ac \u200d\u200d \U0001f600\U0001f600", "", "  \n", "--", None, "one", "\u00e9t\u00e9 \u00c9T\u00c9 \u00ab\u00e9t\u00e9\u00bb"]


def test_f11_tokens_are_those_of_sql(spark):
    """of texts in Spark, of blocks in Arrow and in SQL; before, tokens of numerals that are no digits were lost."""
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (i INT, text VARCHAR)")
    con.executemany("INSERT INTO documents VALUES (?, ?)", list(enumerate(ODD)))
    want = [r[0] or [] for r in con.execute(f"SELECT {graph_queries._WORDS} FROM documents ORDER BY i").fetchall()]
    df = spark.createDataFrame(list(enumerate(ODD)), "i int, text string")
    assert [r.w for r in df.orderBy("i").select(topics.tokens(F.col("text")).alias("w")).collect()] == want
    lowered = df.orderBy("i").select(F.lower(F.coalesce("text", F.lit(""))).alias("t")).toArrow().column("t").combine_chunks()
    vocabulary, ids, row = topics._encoded(lowered)
    got = [[] for _ in ODD]
    for i, r in zip(ids.tolist(), row.tolist(), strict=True):
        got[r].append(vocabulary[i].as_py())
    assert got == want and "\u00bd\u00bd" in want[0]


@pytest.mark.parametrize("block", [1, 40, 1 << 20])
def test_f11_pairs_are_counted_by_block_and_never_a_row_each(spark, monkeypatch, block):
    """whatever the blocks, the pairs of a plain count, and what is left to join are the frequent ones alone."""
    monkeypatch.setattr(topics, "BLOCK_BYTES", block)
    monkeypatch.setattr(topics, "BUCKET_BYTES", 30)
    kept = []
    monkeypatch.setattr(topics, "written", lambda df, name: kept.append(tables.written(df, name)) or kept[-1])
    texts = [*ODD, "the cat sat, the cat ran", "of the cat", "new york (new york) new", *[f"rare{i} word{i}" for i in range(50)]] * 3
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string").repartition(3)
    words = [r.w for r in df.select(topics.tokens(F.col("text")).alias("w")).collect()]
    singles, pairs = Counter(x for w in words for x in w), Counter(p for w in words for p in zip(w, w[1:]))
    total, want = sum(singles.values()), {}
    for (a, b), n in pairs.items():
        npmi = math.log((n / total) / ((singles[a] / total) * (singles[b] / total))) / -math.log(n / total)
        if n >= 6 and npmi >= 0.3:
            want[a, b] = n, round(npmi, 9)
    out = topics.npmi_bigrams(df, "text", 6, 0.3)
    assert {(r.left_word, r.right_word): (r.n, round(r.npmi, 9)) for r in out.collect()} == want and ("new", "york") in want
    frequent = sum(n >= 6 for n in [*singles.values(), *pairs.values()])
    assert frequent < kept[0].count() <= frequent + 1024 and kept[0].where("left_word like 'rare%'").count() == 0
    assert kept[0].where("left_word = ''").agg(F.sum("n")).first()[0] == total
    assert "Generate" not in out._jdf.queryExecution().executedPlan().toString()


def test_f11_no_texts_no_bigrams(spark):
    for texts in ([], [(None,)], [("",), ("--",)]):
        assert topics.npmi_bigrams(spark.createDataFrame(texts, "text string"), "text", 1, 0.0).collect() == []
