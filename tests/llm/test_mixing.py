import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import compare
from pyspark.sql import functions as F

from papyrion.llm import mixing
from papyrion.llm.queries import OP7_SQL, op7_mix

SCHEMA = "doc_id long, source string, size long, target string, _x int"


def plain_targets(sizes, weights=(3, 1, 2), share=150, most=2):
    """Shared by weight, again and again, until none is above its limit."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    left, open_, target = sum(sizes.values()) * share / 100, set(names), {}
    while open_:
        unit = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if unit * weight[s] > most * sizes[s]]
        if not over:
            target |= {s: unit * weight[s] for s in open_}
            break
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
            open_.remove(s)
    return target


@given(st.lists(st.tuples(st.sampled_from([None, "", "a", "Z", "é", "😀"]), st.integers(0, 500)), min_size=1, max_size=12))
@settings(max_examples=10, deadline=None)
def test_targets(spark, rows):
    sizes = {}
    for s, n in rows:
        sizes[s] = sizes.get(s, 0) + n
    df = spark.createDataFrame([(i, s, n, "", 0) for i, (s, n) in enumerate(rows)], SCHEMA)
    got = {r.source: r.target for r in mixing.source_targets(df, "source", "size").collect()}
    assert got == pytest.approx(plain_targets(sizes))


ROWS = [(i, ["big", "a", "b", None][min(i % 9, 3)], i % 40, "old", i) for i in range(4000)] + [(None, "a", 5, "x", 1), (7, "a", None, "x", 1), (8, "b", 3, "x", 1), (8, "b", 3, "x", 1), (9, "zero", 0, "x", 1)]


def test_mix(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    out = mixing.mix(df).cache()
    assert out.count() == len(ROWS) and len(set(out.columns)) == len(out.columns)
    assert out.where("taken > 2 * coalesce(size, 0) OR copies > 2 OR copies < 0").count() == 0
    for r in out.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.max("size").alias("most"), F.first("source_size").alias("size"), F.sum("size").alias("sum")).collect():
        assert abs(r.taken - r.target) <= r.most / 2 and r["size"] == (r["sum"] or 0)
    again = mixing.mix(df.repartition(7)).select("doc_id", "source", "_x", "taken")
    assert again.exceptAll(out.select("doc_id", "source", "_x", "taken")).count() == 0


def test_ranges_do_not_change_the_mix(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    few, many = (mixing.mix(df, range_digits=d).select("doc_id", "source", "_x", "taken") for d in (1, 4))
    assert few.exceptAll(many).count() == 0


def test_repeated(spark):
    out = mixing.mix(spark.createDataFrame(ROWS, SCHEMA))
    rows = mixing.repeated(out)
    assert rows.columns == ["doc_id", "source", "size", "_x"]
    assert rows.agg(F.sum("size")).first()[0] == out.agg(F.sum("taken")).first()[0]


def test_empty_table(spark):
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0


def test_query(spark):
    assert compare(spark, op7_mix, OP7_SQL, "/root/testdata/sf0.001") == ""
