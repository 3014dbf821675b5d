"""Production and growth over years, and performance summaries."""

from __future__ import annotations

from math import floor

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, split_list
from papyrion.operators.packing import ranked


def performance_summary(df: DataFrame, citations: str, year: str) -> DataFrame:
    """One row: papers, citation total, mean and median, share of cited papers, first and last year."""
    c = F.coalesce(F.col(citations), F.lit(0.0))
    return df.agg(
        F.count("*").alias("papers"), F.sum(c).alias("citations"), F.avg(c).alias("mean_citations"), F.median(c).alias("median_citations"),
        F.avg((c > 0).cast("double")).alias("cited_share"), F.min(year).alias("first_year"), F.max(year).alias("last_year"),
    )


def annual_production(df: DataFrame, year: str, citations: str | None = None) -> DataFrame:
    """year, papers, cumulative (and citations): dense between the first and last year."""
    aggs = [F.count("*").alias("papers")] + ([F.sum(citations).alias("citations")] if citations else [])
    counts = df.where(F.col(year) > 0).groupBy(F.col(year).cast("int").alias("year")).agg(*aggs)
    years = counts.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a IS NOT NULL").select(F.explode(F.sequence("a", "b")).alias("year"))
    out = years.join(counts, "year", "left").fillna(0)
    return out.withColumn("cumulative", F.sum("papers").over(Window.orderBy("year").rowsBetween(Window.unboundedPreceding, 0)))


def growth_periods(df: DataFrame, year: str, periods: list[tuple[int, int]]) -> DataFrame:
    """For each (start, end): papers up to each, those added, growth (null from an empty start), in
    one pass: papers up to a year are those with 0 < year <= it."""
    up_to = lambda y: F.sum(((F.col(year) > 0) & (F.col(year) <= y)).cast("long"))
    sums = df.agg(*[up_to(y).alias(f"y{y}") for y in sorted({y for p in periods for y in p})])
    rows = F.array(*[F.struct(F.lit(a).alias("start_year"), F.lit(b).alias("end_year"), F.col(f"y{a}").alias("start_stock"), F.col(f"y{b}").alias("end_stock")) for a, b in periods])
    out = sums.select(F.explode(rows).alias("x")).select("x.*").withColumn("added", F.col("end_stock") - F.col("start_stock"))
    return out.withColumn("growth", F.try_divide(F.col("added").cast("double"), F.nullif(F.col("start_stock"), F.lit(0)).cast("double")))


def cumulative_trace(df: DataFrame, year: str, first: int, last: int, group: str | None = None) -> DataFrame:
    """(group,) year, added, cumulative for every year of the window; papers before it count in the
    starting stock."""
    g = F.col(group) if group else F.lit("all")
    rows = df.where((F.col(year) > 0) & (F.col(year) <= last)).select(g.alias("group"), F.greatest(F.col(year), F.lit(first - 1)).cast("int").alias("year"))
    counts = rows.groupBy("group", "year").agg(F.count("*").alias("added"))
    grid = counts.select("group").distinct().select("group", F.explode(F.sequence(F.lit(first - 1), F.lit(last))).alias("year"))
    out = grid.join(counts, ["group", "year"], "left").fillna(0, ["added"])
    w = Window.partitionBy("group").orderBy("year").rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("cumulative", F.sum("added").over(w)).where(F.col("year") >= first)


def top_groups(df: DataFrame, group: Column, n: int, citations: str | None = None) -> DataFrame:
    """The n largest groups by papers (ties: the smaller value), blanks left out."""
    aggs = [F.count("*").alias("papers")] + ([F.sum(citations).alias("citations")] if citations else [])
    counts = df.groupBy(clean(group).alias("value")).agg(*aggs).where("value <> ''")
    return counts.orderBy(F.desc("papers"), "value").limit(n)


def top_listed(df: DataFrame, column: str, n: int, placeholder: str = "") -> DataFrame:
    """top_groups() of the parts of a ";" list, a placeholder left out."""
    rows = df.select(F.explode(F.array_distinct(split_list(F.col(column)))).alias("part")).where(F.col("part") != placeholder)
    return top_groups(rows, F.col("part"), n)


def most_cited(df: DataFrame, citations: str, paper_id: str, n: int) -> DataFrame:
    return df.orderBy(F.desc_nulls_last(citations), paper_id).limit(n)


def rank_quantile(share: float, n: int) -> float:
    """A quantile of 1..n by linear interpolation. Where it falls on a rank, rounding decides on which
    side of it: the share goes by percent, and the nearer rank is interpolated from."""
    place = (n - 1) * (share * 100 / 100)
    below = floor(place)
    part, step = place - below, 1 if below + 1 < n else 0
    return 1 + below + step * part if part < 0.5 else 1 + below + step - step * (1 - part)


def tertiles(df: DataFrame, value: str, order: list, n: int) -> DataFrame:
    """df with tertile 1..3 of the rank by (value, order), cut as quantile bins are: the edges are
    the 1/3 and 2/3 quantiles of 1..n by linear interpolation, rounded as numpy's percentiles are.
    n is the count of df. Ranks come from ranges of (value, order), so rows of one value are spread."""
    cuts = [rank_quantile(1 / 3, n), rank_quantile(2 / 3, n)]
    rank = F.col("_rank")
    placed = ranked(df, [F.col(value), *order], name="_rank")
    return placed.withColumn("tertile", F.when(rank <= cuts[0], 1).when(rank <= cuts[1], 2).otherwise(3)).drop("_rank")
