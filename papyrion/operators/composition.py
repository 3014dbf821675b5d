"""Distributions, cross-tables and configurations of coded dimensions.

Two views throughout: "full" keeps blanks (as a labelled category) and excluded codes, "observed"
drops both and uses its own denominator. Every figure can be expanded to its rows by ``evidence``.
Ties are ordered by count descending, then value.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, or_missing, share
from papyrion.plans.registry import Panel, Scope

VIEWS = ("full", "observed")


def _check(view: str) -> None:
    if view not in VIEWS:
        raise ValueError(f"unknown view: {view}")


def filter_status(df: DataFrame, status: str, column: str, known: tuple[str, ...]) -> DataFrame:
    """Rows of one status; "all" is no filter, an absent column gives no rows, an unknown status is
    an error."""
    if status == "all":
        return df
    if status not in known:
        raise ValueError(f"unknown status: {status}")
    return df.where(clean(F.col(column)) == status) if column in df.columns else df.limit(0)


def distribution(df: DataFrame, panel: Panel, view: str = "full") -> DataFrame:
    """value, papers, share of the view's denominator. A frame without the column gives no rows."""
    _check(view)
    if panel.resolve(df) not in df.columns:
        return df.sparkSession.createDataFrame([], "value string, papers long, share double")
    rows = df.where(panel.observed(df)) if view == "observed" else df
    counts = rows.groupBy(or_missing(panel.value(df)).alias("value")).agg(F.count("*").alias("papers"))
    total = F.sum("papers").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("papers") / total)


def _long(df: DataFrame, panels: list[Panel], keep: list[str] = ()) -> DataFrame:
    """One row per (row, panel): panel, value, observed. One pass for all panels."""
    cells = [F.struct(F.lit(p.id).alias("panel"), or_missing(p.value(df)).alias("value"), p.observed(df).alias("observed")) for p in panels if p.resolve(df) in df.columns]
    return df.select(*keep, F.explode(F.array(*cells)).alias("x")).select(*keep, "x.*")


def composition(df: DataFrame, panels: list[Panel]) -> DataFrame:
    """All panels in both views from one shuffle: panel, value, papers, full_share, observed_papers,
    observed_share (null for a value that the observed view drops), rank among observed values, and
    charted (within the panel's top_n)."""
    counts = _long(df, panels).groupBy("panel", "value").agg(F.count("*").alias("papers"), F.sum(F.col("observed").cast("long")).alias("observed_papers"))
    whole = Window.partitionBy("panel")
    seen = F.col("observed_papers") > 0
    tops = F.element_at(F.create_map(*[x for p in panels for x in (F.lit(p.id), F.lit(p.top_n))]), F.col("panel"))
    rank = F.row_number().over(whole.orderBy(F.desc("observed_papers"), "value"))
    return (
        counts.withColumn("full_share", F.col("papers") / F.sum("papers").over(whole))
        .withColumn("observed_share", F.when(seen, F.col("observed_papers") / F.sum("observed_papers").over(whole)))
        .withColumn("rank", F.when(seen, rank).cast("long"))
        .withColumn("charted", seen & (rank <= tops))
    )


def relationship_matrix(df: DataFrame, row: Panel, column: Panel, view: str = "full") -> DataFrame:
    """A dense cross-table: row_value, column_value, papers and its shares of all, row and column.
    Cells without papers are kept; only the two axes, never the rows, are crossed."""
    _check(view)
    rows = df.where(row.observed(df) & column.observed(df)) if view == "observed" else df
    cells = rows.groupBy(or_missing(row.value(df)).alias("row_value"), or_missing(column.value(df)).alias("column_value")).agg(F.count("*").alias("papers"))
    axis = cells.groupBy("row_value").agg(F.lit(1).alias("k")).select("row_value", "k")
    columns = cells.agg(F.array_sort(F.collect_set("column_value")).alias("all")).select("all", F.lit(1).alias("k"))
    dense = axis.join(F.broadcast(columns), "k").select("row_value", F.explode("all").alias("column_value"))
    dense = dense.join(cells, ["row_value", "column_value"], "left").withColumn("papers", F.coalesce("papers", F.lit(0)))
    total = lambda *by: F.sum("papers").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    return dense.select(
        "row_value", "column_value", "papers", share(F.col("papers"), total()).alias("share_of_analyzed"),
        share(F.col("papers"), total("row_value")).alias("share_within_row"), share(F.col("papers"), total("column_value")).alias("share_within_column"),
    )


def recurring_configurations(df: DataFrame, panels: list[Panel], view: str = "full", min_support: int = 10) -> DataFrame:
    """Combinations of all panels' values with at least min_support papers; shares are of all
    analysed papers, the rarer combinations included."""
    _check(view)
    if min_support < 1:
        raise ValueError("min_support must be at least 1")
    rows = df
    if view == "observed":
        for p in panels:
            rows = rows.where(p.observed(df))
    counts = rows.groupBy(*[or_missing(p.value(df)).alias(p.id) for p in panels]).agg(F.count("*").alias("papers"))
    total = F.sum("papers").over(Window.partitionBy(F.lit(1)))
    return counts.withColumn("share", F.col("papers") / total).where(F.col("papers") >= min_support)


def nested_distributions(df: DataFrame, panels: list[Panel], paper_id: str) -> DataFrame:
    """For each value of each panel the distribution of every other panel, in both views. Papers with
    the same cells in all panels are counted first, so what is expanded to pairs of panels are the
    different combinations, as few as the categories allow."""
    cells = F.array(*[F.struct(F.lit(p.id).alias("d"), or_missing(p.value(df)).alias("v"), p.observed(df).alias("o")) for p in panels])
    combined = df.select(cells.alias("all")).groupBy("all").agg(F.count("*").alias("n"))
    pairs = combined.select("n", "all", F.explode("all").alias("c")).select("n", "c", F.explode("all").alias("x")).where("c.d <> x.d")
    counts = pairs.groupBy(F.col("c.d").alias("control"), F.col("c.v").alias("control_value"), F.col("x.d").alias("outcome"), F.col("x.v").alias("outcome_value")).agg(
        F.sum("n").alias("papers"), F.sum(F.when(F.col("c.o") & F.col("x.o"), F.col("n")).otherwise(0)).alias("observed_papers")
    )
    whole = Window.partitionBy("control", "control_value", "outcome")
    return counts.withColumn("share", F.col("papers") / F.sum("papers").over(whole)).withColumn("observed_share", share(F.col("observed_papers"), F.sum("observed_papers").over(whole)))


def _bits(populations: list[Scope]) -> Column:
    """The populations that a row is in, as a bitmap; a population's place is its bit."""
    bits = F.lit(0).cast("long")
    for i, s in enumerate(populations):
        bits = bits.bitwiseOR(F.when(s.predicate(), F.lit(1 << i)).otherwise(0).cast("long"))
    return bits.alias("bits")


def _by_population(rows: DataFrame, keys: list[str], populations: list[Scope]) -> DataFrame:
    """(keys, population, n) of rows with keys and bits. Rows alike in both are counted before they are
    expanded to populations."""
    counted = rows.where("bits <> 0").groupBy(*keys, "bits").agg(F.count("*").alias("n"))
    names = F.array(*[F.when(F.col("bits").bitwiseAND(F.lit(1 << i).cast("long")) != 0, F.lit(s.id)) for i, s in enumerate(populations)])
    return counted.select("n", *keys, F.explode(F.filter(names, lambda x: x.isNotNull())).alias("population")).groupBy(*keys, "population").agg(F.sum("n").alias("n"))


def population_tables(df: DataFrame, panels: list[Panel], populations: list[Scope]) -> DataFrame:
    """nested_distributions() for each of several overlapping populations, the population as an axis:
    population, control, control_value, outcome, outcome_value, papers, observed_papers and both shares.
    A row's populations are a bitmap beside its cells; rows alike in all of them are counted first, so
    one shuffle of the rows serves every population, control, outcome and view."""
    cells = F.array(*[F.struct(F.lit(p.id).alias("d"), or_missing(p.value(df)).alias("v"), p.observed(df).alias("o")) for p in panels])
    rows = _by_population(df.select(cells.alias("all"), _bits(populations)), ["all"], populations)
    pairs = rows.select("n", "all", "population", F.explode("all").alias("c")).select("n", "population", "c", F.explode("all").alias("x")).where("c.d <> x.d")
    keys = [F.col("c.d").alias("control"), F.col("c.v").alias("control_value"), F.col("x.d").alias("outcome"), F.col("x.v").alias("outcome_value")]
    seen = F.when(F.col("c.o") & F.col("x.o"), F.col("n")).otherwise(0)
    counts = pairs.groupBy("population", *keys).agg(F.sum("n").alias("papers"), F.sum(seen).alias("observed_papers"))
    whole = Window.partitionBy("population", "control", "control_value", "outcome")
    out = counts.withColumn("share", F.col("papers") / F.sum("papers").over(whole))
    return out.withColumn("observed_share", share(F.col("observed_papers"), F.sum("observed_papers").over(whole)))


def population_comparison(df: DataFrame, panel: Panel, populations: list[Scope], benchmark: str, view: str = "observed") -> DataFrame:
    """population, value, papers, share, benchmark_share, difference_pp: the panel's distribution in each of
    several overlapping populations against one of them. A value that the benchmark lacks has a share of 0
    there; a population without rows, none itself. One shuffle of the rows serves all populations."""
    _check(view)
    rows = df.where(panel.observed(df)) if view == "observed" else df
    counts = _by_population(rows.select(or_missing(panel.value(df)).alias("value"), _bits(populations)), ["value"], populations)
    shares = counts.withColumnRenamed("n", "papers").withColumn("share", F.col("papers") / F.sum("papers").over(Window.partitionBy("population")))
    own = F.max(F.when(F.col("population") == benchmark, F.col("share"))).over(Window.partitionBy("value"))
    out = shares.withColumn("benchmark_share", F.coalesce(own, F.lit(0.0)))
    return out.withColumn("difference_pp", (F.col("share") - F.col("benchmark_share")) * 100)


def population_configurations(df: DataFrame, panels: list[Panel], populations: list[Scope], benchmark: str, view: str = "observed", min_support: int = 10) -> DataFrame:
    """The benchmark's configurations with at least min_support papers, in every population: the panels'
    values, population, papers (0 where it has none), analyzed (the population's papers in this view, rarer
    configurations included) and share."""
    _check(view)
    if min_support < 1:
        raise ValueError("min_support must be at least 1")
    rows = df
    if view == "observed":
        for p in panels:
            rows = rows.where(p.observed(df))
    keys = [p.id for p in panels]
    counts = _by_population(rows.select(*[or_missing(p.value(df)).alias(p.id) for p in panels], _bits(populations)), keys, populations)
    each = F.explode(F.array(*[F.lit(s.id) for s in populations])).alias("population")
    grid = counts.where((F.col("population") == benchmark) & (F.col("n") >= min_support)).select(*keys, each)
    totals = counts.groupBy("population").agg(F.sum("n").alias("analyzed"))
    out = grid.join(counts, [*keys, "population"], "left").join(F.broadcast(totals), "population", "left")  # one row a population
    out = out.select(*keys, "population", F.coalesce("n", F.lit(0)).alias("papers"), F.coalesce("analyzed", F.lit(0)).alias("analyzed"))
    return out.withColumn("share", share(F.col("papers"), F.col("analyzed")))


def evidence(df: DataFrame, filters: dict[str, str], strict: bool = False, strip: bool = True) -> DataFrame:
    """The rows behind a figure: all filters hold. Unknown columns are ignored, or are an error if
    strict. ``strip`` compares cleaned values, else exact ones."""
    unknown = [c for c in filters if c not in df.columns]
    if unknown and strict:
        raise ValueError(f"unknown columns: {unknown}")
    for column, value in filters.items():
        if column in df.columns:
            df = df.where((clean(F.col(column)) if strip else F.col(column)) == value)
    return df


def ordered_evidence(df: DataFrame, year: str, citations: str, title: str, n: int) -> DataFrame:
    """The first n rows by year descending, citations descending, title."""
    return df.orderBy(F.desc_nulls_last(year), F.desc_nulls_last(citations), F.asc(title)).limit(n)


def distinct_values(df: DataFrame, column: str) -> DataFrame:
    """The different non-empty cleaned values of a column."""
    return df.select(clean(F.col(column)).alias("value")).where("value <> ''").distinct()


def pairwise_overlap(df: DataFrame, flags: dict[str, str]) -> DataFrame:
    """For each pair of flag predicates (SQL): sizes, intersection, union, Jaccard (0 for an empty
    union), all from one aggregation of one pass."""
    names = list(flags)
    marks = {n: F.coalesce(F.expr(flags[n]), F.lit(False)).cast("long") for n in names}
    sums = df.agg(*[F.sum(marks[n]).alias(f"n_{i}") for i, n in enumerate(names)], *[F.sum(marks[a] * marks[b]).alias(f"b_{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i < j])
    count = lambda c: F.coalesce(F.col(c), F.lit(0))
    pairs = [
        F.struct(F.lit(names[i]).alias("left_scope"), F.lit(names[j]).alias("right_scope"), count(f"n_{i}").alias("left_n"), count(f"n_{j}").alias("right_n"), count(f"b_{i}_{j}").alias("both_n"))
        for i in range(len(names)) for j in range(i + 1, len(names))
    ]
    out = sums.select(F.explode(F.array(*pairs)).alias("x")).select("x.*").withColumn("union_n", F.expr("left_n + right_n - both_n"))
    return out.withColumn("jaccard", share(F.col("both_n"), F.col("union_n")))


def horizontal_contrast(df: DataFrame, bridge: DataFrame, panel: Panel, key: str, group: str, view: str = "observed") -> DataFrame:
    """The panel's distribution in each (overlapping) group of the bridge against the whole frame's:
    group, value, papers, share, baseline_share, difference_pp. Values a group lacks count 0."""
    _check(view)
    rows = df.where(panel.observed(df)) if view == "observed" else df
    values = rows.select(key, or_missing(panel.value(df)).alias("value"))
    base = distribution(df, panel, view).select("value", F.col("share").alias("baseline_share"))
    counts = values.join(bridge.select(key, F.col(group).alias("group")).distinct(), key).groupBy("group", "value").agg(F.count("*").alias("papers"))
    grid = bridge.select(F.col(group).alias("group")).distinct().withColumn("k", F.lit(1)).join(F.broadcast(base.withColumn("k", F.lit(1))), "k").drop("k")  # a panel's values
    out = grid.join(counts, ["group", "value"], "left").withColumn("papers", F.coalesce("papers", F.lit(0)))
    out = out.withColumn("share", share(F.col("papers"), F.sum("papers").over(Window.partitionBy("group"))))
    return out.withColumn("difference_pp", (F.col("share") - F.col("baseline_share")) * 100)


def count_alignment(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Two count series (key, n) side by side with shares; a missing side counts 0, a ratio to 0 is
    null."""
    joined = left.select(key, F.col("n").alias("left_n")).join(right.select(key, F.col("n").alias("right_n")), key, "full_outer").fillna(0, ["left_n", "right_n"])
    total = lambda df, name: df.agg(F.coalesce(F.sum("n"), F.lit(0)).alias(name)).withColumn("k", F.lit(1))
    totals = total(left, "left_total").join(total(right, "right_total"), "k")
    out = joined.withColumn("k", F.lit(1)).join(F.broadcast(totals), "k").drop("k")  # one row
    out = out.withColumn("left_share", share(F.col("left_n"), F.col("left_total"))).withColumn("right_share", share(F.col("right_n"), F.col("right_total"))).drop("left_total", "right_total")
    return out.withColumn("difference_pp", (F.col("right_share") - F.col("left_share")) * 100).withColumn("ratio", F.try_divide("right_share", "left_share"))


def js_divergence(aligned: DataFrame) -> DataFrame:
    """The Jensen-Shannon divergence (base 2) of count_alignment()'s two shares, one row."""
    m = (F.col("left_share") + F.col("right_share")) / 2
    term = lambda p: F.when(F.col(p) > 0, F.col(p) * F.log2(F.col(p) / m)).otherwise(0.0)
    return aligned.agg((F.sum(term("left_share")) / 2 + F.sum(term("right_share")) / 2).alias("js_divergence"))
