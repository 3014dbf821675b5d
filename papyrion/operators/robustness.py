"""Whether findings hold for another rater, another kind of evidence or another population.

Everything is counted from ratings as in raters, units alike at once; raters are then compared by aggregates over the few rows of counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import or_missing, share
from papyrion.operators.composition import nested_distributions
from papyrion.operators.raters import counted
from papyrion.plans.registry import Panel


def evidence_modes(ratings: DataFrame, dimension: str, value: str, reference: str, comparison: str) -> DataFrame:
    """(unit, in_reference, in_comparison, n, mode): the units to which at least one of two raters gives a
    value; mode is both, reference or comparison, n how many units a unit stands for."""
    hits = counted(ratings).where((F.col("dimension") == dimension) & (F.col("value") == value) & F.col("rater").isin(reference, comparison))
    out = hits.groupBy("unit").agg(F.max(F.col("rater") == reference).alias("in_reference"), F.max(F.col("rater") == comparison).alias("in_comparison"), F.max("n").alias("n"))
    mode = F.when(F.col("in_reference") & F.col("in_comparison"), "both").when(F.col("in_reference"), "reference").otherwise("comparison")
    return out.withColumn("mode", mode)


def agreement_evidence(matches: DataFrame, raters: int, least: int) -> DataFrame:
    """pattern_agreement()'s units with ``least`` raters or more, and whether all agree."""
    if not 1 <= least <= raters:
        raise ValueError("least must be between 1 and the number of raters")
    return matches.where(F.col("n_agreeing") >= least).withColumn("unanimous", F.col("n_agreeing") == raters)


def contrast_directions(rated: DataFrame, group: str, left: str, right: str) -> DataFrame:
    """For each rater and value the share in group ``right`` less that in ``left`` and its sign (0
    within 1e-12), and whether all raters agree in the sign. rated: rater, value and the group."""
    times = lambda side: F.coalesce(F.sum(F.when(F.col(group) == side, F.col("n"))), F.lit(0))
    counts = counted(rated, by=[group]).where(F.col(group).isin(left, right) & F.col("value").isNotNull()).groupBy("rater", "value").agg(times(left).alias("l"), times(right).alias("r"))
    whole = Window.partitionBy("rater")
    diff = share(F.col("r"), F.sum("r").over(whole)) - share(F.col("l"), F.sum("l").over(whole))
    out = counts.withColumn("difference_pp", diff * 100)
    sign = F.when(F.abs(F.col("difference_pp")) <= 1e-10, 0).when(F.col("difference_pp") > 0, 1).otherwise(-1)
    out = out.withColumn("direction", sign)
    of_value = Window.partitionBy("value")
    return out.withColumn("retained", F.min("direction").over(of_value) == F.max("direction").over(of_value)).drop("l", "r")


def leading_by(rated: DataFrame, by: list[str]) -> DataFrame:
    """The commonest value (ties: the smallest) of every rater in each group, and whether all raters
    lead with the same."""
    counts = counted(rated, by=by).where("value IS NOT NULL").groupBy(*by, "rater", "value").agg(F.sum("n").alias("n"))
    first = counts.withColumn("r", F.row_number().over(Window.partitionBy(*by, "rater").orderBy(F.desc("n"), "value"))).where("r = 1").drop("r")
    group = Window.partitionBy(*by)
    return first.withColumn("same", F.min("value").over(group) == F.max("value").over(group))


def evidence_type_sensitivity(df: DataFrame, value: str, kind: str, by: list[str], wanted: str = "stated") -> DataFrame:
    """Per group and value: rows, those with the wanted kind of evidence, both shares, and the
    difference in percentage points."""
    counts = df.groupBy(*by, or_missing(F.col(value)).alias("value")).agg(F.count("*").alias("n"), F.count(F.when(F.col(kind) == wanted, 1)).alias("wanted"))
    whole = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    out = counts.withColumn("share", share(F.col("n"), F.sum("n").over(whole))).withColumn("wanted_share", share(F.col("wanted"), F.sum("wanted").over(whole)))
    return out.withColumn("difference_pp", (F.col("wanted_share") - F.col("share")) * 100)


def strongest_cells(df: DataFrame, panels: list[Panel], paper_id: str) -> DataFrame:
    """For each pair of panels the pair of values with the most papers (ties: the smaller values)."""
    order = F.element_at(F.create_map(*[x for i, p in enumerate(panels) for x in (F.lit(p.id), F.lit(i))]), F.col("control"))
    other = F.element_at(F.create_map(*[x for i, p in enumerate(panels) for x in (F.lit(p.id), F.lit(i))]), F.col("outcome"))
    cells = nested_distributions(df, panels, paper_id).where(order < other)
    first = F.row_number().over(Window.partitionBy("control", "outcome").orderBy(F.desc("papers"), "control_value", "outcome_value"))
    return cells.withColumn("r", first).where("r = 1").select("control", "outcome", "control_value", "outcome_value", "papers")


def supported_configurations(df: DataFrame, panels: list[Panel], populations: dict[str, Column], min_support: int) -> DataFrame:
    """Configurations with min_support papers in the union of (overlapping) populations, with their
    papers in each population, 0 included; all from one aggregation."""
    marks = {n: F.coalesce(p, F.lit(False)) for n, p in populations.items()}
    any_ = None
    for m in marks.values():
        any_ = m if any_ is None else any_ | m
    rows = df.where(any_).groupBy(*[or_missing(p.value(df)).alias(p.id) for p in panels])
    return rows.agg(F.count("*").alias("papers"), *[F.count(F.when(m, 1)).alias(n) for n, m in marks.items()]).where(F.col("papers") >= min_support)


def observability(df: DataFrame, panels: list[Panel], topic: str, n: int = 15) -> DataFrame:
    """(panel, topic, papers, percent): how many of each of the n largest topics' papers a panel
    observes."""
    cells = F.array(*[F.struct(F.lit(p.id).alias("panel"), p.observed(df).alias("seen")) for p in panels])
    rows = df.where(F.col(topic).isNotNull()).select(F.col(topic).alias("topic"), F.explode(cells).alias("x")).select("topic", "x.*")
    counts = rows.groupBy("panel", "topic").agg(F.count("*").alias("papers"), (100 * F.avg(F.col("seen").cast("double"))).alias("percent"))
    place = F.row_number().over(Window.partitionBy("panel").orderBy(F.desc("papers"), "topic"))
    return counts.withColumn("r", place).where(F.col("r") <= n).drop("r")
