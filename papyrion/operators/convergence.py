"""Concentration of codes within groups, and contrasts within shared codes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean


def summaries(df: DataFrame, columns: list[str], group: str | None = None) -> DataFrame:
    """For each group and column: total coded, unique_values, dominant value (ties: the smallest),
    dominant_share, entropy / log2(k) (0 for one value), convergence = 1 - that. Blank codes do not
    count; a group without codes in a column has convergence 0."""
    g = [F.col(group).alias("group")] if group else [F.lit("all").alias("group")]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), clean(F.col(c)).alias("value")) for c in columns])
    counts = df.select(*g, F.explode(cells).alias("x")).select("group", "x.*").groupBy("group", "column", "value").agg(F.count("*").alias("n"))
    n = F.when(F.col("value") != "", F.col("n"))
    total = F.sum(n).over(Window.partitionBy("group", "column"))
    parts = counts.withColumn("t", F.coalesce(total, F.lit(0))).withColumn("p", n / F.when(F.col("t") > 0, F.col("t")))
    out = parts.groupBy("group", "column").agg(
        F.first("t").alias("total"), F.count(n).alias("unique_values"),
        F.min(F.when(F.col("value") != "", F.struct((-F.col("n")).alias("o"), F.col("value").alias("v")))).alias("top"), F.max("p").alias("dominant_share"),
        F.sum(-F.col("p") * F.log2("p")).alias("h"),
    )
    entropy = F.when(F.col("unique_values") > 1, F.col("h") / F.log2(F.col("unique_values").cast("double"))).otherwise(0.0)
    return out.select(
        "group", "column", "total", "unique_values", F.col("top.v").alias("dominant_value"), F.coalesce("dominant_share", F.lit(0.0)).alias("dominant_share"),
        entropy.alias("normalized_entropy"), F.when(F.col("total") > 0, 1 - entropy).otherwise(0.0).alias("convergence"),
    )


def convergence_by(df: DataFrame, columns: list[str], group: str, min_papers: int = 2) -> DataFrame:
    """Mean convergence over the columns, and fragmentation = 1 - mean, for each group of at least
    min_papers papers; blank groups are left out."""
    sizes = df.where(clean(F.col(group)) != "").groupBy(F.col(group).alias("group")).agg(F.count("*").alias("papers")).where(F.col("papers") >= min_papers)
    scores = summaries(df, columns, group).groupBy("group").agg(F.avg(F.round("convergence", 4)).alias("m"))
    return sizes.join(scores, "group").select("group", "papers", F.round("m", 4).alias("convergence"), F.round(1 - F.round("m", 4), 4).alias("fragmentation"))


def construct_contrast(df: DataFrame, shared: str, contrast: str, paper_id: str, examples: int = 5) -> DataFrame:
    """Shared values with two or more different contrast values: one row per (shared, contrast)
    value with its papers and first example ids (by id), and the shared value's totals. Examples
    come from a rank limit, so no group is collected."""
    rows = df.select(clean(F.col(shared)).alias("shared_value"), clean(F.col(contrast)).alias("contrast_value"), F.col(paper_id).alias("id")).where("shared_value <> ''")
    counts = rows.groupBy("shared_value", "contrast_value").agg(F.count("*").alias("papers"))
    whole = Window.partitionBy("shared_value")
    coded = F.col("contrast_value") != ""
    counts = counts.withColumn("contrast_values", F.count(F.when(coded, 1)).over(whole)).withColumn("shared_papers", F.sum("papers").over(whole)).where(coded & (F.col("contrast_values") > 1))
    first = rows.where(coded).withColumn("r", F.row_number().over(Window.partitionBy("shared_value", "contrast_value").orderBy("id"))).where(F.col("r") <= examples)
    first = first.groupBy("shared_value", "contrast_value").agg(F.array_join(F.array_sort(F.collect_list("id")), ";").alias("example_ids"))
    return counts.join(first, ["shared_value", "contrast_value"])
