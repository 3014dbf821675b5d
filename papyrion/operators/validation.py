"""Tables that hold raters against each other: prevalence, cross-tables, intersections, grounding of
evidence, confidence, and reliability over the units that all of them rated.

Ratings are as in raters, long or one row a unit; one rating a unit, rater and dimension, with blanks as
null. What is expanded to pairs or sets of raters are counted patterns, not units.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, number
from papyrion.operators.raters import counted, pair_matrix, per_unit

#: Raters whose sets intersections() lists: 2 ** 12 sets are held as one small table.
MOST_RATERS = 12


def prevalence(ratings: DataFrame, weight: str) -> DataFrame:
    """rater, dimension, category, n, denominator, prevalence, weighted_prevalence and the dimension's
    normalized_entropy by weight (0 for a single category). Blank values are no ratings."""
    counts = counted(ratings, weight).where("value IS NOT NULL").groupBy("rater", "dimension", F.col("value").alias("category")).agg(F.sum("n").alias("n"), F.sum(weight).alias("w"))
    whole = Window.partitionBy("rater", "dimension")
    out = counts.withColumn("denominator", F.sum("n").over(whole)).withColumn("p", F.try_divide("w", F.sum("w").over(whole)))
    surprise = F.when(F.col("p") > 0, -F.col("p") * F.log("p")).otherwise(0.0)
    k = F.count("*").over(whole)
    entropy = F.when(k > 1, F.sum(surprise).over(whole) / F.log(k.cast("double"))).otherwise(0.0)
    return out.select("rater", "dimension", "category", "n", "denominator", (F.col("n") / F.col("denominator")).alias("prevalence"), F.col("p").alias("weighted_prevalence"), entropy.alias("normalized_entropy"))


def _patterns(ratings: DataFrame) -> DataFrame:
    """(dimension, r, n): how many units have the same ratings r by the same raters."""
    ratings = counted(ratings).select("unit", "n", "dimension", F.struct("rater", F.coalesce("value", F.lit("")).alias("value")).alias("x"))
    return ratings.groupBy("unit", "dimension").agg(F.array_sort(F.collect_list("x")).alias("r"), F.max("n").alias("n")).groupBy("dimension", "r").agg(F.sum("n").alias("n"))


def confusion_tables(ratings: DataFrame) -> DataFrame:
    """left_rater, right_rater, dimension, left_value, right_value, n: the cross-table of every two raters
    over the units that both have, combinations without units included. A blank is a value of its own."""
    keys = ["left_rater", "right_rater", "dimension"]
    pairs = _patterns(ratings).select("dimension", "n", "r", F.explode("r").alias("a")).select("dimension", "n", "a", F.explode("r").alias("b")).where("a.rater < b.rater")
    pairs = pairs.select(F.col("a.rater").alias("left_rater"), F.col("b.rater").alias("right_rater"), "dimension", F.col("a.value").alias("left_value"), F.col("b.value").alias("right_value"), "n")
    cells = pairs.groupBy(*keys, "left_value", "right_value").agg(F.sum("n").alias("n"))
    axes = cells.groupBy(*keys).agg(F.collect_set("left_value").alias("l"), F.collect_set("right_value").alias("r"))
    grid = axes.select(*keys, "r", F.explode("l").alias("left_value")).select(*keys, "left_value", F.explode("r").alias("right_value"))
    return grid.join(cells, [*keys, "left_value", "right_value"], "left").fillna(0, ["n"])


def intersections(ratings: DataFrame, raters: list[str]) -> DataFrame:
    """raters ("a|b"), rater_count, units: for every set of two or more raters the units that all of them
    rated. A unit's raters are a bitmap; bitmaps are counted before any set is looked at."""
    if len(raters) > MOST_RATERS:
        raise ValueError(f"at most {MOST_RATERS} raters")
    spark = ratings.sparkSession
    bit = F.lit(0).cast("long")
    for i, r in enumerate(raters):
        bit = F.when(F.col("rater") == r, F.lit(1 << i).cast("long")).otherwise(bit)
    maps = counted(ratings).where("value IS NOT NULL").groupBy("unit").agg(F.bit_or(bit).alias("bits"), F.max("n").alias("n")).groupBy("bits").agg(F.sum("n").alias("n"))
    members = lambda s: [r for i, r in enumerate(raters) if s >> i & 1]
    sets = [(s, "|".join(members(s)), len(members(s))) for s in range(1 << len(raters)) if len(members(s)) > 1]
    table = spark.createDataFrame(sets, "set long, raters string, rater_count int")
    wanted = F.array(*[F.lit(s).cast("long") for s, _, _ in sets]) if sets else F.array().cast("array<bigint>")
    held = maps.select("n", F.explode(F.filter(wanted, lambda s: s.bitwiseAND(F.col("bits")) == s)).alias("set")).groupBy("set").agg(F.sum("n").alias("units"))
    return table.join(held, "set", "left").select("raters", "rater_count", F.coalesce("units", F.lit(0)).alias("units"))


def long_evidence(df: DataFrame, unit: str, rater: Column, dimensions: list[str], source: Column) -> DataFrame:
    """(unit, rater, source, dimension, kind, evidence, confidence) from the columns <dimension>_evidence_type,
    _evidence and _confidence; a confidence that is no number is null."""
    cells = [F.struct(F.lit(d).alias("dimension"), clean(F.col(f"{d}_evidence_type")).alias("kind"), F.col(f"{d}_evidence").alias("evidence"), number(F.col(f"{d}_confidence")).alias("confidence")) for d in dimensions]
    return df.select(F.col(unit).alias("unit"), rater.alias("rater"), source.alias("source"), F.explode(F.array(*cells)).alias("x")).select("unit", "rater", "source", "x.*")


def _plain(c: Column) -> Column:
    """Lower-case words with single spaces between them, whatever stood there."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^\p{L}\p{N}_]+", " "))


def grounding(evidence: DataFrame) -> DataFrame:
    """rater, dimension, stated_evidence_n, exact_match_n, exact_match_share: of stated evidence that is not
    empty, how much stands in its source (case, punctuation and white space aside). A rater's dimension
    without such evidence keeps its row, with a share of null."""
    text = _plain(F.col("evidence"))
    stated = (F.col("kind") == "stated") & (text != "")
    rows = evidence.select("rater", "dimension", F.coalesce(stated, F.lit(False)).alias("s"), F.contains(_plain(F.col("source")), text).alias("m"))
    out = rows.groupBy("rater", "dimension").agg(F.count(F.when(F.col("s"), 1)).alias("stated_evidence_n"), F.count(F.when(F.col("s") & F.col("m"), 1)).alias("exact_match_n"))
    return out.withColumn("exact_match_share", F.try_divide("exact_match_n", "stated_evidence_n"))


def confidence(evidence: DataFrame, kinds: tuple[str, ...] = ("stated", "inferred", "absent")) -> DataFrame:
    """rater, dimension, papers, mean_confidence, median_confidence, and <kind>_share for each kind. Equal
    confidences are counted first, so the exact median keeps different values, not rows."""
    by = ["rater", "dimension"]
    counts = evidence.groupBy(*by, "confidence").agg(F.count("*").alias("n"), *[F.count(F.when(F.col("kind") == k, 1)).alias(k) for k in kinds])
    seen = F.when(F.col("confidence").isNotNull(), F.col("n"))
    out = counts.groupBy(*by).agg(
        F.sum("n").alias("papers"), F.try_divide(F.sum(F.col("confidence") * F.col("n")), F.sum(seen)).alias("mean_confidence"),
        F.percentile("confidence", F.lit(0.5), F.col("n")).alias("median_confidence"), *[(F.sum(k) / F.sum("n")).alias(f"{k}_share") for k in kinds],
    )
    return out


def pair_reliability(ratings: DataFrame, core: list[str]) -> tuple[DataFrame, DataFrame]:
    """The pairs of raters (left_rater, right_rater, balanced_units, mean_percent_agreement, mean_alpha: plain
    means over the core dimensions that have a figure) and their dimensions (pair_matrix() with disagreements
    and classification). All figures are over the units that every rater rated."""
    ratings = counted(per_unit(ratings)) if "n" not in ratings.columns else ratings
    matrix = pair_matrix(ratings)
    dimensions = matrix.withColumn("disagreements", F.col("comparable") - F.col("agreements")).withColumn("classification", F.when(F.col("dimension").isin(core), "Core").otherwise("Exploratory"))
    raters = ratings.agg(F.count_distinct("rater")).first()[0]
    balanced = ratings.groupBy("unit").agg(F.count_distinct("rater").alias("m"), F.max("n").alias("n")).where(F.col("m") == raters).agg(F.sum("n")).first()[0] or 0
    own = lambda c: F.avg(F.when(F.col("dimension").isin(core), F.col(c)))
    pairs = matrix.groupBy("left_rater", "right_rater").agg(own("percent_agreement").alias("mean_percent_agreement"), own("alpha").alias("mean_alpha"))
    return pairs.withColumn("balanced_units", F.lit(balanced).cast("long")), dimensions


def rater_catalog(ratings: DataFrame, kinds: dict[str, str], dimensions: int, sample: int) -> DataFrame:
    """rater, kind ("human", "model" or what kinds says; null for others), available_units, completed_units (all
    dimensions rated) and provisional: a human rater who has not completed the sample."""
    units = counted(ratings).groupBy("rater", "unit").agg(F.count_distinct(F.when(F.col("value").isNotNull(), F.col("dimension"))).alias("d"), F.max("n").alias("n"))
    out = units.groupBy("rater").agg(F.sum("n").alias("available_units"), F.coalesce(F.sum(F.when(F.col("d") >= dimensions, F.col("n"))), F.lit(0)).alias("completed_units"))
    kind = F.coalesce(*[F.when(F.col("rater") == r, F.lit(k)) for r, k in kinds.items()], F.lit(None).cast("string"))
    return out.withColumn("kind", kind).withColumn("provisional", F.coalesce(F.col("kind") == "human", F.lit(False)) & (F.col("completed_units") < sample))
