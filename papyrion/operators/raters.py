"""Agreement between raters: percent agreement, nominal alpha, thresholds, consensus, prevalence.

Ratings are long, (unit, rater, dimension, value), or one row a unit, (unit, x) with its ratings x as a
list (unit_rows). Blank values are no ratings. Statistics over many raters come from counts; units with
the same ratings are one unit that counts n times (counted), and only pair_matrix, which reports on pairs
of raters, makes the pairs of such a unit's few ratings.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, clean_or_null, share
from papyrion.operators.sampling import pair_metrics
from papyrion.plans.tables import written


def long_ratings(df: DataFrame, unit: str, rater: Column, dimensions: list[str]) -> DataFrame:
    """(unit, rater, dimension, value) with blanks as null, one pass."""
    cells = F.array(*[F.struct(F.lit(c).alias("dimension"), clean_or_null(F.col(c)).alias("value")) for c in dimensions])
    return df.select(F.col(unit).alias("unit"), rater.alias("rater"), F.explode(cells).alias("x")).select("unit", "rater", "x.*")


def unit_rows(units: DataFrame, cells: dict[str, dict[str, Column]], keep: list[str] = ()) -> DataFrame:
    """(unit, x, *keep): rows of one unit each with their ratings as a list of (rater, dimension, value),
    from cells, {rater: {dimension: value}}. Nothing is exploded before units are counted."""
    x = [F.struct(F.lit(r).alias("rater"), F.lit(d).alias("dimension"), v.cast("string").alias("value")) for r, dimensions in cells.items() for d, v in dimensions.items()]
    return units.select("unit", F.array(*x).alias("x"), *keep)


def per_unit(ratings: DataFrame) -> DataFrame:
    """(unit, x): unit_rows() as they are, long ratings gathered to them, in one order of x."""
    if "x" in ratings.columns:
        return ratings
    return ratings.groupBy("unit").agg(F.array_sort(F.collect_list(F.struct("rater", "dimension", "value"))).alias("x"))


def counted(ratings: DataFrame, weight: str | None = None, by: list[str] = ()) -> DataFrame:
    """Long ratings with n, how many units a unit stands for, and the units' summed weight. Of unit_rows()
    those alike in their ratings, and in ``by``, become one unit; they are written once, since statistics
    read them several times. Long ratings are given n = 1."""
    if "x" not in ratings.columns:
        return ratings if "n" in ratings.columns else ratings.withColumn("n", F.lit(1).cast("long"))
    sums = [F.sum(weight).alias(weight)] if weight else []
    alike = written(ratings.groupBy(*by, "x").agg(F.count("*").alias("n"), *sums).withColumn("unit", F.monotonically_increasing_id()), "ratings")
    held = ["unit", "n", *by, *([weight] if weight else [])]
    return alike.select(*held, F.explode("x").alias("c")).select(*held, "c.rater", "c.dimension", clean_or_null(F.col("c.value")).alias("value"))


def rated(ratings: DataFrame) -> DataFrame:
    """The ratings that are not blank."""
    if "x" not in ratings.columns:
        return ratings.where("value IS NOT NULL")
    return ratings.withColumn("x", F.filter("x", lambda c: clean_or_null(c["value"]).isNotNull()))


def percent_agreement(pairs: DataFrame, left: str, right: str, by: list[str] = ()) -> DataFrame:
    """comparable, agreements and their ratio (null if none is comparable) of two aligned columns."""
    a, b = clean_or_null(F.col(left)), clean_or_null(F.col(right))
    rows = pairs.groupBy(*by) if by else pairs.groupBy()
    out = rows.agg(F.count(F.when(a.isNotNull() & b.isNotNull(), 1)).alias("comparable"), F.count(F.when(a == b, 1)).alias("agreements"))
    return out.withColumn("percent_agreement", F.try_divide(F.col("agreements").cast("double"), F.col("comparable").cast("double")))


def nominal_alpha(ratings: DataFrame, by: list[str] = ()) -> DataFrame:
    """Nominal alpha per group: 1 - D_o / D_e. D_o is the share of unequal pairs among all pairs
    within units; D_e comes from all pooled ratings, those of units with a single rating included.
    Null without pairs; with D_e = 0 it is 1 if D_o is 0, else null."""
    by = list(by)
    cells = counted(ratings).where("value IS NOT NULL").groupBy(*by, "unit", "value").agg(F.count("*").alias("r"), F.max("n").alias("n"))
    choose2 = lambda c: c * (c - 1) / 2
    units = cells.groupBy(*by, "unit").agg(F.sum("r").alias("m"), F.sum(choose2(F.col("r"))).alias("same"), F.max("n").alias("n"))
    key = by or [F.lit(1).alias("_k")]
    observed = units.groupBy(*key).agg(F.sum(choose2(F.col("m")) * F.col("n")).alias("pairs"), F.sum(F.col("same") * F.col("n")).alias("same"), F.coalesce(F.sum(F.when(F.col("m") > 1, F.col("n"))), F.lit(0)).alias("units"))
    pooled = cells.groupBy(*key, "value").agg(F.sum(F.col("r") * F.col("n")).alias("c")).groupBy(*(by or ["_k"])).agg(F.sum("c").alias("total"), F.sum(F.col("c") * (F.col("c") - 1)).alias("cc"))
    out = observed.join(pooled, by or ["_k"])
    d_o, d_e = 1 - F.col("same") / F.col("pairs"), 1 - F.col("cc") / (F.col("total") * (F.col("total") - 1))
    alpha = F.when(F.col("pairs") > 0, F.when(F.col("cc") == F.col("total") * (F.col("total") - 1), F.when(F.col("same") == F.col("pairs"), 1.0)).otherwise(1 - d_o / d_e))
    return out.select(*by, "units", F.col("pairs").cast("long").alias("pairs"), F.col("total").alias("ratings"), alpha.alias("alpha"))


def balanced_units(ratings: DataFrame, raters: int) -> DataFrame:
    """Units that all raters rated."""
    own = F.array_distinct(F.filter(F.transform("x", lambda c: c["rater"]), lambda r: r.isNotNull()))
    return per_unit(ratings).where(F.size(own) == raters).select("unit")


def pair_matrix(ratings: DataFrame) -> DataFrame:
    """Percent agreement and alpha of every pair of raters and dimension on the units that all raters
    rated. Units with the same ratings meet once, whatever their number: pairs are made within the
    ratings that they have in common. Raters are few."""
    ratings = counted(per_unit(ratings)) if "n" not in ratings.columns else ratings
    raters = ratings.agg(F.count_distinct("rater")).first()[0]
    # Each rater has at most one rating of a dimension; a unit's raters may be spread over its dimensions.
    maps = ratings.groupBy("unit", "dimension").agg(F.array_sort(F.collect_list(F.struct("rater", "value"))).alias("r"), F.max("n").alias("n"))
    units = maps.groupBy("unit").agg(F.collect_list(F.struct("dimension", "r")).alias("dimensions"), F.max("n").alias("n"))
    everyone = F.array_distinct(F.flatten(F.transform("dimensions", lambda d: F.transform(d["r"], lambda x: x["rater"]))))
    rows = units.where(F.size(everyone) == raters).select("unit", "n", F.explode("dimensions").alias("d")).select("unit", "n", "d.dimension", "d.r")
    pairs = rows.select("unit", "n", "dimension", "r", F.explode("r").alias("a")).select("unit", "n", "dimension", "a", F.explode("r").alias("b")).where("a.rater < b.rater")
    pairs = pairs.select("unit", "n", "dimension", *[F.col(f"{x}.{c}").alias(f"{s}_{c}") for x, s in (("a", "left"), ("b", "right")) for c in ("rater", "value")])
    keys = ["left_rater", "right_rater", "dimension"]
    both = F.col("left_value").isNotNull() & F.col("right_value").isNotNull()
    times = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    agreement = pairs.groupBy(*keys).agg(times(both).alias("comparable"), times(F.col("left_value") == F.col("right_value")).alias("agreements"))
    agreement = agreement.withColumn("percent_agreement", F.try_divide(F.col("agreements").cast("double"), F.col("comparable").cast("double")))
    long = pairs.where(both).select(*keys, "unit", "n", F.explode(F.array("left_value", "right_value")).alias("value"))
    return agreement.join(nominal_alpha(long, keys).select(*keys, "alpha"), keys, "left")


def three_layers(pairs: DataFrame, left: str, right: str, excluded: list[str], by: list[str] = ()) -> DataFrame:
    """Agreement on the full categories, on whether a code is observed, and on the categories where
    both observe: layer, comparable, agreements, percent_agreement."""
    seen = lambda c: F.when(F.col(c).isin(*excluded), "no").otherwise("yes")
    layers = [
        ("full", F.col(left), F.col(right)),
        ("observability", seen(left), seen(right)),
        ("jointly_observed", F.when(seen(left) == "yes", F.col(left)), F.when(seen(right) == "yes", F.col(right))),
    ]
    rows = pairs.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("layer"), a.alias("a"), b.alias("b")) for n, a, b in layers])).alias("x")).select(*by, "x.*")
    return percent_agreement(rows, "a", "b", [*by, "layer"])


def multirater_summary(ratings: DataFrame, by: list[str] = ("dimension",)) -> DataFrame:
    """units with two or more ratings, the share of them that are unanimous, and alpha."""
    by = list(by)
    rows = counted(ratings).where("value IS NOT NULL")
    units = rows.groupBy(*by, "unit").agg(F.count("*").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("n").alias("n")).where("m > 1")
    unanimous = F.coalesce(F.sum(F.when(F.col("lo") == F.col("hi"), F.col("n"))), F.lit(0))
    out = units.groupBy(*by).agg(F.sum("n").alias("units"), (unanimous / F.sum("n")).alias("unanimous_share"))
    usable = rows.join(units.select(*by, "unit"), [*by, "unit"], "left_semi")
    return out.join(nominal_alpha(usable, by).select(*by, "alpha"), by)


def normalized_entropy(df: DataFrame, value: str, weight: Column, by: list[str] = ()) -> DataFrame:
    """Weighted entropy of a column over ln k, 0 for one value."""
    counts = df.groupBy(*by, clean(F.col(value)).alias("v")).agg(F.sum(weight).alias("w")).where("v <> ''")
    total = F.sum("w").over(Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1)))
    p = counts.withColumn("p", F.col("w") / total)
    out = p.groupBy(*by).agg(F.count("*").alias("categories"), F.sum(-F.col("p") * F.log("p")).alias("h"))
    return out.withColumn("normalized_entropy", F.when(F.col("categories") > 1, F.col("h") / F.log(F.col("categories").cast("double"))).otherwise(0.0)).drop("h")


def weighted_prevalence(df: DataFrame, value: str, weight: str, by: list[str] = ()) -> DataFrame:
    """n, share, weight total and weighted share of each value."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"), F.sum(weight).alias("weight"))
    w = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(1))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("weighted_share", F.col("weight") / F.sum("weight").over(w))


def confusion(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """left_value, right_value, n and its share of the left value's rows."""
    counts = pairs.groupBy(F.col(left).alias("left_value"), F.col(right).alias("right_value")).agg(F.count("*").alias("n"))
    return counts.withColumn("share_of_left", F.col("n") / F.sum("n").over(Window.partitionBy("left_value")))


def agreement_curve(matches: DataFrame, raters: int) -> DataFrame:
    """From one agreement count per unit (column n_agreeing; n, if there is one, says how many units it
    stands for): for each threshold 1..raters the units with at least so many, and their share."""
    n = F.col("n") if "n" in matches.columns else F.lit(1)
    times = lambda c: F.coalesce(F.sum(F.when(c, n)), F.lit(0)).cast("long")
    sums = matches.agg(times(F.lit(True)).alias("units"), *[times(F.col("n_agreeing") >= t).alias(f"t{t}") for t in range(1, raters + 1)])
    rows = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"t{t}").alias("papers"), "units") for t in range(1, raters + 1)])
    out = sums.select(F.explode(rows).alias("x")).select("x.*")
    return out.select("threshold", "papers", share(F.col("papers"), F.col("units")).alias("share"))


def pattern_agreement(ratings: DataFrame, pattern: dict[str, str]) -> DataFrame:
    """For each unit that has any, how many raters give it every value of a pattern (dimension -> value);
    of counted() ratings with n, how many units it stands for."""

    def hit(c: Column) -> Column:
        found = F.lit(False)
        for dimension, value in pattern.items():
            found = found | ((c["dimension"] == dimension) & (clean_or_null(c["value"]) == value))
        return found

    if "n" in ratings.columns:
        found = ratings.where(hit({c: F.col(c) for c in ("dimension", "value")})).groupBy("unit", "rater", "n").agg(F.count_distinct("dimension").alias("d"))
        return found.where(F.col("d") == len(pattern)).groupBy("unit", "n").agg(F.count("*").alias("n_agreeing"))
    x = F.array_distinct(F.transform(F.filter("x", hit), lambda c: F.struct(c["rater"].alias("rater"), c["dimension"].alias("dimension"))))
    hits = per_unit(ratings).select("unit", F.transform(x, lambda c: c["rater"]).alias("h"))
    full = F.filter(F.array_distinct("h"), lambda r: F.size(F.filter("h", lambda s: s == r)) == len(pattern))
    return hits.select("unit", F.size(full).cast("long").alias("n_agreeing")).where("n_agreeing > 0")


def consensus(ratings: DataFrame, raters: int, excluded: list[str]) -> DataFrame:
    """Per dimension, of units that all raters rated: how many are unanimous on an observed and on an
    unobserved code."""
    rows = counted(ratings).where("value IS NOT NULL")
    units = rows.groupBy("dimension", "unit").agg(F.count_distinct("rater").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"), F.max("n").alias("n")).where(F.col("m") == raters)
    same, unseen = F.col("lo") == F.col("hi"), F.col("lo").isin(*excluded)
    times = lambda c: F.coalesce(F.sum(F.when(c, F.col("n"))), F.lit(0))
    return units.groupBy("dimension").agg(F.sum("n").alias("units"), times(same & ~unseen).alias("observed_consensus"), times(same & unseen).alias("unobserved_consensus"))


def leaders(ratings: DataFrame, by: list[str]) -> DataFrame:
    """The commonest value of each rater in each group (ties: the smallest) with its share."""
    counts = counted(ratings).where("value IS NOT NULL").groupBy(*by, "rater", "value").agg(F.sum("n").alias("n"))
    whole = Window.partitionBy(*by, "rater")
    out = counts.withColumn("share", F.col("n") / F.sum("n").over(whole)).withColumn("r", F.row_number().over(whole.orderBy(F.desc("n"), "value")))
    return out.where("r = 1").drop("r")


#: Draws whose tables are held at once.
DRAWS_AT_ONCE = 256


def bootstrap_interval(pairs: DataFrame, left: str, right: str, weight: str | None = None, draws: int = 2000, seed: int = 20260711) -> dict[str, float | int | None]:
    """Agreement of two columns on the rows where neither is blank: comparable, agreements,
    percent_agreement, weighted_percent_agreement, alpha, and the 2.5 and 97.5 per cent bootstrap
    quantiles of agreement and alpha. All but the counts are None without such rows.

    Spark makes the table of category pairs. Resampling rows is a multinomial draw of that table's
    cells, and the statistics of many draws are one matrix product, so that no row is resampled; the
    table is as small as the categories. Draws whose alpha is undefined (all disagree in no category
    that repeats) are left out of its interval; without weights each row weighs 1.
    """
    rows = pairs.select(clean_or_null(F.col(left)).alias("l"), clean_or_null(F.col(right)).alias("r"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    cells = rows.where("l IS NOT NULL AND r IS NOT NULL").groupBy("l", "r").agg(F.count("*").alias("n"), F.sum("w").alias("w")).orderBy("l", "r").collect()
    out: dict[str, float | int | None] = dict.fromkeys(("percent_agreement", "weighted_percent_agreement", "alpha", "agreement_low", "agreement_high", "alpha_low", "alpha_high"))
    n = np.array([r.n for r in cells], np.int64)
    if not len(cells):
        return {"comparable": 0, "agreements": 0} | out
    names = {v: i for i, v in enumerate(sorted({r.l for r in cells} | {r.r for r in cells}))}
    a, b = np.array([names[r.l] for r in cells]), np.array([names[r.r] for r in cells])
    weights, same = np.array([r.w or 0.0 for r in cells]), a == b
    agreement, alpha = pair_metrics(n[None, :], a, b)
    rng, found = np.random.default_rng(seed), []
    for at in range(0, draws, DRAWS_AT_ONCE):
        found.append(pair_metrics(rng.multinomial(n.sum(), n / n.sum(), size=min(DRAWS_AT_ONCE, draws - at)), a, b))
    agreements, alphas = (np.concatenate(x) for x in zip(*found, strict=True))
    alphas = alphas[~np.isnan(alphas)]
    between = lambda x: [float(np.quantile(x, q)) for q in (0.025, 0.975)] if len(x) else [None, None]
    weighted = float(weights[same].sum() / weights.sum()) if weights.sum() else None
    figures = [float(agreement[0]), weighted, None if np.isnan(alpha[0]) else float(alpha[0]), *between(agreements), *between(alphas)]
    return {"comparable": int(n.sum()), "agreements": int(n[same].sum())} | dict(zip(out, figures, strict=True))
