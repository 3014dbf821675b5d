"""Stratified sampling with exact sizes, and its stability."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def strata(df: DataFrame, parts: list[Column]) -> DataFrame:
    """df with stratum: the parts joined by "|"."""
    return df.withColumn("stratum", F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("nan")) for p in parts]))


def size_band(df: DataFrame, group: str, bounds: list[tuple[str, int]]) -> DataFrame:
    """df with band: the first (name, largest size) that holds the size of the row's group."""
    sizes = df.groupBy(group).agg(F.count("*").alias("_n"))
    band = F
    for name, most in bounds:
        band = band.when(F.col("_n") <= most, F.lit(name))
    return df.join(sizes, group).withColumn("band", band).drop("_n")


def proportional_allocation(sizes: dict[str, int], n: int) -> dict[str, int]:
    """An exact allocation of n to strata: the whole part of each proportional share, at least 1 and
    at most the stratum, then single units to the largest (or from the least) remaining difference;
    ties go to the first stratum by name. Strata are few, so this runs on the driver."""
    names, total = sorted(sizes), sum(sizes.values())
    if not len(names) <= n <= total:
        raise ValueError("the sample must cover every stratum and not exceed the population")
    ideal = {s: sizes[s] * n / total for s in names}
    out = {s: min(sizes[s], max(1, int(ideal[s]))) for s in names}
    while (missing := n - sum(out.values())) != 0:
        step = 1 if missing > 0 else -1
        able = [s for s in names if (out[s] < sizes[s] if step > 0 else out[s] > 1)]
        out[max(able, key=lambda s: step * (ideal[s] - out[s]))] += step
    return out


def draw_stratified(df: DataFrame, key: str, allocation: dict[str, int], seed: int) -> DataFrame:
    """Exactly allocation[stratum] rows of each stratum, in the order of a seeded hash of the key:
    simple random samples without replacement, the same on every run. Adds population, sample,
    selection_probability and weight. The rank limit applies before the shuffle."""
    spark = df.sparkSession
    wanted = F.broadcast(spark.createDataFrame(sorted(allocation.items()), "stratum string, sample int"))  # one row a stratum
    draw = F.row_number().over(Window.partitionBy("stratum").orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key))
    sizes = df.groupBy("stratum").agg(F.count("*").alias("population"))
    most = max(allocation.values())
    out = df.withColumn("draw", draw).where(F.col("draw") <= most).join(wanted, "stratum").where("draw <= sample").join(sizes, "stratum")
    return out.withColumn("selection_probability", F.col("sample") / F.col("population")).withColumn("weight", F.col("population") / F.col("sample"))


def _drawn(rng: np.random.Generator, own: int, others: int, take: np.ndarray) -> np.ndarray:
    """How many of each number of rows drawn without replacement are of a kind. Beyond what numpy draws
    exactly (a billion rows), by the normal distribution of the same mean and variance."""
    if max(own, others) < 10**9:
        return rng.hypergeometric(own, others, take)
    total = own + others
    p = own / total
    spread = np.sqrt(take * p * (1 - p) * (total - take) / (total - 1))
    return np.clip(np.rint(rng.normal(take * p, spread)), np.maximum(0, take - others), np.minimum(take, own)).astype(np.int64)


def pair_metrics(counts: np.ndarray, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Percent agreement and nominal alpha of tables of category pairs, a row of counts each; left and
    right are the categories of its cells. Alpha is 1 if all is one category, NaN where it is undefined."""
    n = counts.sum(axis=1)
    agree = counts[:, left == right].sum(axis=1)
    side = np.zeros((counts.shape[1], int(max(left.max(), right.max())) + 1))
    np.add.at(side, (np.arange(len(left)), left), 1)
    np.add.at(side, (np.arange(len(right)), right), 1)
    pooled = counts @ side
    with np.errstate(divide="ignore", invalid="ignore"):
        observed = 1 - agree / n
        expected = 1 - (pooled * (pooled - 1)).sum(axis=1) / (2.0 * n * (2 * n - 1))
        alpha = np.where(np.abs(expected) < 1e-15, np.where(agree == n, 1.0, np.nan), 1 - observed / expected)
        return agree / n, alpha


def _aligned(df: DataFrame, dimensions: dict[str, tuple[str, str]]) -> DataFrame:
    """(stratum, dimension, l, r, n): the cells of all dimensions, from one pass; blanks are a category."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    cells = F.array(*[F.struct(F.lit(d).alias("dimension"), text(a).alias("l"), text(b).alias("r")) for d, (a, b) in dimensions.items()])
    rows = df.select("stratum", F.explode(cells).alias("x")).select("stratum", "x.*")
    return rows.groupBy("stratum", "dimension", "l", "r").agg(F.count("*").alias("n"))


ESTIMATES = "fraction double, sample_size long, dimension string, replicate int, percent_agreement double, alpha double, rare int, rare_found int"
#: Replicates that one task draws.
REPLICATES_A_TASK = 250


def replicate_estimates(df: DataFrame, dimensions: dict[str, tuple[str, str]], fractions: list[float], replicates: int, seed: int, population: int | None = None) -> DataFrame:
    """ESTIMATES rows: agreement and alpha of the two raters' columns (dimension -> left, right) in
    stratified samples, and how many of the rare categories (of one rater, under 1 % of rows) are in it.

    A sample has ceil(population * fraction) rows, allocated to strata by largest differences. None is
    copied: of a stratum's cells (left, right) a sample takes multivariate hypergeometric numbers,
    drawn cell after cell for all replicates at once. A task holds the cells of one dimension.
    """
    sizes = {r.stratum: r.n for r in df.groupBy("stratum").agg(F.count("*").alias("n")).collect()}
    if population is not None and population < sum(sizes.values()):
        raise ValueError("the target population is smaller than the frame")
    if not sizes:
        return df.sparkSession.createDataFrame([], ESTIMATES)
    basis = population or sum(sizes.values())
    wanted = [(f, int(np.ceil(basis * f))) for f in fractions]
    taken = {f: proportional_allocation(sizes, n) for f, n in wanted}

    def draw(pdf: pd.DataFrame) -> pd.DataFrame:
        fraction, block, dimension = float(pdf.fraction.iloc[0]), int(pdf.block.iloc[0]), pdf.dimension.iloc[0]
        n = min(REPLICATES_A_TASK, replicates - block * REPLICATES_A_TASK)
        pdf = pdf.sort_values(["stratum", "l", "r"])
        names = sorted({*pdf.l, *pdf.r})
        codes = {v: i for i, v in enumerate(names)}
        cells = pdf[["l", "r"]].drop_duplicates().sort_values(["l", "r"])
        at = {(a, b): i for i, (a, b) in enumerate(zip(cells.l, cells.r, strict=True))}
        left, right = np.array([codes[v] for v in cells.l]), np.array([codes[v] for v in cells.r])
        rng = np.random.default_rng([seed, *np.frombuffer(f"{dimension}|{fraction}|{block}".encode(), np.uint8).tolist()])
        counts = np.zeros((n, len(at)), np.int64)
        for stratum, own in pdf.groupby("stratum", sort=True):
            rest, open_ = int(own.n.sum()), np.full(n, taken[fraction][stratum], np.int64)
            for a, b, size in zip(own.l, own.r, own.n, strict=True):
                rest -= int(size)
                found = _drawn(rng, int(size), rest, open_) if rest else open_
                counts[:, at[a, b]] += found
                open_ = open_ - found
        agreement, alpha = pair_metrics(counts, left, right)
        whole = pdf.groupby(["l", "r"]).n.sum().reindex(pd.MultiIndex.from_frame(cells)).to_numpy()
        rare = [side == c for side in (left, right) for c in range(len(names)) if 0 < whole[side == c].sum() < 0.01 * whole.sum()]
        found = sum((counts[:, m].sum(axis=1) > 0).astype(int) for m in rare) if rare else np.zeros(n, int)
        rows = {"fraction": fraction, "sample_size": dict(wanted)[fraction], "dimension": dimension, "replicate": np.arange(n) + block * REPLICATES_A_TASK}
        return pd.DataFrame(rows | {"percent_agreement": agreement, "alpha": alpha, "rare": len(rare), "rare_found": found})

    blocks = F.array(*[F.struct(F.lit(float(f)).alias("fraction"), F.lit(b).alias("block")) for f in fractions for b in range(-(-replicates // REPLICATES_A_TASK))])
    cells = _aligned(df, dimensions).select("*", F.explode(blocks).alias("x")).select("stratum", "dimension", "l", "r", "n", "x.*")
    return cells.groupBy("dimension", "fraction", "block").applyInPandas(draw, ESTIMATES)


def stability(df: DataFrame, dimensions: dict[str, tuple[str, str]], fractions: list[float], replicates: int, seed: int, population: int | None = None, limits: dict[str, tuple[float, float]] | None = None) -> DataFrame:
    """One row for each fraction, dimension and metric (percent_agreement, alpha): the whole frame's
    value, the replicates' mean, bias, sd, rmse, 2.5 and 97.5 per cent quantiles and their width,
    whether bias and width are within the metric's limits, and the mean share of rare categories found
    (1 where none is rare). Undefined replicates of alpha are left out."""
    each = replicate_estimates(df, dimensions, fractions, replicates, seed, population)
    metric = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.when(~F.isnan(m), F.col(m)).alias("v")) for m in ("percent_agreement", "alpha")])).alias("x")
    long = each.select("fraction", "sample_size", "dimension", "rare", "rare_found", metric).select("*", "x.*").drop("x")

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        names = {v: i for i, v in enumerate(sorted({*pdf.l, *pdf.r}))}
        found = pair_metrics(pdf.n.to_numpy()[None, :], pdf.l.map(names).to_numpy(), pdf.r.map(names).to_numpy())
        value = lambda x: None if np.isnan(x[0]) else float(x[0])
        return pd.DataFrame({"dimension": pdf.dimension.iloc[0], "metric": ["percent_agreement", "alpha"], "full_value": [value(found[0]), value(found[1])]})

    cells = _aligned(df, dimensions).groupBy("dimension", "l", "r").agg(F.sum("n").alias("n"))
    truth = cells.groupBy("dimension").applyInPandas(whole, "dimension string, metric string, full_value double")
    off = F.col("v") - F.col("full_value")
    share = F.when(F.col("rare") > 0, F.col("rare_found") / F.col("rare")).otherwise(1.0)
    out = long.join(truth, ["dimension", "metric"]).groupBy("fraction", "sample_size", "dimension", "metric").agg(
        F.first("full_value").alias("full_value"), F.avg("v").alias("mean"), F.avg(off).alias("bias"), F.stddev_samp("v").alias("sd"), F.sqrt(F.avg(off * off)).alias("rmse"),
        F.percentile("v", 0.025).alias("p025"), F.percentile("v", 0.975).alias("p975"), F.avg(share).alias("rare_coverage"),
    )
    limits = limits or {"percent_agreement": (0.01, 0.05), "alpha": (0.02, 0.10)}
    of = lambda i: F.when(F.col("metric") == "alpha", limits["alpha"][i]).otherwise(limits["percent_agreement"][i])
    width = F.col("p975") - F.col("p025")
    return out.withColumn("width_95", width).withColumn("passes", F.coalesce((F.abs("bias") <= of(0)) & (width <= of(1)), F.lit(False)))


def recommend_fraction(table: DataFrame) -> DataFrame:
    """The stability table with recommended: the smallest fraction that passes in every dimension and metric."""
    good = table.groupBy("fraction").agg(F.bool_and("passes").alias("all_pass")).where("all_pass").agg(F.min("fraction").alias("least"))
    least = good.first()["least"]
    return table.withColumn("recommended", F.lit(False) if least is None else F.col("fraction") == least)


def blinded_order(df: DataFrame, salt: str, key: str) -> DataFrame:
    """df with blind_key, by which rows are shown in an order that says nothing about them."""
    return df.withColumn("blind_key", F.sha2(F.concat_ws("|", F.lit(salt), F.col(key).cast("string")), 256))
