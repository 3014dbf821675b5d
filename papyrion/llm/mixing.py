"""Mixing sources to target weights.

Every document gets a hash-random key. Within a source, documents stand in key order; the key's
leading digits cut that order into ranges of about equal size, so the order is a range sort without
a sampling pass and the same on every run. Running totals of token counts come in two steps: totals
of ranges, then totals inside each range. Where the running total meets the source's budget, the
mix is cut; a budget above the source's size repeats whole epochs first. DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import free_name

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (3, 1, 2)
#: The mix's size as a share of the input's, in percent.
SHARE = 150
#: No source and no document is used more often than this.
MOST = 2


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, share: int = SHARE, most: int = MOST) -> DataFrame:
    """One row per source: source, source_size, target.

    Targets share ``share`` percent of all sizes by weight; one that would pass ``most`` times its
    source's size stops there, and the excess is shared again by weight until none is above. That
    fixed point is found in one pass: in the order of the weight unit at which each source stops,
    the first one that stays below its limit fixes the unit for all after it. The windows run over
    one row per source, never over documents. Sources of size 0 get target 0.
    """
    per = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).cast("long").alias("source_size"))
    everywhere = Window.partitionBy(F.lit(1))
    rank = F.row_number().over(everywhere.orderBy(F.col("source").asc_nulls_last()))
    per = per.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank - 1) % len(weights) + 1).cast("long"))
    stops = everywhere.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last())
    before = stops.rowsBetween(Window.unboundedPreceding, -1)
    rest = stops.rowsBetween(0, Window.unboundedFollowing)
    per = (
        per.withColumn("total", F.sum("source_size").over(everywhere) * share / F.lit(100.0))
        .withColumn("capped", F.coalesce(F.sum(F.col("source_size") * most).over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(rest))
        .withColumn("unit", (F.col("total") - F.col("capped")) / F.col("open"))
    )
    # Of the sources that stay below their limits, the first in that order has the most weight open.
    below = F.col("unit") * F.col("weight") <= F.col("source_size") * most
    per = per.withColumn("level", F.max(F.when(below, F.struct("open", "unit"))).over(everywhere)["unit"])
    limit = (F.col("source_size") * most).cast("double")
    target = F.when(F.col("level").isNull(), limit).otherwise(F.least(limit, F.col("level") * F.col("weight")))
    return per.select("source", "source_size", target.alias("target"))


def mix(
    df: DataFrame, size_col: str = "size", source_col: str = "source", id_col: str = "doc_id", seed: str = "mix",
    weights=WEIGHTS, share: int = SHARE, most: int = MOST, range_digits: int = 4,
) -> DataFrame:
    """Every row of df with source_size, target (its source's), copies and taken (its tokens in the mix).

    A row is taken floor(target / source_size) times, and once more if it lies before the cut in
    its source's key order. Rows are whole: the row that the cut would split is taken if that
    brings the source nearer its target, so a source misses it by half a row's size at most. Null
    sizes count as 0, a null source is a source of its own, repeated rows are rows of their own,
    ties in the key go by id and size. Columns of the four names are replaced; all others stay. An
    empty table gives no rows.

    One source may hold most rows: its order is cut into 16^range_digits ranges, and no window over
    rows spans more than one of them. The key is one of id and size, so that rows without an id, or with
    one that very many repeat, spread too.
    """
    # The rows travel as one struct, whatever their columns are called. One plain key for the source
    # keeps null apart from every string and joins without null rules.
    keyed = df.drop("source_size", "target", "copies", "taken").select(
        F.struct("*").alias("row"), F.col(source_col).alias("source"), F.coalesce(F.concat(F.lit("s"), F.col(source_col)), F.lit("n")).alias("_source"), F.col(id_col).alias("id"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).cast("string"))).alias("_key"), F.coalesce(F.col(size_col).cast("long"), F.lit(0)).alias("_size"),
    ).withColumn("_range", F.substring("_key", 1, range_digits))
    ranges = keyed.groupBy("_source", "source", "_range").agg(F.sum("_size").alias("_sum"))
    # Ranges before a range: those of its group (all but the last two digits), and the groups before that.
    group = F.substring("_range", 1, range_digits - 2).alias("_group")
    before = lambda keys, order: Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    groups = ranges.groupBy("_source", group).agg(F.sum("_sum").alias("_of_group"))
    groups = groups.select("_source", "_group", F.coalesce(F.sum("_of_group").over(before(["_source"], "_group")), F.lit(0)).alias("_groups_before"))
    in_group = ranges.select("_source", group, "_range", F.coalesce(F.sum("_sum").over(before(["_source", group], "_range")), F.lit(0)).alias("_in_group"))
    targets = source_targets(ranges, "source", "_sum", weights, share, most)
    targets = targets.select(F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("n")).alias("_source"), "source_size", "target")
    starts = in_group.join(groups, ["_source", "_group"]).withColumn("_start", F.col("_groups_before") + F.col("_in_group")).drop("_group", "_groups_before", "_in_group").join(targets, "_source")
    inside = Window.partitionBy("_source", "_range").orderBy("_key", "id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    placed = keyed.withColumn("_inside", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(starts, ["_source", "_range"])
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    left = F.col("target") - F.col("_epochs") * F.col("source_size")
    more = (left > 0) & ((F.col("_start") + F.col("_inside")) * 2 + F.col("_size") <= left * 2)
    placed = placed.withColumn("_epochs", epochs).withColumn("copies", F.col("_epochs") + more.cast("long"))
    return placed.select("row.*", "source_size", "target", "copies", (F.col("copies") * F.col("_size")).alias("taken"))


def repeated(mixed: DataFrame) -> DataFrame:
    """Each row of mix()'s result as often as it was taken, without the columns that mix() added."""
    epoch = free_name(mixed, "_epoch")
    epochs = mixed.where(F.col("copies") > 0).withColumn(epoch, F.explode(F.sequence(F.lit(1), F.col("copies"))))
    return epochs.drop(epoch, "source_size", "target", "copies", "taken")
