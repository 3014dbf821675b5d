"""Running sums and ranks over all rows, and greedy packing of rows into chunks under a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.plans.tables import written


def running_sum(df: DataFrame, order: list[str], value: str) -> DataFrame:
    """df with _i, its place from 0 in the order, and _upto, the sum of the value up to and with it.
    Rows are dealt to ranges of the order; sums of ranges come first, then those within each. The
    order tells rows apart; null values count 0."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = written(df.repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    cost = F.coalesce(F.col(value), F.lit(0)).cast("long")
    totals = ranged.groupBy("_range").agg(F.sum(cost).alias("_sum"), F.count("*").alias("_n"))  # at most n rows
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    totals = totals.select("_range", zero(F.sum("_sum").over(before)).alias("_sum"), zero(F.sum("_n").over(before)).alias("_n"))
    inside = Window.partitionBy("_range").orderBy(*order)
    out = ranged.withColumns({"_i": F.row_number().over(inside) - 1, "_upto": F.sum(cost).over(inside.rowsBetween(Window.unboundedPreceding, 0))})
    out = out.join(F.broadcast(totals), "_range")
    return out.withColumns({"_i": F.col("_i") + F.col("_n"), "_upto": F.col("_upto") + F.col("_sum")}).drop("_range", "_sum", "_n")


def ranked(df: DataFrame, order: list[Column], by: list[str] = (), name: str = "rank") -> DataFrame:
    """df with its rows' places from 1 on in an order, within each group of ``by``. Rows are dealt to
    ranges of group and order, so neither a group nor the rows of one value meet in one task; places
    are those of all rows less those before the group. The order tells rows of a group apart."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*map(F.col, by), *order]
    ranged = written(df.repartitionByRange(n, *keys).withColumn("_range", F.spark_partition_id()), "ranges")
    before = Window.partitionBy(F.lit(1)).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_n"))  # at most n rows
    totals = totals.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*keys))
    out = ranged.withColumn(name, inside).join(F.broadcast(totals), "_range").withColumn(name, F.col(name) + F.col("_before")).drop("_range", "_before")
    if by:
        out = written(out, "ranks")
        first = out.groupBy(*by).agg(F.min(name).alias("_first"))
        out = out.join(first, list(by)).withColumn(name, F.col(name) - F.col("_first") + 1).drop("_first")
    return out


def pack(df: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """df with chunk, from 1 on: rows in order fill a chunk until the next would pass the budget; a row
    above the budget is alone in its chunk. Costs are positive.

    No task sees all rows. A chunk that starts at a row ends before the first one whose running sum
    passes the row's own start by more than the budget; stretches of the running sum as wide as the
    budget hold few rows, and that end lies in the row's stretch or the next. Where chunks start
    follows by pointer doubling: each round doubles how many starts are known, and how many chunks a
    pointer skips.
    """
    rows = written(running_sum(df, order, cost), "packing-rows")
    start = F.col("_upto") - F.coalesce(F.col(cost), F.lit(0)).cast("long")
    stretch = F.floor(start / budget)
    items = rows.select("_i", "_upto", start.alias("start"), stretch.alias("stretch"))
    # At each value of the running sum a question comes after the rows of that value: what passes it is behind.
    answers = items.select("stretch", F.col("_upto").alias("at"), F.lit(0).alias("asks"), "_i")
    asked = items.select(F.explode(F.array("stretch", F.col("stretch") + 1)).alias("stretch"), (F.col("start") + budget).alias("at"), F.lit(1).alias("asks"), "_i")
    behind = Window.partitionBy("stretch").orderBy("at", "asks", "_i").rowsBetween(1, Window.unboundedFollowing)
    first = F.min(F.when(F.col("asks") == 0, F.col("_i"))).over(behind)
    found = answers.unionByName(asked).withColumn("to", first).where("asks = 1").groupBy("_i").agg(F.min("to").alias("to"))
    jumps = written(found.where(F.col("to").isNotNull()).select("_i", F.greatest("to", F.col("_i") + 1).alias("to")), "packing-jumps")
    starts, skipped = rows.where("_i = 0").select("_i", F.lit(1).cast("long").alias("chunk")), 1
    starts = written(starts, "packing-starts")
    while True:
        more = starts.join(jumps, "_i").select(F.col("to").alias("_i"), (F.col("chunk") + skipped).alias("chunk"))
        known = written(starts.unionByName(more), "packing-starts")
        if known.count() == starts.count():
            break
        starts, skipped = known, 2 * skipped
        jumps = written(jumps.join(jumps.select(F.col("_i").alias("to"), F.col("to").alias("then")), "to").select("_i", F.col("then").alias("to")), "packing-jumps")
    last = items.select("_i", "stretch").join(starts, "_i").select(F.explode(F.array("stretch", F.col("stretch") + 1)).alias("stretch"), "_i", "chunk")
    every = items.select("stretch", "_i", F.lit(None).cast("long").alias("chunk"), F.lit(1).alias("item")).unionByName(last.withColumn("item", F.lit(0)))
    so_far = Window.partitionBy("stretch").orderBy("_i", "item").rowsBetween(Window.unboundedPreceding, 0)
    chunks = every.withColumn("chunk", F.last("chunk", ignorenulls=True).over(so_far)).where("item = 1").select("_i", "chunk")
    return rows.join(chunks, "_i").drop("_i", "_upto")
