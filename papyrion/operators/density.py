"""Density topics: clusters of a minimum spanning forest of mutual reachability, chosen by stability.

Points are compared within cells about k-means centres: each looks for its nearest neighbours in the
cells of the centres nearest to it (in all, if there are no more than ``reach``). The distance of two
neighbours counts as no less than how far the k-th neighbour of either is. A minimum spanning forest
of those links comes about in Borůvka's rounds: each component takes its least link, and components
join by pointer jumping, so a round at least halves them.

The forest's links then merge components from the shortest on. A component of ``least`` points is a
cluster; smaller ones that it takes in leave it at that density; where two clusters meet, both end and
are the children of a new one. Links are merged in stretches of the order of their length, at most
MERGED at a time, each by one task that knows nothing but the components its links join; so memory is
bounded, and the number of such steps grows with the points. A cluster is kept if it is more stable
than those below it together, and a point has the uppermost kept cluster that it belongs to, or -1.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.operators.packing import ranked
from papyrion.plans.tables import written

#: Points of a cell on average, those of a group of a larger one, and links that one step merges.
CELL, PART, MERGED = 2000, 8192, 500_000
#: The least distance that a density is taken from.
TOUCH = 1e-9


def neighbours(points: DataFrame, k: int, reach: int = 8, seed: int = 7) -> DataFrame:
    """(a, b, d): the k nearest other points found of each point of (id, x), x of doubles; ties to the smaller id."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    n = points.count()
    if n < 2:
        return points.sparkSession.createDataFrame([], "a long, b long, d double")
    cells = max(1, n // CELL)
    centres = np.zeros((1, len(points.first()["x"])))
    if cells > 1:
        sample = points.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // (64 * cells)))) == 0)
        centres = np.array(KMeans(k=cells, seed=seed, maxIter=10).fit(sample.select(array_to_vector("x").alias("features"))).clusterCenters())
    apart = lambda a, b: np.maximum((a**2).sum(axis=1)[:, None] - 2 * a @ b.T + (b**2).sum(axis=1)[None, :], 0)

    def placed(batches):
        for pdf in batches:
            x = np.stack(pdf["x"].to_numpy()) if len(pdf) else np.zeros((0, centres.shape[1]))
            yield pd.DataFrame({"id": pdf["id"], "x": pdf["x"], "cells": list(np.argsort(apart(x, centres), axis=1, kind="stable")[:, :reach].astype(np.int32))})

    rows = written(points.select("id", "x").mapInPandas(placed, "id long, x array<double>, cells array<int>"), "density-cells")
    sizes = rows.select(F.col("cells")[0].alias("cell"))
    sizes = sizes.groupBy("cell").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / PART).cast("int")).select("cell", "parts")  # a row a cell
    sizes = written(sizes, "density-sizes")
    held = rows.select(F.col("cells")[0].alias("cell"), "id", "x").join(F.broadcast(sizes), "cell").withColumn("part", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int"))
    asks = rows.select(F.col("id").alias("id"), F.col("x").alias("x"), F.explode("cells").alias("cell")).join(F.broadcast(sizes), "cell")
    asks = asks.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("turn", F.pmod(F.xxhash64("id"), F.col("parts") * reach).cast("int"))
    # A group is a part of a cell and a share of those that ask it; the part is copied to each share.
    held = held.withColumn("turn", F.explode(F.sequence(F.lit(0), F.col("parts") * reach - 1)))

    def nearest(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = {"a": [], "b": [], "d": []}
        if len(left) and len(right):
            order = np.argsort(left["id"].to_numpy())
            ids, x = left["id"].to_numpy()[order], np.stack(left["x"].to_numpy())[order]
            for at in range(0, len(right), 256):
                own, y = right["id"].to_numpy()[at : at + 256], np.stack(right["x"].to_numpy()[at : at + 256])
                d = np.sqrt(((y[:, None, :] - x[None]) ** 2).sum(axis=2)) if len(x) * y.shape[1] < 1 << 14 else np.sqrt(apart(y, x))
                d[own[:, None] == ids[None]] = np.inf
                for q, i in enumerate(np.argsort(d, axis=1, kind="stable")[:, :k]):
                    i = i[np.isfinite(d[q, i])]
                    out["a"].append(np.full(len(i), own[q]))
                    out["b"].append(ids[i])
                    out["d"].append(np.sqrt(((x[i] - y[q]) ** 2).sum(axis=1)))
        return pd.DataFrame({c: np.concatenate(v) if v else np.zeros(0, np.float64 if c == "d" else np.int64) for c, v in out.items()})

    keys = ["cell", "part", "turn"]
    held, asks = held.toDF(*held.columns), asks.toDF(*asks.columns)  # columns of their own, so that the two can meet
    found = held.groupBy(*keys).cogroup(asks.groupBy(*keys)).applyInPandas(nearest, "a long, b long, d double")
    return found.withColumn("r", F.row_number().over(Window.partitionBy("a").orderBy("d", "b"))).where(F.col("r") <= k).select("a", "b", "d")


def reachability(near: DataFrame, k: int) -> DataFrame:
    """(a, b, w), a < b: links of neighbours, as long as the larger of their distance and the two ends'
    distances from their k-th neighbour (the farthest found, where there are fewer)."""
    core = near.groupBy("a").agg(F.max("d").alias("core"))
    ends = lambda side: core.select(F.col("a").alias(side), F.col("core").alias(f"core_{side}"))
    out = near.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "d").groupBy("a", "b").agg(F.min("d").alias("d"))
    return out.join(ends("a"), "a").join(ends("b"), "b").select("a", "b", F.greatest("d", "core_a", "core_b").alias("w"))


def spanning_forest(links: DataFrame) -> DataFrame:
    """The links (a, b, w) of a minimum spanning forest; equal lengths go by a, then b."""
    now = written(links.select("a", "b", "w", F.col("a").alias("ca"), F.col("b").alias("cb")), "forest-links")
    kept = None
    while not now.isEmpty():
        row = F.struct("w", "a", "b", "ca", "cb")
        both = now.select(F.col("ca").alias("c"), row.alias("x"), F.col("cb").alias("to")).unionByName(now.select(F.col("cb").alias("c"), row.alias("x"), F.col("ca").alias("to")))
        least = written(both.groupBy("c").agg(F.min(F.struct("x", "to")).alias("m")).select("c", "m.x.w", "m.x.a", "m.x.b", "m.to"), "forest-least")
        own = least.select("a", "b", "w").distinct()
        kept = own if kept is None else kept.unionByName(own)
        # Two components that chose one link point at each other: the smaller is the root.
        back = least.select(F.col("c").alias("to"), F.col("to").alias("then"))
        up = least.join(back, "to", "left").select("c", F.when((F.col("then") == F.col("c")) & (F.col("c") < F.col("to")), F.col("c")).otherwise(F.col("to")).alias("to"))
        up = written(up, "forest-roots")
        while True:
            new = written(up.join(up.select(F.col("c").alias("to"), F.col("to").alias("then")), "to").select("c", F.col("then").alias("to")), "forest-roots")
            still = new.join(up.withColumnRenamed("to", "was"), "c").where("to <> was").isEmpty()
            up = new
            if still:
                break
        root = lambda side: up.select(F.col("c").alias(side), F.col("to").alias(f"new_{side}"))
        moved = now.join(root("ca"), "ca", "left").join(root("cb"), "cb", "left")
        moved = moved.select("a", "b", "w", F.coalesce("new_ca", "ca").alias("x"), F.coalesce("new_cb", "cb").alias("y")).where("x <> y")
        # Of several links between two components only the least can be taken.
        best = moved.select(F.least("x", "y").alias("ca"), F.greatest("x", "y").alias("cb"), F.struct("w", "a", "b").alias("m")).groupBy("ca", "cb").agg(F.min("m").alias("m"))
        now = written(best.select("m.a", "m.b", "m.w", "ca", "cb"), "forest-links")
    return links.limit(0) if kept is None else written(kept, "forest")


def merge_step(links: pd.DataFrame, parts: dict[int, tuple[int, int]], clusters: dict[int, list], least: int, next_cluster: int) -> tuple[dict, list, list, int]:
    """Merges components along sorted links (ca, cb, w). parts: component -> (size, cluster or -1);
    clusters: cluster -> [sum of densities, children's best, children]. Gives (component -> root), the
    fallen [(component, cluster, density)], the ended [(cluster, parent, size, own stability, best, chosen)],
    and the next free cluster; parts and clusters are brought up to date, by root."""
    root = {c: c for c in parts}
    members = {c: [c] for c in parts}
    fallen, ended = [], []

    def find(c: int) -> int:
        while root[c] != c:
            root[c] = root[root[c]]
            c = root[c]
        return c

    def end(cluster: int, parent: int, size: int, density: float) -> float:
        total, below, _ = clusters.pop(cluster)
        own = total - size * density
        ended.append((cluster, parent, size, own, max(own, below), own >= below))
        return max(own, below)

    for ca, cb, w in links.itertuples(index=False):
        a, b = find(ca), find(cb)
        density = 1 / max(w, TOUCH)
        (na, ka), (nb, kb) = parts[a], parts[b]
        into = ka if ka >= 0 else kb
        if ka >= 0 and kb >= 0:
            into, next_cluster = next_cluster, next_cluster + 1
            best = end(ka, into, na, density) + end(kb, into, nb, density)
            clusters[into] = [(na + nb) * density, best, [ka, kb]]
        elif into >= 0:
            small = b if ka >= 0 else a
            clusters[into][0] += parts[small][0] * density
            fallen += [(c, into, density) for c in members[small]]
            members[small] = []
        elif na + nb >= least:
            into, next_cluster = next_cluster, next_cluster + 1
            clusters[into] = [(na + nb) * density, 0.0, []]
            fallen += [(c, into, density) for c in members[a] + members[b]]
            members[a], members[b] = [], []
        top, low = (a, b) if a < b else (b, a)
        root[low] = top
        if into < 0:
            members[top] = members[a] + members[b]
        parts[top] = (na + nb, into)
        del parts[low]
    return {c: find(c) for c in root}, fallen, ended, next_cluster


def density_topics(points: DataFrame, least: int = 10, k: int = 5, reach: int = 8, seed: int = 7) -> DataFrame:
    """(id, topic, strength) of every point of (id, x): topics from 0 by size (ties: the smallest id),
    -1 for points of none; strength is the point's density over the highest of its topic, 0 for those."""
    spark = points.sparkSession
    forest = spanning_forest(reachability(written(neighbours(points, k, reach, seed), "density-near"), k))
    ordered = written(ranked(forest, [F.col("w"), F.col("a"), F.col("b")], name="place"), "density-order")
    steps = -(-(ordered.agg(F.max("place")).first()[0] or 0) // MERGED)
    # Where each point is now, and the sizes and clusters of components of more than one point.
    where, fallen_rows, ended_rows, clusters, next_cluster, grown = points.select("id", F.col("id").alias("c")), [], [], {}, 0, {}
    for step in range(steps):
        own = ordered.where((F.col("place") > step * MERGED) & (F.col("place") <= (step + 1) * MERGED))
        ends = own.join(where.select(F.col("id").alias("a"), F.col("c").alias("ca")), "a").join(where.select(F.col("id").alias("b"), F.col("c").alias("cb")), "b")
        links = ends.orderBy("place").select("ca", "cb", "w").toPandas()  # at most MERGED rows
        parts = {int(c): grown.get(int(c), (1, -1)) for c in pd.unique(links[["ca", "cb"]].to_numpy().ravel())}
        moved, fallen, ended, next_cluster = merge_step(links, parts, clusters, least, next_cluster)
        for c in moved:
            grown.pop(c, None)
        grown |= parts
        table = lambda rows, schema, name: written(spark.createDataFrame(pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")]), schema), name)
        if fallen:
            fell = table(fallen, "c long, cluster long, density double", "density-fallen")
            fallen_rows.append(written(where.join(fell, "c").select("id", "cluster", "density"), "density-points"))
        if ended:
            ended_rows.append(table(ended, "cluster long, parent long, size long, own double, best double, chosen boolean", "density-ended"))
        names = table(list(moved.items()), "c long, new long", "density-moved")
        where = written(where.join(names, "c", "left").select("id", F.coalesce("new", "c").alias("c")), "density-where")
    empty = lambda schema: spark.createDataFrame([], schema)
    union = lambda rows, schema: empty(schema) if not rows else rows[0] if len(rows) == 1 else union([rows[0].unionByName(rows[1]), *rows[2:]], schema)
    tree = union(ended_rows, "cluster long, parent long, size long, own double, best double, chosen boolean")
    # Clusters that never ended are the uppermost of their trees: kept where the forest has several, as
    # parts that nothing joins, else never.
    roots = [(c, t, below) for c, (t, below, _) in clusters.items()]
    top = written(spark.createDataFrame([(c, -1, len(roots) > 1 and t >= below) for c, t, below in roots], "cluster long, parent long, chosen boolean"), "density-roots") if roots else empty("cluster long, parent long, chosen boolean")
    now = written(tree.select("cluster", "parent", "chosen").unionByName(top).select("cluster", F.when(F.col("chosen"), F.col("cluster")).alias("kept"), F.col("parent").alias("up")), "density-tree")
    while not now.where("up >= 0").isEmpty():
        above = now.select(F.col("cluster").alias("up"), F.col("kept").alias("higher"), F.col("up").alias("next"))
        now = written(now.join(above, "up", "left").select("cluster", F.coalesce("higher", "kept").alias("kept"), F.coalesce("next", F.lit(-1).cast("long")).alias("up")), "density-tree")
    fell = union(fallen_rows, "id long, cluster long, density double")
    labelled = points.select("id").join(fell, "id", "left").join(now.select("cluster", "kept"), "cluster", "left")
    labelled = written(labelled.select("id", "kept", "density"), "density-labels")
    sizes = labelled.where("kept IS NOT NULL").groupBy("kept").agg(F.count("*").alias("n"), F.min("id").alias("first"), F.max("density").alias("most"))
    names = ranked(sizes, [F.desc("n"), F.col("first")], name="topic").select("kept", (F.col("topic") - 1).cast("int").alias("topic"), "most")
    return labelled.join(names, "kept", "left").select("id", F.coalesce("topic", F.lit(-1)).alias("topic"), F.coalesce(F.col("density") / F.col("most"), F.lit(0.0)).alias("strength"))
