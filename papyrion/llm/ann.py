"""Approximate nearest neighbours by cosine: an inverted multi-index.

Vectors of length one are cut into two halves, each half is quantised by its own centroids, and a
pair of centroids names a cell. A query walks the cells in ascending sum of its two squared
distances, taking the next pair from a heap, until the cells walked hold the wanted share of all
vectors. The sum where the walk ends is the query's reach: the vectors in cells within reach are
ranked by the exact cosine of the original vectors in double precision.

Centroids are fitted to a bounded sample (FIT_ROWS). Every row is indexed. The driver holds the
sample, the centroids and one count a cell, all bounded by constants. Cells of neighbouring first
centroids make shards of about PART vectors, a larger one is dealt to several groups, and a query
goes to the groups of the shards that its reach touches, once each; of more than ASKING queries each
block meets its own copy of the vectors, so that no group holds more than about PART vectors and
ASKING queries. What is shuffled is rows and queries but never pairs of them. Of equal vectors only the smallest ids that an answer could hold are kept, by
a rank limit that each task applies before the shuffle, so copies cost nothing.

How far a query walks is measured, not assumed: a bounded sample of queries is searched exactly, and
the share of all vectors that a walk must hold to meet TARGET of their true neighbours is taken for
every query. Where vectors are near to random directions, as in the test tables (the best cosine is
about 0.4 in 64 dimensions), true neighbours lie in far cells too, and that is nearly half of all; on
vectors with structure a few percent do.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import stored

#: Rows that centroids are fitted to, and rounds of fitting.
FIT_ROWS, FIT_ROUNDS = 32768, 12
#: Queries that the walk is measured on, and the share of their true neighbours that it must meet.
PROBES, TARGET = 192, 0.95
#: Vectors for each cell to hold on average, and the most centroids of a half.
PER_CELL, MOST_CENTROIDS = 16, 1024
#: Vectors of a shard, and of a group of a larger one; queries of a group.
PART, ASKING = 16384, 65536


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): rows with an id and a finite, non-zero vector of the commonest length
    (of several, the shortest); one row an id, of several the smallest vector."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("vector").isNotNull() & finite & F.exists(v, lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    rows = rows.where(F.size("vector") == (sizes[0]["size"] if sizes else 0))
    return rows.groupBy("vec_id").agg(F.min("vector").alias("vector"))


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def _distances(points: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return (points**2).sum(axis=1)[:, None] - 2 * points @ centroids.T + (centroids**2).sum(axis=1)[None, :]


def _centroids(points: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Lloyd's rounds from k different random points; a centroid that loses all its points stays."""
    rng = np.random.default_rng(seed)
    different = np.unique(points, axis=0)
    found = different[rng.permutation(len(different))[:k]]
    for _ in range(FIT_ROUNDS):
        nearest = _distances(points, found).argmin(axis=1)
        counts = np.bincount(nearest, minlength=len(found))
        sums = np.stack([np.bincount(nearest, points[:, d], len(found)) for d in range(points.shape[1])], axis=1)
        found = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], found)
    return found


def fit(rows: DataFrame, n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The centroids of the two halves, from at most about FIT_ROWS rows chosen by the hash of their ids."""
    every = -(-n // FIT_ROWS)
    sample = rows.where(F.pmod(F.xxhash64("vec_id"), F.lit(every)) == 0).orderBy("vec_id").select("vector").toArrow()
    points = np.array(sample.column(0).to_pylist(), np.float64)
    if not len(points):
        points = np.array([r.vector for r in rows.orderBy("vec_id").limit(1).collect()], np.float64)
    k = int(np.clip(round((n / PER_CELL) ** 0.5), 2, MOST_CENTROIDS))
    half = points.shape[1] // 2
    unit = _unit(points)
    return _centroids(unit[:, :half], k, seed), _centroids(unit[:, half:], k, seed + 1)


def walk(a: np.ndarray, b: np.ndarray, counts: np.ndarray, wanted: int) -> float:
    """The reach of a query with squared distances a and b to the centroids: pairs are taken from a
    heap in ascending a[i] + b[j] until their cells (i * len(b) + j) hold ``wanted`` vectors."""
    ia, ib = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    sa, sb, held, reach, width = a[ia].tolist(), b[ib].tolist(), 0, -np.inf, len(b)
    # The pair (x, y) follows (x, y - 1), and (x - 1, 0) where y is 0, so none is met twice.
    heap = [(sa[0] + sb[0], 0, 0)]
    while heap and held < wanted:
        reach, x, y = heapq.heappop(heap)
        held += int(counts[ia[x] * width + ib[y]])
        if y + 1 < width:
            heapq.heappush(heap, (sa[x] + sb[y + 1], x, y + 1))
        if y == 0 and x + 1 < len(ia):
            heapq.heappush(heap, (sa[x + 1] + sb[0], x + 1, 0))
    return reach


def needed_share(indexed: DataFrame, queries: DataFrame, k: int, first: np.ndarray, second: np.ndarray, counts: np.ndarray) -> float:
    """The least share of all vectors that walks must hold to meet TARGET of the true k nearest of at
    most PROBES queries, chosen by the hash of their ids. Each task ranks its own vectors exactly."""
    probes = queries.orderBy(F.xxhash64("query_id"), "query_id").limit(PROBES).collect()
    if not probes:
        return 1.0
    asking, unit, half = np.array([r.query_id for r in probes]), _unit(np.array([r.query for r in probes], np.float64)), first.shape[1]

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = np.full((len(unit), k), -np.inf)
        cells = np.zeros((len(unit), k), np.int64)
        for batch in batches:
            if batch.num_rows:
                score = unit @ _unit(_matrix(batch.column("vector"))).T
                score[asking[:, None] == batch.column("vec_id").to_numpy()[None, :]] = -np.inf
                both = np.hstack([best, score])
                take = np.argsort(-both, axis=1, kind="stable")[:, :k]
                cells = np.take_along_axis(np.hstack([cells, np.broadcast_to(batch.column("cell").to_numpy(), score.shape)]), take, axis=1)
                best = np.take_along_axis(both, take, axis=1)
        q, at = np.nonzero(best > -np.inf)
        yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(cells[q, at]), pa.array(best[q, at])], ["q", "cell", "score"])

    found = indexed.select("vec_id", "vector", "cell").mapInArrow(nearest, "q long, cell long, score double")
    order = Window.partitionBy("q").orderBy(F.desc("score"), "cell")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("q", "cell").collect()  # at most PROBES * k
    needed = []
    a, b = _distances(unit[:, :half], first), _distances(unit[:, half:], second)
    for r in found:
        sums = a[r.q][:, None] + b[r.q][None, :]
        needed.append(counts[(sums <= sums.ravel()[r.cell] + 1e-12).ravel()].sum() / counts.sum())
    return float(np.quantile(needed, TARGET, method="higher")) if needed else 1.0


def _matrix(column: pa.Array) -> np.ndarray:
    return column.values.to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.empty((0, 0))


def search(df: DataFrame, query_every: int, k: int, id_col: str = "vec_id", vector_col: str = "embedding", share: float | None = None) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of every query, and share: the share
    of all vectors that a query's walk held, measured by needed_share() unless it is given.

    Queries are the rows whose id is divisible by ``query_every``; candidates are all rows but the
    query's own. score is the cosine of the original vectors in double precision; ties go to the
    smaller id. Rows with a null id and vectors that are null, zero, hold null or non-finite
    components or are of another length than most take no part; repeated rows count once. Fewer
    candidates than k give them all; an empty table gives no rows. Other columns play no part.
    """
    spark = df.sparkSession
    rows = stored(usable(df, id_col, vector_col), "vectors")
    queries = rows.where(F.col("vec_id") % query_every == 0)
    place = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    kept = rows.withColumn("place", place).where(F.col("place") <= k + 1).drop("place")
    n = rows.count()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double, share double")
    first, second = fit(rows, n)
    half, width = first.shape[1], len(second)

    def quantised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                unit = _unit(_matrix(batch.column("vector")))
                cell = _distances(unit[:, :half], first).argmin(axis=1) * width + _distances(unit[:, half:], second).argmin(axis=1)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell, pa.int64())], ["vec_id", "vector", "cell"])

    indexed = stored(kept.mapInArrow(quantised, "vec_id long, vector array<double>, cell long"), "index")
    counts = np.zeros(len(first) * width, np.int64)
    for r in indexed.groupBy("cell").agg(F.count("*").alias("n")).collect():  # at most MOST_CENTROIDS squared
        counts[r.cell] = r.n
    if share is None:
        share = needed_share(indexed, queries.select(F.col("vec_id").alias("query_id"), F.col("vector").alias("query")), k, first, second, counts)
    # Shards: first centroids in the order of their first components, up to PART vectors each.
    sizes, order = counts.reshape(len(first), width).sum(axis=1), np.argsort(first[:, 0], kind="stable")
    shard_of, parts, held = np.zeros(len(first), np.int64), [], PART
    for i in order:
        if held + sizes[i] > PART:
            parts.append(1)
            held = 0
        held += sizes[i]
        shard_of[i], parts[-1] = len(parts) - 1, max(1, -(-int(held) // PART))
    parts = np.array(parts)

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard = shard_of[batch.column("cell").to_numpy() // width]
            part = batch.column("vec_id").to_numpy() % parts[shard]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shard), pa.array(part)], ["vec_id", "vector", "cell", "shard", "part"])

    def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            unit = _unit(_matrix(batch.column("vector")))
            a, b = _distances(unit[:, :half], first), _distances(unit[:, half:], second)
            wanted = max(int(share * counts.sum()), k + 1)
            reach = np.array([walk(x, y, counts, wanted) for x, y in zip(a, b, strict=True)]) + 1e-9
            q, i = np.nonzero(a + b.min(axis=1)[:, None] <= reach[:, None])
            pairs = np.unique(q * len(parts) + shard_of[i])
            q, shard = pairs // len(parts), pairs % len(parts)
            copies = parts[shard]
            part = np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies)
            q, shard = np.repeat(q, copies), np.repeat(shard, copies)
            taken = batch.take(pa.array(q))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(reach[q]), pa.array(shard), pa.array(part)], ["query_id", "query", "reach", "shard", "part"])

    def ranked(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))]
        if len(left) and len(right):
            ids, cells, vectors = left["vec_id"].to_numpy(), left["cell"].to_numpy(), np.stack(left["vector"].to_numpy())
            unit = _unit(vectors)
            for at in range(0, len(right), 128):
                some = right.iloc[at : at + 128]
                asking, query_vectors = some["query_id"].to_numpy(), np.stack(some["query"].to_numpy())
                u = _unit(query_vectors)
                a, b = _distances(u[:, :half], first), _distances(u[:, half:], second)
                rough = u @ unit.T
                out = a[:, cells // width] + b[:, cells % width] > some["reach"].to_numpy()[:, None]
                rough[out | (asking[:, None] == ids[None, :])] = -np.inf
                # What may be among the k nearest by the rough product, with room for its rounding.
                cut = np.partition(rough, -k, axis=1)[:, -k] - 1e-9 if len(ids) > k else np.full(len(u), -2.0)
                for q in range(len(u)):
                    take = np.nonzero(rough[q] >= max(cut[q], -2.0))[0]
                    exact = cosine(query_vectors[q], vectors[take])
                    best = np.lexsort((ids[take], -exact))[:k]
                    found.append((np.full(len(best), asking[q]), ids[take][best], exact[best]))
        return pd.DataFrame(dict(zip(("query_id", "vec_id", "score"), map(np.concatenate, zip(*found, strict=True)), strict=True)))

    blocks = max(1, -(-queries.count() // ASKING))
    shards = indexed.mapInArrow(dealt, "vec_id long, vector array<double>, cell long, shard long, part long")
    shards = shards.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))) if blocks > 1 else F.lit(0))
    asking = queries.mapInArrow(asked, "query_id long, query array<double>, reach double, shard long, part long")
    asking = asking.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).cast("int"))
    keys = ["shard", "part", "block"]
    met = shards.groupBy(*keys).cogroup(asking.groupBy(*keys)).applyInPandas(ranked, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return met.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score", F.lit(share).alias("share"))


def cosine(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """The cosine of one vector with each of several, the same bits however they are grouped."""
    a, b = query / np.abs(query).max(), vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return (a * b).sum(axis=1) / (np.sqrt((a * a).sum()) * np.sqrt((b * b).sum(axis=1)))
