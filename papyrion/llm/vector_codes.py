"""Product codes of vectors, assigned by annular norm pruning in exact integer arithmetic.

A component x counts as floor(256 * x). Vectors are cut into PARTS equal consecutive parts, each
with a codebook of ENTRIES entries that starts as that part of the vectors of the smallest ids and
moves to the componentwise floor of its parts' means in each of ROUNDS rounds.

The nearest entry of a part is not sought among all. Entries are sorted by norm; the PROBES next to the
part's own norm give a first distance d; by the triangle inequality an entry as near as d has a norm
within d of the part's, so that a binary search bounds the annulus, and only its entries (both ends
included) are evaluated. Norms are floors of integer roots, and the annulus is wider by one for
that, so no entry is left out that could be nearest, nor one that ties with a lower index.

Each task holds one batch and the sums of its parts for each entry. Spark adds the sums up; the
driver gets PARTS * ENTRIES rows for each place in a part, whatever the table's size.

Rows whose vector is null, or holds null or non-finite components, are left out. The length of
vectors is the commonest one that PARTS divides (of several, the shortest), and rows of others are
left out too. A null id is coded but comes after all others as a seed; rows that repeat an id are coded each, and
taken as seeds by their components. With fewer rows than ENTRIES a codebook has as many entries. An
empty table gives no rows. Components are exact up to 10^20; integers that pass 64 bits are
computed with in Python, and an error that passes them comes out as null.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import stored

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Entries next in norm that give the first distance, and entries that are evaluated at once.
PROBES, AT_ONCE = 6, 1 << 21

Codebooks = list[np.ndarray]


def usable(df: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, vector, label) of the rows that take part."""
    v = F.col(vector_col).cast("array<double>")
    finite = F.forall(v, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)) & ~F.isnan(x))
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("vector"), label.alias("label"))
    rows = rows.where(F.col("vector").isNotNull() & (F.size("vector") > 0) & (F.size("vector") % PARTS == 0) & finite)
    size = rows.groupBy(F.size("vector").alias("size")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "size").limit(1).collect()
    return rows.where(F.size("vector") == (size[0]["size"] if size else 0))


def integers(vectors: np.ndarray) -> np.ndarray:
    """floor(SCALE * x): 64-bit where squared distances surely fit, else Python's integers."""
    scaled = np.floor(vectors * float(SCALE))
    if not scaled.size or np.abs(scaled).max() < 2**24:
        return scaled.astype(np.int64)
    return np.array([[int(x) for x in row] for row in scaled], object).reshape(scaled.shape)


def _roots(squares: np.ndarray) -> np.ndarray:
    """Floors of square roots."""
    if squares.dtype == object:
        return np.array([math.isqrt(s) for s in squares], object)
    root = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    root -= root * root > squares
    return root + ((root + 1) * (root + 1) <= squares)


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """The nearest entry of each point (of equally near ones the lowest) and its squared distance, and
    how many distances were computed."""
    if points.dtype == object or book.dtype == object:
        points, book = points.astype(object), book.astype(object)
    order = np.argsort(_roots((book * book).sum(axis=1)), kind="stable")
    entries, norms = book[order], _roots((book * book).sum(axis=1))[order]
    norm, k = _roots((points * points).sum(axis=1)), len(book)
    distance = lambda p, at: ((p - entries[at]) ** 2).sum(axis=1)
    next_to = np.searchsorted(norms, norm)
    best = distance(points, np.minimum(next_to, k - 1))
    for step in (*range(-PROBES // 2, 0), *range(1, PROBES // 2)):
        best = np.minimum(best, distance(points, np.clip(next_to + step, 0, k - 1)))
    reach = _roots(best) + 1
    low, high = np.searchsorted(norms, norm - reach, "left"), np.searchsorted(norms, norm + reach, "right")
    width = high - low
    found, error = np.empty(len(points), np.int64), np.empty(len(points), best.dtype)
    cut = np.r_[0, np.flatnonzero(np.diff(np.cumsum(width) // AT_ONCE)) + 1, len(points)]
    for i, j in zip(cut[:-1], cut[1:], strict=True):
        if i == j:
            continue
        starts = np.cumsum(width[i:j]) - width[i:j]
        which = np.repeat(np.arange(i, j), width[i:j])
        at = np.arange(width[i:j].sum()) - np.repeat(starts, width[i:j]) + low[which]
        least = np.minimum.reduceat(distance(points[which], at) * k + order[at], starts)
        found[i:j], error[i:j] = (least % k).astype(np.int64), least // k
    return found, error, int(width.sum()) + PROBES * len(points)


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    column = batch.column("vector")
    return integers(np.asarray(column.flatten(), np.float64).reshape(len(column), -1))


def _cut(matrix: np.ndarray) -> list[np.ndarray]:
    return np.split(matrix, PARTS, axis=1)


def seeds(rows: DataFrame) -> Codebooks:
    """The codebooks at the start: ENTRIES vectors at most come to the driver."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "vector").limit(ENTRIES).collect()
    return _cut(integers(np.array([r.vector for r in first], np.float64).reshape(len(first), -1 if first else PARTS)))


def moved(rows: DataFrame, books: Codebooks) -> Codebooks:
    """The codebooks after one round; entries that no part is assigned to stay."""
    width = books[0].shape[1]

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        totals = [np.zeros(b.shape, object) for b in books]
        for batch in batches:
            if batch.num_rows:
                for j, points in enumerate(_cut(_matrix(batch))):
                    code, _, _ = nearest(points, books[j])
                    order = np.argsort(code, kind="stable")
                    used, start = np.unique(code[order], return_index=True)
                    totals[j][used] += np.add.reduceat(points[order], start, axis=0).astype(object)
                    counts[j] += np.bincount(code, minlength=len(books[j]))
        found = [(j, e, int(counts[j][e]), totals[j][e].tolist()) for j in range(PARTS) for e in np.flatnonzero(counts[j]).tolist()]
        types = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], t) for i, t in enumerate(types)], ["part", "entry", "n", "sums"])

    partial = rows.mapInArrow(sums, "part int, entry int, n long, sums array<decimal(38,0)>")
    total = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)])
    new = [b.astype(object) for b in books]
    for r in total.collect():
        new[r.part][r.entry] = [int(r[f"s{i}"]) // r.n for i in range(width)]
    small = all(abs(int(x)) < 2**24 for b in new for x in b.ravel())
    return [b.astype(np.int64) if small else b for b in new]


def assigned(rows: DataFrame, books: Codebooks) -> DataFrame:
    """(vec_id, label, code, error) of every row."""

    def codes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = [nearest(points, books[j])[:2] for j, points in enumerate(_cut(_matrix(batch)))]
                code = np.stack([f[0] for f in found], axis=1).astype(np.uint8)
                error = [e if e < 2**63 else None for e in sum(f[1] for f in found).tolist()]
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    schema = f"vec_id long, label {rows.schema['label'].dataType.simpleString()}, code string, error long"
    return rows.mapInArrow(codes, schema)


def digest(books: Codebooks) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def trained(rows: DataFrame) -> Codebooks:
    """The codebooks after all rounds; none for an empty table."""
    books = seeds(rows)
    for _ in range(ROUNDS if len(books[0]) else 0):
        books = moved(rows, books)
    return books


def compress(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str | None = "label") -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256): two hexadecimal digits a part, the squared
    distance of the vector to what its code stands for, and that distance summed over equal labels."""
    rows = usable(df, id_col, vector_col, label_col)
    books = trained(rows)
    if not len(books[0]):
        return df.sparkSession.createDataFrame([], "vec_id long, code string, error long, label_error long, codebooks_sha256 string")
    found = stored(assigned(rows, books), "vector-codes")
    # Stored, so that the join is of two shuffles that Spark can split where one label is very common.
    by_label = stored(found.groupBy("label").agg(F.sum(F.col("error").cast("decimal(38,0)")).alias("total")), "label-errors")
    by_label = by_label.select(F.col("label").alias("of"), F.expr("try_cast(total AS long)").alias("label_error"))
    joined = found.join(by_label, F.col("label").eqNullSafe(F.col("of")))
    return joined.select("vec_id", "code", "error", "label_error", F.lit(digest(books)).alias("codebooks_sha256"))
