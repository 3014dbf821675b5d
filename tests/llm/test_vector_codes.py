import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest

from papyrion.llm import vector_codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int"


def brute(rows, parts=16, entries=64, rounds=2):
    """The rows by all distances, in Python's integers."""
    kept = [(i, [math.floor(256 * float(np.float32(x))) for x in v], g) for i, v, g in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    kept.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    if not kept:
        return []
    w = len(kept[0][1]) // parts
    cut = lambda v, j: v[j * w : (j + 1) * w]
    books = [[cut(v, j) for _, v, _ in kept[:entries]] for j in range(parts)]
    best = lambda x, book: min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))
    for _ in range(rounds):
        for j in range(parts):
            members = defaultdict(list)
            for _, v, _ in kept:
                members[best(cut(v, j), books[j])[1]].append(cut(v, j))
            books[j] = [[sum(c) // len(members[k]) for c in zip(*members[k], strict=True)] if members[k] else e for k, e in enumerate(books[j])]
    sha = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    found = [(i, [best(cut(v, j), books[j]) for j in range(parts)], g) for i, v, g in kept]
    total = defaultdict(int)
    for _, f, g in found:
        total[g] += sum(d for d, _ in f)
    return sorted(((i, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f), total[g], sha) for i, f, g in found), key=repr)


def coded(spark, rows):
    df = spark.createDataFrame([(i, v, g, "x", 1) for i, v, g in rows], SCHEMA)
    return sorted((tuple(r) for r in vector_codes.compress(df).collect()), key=repr)


@pytest.mark.parametrize("spread", [0.004, 1.0, 30.0])
def test_same_as_all_distances(spark, spread):
    """Small spreads make many ties of distances and equal entries."""
    rng = np.random.default_rng(4)
    rows = [(int(i), (rng.normal(size=32) * spread).astype(np.float32).tolist(), [1, 1, None, 3][i % 4]) for i in rng.permutation(300)]
    assert coded(spark, rows) == brute(rows)


def test_rows_that_take_no_part_ties_and_repeats(spark):
    a, b = [0.5] * 16, [-0.25, 1.0] * 8
    rows = [(1, a, 1), (1, b, 1), (2, a, None), (None, b, None), (3, None, 1), (4, [None] + a[1:], 1), (5, [math.nan] + a[1:], 1), (6, [math.inf] + a[1:], 2), (7, b, 2), (7, b, 2)]
    assert coded(spark, rows) == brute(rows)
    assert coded(spark, rows + [(8, [1.0] * 15, 1), (9, [1.0] * 48, 1), (10, [], 1)]) == brute(rows)


def test_empty_tables(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1)]) == []


def test_components_of_any_size(spark):
    rng = np.random.default_rng(9)
    rows = [(i, (rng.normal(size=16) * 10.0 ** rng.integers(0, 7)).astype(np.float32).tolist(), i % 2) for i in range(90)]
    assert coded(spark, rows) == brute(rows)
    assert [r[2:4] for r in coded(spark, [(1, [0.0] * 16, 1), (2, [3e15] * 16, 1), (3, [3e15] * 15 + [0.0], 1)])] == [(0, 0)] * 3


def test_the_annulus_is_smaller_than_the_codebook_and_loses_nothing():
    rng = np.random.default_rng(1)
    book = rng.integers(-300, 300, (64, 4))
    points = book[rng.integers(0, 64, 5000)] + rng.integers(-20, 20, (5000, 4))
    code, error, evaluated = vector_codes.nearest(points, book)
    every = ((points[:, None, :] - book[None]) ** 2).sum(axis=2)
    assert (code == every.argmin(axis=1)).all() and (error == every.min(axis=1)).all()
    assert evaluated < 0.6 * every.size


def test_query(spark):
    from papyrion.llm.queries import op13_vector_codes

    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert sorted((tuple(r) for r in op13_vector_codes(spark, "/root/testdata/sf0.001").collect()), key=repr) == brute(rows)
