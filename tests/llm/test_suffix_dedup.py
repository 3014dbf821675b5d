import hashlib
from collections import Counter

import numpy as np
import pytest

from papyrion.llm import suffix_dedup

SCHEMA = "doc_id long, text string, part int, block long, keys string"


def brute(texts, n=suffix_dedup.N):
    """{row: (bytes, removed, spans, hash)} by every string of n bytes."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + n] for d in data for i in range(len(d) - n + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, bool)
        for i in range(len(d) - n + 1):
            if seen[d[i : i + n]] > 1:
                gone[i : i + n] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum())
        out.append((len(d), int(gone.sum()), spans, hashlib.sha256(bytes(b for b, g in zip(d, gone, strict=False) if not g)).hexdigest()))
    return out


def removed(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    rows = suffix_dedup.remove_repeats(spark.createDataFrame([(i, t, 1, 2, "x") for i, t in zip(ids, texts, strict=True)], SCHEMA)).collect()
    return sorted((tuple(r) for r in rows), key=repr)


def same(spark, texts, ids=None):
    ids = list(range(len(texts))) if ids is None else ids
    assert removed(spark, texts, ids) == sorted(((i, *b) for i, b in zip(ids, brute(texts), strict=True)), key=repr)


def letters(rng, n, alphabet="abcdefghij klmnop"):
    return "".join(rng.choice(list(alphabet), n))


@pytest.mark.parametrize("seed", range(3))
def test_random_texts_with_shared_passages(spark, seed, monkeypatch):
    """Passages around N bytes, copies with edits, overlaps of several passages, and chunk borders."""
    monkeypatch.setattr(suffix_dedup, "CHUNK", [700, 1 << 20, 5000][seed])
    monkeypatch.setattr(suffix_dedup, "BLOCK", [2000, 1 << 20, 20000][seed])
    rng = np.random.default_rng(seed)
    pool = [letters(rng, int(n)) for n in rng.integers(150, 900, 12)]
    texts = []
    for _ in range(60):
        parts = []
        for _ in range(rng.integers(0, 6)):
            p = pool[rng.integers(len(pool))]
            i = int(rng.integers(0, len(p) // 2))
            parts += [letters(rng, int(rng.integers(0, 80))), p[i : i + int(rng.integers(100, 800))]]
        t = "".join(parts)
        if t and rng.random() < 0.3:
            i = int(rng.integers(len(t)))
            t = t[:i] + "ä" + t[i + 1 :]
        texts.append(t)
    same(spark, texts)


def test_lengths_about_the_limit(spark):
    rng = np.random.default_rng(5)
    for n in (199, 200, 201, 368, 369, 400):
        p = letters(rng, n)
        same(spark, [letters(rng, 50) + p + letters(rng, 40), p + letters(rng, 300), letters(rng, 300) + p])


def test_one_long_occurrence_serves_partial_ones(spark):
    """Strings of a text with edits are found in texts that agree with each other throughout."""
    rng = np.random.default_rng(8)
    base = letters(rng, 3000)
    cut = [base[i : i + 230] for i in range(0, 2700, 45)]
    same(spark, [base, base, "".join(letters(rng, 30) + c for c in cut), base[:1500] + "#" + base[1501:]])


def test_periods_and_runs_of_one_letter(spark):
    same(spark, ["a" * 1000, "b" * 200, "b" * 199, "ab" * 150, "abc" * 67, "x" * 201, "y" + "a" * 199])


def test_nulls_copies_short_and_repeated_rows(spark):
    p = letters(np.random.default_rng(1), 400)
    same(spark, [None, "", "short", "short", p, p, p[:199], None], [1, 1, 2, 3, None, None, 7, 8])
    assert removed(spark, []) == []


def test_long_text(spark):
    rng = np.random.default_rng(2)
    p = letters(rng, 300_000)
    got = {r[0]: r[1:4] for r in removed(spark, [p + p[1000:1500], letters(rng, 1000), "é" * 150])}
    assert got == {0: (300_500, 1000, 2), 1: (1000, 0, 0), 2: (300, 300, 1)}


def test_names_of_deep_buckets():
    """Positions have one name to a depth if and only if so many bytes are equal."""
    data = np.frombuffer((b"abcabcab" * 40 + b"zz" + b"abcabcab" * 40), np.uint8)
    for depth in (8, 16, 32, 64, 128):
        names = suffix_dedup.bucket_names(data, depth)
        strings = [data[i : i + depth].tobytes() for i in range(len(names))]
        assert len(set(names.tolist())) == len(set(strings)) == len(set(zip(names.tolist(), strings, strict=True)))
