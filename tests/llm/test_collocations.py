import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from papyrion.llm import collocations
from papyrion.llm.perfect_hash import PerfectHash

SCHEMA = "doc_id long, lang string, text string, n long, rank int"


def brute(rows, least, longest=4, top=2000):
    count, size = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")):
            words = re.findall("[^ \t]+", piece)
            size[lang] += len(words)
            for n in range(1, longest + 1):
                count[lang].update(tuple(words[i : i + n]) for i in range(len(words) - n + 1))
    out = []
    for lang, f in count.items():
        often = {p: n for p, n in f.items() if n >= least and len(p) > 1}
        inside = lambda s, p: len(s) < len(p) and any(p[i : i + len(s)] == s for i in range(len(p)))
        found = []
        for p, a in often.items():
            if not any(100 * b >= 80 * a and inside(p, q) for q, b in often.items()):
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                found.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        out += [(lang, i, p.decode(), -a, left, right, size[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


def mined(spark, rows, least, **more):
    df = spark.createDataFrame([(i, x, t, 1, 1) for i, (x, t) in enumerate(rows)], SCHEMA).repartition(3)
    return sorted(tuple(r) for r in collocations.mine(df, least=least, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


def some(seed, n=300, vocabulary=25):
    rng = np.random.default_rng(seed)
    words = ["ab", "AB", "é", "naïve", "x-y", "don't", "zz" * 40, "Ünder", "\x01", "’", *(f"w{i}" for i in range(vocabulary))]
    p = 1 / np.arange(1, len(words) + 1)
    rows = []
    for _ in range(n):
        picked = rng.choice(words, rng.integers(0, 60), p=p / p.sum())
        seps = rng.choice([" ", "  ", "\t", ". ", ",", "\n", " ; "], len(picked), p=[0.8, 0.05, 0.03, 0.04, 0.03, 0.03, 0.02])
        rows.append(([None, "und", "en", "en", "de"][rng.integers(5)], "".join(w + s for w, s in zip(picked, seps, strict=True))))
    return rows


@pytest.mark.parametrize("least, top", [(5, 2000), (12, 7), (1, 2000)])
def test_same_as_counting_every_phrase(spark, least, top):
    rows = some(least, 120 if least == 1 else 300)
    assert mined(spark, rows, least, top=top) == brute(rows, least, top=top)


def test_passes_shards_and_pieces_lose_nothing(spark, monkeypatch):
    for name, value in {"MOST_BUCKETS": 256, "MOST_SLOTS": 40, "SHARD": 30, "PIECE": 64, "LOAD": 2, "BLOCK": 300, "ROW": 100, "FAN_IN": 2}.items():
        monkeypatch.setattr(collocations, name, value)
    rows = some(3) + [("en", "long " + "q" * 700 + " word " + "q" * 700 + " word")] * 6
    assert mined(spark, rows, 5) == brute(rows, 5)


def test_nulls_copies_and_empty_tables(spark):
    assert mined(spark, [], 2) == [] and mined(spark, [(None, None), ("en", ""), ("en", " .,\t")], 1) == []
    rows = [(None, "a b c"), ("und", "a b. c"), ("", "a b c"), ("", None), ("en", "a\tb  c")] * 4
    assert mined(spark, rows, 3) == brute(rows, 3)


def test_one_very_common_phrase(spark):
    rows = [("en", "same words come again " * 200)] * 20 + some(4, 60)
    assert mined(spark, rows, 6) == brute(rows, 6)


def test_the_perfect_hash_is_minimal_and_knows_its_keys():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 50_000, np.uint64))
    table = PerfectHash(keys[::2])
    assert sorted(table.slots(keys[::2])) == list(range(len(keys[::2])))
    assert (table.slots(keys[1::2]) == -1).all()
    assert PerfectHash(keys[:0]).slots(keys[:3]).tolist() == [-1] * 3
