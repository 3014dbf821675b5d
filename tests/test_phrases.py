"""Phrases and packing against plain readings of their rules."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from papyrion.operators import packing, phrases, topics
from papyrion.queries import QUERIES

CONNECTORS = set(phrases.CONNECTORS)


def vocabulary(texts):
    counts, total = Counter(), 0
    for words in texts:
        start, between = None, []
        for w in words:
            total += 1
            if w in CONNECTORS:
                if start is not None:
                    between.append(w)
                continue
            counts[w] += 1
            if start is not None:
                counts["_".join([start, *between, w])] += 1
            start, between = w, []
    return counts, total


def merged(texts, least, threshold):
    """One round by a fold over the words, whose state is the open word and the connectors after it."""
    counts, total = vocabulary(texts)

    def good(phrase, a, b):
        n = counts[phrase]
        return n >= least and math.log(n / total / (counts[a] / total * (counts[b] / total))) / -math.log(n / total) > threshold

    out = []
    for words in texts:
        done, start, between = [], None, []
        for w in words:
            if w in CONNECTORS:
                (done if start is None else between).append(w)
            elif start is None:
                start = w
            elif good(phrase := "_".join([start, *between, w]), start, w):
                done.append(phrase)
                start, between = None, []
            else:
                done += [start, *between]
                start, between = w, []
        out.append(done + ([] if start is None else [start, *between]))
    return out


def detected(spark, texts, least, threshold):
    df = spark.createDataFrame(list(enumerate(texts)), "id long, words array<string>")
    out, _ = phrases.detect_phrases(df, "id", "words", least, threshold)
    return [r.words for r in out.orderBy("id").collect()]


@pytest.mark.parametrize("least, threshold", [(2, 0.1), (5, 0.5), (1, -1.0)])
def test_merged_texts_are_those_of_a_fold(spark, least, threshold):
    rng = np.random.default_rng(least)
    vocabulary_ = ["the", "of", "and", "a", *"bcdefghij", "b_c", "c_d"]
    p = 1 / np.arange(1, len(vocabulary_) + 1)
    texts = [[str(w) for w in rng.choice(vocabulary_, rng.integers(0, 40), p=p / p.sum())] for _ in range(150)] + [[], ["x"], ["the"], ["the", "of"]]
    want = merged(merged(texts, least, threshold), least, threshold)
    assert detected(spark, texts, least, threshold) == want


def test_overlapping_pairs_and_connectors(spark):
    """Of a b and b c the first is joined; a third word joins in the second round."""
    texts = [["x", "y", "z"]] * 8 + [["state", "of", "the", "art", "end"]] * 8 + [["p", "q", "p", "q", "p"]] * 8
    want = merged(merged(texts, 5, 0.3), 5, 0.3)
    got = detected(spark, texts, 5, 0.3)
    assert got == want and got[0] == ["x_y_z"] and "state_of_the_art" in "".join(got[8])


def test_query_is_a_plain_reading_of_all_documents(spark):
    d = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", topics.tokens(F.col("text")).alias("w")).collect()
    texts = [r.w for r in docs]
    want = merged(merged(texts, 5, 0.5), 5, 0.5)
    got = {r.doc_id: r for r in QUERIES["phrase_texts"](spark, d).collect()}
    assert {r.doc_id: hashlib.md5(" ".join(w).encode()).hexdigest() for r, w in zip(docs, want, strict=True)} == {i: r.digest for i, r in got.items()}
    assert any(r.phrases for r in got.values())


def plain_counts(text, listed, upper_only=()):
    """The rule of the list, phrase by phrase."""
    tokens, out = list(re.finditer(r"[^\W_]+", text)), {}
    for phrase in listed:
        if phrase in upper_only:
            n = len(re.findall(rf"\b{re.escape(phrase.upper())}\b", text))
        elif re.fullmatch(r"[^\W_]+(?:[ _][^\W_]+)*", phrase):
            width, forms = len(re.findall(r"[^\W_]+", phrase)), {phrase.lower(), phrase.replace("_", " ").lower()}
            n = sum(text[tokens[i].start() : tokens[i + width - 1].end()].lower() in forms for i in range(len(tokens) - width + 1))
        else:
            n = len(re.findall(rf"\b{re.escape(phrase)}\b|\b{re.escape(phrase.replace('_', ' '))}\b", text, re.I))
        if n:
            out[phrase] = n
    return out


def matched(spark, texts, listed, upper_only=()):
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    rows = phrases.match_phrases(df, "id", "text", spark.createDataFrame([(p,) for p in listed], "phrase string"), upper_only).collect()
    return {(r.id, r.phrase): r.n for r in rows}


def test_surfaces_patterns_and_upper_case(spark, monkeypatch):
    texts = [
        "Machine learning, machine-learning; machine  learning machine_learning MACHINE LEARNING machinelearning", "AI ai Ai (AI) AIs a.i. A.I.",
        "e-commerce E-Commerce ecommerce xe-commerce", "ÉCOLE école İstanbul istanbul x İx machine learning", "", None, "learning learning learning", "c++ C++ c",
    ]
    listed = ["machine_learning", "machine learning", "learning", "ai", "e-commerce", "école", "learning learning", "a.i.", "c++", "x_machine", " ", "İstanbul"]
    want = {(i, p): n for i, t in enumerate(texts) for p, n in plain_counts(t or "", [x for x in listed if x.strip()], ["ai"]).items()}
    assert matched(spark, texts, listed, ["ai"]) == want
    monkeypatch.setattr(phrases, "MOST_CHARACTERS", 40)  # several passes
    assert matched(spark, texts, listed, ["ai"]) == want
    assert matched(spark, texts, []) == {}


def test_ten_thousand_phrases(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").limit(60).collect()]
    words = [re.findall(r"[^\W_]+", t) for t in texts]
    rng = np.random.default_rng(5)
    listed = {"_".join(w[i : i + int(rng.integers(1, 5))]) for w in words for i in range(len(w))}
    listed = sorted(listed)[:: max(1, len(listed) // 10_000)][:10_000]
    index = {p: tuple(re.findall(r"[^\W_]+", p.lower())) for p in listed}
    want = Counter()
    for i, t in enumerate(texts):
        tokens = list(re.finditer(r"[^\W_]+", t))
        low = [m[0].lower() for m in tokens]
        runs = {tuple(low[a : a + n]) for n in range(1, 5) for a in range(len(low) - n + 1)}
        near = [p for p in listed if index[p] in runs]
        want.update({(i, p): n for p, n in plain_counts(t, near).items()})
    assert len(listed) > 5000 and matched(spark, texts, listed) == dict(want)


def greedy(costs, budget):
    chunk, used, out = 1, 0, []
    for i, c in enumerate(costs):
        if i and used + c > budget:
            chunk, used = chunk + 1, 0
        used += c
        out.append(chunk)
    return out


@pytest.mark.parametrize("budget", [50, 300, 1000, 10**6])
def test_packing_is_greedy(spark, budget):
    rng = np.random.default_rng(budget)
    costs = [int(c) for c in rng.integers(1, 100, 400)]
    costs[17], costs[18], costs[-1] = 5000, 2000, 1001
    df = spark.createDataFrame([(i, c) for i, c in rng.permutation(list(enumerate(costs))).tolist()], "id long, cost long")
    got = [r.chunk for r in packing.pack(df, ["id"], "cost", budget).orderBy("id").collect()]
    assert got == greedy(costs, budget)
    sums = [r._upto for r in packing.running_sum(df, ["id"], "cost").orderBy("_i").collect()]
    assert sums == np.cumsum(costs).tolist()
    assert packing.pack(df.limit(0), ["id"], "cost", budget).count() == 0
