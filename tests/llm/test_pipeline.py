import hashlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from papyrion.llm import bpe

D = "/root/testdata/sf0.001"
BODY = " ".join(f"word{i}" for i in range(80))
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids int, _words int"
ROWS = [
    (1, BODY + " one", "en", "a", 5, "x", 1, 1), (2, BODY + " one", "en", "b", 5, None, 1, 1), (2, BODY + " other", "en", "b", 5, "x", 1, 1), (3, None, "en", "a", None, "x", 1, 1), (4, "", None, None, 0, "x", 1, 1),
    (None, BODY + " none", "en", "a", 5, "x", 1, 1), (6, BODY + " six " * 100000, "en", "a", 5, "x", 1, 1), (7, f"{BODY} seven\n\n  {BODY[::-1]}", None, None, None, None, None, None), (8, " ".join(f"long{i}" for i in range(100000)), "en", "a", 5, "x", 1, 1),
]


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """The rows after each stage over the smallest tables, written and read again."""
    folder, docs = tmp_path_factory.mktemp("stages"), spark.read.parquet(f"{D}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, found[-1], D).write.parquet(f"{folder}/{name}")
        found.append(spark.read.parquet(f"{folder}/{name}"))
    return found


def test_stages_keep_the_columns_of_documents(steps):
    for step in steps[1:-1]:
        assert step.columns == steps[0].columns and dict(step.dtypes) == dict(steps[0].dtypes)


def test_filters_only_drop(steps):
    ids = [{r.doc_id for r in s.select("doc_id").collect()} for s in steps]
    assert ids[0] > ids[1] > ids[2] >= ids[3] >= ids[4] and len(ids[3]) > 0.5 * len(ids[0])
    assert steps[3].count() == len(ids[3])


def test_one_of_each_group_stays(steps):
    from papyrion.llm import simhash

    groups = simhash.similar(steps[2])
    assert {r.doc_id for r in steps[3].collect()} == {r.c for r in groups.select(F.col("component_id").alias("c")).distinct().collect()}


def test_mix_repeats_rows(steps):
    per = {r.doc_id: r.n for r in steps[4].groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert set(per.values()) <= {1, 2}
    size = lambda s: s.agg(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]
    assert size(steps[4]) == pytest.approx(1.5 * size(steps[3]), rel=0.05)


def test_tokens_are_those_of_the_texts(steps):
    enc = bpe.encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    texts = {r.doc_id: r.text for r in steps[4].collect()}
    for r in steps[5].collect():
        ids = enc.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        assert hashlib.sha256(b"".join(enc.decode_tokens_bytes(ids))).digest() == hashlib.sha256(texts[r.doc_id].encode()).digest()


def test_run_gives_the_last_stage(spark, steps):
    assert corpus_pipeline.run(spark, D).count() == steps[-1].count()


@pytest.mark.parametrize("stage", range(5))
@pytest.mark.parametrize("rows", [ROWS, []])
def test_edges(spark, stage, rows):
    out = corpus_pipeline.STAGES[stage][1](spark, spark.createDataFrame(rows, SCHEMA), D)
    got = out.collect()
    assert len(got) <= 2 * len(rows) and len(set(map(str.lower, out.columns))) == len(out.columns)
    if rows and stage == 0:
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 2, 2, 7, 8]
    if rows and stage == 2:  # 6 has the shingles of 1 and few more, repeated ones counting once
        assert sorted(r.doc_id or 0 for r in got) == [0, 1, 3, 7, 8]
