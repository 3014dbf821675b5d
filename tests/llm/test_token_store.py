import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from papyrion.llm import token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def store(spark, tmp_path, rows, **more):
    df = spark.createDataFrame(rows, "doc_id long, text string, start string, ids int")
    token_store.write_store(df, str(tmp_path / "store"), PATH, **more)
    return token_store.read_store(spark, str(tmp_path / "store"))


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 70000), st.integers(0, 2**32 - 1)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_code_round_trip(values):
    ranks = np.array(values, np.uint32)
    control, data = token_store.encode_ranks(ranks)
    assert len(control) == -(-len(values) // 4)
    assert len(data) == sum(max(1, (v.bit_length() + 7) // 8) for v in values)
    assert token_store.decode_ranks(control, data, len(values)).tolist() == values


def test_frequent_ids_take_one_byte():
    assert token_store.encode_ranks(np.array([0, 255, 256, 65535, 65536], np.uint32))[1] == bytes([0, 255, 0, 1, 255, 255, 0, 0, 1])


@given(st.text(alphabet=st.sampled_from("abZ12'' \n\n\t\xa0\xad×éƀ.,日<|!-_²"), max_size=50))
@settings(max_examples=1500, deadline=None)
def test_chunks_encode_as_the_whole(tokenizer, text):
    assert np.frombuffer(token_store.encode_text(PATH, text), np.uint16).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.sampled_from("ab.  \n\té\x1c\xa0\u2003\x85"), max_size=12)), max_size=12), st.integers(1, 30))
@settings(max_examples=200, deadline=None)
def test_runs_of_texts_encode_as_each(texts, run_bytes):
    kept, token_store.RUN_BYTES = token_store.RUN_BYTES, run_bytes
    try:
        assert list(token_store.encode_texts(PATH, pa.array(texts, pa.string()))) == [token_store.encode_text(PATH, t or "") for t in texts]
    finally:
        token_store.RUN_BYTES = kept


PIECES = ["<|endoftext|>", "<|endoftext|", "|>", "<|", " ", "  ", "\n", "\t", "a", "word", "don't", "12", ".", "é", "日", "\u2003", "<", ">"]


def test_added_tokens_are_those_of_the_library(tokenizer):
    """10,000 texts with the special token's content, glued to others and spaced."""
    rng = np.random.default_rng(5)
    texts = ["".join(PIECES[i] for i in rng.integers(0, len(PIECES), rng.integers(1, 12))) for _ in range(10000)]
    want = [np.array(e.ids, np.uint16).tobytes() for e in tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert [token_store.encode_text(PATH, t) for t in texts] == want
    assert list(token_store.encode_texts(PATH, pa.array(texts, pa.string()))) == want
    assert sum(np.uint16(50256) in np.frombuffer(w, np.uint16) for w in want) > 1000


def test_rows_of_one_id_are_dealt_out(spark, tmp_path):
    rows = [(7, f"text {i}", "a", 1) for i in range(4000)]
    got = store(spark, tmp_path, rows, shards=8)
    assert got.count() == 4000 and got.select("start").distinct().count() == 4000
    assert spark.read.parquet(str(tmp_path / "store" / "blocks")).select("shard").distinct().count() > 4


def test_edges(spark, tmp_path, tokenizer):
    long = "word and word, " * 90000
    rows = [(9, "nine <|endoftext|> x", "a", 1), (None, "no id", None, 2), (2, "b", "a", None), (2, "a", "a", 1), (2, "a", "a", 1), (4, None, "a", 1), (5, "", "a", 1), (7, long, "a", 1)]
    got = store(spark, tmp_path, rows, shards=3).collect()
    h = {t: spark.sql(f"SELECT xxhash64('{t}')").first()[0] for t in "ab"}
    in_order = sorted(["b", "a", "a"], key=h.__getitem__)
    encode = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    order = [(None, "no id"), *((2, t) for t in in_order), (4, None), (5, ""), (7, long), (9, "nine <|endoftext|> x")]
    got = sorted(got, key=lambda r: r.start)
    start = 0
    for r, (i, t) in zip(got, order, strict=True):
        ids = encode(t)
        assert (r.doc_id, r.start, r.n_tokens) == (i, start, len(ids))
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ids
        start += len(ids)


def test_empty_table(spark, tmp_path):
    assert store(spark, tmp_path, []).count() == 0


def test_query(spark, tokenizer):
    from papyrion.llm.queries import op6_token_ids

    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect())
    want, start = [], 0
    for i, text in docs:
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = op6_token_ids(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in got) == want
