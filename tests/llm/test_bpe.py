import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrion.llm import bpe

RANKS, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@given(st.text(alphabet=st.sampled_from("ab1' \n\t\xa0\x1cé.日s"), max_size=60), st.integers(1, 9))
@settings(max_examples=300, deadline=None)
def test_cut_texts_encode_as_whole(text, cut_at):
    enc = bpe.encoding(RANKS, PATTERN)
    got = [i for whole, p in bpe.pieces(text, cut_at) for i in (enc._encode_single_piece(p) if whole else enc.encode_ordinary(p))]
    assert got == enc.encode_ordinary(text)


@pytest.mark.parametrize("text", ["x" + " " * 9000 + "y", "x" + "\n" * 9000 + "y", " " * 9000, "a \t" + " " * 5000 + "\n\n\nb " * 2])
def test_long_white_space(text):
    assert bpe.encode_text(RANKS, PATTERN, text) == bpe.encoding(RANKS, PATTERN).encode_ordinary(text)


def test_very_long_white_space_does_not_fail():
    assert bpe.encode_text(RANKS, PATTERN, "x" + " " * 3_000_000 + "y")


def test_round_trip_keeps_rows_and_columns(spark):
    rows = [(1, "héllo 'ssays\n\n x", "k"), (1, "héllo 'ssays\n\n x", "k"), (2, None, None), (3, "", "z"), (4, "word " * 40000, "q"), (None, "日本語 <|endoftext|>", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    enc = bpe.encoding(RANKS, PATTERN)
    got = sorted(((r.doc_id or 0, r.text or "", bytes(r.ids), bytes(r.decoded)) for r in out.collect()))
    want = sorted((i or 0, t or "", np.array(enc.encode_ordinary(t or ""), "<u4").tobytes(), (t or "").encode()) for i, t, _ in rows)
    assert got == want
    assert bpe.ids_array(out).where("doc_id = 2").first().id_array == []


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert bpe.decode(bpe.encode(df, RANKS, PATTERN), RANKS, PATTERN).count() == 0


def test_query(spark):
    from papyrion.llm.queries import op1_bpe

    got = {r.doc_id: r for r in op1_bpe(spark, "/root/testdata/sf0.001").collect()}
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    enc = bpe.encoding(RANKS, PATTERN)
    assert len(got) == len(docs)
    for d in docs:
        ids = enc.encode_ordinary(d.text)
        r = got[d.doc_id]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(d.text.encode()).hexdigest()


def test_other_patterns_are_not_cut():
    """A pattern whose matches may end in a line feed, so that a cut before one would change them."""
    pattern, text = r"\p{L}+\n?|\s+|[^\s\p{L}]+", "word\n" * 50000
    assert bpe.encode_text(RANKS, pattern, text) == bpe.encoding(RANKS, pattern).encode_ordinary(text)
