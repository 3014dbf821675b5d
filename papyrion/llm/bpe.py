"""Byte-level BPE encoding and decoding with a local rank file.

Ids are kept as one binary column, little-endian unsigned 32-bit integers: compact in shuffles and
Parquet, hashed by the JVM as they stand, and read by numpy without a copy. ``ids_array`` gives
them as an array.

Long texts are cut at safe boundaries before the library sees them, if the split pattern is the one
that the boundaries are safe for. A cut between a character that
is not white space and a following space or line feed never changes a match of the split pattern:
every alternative is either all white space or has it at its start only. Runs of very much white
space, on which the library's regular expression engine overflows its stack, are encoded as the
one match they are.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from public_tokenizers import PATTERN
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters after which a long text is cut at the next safe boundary.
CUT_AT = 1 << 16
#: A longer run of white space bypasses the regular expression.
LONG_SPACE = 4096

# The characters with Unicode's White_Space property, which the split pattern's \s matches.
_WHITE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
_RUN = re.compile(f"[{_WHITE}]{{{LONG_SPACE},}}")
_SAFE = re.compile(f"[^{_WHITE}\\x1c-\\x1f](?=[ \\n])")


@lru_cache(maxsize=4)
def encoding(ranks_path: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoding for a rank file, loaded once per Python worker."""
    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _whole(ranks_path: str) -> tiktoken.Encoding:
    """An encoding that takes any text for one match."""
    return encoding(ranks_path, "(?s:.+)")


def pieces(text: str, cut_at: int = CUT_AT) -> Iterator[tuple[bool, str]]:
    """The text in order as (is one match, piece); other pieces are matched each for itself."""
    at = 0
    for run in _RUN.finditer(text):
        start, end = run.span()
        if start < at:
            continue
        yield from _cut(text, at, start, cut_at)
        # The last white space before other characters belongs to the next match or is one of its own.
        at = end if end == len(text) else end - 1
        yield True, text[start:at]
    yield from _cut(text, at, len(text), cut_at)


def _cut(text: str, at: int, end: int, cut_at: int) -> Iterator[tuple[bool, str]]:
    while end - at > cut_at and (safe := _SAFE.search(text, at + cut_at, end)):
        yield False, text[at : safe.end()]
        at = safe.end()
    if at < end:
        yield False, text[at:end]


def encode_text(ranks_path: str, pattern: str, text: str) -> list[int]:
    """The ids of a whole text. With a pattern that the boundaries are not known to be safe for, the
    library gets it uncut."""
    enc = encoding(ranks_path, pattern)
    if len(text) <= LONG_SPACE or pattern != PATTERN:
        return enc.encode_ordinary(text)
    ids: list[int] = []
    for whole, piece in pieces(text):
        ids += (_whole(ranks_path) if whole else enc).encode_ordinary(piece)
    return ids


def encode(df: DataFrame, ranks_path: str, pattern: str, text_col: str = "text", out_col: str = "ids") -> DataFrame:
    """Adds ``out_col``: the ids of each whole text as little-endian unsigned 32-bit integers.

    Null and empty texts give no ids. Repeated rows, other columns and their nulls stay as they
    are. ``out_col`` replaces a column of that name. No shuffle: one Arrow batch at a time, so
    memory is bounded by a batch and the longest text.
    """

    @F.arrow_udf("binary")
    def ids_of(texts: pa.Array) -> pa.Array:
        return pa.array([np.array(encode_text(ranks_path, pattern, t.as_py() or ""), "<u4").tobytes() for t in texts], pa.binary())

    return df.withColumn(out_col, ids_of(F.col(text_col).cast("string")))


@lru_cache(maxsize=4)
def _token_bytes(ranks_path: str, pattern: str) -> list[bytes]:
    enc = encoding(ranks_path, pattern)
    return [enc.decode_single_token_bytes(i) for i in range(enc.n_vocab)]


def decode(df: DataFrame, ranks_path: str, pattern: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds ``out_col``: the raw bytes that the ids stand for, without a check that they are UTF-8,
    since an id sequence may end inside a character. Null ids give no bytes; an id that the rank
    file lacks is an error."""

    @F.arrow_udf("binary")
    def bytes_of(ids: pa.Array) -> pa.Array:
        table = _token_bytes(ranks_path, pattern)
        return pa.array([b"".join([table[i] for i in np.frombuffer(x.as_py() or b"", "<u4").tolist()]) for x in ids], pa.binary())

    return df.withColumn(out_col, bytes_of(F.col(ids_col)))


def n_ids(ids: Column) -> Column:
    """How many ids a binary id column holds."""
    return (F.coalesce(F.octet_length(ids), F.lit(0)) / 4).cast("long")


def ids_array(df: DataFrame, ids_col: str = "ids", out_col: str = "id_array") -> DataFrame:
    """Adds the ids as array<bigint>."""

    @F.arrow_udf("array<bigint>")
    def listed(ids: pa.Array) -> pa.Array:
        return pa.array([np.frombuffer(x.as_py() or b"", "<u4").astype(np.int64) for x in ids], pa.list_(pa.int64()))

    return df.withColumn(out_col, listed(F.col(ids_col)))
