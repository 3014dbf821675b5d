"""Token-ID files: frequency-ranked ids in a byte-aligned variable-length code.

A store is a folder of Parquet tables written by Spark's committer. ``ranks`` has the id of every
frequency rank. ``blocks`` has, in order, blocks of whole documents: shard (its place in id order),
start (tokens before the block in its shard), the documents' ids and token counts, and two byte
streams: ``control`` with two bits for each token, how many bytes its rank takes less one, and
``data`` with those bytes, least first. The most frequent 256 ids take one byte. Decoding is a
lookup in a table of 256 byte masks, one for each control byte, and a numpy assignment by mask.

Documents are put in order once, by a range partition of the texts. Each partition is encoded by
one task in passing; the frequencies then come from the stored ids, combined in each task to one
row an id, and the code is a map over the stored blocks. A task holds a block at a time, and the
table of ranks is bounded by the vocabulary.
"""

from __future__ import annotations

import json
import re
from array import array
from codecs import charmap_decode
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from papyrion.llm.shared import stored

#: A block is closed once it holds so many tokens; a document is never split.
BLOCK_TOKENS = 1 << 18
#: Words and other chunks whose ids a Python worker remembers, and the longest that it does.
REMEMBERED, LONGEST = 1_000_000, 40
#: Bytes of texts that are split at once; a longer text is split alone.
RUN_BYTES = 1 << 24
#: The id that ends a document.
END_ID = 0

_BLOCK = "shard int, start long, n_tokens long, doc_ids array<long>, counts array<long>"
_UNSAFE = re.compile(r"\s ")
#: The same for Arrow, whose \s is ASCII alone.
_ARROW_UNSAFE = r"[\x09-\x0d\x1c-\x20\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}] "
_SPLIT = re.compile(r"(?<!\s) ")
#: A run of Latin letters or digits with ASCII punctuation after it, which may be all of it. Apostrophes
#: are left out, since the split pattern has words that begin with one.
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af]*|[0-9]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> str:
    """The letters that stand for the bytes in a byte-level vocabulary: a byte's own where that is
    printable and no space, else the next one from U+0100."""
    others = iter(range(256, 512))
    return "".join(chr(b) if chr(b).isprintable() and b != 32 else chr(next(others)) for b in range(256))


class _Chunks(dict):
    """The ids, as bytes, of chunks that follow a space (or begin a text), encoded when first met.

    A plain run is one match of the split pattern, or a word's and its marks', and goes to the
    library's model; lines of plain runs are put together. Anything else, and whatever holds an added
    token's content, is encoded by the library as it stands.
    """

    def __init__(self, tokenizer: Tokenizer, prefix: str, start: _Chunks | None = None):
        self.encode, self.tokenize, self.prefix, self.letters = tokenizer.encode, tokenizer.model.tokenize, prefix, _byte_letters()
        self.start = self if start is None else start
        self.kind = "H" if tokenizer.get_vocab_size() <= 1 << 16 else "I"
        told = json.loads(tokenizer.to_str())
        split = told["pre_tokenizer"] or {}
        self.plain = told["normalizer"] is None and (split.get("type"), split.get("add_prefix_space"), split.get("use_regex", True)) == ("ByteLevel", False, True)
        # The library takes these for one id each wherever they stand; white space next to or in one forbids cuts.
        self.added = [t["content"] for t in told["added_tokens"]]
        self.cuts = self.plain and not any(t["lstrip"] or t["rstrip"] or re.search(r"\s", t["content"]) for t in told["added_tokens"])

    def __missing__(self, chunk: str) -> bytes:
        if not self.plain or not chunk or any(t in chunk for t in self.added):
            ids = self._whole(chunk)
        elif chunk.isascii() and chunk.isalpha():
            ids = self._match(chunk)
        elif m := _PLAIN.fullmatch(chunk):
            word, marks = m.groups()
            if word and marks:
                return self[word] + self.start[marks]
            ids = self._match(chunk)
        elif len(lines := chunk.split("\n")) > 1 and all(line and _PLAIN.fullmatch(line) for line in lines):
            end = self.start._match("\n")
            return self[lines[0]] + b"".join([end + self.start[line] for line in lines[1:]])
        else:
            ids = self._whole(chunk)
        if len(self) < REMEMBERED and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids

    def _whole(self, chunk: str) -> bytes:
        return array(self.kind, self.encode(self.prefix + chunk, add_special_tokens=False).ids).tobytes()

    def _match(self, piece: str) -> bytes:
        letters = charmap_decode((self.prefix + piece).encode(), "strict", self.letters)[0]
        return array(self.kind, [t.id for t in self.tokenize(letters)]).tobytes()


@lru_cache(maxsize=2)
def _chunks(path: str) -> tuple[_Chunks, _Chunks]:
    tokenizer = Tokenizer.from_file(path)
    first = _Chunks(tokenizer, "")
    return first, _Chunks(tokenizer, " ", first)


def encode_text(path: str, text: str) -> bytes:
    """The text's ids as unsigned 16-bit integers, 32-bit for vocabularies that need it, exactly as the
    library gives them for the whole.

    A space after a character that is not white space always begins a match of the byte-level
    split pattern, so the chunks between such spaces encode each for itself; most are words that
    the worker has met before.
    """
    first, after = _chunks(path)
    if not first.cuts:
        return first._whole(text)
    parts = _SPLIT.split(text) if _UNSAFE.search(text) else text.split(" ")
    return first[parts[0]] + b"".join(map(after.__getitem__, parts[1:]))


def encode_texts(path: str, texts: pa.Array) -> Iterator[bytes]:
    """encode_text() of each text, null as empty. Runs of texts are split and their chunks told apart
    by Arrow, so that each different chunk is looked up once a run."""
    first, after = _chunks(path)
    texts = texts.fill_null("")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + RUN_BYTES, side="right")))
        run = texts.slice(at, to - at)
        at = to
        unsafe = pc.match_substring_regex(run, _ARROW_UNSAFE).to_pylist() if first.cuts else [True] * len(run)
        whole = [t.as_py() if u else None for t, u in zip(run, unsafe, strict=True)]
        split = pc.split_pattern(run.filter(pa.array([t is None for t in whole])), " ")
        chunks = split.flatten()
        told = chunks.dictionary_encode()
        table = list(map(after.__getitem__, told.dictionary.to_pylist()))
        codes, offsets, i = told.indices.to_numpy().tolist(), split.offsets.to_pylist(), 0
        for text in whole:
            if text is not None:
                yield encode_text(path, text)
                continue
            lo, hi = offsets[i], offsets[i + 1]
            i += 1
            yield first[chunks[lo].as_py()] + b"".join(map(table.__getitem__, codes[lo + 1 : hi]))


def encode_ranks(ranks: np.ndarray) -> tuple[bytes, bytes]:
    """(control, data) of unsigned 32-bit ranks."""
    lengths = 1 + (ranks > 0xFF) + (ranks > 0xFFFF) + (ranks > 0xFFFFFF)
    data = ranks.astype("<u4").view(np.uint8).reshape(-1, 4)[np.arange(4) < lengths[:, None]]
    codes = np.zeros(-(-len(ranks) // 4) * 4, np.uint8)
    codes[: len(ranks)] = lengths - 1
    control = (codes.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(axis=1, dtype=np.uint8)
    return control.tobytes(), data.tobytes()


#: For each control byte, which of the 16 bytes of its four values are in the data.
_MASKS = np.arange(4) <= ((np.arange(256)[:, None] >> np.array([0, 2, 4, 6])) & 3)[:, :, None]


def decode_ranks(control: bytes, data: bytes, n: int) -> np.ndarray:
    """The n ranks of a control and a data stream."""
    mask = _MASKS[np.frombuffer(control, np.uint8)].reshape(-1, 4)[:n]
    out = np.zeros((n, 4), np.uint8)
    out[mask] = np.frombuffer(data, np.uint8)
    return out.view("<u4").ravel()


def write_store(df: DataFrame, path: str, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, shards: int | None = None) -> None:
    """Writes every text's ids, each ended by ``end_id``, in ascending order of ``id_col``.

    Null and empty texts are the end id alone. Null ids come first; rows that repeat an id stand in
    the order of a hash of their texts, so that they need not meet in one task. Other columns are not
    stored. An empty table makes a store without blocks.
    """
    spark = df.sparkSession
    shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))
    vocab = Tokenizer.from_file(tokenizer_path).get_vocab_size()
    raw = "<u2" if vocab <= 1 << 16 else "<u4"

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, start, ids, counts, parts, held = TaskContext.get().partitionId(), 0, [], [], [], 0

        def block() -> pa.RecordBatch:
            values = [[shard], [start], [held], [ids], [counts], [b"".join(parts)]]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], ["shard", "start", "n_tokens", "doc_ids", "counts", "ids"])

        ending = np.array([end_id], raw).tobytes()
        for batch in batches:
            for doc_id, encoded in zip(batch.column(0).to_pylist(), encode_texts(tokenizer_path, batch.column(1)), strict=True):
                encoded += ending
                ids.append(doc_id)
                counts.append(len(encoded) // len(ending))
                parts.append(encoded)
                held += counts[-1]
                if held >= BLOCK_TOKENS:
                    yield block()
                    start, ids, counts, parts, held = start + held, [], [], [], 0
        if ids:
            yield block()

    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("h", F.xxhash64("text")).repartitionByRange(shards, "doc_id", "h").sortWithinPartitions("doc_id", "h", "text")
    first = stored(docs.select("doc_id", "text").mapInArrow(blocks, f"{_BLOCK}, ids binary"), "token-ids")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(vocab, np.int64)
        for batch in batches:
            for ids in batch.column(0):
                total += np.bincount(np.frombuffer(ids.as_py(), raw), minlength=vocab)
        found = np.nonzero(total)[0]
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(total[found])], ["id", "n"])

    counts = first.select("ids").mapInArrow(counted, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))
    ranked = counts.orderBy(F.desc("n"), "id").collect()  # bounded by the vocabulary
    id_of = np.array([r.id for r in ranked], np.int64)
    rank_of = np.zeros(vocab, np.uint32)
    rank_of[id_of] = np.arange(len(id_of))
    rows = list(enumerate(id_of.tolist()))
    spark.createDataFrame(rows, "rank long, id long").coalesce(1).write.parquet(f"{path}/ranks")

    def coded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            streams = [encode_ranks(rank_of[np.frombuffer(x.as_py(), raw)]) for x in batch.column("ids")]
            kept = [batch.column(c) for c in batch.schema.names if c != "ids"]
            both = [pa.array([s[k] for s in streams], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*kept, *both], [c for c in batch.schema.names if c != "ids"] + ["control", "data"])

    first.mapInArrow(coded, f"{_BLOCK}, control binary, data binary").write.parquet(f"{path}/blocks", compression="zstd")


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """One row per document of a store: doc_id, start (tokens of all documents before it), n_tokens
    (with the end id), ids (little-endian unsigned 32-bit integers).

    Blocks are decoded each for itself. The tokens of the shards before a shard come from one row a
    shard, as many as the writer had partitions.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    id_of = np.array([r.id for r in spark.read.parquet(f"{path}/ranks").orderBy("rank").collect()], np.uint32)
    before, offsets = 0, {}
    for r in blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).orderBy("shard").collect():
        offsets[r.shard], before = before, before + r.n

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in batch.to_pylist():
                ids = id_of[decode_ranks(b["control"], b["data"], b["n_tokens"])].astype("<u4")
                counts = np.array(b["counts"], np.int64)
                ends = np.cumsum(counts)
                each = [ids[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]
                columns = [pa.array(b["doc_ids"], pa.int64()), pa.array(offsets[b["shard"]] + b["start"] + ends - counts), pa.array(counts), pa.array(each, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids"])

    return blocks.mapInArrow(documents, "doc_id long, start long, n_tokens long, ids binary")

