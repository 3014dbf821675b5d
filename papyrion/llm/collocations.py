"""Phrase collocations by language: minimal perfect hashes over Apriori-safe candidates, counted in arrays.

A phrase of n words can only be frequent if those without its last and without its first word are.
Level by level, from words on, each position of the corpus holds the slot of the phrase that starts
there, and a pair of neighbouring slots is the exact 64-bit key of a phrase one word longer:

1. Mappers bincount the keys into buckets, up to LEAST a task (enough to tell what reaches LEAST), and
   the arrays are summed as a tree. A frequent key lies in a bucket of LEAST or more.
2. The different keys of such buckets are the candidates. Shards of them become minimal perfect
   hashes, with every key stored in its slot, so that a key that is no candidate is told apart.
3. The corpus is rewritten from slots to the slots of candidates, mappers bincount those, and the
   arrays are summed as a tree: exact counts by slot.

What mappers hold is bounded: MOST_BUCKETS buckets and MOST_SLOTS slots at a time. Keys are split by
their hash into as many passes as that takes, and shards into as many, so every candidate is
counted at any size; passes read the slots of the corpus (4 bytes a word, compressed), never the
texts. Word counts come first, by an ordinary aggregation; words below LEAST have no slot.

A phrase carries the counts of its beginnings and its ends along, read by slot from the level before,
so that every cut's two sides are at hand.

Null texts count as empty, a null language as ``und``. A language of no phrase gives no row. Rows that
repeat an id, or texts, count each. Columns beside those two do not matter.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.llm.perfect_hash import PerfectHash, mixed
from papyrion.llm.shared import dropped, stored, stored_at

#: Occurrences of a candidate, words of the longest, phrases of a language, per cent of a containing phrase.
LEAST, LONGEST, TOP, CONTAINED = 30, 4, 2000, 80
#: Keys a bucket on average, and the most buckets and slots that mappers hold at a time.
LOAD, MOST_BUCKETS, MOST_SLOTS = 6, 1 << 23, 1 << 22
#: Keys of a shard, buckets or slots of an array that is summed, and arrays that one task sums.
SHARD, PIECE, FAN_IN = 1 << 18, 1 << 20, 32
#: Bytes of text whose words are found at once, and slots of a row of the corpus.
BLOCK, ROW = 1 << 20, 1 << 20

U = np.uint64
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: 0 within words, 1 between them, 2 between pieces.
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 2
_RANDOM = np.random.default_rng(12).integers(0, 2**64, (2, 256), U)
_BASE = (U(0x5851F42D4C957F2D), U(0x14057B7EF767814F))
_POWERS = [np.cumprod(np.r_[U(1), np.full(BLOCK + 1, b)], dtype=U) for b in _BASE]
_BACK = [np.cumprod(np.r_[U(1), np.full(BLOCK + 1, U(pow(int(b), -1, 2**64)))], dtype=U) for b in _BASE]


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, piece) of every word of lower-cased bytes."""
    kind = _CLASS[data]
    inside = np.r_[False, kind == 0, False]
    start, end = np.flatnonzero(inside[1:] & ~inside[:-1]), np.flatnonzero(inside[:-1] & ~inside[1:])
    return start, end, np.cumsum(kind == 2)[start] if len(start) else start


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, salt: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of every word [start, end) of at most BLOCK bytes of data, by a salt each:
    sums of random numbers of the bytes times powers, from prefix sums, mixed with the length."""
    found = []
    for i in range(2):
        prefix = np.r_[U(0), np.cumsum(_RANDOM[i][data] * _POWERS[i][: len(data)], dtype=U)]
        own = (prefix[end] - prefix[start]) * _BACK[i][start]
        found.append(mixed(mixed(own + (end - start).astype(U), i) + salt, i + 2))
    return np.stack(found, axis=1)


def _long_hash(word: bytes, salt: int) -> list[int]:
    """Two hashes of a word that is longer than a block."""
    digest = hashlib.blake2b(word, digest_size=16, salt=salt.to_bytes(8, "little")).digest()
    return [int.from_bytes(digest[:8], "little"), int.from_bytes(digest[8:], "little")]


def _salt(lang: str) -> int:
    return int.from_bytes(hashlib.blake2b(lang.encode(), digest_size=8).digest(), "little")


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, list[str]]]:
    """(bytes, number of the language of each, languages): texts joined by line feeds, in stretches of
    at most BLOCK bytes, where one text is no longer than that."""
    langs = ["und" if x is None else x for x in batch.column(0).to_pylist()]
    names = sorted(set(langs))
    number, held, size = {x: i for i, x in enumerate(names)}, [], 0

    def joined():
        data = np.frombuffer(b"".join(b + b"\n" for b, _ in held), np.uint8)
        return _LOWER[data], np.repeat([k for _, k in held], [len(b) + 1 for b, _ in held]), names

    for lang, text in zip(langs, batch.column(1), strict=True):
        data = text.as_buffer().to_pybytes() if text.is_valid else b""
        if held and size + len(data) + 1 > BLOCK:
            yield joined()
            held, size = [], 0
        held.append((data, number[lang]))
        size += len(data) + 1
    if held:
        yield joined()


def _words(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[str]]]:
    """(bytes, start, end, piece, hashes, language, languages) of the words of each stretch of texts."""
    for data, lang, names in _texts(batch):
        salts = np.array([_salt(x) for x in names], U)
        start, end, piece = word_spans(data)
        hashes = np.empty((len(start), 2), U)
        # A text longer than a block is hashed in windows that end between words.
        i = 0
        while i < len(start):
            j = int(np.searchsorted(end, start[i] + BLOCK, side="right"))
            if j > i:
                low = start[i]
                hashes[i:j] = word_hashes(data[low : end[j - 1]], start[i:j] - low, end[i:j] - low, salts[lang[start[i:j]]])
            else:
                j = i + 1
                hashes[i] = _long_hash(data[start[i] : end[i]].tobytes(), int(salts[lang[start[i]]]))
            i = j
        yield data, start, end, piece, hashes, lang[start] if len(start) else start, names


def _batch(names: list[str], types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)


def word_counts(df: DataFrame) -> DataFrame:
    """(lang, word, n) of every word of df's (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, start, end, _, hashes, lang, names in _words(batch):
                _, first, n = np.unique(hashes[:, 0], return_index=True, return_counts=True)
                words = [data[i:j].tobytes().decode() for i, j in zip(start[first], end[first], strict=True)]
                yield _batch(["lang", "word", "n"], [pa.string(), pa.string(), pa.int64()], [[names[k] for k in lang[first]], words, n])

    return df.mapInArrow(count, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))


SHARDS = "shard int, size long, first binary, second binary"


def _shard(number: int, key: np.ndarray, verify: np.ndarray) -> pa.RecordBatch:
    """A row of SHARDS: different keys, and what verifies them if that is not the key, by slot."""
    slot = PerfectHash(key).slots(key)
    first, second = np.empty_like(key), np.empty_like(key)
    first[slot], second[slot] = key, verify
    second = b"" if (first == second).all() else second.tobytes()
    return _batch(["shard", "size", "first", "second"], [pa.int32(), pa.int64(), pa.binary(), pa.binary()], [[number], [len(key)], [first.tobytes()], [second]])


def _shards(keys: DataFrame, n_shards: int) -> DataFrame:
    """SHARDS rows of the different (key, verify), longs, of a table."""

    def build(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_shard(table.column("shard")[0].as_py(), *(table.column(c).to_numpy().view(U) for c in ("key", "verify")))])

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(_shard_of(batch.column("key").to_numpy().view(U), n_shards), pa.int32()), batch.column("key"), batch.column("verify")], ["shard", "key", "verify"])

    rows = keys.select("key", "verify").mapInArrow(dealt, "shard int, key long, verify long")
    return rows.groupBy("shard").applyInArrow(build, SHARDS)


class Slots:
    """The slots of a group of shards, by perfect hashes that each task builds once of the stored keys."""

    def __init__(self, rows: list, n_shards: int, offset: int) -> None:
        self.rows, self.n_shards, self.ends = [(r.shard, bytes(r.first), bytes(r.second)) for r in rows], n_shards, []
        for r in rows:
            self.ends.append(offset)
            offset += r.size
        self.offset, self.size, self.tables = offset, sum(r.size for r in rows), None

    def open(self) -> None:
        if self.tables is None:
            self.tables = [PerfectHash(np.frombuffer(first, "<u8"), np.frombuffer(second or first, "<u8")) for _, first, second in self.rows]

    def close(self) -> None:
        self.tables = None

    def slots(self, keys: np.ndarray, verify: np.ndarray) -> np.ndarray:
        """Slots from 1 on; 0 for keys of no shard of this group."""
        self.open()
        found = np.zeros(len(keys), np.int64)
        shard = _shard_of(keys, self.n_shards) if self.n_shards > 1 else np.zeros(len(keys), np.int64)
        for (number, _, _), table, offset in zip(self.rows, self.tables, self.ends, strict=True):
            own = np.flatnonzero(shard == number) if self.n_shards > 1 else slice(None)
            slot = table.slots(keys[own], verify[own])
            found[own] = np.where(slot >= 0, slot + offset + 1, 0)
        return found


def _groups(shards: DataFrame, n_shards: int) -> Iterator[Slots]:
    """The slots of all shards, in groups of at most MOST_SLOTS (or one shard) that mappers can hold."""
    sizes = sorted((r.shard, r.size) for r in shards.select("shard", "size").collect())
    offset, own, held = 0, [], 0
    for i, (shard, size) in enumerate(sizes):
        own.append(shard)
        held += size
        if i + 1 == len(sizes) or held + sizes[i + 1][1] > MOST_SLOTS:
            group = Slots(shards.where(F.col("shard").isin(own)).orderBy("shard").collect(), n_shards, offset)
            offset, own, held = group.offset, [], 0
            yield group


def tree_union(keys: DataFrame, n_branches: int) -> DataFrame:
    """Shards of the different keys in (branch, shard, data), FAN_IN branches united at a time."""

    def united(table: pa.Table) -> np.ndarray:
        return np.unique(np.frombuffer(b"".join(table.column("data").to_pylist()), "<u8"))

    def inner(table: pa.Table) -> pa.Table:
        branch, shard = (table.column(c)[0].as_py() for c in ("branch", "shard"))
        return pa.Table.from_batches([_batch(["branch", "shard", "data"], [pa.int32(), pa.int32(), pa.binary()], [[branch], [shard], [united(table).tobytes()]])])

    def last(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([_shard(table.column("shard")[0].as_py(), found := united(table), found)])

    while n_branches > FAN_IN:
        keys = keys.withColumn("branch", F.expr(f"CAST(branch DIV {FAN_IN} AS INT)")).groupBy("branch", "shard").applyInArrow(inner, "branch int, shard int, data binary")
        n_branches = -(-n_branches // FAN_IN)
    return keys.groupBy("shard").applyInArrow(last, SHARDS)


def tree_sum(arrays: DataFrame, n_branches: int, finish: Callable[[int, np.ndarray], pa.RecordBatch], schema: str) -> DataFrame:
    """What ``finish`` makes of each piece's sum. arrays: (branch, piece, data), counts as compressed
    bytes; FAN_IN branches are added up at a time, so no task holds more than one sum and one array."""

    def added(table: pa.Table) -> np.ndarray:
        total = np.zeros(0, np.int64)
        for data in table.column("data"):
            one = _expand(data.as_buffer())
            if len(one) > len(total):
                total, one = one.copy(), total
            total[: len(one)] += one
        return total

    def inner(table: pa.Table) -> pa.Table:
        branch, piece = (table.column(c)[0].as_py() for c in ("branch", "piece"))
        return pa.Table.from_batches([_batch(["branch", "piece", "data"], [pa.int32(), pa.int32(), pa.binary()], [[branch], [piece], [_compact(added(table))]])])

    while n_branches > FAN_IN:
        arrays = arrays.withColumn("branch", F.expr(f"CAST(branch DIV {FAN_IN} AS INT)")).groupBy("branch", "piece").applyInArrow(inner, "branch int, piece int, data binary")
        n_branches = -(-n_branches // FAN_IN)
    last = lambda table: pa.Table.from_batches([finish(table.column("piece")[0].as_py(), added(table))])
    return arrays.groupBy("piece").applyInArrow(last, schema)


def _compact(counts: np.ndarray) -> bytes:
    """Counts as compressed 64-bit integers, their length before them."""
    return len(counts).to_bytes(8, "little") + pa.compress(counts.astype("<i8").tobytes(), "zstd", asbytes=True)


def _expand(data: pa.Buffer) -> np.ndarray:
    n = int.from_bytes(data[:8].to_pybytes(), "little")
    return np.frombuffer(pa.decompress(data[8:], 8 * n, "zstd"), "<i8") if n else np.zeros(0, np.int64)


def _sent(counts: np.ndarray, most: int | None = None) -> Iterator[pa.RecordBatch]:
    """A task's counts in pieces, those without any left out."""
    branch = TaskContext.get().partitionId()
    for piece in range(-(-len(counts) // PIECE)):
        own = counts[piece * PIECE : (piece + 1) * PIECE]
        if own.any():
            yield _batch(["branch", "piece", "data"], [pa.int32(), pa.int32(), pa.binary()], [[branch], [piece], [_compact(own if most is None else np.minimum(own, most))]])


def _ids(row: pa.StructScalar | dict, name: str = "ids") -> np.ndarray:
    return np.frombuffer(pa.decompress(row[name], 4 * row["size"], "zstd"), "<i4") if row["size"] else np.zeros(0, np.int32)


def _keys(ids: np.ndarray, frequent: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
    """(places, keys) of neighbouring slots, both of frequent phrases."""
    good = ids > 0
    if frequent is not None:
        good &= ((frequent[ids >> 3] >> (ids & 7).astype(np.uint8)) & 1).astype(bool)
    at = np.flatnonzero(good[:-1] & good[1:])
    return at, (ids[at].astype(U) << U(32)) | ids[at + 1].astype(U)


CORPUS = "size int, ids binary"
_CORPUS = (["size", "ids"], [pa.int32(), pa.binary()])


def _row(ids: np.ndarray) -> list:
    return [[len(ids)], [pa.compress(ids.astype("<i4").tobytes(), "zstd", asbytes=True)]]


def spelled(df: DataFrame, groups: list) -> DataFrame:
    """The corpus as CORPUS rows: a slot for every word, 0 for a word without one and between pieces.
    groups: broadcasts of Slots; of several, a task opens one at a time for some millions of words."""

    def written(found: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        slots = np.zeros(sum(len(piece) for piece, _ in found), np.int32)
        for group in groups:
            at = 0
            for _, hashes in found:
                slots[at : at + len(hashes)] += group.value.slots(hashes[:, 0], hashes[:, 1]).astype(np.int32)
                at += len(hashes)
            if len(groups) > 1:
                group.value.close()
        # Pieces are counted through, and a place without a slot is left between any two.
        place = np.arange(len(slots)) + np.cumsum(np.concatenate([np.diff(piece, prepend=-1) > 0 for piece, _ in found]))
        ids = np.zeros(place[-1] + 2, np.int32)
        ids[place] = slots
        # Rows end where no phrase goes on.
        gaps, i = np.flatnonzero(ids == 0), 0
        while i < len(ids):
            j = int(gaps[np.searchsorted(gaps, min(i + ROW, len(ids) - 1))]) + 1
            yield _batch(*_CORPUS, _row(ids[i:j]))
            i = j

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = [], 0
        for batch in batches:
            for _, _, _, piece, hashes, _, _ in _words(batch):
                if len(piece):
                    found.append((piece, hashes))
                    n += len(piece)
                if n >= (ROW if len(groups) == 1 else 4 * ROW):
                    yield from written(found)
                    found, n = [], 0
        if n:
            yield from written(found)

    return df.mapInArrow(spell, CORPUS)


def _merged(one: DataFrame, other: DataFrame | None) -> DataFrame:
    return one if other is None else one.unionByName(other)


class Level:
    """The phrases of one length: the corpus in their slots, and which of those are frequent."""

    def __init__(self, corpus: DataFrame, path: str, frequent: np.ndarray | None, table: DataFrame) -> None:
        self.corpus, self.path, self.frequent, self.table = corpus, path, frequent, table


def candidates(level: Level, least: int) -> tuple[DataFrame, int]:
    """SHARDS of the keys one word longer that may occur ``least`` times, and how many shards there are."""
    spark, corpus = level.corpus.sparkSession, level.corpus
    frequent, n_tasks = spark.sparkContext.broadcast(level.frequent), corpus.rdd.getNumPartitions()

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield _batch(["n"], [pa.int64()], [[sum(len(_keys(_ids(r), frequent.value)[0]) for batch in batches for r in batch.to_pylist())]])

    n = corpus.mapInArrow(sizes, "n long").agg(F.sum("n")).first()[0] or 0
    total, passes, heavy_buckets = max(1, n // LOAD), [], 0
    for first in range(0, total, MOST_BUCKETS):
        buckets = min(MOST_BUCKETS, total - first)

        def own(keys: np.ndarray, first=first, buckets=buckets) -> tuple[np.ndarray, np.ndarray]:
            """The keys whose buckets are this pass's, and those."""
            place = (((mixed(keys, 5) >> U(32)) * U(total)) >> U(32)).astype(np.int64) - first
            keep = (place >= 0) & (place < buckets)
            return keys[keep], place[keep]

        def count(batches: Iterator[pa.RecordBatch], own=own, buckets=buckets) -> Iterator[pa.RecordBatch]:
            counts = np.zeros(buckets, np.int32)
            for batch in batches:
                for r in batch.to_pylist():
                    counts += np.bincount(own(_keys(_ids(r), frequent.value)[1])[1], minlength=buckets).astype(np.int32)
            yield from _sent(counts, least)

        def heavy(piece: int, counts: np.ndarray) -> pa.RecordBatch:
            return _batch(["piece", "bits"], [pa.int32(), pa.binary()], [[piece], [np.packbits(counts >= least, bitorder="little").tobytes()]])

        rows = tree_sum(corpus.mapInArrow(count, "branch int, piece int, data binary"), n_tasks, heavy, "piece int, bits binary").collect()
        marks = np.zeros(-(-buckets // 8), np.uint8)
        for r in rows:
            marks[r.piece * PIECE // 8 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
        heavy_buckets += int(np.bitwise_count(marks).sum())
        passes.append((own, spark.sparkContext.broadcast(marks)))
    # A heavy bucket holds LOAD different keys or so at most.
    n_shards, found = max(1, -(-heavy_buckets * LOAD // SHARD)), None

    def dealt(keys: np.ndarray) -> pa.RecordBatch:
        shard = _shard_of(keys, n_shards)
        order = np.argsort(shard, kind="stable")
        keys, shard = keys[order], shard[order]
        numbers, start = np.unique(shard, return_index=True)
        ends, branch = [*start[1:].tolist(), len(keys)], TaskContext.get().partitionId()
        blobs = [keys[i:j].tobytes() for i, j in zip(start.tolist(), ends, strict=True)] if len(keys) else []
        return _batch(["branch", "shard", "data"], [pa.int32(), pa.int32(), pa.binary()], [[branch] * len(blobs), numbers, blobs])

    for own, marked in passes:

        def different(batches: Iterator[pa.RecordBatch], own=own, marked=marked) -> Iterator[pa.RecordBatch]:
            known = np.empty(0, U)
            for batch in batches:
                for r in batch.to_pylist():
                    keys, bucket = own(_keys(_ids(r), frequent.value)[1])
                    keys = keys[((marked.value[bucket >> 3] >> (bucket & 7).astype(np.uint8)) & 1).astype(bool)]
                    known = np.union1d(known, keys)
                    if len(known) > MOST_SLOTS // 4:
                        yield dealt(known)
                        known = np.empty(0, U)
            yield dealt(known)

        found = _merged(corpus.mapInArrow(different, "branch int, shard int, data binary"), found)

    return tree_union(found, n_tasks), n_shards


def deepened(level: Level, least: int) -> Level:
    """The phrases one word longer: (slot, left, right, f), where left and right are the slots of those
    without the last and without the first word."""
    spark = level.corpus.sparkSession
    found, n_shards = candidates(level, least)
    shards, frequent = stored(found, "phrase-shards"), spark.sparkContext.broadcast(level.frequent)
    next_, path, tables, end = None, None, [], 0
    source = level.corpus.select("size", "ids", F.lit(None).cast("binary").alias("next"))
    for group in _groups(shards, n_shards):
        held = spark.sparkContext.broadcast(group)

        def fill(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for r in batch.to_pylist():
                    ids = _ids(r)
                    at, key = _keys(ids, frequent.value)
                    slots = np.zeros(len(ids), np.int32) if r["next"] is None else _ids(r, "next").copy()
                    slots[at] += held.value.slots(key, key).astype(np.int32)
                    yield _batch(["size", "ids", "next"], [pa.int32(), pa.binary(), pa.binary()], [[len(ids)], [r["ids"]], _row(slots)[1]])

        before = path
        next_, path = stored_at(source.mapInArrow(fill, f"{CORPUS}, next binary"), "phrase-corpus")
        source = next_
        if before:
            dropped(spark, before)
        tables.append(stored(_counted(next_, group, least), "phrase-counts"))
        end = group.offset
    if next_ is None:
        next_, path = stored_at(source.where("size < 0"), "phrase-corpus")
    table = stored(_union(spark, tables), "phrase-counts")
    bits = _marked(table, end)
    if level.path:
        dropped(spark, level.path)
    return Level(next_.select("size", F.col("next").alias("ids")), path, bits, table)


def _marked(table: DataFrame, end: int) -> np.ndarray:
    """A bit for each slot up to end, set for those of the table."""

    def mark(part: pa.Table) -> pa.Table:
        piece, bits = part.column("piece")[0].as_py(), np.zeros(PIECE, bool)
        bits[part.column("slot").to_numpy() % PIECE] = True
        return pa.Table.from_batches([_batch(["piece", "bits"], [pa.int32(), pa.binary()], [[piece], [np.packbits(bits, bitorder="little").tobytes()]])])

    rows = table.select(F.expr(f"CAST(slot DIV {PIECE} AS INT)").alias("piece"), "slot").groupBy("piece").applyInArrow(mark, "piece int, bits binary").collect()
    marks = np.zeros(-(-(end + 1) // PIECE) * PIECE // 8, np.uint8)
    for r in rows:
        marks[r.piece * PIECE // 8 :][: len(r.bits)] = np.frombuffer(r.bits, np.uint8)
    return marks


COUNTED = "slot int, left int, right int, f long"


def _union(spark: SparkSession, tables: list[DataFrame]) -> DataFrame:
    found = spark.createDataFrame([], COUNTED)
    for t in tables:
        found = found.unionByName(t)
    return found


def _counted(corpus: DataFrame, group: Slots, least: int) -> DataFrame:
    """COUNTED rows of the group's phrases that occur ``least`` times."""
    held, first, size = corpus.sparkSession.sparkContext.broadcast(group), group.offset - group.size, group.size

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(size, np.int64)
        for batch in batches:
            for r in batch.to_pylist():
                ids = _ids(r, "next").astype(np.int64) - first
                counts += np.bincount(ids[(ids > 0) & (ids <= size)] - 1, minlength=size)
        yield from _sent(counts)

    def frequent(piece: int, counts: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(counts >= least)
        keys = np.concatenate([np.frombuffer(x, "<u8") for _, x, _ in held.value.rows])[at + piece * PIECE]
        kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
        return _batch(["slot", "left", "right", "f"], kinds, [at + piece * PIECE + first + 1, keys >> U(32), keys & U(2**32 - 1), counts[at]])

    return tree_sum(corpus.mapInArrow(count, "branch int, piece int, data binary"), corpus.rdd.getNumPartitions(), frequent, COUNTED)


def words_level(df: DataFrame, counts: DataFrame, least: int) -> Level:
    """Words that occur ``least`` times, with their slots, and the corpus in these."""
    often = stored(counts.where(F.col("n") >= least), "frequent-words")

    def with_hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = [h for *_, h, _, _ in _words(batch)]
            columns = np.concatenate(hashes).view(np.int64).T if hashes else np.empty((2, 0), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, columns)], [*batch.schema.names, "key", "verify"])

    keyed = stored(often.mapInArrow(with_hashes, "lang string, word string, n long, key long, verify long"), "word-keys")
    n, different = keyed.agg(F.count("*"), F.count_distinct("key")).first()
    if n != different:
        raise ValueError("two frequent words have one hash; change the random numbers")
    n_shards = max(1, -(-n // SHARD))
    shards = stored(_shards(keyed, n_shards), "word-shards")
    groups, slots = [df.sparkSession.sparkContext.broadcast(group) for group in _groups(shards, n_shards)], []
    corpus, path = stored_at(spelled(df, groups), "phrase-corpus")
    for held in groups:

        def find(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                slot = held.value.slots(batch.column("key").to_numpy().view(U), batch.column("verify").to_numpy().view(U))
                own = pa.array(slot > 0)
                yield pa.RecordBatch.from_arrays([pa.array(slot[slot > 0], pa.int32()), *[batch.column(c).filter(own) for c in ("lang", "word", "n")]], ["slot", "lang", "word", "f"])

        slots.append(keyed.mapInArrow(find, "slot int, lang string, word string, f long"))
    table = df.sparkSession.createDataFrame([], "slot int, lang string, word string, f long")
    for t in slots:
        table = table.unionByName(t)
    return Level(corpus, path, None, stored(table, "word-slots"))


def phrases(df: DataFrame, counts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Of each length from 2 on: (slot, left, right, lang, phrase, last, f, starts, ends), where starts and
    ends hold the counts of the phrase's first and last 1, 2, ... words, its own last."""
    level = words_level(df, counts, least)
    one = F.array("f")
    last = level.table.select("slot", "lang", F.col("word").alias("phrase"), F.col("word").alias("last"), one.alias("starts"), one.alias("ends"))
    found = []
    for _ in range(longest - 1):
        level = deepened(level, least)
        left = last.select(F.col("slot").alias("left"), "lang", F.col("phrase").alias("head"), F.col("starts").alias("before"))
        right = last.select(F.col("slot").alias("right"), "last", F.col("ends").alias("after"))
        new = level.table.join(left, "left").join(right, "right").select(
            "slot", "left", "right", "lang", F.concat_ws(" ", "head", "last").alias("phrase"), "last", "f", F.concat("before", one).alias("starts"), F.concat("after", one).alias("ends")
        )
        last = stored(new, "phrases")
        found.append(last)
    return found


def _contained(found: list[DataFrame]) -> DataFrame:
    """(words, slot, most): the highest count of a longer phrase that holds the phrase of that slot."""
    out = None
    for n, longer in enumerate(found[1:], 3):
        inner = longer.select("f", F.explode(F.array("left", "right")).alias("slot"))
        for words in range(n - 1, 1, -1):
            own = inner.groupBy("slot").agg(F.max("f").alias("most"))
            out = _merged(own.select(F.lit(words).alias("words"), "slot", "most"), out)
            if words > 2:
                shorter = found[words - 2].select("slot", F.array("left", "right").alias("parts"))
                inner = own.join(shorter, "slot").select(F.col("most").alias("f"), F.explode("parts").alias("slot"))
    return out.groupBy("words", "slot").agg(F.max("most").alias("most"))


def mine(df: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score) of each language's first ``top`` phrases."""
    texts = df.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text"))
    counts = stored(word_counts(texts), "word-counts")
    sizes = counts.groupBy("lang").agg(F.sum("n").alias("n"))
    found = phrases(texts, counts, least, longest)
    every = None
    for words, t in enumerate(found, 2):
        cuts = F.array(*[F.struct(_score(F.col("f"), l, r).alias("score"), F.lit(k).alias("k"), l.alias("l"), r.alias("r")) for k in range(1, words) for l, r in [(F.col("starts")[k - 1], F.col("ends")[words - k - 1])]])
        every = _merged(t.select(F.lit(words).alias("words"), "slot", "lang", "phrase", F.col("f").alias("a"), F.array_min(cuts).alias("cut")), every)
    if longest > 2:
        every = every.join(_contained(found), ["words", "slot"], "left").where(f"most IS NULL OR CAST(100 AS DECIMAL(38,0)) * most < CAST({CONTAINED} AS DECIMAL(38,0)) * a")
    order = Window.partitionBy("lang").orderBy(F.desc("cut.score"), F.desc("a"), "phrase")
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(sizes, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def _score(a, l, r):
    """floor(2000000 * a / (l + r)) in integers of 38 digits."""
    wide = lambda c: c.cast("decimal(38,0)")
    return F.call_function("div", wide(F.lit(2000000)) * a, wide(l) + r)


def _shard_of(keys: np.ndarray, n: int) -> np.ndarray:
    return ((mixed(keys, 77) >> U(8)) % U(n)).astype(np.int64)
