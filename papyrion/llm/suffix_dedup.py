"""Removal of repeated 200-byte strings by bucket-pointer refinement of the suffixes of a corpus.

Every position is in the bucket of the bytes that follow it. A bucket to depth 2h is named by two
names to depth h: that of its position, and that of the position h bytes later. Depths 8, 16, 32, 64
and 128 follow from one another in this way within a text, and any depth from 128 to 256 from two
overlapping names. A bucket with a single member needs no refinement: no longer string from there
repeats. Which buckets have one member is settled over the whole corpus, by sorting the names that
the tasks send, each name twice at most from a block of texts, so that a passage that a third of all
texts hold is as little work as any other. Three rounds refine what is left of the round before:

1. q-grams of Q bytes. Not all positions: a string of N bytes is represented by the least Q-gram in
   it (by hash, of equals the leftmost), its anchor, and neighbouring strings mostly share theirs.
   About one position in 85 is an anchor. Strings whose anchor's bucket has one member are done.
2. The strings with one anchor are taken by their distance d before it, in spans of SPAN distances.
   Where the string that all of a span have in common has one member, none of them repeats. Where
   the string that they cover together repeats, all of them do.
3. Of the spans between, mostly at the ends of repeated passages, each string by itself.

Names in the second and third round that decide on removal have 128 bits, those that only leave
positions out have 64. So the result is that of comparing the strings themselves.

A text that is null counts as empty. Texts of fewer than N bytes keep everything; equal texts of N
or more bytes lose everything; overlapping repeats within one text count. Rows that repeat an id are
texts of their own. Columns of any name may stand beside id and text; they are not returned.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import dropped, stored_at

#: Bytes of a string that may not repeat, and of a q-gram; strings that share an anchor in spans.
N, Q, SPAN = 200, 32, 32
#: Text of a block, and positions that are named at once, in bytes.
BLOCK, CHUNK = 8 << 20, 1 << 20
#: Names that a group of the shuffle is to hold on average.
PER_PART = 4_000_000
#: Kinds of replies: the string occurs more than once; each of the span's strings is to be looked at.
SHARED, OPEN = 1, 2

DOCS = "block long, ids array<long>, lens array<int>, shas array<string>"
STATE = f"{DOCS}, size long, opened array<int>, text binary, s binary, e binary, a binary, hits binary"
KEYS = "part int, block long, keys binary"
RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"

U = np.uint64
SEEDS = ((U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F)), (U(0xD6E8FEB86659FD93), U(0xA0761D6478BD642F)))


def _pair(left: np.ndarray, right: np.ndarray, seed: int) -> np.ndarray:
    """The name of two names, one after the other."""
    one, two = SEEDS[seed]
    x = left * one
    x ^= x >> U(29)
    x += right
    x *= two
    x ^= x >> U(32)
    return x


def bucket_names(data: np.ndarray, depth: int, seed: int = 0) -> np.ndarray:
    """The names to a depth of 8, 16, 32, 64 or 128 bytes of every position that has so many."""
    if len(data) < depth:
        return np.empty(0, U)
    grams = np.lib.stride_tricks.sliding_window_view(data, 8)
    found, at = np.ascontiguousarray(grams).view("<u8")[:, 0], 8
    while at < depth:
        found, at = _pair(found[:-at], found[at:], seed), 2 * at
    return found


def _deep(names: np.ndarray, start: np.ndarray, length: np.ndarray, seed: int) -> np.ndarray:
    """Names of strings of 128 to 256 bytes, by the names to depth 128 of their ends and their length."""
    return _pair(_pair(names[start], names[start + length - 128], seed), length.astype(U), seed)


def least_in_windows(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of every window of ``width``: the lesser of two running minima, one from the
    left and one from the right edge of the stretch of ``width`` values that the window straddles."""
    n = len(values)
    rows = np.full(-(-n // width) * width, np.iinfo(U).max, U)
    rows[:n] = values
    rows = rows.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchored(data: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs [s, e) of valid string starts that share the anchor a, and the names of the anchors' buckets."""
    if len(data) < N:
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U),)
    names = bucket_names(data, Q)
    low = U((1 << 24) - 1)
    anchor = (least_in_windows((names & ~low) | np.arange(len(names), dtype=U), N - Q + 1) & low).astype(np.int64)
    at = np.flatnonzero(valid[: len(anchor)])
    if not len(at):
        return (np.empty(0, np.int64),) * 3 + (np.empty(0, U),)
    new = np.r_[True, (np.diff(anchor[at]) != 0) | (np.diff(at) != 1)]
    s, last = at[new], at[np.r_[new[1:], True]]
    return s, last + 1, anchor[s], names[anchor[s]]


def _chunks(lens: np.ndarray) -> Iterator[tuple[int, int, np.ndarray]]:
    """(from, to, valid) of stretches of concatenated texts: valid marks the string starts whose
    string lies within one text. Stretches overlap by N - 1 bytes, and share no valid start."""
    ends, total, at = np.cumsum(lens), int(np.sum(lens)), 0
    while at + N <= total:
        to = min(at + CHUNK + N - 1, total)
        start = np.arange(at, to - N + 1)
        text = np.searchsorted(ends, start, side="right")
        yield at, to, start + N <= ends[text]
        at += CHUNK


def _sent(names: np.ndarray, block: int, parts: int) -> list[tuple]:
    """Rows of KEYS: the names of a block, each at most twice, dealt to the parts by their first column."""
    if not len(names):
        return []
    names = names[np.lexsort(names.T[::-1])]
    third = np.zeros(len(names), bool)
    third[2:] = (names[2:] == names[:-2]).all(axis=1)
    names = names[~third]
    part = (names[:, 0] >> U(20)) % U(parts)
    order = np.argsort(part, kind="stable")
    names, part = names[order], part[order]
    cut = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(part)]
    return [(int(part[i]), block, names[i:j].tobytes()) for i, j in zip(cut[:-1], cut[1:], strict=True)]


def _groups(names: np.ndarray) -> np.ndarray:
    """The number of its group of equal rows, for each row."""
    order = np.lexsort(names.T[::-1])
    new = np.r_[0, (names[order][1:] != names[order][:-1]).any(axis=1)]
    found = np.empty(len(names), np.int64)
    found[order] = np.cumsum(new)
    return found


def _settled(width: int):
    """What a part replies to its blocks about their names. Of one or two columns: SHARED, those that
    occur more than once. Of three (the common string of a span, and the covered one): SHARED where
    the covered string does, else OPEN where the common string does; and OPEN too where another span
    with this common string is open, since that one's strings may be found in this one."""

    def reply(table: pa.Table) -> pa.Table:
        blobs = table.column("keys").to_pylist()
        names = np.frombuffer(b"".join(blobs), "<u8").reshape(-1, width)
        group = _groups(names)
        shared = np.bincount(group)[group] > 1
        told = {SHARED: shared}
        if width == 3:
            common = _groups(names[:, :1])
            several, waiting = np.bincount(common) > 1, np.bincount(common, ~shared) > 0
            told[OPEN] = (several & waiting)[common]
        ends, out = np.cumsum([len(b) // (8 * width) for b in blobs]), []
        for block, i, j in zip(table.column("block").to_pylist(), np.r_[0, ends[:-1]], ends, strict=True):
            out += [(kind, block, names[i:j][said[i:j]].tobytes()) for kind, said in told.items() if said[i:j].any()]
        return pa.Table.from_batches([_rows(["kind", "block", "keys"], [pa.int32(), pa.int64(), pa.binary()], out)])

    return reply


def _held(names: np.ndarray, replies: list[dict] | None, kind: int) -> np.ndarray:
    """Which of the names are among the replies of a kind."""
    known = np.frombuffer(b"".join(r["keys"] for r in replies or [] if r["kind"] == kind), "<u8").reshape(-1, names.shape[1])
    group = _groups(np.vstack([known, names])) if len(known) and len(names) else np.zeros(len(known) + len(names), np.int64)
    mark = np.zeros(group.max(initial=0) + 1, bool)
    mark[group[: len(known)]] = True
    return mark[group[len(known) :]]


def _spans(s: np.ndarray, e: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs cut where the distance to their anchor passes a multiple of SPAN: (s, e, a, k), where
    the distances lie from k * SPAN to (k + 1) * SPAN - 1."""
    first, last = (a - e + 1) // SPAN, (a - s) // SPAN
    n = last - first + 1
    which = np.repeat(np.arange(len(s)), n)
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[which]
    anchor = a[which]
    return np.maximum(s[which], anchor - (k + 1) * SPAN + 1), np.minimum(e[which], anchor - k * SPAN + 1), anchor, k


def _span_names(data: np.ndarray, s, e, a, k) -> np.ndarray:
    """Of each span: the name of the string that all strings at such distances have in common, and the
    name of the string that those of the span cover together, with where it lies before the anchor."""
    one, two = bucket_names(data, 128), bucket_names(data, 128, 1)
    place, cover = ((a - s) * 8 + k).astype(U), e - s + N - 1
    common = _pair(_deep(one, a - k * SPAN, np.full(len(s), N - SPAN + 1), 0), k.astype(U), 0)
    return np.stack([common, _pair(_deep(one, s, cover, 0), place, 0), _pair(_deep(two, s, cover, 1), place, 1)], axis=1)


def _spans_of(r: dict) -> tuple[np.ndarray, ...]:
    """The spans of a block by start, and their names: (s, e, a, names)."""
    spans = _spans(*map(_ints, (r["s"], r["e"], r["a"])))
    order = np.argsort(spans[0], kind="stable")
    s, e, a, k = (x[order] for x in spans)
    data = _unzip(r["text"], r["size"])
    names = [_span_names(part, s[own] - low, e[own] - low, a[own] - low, k[own]) for own, low, part in _pieces(data, s, e)]
    return s, e, a, np.concatenate(names) if names else np.empty((0, 3), U)


def _string_names(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    length = np.full(len(starts), N)
    return np.stack([_deep(bucket_names(data, 128, i), starts, length, i) for i in range(2)], axis=1)


def _zip(data: bytes) -> bytes:
    return pa.compress(data, "zstd", asbytes=True)


def _unzip(data: bytes, size: int) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, size, "zstd", asbytes=True) if size else b"", np.uint8)


def _ints(blob: bytes) -> np.ndarray:
    return np.frombuffer(blob, "<i4").astype(np.int64)


def _blob(values: np.ndarray) -> bytes:
    return values.astype("<i4").tobytes()


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names)


_STATE_TYPES = (
    ["block", "ids", "lens", "shas", "size", "opened", "text", "s", "e", "a", "hits"],
    [pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int32()), *[pa.binary()] * 5],
)


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts in blocks of about BLOCK bytes; a block's number is the task's and a count."""
    task, n, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def row():
        whole = b"".join(texts)
        shas = [hashlib.sha256(t).hexdigest() for t in texts]
        return _rows(*_STATE_TYPES, [((task << 32) + n, ids, [len(t) for t in texts], shas, len(whole), [], _zip(whole), b"", b"", b"", b"")])

    for batch in batches:
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            data = text.as_buffer().to_pybytes() if text.is_valid else b""
            ids.append(i)
            texts.append(data)
            size += len(data)
            if size >= BLOCK or len(ids) >= 1 << 16:
                yield row()
                n, ids, texts, size = n + 1, [], [], 0
    if ids:
        yield row()


def _anchors_of(r: dict) -> tuple[np.ndarray, ...]:
    """The runs of string starts of a block that share an anchor, and the anchors' names: (s, e, a, names)."""
    data, found = _unzip(r["text"], r["size"]), []
    for i, j, valid in _chunks(np.array(r["lens"], np.int64)):
        s, e, a, names = anchored(data[i:j], valid)
        found.append((s + i, e + i, a + i, names[:, None]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (*[np.empty(0, np.int64)] * 3, np.empty((0, 1), U))


def _emit(named, parts: int):
    """Sends the names that ``named`` gives as the last of what it finds in a block."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _rows(["part", "block", "keys"], [pa.int32(), pa.int64(), pa.binary()], _sent(named(r)[-1], r["block"], parts))

    return emit


def _after_anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the texts that hold a shared anchor, joined, and the runs of those anchors."""
    for batch in batches:
        for r in batch.to_pylist():
            s, e, a, names = _anchors_of(r)
            held = _held(names, r["replies"], SHARED)
            s, e, a = s[held], e[held], a[held]
            data, lens = _unzip(r["text"], r["size"]), np.array(r["lens"], np.int64)
            starts = np.cumsum(lens) - lens
            text = np.searchsorted(starts + lens, s, side="right")
            opened = np.unique(text)
            whole = b"".join(data[starts[t] : starts[t] + lens[t]].tobytes() for t in opened)
            shift = (starts[opened] - (np.cumsum(lens[opened]) - lens[opened]))[np.searchsorted(opened, text)]
            yield _rows(*_STATE_TYPES, [(r["block"], r["ids"], r["lens"], r["shas"], len(whole), opened.tolist(), _zip(whole), _blob(s - shift), _blob(e - shift), _blob(a - shift), b"")])


def _pieces(data: np.ndarray, s: np.ndarray, e: np.ndarray) -> Iterator[tuple[slice, int, np.ndarray]]:
    """Ascending runs in groups that lie within a chunk: (which, from, bytes). The bytes reach as far
    as any name of theirs, which is N behind an end or SPAN behind an anchor."""
    i = 0
    while i < len(s):
        j = int(np.searchsorted(s, s[i] + CHUNK))
        low = max(0, int(s[i]) - SPAN)
        yield slice(i, j), low, data[low : int(e[i:j].max()) + N + SPAN]
        i = j


def _after_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks with the spans that repeat whole as hits, and those to look at string by string as runs."""
    for batch in batches:
        for r in batch.to_pylist():
            s, e, a, names = _spans_of(r)
            whole, look = _held(names, r["replies"], SHARED), _held(names, r["replies"], OPEN)
            hits = _blob(np.stack([s[whole], e[whole]], axis=1))
            yield _rows(*_STATE_TYPES, [(r["block"], r["ids"], r["lens"], r["shas"], r["size"], r["opened"], r["text"], _blob(s[look]), _blob(e[look]), _blob(a[look]), hits)])


def _strings_of(r: dict) -> tuple[np.ndarray, np.ndarray]:
    """Every string start of the runs, and their names."""
    data, s, e = _unzip(r["text"], r["size"]), _ints(r["s"]), _ints(r["e"])
    starts = np.repeat(s - np.cumsum(e - s) + (e - s), e - s) + np.arange((e - s).sum())
    names = []
    for own, low, part in _pieces(data, s, e):
        lie = starts[np.searchsorted(starts, s[own][0]) : np.searchsorted(starts, e[own][-1])]
        names.append(_string_names(part, lie - low))
    return starts, np.concatenate(names) if names else np.empty((0, 2), U)


def covered(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs of bytes that strings of N bytes cover, from ranges [s, e) of their starts."""
    order = np.argsort(starts, kind="stable")
    s, e = starts[order], ends[order] + N - 1
    reach = np.maximum.accumulate(e) if len(e) else e
    new = np.r_[True, s[1:] > reach[:-1]] if len(s) else np.zeros(0, bool)
    return s[new], reach[np.r_[new[1:], True]] if len(s) else reach


def _results(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    types = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"], [*[pa.int64()] * 4, pa.string()]
    for batch in batches:
        for r in batch.to_pylist():
            starts, names = _strings_of(r)
            starts = starts[_held(names, r["replies"], SHARED)]
            hits = np.vstack([_ints(r["hits"]).reshape(-1, 2), np.stack([starts, starts + 1], axis=1)])
            data, rows = _unzip(r["text"], r["size"]), [[i, n, 0, 0, sha] for i, n, sha in zip(r["ids"], r["lens"], r["shas"], strict=True)]
            opened = np.array(r["opened"] or [], np.int64)
            ends = np.cumsum(np.array(r["lens"], np.int64)[opened])
            text = np.searchsorted(ends, hits[:, 0], side="right")
            order = np.argsort(text, kind="stable")
            hits, text = hits[order], text[order]
            for t in np.unique(text):
                own = hits[np.searchsorted(text, t) : np.searchsorted(text, t, side="right")]
                start = ends[t] - r["lens"][opened[t]]
                lo, hi = covered(own[:, 0] - start, own[:, 1] - start)
                kept, at, whole = hashlib.sha256(), 0, data[start : ends[t]]
                for i, j in zip(lo, hi, strict=True):
                    kept.update(whole[at:i].tobytes())
                    at = j
                kept.update(whole[at:].tobytes())
                rows[opened[t]][2:] = [int((hi - lo).sum()), len(lo), kept.hexdigest()]
            yield _rows(*types, rows)


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """RESULT rows, one for each row of df: bytes, those removed, their maximal runs, and the SHA-256
    of what remains."""
    spark = df.sparkSession
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    blocks, path = stored_at(docs.mapInArrow(_blocks, STATE), "suffix-blocks")
    total = blocks.agg(F.sum("size")).first()[0] or 0
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-2 * total // (N - Q) // PER_PART))

    def asked(state: DataFrame, named, width: int) -> DataFrame:
        """The state with what its blocks' names get as replies."""
        sent = state.drop("ids", "shas", "opened", "hits").mapInArrow(_emit(named, parts), KEYS)
        replies = sent.groupBy("part").applyInArrow(_settled(width), "kind int, block long, keys binary")
        return state.join(replies.groupBy("block").agg(F.collect_list(F.struct("kind", "keys")).alias("replies")), "block", "left")

    for named, width, after in ((_anchors_of, 1, _after_anchors), (_spans_of, 3, _after_spans)):
        blocks, new = stored_at(asked(blocks, named, width).mapInArrow(after, STATE), "suffix-blocks")
        dropped(spark, path)
        path = new
    return asked(blocks, _strings_of, 2).mapInArrow(_results, RESULT)
