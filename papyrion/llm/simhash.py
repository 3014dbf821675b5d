"""SimHash near-dedup with bit-sliced comparison.

Equal fingerprints are one from the start. Two different ones at 3 or fewer of 64 bits agree in one
of four 16-bit quarters, and in one of four 12-bit parts of the other 48 bits: 16 keys of 28 bits
that no link escapes. Fingerprints of one key are compared in blocks whose bits are stored as
planes, one machine word for 64 fingerprints: each plane adds to all distances at once by
carry-save counters, and a block is left as soon as every distance exceeds the radius. Linked
fingerprints leave a comparison as a star about the smallest one, never as all their pairs.

``similar`` compares the same way, but finds texts by the similarity of their 5-word shingles. 64 bits
are too few for that, so its fingerprints have 768, of which two texts of similarity J differ in about
acos(2J / (1 + J)) / pi: 116 of 768 at 0.8, give or take 10. A radius of 160 makes candidates; what
links two of them is the similarity of their shingle sets itself. Whose bits are compared is settled
by the smallest shingle hashes of eight kinds: texts of similarity 0.8 share none of them once in 400,000.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from papyrion.llm.components import components
from papyrion.llm.shared import stored

SHINGLE, SEED, RADIUS = 3, 42, 3
#: Fingerprints compared at once.
BLOCK = 1024
#: Fingerprints of one key that meet in one task; those of a larger key meet in all pairs of parts.
PART = 16384
#: Of ``similar``: words of a fingerprint, shingle, radius, smallest hashes, and the rows of a part.
WORDS, WIDE_SHINGLE, WIDE_RADIUS, MINIMA, WIDE_PART = 12, 5, 160, 8, 4096
#: Shingle sets are linked at this percentage; as a part's rows their texts count by this many bytes.
SIMILAR_PERCENT, TEXT_BYTES = 80, 8192
#: Keys that more than a part's rows share are sent to every task if there are at most so many of them.
HOT_KEYS = 1_000_000


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a text; 0 without words.

    A-Z are lowered, words are runs of anything but ASCII white space, shingles are 3 words joined
    by spaces, each occurrence counted; fewer words make one shingle. A bit is set where over half
    the shingles' XXH64 values have it.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - SHINGLE + 1)
    spans = zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(joined[s:e], SEED) for s, e in spans), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for at in range(0, n, 4096):
        bits = np.unpackbits(hashes[at : at + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(df: DataFrame, text_col: str = "text", out_col: str = "simhash") -> DataFrame:
    """Adds the fingerprint as a long (its unsigned bits); null and empty texts have 0."""

    @F.arrow_udf("long")
    def of(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([fingerprint(t.as_py()) for t in texts], np.uint64).view(np.int64))

    return df.withColumn(out_col, of(F.col(text_col).cast("string")))


def _mixed(hashes: np.ndarray, first: int, n: int) -> np.ndarray:
    """n further 64-bit hashes of each hash (splitmix64 of its sum with multiples of the golden ratio)."""
    z = hashes[:, None] + np.arange(first + 1, first + n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return z ^ (z >> np.uint64(31))


def shingle_hashes(text: str | None) -> np.ndarray:
    """The different hashes of a text's 5-word shingles, sorted; none without words. Words as in
    ``fingerprint``."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(words) - WIDE_SHINGLE + 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[-n:].tolist(), strict=True)), np.uint64, n))


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sorted sets of hashes have a Jaccard similarity of 0.8 or more."""
    few, many = (a, b) if len(a) <= len(b) else (b, a)
    if len(few) * 100 < len(many) * SIMILAR_PERCENT or not len(few):
        return False
    both = int((many[np.minimum(np.searchsorted(many, few), len(many) - 1)] == few).sum())
    return both * 100 >= (len(few) + len(many) - both) * SIMILAR_PERCENT


def sketch(text: str | None) -> tuple[bytes, list[int]]:
    """The 768-bit SimHash of the different 5-word shingles of a text, and their smallest hashes of
    eight kinds as signed integers; zero bits and none without words. Words as in ``fingerprint``."""
    hashes = shingle_hashes(text)
    if not len(hashes):
        return bytes(8 * WORDS), []
    counts = np.zeros(64 * WORDS, np.int64)
    smallest = np.full(MINIMA, 2**64 - 1, np.uint64)
    for at in range(0, len(hashes), 1024):
        some = hashes[at : at + 1024]
        counts += np.unpackbits(_mixed(some, 0, WORDS).view(np.uint8), axis=1, bitorder="little").sum(axis=0, dtype=np.uint16)
        smallest = np.minimum(smallest, _mixed(some, WORDS, MINIMA).min(axis=0))
    return np.packbits(counts * 2 > len(hashes), bitorder="little").tobytes(), smallest.view(np.int64).tolist()


def planes(values: np.ndarray) -> np.ndarray:
    """Bit planes of fingerprints, each a row of uint64 words: row b holds bit b of each fingerprint,
    64 fingerprints a word."""
    padded = np.zeros((-(-len(values) // 64) * 64, values.shape[1]), np.uint64)
    padded[: len(values)] = values
    bits = np.unpackbits(padded.view(np.uint8), axis=1, bitorder="little")
    return np.ascontiguousarray(np.packbits(bits.T, axis=1, bitorder="little")).view(np.uint64)


def near(queries: np.ndarray, block: np.ndarray, n: int, radius: int = RADIUS) -> np.ndarray:
    """Boolean (queries, n): which of the block's n fingerprints lie within the radius of which query.

    Counters start so that they overflow just beyond the radius; what carries out of them marks the
    distance as beyond it for good.
    """
    size = radius.bit_length()
    spare = (1 << size) - 1 - radius
    shape = (len(queries), block.shape[1])
    full, one = ~np.uint64(0), np.uint64(1)
    counters = [np.full(shape, full if spare >> i & 1 else 0, np.uint64) for i in range(size)]
    beyond = np.zeros(shape, np.uint64)
    bits = 64 * queries.shape[1]
    for b in range(bits):
        mask = np.uint64(0) - ((queries[:, b // 64] >> np.uint64(b % 64)) & one)
        carry = block[b][None, :] ^ mask[:, None]
        for i in range(size):
            counters[i], carry = counters[i] ^ carry, counters[i] & carry
        beyond |= carry
        if b % 8 == 7 and b >= radius and b + 1 < bits and (beyond == full).all():
            return np.zeros((len(queries), n), bool)
    found = np.unpackbits(np.ascontiguousarray(beyond).view(np.uint8), axis=1, bitorder="little")[:, :n]
    return found == 0


def _stars(values: np.ndarray, ids: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (id, smallest id of its group) for the groups of linked values. Links are merged block
    by block, so that very many of them are never held at once."""
    order = np.argsort(ids, kind="stable")
    values, ids = values[order], ids[order]
    n, root = len(values), np.arange(len(values))
    blocks = [(at, values[at : at + BLOCK]) for at in range(0, n, BLOCK)]
    sliced = [planes(v) for _, v in blocks]
    for i, (at, v) in enumerate(blocks):
        for j in range(i + 1):
            a, b = np.nonzero(near(v, sliced[j], len(blocks[j][1]), radius))
            a, b = a + at, b + blocks[j][0]
            open_ = root[a] != root[b]
            a, b = a[open_], b[open_]
            while len(a):
                low = np.minimum(root[a], root[b])
                np.minimum.at(root, root[a], low)
                np.minimum.at(root, root[b], low)
                while not np.array_equal(root, root[root]):
                    root = root[root]
                open_ = root[a] != root[b]
                a, b = a[open_], b[open_]
    moved = np.nonzero(root != np.arange(n))[0]
    return ids[moved], ids[root[moved]]


def _verified_stars(values: np.ndarray, ids: np.ndarray, sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """As _stars() at WIDE_RADIUS, of the pairs whose sets are alike. Pairs that others have joined
    already are not compared."""
    order = np.argsort(ids, kind="stable")
    values, ids, sets = values[order], ids[order], [sets[i] for i in order.tolist()]
    n, root = len(values), list(range(len(values)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = i = root[root[i]]
        return i

    blocks = [(at, values[at : at + BLOCK]) for at in range(0, n, BLOCK)]
    sliced = [planes(v) for _, v in blocks]
    for i, (at, v) in enumerate(blocks):
        for j in range(i + 1):
            a, b = np.nonzero(near(v, sliced[j], len(blocks[j][1]), WIDE_RADIUS))
            a, b = a + at, b + blocks[j][0]
            tops = np.fromiter(map(top, range(n)), np.int64, n)
            open_ = (a > b) & (tops[a] != tops[b])
            for x, y in zip(a[open_].tolist(), b[open_].tolist(), strict=True):
                p, q = top(x), top(y)
                if p != q and alike(sets[x], sets[y]):
                    root[max(p, q)] = min(p, q)
    tops = np.fromiter(map(top, range(n)), np.int64, n)
    moved = np.nonzero(tops != np.arange(n))[0]
    return ids[moved], ids[tops[moved]]


def _verification(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (group, value, node, text) sorted by group, with verified edges out."""
    group, found = None, {}

    def edges() -> pa.RecordBatch:
        values = np.frombuffer(b"".join(v for _, v in found), "<u8").reshape(-1, WORDS)
        a, b = _verified_stars(values, np.array([i for i, _ in found], np.int64), list(found.values()))
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    for batch in batches:
        columns = [batch.column(c) for c in ("group", "value", "node", "text")]
        for g, v, i, t in zip(*columns, strict=True):
            if g.as_py() != group:
                if len(found) > 1:
                    yield edges()
                group, found = g.as_py(), {}
            key = (i.as_py(), v.as_py())
            if key not in found:
                found[key] = shingle_hashes(t.as_py())
    if len(found) > 1:
        yield edges()


def _comparison(width: int, radius: int):
    """A map over rows (group, value, node) sorted by group, with edges out. Small groups share a
    block: a link between two of them is a true one all the same."""

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = np.empty(0, np.int64)
        value, ids = np.empty((0, width), np.uint64), np.empty(0, np.int64)

        def edges(lo: int, hi: int) -> pa.RecordBatch:
            a, b = _stars(value[lo:hi], ids[lo:hi], radius)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        for batch in batches:
            column = batch.column("value")
            words = np.frombuffer(b"".join(column.to_pylist()), "<u8") if pa.types.is_binary(column.type) else column.to_numpy().view(np.uint64)
            group = np.concatenate([group, batch.column("group").to_numpy()])
            value = np.concatenate([value, words.reshape(-1, width)])
            ids = np.concatenate([ids, batch.column("node").to_numpy()])
            ends = np.nonzero(group[1:] != group[:-1])[0] + 1
            at = 0
            while len(ends) and ends[-1] > at:
                # As many whole groups as a block holds, or the next one alone.
                k = np.searchsorted(ends, at + BLOCK, side="right")
                end = int(ends[k - 1]) if k and ends[k - 1] > at else int(ends[np.searchsorted(ends, at, side="right")])
                yield edges(at, end)
                at = end
            group, value, ids = group[at:], value[at:], ids[at:]
        if len(group):
            yield edges(0, len(group))

    return compared


def _keys() -> list:
    """The 16 keys of a fingerprint, the number of the key in the upper bits."""
    x, found = F.col("simhash"), []
    for i in range(4):
        block = F.shiftrightunsigned(x, 16 * i).bitwiseAND(F.lit(0xFFFF))
        above = F.shiftrightunsigned(x, 16 * (i + 1)) if i < 3 else F.lit(0).cast("long")
        rest = F.shiftleft(above, 16 * i).bitwiseOR(x.bitwiseAND(F.lit((1 << 16 * i) - 1).cast("long")))
        for j in range(4):
            part = F.shiftrightunsigned(rest, 12 * j).bitwiseAND(F.lit(0xFFF))
            found.append((F.lit((4 * i + j) << 28).cast("long") + F.shiftleft(block.cast("long"), 12) + part.cast("long")))
    return found


def _with_sizes(keyed: DataFrame, sizes: DataFrame, size: int) -> DataFrame:
    """Rows with their key's n of sizes (key, n), those without one left out. Rows of keys with n above
    ``size`` get it where they are, so that they do not meet by key."""
    sizes = stored(sizes, "key-sizes")
    hot = sizes.where(F.col("n") > size)
    known = hot.count()
    if not known:
        return keyed.join(sizes, "key")
    marked = keyed.join(F.broadcast(hot) if known <= HOT_KEYS else hot, "key", "left")
    return marked.where("n IS NOT NULL").unionByName(marked.where("n IS NULL").drop("n").join(sizes, "key"))


def _shared(keyed: DataFrame) -> DataFrame:
    """How many rows share each key that more than one has."""
    return keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")


def _dealt(rows: DataFrame, size: int, *more: str) -> DataFrame:
    """(group, node, value, more) of _with_sizes()'s rows: a key that more than ``size`` rows share is split
    into parts that meet pairwise, each pair in a group of its own; every two rows meet in one."""
    rows = rows.withColumn("parts", F.ceil(F.col("n") / size).cast("int"))
    part = F.pmod(F.xxhash64("value"), F.col("parts")).cast("int")
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.xxhash64(F.least(part, o), F.greatest(part, o)))
    alone = rows.where("parts = 1").select("key", "node", "value", *more, F.lit(0).cast("long").alias("pair"))
    split = rows.where("parts > 1").select("key", "node", "value", *more, F.explode(others).alias("pair"))
    return alone.unionByName(split).select(F.when(F.col("pair") == 0, F.col("key")).otherwise(F.xxhash64("key", "pair")).alias("group"), "node", "value", *more)


def _edges(groups: DataFrame, width: int, radius: int) -> DataFrame:
    return groups.repartition("group").sortWithinPartitions("group").mapInArrow(_comparison(width, radius), "a long, b long")


def links(nodes: DataFrame) -> DataFrame:
    """Edges (a, b) that join all nodes (node, simhash; each simhash once) within the radius."""
    keyed = nodes.select("node", F.col("simhash").alias("value"), F.explode(F.array(*_keys())).alias("key"))
    return _edges(_dealt(_with_sizes(keyed, _shared(keyed), PART), PART), 1, RADIUS)


def similar_links(nodes: DataFrame) -> DataFrame:
    """Candidates (a, b) between nodes (node, bits, minima) whose bits lie within the radius. All nodes that
    share a smallest hash meet, however many do, as with a passage in very many texts."""
    keyed = nodes.select("node", F.col("bits").alias("value"), F.posexplode("minima").alias("k", "m")).withColumn("key", F.xxhash64("k", "m"))
    return _edges(_dealt(_with_sizes(keyed, _shared(keyed), WIDE_PART), WIDE_PART), WORDS, WIDE_RADIUS)


def verified_links(df: DataFrame, nodes: DataFrame, candidates: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Edges (a, b) between nodes (node, bits, t, size) that one component of candidates (node,
    component) holds and whose shingle sets are alike. A node's text is the one of df with its id and
    hash t. A component of very many rows or bytes is split into parts that meet pairwise."""
    rows = nodes.join(candidates, "node").select("node", "t", F.col("bits").alias("value"), "size", F.col("component").alias("key"))
    sizes = rows.groupBy("key").agg(F.greatest(F.count("*"), F.ceil(F.sum("size") / TEXT_BYTES)).alias("n"))
    groups = _dealt(_with_sizes(rows, sizes, WIDE_PART), WIDE_PART, "t")
    texts = df.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text")).withColumn("t", F.xxhash64("text"))
    full = groups.join(texts, ["node", "t"]).select("group", "value", "node", "text")
    return full.repartition("group").sortWithinPartitions("group").mapInArrow(_verification, "a long, b long")


def similar(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, component_id, the smallest id that a chain of similar texts reaches,
    its own included. Texts are similar if their sets of 5-word shingles have a Jaccard similarity of
    0.8 or more; a pair just there is missed by chance about once in 100,000. Equal bits are always linked.

    Null, empty and wordless texts are equal. Ids and nulls are treated as by ``near_duplicates``.
    Other columns are not kept. An empty table gives no rows.
    """

    @F.arrow_udf("struct<bits: binary, minima: array<bigint>>")
    def sketches(texts: pa.Array) -> pa.Array:
        bits, minima = zip(*[sketch(t.as_py()) for t in texts], strict=True) if len(texts) else ((), ())
        return pa.StructArray.from_arrays([pa.array(bits, pa.binary()), pa.array(minima, pa.list_(pa.int64()))], ["bits", "minima"])

    text = F.col(text_col).cast("string")
    docs = df.select(id_col, sketches(text).alias("s"), F.struct(F.xxhash64(text).alias("t"), F.octet_length(text).alias("size")).alias("x"))
    docs = stored(docs.select(id_col, "s.bits", "s.minima", "x"), "sketches")
    nodes = docs.where(F.col(id_col).isNotNull()).groupBy("bits").agg(F.min(id_col).cast("long").alias("node"), F.min("minima").alias("minima"), F.min_by("x", F.struct(id_col, "x")).alias("x"))
    nodes = stored(nodes.select("bits", "node", "minima", "x.t", "x.size"), "sketch-nodes")
    candidates = components(similar_links(nodes), "sketch-candidates")
    found = components(verified_links(df, nodes, candidates, id_col, text_col), "sketch-components")
    return _named(docs, nodes, found, "bits").select(id_col, "component_id")


def _named(docs: DataFrame, nodes: DataFrame, found: DataFrame, value: str) -> DataFrame:
    """docs with the component_id of their value's node."""
    named = nodes.join(found, "node", "left").select(value, F.coalesce("component", "node").alias("component_id"))
    return docs.join(named, value, "left")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of df: id, fingerprint (16 hexadecimal digits), component_id.

    component_id is the smallest id that a chain of links reaches, the row's own included. Null,
    empty and wordless texts have fingerprint zero and are linked like any other. Rows that repeat
    an id are one document and so linked; a row with a null id has the component of its fingerprint, null if
    no other row has it. Other columns are not kept. An empty table gives no rows.
    """
    docs = stored(fingerprints(df.select(id_col, text_col), text_col).select(id_col, "simhash"), "simhash")
    nodes = docs.where(F.col(id_col).isNotNull()).groupBy("simhash").agg(F.min(id_col).cast("long").alias("node"))
    nodes = stored(nodes, "simhash-nodes")
    digits = F.lpad(F.lower(F.hex("simhash")), 16, "0")
    return _named(docs, nodes, components(links(nodes), "simhash-components"), "simhash").select(id_col, digits.alias("fingerprint"), "component_id")
