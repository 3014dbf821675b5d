import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from papyrion.llm import simhash
from papyrion.llm.components import components

SCHEMA = "doc_id long, text string, simhash string, key int"


def plain_fingerprint(text):
    words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """prints: {id: fingerprint}. Smallest id reachable over links at 3 or fewer bits."""
    ids, root = sorted(prints), {i: i for i in prints}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            if (prints[a] ^ prints[b]).bit_count() <= 3:
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


@given(st.text(alphabet=st.sampled_from("aAbÀ \t\n\x1f\xa0"), max_size=40))
@settings(max_examples=200, deadline=None)
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=8), st.lists(st.lists(st.integers(0, 63), max_size=6), min_size=1, max_size=90))
@settings(max_examples=100, deadline=None)
def test_bit_sliced_distances(queries, flips):
    q = np.array(queries, np.uint64)
    values = np.array([queries[i % len(queries)] ^ sum(1 << b for b in set(bits)) for i, bits in enumerate(flips)], np.uint64)
    got = simhash.near(q.reshape(-1, 1), simhash.planes(values.reshape(-1, 1)), len(values))
    want = np.array([[(int(a) ^ int(b)).bit_count() <= 3 for b in values] for a in q])
    assert np.array_equal(got, want)


def test_query_is_brute_force(spark):
    from papyrion.llm.queries import op5_simhash

    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    prints = {i: plain_fingerprint(t) for i, t in docs.items()}
    roots = plain_components(prints)
    got = op5_simhash(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((i, f"{p:016x}", roots[i]) for i, p in prints.items())
    assert len(set(roots.values())) < len(roots)


@pytest.mark.parametrize("part", [simhash.PART, 8])
def test_links_of_near_values(spark, monkeypatch, part):
    """Chains, keys that most values share, and keys split into parts lose no link."""
    monkeypatch.setattr(simhash, "PART", part)
    rng = np.random.default_rng(5)
    values = {0, (1 << 64) - 1}
    for base in rng.integers(0, 2**63, 12).tolist():
        v = base
        for _ in range(12):
            values.add(v)
            for b in rng.choice(64, rng.integers(1, 6), replace=False).tolist():
                v ^= 1 << b
    values = {i: v for i, v in enumerate(sorted(values, key=lambda v: v * 0x9E3779B97F4A7C15 % 2**64))}
    signed = [(i, v - (1 << 64) if v >> 63 else v) for i, v in values.items()]
    nodes = spark.createDataFrame(signed, "node long, simhash long")
    found = {r.node: r.component for r in components(simhash.links(nodes)).collect()}
    assert {i: found.get(i, i) for i in values} == plain_components(values)


def test_edges(spark):
    long = "lorem ipsum dolor sit amet " * 20000
    rows = [(5, None, "x", 1), (3, "", None, 2), (9, " \t\n", "x", None), (7, "One two THREE four", "x", 1), (2, "one two three FOUR", "x", 1), (2, "one two three FOUR", "x", 1),
            (2, "other words altogether here", "q", 1), (None, "one two three four", "x", 1), (None, "nobody else says this", "x", 1), (8, long, "x", 1), (11, long + "amet", "x", 1)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    assert {by[i].copy().pop() for i in (5, 3, 9)} == {("0" * 16, 3)}
    assert {c for _, c in by[7]} == {2} and {c for _, c in by[2]} == {2}
    assert {c for _, c in by[8] | by[11]} == {8}
    assert {c for _, c in by[None]} == {2, None}
    assert simhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(20, 60)] + [(3, 3), (7, 20), (20, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **{i: 7 for i in range(20, 60)}, 7: 7}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("radius", [0, 1, 5, 127, 128, 200])
def test_any_radius_and_width(radius):
    rng = np.random.default_rng(radius)
    base = rng.integers(0, 2**64, (6, 12), dtype=np.uint64)
    flips = rng.random((90, 768)) < rng.choice([0.0, 0.01, radius / 768, 0.3], 90)[:, None]
    values = base[np.arange(90) % 6] ^ np.packbits(flips, axis=1, bitorder="little").view("<u8")
    got = simhash.near(base, simhash.planes(values), 90, radius)
    assert np.array_equal(got, np.bitwise_count(base[:, None, :] ^ values[None, :, :]).sum(axis=2) <= radius)


def shingles(text):
    words = text.encode().lower().split()
    return {b" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


@pytest.mark.parametrize("part", [simhash.WIDE_PART, 20])
def test_similar_texts_are_found_and_others_left_alone(spark, monkeypatch, part):
    """Also where very many texts share a passage, so that hashes are shared by more than a part."""
    monkeypatch.setattr(simhash, "WIDE_PART", part)
    rng = np.random.default_rng(11)
    passage = [f"p{i}" for i in range(60)]
    texts = {}
    for base in range(60):
        words = [f"w{base}_{i}" for i in rng.integers(0, 400, 200)]
        for copy in range(4):
            changed = list(words)
            for at in rng.integers(0, 200, copy):
                changed[at] = "changed"
            texts[base * 10 + copy] = " ".join(passage + changed)
    texts |= {5000: "", 5001: " ", 5002: "short", 5003: "SHORT", 5004: "other"}
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], SCHEMA)
    got = {r.doc_id: r.component_id for r in simhash.similar(df).collect()}
    sets = {i: shingles(t) for i, t in texts.items()}
    for i in texts:
        for j in texts:
            if i < j and similarity(sets[i], sets[j]) >= 0.85:
                assert got[i] == got[j]
            if i < j and i // 10 != j // 10 and similarity(sets[i], sets[j]) < 0.5:
                assert got[i] != got[j]
    assert (got[5001], got[5003], got[5004]) == (5000, 5002, 5004)


@pytest.mark.parametrize("part", [1, 20, simhash.WIDE_PART])
def test_similar_over_the_documents(spark, monkeypatch, part):
    """The components of all pairs of 0.8 or more, by brute force, however small the parts."""
    monkeypatch.setattr(simhash, "WIDE_PART", part)
    docs = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).collect()}
    sets = {i: shingles(t) for i, t in docs.items()}
    near = [(i, j) for i in sets for j in sets if i < j and 0.8 <= len(sets[i]) / max(1, len(sets[j])) <= 1.25 and similarity(sets[i], sets[j]) >= 0.8]
    assert got == plain_roots(sets, near) and len(set(got.values())) < len(got)


def plain_roots(ids, pairs):
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        x, y = top(a), top(b)
        root[max(x, y)] = min(x, y)
    return {i: top(i) for i in ids}


def test_similar_edges(spark):
    rows = [(5, None, "x", 1), (None, "a b c d e f", "x", 1), (2, "a b c d e f", "x", 1), (2, "z", "x", 1), (7, "A b c\td e f", None, None), (8, "lorem ipsum " * 100000, "x", 1)]
    got = simhash.similar(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted((r.doc_id or 0, r.component_id) for r in got) == [(0, 2), (2, 2), (2, 2), (5, 5), (7, 2), (8, 8)]
    assert simhash.similar(spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_hash_that_very_many_share_loses_no_link(spark, monkeypatch):
    """Nodes whose one shared smallest hash is shared by more than a part meet all the same."""
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**64, (40, 12), dtype=np.uint64)
    rows = []
    for i, bits in enumerate(np.concatenate([base, base ^ np.uint64(1)])):
        rows.append((i, bits.tobytes(), [7, *rng.integers(0, 2**62, 3).tolist()]))
    nodes = spark.createDataFrame(rows, "node long, bits binary, minima array<long>")
    monkeypatch.setattr(simhash, "WIDE_PART", 20)
    found = {r.node: r.component for r in components(simhash.similar_links(nodes)).collect()}
    assert found == {i: i % 40 for i in range(80)}


@pytest.mark.parametrize("rows, size", [(simhash.WIDE_PART, simhash.TEXT_BYTES), (20, 8192), (4096, 2)])
def test_the_similarity_itself_decides(spark, monkeypatch, rows, size):
    """Pairs just below 0.8 stay apart and pairs just above it are linked, however groups are split."""
    monkeypatch.setattr(simhash, "WIDE_PART", rows)
    monkeypatch.setattr(simhash, "TEXT_BYTES", size)
    texts = {}
    for base in range(120):
        words = [f"w{base}_{i}" for i in range(300)]
        texts[2 * base] = " ".join(words)
        for at in range(6 + base % 2):  # 30 of 296 shingles differ (0.817), or 35 (0.789)
            words[20 + 40 * at] = "changed"
        texts[2 * base + 1] = " ".join(words)
    got = {r.doc_id: r.component_id for r in simhash.similar(spark.createDataFrame([(i, t, "x", 1) for i, t in texts.items()], SCHEMA)).collect()}
    assert got == {i: i // 2 * 2 if similarity(shingles(texts[i // 2 * 2]), shingles(texts[i // 2 * 2 + 1])) >= 0.8 else i for i in texts}


def test_a_node_of_two_texts_is_compared_by_each(spark):
    a, b = ([f"{x}{i}" for i in range(200)] for x in "ab")
    rows = [(2, " ".join(a)), (2, " ".join(b)), (5, " ".join(a[:195])), (7, " ".join(b[5:])), (7, " ".join(b[5:])), (9, " ".join(a[:100]))]
    got = simhash.similar(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()
    assert sorted((r.doc_id, r.component_id) for r in got) == [(2, 2), (2, 2), (5, 2), (7, 2), (7, 2), (9, 9)]
