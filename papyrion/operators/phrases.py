"""Phrases in texts: collocations merged into single tokens, and a phrase list counted in one pass."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.plans.tables import written

# The words that may stand between the two words of a phrase.
CONNECTORS = "a an the of with without at from to in on by and or for".split()

#: Words of a block of texts, and of all blocks that have their different terms in one bucket, about.
BLOCK_WORDS, BUCKET_WORDS = 1_000_000, 4_000_000

#: Characters of a phrase list that one pass over the texts counts.
MOST_CHARACTERS = 16 << 20


class _Block:
    """The words of a block of texts as numbers, each two in a row that are no connectors as a pair (its places
    s and e, with only connectors between), and the pairs' kinds: equal pairs with equal words between."""

    def __init__(self, texts: pa.Table, connectors: list[str]) -> None:
        sizes = texts.column("_n").to_numpy()
        words = pc.split_pattern(texts.column("_words").combine_chunks().filter(pa.array(sizes > 0)), "\n")
        if not np.array_equal(pc.list_value_length(words).to_numpy(), sizes[sizes > 0]):
            raise ValueError("words are not null and hold no line feed")
        encoded = words.flatten().dictionary_encode()
        self.vocabulary, ids = encoded.dictionary, encoded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        self.ids, self.row, size = ids, np.repeat(np.arange(len(sizes)), sizes), max(1, len(encoded.dictionary))
        plain = ~np.isin(np.arange(size), pc.index_in(pa.array(connectors, self.vocabulary.type), self.vocabulary).drop_null().to_numpy())
        at = np.flatnonzero(plain[ids])
        together = self.row[at[:-1]] == self.row[at[1:]]
        self.s, self.e = at[:-1][together], at[1:][together]
        between, length, step = np.zeros(len(self.s), np.int64), self.e - self.s, 1
        longer = np.flatnonzero(length > 1)
        while len(longer):
            between[longer] = pd.factorize(between[longer] * size + ids[self.s[longer] + step])[0]
            step += 1
            longer = longer[length[longer] > step]
        spans = pd.factorize(length * (len(length) + 1) + between)[0].astype(np.int64)
        ends = pd.factorize(ids[self.s] * size + ids[self.e])[0].astype(np.int64)
        self.kind, kinds = pd.factorize(ends * (len(length) + 1) + spans)
        first = np.zeros(len(kinds), np.int64)
        first[self.kind[::-1]] = np.arange(len(length))[::-1]
        self.n_pairs = np.bincount(self.kind, minlength=len(kinds))
        self.words = np.flatnonzero(plain[: len(self.vocabulary)])  # in these and n_words: no connectors
        self.n_words = np.bincount(ids, minlength=size)[self.words]
        self.first, self.last = self.s[first], self.e[first]

    def joined(self) -> pa.Array:
        """The spelling of each kind of pair."""
        length, parts = self.last - self.first, [pa.array([], self.vocabulary.type)]
        order = np.argsort(length, kind="stable")
        for places in np.split(order, np.flatnonzero(np.diff(length[order])) + 1) if len(order) else ():
            words = [self.vocabulary.take(pa.array(self.ids[self.first[places] + i])) for i in range(length[places[0]] + 1)]
            parts.append(pc.binary_join_element_wise(*words, "_"))
        return pa.concat_arrays(parts).take(pa.array(np.argsort(order)))


def _hashed(terms: pa.Array, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, hash, order) of terms: 64 bits tell terms of a bucket apart, as many more name the bucket as it
    takes, and the order is by both."""
    texts = terms.to_numpy(zero_copy_only=False)
    bucket, mixed = (pd.util.hash_array(texts, hash_key=k, categorize=False) for k in ("papyrion bucket.", "papyrion phrases"))
    bucket, order = (bucket % np.uint64(buckets)).astype(np.uint16), np.argsort(mixed)
    return bucket, mixed.view(np.int64), order[np.argsort(bucket[order], kind="stable")]


def _lists(values: np.ndarray, bucket: np.ndarray, buckets: int) -> pa.Array:
    """A list a bucket of values that are in the buckets' order."""
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(bucket, np.arange(buckets + 1)).astype(np.int32)), pa.array(values))


def _block_counts(texts: DataFrame, least: int, connectors: list[str], buckets: int) -> DataFrame:
    """(block, bucket, n_words, n_pairs): how often each different word and pair of a block stands in all texts,
    spelt alike counted alike, in the order of _hashed(); 0 for pairs found less than ``least`` times.

    Only hashes and counts of a block's different terms are dealt to buckets, and counts go back."""

    def terms(table: pa.Table) -> pa.Table:
        block, columns = _Block(table, connectors), {}
        for name, spelt, n in (("words", block.vocabulary.take(pa.array(block.words)), block.n_words), ("pairs", block.joined(), block.n_pairs)):
            bucket, mixed, order = _hashed(spelt, buckets)
            columns[name] = _lists(mixed[order], bucket[order], buckets)
            columns[f"n_{name}"] = _lists(n[order].astype(np.int32), bucket[order], buckets)
        return pa.table({"block": pa.array([table.column("_block")[0].as_py()] * buckets, pa.int64()), "bucket": pa.array(np.arange(buckets), pa.int64()), **columns})

    def totals(table: pa.Table) -> pa.Table:
        flat = lambda c: table.column(c).combine_chunks().flatten().to_numpy()
        _, same = np.unique(np.concatenate([flat("words"), flat("pairs")]), return_inverse=True)
        n = np.bincount(same, weights=np.concatenate([flat("n_words"), flat("n_pairs")])).astype(np.int64)[same]
        every = {"words": n[: len(flat("words"))], "pairs": np.where(n < least, 0, n)[len(flat("words")) :]}
        for name, values in every.items():
            ends = np.concatenate([[0], np.cumsum(pc.list_value_length(table.column(name)).to_numpy())]).astype(np.int32)
            every[name] = pa.ListArray.from_arrays(pa.array(ends), pa.array(values))
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "n_words": every["words"], "n_pairs": every["pairs"]})

    sent = texts.groupBy("_block").applyInArrow(terms, "block long, bucket long, words array<long>, n_words array<int>, pairs array<long>, n_pairs array<int>")
    return sent.groupBy("bucket").applyInArrow(totals, "block long, bucket long, n_words array<long>, n_pairs array<long>")


def _n_words(df: DataFrame, words: str) -> int:
    return df.agg(F.sum(F.size(words)).alias("t")).first()["t"] or 0


def _with_phrases(df: DataFrame, key: Column, words: str, least: int, threshold: float, connectors: list[str], total: int | None, result, schema: str) -> DataFrame:
    """The rows that result(texts, block, good, n, npmi) makes of each block of texts; good, n and npmi are those
    of the block's kinds of pairs. Rows are dealt to blocks once: counts and results read the same shuffle."""
    total = _n_words(df, words) if total is None else total
    blocks, buckets = -(-total // BLOCK_WORDS) or 1, min(max(16, 1 << (total // BUCKET_WORDS).bit_length()), 1 << 15)
    texts = df.withColumn("_block", F.pmod(F.xxhash64(key), F.lit(blocks)).cast("long"))
    texts = texts.withColumns({"_n": F.greatest(F.size(words), F.lit(0)), "_words": F.array_join(words, "\n")}).drop(words)

    def made(texts: pa.Table, counts: pa.Table) -> pa.Table:
        block = _Block(texts, connectors)
        counts = counts.sort_by("bucket")
        n = {}
        for name, spelt in (("words", block.vocabulary.take(pa.array(block.words))), ("pairs", block.joined())):
            n[name] = np.zeros(len(spelt), np.int64)
            n[name][_hashed(spelt, buckets)[2]] = counts.column(f"n_{name}").combine_chunks().flatten().to_numpy()
        of = np.ones(max(1, len(block.vocabulary)), np.int64)
        of[block.words] = n["words"]
        p, a, b = (x / float(total) for x in (n["pairs"], of[block.ids[block.first]], of[block.ids[block.last]]))
        with np.errstate(divide="ignore", invalid="ignore"):
            npmi = np.log(p / (a * b)) / -np.log(p)
        return result(texts, block, (n["pairs"] >= max(1, least)) & (npmi > threshold), n["pairs"], npmi)

    counts = _block_counts(texts, least, connectors, buckets)
    return texts.groupBy("_block").cogroup(counts.groupBy("block")).applyInArrow(made, schema)


def phrase_table(df: DataFrame, words: str, least: int = 5, threshold: float = 0.5, connectors: list[str] = CONNECTORS, key: str | None = None, total: int | None = None) -> DataFrame:
    """(a, b, phrase, n, npmi): pairs of words, connectors between them kept and "_" as joint, found ``least``
    times or more, whose normalised pointwise mutual information is above the threshold. Words and joined pairs
    are counted by their spelling: a pair that is spelt like a word counts with it. A key that tells rows apart
    deals them evenly; without one, equal texts meet in one task. total is the number of words, if known."""

    def good_ones(texts: pa.Table, block: _Block, good: np.ndarray, n: np.ndarray, npmi: np.ndarray) -> pa.Table:
        at = pa.array(np.flatnonzero(good))
        word = lambda places: block.vocabulary.take(pa.array(block.ids[places[good]]))
        return pa.table({"a": word(block.first), "b": word(block.last), "phrase": block.joined().take(at), "n": pa.array(n).take(at), "npmi": pa.array(npmi).take(at)})

    found = _with_phrases(df.select(*{key or words, words}), F.col(key or words), words, least, threshold, connectors, total, good_ones, "a string, b string, phrase string, n long, npmi double")
    return found.dropDuplicates(["a", "b", "phrase"])


def merge_phrases(df: DataFrame, key: str, words: str, least: int = 5, threshold: float = 0.5, connectors: list[str] = CONNECTORS, total: int | None = None) -> DataFrame:
    """df with the pairs of its phrase_table() joined to single tokens, from left to right, each word in one
    phrase at most. The key tells rows apart.

    Of pairs that overlap in a row the first is joined, so the second is not, so the third is: in a
    run of good pairs every other one is joined.
    """

    def merged(texts: pa.Table, block: _Block, good: np.ndarray, n: np.ndarray, npmi: np.ndarray) -> pa.Table:
        at = np.flatnonzero(good[block.kind])
        first = np.ones(len(at), bool)
        first[1:] = (np.diff(at) > 1) | (np.diff(block.row[block.s[at]]) > 0)
        place = np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]
        taken = at[place % 2 == 0]
        edges = np.bincount(block.s[taken] + 1, minlength=len(block.ids) + 2) - np.bincount(block.e[taken] + 1, minlength=len(block.ids) + 2)
        kept, ids = np.cumsum(edges)[: len(block.ids)] == 0, block.ids.copy()
        ids[block.s[taken]] = len(block.vocabulary) + block.kind[taken]
        ends = np.concatenate([[0], np.cumsum(np.bincount(block.row[kept], minlength=len(texts)))]).astype(np.int32)
        lists = pa.ListArray.from_arrays(pa.array(ends), pa.concat_arrays([block.vocabulary, block.joined()]).take(pa.array(ids[kept])))
        return texts.drop_columns(["_words"]).append_column("_words", lists).select(columns)

    columns = ["_words" if c == words else c for c in df.columns]
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(columns, df.schema, strict=True))
    return _with_phrases(df, F.col(key), words, least, threshold, connectors, total, merged, schema).withColumnRenamed("_words", words)


def detect_phrases(df: DataFrame, key: str, words: str, least: int = 5, threshold: float = 0.5, connectors: list[str] = CONNECTORS, rounds: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """df with phrases merged into its words, and the tables of the rounds: the first joins pairs, the
    second pairs of what the first has joined, so that phrases of three or four words come about."""
    tables = []
    for i in range(rounds):
        total = _n_words(df, words)
        tables.append(phrase_table(df, words, least, threshold, connectors, key, total))
        df = merge_phrases(df, key, words, least, threshold, connectors, total)
        df = written(df, "phrase-texts") if i + 1 < rounds else df
    return df, tables


# A token, and a phrase that tokens, single spaces and underscores make up.
_TOKEN, _SIMPLE = re.compile(r"[^\W_]+"), re.compile(r"[^\W_]+(?:[ _][^\W_]+)*")


def _folded(text: str) -> str:
    """Text in which all that a pattern matches without regard to case is spelt alike: full case folding,
    and both i of Turkish as i."""
    return text.replace("\u0130", "i").replace("\u0131", "i").casefold()


class PhraseMatcher:
    """Counts a phrase list in a text. Phrases of tokens go into one automaton of their surfaces, whose
    hits count where they begin and end with a token; others, and those that only count in upper case,
    are patterns of their own. A second automaton, of the patterns' folded surfaces, tells which of them
    a text may match at all, so that a text is not searched once a pattern."""

    def __init__(self, phrases: list[str], upper_only: list[str] = ()) -> None:
        self.automaton, surfaces, self.patterns = ahocorasick.Automaton(), {}, {}
        self.candidates, folded = ahocorasick.Automaton(), {}
        for phrase in sorted(set(phrases)):
            if phrase in upper_only:
                self.patterns[phrase] = rf"\b{re.escape(phrase.upper())}\b", re.NOFLAG
                folded.setdefault(_folded(phrase.upper()), set()).add(phrase)
            elif _SIMPLE.fullmatch(phrase):
                for surface in {phrase.lower(), phrase.replace("_", " ").lower()}:
                    surfaces.setdefault(surface, []).append(phrase)
            else:
                spaced = phrase.replace("_", " ")
                self.patterns[phrase] = rf"\b{re.escape(phrase)}\b|\b{re.escape(spaced)}\b", re.IGNORECASE
                for surface in (phrase, spaced):
                    folded.setdefault(_folded(surface), set()).add(phrase)
        for surface, names in surfaces.items():
            self.automaton.add_word(surface, (len(surface), names))
        if surfaces:
            self.automaton.make_automaton()
        self.any = bool(surfaces)
        for surface, names in folded.items():
            self.candidates.add_word(surface, names)
        if folded:
            self.candidates.make_automaton()
        self.compiled: dict[str, re.Pattern] = {}

    def counts(self, text: str) -> Counter:
        """How often each phrase is found; overlapping matches of the automaton all count."""
        found: Counter = Counter()
        if self.any:
            spans = [m.span() for m in _TOKEN.finditer(text)]
            lowered = text.lower()
            if len(lowered) != len(text):  # a character that becomes two
                shift, at = [0], 0
                for c in text:
                    shift.append(at := at + len(c.lower()))
                spans = [(shift[i], shift[j]) for i, j in spans]
            starts, ends = {i for i, _ in spans}, {j for _, j in spans}
            for last, (size, names) in self.automaton.iter(lowered):
                if last + 1 in ends and last + 1 - size in starts:
                    found.update(names)
        if self.patterns:
            for phrase in set().union(*(names for _, names in self.candidates.iter(_folded(text)))):
                if phrase not in self.compiled:  # a task meets few of a long list's patterns
                    self.compiled[phrase] = re.compile(*self.patterns[phrase])
                if n := sum(1 for _ in self.compiled[phrase].finditer(text)):
                    found[phrase] = n
        return found


def match_phrases(df: DataFrame, key: str, text: str, phrases: DataFrame, upper_only: list[str] = ()) -> DataFrame:
    """(key, phrase, n): how often each phrase of the list stands in each row's text, in one pass.

    The list goes to every task; if it has more than MOST_CHARACTERS, in parts of about that size and
    a pass each. Null texts and blank phrases match nothing.
    """
    own = phrases.where(F.trim("phrase") != "").select("phrase").distinct()
    parts = -(-(own.agg(F.sum(F.char_length("phrase") + 8)).first()[0] or 0) // MOST_CHARACTERS)
    rows, upper = df.select(key, F.col(text).cast("string").alias("text")), list(upper_only)
    schema = f"{key} {rows.schema[key].dataType.simpleString()}, phrase string, n long"
    out = None
    for part in range(max(1, parts)):
        listed = [r.phrase for r in own.where(F.pmod(F.xxhash64("phrase"), F.lit(max(1, parts))) == part).collect()]
        held = df.sparkSession.sparkContext.broadcast((listed, upper))

        def count(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            matcher = PhraseMatcher(*held.value)
            for batch in batches:
                places, names, counts = [], [], []
                for i, t in enumerate(batch.column(1)):
                    for phrase, n in matcher.counts(t.as_py() or "").items():
                        places.append(i)
                        names.append(phrase)
                        counts.append(n)
                columns = [batch.column(0).take(pa.array(places, pa.int64())), pa.array(names, pa.string()), pa.array(counts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [key, "phrase", "n"])

        found = rows.mapInArrow(count, schema)
        out = found if out is None else out.unionByName(found)
    return out
