"""Quality rules: base statistics of a text, and lines that recur across a host's documents.

Lines are normalised and hashed; a line counts once for every distinct document of a host that holds
it. Exact copies are one document under several ids: if each counted, a document copied often would
lose every line, and its copies and itself be rejected, for being copied. Lines above a limit are
removed, and a document that little is left of is rejected. The limit is a number of documents and no
share, so that a verdict does not loosen as a host grows. DataFrame functions only.

Everything that leaves a task is hashes and counts: texts are never shuffled for the counting.
Counts are combined before the shuffle, so a line that a third of all documents share is one row a
task. Texts are scanned three times: to count lines, to find what each text loses, and to judge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from papyrion.llm.shared import SPACE, WORD, free_name, let, n_words, words

#: A line is removed if more distinct documents of its host hold it than this many.
MOST_DOCUMENTS = 20
#: A document is depleted if less than this percentage of its words remains.
REMAIN_PERCENT = 30
#: Base rules: fewer words fail, and a larger percentage of words in repeated windows fails.
LEAST_WORDS, MOST_REPEATED_PERCENT = 50, 50


def _lines(text: Column) -> Column:
    """The lines that hold a word."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda x: x.rlike(WORD))


def normalised(line: Column) -> Column:
    """A-Z in lower case, runs of white space as one space, none at the ends."""
    lower = F.translate(line, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.trim(F.regexp_replace(lower, SPACE, " "))


def _repeat_words(found: Column) -> Column:
    """Words that lie in a 3-word window found twice or more: windows are hashed and sorted by
    (hash, place); the places of those with an equal neighbour, in order, cover up to 3 words each."""

    def covered(places: Column) -> Column:
        after = F.concat(F.slice(places, 2, F.greatest(F.size(places), F.lit(1))), F.array(F.lit(1 << 30)))
        return F.aggregate(F.zip_with(places, after, lambda a, b: F.least(b - a, F.lit(3))), F.lit(0), lambda s, x: s + x)

    def again(pairs: Column) -> Column:
        same = lambda x, i: (F.try_element_at(pairs, i + 2)["h"] == x["h"]) | ((i > 0) & (F.get(pairs, i - 1)["h"] == x["h"]))
        kept = F.filter(pairs, lambda x, i: F.coalesce(same(x, i), F.lit(False)))
        return let(F.array_sort(F.transform(kept, lambda x: x["i"])), covered)

    def windows(w: Column) -> Column:
        hashes = F.transform(F.sequence(F.lit(0), F.size(w) - 3), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))
        pairs = lambda h: F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))
        return let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(pairs(h), again)))

    return F.when(F.size(found) < 3, F.lit(0)).otherwise(windows(found))


def base_statistics(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    A null text counts as empty: no words, and base_failed. Windows are compared by 64-bit hash
    within one text. Columns of these names are replaced.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))

    def statistics(w: Column) -> Column:
        lines = _lines(text)
        return F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.char_length(F.regexp_replace(text, SPACE, "")).cast("long").alias("word_chars"),
            F.char_length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
            let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
            _repeat_words(w).cast("long").alias("n_repeat_words"),
        )

    s = free_name(df, "_statistics")
    out = df.withColumn(s, let(words(F.col(text_col)), statistics))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    out = out.select(*[c for c in df.columns if c.lower() not in (*names, "base_failed")], *[F.col(s)[n].alias(n) for n in names])
    failed = (F.col("n_words") < LEAST_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MOST_REPEATED_PERCENT)
    return out.withColumn("base_failed", failed)


def frequent_lines(df: DataFrame, host_col: str = "source", text_col: str = "text", most_documents: int = MOST_DOCUMENTS) -> DataFrame:
    """(host, line): the hashes of normalised lines that more than ``most_documents`` distinct documents
    of a host hold. A null host is a host of its own."""
    line_hashes = F.array_distinct(F.transform(_lines(F.col(text_col)), lambda x: F.xxhash64(normalised(x))))
    texts = df.select(_host(host_col).alias("host"), _content(text_col).alias("t"), line_hashes.alias("lines"))
    texts = texts.groupBy("host", "t").agg(F.first("lines").alias("lines"))
    counts = texts.select("host", F.explode("lines").alias("line")).groupBy("host", "line").agg(F.count("*").alias("n"))
    return counts.where(F.col("n") > most_documents).select("host", "line")


def _host(host_col: str) -> Column:
    return F.coalesce(F.concat(F.lit("s"), F.col(host_col)), F.lit("n"))


def _content(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))


def line_verdicts(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", **limits) -> DataFrame:
    """One row for each text with frequent lines, by host, t (its hash) and spread: removed (hashes of
    its normalised lines that go) and removed_words (words in them, every occurrence). spread is a
    hash of the id, so that what very many rows share does not meet in one task."""
    words_of = F.transform(_lines(F.col(text_col)), lambda x: F.struct(F.xxhash64(normalised(x)).alias("line"), n_words(x).alias("n")))
    lines = df.select(*_place(id_col, host_col, text_col), F.posexplode(words_of).alias("i", "x"))
    lines = lines.select("spread", "host", "t", F.struct("i", "x.line", "x.n").alias("x"), F.col("x.line").alias("line"))
    found = lines.join(frequent_lines(df, host_col, text_col, **limits), ["host", "line"], "left_semi")
    # A set, so that repeated rows count once.
    rows = found.groupBy("spread", "host", "t").agg(F.collect_set("x").alias("x"))
    removed_words = F.aggregate("x", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return rows.select("spread", "host", "t", F.array_distinct(F.transform("x", lambda x: x["line"])).alias("removed"), removed_words.alias("removed_words"))


def _place(id_col: str, host_col: str, text_col: str) -> list[Column]:
    return [F.xxhash64(id_col).alias("spread"), _host(host_col).alias("host"), _content(text_col).alias("t")]


def judge(df: DataFrame, id_col: str = "doc_id", host_col: str = "source", text_col: str = "text", remain_percent: int = REMAIN_PERCENT, **limits) -> DataFrame:
    """Every row of df with the base statistics, removed, removed_words and kept.

    kept is false if base_failed, or if less than ``remain_percent`` percent of the words remain
    once frequent lines are removed. The verdict is each row's own, whatever other rows have its id or
    none. Null texts and hosts count as the empty text and as one host; an empty table gives no rows.
    Columns of the added names are replaced.
    """
    plain = df.drop("removed", "removed_words", "kept")
    names = [free_name(plain, f"_{c}") for c in ("spread", "host", "t")]
    verdicts = line_verdicts(df, id_col, host_col, text_col, **limits).toDF(*names, "removed", "removed_words")
    placed = plain.withColumns(dict(zip(names, _place(id_col, host_col, text_col), strict=True)))
    out = base_statistics(placed, text_col).join(verdicts, names, "left").drop(*names)
    out = out.withColumn("removed_words", F.coalesce(F.col("removed_words"), F.lit(0)).cast("long"))
    depleted = (F.col("n_words") - F.col("removed_words")) * 100 < F.col("n_words") * remain_percent
    return out.withColumn("kept", ~F.col("base_failed") & ~depleted)


def without_removed(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The text of judge()'s rows without the lines in ``removed``; other lines keep every character."""
    keep = F.filter(F.split(F.col(text_col), "\n", -1), lambda x: ~F.array_contains(F.col("removed"), F.xxhash64(normalised(x))))
    return df.withColumn(text_col, F.when(F.col("removed").isNull(), F.col(text_col)).otherwise(F.array_join(keep, "\n")))
