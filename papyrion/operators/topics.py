"""Tokens, phrases, topic terms and topic tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import share
from papyrion.plans.tables import written


#: Runs of punctuation that white space or an end of the text stands before or behind, found in one pass over a text.
_MARK = r"[!-/:-@\[-^`{-~]"
_ENDS = rf"(?U)(?={_MARK})(?<!{_MARK})(?:(?<!\S){_MARK}++|{_MARK}++(?!\S))"
_MARKS = "".join(c for c in map(chr, range(0x21, 0x7F)) if not c.isalnum() and c != "_")

#: White space and what a token has one of, spelt alike in Java's patterns, Arrow's and SQL's.
_SPACE, _LETTER = r"[\t-\r \x{85}\p{Z}]+", r"[\p{L}\p{M}\p{N}_]"

#: Bytes of a block of texts, and of all texts that have their pairs in one bucket, about.
BLOCK_BYTES, BUCKET_BYTES = 16 << 20, 8 << 20


def tokens(text: Column) -> Column:
    """Lower-case white-space tokens without punctuation at their ends, underscores kept, of two or
    more characters with a letter, digit or underscore."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _ENDS, "")
    return F.filter(F.split(bare, _SPACE), lambda t: (F.char_length(t) >= 2) & t.rlike(_LETTER))


def ngrams(words: Column, width: int, joiner: str = " ") -> Column:
    """All runs of ``width`` words."""
    empty = F.array().cast("array<string>")
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - width + 1, F.lit(1))), lambda i: F.array_join(F.slice(words, i, width), joiner))).otherwise(empty)


def phrase_counts(df: DataFrame, key: str, words: Column, phrases: DataFrame, widths: list[int]) -> DataFrame:
    """(key, phrase, n): how often each phrase stands in each row's words; overlaps all count. Runs
    of the phrases' widths meet the phrase list in an equi-join, whatever the list's length."""
    runs = F.concat(*[ngrams(words, w) for w in widths])
    rows = df.select(key, F.explode(runs).alias("phrase"))
    return rows.join(phrases.select("phrase").distinct(), "phrase").groupBy(key, "phrase").agg(F.count("*").alias("n"))


def _encoded(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(vocabulary, ids, row) of the tokens() of lower-case texts: white space and marks are looked for in a text,
    what makes a token in the different ones alone."""
    lists = pc.split_pattern(pc.replace_substring_regex(texts, _SPACE, " "), " ")
    found = lists.flatten().dictionary_encode()
    bare = pc.ascii_trim(found.dictionary, characters=_MARKS)
    kept = pc.and_(pc.greater_equal(pc.utf8_length(bare), 2), pc.match_substring_regex(bare, _LETTER))
    spelt = pc.if_else(kept, bare, pa.scalar(None, bare.type)).dictionary_encode()
    ids = spelt.indices.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)[found.indices.to_numpy(zero_copy_only=False)]
    row = np.repeat(np.arange(len(texts)), pc.list_value_length(lists).to_numpy())
    return spelt.dictionary, ids[ids >= 0], row[ids >= 0]


def _block_pairs(texts: pa.Array, buckets: int) -> pa.RecordBatch:
    """(bucket, left_words, right_words, n) of a block of texts, a row a bucket, words joined by line feeds: how often
    words stand side by side, and with an empty word at its right, how often a word stands at all."""
    vocabulary, ids, row = _encoded(texts)
    size = len(vocabulary) + 1
    keys, n = np.unique((ids[:-1] * size + ids[1:])[row[:-1] == row[1:]], return_counts=True)
    left, right = np.divmod(np.concatenate([keys, np.arange(1, size) * size - 1]), size)
    n = np.concatenate([n, np.bincount(ids, minlength=size - 1)]).astype(np.int32)
    vocabulary = pa.concat_arrays([vocabulary, pa.array([""], vocabulary.type)])
    mixed = pd.util.hash_array(vocabulary.to_numpy(zero_copy_only=False), categorize=False)
    bucket = (((mixed[left] * np.uint64(0x9E3779B97F4A7C15) + mixed[right]) >> np.uint64(32)) % np.uint64(buckets)).astype(np.uint16)
    order = np.argsort(bucket, kind="stable")
    own, starts = np.unique(bucket[order], return_index=True)
    ends = pa.array(np.append(starts, len(order)).astype(np.int32))
    words = (pc.binary_join(pa.ListArray.from_arrays(ends, vocabulary.take(pa.array(side[order]))), "\n") for side in (left, right))
    return pa.RecordBatch.from_arrays([pa.array(own.astype(np.int64)), *words, pa.ListArray.from_arrays(ends, pa.array(n[order]))], ["bucket", "left_words", "right_words", "n"])


def _bucket_pairs(table: pa.Table, least: int) -> pa.Table:
    """(left_word, right_word, n) of a bucket: the pairs and words found ``least`` times or more in all blocks, and
    without any word, how many words there are."""
    words = [pc.split_pattern(table.column(f"{side}_words"), "\n").combine_chunks().flatten().dictionary_encode() for side in ("left", "right")]
    n, size = table.column("n").combine_chunks().flatten().to_numpy().astype(np.int64), len(words[1].dictionary)
    left, right = (w.indices.to_numpy().astype(np.int64) for w in words)
    total = n[right == pc.index(words[1].dictionary, "").as_py()].sum()
    keys = left * size + right
    order = np.argsort(keys)
    first = np.flatnonzero(np.diff(keys[order], prepend=-1))
    keys, n = keys[order][first], np.add.reduceat(n[order], first)
    keys, n = keys[n >= least], n[n >= least]
    found = [pa.concat_arrays([w.dictionary.take(pa.array(at)), pa.array([""], w.dictionary.type)]) for w, at in zip(words, np.divmod(keys, size), strict=True)]
    return pa.table([*found, pa.array(np.append(n, total))], ["left_word", "right_word", "n"])


def npmi_bigrams(df: DataFrame, text: str, least: int = 5, threshold: float = 0.5) -> DataFrame:
    """Bigrams of a text column's tokens() found ``least`` times or more whose normalised pointwise mutual
    information reaches the threshold: left_word, right_word, n, npmi.

    Texts are read once. Blocks of them deal their different words and pairs to buckets, which keep what is
    frequent: a word of a frequent pair is frequent too."""
    lowered = df.select(F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))
    size_of_all = df.agg(F.sum(F.octet_length(text)).alias("t")).first()["t"] or 0
    most, buckets = BLOCK_BYTES, min(max(16, 1 << (size_of_all // BUCKET_BYTES).bit_length()), 1 << 15)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            ends = size + np.cumsum(pc.binary_length(batch.column(0)).to_numpy().astype(np.int64))
            cuts = np.flatnonzero(np.diff(ends // most, prepend=0))
            for i, (start, end) in enumerate(zip([0, *cuts], [*cuts, len(ends)], strict=True)):
                if i and held:
                    yield _block_pairs(pa.concat_arrays(held), buckets)
                    held = []
                if end > start:
                    held.append(batch.column(0).slice(start, end - start))
            size = ends[-1] % most if len(ends) else size
        if held:
            yield _block_pairs(pa.concat_arrays(held), buckets)

    sent = lowered.mapInArrow(blocks, "bucket long, left_words string, right_words string, n array<int>")
    counts = sent.groupBy("bucket").applyInArrow(lambda table: _bucket_pairs(table, least), "left_word string, right_word string, n long")
    counts = written(counts, "npmi-counts")
    singles, pairs = counts.where((F.col("left_word") != "") & (F.col("right_word") == "")), counts.where(F.col("right_word") != "")
    total = counts.where(F.col("left_word") == "").agg(F.sum("n").alias("t")).withColumn("k", F.lit(1))
    s = lambda side: singles.select(F.col("left_word").alias(f"{side}_word"), F.col("n").alias(f"{side}_c"))
    out = pairs.join(s("left"), "left_word").join(s("right"), "right_word").withColumn("k", F.lit(1)).join(F.broadcast(total), "k")  # one row
    p = F.col("n") / F.col("t")
    npmi = F.log(p / (F.col("left_c") / F.col("t") * (F.col("right_c") / F.col("t")))) / -F.log(p)
    return out.withColumn("npmi", npmi).where(F.col("npmi") >= threshold).select("left_word", "right_word", "n", "npmi")


def ctfidf(df: DataFrame, topic: str, words: Column, least_df: int = 2, n: int | None = None) -> DataFrame:
    """Class-based term weights: term frequency in the topic times ln(1 + A / f), A the average words
    a topic and f the term's frequency everywhere; terms in ``least_df`` topics' worth of rows."""
    rows = df.select(F.col(topic).alias("topic"), F.explode(words).alias("term"))
    counts = rows.groupBy("topic", "term").agg(F.count("*").alias("n"))
    sizes = F.sum("n").over(Window.partitionBy("topic"))
    everywhere = Window.partitionBy("term")
    average = counts.agg((F.sum("n") / F.count_distinct("topic")).alias("a")).withColumn("k", F.lit(1))
    out = counts.withColumn("tf", F.col("n") / sizes).withColumn("f", F.sum("n").over(everywhere)).where(F.col("f") >= least_df)
    out = out.withColumn("k", F.lit(1)).join(F.broadcast(average), "k").withColumn("weight", F.col("tf") * F.log1p(F.col("a") / F.col("f")))
    out = out.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc(F.round("weight", 12)), "term")))
    out = out.where(F.col("rank") <= n) if n else out
    return out.select("topic", "term", "n", "weight", "rank")


def terms_by_topic(df: DataFrame, key: str, topic: str, words: Column, n: int = 20) -> DataFrame:
    """The n terms of each topic found in most of its rows, with the percentage of rows."""
    rows = df.select(F.col(topic).alias("topic"), key, F.explode(F.array_distinct(words)).alias("term"))
    counts = rows.groupBy("topic", "term").agg(F.count("*").alias("papers"))
    sizes = df.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("total"))
    ranked = counts.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("papers"), "term"))).where(F.col("rank") <= n)
    return ranked.join(sizes, "topic").withColumn("percent", 100 * share(F.col("papers"), F.col("total"))).drop("total")


def assign_topics(df: DataFrame, topic: str, probabilities: str, least: float = 0.05) -> DataFrame:
    """df with assigned_topic and was_outlier: an outlier (-1 or null) goes to its most probable topic
    if that has ``least``, else to none."""
    p = F.col(probabilities)
    best = F.when(F.array_max(p) >= least, F.array_position(p, F.array_max(p)) - 1)
    outlier = F.col(topic).isNull() | (F.col(topic) == -1)
    return df.withColumn("was_outlier", outlier).withColumn("assigned_topic", F.when(outlier, best).otherwise(F.col(topic)).cast("int"))


def topic_prevalence(df: DataFrame, topic: str, value: str, condition: Column) -> DataFrame:
    """Per topic: papers, share, median of a value, papers under a condition and their share; rows
    without a topic are one group of their own, with a null share."""
    out = df.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("papers"), F.median(value).alias("median_value"), F.count(F.when(condition, 1)).alias("hits"))
    total = F.sum(F.when(F.col("topic").isNotNull(), F.col("papers"))).over(Window.partitionBy(F.lit(1)))
    out = out.withColumn("share", F.when(F.col("topic").isNotNull(), F.col("papers") / total))
    return out.withColumn("hit_share", F.col("hits") / F.col("papers"))


def topic_by_group(df: DataFrame, topic: str, group: str) -> DataFrame:
    """Per group: papers of each topic and their percentage of the group."""
    out = df.groupBy(F.col(group).alias("group"), F.col(topic).alias("topic")).agg(F.count("*").alias("papers"))
    return out.withColumn("percent", 100 * F.col("papers") / F.sum("papers").over(Window.partitionBy("group")))


def topics_over_time(df: DataFrame, topic: str, moment: str, bins: int = 20, least: int = 10) -> DataFrame:
    """Papers of each topic in equal bins between the first and the last moment; no rows if fewer than
    ``least`` are dated."""
    span = df.agg(F.min(moment).alias("lo"), F.max(moment).alias("hi"), F.count(moment).alias("dated")).withColumn("k", F.lit(1)).where(F.col("dated") >= least)
    rows = df.where(F.col(moment).isNotNull()).withColumn("k", F.lit(1)).join(F.broadcast(span), "k")  # one row
    width = F.nullif(F.col("hi") - F.col("lo"), F.lit(0))
    place = F.coalesce(F.least(F.floor((F.col(moment) - F.col("lo")) * bins / width), F.lit(bins - 1)), F.lit(0))
    return rows.groupBy(F.col(topic).alias("topic"), place.cast("int").alias("bin")).agg(F.count("*").alias("papers"))


def centroids(df: DataFrame, topic: str, vector: str) -> DataFrame:
    """The mean vector of each topic, summed by component so that partial sums combine."""
    parts = df.select(F.col(topic).alias("topic"), F.posexplode(vector).alias("i", "x")).groupBy("topic", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy("topic").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("centroid"))


def cosine(a: Column, b: Column) -> Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def centroid_nearest(df: DataFrame, key: str, topic: str, vector: str, n: int = 3) -> DataFrame:
    """The n rows of each topic nearest to its mean vector by cosine."""
    rows = df.join(centroids(df, topic, vector).withColumnRenamed("topic", topic), topic)
    rows = rows.select(key, F.col(topic).alias("topic"), cosine(F.col(vector), F.col("centroid")).alias("similarity"))
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("similarity"), key))).where(F.col("rank") <= n)


def fitted(df: DataFrame, topic: str, order: list, n: int) -> DataFrame:
    """The n first rows of each topic by an explicit order, with their rank."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(topic).orderBy(*order))).where(F.col("rank") <= n)


def term_column(counts: DataFrame, key: str) -> DataFrame:
    """(key, terms): "term:count;..." by count descending, then term."""
    parts = counts.groupBy(key).agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("o"), "phrase", "n"))).alias("x"))
    return parts.select(key, F.array_join(F.transform("x", lambda s: F.concat(s["phrase"], F.lit(":"), s["n"].cast("string"))), ";").alias("terms"))


def label_from_terms(weights: DataFrame) -> DataFrame:
    """(topic, label): the two heaviest terms."""
    tops = weights.where("rank <= 2").groupBy("topic").agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("x"))
    return tops.select("topic", F.array_join(F.transform("x", lambda s: s["term"]), " / ").alias("label"))


def topic_fit(df: DataFrame, key: str, vector: str, k: int, seed: int = 7, dimensions: int | None = None) -> PipelineModel:
    """A fit of k-means topics, after a principal-component projection if ``dimensions`` is given. It can be
    saved and loaded, and assigned_by() applies it."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import PCA

    projection = [PCA(k=dimensions, inputCol="features", outputCol="projected")] if dimensions else []
    means = KMeans(k=k, seed=seed, featuresCol="projected" if dimensions else "features", predictionCol="topic")
    return Pipeline(stages=[*projection, means]).fit(_features(df, key, vector))


def _features(df: DataFrame, key: str, vector: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return df.select(key, array_to_vector(F.col(vector).cast("array<double>")).alias("features"))


def assigned_by(model: PipelineModel, df: DataFrame, key: str, vector: str) -> DataFrame:
    """(key, topic, probability, features) of rows by a fit: the probability is the topic's part of the inverse
    squared distances to all centres, so it is 1 at the centre and 1 / k in the middle of all; features are
    the projected ones if the fit projects."""
    from pyspark.ml.functions import vector_to_array

    place = model.stages[-1].getFeaturesCol()
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.stages[-1].clusterCenters()])
    x = vector_to_array(place)
    apart = F.transform(centres, lambda c: F.aggregate(F.zip_with(x, c, lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, v: s + v))
    fitted = model.transform(_features(df, key, vector)).withColumn("_apart", apart)
    own = F.get("_apart", F.col("topic"))
    part = 1 / F.aggregate("_apart", F.lit(0.0), lambda s, v: s + own / v)
    return fitted.select(key, "topic", F.when(own == 0, F.lit(1.0)).otherwise(part).alias("probability"), F.col(place).alias("features"))


def fit_topics(df: DataFrame, key: str, vector: str, k: int, seed: int = 7, dimensions: int | None = None) -> DataFrame:
    """assigned_by() a topic_fit() of the same rows: the counterpart of density_topics() with centres."""
    return assigned_by(topic_fit(df, key, vector, k, seed, dimensions), df, key, vector)


# The weights of a fit's score, and the least topics of one that may be recommended.
SILHOUETTE, DIVERSITY, ASSIGNED, BALANCE, LEAST_TOPICS = 0.25, 0.25, 0.35, 0.15, 5


def fit_score(silhouette: float, diversity: float, outlier_rate: float, size_cv: float) -> float:
    return (silhouette + 1) / 2 * SILHOUETTE + diversity * DIVERSITY + (1 - outlier_rate) * ASSIGNED + BALANCE / (1 + size_cv)


#: Topics whose counts of a word are columns of one row.
TOPICS_A_PASS = 64


def top_words(models: list[PipelineModel], df: DataFrame, key: str, vector: str, words: Column, least_df: int = 2, n: int = 10, texts: DataFrame | None = None) -> DataFrame:
    """(fit, topic, term, n, weight, rank): ctfidf() of the topics that each fit gives the rows, cut at n terms a
    topic. A word is one row with its counts in all topics of up to TOPICS_A_PASS, so words are dealt once, not once
    a fit and topic. The words are df's or those of ``texts``, by the key."""
    rows = _features(df, key, vector)
    for i, model in enumerate(models):
        rows = model.transform(rows).select(key, "features", *[f"_t{j}" for j in range(i)], F.col("topic").alias(f"_t{i}"))
    rows = (df if texts is None else texts).select(key, words.alias("_words")).join(rows.drop("features"), key)
    rows = rows.select(F.explode("_words").alias("term"), *[f"_t{i}" for i in range(len(models))])
    slots, out = [(i, t) for i, m in enumerate(models) for t in range(len(m.stages[-1].clusterCenters()))], None
    for at in range(0, len(slots), TOPICS_A_PASS):
        own = slots[at : at + TOPICS_A_PASS]
        held = F.array(*[F.struct(F.lit(i).alias("fit"), F.lit(t).alias("topic"), F.col(f"_n{i}_{t}").alias("n")) for i, t in own])
        terms = rows.groupBy("term").agg(F.count("*").alias("f"), *[F.count(F.when(F.col(f"_t{i}") == t, 1)).alias(f"_n{i}_{t}") for i, t in own])
        terms = terms.select("term", "f", F.explode(held).alias("x")).select("term", "f", "x.*").where("n > 0")
        out = terms if out is None else out.unionByName(terms)
    out = written(out, "topic-words")
    sizes = out.groupBy("fit", "topic").agg(F.sum("n").alias("words"))
    sizes = sizes.withColumn("a", F.sum("words").over(Window.partitionBy("fit")) / F.count("*").over(Window.partitionBy("fit")))
    out = out.where(F.col("f") >= least_df).join(F.broadcast(sizes), ["fit", "topic"])  # one row a topic
    out = out.withColumn("weight", F.col("n") / F.col("words") * F.log1p(F.col("a") / F.col("f")))
    place = F.row_number().over(Window.partitionBy("fit", "topic").orderBy(F.desc(F.round("weight", 12)), "term"))
    return out.withColumn("rank", place).where(F.col("rank") <= n).select("fit", "topic", "term", "n", "weight", "rank")


def choose_topic_count(df: DataFrame, key: str, vector: str, words: Column, sizes: list[int], least: int = LEAST_TOPICS, seed: int = 7, dimensions: int | None = None, texts: DataFrame | None = None) -> DataFrame:
    """One row a candidate size: topics, silhouette, diversity, outlier_rate, size_cv, score and
    recommended (the best score of those with at least ``least`` topics; ties to fewer topics). Each
    candidate is one fit and three aggregates over all rows; what comes to the driver is its figures. The words of
    all candidates are counted together; they are df's, or those that ``texts`` has by the key."""
    from pyspark.ml.evaluation import ClusteringEvaluator

    models = [topic_fit(df, key, vector, k, seed, dimensions) for k in sizes]
    every = written(top_words(models, df, key, vector, words, 2, 10, texts), "top-words")
    found = []
    for i, (k, model) in enumerate(zip(sizes, models, strict=True)):
        fitted = assigned_by(model, df, key, vector)
        quality = topic_quality(fitted, every.where(F.col("fit") == i)).first()
        several = quality.topics > 1
        silhouette = ClusteringEvaluator(predictionCol="topic", featuresCol="features").evaluate(fitted) if several else 0.0
        figures = (float(silhouette), float(quality.diversity or 0.0), float(quality.outlier_rate), float(quality.size_cv or 0.0))
        found.append((k, quality.topics, *figures, fit_score(*figures)))
    able = [f for f in found if f[1] >= least]
    if not able:
        raise ValueError(f"no candidate gives {least} topics or more")
    best = max(able, key=lambda f: (f[-1], -f[1], -f[0]))
    names = "size int, topics long, silhouette double, diversity double, outlier_rate double, size_cv double, score double, recommended boolean"
    return df.sparkSession.createDataFrame([(*f, f is best) for f in found], names)


def merge_sequence(centres: dict[int, np.ndarray], sizes: dict[int, int]) -> list[tuple[int, float, int, int]]:
    """(topics left, cosine distance, kept, merged) for each merge of the two closest topics, the centre of both
    being the mean by their sizes; ties go to the smaller topics. Topics are few, so this runs on the driver."""
    unit = lambda v: v / (np.sqrt((v * v).sum()) or 1.0)
    centres, sizes, out = {t: np.asarray(c, float) for t, c in sorted(centres.items())}, dict(sizes), []
    while len(centres) > 1:
        names = sorted(centres)
        m = np.stack([unit(centres[t]) for t in names])
        apart = np.round(1 - m @ m.T, 12)
        apart[np.tril_indices(len(names))] = np.inf
        i, j = np.unravel_index(apart.argmin(), apart.shape)
        a, b = names[i], names[j]
        total = sizes[a] + sizes[b]
        centres[a] = (centres[a] * sizes[a] + centres.pop(b) * sizes[b]) / total
        sizes[a] = total
        sizes.pop(b)
        out.append((len(centres), float(apart[i, j]), a, b))
    return out


def reduced_topics(fitted: DataFrame, least: int = 10, most: int = 100) -> DataFrame:
    """fit_topics()'s rows with reduced_topic: topics merged until the count before the largest jump of
    merge distance, among counts from ``least`` to ``most``; without such a count none are merged. Only
    the topics' centres and sizes, as many as topics, come to the driver."""
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.stat import Summarizer

    means = fitted.groupBy("topic").agg(Summarizer.mean(F.col("features")).alias("m"), F.count("*").alias("n")).select("topic", vector_to_array("m").alias("m"), "n").collect()
    merges = merge_sequence({r.topic: np.array(r.m) for r in means}, {r.topic: r.n for r in means})
    able = [(n, apart) for n, apart, _, _ in merges if least <= n <= most]
    target = len(means)
    if able:
        jumps = [b[1] - a[1] for a, b in zip(able, able[1:], strict=False)]
        target = able[int(np.argmax(jumps))][0] if jumps else able[0][0]
    into = {r.topic: r.topic for r in means}
    for n, _, kept, merged in merges:
        if n >= target:
            into = {t: kept if now == merged else now for t, now in into.items()}
    pairs = fitted.sparkSession.createDataFrame(sorted(into.items()), "topic int, reduced_topic int")
    return fitted.join(F.broadcast(pairs), "topic")  # one row a topic


def topic_quality(assigned: DataFrame, weights: DataFrame, top: int = 10) -> DataFrame:
    """One row: topics, outlier_rate, size_cv (population deviation over mean) and diversity (share of
    different words among the topics' top words)."""
    sizes = assigned.where("topic IS NOT NULL AND topic >= 0").groupBy("topic").agg(F.count("*").alias("n"))
    a = sizes.agg(F.count("*").alias("topics"), (F.stddev_pop("n") / F.avg("n")).alias("size_cv")).withColumn("k", F.lit(1))
    b = assigned.agg(F.avg((F.col("topic").isNull() | (F.col("topic") < 0)).cast("double")).alias("outlier_rate")).withColumn("k", F.lit(1))
    c = weights.where(F.col("rank") <= top).agg((F.count_distinct("term") / F.count("*")).alias("diversity")).withColumn("k", F.lit(1))
    return a.join(F.broadcast(b), "k").join(F.broadcast(c), "k").drop("k")  # one row each
