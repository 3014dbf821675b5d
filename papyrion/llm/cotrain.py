"""Quality classifier by co-training.

Two logistic regressions see a document by different views: one its content (words, beginnings of
words and shares of kinds of characters), the other the page's metadata (source, language, length and layout: lines, words and
their lengths, punctuation, repeats). Over a few rounds each labels the pool documents that it is
surest of, by rank within each class, and those join the other's training rows, unless the other
itself takes them for the opposite. Each view is then calibrated on held-out labels, and the
calibrated views are combined, on other held-out labels, into one score for every document.

What is fitted to is bounded: at most FIT_ROWS labelled rows and POOL_ROWS unlabelled ones, both
chosen by the hash of their ids from the whole table, and a vocabulary of at most TERMS terms of
those; the list of ids, the vocabulary and the models are all that is broadcast. Text weights are
sparse (an L1 penalty), since most words say nothing of quality. The pool's margins, two numbers a
row, are ranked on the driver, at most POOL_ROWS of them.
Features, fits and scores are Spark ML's, and all documents are scored in one pass without a
shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import CountVectorizerModel, FeatureHasher, VectorAssembler, VectorSizeHint
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.llm.shared import let, stored

#: Bounds of what is fitted to.
FIT_ROWS, POOL_ROWS = 20000, 20000
#: One in so many labelled rows is held out for calibration, and one for the combination.
HELD = 10
#: Rounds, and the rows that a view hands the other in each, good and bad ones as they are among the labelled rows.
ROUNDS, HANDED = 2, 500
#: Most terms of the vocabulary, the labelled rows that a term must be in, and how long beginnings of words are.
TERMS, TERM_ROWS, BEGINS = 4096, 10, (5, 7)
#: Weights of the penalties of the two views; the text's is L1, the metadata's L2.
SPARSE, RIDGE = 2e-3, 1e-2
KEEP_AT = 0.8


#: Numbers in the two arrays of figures.
N_STYLE, N_LAYOUT = 6, 9


def _joined(df: DataFrame, first: str, figures: str, n: int, out: str) -> DataFrame:
    """df with two vectors as one; the hint spares Spark a look at the rows for the length."""
    hinted = VectorSizeHint(inputCol=figures, size=n, handleInvalid="optimistic").transform(df)
    return VectorAssembler(inputCols=[first, figures], outputCol=out).transform(hinted)


def featured(docs: DataFrame, text_col: str, source_col: str, lang_col: str) -> DataFrame:
    """docs with what the two views' vectors are made of: _terms (words, and the beginnings of longer
    ones), _style and _meta_view. Null texts count as empty, null sources and languages as a value of
    their own."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    chars = F.greatest(F.char_length(text), F.lit(1))
    often = lambda pattern, whole: F.log1p(100.0 * F.regexp_count(text, F.lit(pattern)) / whole)

    def style(words: Column) -> Column:
        again = often(r"(?<![\p{L}\p{N}])([\p{L}\p{N}]++) (?=\1(?![\p{L}\p{N}]))", F.greatest(F.size(words), F.lit(1)))
        return F.array(often(r"\p{Lu}", chars), often(r"\p{N}", chars), often(r"[#*$%&<>]", chars), often(r"\|", chars), often("!", chars), again)

    def layout(words: Column, lines: Column) -> Column:
        n_words, n_lines = F.greatest(F.size(words), F.lit(1)), F.greatest(F.size(lines), F.lit(1))
        log = lambda x: F.log1p(x.cast("double"))
        return F.array(
            log(chars), log(F.size(words)), log(F.size(lines)), log(chars / n_lines), log(chars / n_words), log(F.array_max(F.transform(lines, F.char_length))),
            often(r"[.,;:?!]", n_words), F.size(F.array_distinct(lines)) / n_lines, F.size(F.array_distinct(words)) / n_words,
        )

    def parts(words: Column) -> Column:
        begins = [F.transform(F.filter(words, lambda x: F.char_length(x) > n), lambda x: F.concat(F.substring(x, 1, n), F.lit("-"))) for n in BEGINS]  # noqa: B023
        lines = F.filter(F.split(text, "\n", -1), lambda x: x != "")
        # The empty term is in every text, so that every text has one of the vocabulary.
        terms = F.concat(F.array(F.lit("")), words, *begins)
        whole = lambda x: F.transform(x, lambda v: F.coalesce(v, F.lit(0.0)))
        return F.struct(terms.alias("terms"), style(words).alias("style"), let(lines, lambda x: whole(layout(words, x))).alias("layout"))

    words = F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))
    out = docs.withColumn("_f", let(words, parts)).withColumns({"_terms": F.col("_f.terms"), "_style": array_to_vector(F.col("_f.style")), "_layout": array_to_vector(F.col("_f.layout"))}).drop("_f")
    size = F.floor(F.log2(chars)).cast("string")
    out = out.withColumns({"_m_source": F.coalesce(F.col(source_col).cast("string"), F.lit("null")), "_m_lang": F.coalesce(F.col(lang_col).cast("string"), F.lit("null")), "_m_size": size})
    out = FeatureHasher(inputCols=["_m_source", "_m_lang", "_m_size"], outputCol="_m_names", numFeatures=1 << 11).transform(out)
    out = _joined(out, "_m_names", "_layout", N_LAYOUT, "_meta_view")
    return out.drop("_m_source", "_m_lang", "_m_size", "_m_names", "_layout")


def _vocabulary(rows: DataFrame, bad: int, good: int) -> CountVectorizerModel:
    """The TERMS terms of the labelled rows that tell most of the label, by chi-square."""
    total, n, k = float(bad + good), F.col("n").cast("double"), F.col("k")
    counts = rows.select("label", F.explode(F.array_distinct("_terms")).alias("term")).groupBy("term").agg(F.count("*").alias("n"), F.sum("label").alias("k"))
    tells = (k * total - n * good) ** 2 / (n * (total - n))
    best = counts.where((n >= TERM_ROWS) & (n < total)).orderBy(tells.desc(), "term").limit(TERMS).select("term").collect()
    return CountVectorizerModel.from_vocabulary(["", *[r.term for r in best]], inputCol="_terms", outputCol="_counts", binary=True)


def _with_text_view(df: DataFrame, vocabulary: CountVectorizerModel) -> DataFrame:
    out = _joined(vocabulary.transform(df), "_counts", "_style", N_STYLE, "_text_view")
    return out.drop("_counts", "_style", "_terms")


def _margin(model: LogisticRegressionModel, df: DataFrame, view: str, out: str) -> DataFrame:
    """df with the model's margin (the log-odds it gives the label 1)."""
    scored = model.copy().setFeaturesCol(view).setRawPredictionCol("_raw").setProbabilityCol("").setPredictionCol("").transform(df)
    return scored.withColumn(out, vector_to_array("_raw")[1]).drop("_raw")


@dataclass
class CoTrained:
    """The vocabulary, the two views' models, and the calibrations: score = sigmoid(a + b * text + c * meta + d *
    the smaller one), where text and meta are the views' own calibrated log-odds. The smaller one stands for documents that
    one view alone can fault."""

    vocabulary: CountVectorizerModel | None
    text: LogisticRegressionModel | None
    meta: LogisticRegressionModel | None
    text_line: tuple[float, float] = (0.0, 0.0)
    meta_line: tuple[float, float] = (0.0, 0.0)
    both: tuple[float, float, float, float] = (0.0, 0.0, 0.0, 0.0)
    #: For each round the ids of (good, bad) rows that text handed to meta, and of those that meta handed to text.
    handed_ids: tuple[tuple[tuple, tuple, tuple, tuple], ...] = ()
    #: Rows that all was fitted to.
    fit_rows: int = 0

    @property
    def handed(self) -> tuple[tuple[int, ...], ...]:
        """How many rows were handed over in each round."""
        return tuple(tuple(map(len, moved)) for moved in self.handed_ids)

    def score(self, docs: DataFrame, text_col: str = "text", source_col: str = "source", lang_col: str = "lang") -> DataFrame:
        """docs with text_score, meta_score and score, each in 0..1; all 1 where there was nothing to
        learn a difference from."""
        names = ("text_score", "meta_score", "score")
        plain = docs.drop(*names)
        if self.text is None or self.meta is None:
            return plain.withColumns({c: F.lit(1.0) for c in names})
        # The rows travel as one struct, whatever their columns are called.
        out = plain.select(F.struct("*").alias("row"), F.col(text_col).alias("text"), F.col(source_col).alias("source"), F.col(lang_col).alias("lang"))
        out = _with_text_view(featured(out, "text", "source", "lang"), self.vocabulary)
        out = _margin(self.meta, _margin(self.text, out, "_text_view", "_t"), "_meta_view", "_m")
        t, m = (F.lit(line[0]) + F.lit(line[1]) * F.col(c) for line, c in ((self.text_line, "_t"), (self.meta_line, "_m")))
        both = F.lit(self.both[0]) + F.lit(self.both[1]) * t + F.lit(self.both[2]) * m + F.lit(self.both[3]) * F.least(t, m)
        sigmoid = lambda x: 1 / (1 + F.exp(-x))
        return out.select("row.*", *[sigmoid(x).alias(c) for x, c in zip((t, m, both), names, strict=True)])


def _fit(rows: DataFrame, view: str, penalty: float, sparse: bool = False) -> LogisticRegressionModel:
    """A logistic fit with an L2 penalty, or an L1 penalty if sparse."""
    return LogisticRegression(featuresCol=view, labelCol="label", maxIter=20, tol=1e-4, regParam=penalty, elasticNetParam=float(sparse)).fit(rows.select(view, "label"))


def surest(giver: np.ndarray, taker: np.ndarray, ids: np.ndarray, free: np.ndarray, n_good: int, n_bad: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pool rows that a view hands over as good and as bad: of those that are free and that
    neither view puts in the other class, the n_good and n_bad with the giver's largest margins; ties
    go to the smaller id. A view puts into a class its share of the pool, as n_good to n_bad."""
    if not len(ids):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    share, found = n_bad / max(1, n_good + n_bad), []
    above = giver >= np.quantile(giver, share), taker >= np.quantile(taker, share)
    for sign, n in ((1, n_good), (-1, n_bad)):
        fit = np.nonzero(free & (above[0] == (sign > 0)) & (above[1] == (sign > 0)))[0]
        found.append(fit[np.lexsort((ids[fit], -giver[fit] * sign))[:n]])
    return found[0], found[1]


def logistic_line(inputs: np.ndarray, labels: np.ndarray, ridge: float = 1e-3, rounds: int = 50) -> list[float]:
    """Intercept and coefficients of a logistic fit of 0/1 labels to few inputs, by Newton's method
    with steps that are halved until they help."""
    x = np.column_stack([np.ones(len(labels)), inputs])
    penalty = ridge * len(labels) * np.diag([0.0] + [1.0] * (x.shape[1] - 1))
    loss = lambda w: np.logaddexp(0, x @ w).sum() - labels @ (x @ w) + w @ penalty @ w / 2
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        step = np.linalg.lstsq(x.T @ (x * (p * (1 - p))[:, None]) + penalty, x.T @ (labels - p) - penalty @ w, rcond=None)[0]
        size = 1.0
        while size > 1e-6 and loss(w + size * step) > loss(w):
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w.tolist()


def train(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang",
    fit_rows: int = FIT_ROWS, pool_rows: int = POOL_ROWS, rounds: int = ROUNDS, handed: int = HANDED,
) -> CoTrained:
    """Co-trains on labels (id_col, label 0 or 1): at most ``fit_rows`` labelled and ``pool_rows``
    other documents, of which each view hands the other ``handed`` in each round. Null labels and ids
    count as none; of several labels of an id the smallest holds, and of several rows of an id one. Without both classes in each part
    of the labels there is nothing to learn, and every document will score 1."""
    known = labels.where(F.col(id_col).isNotNull() & F.col("label").isNotNull()).groupBy(id_col).agg(F.min("label").cast("double").alias("label"))
    by_hash = F.xxhash64(id_col)
    # By turns within each class, in the order of another hash, so that few labels still give each part of both;
    # the window sees fit_rows rows at most.
    part = (F.row_number().over(Window.partitionBy("label").orderBy(F.xxhash64(F.lit("held"), id_col), id_col)) - 1) % HELD
    role = F.when(part == 0, "calibrate").when(part == 1, "combine").otherwise("train")
    chosen = known.orderBy(by_hash, id_col).limit(fit_rows).withColumn("role", role)
    ids = docs.select(id_col).where(F.col(id_col).isNotNull())
    share = min(1.0, 2 * pool_rows / max(1, ids.agg(F.approx_count_distinct(id_col)).first()[0]))
    pool = ids.where(F.pmod(by_hash, F.lit(1 << 20)) < int(share * (1 << 20)) + 1).join(known, id_col, "left_anti").distinct()
    pool = pool.orderBy(by_hash, id_col).limit(pool_rows).select(id_col, F.lit(None).cast("double").alias("label"), F.lit("pool").alias("role"))
    chosen = stored(chosen.unionByName(pool), "cotrain-ids")
    # Bounded by fit_rows + pool_rows: small enough to send to every task.
    rows = docs.select(id_col, text_col, source_col, lang_col).join(F.broadcast(chosen), id_col)
    # However many rows repeat an id, one of them takes part: that of the smallest hashes of text, source and language.
    columns = (text_col, source_col, lang_col)
    one = F.min(F.struct(*[F.xxhash64(c).alias(f"h{i}") for i, c in enumerate(columns)], *[F.col(c).alias(f"c{i}") for i, c in enumerate(columns)])).alias("one")
    rows = rows.groupBy(id_col, "label", "role").agg(one).select(id_col, "label", "role", *[F.col(f"one.c{i}").alias(c) for i, c in enumerate(columns)])
    rows = featured(rows, text_col, source_col, lang_col).select(id_col, F.xxhash64(text_col).alias("t"), "label", "role", "_terms", "_style", "_meta_view")
    rows = stored(rows, "cotrain-rows").coalesce(8)
    found = {(r.role, r.label): r.n for r in rows.groupBy("role", "label").agg(F.count("*").alias("n")).collect()}
    if not all(found.get((role, label)) for role in ("train", "calibrate", "combine") for label in (0.0, 1.0)):
        return CoTrained(None, None, None)
    good, bad = found["train", 1.0], found["train", 0.0]
    vocabulary = _vocabulary(rows.where("role = 'train'"), bad, good)
    rows = stored(_with_text_view(rows, vocabulary), "cotrain-views").coalesce(2).persist()
    labelled, pool = rows.where("role = 'train'"), rows.where("role = 'pool'")
    n_good = round(handed * good / (good + bad))

    def margins(of: DataFrame) -> list:
        """Two margins of each row, of at most fit_rows or pool_rows: few enough for the driver."""
        found = _margin(meta, _margin(text, of, "_text_view", "_t"), "_meta_view", "_m").select(id_col, "t", "role", "label", "_t", "_m").collect()
        return sorted(found, key=lambda r: (r[id_col], r.t))

    def with_handed(labels: dict) -> DataFrame:
        """The labelled rows and those of the pool that were handed over, with their new labels."""
        if not labels:
            return labelled
        new = rows.sparkSession.createDataFrame([(*key, label) for key, label in labels.items()], pool.select(id_col, "t", F.lit(0.0).alias("label")).schema)
        return labelled.unionByName(pool.drop("label").join(F.broadcast(new), [id_col, "t"]).select(*rows.columns))

    given: dict[str, dict] = {"_t": {}, "_m": {}}  # what each view has given: (id, text's hash) -> label
    counts = []
    text, meta = _fit(labelled, "_text_view", SPARSE, sparse=True), _fit(labelled, "_meta_view", RIDGE)
    for _ in range(rounds):
        scored = margins(pool)
        keys = [(r[id_col], r.t) for r in scored]
        t, m, place = np.array([r._t for r in scored]), np.array([r._m for r in scored]), np.arange(len(scored))
        moved = []
        for giver, taker, name in ((t, m, "_t"), (m, t, "_m")):
            free = np.array([k not in given[name] for k in keys], bool)
            for label, places in zip((1.0, 0.0), surest(giver, taker, place, free, n_good, handed - n_good), strict=True):
                given[name] |= {keys[i]: label for i in places.tolist()}
                moved.append(tuple(keys[i][0] for i in places.tolist()))
        counts.append(tuple(moved))
        # A view whose training rows are the same keeps its model.
        if moved[2] or moved[3]:
            text = _fit(with_handed(given["_m"]), "_text_view", SPARSE, sparse=True)
        if moved[0] or moved[1]:
            meta = _fit(with_handed(given["_t"]), "_meta_view", RIDGE)
        if not any(moved):
            break
    held = margins(rows.where("role IN ('calibrate', 'combine')"))
    rows.unpersist()
    arrays = lambda role: np.array([(r.label, r._t, r._m) for r in held if r.role == role]).T
    label, t, m = arrays("calibrate")
    (a, b), (c, d) = logistic_line(t, label), logistic_line(m, label)
    label, t, m = arrays("combine")
    t, m = a + b * t, c + d * m
    both = logistic_line(np.column_stack([t, m, np.minimum(t, m)]), label)
    return CoTrained(vocabulary, text, meta, (a, b), (c, d), tuple(both), tuple(counts), sum(found.values()))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", lang_col: str = "lang", keep_at: float = KEEP_AT, **bounds) -> DataFrame:
    """Every row of docs with text_score, meta_score, score and kept (score of ``keep_at`` or more).

    Repeated rows are scored each for itself; null and empty texts are scored by what their
    metadata and emptiness say. Columns of the added names are replaced, all others stay. An empty
    table gives no rows.
    """
    model = train(docs, labels, id_col, text_col, source_col, lang_col, **bounds)
    return model.score(docs.drop("kept"), text_col, source_col, lang_col).withColumn("kept", F.col("score") >= keep_at)


def clean_labels(labels: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """The label table's quality and toxic as one label: 1 for good documents that are not toxic."""
    good = (F.col("quality") == 1) & (F.coalesce(F.col("toxic"), F.lit(0)) == 0)
    return labels.select(id_col, F.when(F.col("quality").isNotNull(), good.cast("double")).alias("label"))
