"""Single records and their tables: lookups, enrichment, checks, labels, progress, alignment."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, clean_or_null, number, share, split_list
from papyrion.operators.raters import counted


def connected(df: DataFrame, value: str, exact: list[str] = (), lists: list[str] = ()) -> DataFrame:
    """Rows whose exact columns equal a value, or whose list columns contain it in any case, as plain
    text and not as a pattern."""
    tests = [clean(F.col(c)) == value for c in exact] + [F.contains(F.lower(F.coalesce(F.col(c), F.lit(""))), F.lit(value.lower())) for c in lists]
    return df.where(reduce(lambda a, b: a | b, tests)) if tests else df.limit(0)


def enriched(df: DataFrame, mechanism: str, logic: str, problems: str, box: str = "black box") -> DataFrame:
    """df with mechanism_raw (as it was), the mechanism as "mechanism missing" where its logic is empty,
    problem_count, and is_box: whether the unstripped ";" list holds exactly ``box``."""
    out = df.withColumn("mechanism_raw", F.col(mechanism))
    out = out.withColumn(mechanism, F.when(clean(F.col(logic)) == "", F.lit("mechanism missing")).otherwise(F.col(mechanism)))
    return out.withColumn("problem_count", F.size(split_list(F.col(problems)))).withColumn("is_box", F.array_contains(F.split(F.coalesce(F.col(problems), F.lit("")), ";", -1), box))


def payload_faults(df: DataFrame, dimensions: dict[str, list[str]], kinds: list[str]) -> DataFrame:
    """df with faults (array): for each dimension a code outside its list, an unknown evidence type, a
    confidence outside 0..1 or none, and evidence missing though the type is not "absent"."""
    tests = []
    for d, codes in dimensions.items():
        code, kind, confidence = clean(F.col(d)), clean(F.col(f"{d}_evidence_type")), number(F.col(f"{d}_confidence"))
        tests += [
            F.when(~code.isin(*codes), F.lit(f"{d}: code")),
            F.when(~kind.isin(*kinds), F.lit(f"{d}: evidence type")),
            F.when(~F.coalesce(confidence.between(0, 1), F.lit(False)), F.lit(f"{d}: confidence")),
            F.when((kind != "absent") & (clean(F.col(f"{d}_evidence")) == ""), F.lit(f"{d}: evidence")),
        ]
    return df.withColumn("faults", F.filter(F.array(*tests), lambda x: x.isNotNull()))


def inspection(df: DataFrame, key: str, dimensions: list[str], selected: dict[str, str]) -> DataFrame:
    """(key, dimensions): each record's codes as an array of structs (dimension, value, selected)."""
    cells = [F.struct(F.lit(d).alias("dimension"), clean(F.col(d)).alias("value"), (F.lit(d in selected) & (clean(F.col(d)) == selected.get(d, ""))).alias("selected")) for d in dimensions]
    return df.select(key, F.array(*cells).alias("dimensions"))


def overlaid(df: DataFrame, labels: DataFrame, keys: list[str], automatic: str) -> DataFrame:
    """df with label: the approved one of its keys if there is one that is not blank, else the
    automatic one."""
    approved = labels.select(*keys, clean_or_null(F.col("approved")).alias("approved"))
    return df.join(approved, keys, "left").withColumn("label", F.coalesce("approved", automatic)).drop("approved")


def aligned(left: DataFrame, right: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Two raters' rows side by side, columns prefixed left__ and right__."""
    side = lambda df, p: df.select(key, *[F.col(c).alias(f"{p}__{c}") for c in columns])
    return side(left, "left").join(side(right, "right"), key)


def combined(master: DataFrame, rated: DataFrame, checks: DataFrame, key: str) -> DataFrame:
    """master with a rater's columns in place of its own of the same names, and the check columns
    prefixed qc_; rows that a side lacks keep nulls there."""
    own = [c for c in rated.columns if c != key]
    qc = checks.select(key, *[F.col(c).alias(f"qc_{c}") for c in checks.columns if c != key])
    return master.drop(*own).join(rated, key, "left").join(qc, key, "left")


def in_all(frames: list[DataFrame], key: str) -> DataFrame:
    """The ids that every frame holds, counted in one shuffle."""
    rows = reduce(DataFrame.unionAll, [f.select(F.col(key).alias("id"), F.lit(i).alias("frame")) for i, f in enumerate(frames)])
    return rows.groupBy("id").agg(F.count_distinct("frame").alias("n")).where(F.col("n") == len(frames)).select("id")


def in_order(df: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """df's rows for the wanted (key, position), with position; ids that df lacks have no row."""
    return df.join(wanted.select(key, "position"), key)


def review_progress(reviews: DataFrame, scope: str, status: str, done: str = "approved") -> DataFrame:
    """Per scope: topics, those done, complete."""
    out = reviews.groupBy(F.col(scope).alias("scope")).agg(F.count("*").alias("topics"), F.count(F.when(F.col(status) == done, 1)).alias("done"))
    return out.withColumn("complete", F.col("topics") == F.col("done"))


def missing_numbers(df: DataFrame, scope: str, number_column: str) -> DataFrame:
    """(scope, missing): the numbers from 0 to a scope's largest that it lacks, from its own numbers'
    gaps, without a list of all."""
    rows = df.select(F.col(scope).alias("scope"), F.col(number_column).cast("long").alias("n")).where("n >= 0").distinct()
    before = F.coalesce(F.lag("n").over(Window.partitionBy("scope").orderBy("n")), F.lit(-1))
    gaps = rows.withColumn("before", before).where("n - before > 1")
    return gaps.select("scope", F.explode(F.sequence(F.col("before") + 1, F.col("n") - 1)).alias("missing"))


def rater_progress(ratings: DataFrame, sample: int, dimensions: int) -> DataFrame:
    """Per rater: units started, units completed (all dimensions rated) and their share of the sample."""
    units = counted(ratings).where("value IS NOT NULL").groupBy("rater", "unit").agg(F.count_distinct("dimension").alias("d"), F.max("n").alias("n"))
    out = units.groupBy("rater").agg(F.sum("n").alias("started"), F.coalesce(F.sum(F.when(F.col("d") >= dimensions, F.col("n"))), F.lit(0)).alias("completed"))
    return out.withColumn("share", share(F.col("completed"), F.lit(sample)))


def selection_diagnostics(df: DataFrame, text: str, year: str, flags: dict[str, Column]) -> DataFrame:
    """One row: papers, mean words, median year and the share of each flag."""
    words = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(r"\S+"))
    return df.agg(F.count("*").alias("papers"), F.avg(words).alias("mean_words"), F.median(year).alias("median_year"), *[F.avg(f.cast("double")).alias(n) for n, f in flags.items()])


def listed_ids(df: DataFrame, column: str, key: str, n: int) -> DataFrame:
    """(value, papers, ids): each value's count and its first n ids as a ";" list."""
    ranked = df.select(clean(F.col(column)).alias("value"), key).withColumn("r", F.row_number().over(Window.partitionBy("value").orderBy(key)))
    ids = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("r") <= n, F.col(key)))), lambda x: x.cast("string")), ";")
    return ranked.groupBy("value").agg(F.count("*").alias("papers"), ids.alias("ids"))


def assigned_above(papers: DataFrame, left: DataFrame, right: DataFrame, key: str, topic: str, least: int) -> DataFrame:
    """Per topic: papers whose total counts of both term families reach ``least``, and the mean of
    each family's counts among them. left and right: key, n."""
    total = lambda df, name: df.groupBy(key).agg(F.sum("n").alias(name))
    rows = papers.join(total(left, "left_n"), key, "left").join(total(right, "right_n"), key, "left").fillna(0, ["left_n", "right_n"])
    kept = rows.where((F.col("left_n") >= least) & (F.col("right_n") >= least))
    return kept.groupBy(F.col(topic).alias("topic")).agg(F.count("*").alias("papers"), F.avg("left_n").alias("left_mean"), F.avg("right_n").alias("right_mean"))


def rater_registry(ratings: DataFrame, cohort: list[str], minimum: dict[str, int]) -> DataFrame:
    """Per rater: units coded, their share of all units, and whether agreement statistics admit it: raters of
    the fixed cohort always, others from their own minimum of coded units on."""
    units = ratings.where("value IS NOT NULL").select("rater", "unit").distinct()
    coded = units.groupBy("rater").agg(F.count("*").alias("coded"))
    total = ratings.agg(F.count_distinct("unit")).first()[0]
    least = F.coalesce(*[F.when(F.col("rater") == r, F.lit(n)) for r, n in minimum.items()], F.lit(None).cast("int"))
    eligible = F.col("rater").isin(cohort) | F.coalesce(F.col("coded") >= least, F.lit(False))
    return coded.select("rater", "coded", share(F.col("coded"), F.lit(total)).alias("coverage"), eligible.alias("eligible"))


def rater_frame(corpus: DataFrame, rater: DataFrame, key: str) -> DataFrame:
    """The corpus as a rater coded it: every column that the rater supplies is the rater's, never the
    corpus's, and only coded rows stay. A key that the rater has twice is an error."""
    once = rater.withColumn("_n", F.count("*").over(Window.partitionBy(key)))
    once = once.withColumn(key, F.when(F.col("_n") == 1, F.col(key)).otherwise(F.raise_error(F.lit("a rater has a key twice")).cast(rater.schema[key].dataType))).drop("_n")
    return corpus.drop(*[c for c in rater.columns if c != key]).join(once, key)


def targeted_reading(frame: DataFrame, sample: DataFrame, key: str, order: str) -> DataFrame:
    """frame's rows of a sample, with the sample's columns (those that frame has too end in _prior) and sample_order."""
    names = [F.col(order).alias("sample_order"), *[F.col(c).alias(f"{c}_prior" if c in frame.columns else c) for c in sample.columns if c not in (key, order)]]
    return frame.join(sample.select(key, *names), key)


def relation_evidence(reading: DataFrame, primary: DataFrame, raters: dict[str, DataFrame], key: str) -> DataFrame:
    """reading with the primary coding of its rows, and each rater's columns where it has the row, named after it."""
    out = reading.join(primary, key)
    for name, rows in raters.items():
        out = out.join(rows.select(key, *[F.col(c).alias(f"{name}__{c}") for c in rows.columns if c != key]), key, "left")
    return out


def review_faults(review: DataFrame, expected: DataFrame, statuses: list[str]) -> DataFrame:
    """(fault, scope, topic): what keeps a label review from being complete. expected has (scope, topics):
    each scope's topics must be 0 to topics - 1, once each, with a known status and, if approved, a
    label. A review without faults gives no rows."""
    rows = review.select("scope", F.col("topic").cast("int").alias("topic"), "status", clean_or_null(F.col("approved")).alias("approved"))
    wanted = expected.select("scope", F.explode(F.sequence(F.lit(0), F.col("topics").cast("int") - 1)).alias("topic"))
    counts = rows.groupBy("scope", "topic").agg(F.count("*").alias("n"))
    fault = lambda df, name: df.select(F.lit(name).alias("fault"), "scope", "topic")
    return reduce(DataFrame.unionByName, [
        fault(counts.where("n > 1"), "duplicate"),
        fault(wanted.join(counts, ["scope", "topic"], "left_anti"), "missing"),
        fault(counts.join(wanted, ["scope", "topic"], "left_anti"), "not expected"),
        fault(rows.where(~F.coalesce(F.col("status").isin(statuses), F.lit(False))), "status"),
        fault(rows.where("status = 'approved' AND approved IS NULL"), "approved without label"),
    ])


def gated(review: DataFrame, automatic: str = "automatic") -> DataFrame:
    """review with label: the approved labels of scopes whose every topic is approved and named, else
    the automatic ones."""
    named = F.coalesce((F.col("status") == "approved") & clean_or_null(F.col("approved")).isNotNull(), F.lit(False))
    complete = review.groupBy("scope").agg(F.every(named).alias("complete"))
    return review.join(complete, "scope").withColumn("label", F.when(F.col("complete"), clean_or_null(F.col("approved"))).otherwise(F.col(automatic)))
