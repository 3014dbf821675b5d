"""Merging search exports into one corpus, source validation and lexical relevance."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, clean_or_null, collapse_space


def first_wins(df: DataFrame, key: str, order: list) -> DataFrame:
    """The first row of each key by an explicit order, so a repartition changes nothing."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_place", F.row_number().over(w)).where("_place = 1").drop("_place")


def merge_queries(df: DataFrame, key: str, query: str, order: list, queries: list[str]) -> DataFrame:
    """One row per key: the first by ``order`` (which starts with the query order), a 0/1 flag per
    query (in_<query>), query_sources (";" list) and query_count. A null key or an unknown query is
    an error, raised by the rows themselves."""
    known = F.when(F.col(query).isin(*queries), F.col(query)).otherwise(F.raise_error(F.concat(F.lit("unknown query: "), F.col(query))))
    checked = df.withColumn(query, known).withColumn(key, F.when(F.col(key).isNotNull(), F.col(key)).otherwise(F.raise_error(F.lit("a row has no identifier"))))
    members = checked.groupBy(key).agg(F.array_sort(F.collect_set(query)).alias("_m"))
    out = first_wins(checked, key, order).drop(query).join(members, key)
    flags = [F.array_contains("_m", q).cast("int").alias(f"in_{q}") for q in queries]
    return out.select("*", *flags, F.array_join("_m", ";").alias("query_sources"), F.size("_m").alias("query_count")).drop("_m")


def merge_filling_blanks(df: DataFrame, key: str, order: Column, columns: list[str]) -> DataFrame:
    """One row per key whose every column is the first non-blank value by ``order``: later rows fill
    what earlier ones leave blank."""
    aggs = [F.min_by(clean_or_null(F.col(c)), F.when(clean_or_null(F.col(c)).isNotNull(), order)).alias(c) for c in columns]
    return df.groupBy(key).agg(*aggs, F.min(order).alias("first_seen"))


def validate_titles(df: DataFrame, universe: DataFrame, title: Column, norm) -> DataFrame:
    """df with source_valid (0/1) and matched_title: the universe's title with the same normal form.
    No row is dropped. Of titles with one normal form the smallest is matched."""
    known = universe.select(norm(F.col("title")).alias("_norm"), F.col("title").alias("matched_title")).groupBy("_norm").agg(F.min("matched_title").alias("matched_title"))
    out = df.withColumn("_norm", norm(title)).join(known, "_norm", "left").drop("_norm")
    return out.withColumn("source_valid", F.col("matched_title").isNotNull().cast("int"))


def term_pattern(term: str) -> str:
    """Whole words, any case; * stands for the rest of a word."""
    return r"(?iU)(?<!\w)" + re.escape(term).replace(r"\*", r"\w*").replace(r"\ ", r"\s+") + r"(?!\w)"


def score_relevance(df: DataFrame, text: Column, groups: dict[str, list[str]], venue: Column | None = None) -> DataFrame:
    """df with, for each term group, <group>_count (terms found) and <group>_terms (";" list), and
    strict / broad. Groups are primary, secondary, strong and broad: strict wants a primary term and
    (a strong one, or two secondary ones, or a matching venue); broad also takes a broad term."""
    # A column of its own, which the many terms read: Spark doesn't make what several expressions read anew for each.
    df, body = df.withColumn("_body", collapse_space(text)), F.col("_body")
    for name, terms in groups.items():
        found = F.filter(F.array(*[F.when(body.rlike(term_pattern(t)), F.lit(t)) for t in terms]), lambda x: x.isNotNull())
        df = df.withColumn(f"{name}_terms", F.array_join(found, ";")).withColumn(f"{name}_count", F.size(found))
    count = lambda g: F.col(f"{g}_count") if g in groups else F.lit(0)
    in_venue = venue if venue is not None else F.lit(False)
    core = (count("strong") >= 1) | (count("secondary") >= 2) | in_venue
    strict = (count("primary") >= 1) & core
    return df.drop("_body").withColumn("strict", strict).withColumn("broad", strict | ((count("primary") >= 1) & (count("broad") >= 1)))


def search_text(df: DataFrame, columns: list[str], separator: str = " ") -> Column:
    """The available columns joined, white space collapsed."""
    return collapse_space(F.concat_ws(separator, *[clean_or_null(F.col(c)) for c in columns if c in df.columns]))


def unified_texts(df: DataFrame, columns: list[str], blank: str = "[No abstract available]", min_chars: int = 0) -> DataFrame:
    """df with unified_text: columns joined by ". " with a placeholder as blank, long enough ones only."""
    parts = [F.nullif(clean(F.col(c)), F.lit(blank)) for c in columns]
    joined = F.concat_ws(". ", *[F.nullif(p, F.lit("")) for p in parts])
    return df.withColumn("unified_text", joined).where(F.char_length("unified_text") >= min_chars)


def crosswalk(pairs: DataFrame, official: DataFrame, overrides: DataFrame, norm_title, norm_issn) -> DataFrame:
    """Each corpus (title, issn) pair matched to an official record: exact (title and an identifier)
    before a reviewed override before a suggestion by title or identifier alone (review_required),
    else unresolved. A step counts only if it has one candidate. identifier_conflict: the title's
    only record has other identifiers."""
    p = pairs.select("title", "issn", norm_title(F.col("title")).alias("t"), norm_issn(F.col("issn")).alias("i")).distinct()
    o = official.select("record_id", norm_title(F.col("title")).alias("t"), F.explode(F.array_distinct(F.filter(F.array(norm_issn(F.col("issn")), norm_issn(F.col("eissn"))), lambda x: x != ""))).alias("i")).distinct()
    names = official.select("record_id", norm_title(F.col("title")).alias("t")).distinct()
    one = lambda rows, key, name: rows.groupBy(*key).agg(F.when(F.count_distinct("record_id") == 1, F.min("record_id")).alias(name))
    out = p.join(one(o, ["t", "i"], "exact"), ["t", "i"], "left").join(one(names, ["t"], "by_title"), ["t"], "left").join(one(o, ["i"], "by_issn"), ["i"], "left")
    out = out.join(overrides.select("title", "issn", F.col("record_id").alias("override")), ["title", "issn"], "left")
    status = (
        F.when(F.col("exact").isNotNull(), "exact").when(F.col("override").isNotNull(), "override")
        .when(F.col("by_title").isNotNull(), "title_only").when(F.col("by_issn").isNotNull(), "issn_only").otherwise("unresolved")
    )
    conflict = F.col("exact").isNull() & F.col("by_title").isNotNull() & (F.col("i") != "")
    return out.select("title", "issn", F.coalesce("exact", "override", "by_title", "by_issn").alias("record_id"), status.alias("match"), status.isin("title_only", "issn_only").alias("review_required"), conflict.alias("identifier_conflict"))


def provenance_audit(sample: DataFrame, master: DataFrame, raw: DataFrame, key: str, raw_key: str, fields: list[str]) -> DataFrame:
    """For each sampled id: whether the master has it, how many raw rows it has, which fields agree
    with any raw row, and whether one raw row agrees in all."""
    s = sample.select(key, *[F.col(f).alias(f"s_{f}") for f in fields])
    m = master.select(key, raw_key)
    r = raw.select(raw_key, F.lit(1).alias("hit"), *[F.col(f).alias(f"r_{f}") for f in fields])
    rows = s.join(m, key, "left").withColumn("in_master", F.col(raw_key).isNotNull()).join(r, raw_key, "left")
    agree = {f: F.coalesce(clean(F.col(f"s_{f}")) == clean(F.col(f"r_{f}")), F.lit(False)) for f in fields}
    every = F.col("hit").isNotNull()
    for a in agree.values():
        every = every & a
    return rows.groupBy(key).agg(F.max("in_master").alias("in_master"), F.count("hit").alias("raw_rows"), *[F.max(a).alias(f"{f}_matches") for f, a in agree.items()], F.max(every).alias("all_in_one_row"))
