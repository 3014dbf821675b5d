"""A training-data pipeline over ``documents``: rules, classifier, near-dedup, mixing, tokens.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and
read again as the next one's docs. All but the last return the columns of documents. Stages work
on all rows they get, whatever other columns those have; null texts count as empty throughout, and
an empty table passes through as one.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.llm import bpe, cotrain, line_rules, mixing, simhash
from papyrion.llm.shared import n_words, stored

#: SQL has no SimHash, no classifier and no BPE; tests hold the stages against brute force instead.
ORACLE_SQL = None


def _packed(docs: DataFrame, *columns, without: str = "") -> DataFrame:
    """docs as one struct column, a column left out if wanted, beside the columns that an operator
    reads, so that no column of docs is taken for one that the operator adds."""
    return docs.select(F.struct(*[c for c in docs.columns if c != without]).alias("packed"), *columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and cross-document line frequency keep, without the lines that
    recur across their source's documents; n_chars is the length of what remains."""
    judged = line_rules.without_removed(line_rules.judge(_packed(docs, "doc_id", "source", "text", without="text")).where("kept"))
    new = {"text": F.col("text")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("text").cast(docs.schema["n_chars"].dataType).alias("n_chars")
    return judged.select(*[new[c] if c in new else F.col("packed")[c].alias(c) for c in docs.columns])


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier takes for good and not toxic."""
    labels = cotrain.clean_labels(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return cotrain.classify(_packed(docs, "doc_id", "text", "source", "lang"), labels).where("kept").select("packed.*")


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each group of near-duplicates (five-word shingles at a
    similarity of 0.8 or more); of rows that repeat its id the one with the smallest text. Rows with
    a null id can't be named by a group and stay."""
    found = stored(simhash.similar(docs), "pipeline-groups")
    stay = found.where("doc_id = component_id").select("doc_id").distinct()
    once = F.row_number().over(Window.partitionBy("doc_id").orderBy("text"))
    rows = docs.join(stay, "doc_id", "left_semi").select(F.struct(*docs.columns).alias("packed"), once.alias("once"))
    return rows.where("once = 1").select("packed.*").unionByName(docs.where("doc_id IS NULL"))


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target weights, each document as often as it is taken."""
    sized = _packed(docs, "doc_id", "source", n_words(F.col("text")).alias("size"))
    return mixing.repeated(mixing.mix(sized)).select("packed.*")


def bpe_encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's ids (little-endian unsigned 32-bit integers) in place of its text."""
    encoded = bpe.encode(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return encoded.withColumn("n_tokens", bpe.n_ids(F.col("ids"))).drop("text")


STAGES = [
    ("quality_rules", quality_rules),
    ("quality_classifier", quality_classifier),
    ("simhash_near_dedup", simhash_near_dedup),
    ("source_mix", source_mix),
    ("bpe_encode", bpe_encode),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
