"""Topic runs on disk: a fit, its assignments and its term counts, read back and applied without a fit."""

from __future__ import annotations

import json

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.operators.records import assigned_above
from papyrion.operators.topics import assigned_by, topic_fit


def save_run(df: DataFrame, key: str, vector: str, folder: str, k: int, terms: dict[str, DataFrame], seed: int = 7, dimensions: int | None = None) -> None:
    """Fits topics and writes the run to a new folder: the transforms and the model, every row's topic and
    probability, and term counts by family (key, n). The settings come last, so that a run that breaks off
    has none and is never read."""
    model = topic_fit(df, key, vector, k, seed, dimensions)
    model.write().save(f"{folder}/model")
    assigned_by(model, df, key, vector).select(key, "topic", "probability").write.parquet(f"{folder}/assignments")
    for family, counts in terms.items():
        counts.select(key, "n").write.parquet(f"{folder}/terms/{family}")
    settings = {"key": key, "vector": vector, "k": k, "seed": seed, "dimensions": dimensions, "families": sorted(terms)}
    df.sparkSession.createDataFrame([(json.dumps(settings),)], "value string").coalesce(1).write.text(f"{folder}/settings")


def run_settings(spark: SparkSession, folder: str) -> dict:
    return json.loads(spark.read.text(f"{folder}/settings").first().value)


def assignments(spark: SparkSession, folder: str) -> DataFrame:
    """(key, topic, probability) as the run left them."""
    run_settings(spark, folder)
    return spark.read.parquet(f"{folder}/assignments")


def rerun(spark: SparkSession, folder: str, df: DataFrame) -> DataFrame:
    """(key, topic, probability) of rows, new ones too, by the stored fit: no model is fitted, and rows
    that the run had get the same topics again."""
    settings = run_settings(spark, folder)
    model = PipelineModel.load(f"{folder}/model")
    return assigned_by(model, df, settings["key"], settings["vector"]).select(settings["key"], "topic", "probability")


def refiltered(spark: SparkSession, folder: str, left: str, right: str, least: int) -> DataFrame:
    """assigned_above() of a stored run for two families of its terms: other limits need no other run."""
    key = run_settings(spark, folder)["key"]
    counts = lambda family: spark.read.parquet(f"{folder}/terms/{family}")
    return assigned_above(assignments(spark, folder), counts(left), counts(right), key, "topic", least)


def moved(spark: SparkSession, folder: str, df: DataFrame) -> DataFrame:
    """(key, stored_topic, topic) of rows that the stored fit now puts elsewhere, those that either side lacks
    included: none as long as the vectors are those of the run."""
    key = run_settings(spark, folder)["key"]
    before = assignments(spark, folder).select(key, F.col("topic").alias("stored_topic"))
    now = rerun(spark, folder, df).select(key, "topic")
    return before.join(now, key, "full").where(~F.col("stored_topic").eqNullSafe(F.col("topic")))
