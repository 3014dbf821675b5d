"""Resumable ingest of batch results.

Results of coding batches arrive as files in a folder over hours. A file stream takes each file
once: its checkpoint remembers what was read, so a run that is stopped and started again goes on
where it was, and each run ends when it has read what is there. Of several results for one request
the first that is no error is kept, through the same rule for any split of the files into runs. A run
stops early when too many results fail, and what is still open is packed again under a token budget.
"""

from __future__ import annotations

from pyspark.errors import StreamingQueryException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.operators.packing import pack
from papyrion.sources.exports import parse_results

# A run stops once so many results are in and so large a share of them failed.
LEAST_RESULTS, FAILED_SHARE = 20, 0.5


class TooManyFailures(RuntimeError):
    """A run stopped because its results fail."""


def ingest_results(spark: SparkSession, inbox: str, log: str, checkpoint: str) -> None:
    """Appends the parsed lines of the inbox's new files to the log (Parquet), with the file's path."""
    lines = spark.readStream.option("recursiveFileLookup", True).text(inbox).withColumn("file", F.col("_metadata.file_path"))
    stream = parse_results(lines).writeStream.format("parquet").option("path", log).option("checkpointLocation", checkpoint)
    stream.trigger(availableNow=True).start().awaitTermination()


def guarded_ingest(spark: SparkSession, inbox: str, log: str, checkpoint: str, files: int = 16, least: int = LEAST_RESULTS, share: float = FAILED_SHARE) -> tuple[int, int]:
    """ingest_results() that takes ``files`` files at a time and counts as it goes; gives (results, failures)
    of this run. Once at least ``least`` results are in and ``share`` of them failed, it takes no more files
    and raises TooManyFailures: what it has read is in the log, and the next run goes on behind it.

    A batch is the log's folder batch=<number>, written over if it is repeated, so a run that dies within
    one leaves no result twice. The driver holds two counts.
    """
    seen = {"results": 0, "failures": 0}
    tripped = lambda: seen["results"] >= least and seen["failures"] >= share * seen["results"]

    def take(batch: DataFrame, number: int) -> None:
        if tripped():
            raise TooManyFailures
        place = f"{log}/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        counts = batch.sparkSession.read.schema(batch.schema).parquet(place).agg(F.count("*").alias("n"), F.count("error").alias("bad")).first()
        seen["results"] += counts.n
        seen["failures"] += counts.bad

    lines = spark.readStream.option("recursiveFileLookup", True).option("maxFilesPerTrigger", files).text(inbox).withColumn("file", F.col("_metadata.file_path"))
    stream = parse_results(lines).writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        stream.awaitTermination()
    except StreamingQueryException:
        if not tripped():
            raise
    if tripped():
        raise TooManyFailures(f"{seen['failures']} of {seen['results']} results failed")
    return seen["results"], seen["failures"]


def open_requests(requested: DataFrame, log: DataFrame, order: list[str], cost: str, budget: int) -> DataFrame:
    """The requests without a result that is no error, failed ones and those without any alike, with chunk: in
    order they fill a chunk until the next would pass the budget, so that each is one submission."""
    done = log.where("error IS NULL AND custom_id IS NOT NULL").select("custom_id").distinct()
    return pack(requested.join(done, "custom_id", "left_anti"), order, cost, budget)


def accepted(log: DataFrame) -> DataFrame:
    """One row per request: its first result that is no error by file name, else its first error."""
    w = Window.partitionBy("custom_id").orderBy(F.col("error").isNotNull(), "file", "text")
    return log.where("custom_id IS NOT NULL").withColumn("place", F.row_number().over(w)).where("place = 1").drop("place")


def progress(log: DataFrame, requested: DataFrame) -> DataFrame:
    """One row: requested, done, failed and missing requests."""
    state = requested.select("custom_id").distinct().join(accepted(log).select("custom_id", F.lit(1).alias("seen"), "error"), "custom_id", "left")
    count = lambda c: F.count(F.when(c, 1))
    return state.agg(
        F.count("*").alias("requested"), count(F.col("seen").isNotNull() & F.col("error").isNull()).alias("done"),
        count(F.col("error").isNotNull()).alias("failed"), count(F.col("seen").isNull()).alias("missing"),
    )
