"""Tables that a job writes for itself, so that later steps read what earlier ones settled."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The shared folder that spark.checkpoint.dir names. Where that is unset, a local master (as in tests)
    gets a temporary folder as it, any other an error."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="papyrion-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used yet."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The rows of df, written once in the shared folder, and read back."""
    spark, path = df.sparkSession, new_path(df.sparkSession, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Rows that one task of a spread() table holds, about.
ROWS_A_TASK = 500_000


def spread(df: DataFrame, keys: list[str], rows: int) -> DataFrame:
    """df dealt by keys to as many partitions as ``rows``, the number that it grows with, asks for, so that
    what a task holds does not grow with the table. Later steps by the same keys stay in these partitions."""
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // ROWS_A_TASK)), *keys)
