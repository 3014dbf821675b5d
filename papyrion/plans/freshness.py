"""Stored frames that know whether the files they come from have changed since."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = "path string, modificationTime timestamp, length long"


def files(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of the files at a path or below it, none if it does not exist.
    Contents are not read: the scan's columns are the listing's."""
    try:
        return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "modificationTime", "length")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], _SCHEMA)


def signature(spark: SparkSession, paths: list[str]) -> str:
    """What tells one state of input files from another: their number, bytes, and 128 bits that every file's
    path, time and length goes into. The listing is folded by an aggregate, so it may be of any length.
    An input that does not exist is part of the state, too."""
    listing = spark.createDataFrame([], _SCHEMA)
    for p in paths:
        listing = listing.unionByName(files(spark, p))
    mixed = [F.bit_xor(F.xxhash64(F.lit(salt), "path", F.unix_micros("modificationTime"), "length")) for salt in ("one", "two")]
    r = listing.distinct().agg(F.count("*").alias("n"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"), *[F.coalesce(m, F.lit(0)).alias(f"m{i}") for i, m in enumerate(mixed)]).first()
    return f"{r.n}-{r.bytes}-{r.m0 & (1 << 64) - 1:016x}{r.m1 & (1 << 64) - 1:016x}"


def status(spark: SparkSession, target: str, reference: str) -> str:
    """"missing" if the target has no files, "stale" if a file of the reference is newer than all of the
    target's, else "current". A reference that does not exist makes nothing stale."""
    newest = lambda p: files(spark, p).agg(F.max("modificationTime")).first()[0]
    own, other = newest(target), newest(reference)
    if own is None:
        return "missing"
    return "stale" if other is not None and other > own else "current"


class FrameStore:
    """Frames that were built from files, kept in a shared folder under their inputs' signature.

    Rows are written under a name that no other writer has. They count from the moment that an empty marker
    names them, which is set only after the inputs were found unchanged: a writer that breaks off, two at
    once, or inputs that change meanwhile leave no half or mixed frame. Of several frames of one signature
    readers take the first by name. Those of earlier signatures stay. The name stands for the plan: a plan
    that changes takes a new name.
    """

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _at(self, path: str):
        """A path and its file system, as Hadoop has them."""
        found = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        return found, found.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def _whole(self, name: str, state: str) -> list[str]:
        path, system = self._at(f"{self.folder}/{name}/states/{state}/*")
        return sorted(s.getPath().getName() for s in system.globStatus(path) or [])

    def status(self, name: str, inputs: list[str]) -> str:
        """"current" if the frame of the inputs as they are is stored, "stale" if only one of an earlier state
        is, else "missing"."""
        if self._whole(name, signature(self.spark, inputs)):
            return "current"
        return "stale" if self._whole(name, "*") else "missing"

    def frame(self, name: str, inputs: list[str], build: Callable[[], DataFrame]) -> DataFrame:
        """The stored frame of the inputs as they are; where there is none, build()'s rows are stored first. If
        the inputs change while they are read, the frame is built again; after three times it is an error."""
        for _ in range(3):
            state = signature(self.spark, inputs)
            if not self._whole(name, state):
                own = uuid.uuid4().hex
                build().write.parquet(f"{self.folder}/{name}/data/{own}")
                if signature(self.spark, inputs) != state:
                    continue
                marker, system = self._at(f"{self.folder}/{name}/states/{state}/{own}")
                system.create(marker).close()
            return self.spark.read.parquet(f"{self.folder}/{name}/data/{self._whole(name, state)[0]}")
        raise RuntimeError(f"the inputs of {name} keep changing")
