"""A review store: versioned entries by many writers, conflicts, an audit trail and compaction."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ReviewStore:
    """Entries (keys, fields, expected_version, moment, writer) in a folder that all writers append to.

    A key has version 0 until its first entry. In the order of (moment, writer, entry) an entry is
    accepted if it expected the version that its key then has, and makes the next one; else it is a
    conflict, and stays as a row that says which version it met. Nothing is rewritten: an entry lies in
    the log until a compaction has folded it into a base and its verdict into the audit trail. Both
    count from the moment that the base is whole, so a compaction that breaks off changes nothing, and
    an entry that is appended meanwhile is read as before. The entries of one key meet in one task.
    """

    def __init__(self, spark: SparkSession, folder: str, keys: list[str], fields: str) -> None:
        """fields: the other columns as a schema string, such as "label string, note string"."""
        self.spark, self.folder, self.keys = spark, folder.rstrip("/"), keys
        self.fields = spark.createDataFrame([], fields).schema
        self.names = [*keys, *self.fields.names]

    def append(self, entries: DataFrame) -> None:
        """Adds entries; each gets an id of its own."""
        columns = [F.col(k).cast("string").alias(k) for k in self.keys] + [F.col(f.name).cast(f.dataType).alias(f.name) for f in self.fields]
        own = [F.col("expected_version").cast("long").alias("expected_version"), F.col("moment").cast("timestamp").alias("moment"), F.col("writer").cast("string").alias("writer")]
        entries.select(F.expr("uuid()").alias("entry"), *columns, *own).write.mode("append").parquet(f"{self.folder}/log")

    def _numbers(self, name: str) -> list[int]:
        """The numbers of the parts of the base or the audit trail that are whole."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{name}/*/_SUCCESS")
        found = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).globStatus(path) or []
        return sorted(int(s.getPath().getParent().getName()) for s in found)

    def _schema(self, *more: str) -> str:
        types = [f"{k} string" for k in self.keys] + [f"{f.name} {f.dataType.simpleString()}" for f in self.fields]
        return ", ".join([*more, *types])

    def _entry_schema(self) -> str:
        return self._schema("entry string") + ", expected_version long, moment timestamp, writer string"

    def base(self) -> DataFrame:
        """(keys, fields, version) of the last compaction."""
        schema, numbers = self._schema() + ", version long", self._numbers("base")
        return self.spark.read.schema(schema).parquet(f"{self.folder}/base/{numbers[-1]}") if numbers else self.spark.createDataFrame([], schema)

    def settled(self) -> DataFrame:
        """Entries that compactions have folded, with their verdicts."""
        whole, schema = self._numbers("base"), self._entry_schema() + ", met_version long, accepted boolean"
        paths = [f"{self.folder}/audit/{n}" for n in whole]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def judged(self) -> DataFrame:
        """Entries of the log that no compaction has folded, with met_version and accepted."""
        try:
            log = self.spark.read.parquet(f"{self.folder}/log")
        except Exception as e:
            if "PATH_NOT_FOUND" not in str(e):
                raise
            log = self.spark.createDataFrame([], self._entry_schema())
        open_ = log.join(self.settled().select("entry"), "entry", "left_anti")
        known = self.base().select(*self.keys, "version")
        rows = open_.join(known, self.keys, "left").withColumn("version", F.coalesce("version", F.lit(0).cast("long")))

        def judge(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["moment", "writer", "entry"])
            version, met, good = int(pdf["version"].iloc[0]), [], []
            for expected in pdf["expected_version"]:
                met.append(version)
                good.append(bool(expected == version))
                version += good[-1]
            return pdf.drop(columns="version").assign(met_version=met, accepted=good)

        order = ["entry", *self.names, "expected_version", "moment", "writer"]
        out = rows.select(*order, "version").groupBy(*self.keys).applyInPandas(judge, self._entry_schema() + ", met_version long, accepted boolean")
        return out

    def read(self) -> DataFrame:
        """(keys, fields, version) as the accepted entries have left them."""
        new = self.judged().where("accepted").groupBy(*self.keys).agg(F.max_by(F.struct(*self.fields.names, (F.col("met_version") + 1).alias("version")), "met_version").alias("x"))
        new = new.select(*self.keys, "x.*")
        return new.unionByName(self.base().join(new.select(*self.keys), self.keys, "left_anti"))

    def audit(self) -> DataFrame:
        """Every entry ever made, with its verdict."""
        return self.settled().unionByName(self.judged())

    def conflicts(self) -> DataFrame:
        return self.audit().where("NOT accepted")

    def compact(self) -> None:
        """Folds the log into a new base. What is read stays the same."""
        number = (self._numbers("base") or [0])[-1] + 1
        self.judged().write.mode("overwrite").parquet(f"{self.folder}/audit/{number}")
        verdicts = self.spark.read.parquet(f"{self.folder}/audit/{number}").where("accepted")
        new = verdicts.groupBy(*self.keys).agg(F.max_by(F.struct(*self.fields.names, (F.col("met_version") + 1).alias("version")), "met_version").alias("x"))
        new = new.select(*self.keys, "x.*")
        whole = new.unionByName(self.base().join(new.select(*self.keys), self.keys, "left_anti"))
        whole.write.mode("overwrite").parquet(f"{self.folder}/base/{number}")
