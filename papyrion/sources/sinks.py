"""Writers: corpus views, identifier-filtered maps, bundles with a manifest, requests, review logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from papyrion.functions.expressions import norm_doi
from papyrion.plans.freshness import status
from papyrion.plans.registry import Scope
from papyrion.sources.exports import read_doi_map


def write_views(df: DataFrame, folder: str, flags: dict[str, str], columns: list[str] | None = None, form: str = "csv") -> DataFrame:
    """Writes the whole corpus and one view for each flag column (view name -> 0/1 column), with the
    whitelisted columns that exist, and returns (view, rows) counted in one pass."""
    kept = [c for c in columns if c in df.columns] if columns else df.columns
    save = lambda rows, name: rows.select(*kept).write.mode("overwrite").option("header", True).format(form).save(f"{folder}/{name}")
    save(df, "corpus")
    for name, flag in flags.items():
        save(df.where(F.col(flag) == 1), name)
    sums = df.agg(F.count("*").alias("corpus"), *[F.coalesce(F.sum((F.col(f) == 1).cast("long")), F.lit(0)).alias(n) for n, f in flags.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(c).alias("view"), F.col(c).alias("rows")) for c in sums.columns])).alias("x")).select("x.*")


def split_by_dois(map_rows: DataFrame, doi: Column, corpus_dois: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of a map whose DOI the corpus has, and the others; rows without a DOI are among the
    others. corpus_dois has a column doi."""
    known = corpus_dois.select(norm_doi(F.col("doi")).alias("_doi")).where("_doi IS NOT NULL").distinct()
    rows = map_rows.withColumn("_doi", norm_doi(doi))
    return rows.join(known, "_doi", "left_semi").drop("_doi"), rows.join(known, "_doi", "left_anti").drop("_doi")


def filter_scopes(corpus: DataFrame, doi: Column, scopes: list[Scope], maps: dict[str, str], reference: str, folder: str) -> DataFrame:
    """Writes each scope's rows as folder/<scope>/retained=true and =false, by whether its map (a path for each
    scope id) has their DOI, and returns a row a scope: scope, status, map_dois, scope_papers, retained, dropped
    and retained_share (four decimals). A scope whose map is missing, or older than the reference, is not
    written; it has that as status and no figures. Rows without a DOI are dropped ones."""
    spark, parts = corpus.sparkSession, []
    for s in scopes:
        state = status(spark, maps[s.id], reference) if s.id in maps else "missing"
        if state != "current":
            parts.append(spark.createDataFrame([(s.id, state)], "scope string, status string"))
            continue
        known = read_doi_map(spark, maps[s.id]).select(F.col("doi").alias("_doi"), F.lit(True).alias("retained"))
        rows = s.frame(corpus).withColumn("_doi", norm_doi(doi)).join(known, "_doi", "left").drop("_doi")
        path = f"{folder}/{s.id}"
        rows.withColumn("retained", F.coalesce("retained", F.lit(False))).write.mode("overwrite").partitionBy("retained").parquet(path)
        # Counts come from the rows as written, for which the reader needs no column but the folder's.
        done = spark.read.schema("retained boolean").parquet(path).agg(F.count("*").alias("scope_papers"), F.count(F.when(F.col("retained"), 1)).alias("retained"))
        done = done.withColumn("map_dois", F.lit(known.count())).withColumn("dropped", F.col("scope_papers") - F.col("retained"))
        parts.append(done.select(F.lit(s.id).alias("scope"), F.lit("filtered").alias("status"), "*", F.round(F.coalesce(F.try_divide("retained", "scope_papers"), F.lit(0.0)), 4).alias("retained_share")))
    names = "scope string, status string, map_dois long, scope_papers long, retained long, dropped long, retained_share double"
    out = spark.createDataFrame([], names)
    for p in parts:
        out = out.unionByName(p, allowMissingColumns=True)
    return out


def write_bundle(tables: dict[str, DataFrame], folder: str) -> DataFrame:
    """Writes each table as CSV and a manifest of every file: table, file, bytes, sha256, taken from
    the files as they were written."""
    spark = next(iter(tables.values())).sparkSession
    for name, df in tables.items():
        df.write.mode("overwrite").option("header", True).csv(f"{folder}/tables/{name}")
    manifest = checksums(spark, f"{folder}/tables", "*.csv").withColumn("table", F.element_at(F.split("path", "/"), -2)).withColumn("file", F.element_at(F.split("path", "/"), -1))
    manifest = manifest.select("table", "file", "bytes", "sha256")
    manifest.write.mode("overwrite").json(f"{folder}/manifest")
    return spark.read.schema(manifest.schema).json(f"{folder}/manifest")


def checksums(spark: SparkSession, folder: str, glob: str = "*") -> DataFrame:
    """(path, bytes, sha256) of a folder's files."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", glob).load(folder)
    return files.select("path", F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def requests(df: DataFrame, key: str, prompt: Column, model: str, shard_rows: int, fingerprint: str) -> DataFrame:
    """Request lines (shard, custom_id, value): ids are made from the key and the protocol's
    fingerprint, so that a repeated run writes the same ones. Rows are shared out to shards of about
    ``shard_rows`` by the hash of their id, which needs no order over all rows."""
    rows = df.select(F.concat(F.lit("req-"), F.substring(F.sha1(F.concat_ws("|", F.lit(fingerprint), F.col(key).cast("string"))), 1, 24)).alias("custom_id"), prompt.alias("p"))
    shards = max(1, -(-rows.count() // shard_rows))
    body = F.struct(F.lit(model).alias("model"), F.col("p").alias("input"))
    line = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), body.alias("body")))
    return rows.select(F.pmod(F.xxhash64("custom_id"), F.lit(shards)).cast("int").alias("shard"), "custom_id", line.alias("value"))


def write_requests(lines: DataFrame, folder: str) -> None:
    """One folder of JSON lines for each shard."""
    lines.repartition("shard").sortWithinPartitions("shard", "custom_id").select("shard", "value").write.mode("overwrite").partitionBy("shard").text(folder)


def append_log(entries: DataFrame, folder: str) -> None:
    """Adds review entries to an append-only log; nothing is ever rewritten, so the log is the audit
    trail and a failed write leaves no half state."""
    entries.write.mode("append").parquet(folder)


def latest(log: DataFrame, keys: list[str], moment: str, ties: list[str] = ()) -> DataFrame:
    """The newest entry of each key: what an upsert would have left."""
    w = Window.partitionBy(*keys).orderBy(F.desc(moment), *[F.desc(t) for t in ties])
    return log.select(F.struct("*").alias("entry"), *keys, F.row_number().over(w).alias("place")).where("place = 1").select("entry.*")
