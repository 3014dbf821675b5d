"""Content-addressed WARC archive.

An archive is a folder with two Parquet tables. ``payloads`` holds the bytes of each different
payload once, under its SHA-256. ``records`` holds one row per record with its header block, byte
for byte as it stands in a WARC file, and the SHA-256 of its payload. Records are rebuilt by a join
of the two. Digests are verified: when writing, payloads that meet under one SHA-256 must agree in
length and SHA-1; when reading, each stored payload must have the digest that it is stored under,
and each record's header must name the payload's SHA-1.

The tables are written by Spark's own committer to any file system it reads, so a lost executor
leaves no half file, and no Python runs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The digits of Spark's base 32 and the alphabet of RFC 4648.
_DIGITS, _BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of bytes in upper-case base 32, as WARC digests are written: each 5 hexadecimal
    digits make 4 of base 32."""
    hexed = F.sha1(payload)
    fives = [F.lpad(F.conv(F.substring(hexed, i, 5), 16, 32), 4, "0") for i in range(1, 41, 5)]
    return F.translate(F.concat(*fives), _DIGITS, _BASE32)


def _header(fields: list[tuple[str, Column]]) -> Column:
    """A header block; null fields are left out, line ends in values become spaces."""
    clean = lambda v: F.regexp_replace(v, r"[\r\n]+", " ")
    lines = [F.lit("WARC/1.1\r\n"), *[F.coalesce(F.concat(F.lit(f"{k}: "), clean(v), F.lit("\r\n")), F.lit("")) for k, v in fields]]
    return F.concat(*lines, F.lit("\r\n")).cast("binary")


def write_archive(
    df: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
    date: str = "2024-01-01T00:00:00Z", least_bytes: int = 0,
) -> None:
    """Writes a record for every row of df.

    Among records with equal payloads of ``least_bytes`` or more, the one with the smallest id is a
    response and the others are revisits of it; smaller payloads are always responses. Null
    payloads are empty ones, null URLs are left out. Rows that repeat the smallest id are all
    responses; a null id is never the smallest unless there is no other. Other columns are not
    archived. An empty table makes an empty archive.

    A payload may be shared by most rows: the smallest id and the stored bytes are combined before
    the shuffle, and the join that brings the id back to the rows is one that Spark can split.
    """
    rows = df.select(
        F.col(id_col).cast("long").alias("record_id"), F.col(url_col).cast("string").alias("url"),
        F.coalesce(F.col(payload_col).cast("string"), F.lit("")).cast("binary").alias("payload"),
    ).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    stored = rows.groupBy("sha256").agg(F.first("payload").alias("payload"))
    stored.write.parquet(f"{path}/payloads", compression="zstd")

    slim = rows.select("record_id", "url", "sha256", F.octet_length("payload").cast("long").alias("n_bytes"), base32_sha1(F.col("payload")).alias("sha1"))
    per = slim.groupBy("sha256").agg(
        F.min("record_id").alias("first_id"), F.min("n_bytes").alias("n0"), F.max("n_bytes").alias("n1"), F.min("sha1").alias("s0"), F.max("sha1").alias("s1")
    )
    clash = (F.col("n0") != F.col("n1")) | (F.col("s0") != F.col("s1"))
    per = per.select("sha256", F.when(clash, F.raise_error(F.lit("different payloads under one SHA-256"))).otherwise(F.col("first_id")).cast("long").alias("first_id"))
    slim = slim.join(per, "sha256")
    revisit = ~F.col("record_id").eqNullSafe(F.col("first_id")) & (F.col("n_bytes") >= least_bytes)
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("null")), F.lit(">"))
    header = _header([
        ("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        ("WARC-Record-ID", urn(F.col("record_id"))),
        ("WARC-Date", F.lit(date)),
        ("WARC-Target-URI", F.col("url")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        ("WARC-Profile", F.when(revisit, F.lit(_PROFILE))),
        ("WARC-Refers-To", F.when(revisit, urn(F.col("first_id")))),
        ("Content-Type", F.lit("text/html; charset=utf-8")),
        ("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("n_bytes").cast("string"))),
    ])
    slim.select("record_id", "sha256", header.alias("header")).write.parquet(f"{path}/records", compression="zstd")


def header_field(header: Column, name: str) -> Column:
    """A field of a header block, null where it is absent."""
    found = F.regexp_extract(header.cast("string"), rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: record_id, header, record_type, refers_to, payload, payload_bytes,
    payload_digest.

    payload is the full payload, of revisits too. Size and digest are taken from the stored bytes
    once per different payload, before the join, so a reader that wants no bytes moves none.
    """
    intact = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    payloads = spark.read.parquet(f"{path}/payloads").select(
        "sha256", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.when(intact, base32_sha1(F.col("payload"))).otherwise(F.raise_error(F.lit("a stored payload has another digest"))).alias("payload_digest"),
    )
    rows = spark.read.parquet(f"{path}/records").join(payloads, "sha256")
    named = header_field(F.col("header"), "WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    digest = F.when(named, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header names another payload")))
    refers = F.regexp_extract(F.coalesce(header_field(F.col("header"), "WARC-Refers-To"), F.lit("")), r"<urn:page:(-?\d+)>", 1)
    return rows.select(
        "record_id", "header", header_field(F.col("header"), "WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"), "payload", "payload_bytes", digest.alias("payload_digest"),
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """read_archive()'s rows as WARC records: record_id and the bytes from the version line to the
    blank lines at the end. Concatenated they are a WARC file."""
    body = F.when(F.col("record_type") == "revisit", F.lit("").cast("binary")).otherwise(F.col("payload"))
    return records.select("record_id", F.concat(F.col("header"), body, F.lit("\r\n\r\n").cast("binary")).alias("record"))
