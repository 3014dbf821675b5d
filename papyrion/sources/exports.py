"""Readers: search exports as CSV, coded profiles and batch results as JSON, identifier maps, workbooks.

All are lazy scans over any path that Spark reads; text stays text, and the order of rows that
"first row wins" rules need is kept as (query order, file, row in file).
"""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from functools import reduce
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from papyrion.functions.expressions import clean, norm_doi


def read_export(spark: SparkSession, paths: list[str]) -> DataFrame:
    """The rows of CSV parts with a header, every cell cleaned text, blanks empty. Parts may lack
    columns that others have. A missing file is an error. Also part and row: a part's place in
    ``paths`` and a row's in its part.

    A part is one file that Spark reads in one split (quoted cells may hold line ends), so the
    increasing id that it numbers rows with stands in the file's order.
    """
    parts = []
    for i, path in enumerate(paths):
        rows = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
        named = [F.col(f"`{c}`").alias(c.lstrip("﻿").strip()) for c in rows.columns]
        parts.append(rows.select(*named, F.lit(i).alias("part"), F.monotonically_increasing_id().alias("row")))
    out = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    return out.select(*[F.col(c) if c in ("part", "row") else clean(F.col(f"`{c}`")).alias(c) for c in out.columns])


def read_exports(spark: SparkSession, by_query: dict[str, list[str]]) -> DataFrame:
    """read_export() of several queries, with query and query_order."""
    parts = [read_export(spark, paths).withColumn("query", F.lit(q)).withColumn("query_order", F.lit(i)) for i, (q, paths) in enumerate(by_query.items())]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_profiles(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """One JSON object a file: coded profiles with a paper_id, ordered by nothing; files that are no
    profile (a manifest, say) give rows without a paper_id and are left out."""
    rows = spark.read.json(folder, schema=schema, multiLine=True, pathGlobFilter="*.json", mode="PERMISSIVE")
    return rows.where(clean(F.col("paper_id")) != "")


def flatten_profile(profile: Column, dimensions: list[str]) -> list[Column]:
    """The flat columns of a nested profile struct: for each dimension code, evidence, evidence_type
    and confidence clamped to 0..1; score is clamped to 0..100 and mechanisms joined by ";"."""
    clamp = lambda c, hi: F.greatest(F.lit(0.0), F.least(F.lit(float(hi)), c.cast("double")))
    out = []
    for d in dimensions:
        cell = profile[d]
        out += [cell["code"].alias(d), cell["evidence"].alias(f"{d}_evidence"), cell["evidence_type"].alias(f"{d}_evidence_type"), clamp(cell["confidence"], 1).alias(f"{d}_confidence")]
    return [*out, clamp(profile["score"], 100).alias("score"), F.array_join(profile["problems"], ";").alias("problems")]


_RESULT = "custom_id string, error struct<message string>, response struct<status_code int, body struct<output_text string, usage struct<input_tokens long, output_tokens long>>>"


def parse_results(lines: DataFrame, line: str = "value") -> DataFrame:
    """Batch result lines as custom_id, text, input_tokens, output_tokens and error (null if fine): a
    line that is no JSON, a provider's error, another status than 200 and an empty text are errors."""
    r = F.from_json(F.col(line), _RESULT, {"mode": "PERMISSIVE"})
    rows = lines.select(r.alias("r"), *[c for c in lines.columns if c != line])
    text = F.col("r.response.body.output_text")
    error = (
        F.when(F.col("r.custom_id").isNull(), F.lit("unreadable line")).when(F.col("r.error.message").isNotNull(), F.col("r.error.message"))
        .when(~F.col("r.response.status_code").eqNullSafe(200), F.concat(F.lit("status "), F.coalesce(F.col("r.response.status_code").cast("string"), F.lit("missing"))))
        .when(clean(text) == "", F.lit("empty text"))
    )
    usage = F.col("r.response.body.usage")
    return rows.select(F.col("r.custom_id").alias("custom_id"), text.alias("text"), usage["input_tokens"].alias("input_tokens"), usage["output_tokens"].alias("output_tokens"), error.alias("error"), *[c for c in lines.columns if c != line])


def read_results(spark: SparkSession, path: str) -> DataFrame:
    return parse_results(spark.read.text(path))


def read_doi_map(spark: SparkSession, path: str) -> DataFrame:
    """The different normalised DOIs of a delimited map: tab or comma, whichever its header has more
    of, and the first column whose name tells of a DOI, URL or link. Without one it is an error."""
    header = spark.read.text(path).limit(1).collect()
    head = header[0].value if header else ""
    separator = "\t" if head.count("\t") >= head.count(",") and "\t" in head else ","
    rows = spark.read.csv(path, sep=separator, header=True)
    found = [c for c in rows.columns if re.search("doi|url|link", c, re.I)]
    if not found:
        raise ValueError(f"no DOI, URL or link column in {path}")
    return rows.select(norm_doi(F.col(f"`{found[0]}`")).alias("doi")).where("doi IS NOT NULL").distinct()


_NS = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"


def _cells(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, column, value) of a workbook's non-empty cells, counted from 1."""
    book = zipfile.ZipFile(io.BytesIO(content))
    names = set(book.namelist())
    read = lambda name: ElementTree.fromstring(book.read(name))
    text = lambda e: "".join(t.text or "" for t in e.iter(f"{_NS}t"))
    shared = [text(s) for s in read("xl/sharedStrings.xml")] if "xl/sharedStrings.xml" in names else []
    targets = {r.get("Id"): r.get("Target").lstrip("/").removeprefix("xl/") for r in read("xl/_rels/workbook.xml.rels")}
    for sheet in read("xl/workbook.xml").iter(f"{_NS}sheet"):
        row_number = 0
        for row in read(f"xl/{targets[sheet.get(_REL)]}").iter(f"{_NS}row"):
            row_number = int(row.get("r") or row_number + 1)
            column = 0
            for cell in row.iter(f"{_NS}c"):
                letters = re.match("[A-Z]*", cell.get("r") or "")[0]
                column = int(sum((ord(c) - 64) * 26**k for k, c in enumerate(reversed(letters)))) or column + 1
                raw = cell.find(f"{_NS}v")
                if cell.get("t") == "inlineStr":
                    value = text(cell)
                elif raw is None or raw.text is None:
                    continue
                else:
                    value = shared[int(raw.text)] if cell.get("t") == "s" else raw.text
                if value.strip():
                    yield sheet.get("name"), row_number, column, value


def read_workbook_cells(spark: SparkSession, path: str) -> DataFrame:
    """(path, sheet, row, column, value) of every non-empty cell of one or many XLSX workbooks. Spark
    hands out whole files; a task parses one workbook at a time with the standard library."""

    def parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in batches:
            for name, content in zip(files["path"], files["content"], strict=True):
                yield pd.DataFrame([(name, *c) for c in _cells(content)], columns=["path", "sheet", "row", "column", "value"])

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(parsed, "path string, sheet string, row int, column int, value string")


def read_workbook(spark: SparkSession, path: str, sheet: str, columns: list[str], header_row: int = 1) -> DataFrame:
    """The named columns of a sheet, by the header row's cleaned names, one row for each row below it
    that holds anything. A missing column is an error."""
    cells = read_workbook_cells(spark, path).where(F.col("sheet") == sheet)
    heads = {clean_name(r.value): r.column for r in cells.where(F.col("row") == header_row).collect()}
    if missing := [c for c in columns if c not in heads]:
        raise ValueError(f"sheet {sheet} lacks {missing}")
    wanted = [F.max(F.when(F.col("column") == heads[c], F.col("value"))).alias(c) for c in columns]
    return cells.where(F.col("row") > header_row).groupBy("row").agg(*wanted)


def clean_name(value: str) -> str:
    return " ".join(value.split())
