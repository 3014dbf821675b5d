import hashlib
import json
import os
import zipfile

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from papyrion.functions import expressions as E
from papyrion.operators import ingest
from papyrion.sources import exports, sinks
from papyrion.streaming import results


def test_exports_merge_like_search_results(spark, tmp_path):
    (tmp_path / "a.csv").write_text('﻿EID,DOI,Title,Year\ne1,, First paper ,2001\ne2,10.1/X,"Quoted ""word""\nover lines",2002\n', encoding="utf-8")
    (tmp_path / "b.csv").write_text("EID,DOI,Title,Year,Extra\ne2,10.1/x,Second,2002,more\n,https://doi.org/10.9/Z,Third,2003,\n", encoding="utf-8")
    rows = exports.read_exports(spark, {"query_1": [str(tmp_path / "a.csv")], "query_3": [str(tmp_path / "b.csv")]})
    assert [r.Title for r in rows.orderBy("query_order", "part", "row").collect()] == ["First paper", 'Quoted "word"\nover lines', "Second", "Third"]
    keyed = rows.withColumn("key", E.dedup_key(F.col("EID"), F.col("DOI"), F.col("Title"), F.col("Year")))
    out = ingest.merge_queries(keyed, "key", "query", [F.col("query_order"), F.col("part"), F.col("row")], ["query_1", "query_2", "query_3"])
    got = {r.key: (r.in_query_1, r.in_query_2, r.in_query_3, r.query_count, r.query_sources, r.Title) for r in out.collect()}
    assert got == {"eid:e1": (1, 0, 0, 1, "query_1", "First paper"), "eid:e2": (1, 0, 1, 2, "query_1;query_3", 'Quoted "word"\nover lines'), "doi:10.9/z": (0, 0, 1, 1, "query_3", "Third")}
    with pytest.raises(Exception, match="no identifier"):
        ingest.merge_queries(keyed.withColumn("key", F.lit(None).cast("string")), "key", "query", [F.col("row")], ["query_1", "query_3"]).collect()
    with pytest.raises(Exception, match="unknown query"):
        ingest.merge_queries(keyed, "key", "query", [F.col("row")], ["query_1"]).collect()


def test_a_missing_export_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        exports.read_export(spark, [str(tmp_path / "none.csv")])


def test_doi_map_and_its_split(spark, tmp_path):
    (tmp_path / "map.txt").write_text("id\tlabel\turl\n1\ta\thttps://doi.org/10.1/A\n2\tb\t\n3\tc\t10.2/b.\n3\tc\t10.2/B\n")
    assert {r.doi for r in exports.read_doi_map(spark, str(tmp_path / "map.txt")).collect()} == {"10.1/a", "10.2/b"}
    rows = spark.read.csv(str(tmp_path / "map.txt"), sep="\t", header=True)
    kept, dropped = sinks.split_by_dois(rows, F.col("url"), spark.createDataFrame([("https://doi.org/10.2/b",), (None,)], "doi string"))
    assert sorted(r.id for r in kept.collect()) == ["3", "3"] and sorted(r.id for r in dropped.collect()) == ["1", "2"]
    (tmp_path / "bad.csv").write_text("a,b\n1,2\n")
    with pytest.raises(ValueError, match="no DOI"):
        exports.read_doi_map(spark, str(tmp_path / "bad.csv"))


def workbook(path):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook {main} xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="One" sheetId="1" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/s.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f"<sst {main}><si><t>Title</t></si><si><r><t>Rich </t></r><r><t>text</t></r></si></sst>")
        z.writestr("xl/worksheets/s.xml", f'<worksheet {main}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t> ISSN  print</t></is></c></row><row r="3"><c r="A3" t="s"><v>1</v></c><c r="C3"><v>12345678</v></c></row><row r="4"><c r="AB4"><v>9</v></c></row></sheetData></worksheet>')


def test_workbooks(spark, tmp_path):
    workbook(tmp_path / "w.xlsx")
    cells = exports.read_workbook_cells(spark, str(tmp_path / "w.xlsx"))
    assert {(r.sheet, r.row, r.column, r.value) for r in cells.collect()} == {("One", 1, 1, "Title"), ("One", 1, 3, " ISSN  print"), ("One", 3, 1, "Rich text"), ("One", 3, 3, "12345678"), ("One", 4, 28, "9")}
    rows = exports.read_workbook(spark, str(tmp_path / "w.xlsx"), "One", ["Title", "ISSN print"]).orderBy("row").collect()
    assert [(r.Title, r["ISSN print"]) for r in rows] == [("Rich text", "12345678"), (None, None)]
    with pytest.raises(ValueError, match="lacks"):
        exports.read_workbook(spark, str(tmp_path / "w.xlsx"), "One", ["Year"])


def test_profiles(spark, tmp_path):
    cell = {"code": "x", "evidence": "e", "evidence_type": "stated", "confidence": 1.7}
    (tmp_path / "p1.json").write_text(json.dumps({"paper_id": "p1", "profile": {"role": cell, "score": -3, "problems": ["a", "b"]}}, indent=1))
    (tmp_path / "protocol_manifest.json").write_text('{"version": 2}')
    schema = "paper_id string, profile struct<role struct<code string, evidence string, evidence_type string, confidence double>, score double, problems array<string>>"
    row = exports.read_profiles(spark, str(tmp_path), schema).select("paper_id", *exports.flatten_profile(F.col("profile"), ["role"])).collect()
    assert [tuple(r) for r in row] == [("p1", "x", "e", "stated", 1.0, 0.0, "a;b")]


def line(i, text="ok", status=200, error=None):
    return json.dumps({"custom_id": i, "error": error, "response": {"status_code": status, "body": {"output_text": text, "usage": {"input_tokens": 5, "output_tokens": 2}}}})


def test_results_come_in_once_and_a_run_goes_on(spark, tmp_path):
    inbox, log, mark = (str(tmp_path / n) for n in ("inbox", "log", "mark"))
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox/1.jsonl").write_text("\n".join([line("a"), line("b", status=429), "no json", line("c", text=" ")]) + "\n")
    results.ingest_results(spark, inbox, log, mark)
    results.ingest_results(spark, inbox, log, mark)
    assert spark.read.parquet(log).count() == 4
    (tmp_path / "inbox/2.jsonl").write_text("\n".join([line("b", "late"), line("d", error={"message": "boom"})]) + "\n")
    results.ingest_results(spark, inbox, log, mark)
    got = {r.custom_id: (r.text, r.error) for r in results.accepted(spark.read.parquet(log)).collect()}
    assert got == {"a": ("ok", None), "b": ("late", None), "c": (" ", "empty text"), "d": ("ok", "boom")}
    wanted = spark.createDataFrame([(x,) for x in "abcdefe"], "custom_id string")
    assert tuple(results.progress(spark.read.parquet(log), wanted).first()) == (6, 2, 2, 2)


def test_a_run_stops_when_results_fail(spark, tmp_path):
    """The batch that shows it is kept, later files wait for the next run, and open requests are packed."""
    inbox, log, mark = (str(tmp_path / n) for n in ("inbox", "log", "mark"))
    (tmp_path / "inbox").mkdir()
    for name, rows in (("1", [line(f"a{i}") for i in range(6)]), ("2", [line(f"b{i}", status=500) for i in range(6)]), ("3", [line(f"c{i}") for i in range(3)])):
        path = tmp_path / f"inbox/{name}.jsonl"
        path.write_text("\n".join(rows) + "\n")
        os.utime(path, (int(name), 1_700_000_000 + int(name)))
    with pytest.raises(results.TooManyFailures, match="6 of 12"):
        results.guarded_ingest(spark, inbox, log, mark, files=1, least=10)
    assert spark.read.parquet(log).count() == 12
    assert results.guarded_ingest(spark, inbox, log, mark, files=1, least=10) == (3, 0)
    assert results.guarded_ingest(spark, inbox, log, mark, files=1, least=10) == (0, 0)
    read = spark.read.parquet(log)
    assert read.count() == 15 and read.select("custom_id").distinct().count() == 15
    wanted = spark.createDataFrame([(x, i, 4) for i, x in enumerate(["a1", "b1", "c1", "b0", "z", "c9"])], "custom_id string, n int, cost int")
    got = {r.custom_id: r.chunk for r in results.open_requests(wanted, read, ["n"], "cost", 8).collect()}
    assert got == {"b1": 1, "b0": 1, "z": 2, "c9": 2}


def test_a_stream_that_breaks_is_no_breaker(spark, tmp_path):
    (tmp_path / "inbox").mkdir()
    (tmp_path / "inbox/1.jsonl").write_text(line("a") + "\n")
    (tmp_path / "log").write_text("a file where the log's folder should be")
    with pytest.raises(StreamingQueryException):
        results.guarded_ingest(spark, str(tmp_path / "inbox"), str(tmp_path / "log"), str(tmp_path / "mark"))


def test_views_and_counts(spark, tmp_path):
    df = spark.createDataFrame([(1, "x", 1, 0), (2, "y", 1, 1), (3, "z", 0, 0)], "id int, t string, in_a int, in_b int")
    counts = {r.view: r.rows for r in sinks.write_views(df, str(tmp_path), {"a": "in_a", "b": "in_b"}, ["t", "absent"]).collect()}
    assert counts == {"corpus": 3, "a": 2, "b": 1}
    assert {r.t for r in spark.read.csv(str(tmp_path / "a"), header=True).collect()} == {"x", "y"}


def test_bundle_manifest_holds_the_files_sums(spark, tmp_path):
    df = spark.createDataFrame([(1, "x")], "id int, t string")
    manifest = sinks.write_bundle({"one": df, "two": df}, str(tmp_path)).collect()
    assert {r.table for r in manifest} == {"one", "two"}
    for r in manifest:
        content = (tmp_path / "tables" / r.table / r.file).read_bytes()
        assert (r.bytes, r.sha256) == (len(content), hashlib.sha256(content).hexdigest())


def test_requests_are_the_same_every_run(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text {i}") for i in range(50)], "id int, t string")
    make = lambda d: sinks.requests(d, "id", F.col("t"), "m", 20, "v1")
    lines = make(df)
    assert lines.exceptAll(make(df.repartition(5))).count() == 0 and lines.select("custom_id").distinct().count() == 50
    assert {r.shard for r in lines.collect()} <= {0, 1, 2}
    sinks.write_requests(lines, str(tmp_path / "r"))
    assert {json.loads(r.value)["body"]["input"] for r in spark.read.text(str(tmp_path / "r")).collect()} == {f"text {i}" for i in range(50)}


def test_log_and_latest(spark, tmp_path):
    schema, log = "topic int, moment int, label string, place int", str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([(1, 1, "old", 5), (2, 1, "only", 6)], schema), log)
    sinks.append_log(spark.createDataFrame([(1, 2, "new", 7)], schema), log)
    assert {(r.topic, r.label, r.place) for r in sinks.latest(spark.read.parquet(log), ["topic"], "moment").collect()} == {(1, "new", 7), (2, "only", 6)}
    assert spark.read.parquet(log).count() == 3
