import base64
import hashlib

import pytest

from papyrion.llm import warc

SCHEMA = "page_id long, url string, html string, sha256 int, payload string"


def archive(spark, tmp_path, rows, **more):
    path = str(tmp_path / "archive")
    warc.write_archive(spark.createDataFrame(rows, SCHEMA), path, **more)
    return warc.read_archive(spark, path)


ROWS = [(4, "http://a/x", "same é", 1, "p"), (2, "http://b/y\r\nX: 1", "same é", 2, "p"), (9, None, "same é", None, None), (7, "u", None, 1, "p"), (5, "u", "", 1, "p"), (6, "u", "z" * 300000, 1, "p"), (3, "u", "own", 1, "p"), (3, "u", "own", 1, "p")]


def test_records(spark, tmp_path):
    got = archive(spark, tmp_path, ROWS).collect()
    assert len(got) == len(ROWS)
    by = {r.record_id: r for r in got}
    assert {i: (r.record_type, r.refers_to) for i, r in by.items()} == {2: ("response", None), 4: ("revisit", 2), 9: ("revisit", 2), 5: ("response", None), 7: ("revisit", 5), 6: ("response", None), 3: ("response", None)}
    for i, _, html, _, _ in ROWS:
        body = (html or "").encode()
        assert (bytes(by[i].payload), by[i].payload_bytes, by[i].payload_digest) == (body, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode())


def test_payload_bytes_are_stored_once(spark, tmp_path):
    archive(spark, tmp_path, ROWS)
    assert spark.read.parquet(str(tmp_path / "archive/payloads")).count() == 4


def test_small_payloads_are_responses(spark, tmp_path):
    got = archive(spark, tmp_path, ROWS, least_bytes=7)
    assert {r.record_type for r in got.where("payload_bytes < 7").collect()} == {"response"}
    assert got.where("record_type = 'revisit'").count() == 2


def test_record_bytes(spark, tmp_path):
    records = {r.record_id: bytes(r.record) for r in warc.record_bytes(archive(spark, tmp_path, ROWS)).collect()}
    for i, record in records.items():
        header, _, body = record.partition(b"\r\n\r\n")
        fields = dict(line.split(b": ", 1) for line in header.split(b"\r\n")[1:])
        assert record.startswith(b"WARC/1.1\r\n") and body.endswith(b"\r\n\r\n")
        assert int(fields[b"Content-Length"]) == len(body) - 4
        assert fields[b"WARC-Record-ID"] == f"<urn:page:{i}>".encode()
    assert b"X: 1" not in records[2].split(b"\r\n")


def test_a_changed_payload_is_an_error(spark, tmp_path):
    archive(spark, tmp_path, ROWS)
    changed = spark.read.parquet(str(tmp_path / "archive/payloads")).selectExpr("sha256", "concat(payload, X'00') AS payload")
    changed.write.parquet(str(tmp_path / "other/payloads"))
    spark.read.parquet(str(tmp_path / "archive/records")).write.parquet(str(tmp_path / "other/records"))
    with pytest.raises(Exception, match="another digest"):
        warc.read_archive(spark, str(tmp_path / "other")).collect()


def test_empty_table(spark, tmp_path):
    assert archive(spark, tmp_path, []).count() == 0
