import base64
import hashlib

import pytest

from graphloom.llm import warc
from graphloom.llm.warc import chunked, read_archives, write_archives

BIG = "é\r\n\r\n" * 700
ROWS = [(3, "http://a/ x", "<p>x</p>"), (1, "http://b", "<p>x</p>"), (2, None, None), (4, "u", ""), (5, "big", BIG), (6, "big2", BIG), (7, "WARC/1.1\r\n", "WARC/1.1\r\n\r\nContent-Length: 3\r\n\r\n"), (None, "n", "<p>x</p>"), (8, "u", "alone"), (8, "u", "alone")]


def table(spark, rows=ROWS):
    return spark.createDataFrame([(*r, "e") for r in rows], "page_id long, url string, html string, data string")


@pytest.mark.parametrize("digests", [warc.DIGESTS, 0])
def test_round_trip(spark, tmp_path, monkeypatch, digests):
    monkeypatch.setattr(warc, "DIGESTS", digests)
    for chunk in (5, 1000, 1 << 20):
        path = str(tmp_path / f"w{chunk}")
        write_archives(table(spark), path, archives=3, chunk=chunk)
        got = sorted((tuple(x) for x in read_archives(spark, path).drop("url", "intact").collect()), key=str)
        first = {"<p>x</p>": 1, "": 2, BIG: 5, ROWS[6][2]: 7, "alone": 8}
        want = []
        for page, _, body in ROWS:
            data = (body or "").encode()
            response = first[body or ""] == page
            want.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if response else "revisit", None if response else first[body or ""]))
        assert got == sorted(want, key=str)
        assert read_archives(spark, path).filter("not intact").count() == 0


def test_bytes_are_warc_and_digests_go_on(spark):
    rows = sorted((x.archive, x.record_id, x.chunk, bytes(x.data), x.digest) for x in chunked(table(spark, ROWS[4:5]), 1, chunk=100).collect())
    whole = b"".join(x[3] for x in rows)
    head, _, rest = whole.partition(b"\r\n\r\n")
    http, _, body = rest.partition(b"\r\n\r\n")
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body == BIG.encode() + b"\r\n\r\n"
    assert rows[1][4] == base64.b32encode(hashlib.sha1(BIG.encode()[:100]).digest()).decode()


def test_small_payloads_are_responses(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(table(spark, ROWS[:2]), path, least=1000)
    assert {x.record_type for x in read_archives(spark, path).collect()} == {"response"}


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "w")
    write_archives(table(spark).limit(0), path)
    assert read_archives(spark, path).collect() == []


def test_payload_of_many_chunks(spark, tmp_path):
    path, body = str(tmp_path / "w"), "0123456789é" * 300_000
    write_archives(table(spark, [(1, "u", body), (2, "v", body), (3, "w", body + "x")]), path)
    assert spark.read.parquet(path).filter("length(data) > 1048580").count() == 0
    assert spark.read.parquet(path).groupBy("record_id").count().agg({"count": "max"}).first()[0] == 6
    got = {x.page_id: x for x in read_archives(spark, path).collect()}
    assert [(got[i].record_type, got[i].intact) for i in (1, 2, 3)] == [("response", True), ("revisit", True), ("response", True)]
    assert got[3].payload_bytes == len(body.encode()) + 1 and got[2].payload_digest == got[1].payload_digest


def test_damage_is_seen(spark, tmp_path):
    from pyspark.sql import functions as F

    path = str(tmp_path / "w")
    hurt = F.expr("if(chunk = 1, encode(replace(decode(data, 'utf-8'), 'alone', 'a1one'), 'utf-8'), data)")
    chunked(table(spark, [(1, "u", "alone"), (2, "u", "whole")]), 1).withColumn("data", hurt).write.parquet(path)
    assert {x.page_id: x.intact for x in read_archives(spark, path).collect()} == {1: False, 2: True}
