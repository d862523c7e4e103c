import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from aerialframe.llm import warc

ROWS = [
    (5, "http://a/ b", "<p>x</p>"), (3, "http://b", "<p>x</p>"), (9, None, "<p>x</p>"), (None, "u", "<p>x</p>"),
    (1, "u", ""), (2, "u", None), (7, "u\r\nX: y", "WARC/1.1\r\n\r\n\r\n\r\nContent-Length: 3\r\n\r\n"), (8, "é", "é\x00 " * 5000), (3, "again", "<p>x</p>"), (None, "n", "only null"),
]


def plain(rows, least):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "").encode() == data and p is not None]
        first = min(same, default=None)
        revisit = len(data) >= least and page != first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", first if revisit else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 1, 9])
def test_round_trip(spark, tmp_path, least):
    df = spark.createDataFrame(ROWS, "page_id long, url string, payload string").repartition(3)
    warc.write_archives(df, str(tmp_path / "w"), least)
    rows = warc.read_archives(spark, str(tmp_path / "w")).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == plain(ROWS, least)
    assert all(r.intact for r in rows)
    texts = {p: (h or "").encode() for p, _, h in ROWS}
    assert all(bytes(r.payload) == texts[r.page_id] for r in rows if r.record_type == "response" and r.page_id is not None)


def test_no_pages(spark, tmp_path):
    df = spark.createDataFrame([], "page_id long, url string, payload string, payload_digest int")
    warc.write_archives(df, str(tmp_path / "w"))
    assert warc.read_archives(spark, str(tmp_path / "w")).count() == 0


def test_digest_in_sql(spark):
    row = spark.createDataFrame([("abc",)], "t string").select(warc.base32_sha1(F.col("t").cast("binary"))).first()
    assert row[0] == base64.b32encode(hashlib.sha1(b"abc").digest()).decode()


def test_members_ids_and_references(spark, tmp_path, monkeypatch):
    """A member for each record, names that differ, and revisits that name the record, address and date of their response."""
    import gzip
    import zlib

    monkeypatch.setattr(warc, "FILE_BYTES", 1)
    df = spark.createDataFrame(ROWS, "page_id long, url string, payload string").coalesce(1)
    warc.write_archives(df, str(tmp_path / "w"))
    files = sorted((tmp_path / "w").glob("part-*"))
    assert len(files) >= len(ROWS) // 2
    records = []
    for f in files:
        data, n = f.read_bytes(), 0
        whole = gzip.decompress(data)
        while data:
            d = zlib.decompressobj(31)
            got = d.decompress(data) + d.flush()
            data, n = d.unused_data, n + 1
            if got != warc.END:
                records.append(got)
                assert got.startswith(b"WARC/1.1\r\n")
        assert whole.endswith(warc.END)
    assert len(records) == len(ROWS)
    heads = [dict(line.split(b": ", 1) for line in r.split(warc.END)[0].split(b"\r\n")[1:]) for r in records]
    names = [h[b"WARC-Record-ID"] for h in heads]
    assert len(set(names)) == len(names)
    by_name = {h[b"WARC-Record-ID"]: h for h in heads}
    revisits = [h for h in heads if h[b"WARC-Type"] == b"revisit"]
    assert len(revisits) == 4
    for h in revisits:
        to = by_name[h[b"WARC-Refers-To"]]
        assert to[b"WARC-Type"] == b"response" and h[b"WARC-Refers-To-Target-URI"] == to[b"WARC-Target-URI"] and h[b"WARC-Refers-To-Date"] == to[b"WARC-Date"]


@pytest.mark.parametrize("most", [0, 1 << 24])
def test_both_ways_to_meet_a_digest(spark, monkeypatch, most):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", most)
    df = spark.createDataFrame([(*r, i, "x") for i, r in enumerate(ROWS)], "page_id long, url string, payload string, first_id long, _salt string").withColumn("FIRST", F.lit(3))
    rows = warc.resolve(df).collect()
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in rows), key=str) == plain(ROWS, 0)
    assert sorted(r.first_id for r in rows) == list(range(len(ROWS))) and {(r._salt, r.FIRST) for r in rows} == {("x", 3)}
    assert warc.resolve(df.where("false")).collect() == []
