"""WARC archives: exact round trip, members and offsets, edges."""

import glob
import gzip
import hashlib
import os
import zlib

import pytest
from pyspark.sql import functions as F

from hyetos.llm.warc import normalise, op11_warc_normaliser, page_of, read_records, write_archives

LONG = "x" * 200
BREAKS = "a\r\n\r\nWARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0" + LONG
PAGES = [
    (1, "http://a/", LONG), (2, "http://b/", LONG), (3, None, None), (4, "http://c/\r\nWARC-Type: warcinfo", BREAKS), (5, "", ""), (6, "http://e/", "x" * 99), (7, "http://f/", "x" * 99),
    (8, "http://g/ü", "ü\x00\n" * 60), (9, "http://h/", "WARC/1.1\r\n\r\n"), (10, "http://i/", BREAKS), (None, "http://j/", LONG), (None, "http://k/", "only without an id " * 9), (None, "http://l/", "only without an id " * 9),
    (1, "http://m/", LONG), (11, "http://n/", "\r\n\r\n"), (12, "http://o/", "long text " * 300_000),
]


def plain(pages):
    """The contract, row by row."""
    first = {}
    for i, _, body in pages:
        if i is not None:
            first[body or ""] = min(i, first.get(body or "", i))
    for i, _, body in pages:
        data = (body or "").encode()
        revisit = len(data) >= 100 and first.get(body or "") is not None and i != first[body or ""]
        yield i, len(data), hashlib.sha256(data).hexdigest(), "revisit" if revisit else "response", first[body or ""] if revisit else None


@pytest.fixture
def pages(spark):
    df = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    for name in ("id", "body", "digest", "first", "value", "block", "file", "revisit"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def test_query_on_edges(spark, pages, tmp_path):
    pages.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted(map(repr, (tuple(r) for r in op11_warc_normaliser(spark, str(tmp_path)).collect())))
    assert got == sorted(map(repr, plain(PAGES)))


def test_members_offsets_and_sidecars(spark, pages, tmp_path):
    write_archives(pages.coalesce(2), f"{tmp_path}/one", broadcast_rows=0)
    index = normalise(spark, f"{tmp_path}/one", f"{tmp_path}/each", archive_bytes=500)
    before = b""
    for name in sorted(glob.glob(f"{tmp_path}/one/part*.gz")):
        data = open(name, "rb").read()
        one = zlib.decompressobj(31)
        before += one.decompress(data)
        assert one.eof and not one.unused_data  # one stream for all records
    places = {}
    for r in index.collect():
        places.setdefault(r.file, []).append((r.offset, r.length, r.record_id))
    assert len(places) > 2 and len(PAGES) == sum(map(len, places.values()))
    after = []
    for name, rows in places.items():
        data = open(name, "rb").read()
        assert gzip.decompress(data)
        end = 0
        for offset, length, record_id in sorted(rows):
            assert offset == end
            one = zlib.decompressobj(31)
            record = one.decompress(data[offset : offset + length])
            assert one.eof and not one.unused_data and record.startswith(b"WARC/1.1\r\n") and record_id.encode() in record
            after.append(record)
            end = offset + length
        assert end == len(data)
        assert open(f"{name}.idx").read() == "".join(f"{o}\t{n}\t{i}\n" for o, n, i in sorted(rows))
    assert len(before) == sum(map(len, after)) and all(x in before for x in after)
    payloads = {r.page: bytes(r.payload) for r in read_records(index).filter("warc_type = 'response'").withColumn("page", page_of(F.col("record_id"))).collect()}
    assert payloads["4"] == BREAKS.encode() and payloads["9"] == b"WARC/1.1\r\n\r\n" and payloads["11"] == b"\r\n\r\n"
    assert read_records(index).filter("target_uri like '%warcinfo%' and warc_type = 'response' and target_uri like '%\\%0D\\%0A%'").count() == 1


def test_foreign_and_broken_archives(spark, tmp_path):
    os.makedirs(f"{tmp_path}/in")
    info = b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x:1>\r\nContent-Type: application/warc-fields\r\ncontent-length: 5\r\n\r\nWARC/\r\n\r\n"
    folded = b"WARC/1.1\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:x:2>\r\nX-Long: a\r\n b\r\nContent-Length: 0\r\n\r\n\r\n\r\n"
    open(f"{tmp_path}/in/a.warc.gz", "wb").write(gzip.compress(info + folded + info))
    rows = read_records(normalise(spark, f"{tmp_path}/in", f"{tmp_path}/out")).collect()
    assert sorted((r.record_id, r.warc_type, bytes(r.payload)) for r in rows) == [("<urn:x:1>", "warcinfo", b"WARC/")] * 2 + [("<urn:x:2>", "resource", b"")]
    for k, bad in enumerate((info[:-8], b"no archive", info[:-4] + b"more bytes" + folded)):
        os.makedirs(f"{tmp_path}/bad{k}")
        open(f"{tmp_path}/bad{k}/b.warc.gz", "wb").write(gzip.compress(bad))
        with pytest.raises(Exception, match="b.warc.gz"):
            normalise(spark, f"{tmp_path}/bad{k}", f"{tmp_path}/outbad{k}")


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    assert op11_warc_normaliser(spark, str(tmp_path)).collect() == []
