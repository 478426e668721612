import base64
import gzip
import hashlib
import io

import pytest

from quintet.llm import warc


def records(data, **options):
    return list(warc.read_records(io.BytesIO(data).read, **options))


def test_records_round_trip_in_one_member_each():
    pages = [(1, "http://a/ b\r\nX: y", b"<p>hi</p>" * 40_000, None), (2, None, b"", None), (3, "u", b"\x00\xff", None), (4, "u", b"\x00\xff", 3)]
    data = b"".join(warc.page_record(*p) for p in pages)
    assert data.count(b"\x1f\x8b\x08") >= 4 and gzip.decompress(data).count(b"WARC/1.1\r\n") == 4
    got = records(data)
    assert [r.kind for r in got] == ["response"] * 3 + ["revisit"]
    assert [r.http[1] for r in got] == [p[2] for p in pages[:3]] + [b""]
    assert got[0].headers["warc-target-uri"] == "http://a/%20b%0D%0AX:%20y"
    assert got[3].headers["warc-payload-digest"] == "sha1:" + base64.b32encode(hashlib.sha1(b"\x00\xff").digest()).decode()


def test_plain_and_joined_members_are_read():
    data = b"".join(warc.page_record(i, "u", b"x" * i, None) for i in range(5))
    plain = gzip.decompress(data)
    assert [r.block for r in records(plain)] == [r.block for r in records(gzip.compress(plain))] == [r.block for r in records(data)]


def test_members_of_one_record():
    pages = [warc.page_record(i, "u", b"x" * i * 40_000, None) for i in range(4)]
    assert len(records(b"".join(pages), one_each=True)) == 4
    two = gzip.compress(gzip.decompress(pages[1] + pages[2]))
    assert len(records(pages[0] + two)) == 3
    with pytest.raises(ValueError):
        records(pages[0] + two, one_each=True)


def test_damage_is_noticed():
    data = warc.page_record(1, "u", b"payload " * 100, None)
    plain = gzip.decompress(data)
    for bad in (data[:-9], data[: len(data) // 2], plain.replace(b"payload", b"pAyload", 1), plain[:-4], plain.replace(b"Content-Length: 8", b"Content-Length: 7"), b"HTTP/1.1 x\r\n\r\n"):
        with pytest.raises(ValueError):
            records(bad)


def test_pages(spark):
    rows = [(5, "u", "same"), (3, "v", "same"), (9, "w", "same"), (4, "x", ""), (6, None, None), (7, "y", "é" * 100_000), (None, "z", "same"), (None, "z", "lone"), (3, "v", "same")]
    df = spark.createDataFrame([(*r, 0) for r in rows], "page_id long, url string, html string, digest int")
    got = warc.read_pages(spark, warc.write_pages(df)).collect()
    said = sorted((r["page_id"] or -1, r["payload_bytes"], r["record_type"], r["refers_to"] or 0) for r in got)
    assert said == sorted([(5, 4, "revisit", 3), (3, 4, "response", 0), (9, 4, "revisit", 3), (4, 0, "response", 0), (6, 0, "revisit", 4), (7, 200_000, "response", 0), (-1, 4, "revisit", 3), (-1, 4, "response", 0), (3, 4, "response", 0)])
    small = warc.read_pages(spark, warc.write_pages(df, least_bytes=5)).collect()
    assert {r["record_type"] for r in small} == {"response"}
    assert warc.read_pages(spark, warc.write_pages(df.limit(0))).count() == 0
