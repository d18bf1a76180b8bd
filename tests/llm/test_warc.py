"""ARC -> WARC: round trips, both header versions, revisits."""

import base64
import hashlib

import pytest

from credence.llm import warc


def expected(rows, min_bytes=0):
    top = {}
    for page, _, html in rows:
        if page is not None:
            top[html or ""] = max(page, top.get(html or "", page))
    out = []
    for page, _, html in rows:
        data, to = (html or "").encode(), top.get(html or "")
        revisit = len(data) >= min_bytes and to is not None and page != to
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


ODD = [(1, "http://a/x y\n", "<p>é</p>"), (2, None, None), (3, "u", ""), (4, "u", "same"), (9, "u", "same"), (9, "u", "same"), (None, "u", "same"), (None, None, "alone"), (5, "u", "http://x 1 2 text/html 9\n\n\r\n\r\nWARC/1.1\r\n"), (6, "u", "z" * 3_000_000)]


def test_whole_table(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert got(warc.round_trip(spark, pages)) == expected([tuple(r) for r in pages.select("page_id", "url", "html").collect()])


@pytest.mark.parametrize("size", [32 << 20, 10])
@pytest.mark.parametrize("least", [0, 5])
def test_odd_rows(spark, monkeypatch, size, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", size)
    df = spark.createDataFrame([(*r, "x") for r in ODD], "page_id long, url string, html string, record_type string")
    assert got(warc.round_trip(spark, df, min_bytes=least)) == expected(ODD, least)
    assert got(warc.round_trip(spark, df.limit(0))) == []


@pytest.mark.parametrize("version", [1, 2])
def test_header_versions_and_declared_lengths(version):
    data = warc.arc_header(version, "a.arc", "20010203") + warc.arc_record(version, "http://h/ a", "200102", "404", b"HTTP/1.0 404 no\r\nX: y\r\n\r\nbody\n\n") + warc.arc_record(version, "dns:h", "20010203040506", "200", b"plain\n", ip="1.2.3.4", kind="text/dns")
    a, b = warc.parse_arc(data)
    assert (a.version, a.uri, a.status, a.payload, b.ip, b.kind, b.http, b.payload) == (version, "http://h/%20a", "404", b"body\n\n", "1.2.3.4", "text/dns", b"", b"plain\n")
    (head, block), (again, _) = warc.parse_warc(warc.packed(warc.to_warc(a, "a.arc", 0, None)) + warc.packed(warc.to_warc(a, "a.arc", 1, ("a.arc", 0, a.uri, a.date, 7))))
    assert head["warc-date"] == "2001-02-01T00:00:00Z" and block == a.http + a.payload and head["warc-payload-digest"] == "sha1:" + warc.digest(b"body\n\n")
    assert again["warc-type"] == "revisit" and again["warc-refers-to"] == head["warc-record-id"] and again["content-length"] == str(len(a.http))
    with pytest.raises(ValueError, match="declares"):
        list(warc.parse_arc(data[:-3]))
    with pytest.raises(ValueError, match="version block"):
        list(warc.parse_arc(b"http://x 0.0.0.0 20010101000000 text/html 3\n9 0\n"))
