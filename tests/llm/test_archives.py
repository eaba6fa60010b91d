import hashlib
import io
import zlib

import pytest

from slopeline.llm.archives import V1_FIELDS, V2_FIELDS, arc_file, arc_records, archive_round_trip, converted, safe_url, squeeze, warc_date, warc_record, warc_records
from slopeline.session import scratch_path

SCHEMA = "page_id long, url string, html string, path string, number int"


def pages():
    big = "<p>" + "x" * 1500 + "</p>"
    rows = [(k, f"http://h{k % 3}.example.com/a b/{k}\n", f"<p>{k} é日</p>" * (k * 20)) for k in range(12)]
    rows += [(20, None, big), (25, "http://x/", big), (22, "", big), (30, "http://x/", None), (31, "http://x/", ""), (None, "http://n/", big), (7, "http://dup/", rows[7][2])]
    return rows


def brute(rows):
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        same = [j for j, _, g in rows if (g or "").encode() == b and j is not None]
        top = max(same) if same else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), len(b) >= 1000 and i != top, top))
    return out


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, "p", 1) for r in pages()], SCHEMA).repartition(3)
    rows = archive_round_trip(df, scratch_path(spark, "arc")).collect()
    assert len(rows) == len(pages())
    for i, n, digest, revisit, top in brute(pages()):
        found = [r for r in rows if r["page_id"] == i and r["payload_digest"] == digest]
        assert found and all(r["payload_bytes"] == n for r in found)
        if i == 7:  # a repeated row: one of the two keeps the payload
            assert sorted(r["record_type"] for r in found) == ["response", "revisit"] and {r["refers_to"] for r in found} == {None, 7}
        else:
            assert [(r["record_type"], r["refers_to"]) for r in found] == [("revisit", top) if revisit else ("response", None)]
    assert len({r["record_id"] for r in rows}) == len(rows)
    none = spark.createDataFrame([], SCHEMA)
    assert archive_round_trip(none, scratch_path(spark, "arc")).count() == 0


@pytest.mark.parametrize("version", [1, 2])
@pytest.mark.parametrize("packed", [True, False])
def test_versions_plain_and_compressed(version, packed):
    data = b"".join(arc_file([(1, "http://a/ b", "<p>é</p>"), (2, None, None)], "f.arc.gz", version, "20010203040506", {"n": 0}))
    raw, rest = b"", data
    while rest:
        z = zlib.decompressobj(31)
        raw += z.decompress(rest)
        rest = z.unused_data
    assert (V1_FIELDS if version == 1 else V2_FIELDS).encode() in raw
    records = list(arc_records(io.BytesIO(data if packed else raw)))
    assert [len(r[1]) for r in records] == [5 if version == 1 else 10] * 3
    assert records[1][1]["URL"] == "http://a/%20b" and records[1][2].endswith("<p>é</p>".encode())
    out = b"".join(converted("f.arc.gz", iter(records), {records[2][0]: ("urn:x", "http://a/", "2001-02-03T04:05:06Z")}, {"n": 0}))
    back = list(warc_records(io.BytesIO(out)))
    assert [h["WARC-Type"] for h, _ in back] == ["warcinfo", "response", "revisit"]
    assert back[1][0]["WARC-Date"] == "2001-02-03T04:05:06Z" and back[2][0]["WARC-Refers-To"] == "<urn:x>"


def test_other_records_and_errors():
    body = b"1 0 crawler\n" + V1_FIELDS.encode() + b"\n\n"
    head = b"filedesc://f 0.0.0.0 20010101 text/plain %d\n" % len(body) + body + b"\n"
    data = head + b"dns:a.example 1.2.3.4 20010101 text/dns 5\n12345\n" + b"ftp://a/x y 1.2.3.4 2001 text/plain 3\nabc\n"
    out = list(warc_records(io.BytesIO(b"".join(converted("f", arc_records(io.BytesIO(data)), {}, {"n": 0})))))
    assert [(h["WARC-Type"], h["Content-Type"], b) for h, b in out[1:]] == [("response", "text/dns", b"12345"), ("resource", "text/plain", b"abc")]
    with pytest.raises(ValueError):
        list(arc_records(io.BytesIO(head + b"http://a/ 1.2.3.4 20010101 text/html 50\nshort\n")))
    with pytest.raises(ValueError):
        list(arc_records(io.BytesIO(b"http://a/ 1.2.3.4 20010101 text/html 5\nshort\n")))
    with pytest.raises(ValueError):
        list(arc_records(io.BytesIO(head.replace(b"1 0 crawler", b"9 0 crawler"))))


def test_headers():
    assert warc_date("2001") == "2001-01-01T00:00:00Z" and warc_date("20010203040506") == "2001-02-03T04:05:06Z"
    assert " " not in safe_url("http://a b\n") and safe_url(None) == "urn:none"
    (h, b), = warc_records(io.BytesIO(squeeze(warc_record([("A", "b: c")], b"\r\n\r\nx"))))
    assert h["A"] == "b: c" and b == b"\r\n\r\nx"


def test_a_page_with_the_url_of_a_file_description_is_kept(spark):
    df = spark.createDataFrame([(1, "filedesc://page.arc", "<p>one</p>"), (2, "http://a/", "<p>two</p>")], "page_id long, url string, html string").coalesce(1)
    rows = archive_round_trip(df, scratch_path(spark, "arc")).collect()
    assert sorted((r["page_id"], r["payload_bytes"], r["record_type"]) for r in rows) == [(1, 10, "response"), (2, 10, "response")]
