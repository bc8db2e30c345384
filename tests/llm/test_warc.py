import gzip
import hashlib
import io

import pytest

from gaugewright.llm import warc
from gaugewright.llm.shared import opened
from gaugewright.llm.warc import arc_record, convert, read_arc, read_warc, warc_date, write_arc


def arc(version, records):
    return io.BufferedReader(io.BytesIO(warc._version_block(version, "t.arc") + b"".join(records)))


def test_both_versions():
    for version in (1, 2):
        found = list(read_arc(arc(version, [arc_record(version, "http://a/b c", b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\nx"), b"\n", arc_record(version, None, b"raw\n\n")])))
        assert [r.parts for r in found] == [(b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"body\nx"), (b"", b"raw\n\n")]
        assert found[0].fields["URL"] == "http://a/b%20c" and found[1].fields["URL"] == "-"


def test_legacy_url_with_spaces():
    line = b"http://a/b c d 1.2.3.4 19970102030405 text/html 3\nabc\n"
    assert next(read_arc(arc(1, [line]))).fields["URL"] == "http://a/b c d"


def test_spaced_content_type():
    """Spaces in the content type shift no other field, in either version, with or without spaces in the URL."""
    for version, more in ((1, b""), (2, b"200 - - 0 name ")):
        for url in (b"http://a/b", b"http://a/b c d"):
            line = url + b" 1.2.3.4 19970102030405 text/html; charset=utf-8; x=1 " + more + b"3\nabc\n"
            fields = next(read_arc(arc(version, [line]))).fields
            assert (fields["URL"], fields["IP-address"], fields["Archive-date"], fields["Content-type"]) == (url.decode(), "1.2.3.4", "19970102030405", "text/html; charset=utf-8; x=1")


def test_heads():
    """A head ends at the first blank line, whichever line ends it has."""
    for block, parts in ((b"HTTP/1.0 200 OK\nA: b\n\nbody\r\n\r\nmore", (b"HTTP/1.0 200 OK\nA: b\n\n", b"body\r\n\r\nmore")), (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\nbody\n\nmore", (b"HTTP/1.0 200 OK\r\nA: b\r\n\r\n", b"body\n\nmore")), (b"HTTP/1.0 204", (b"HTTP/1.0 204", b""))):
        assert next(read_arc(arc(1, [arc_record(1, "http://a", block)]))).parts == parts


def test_no_archives():
    for data in (b"no arc", warc._version_block(1, "x").replace(b"1 0 ", b"7 0 ")):
        with pytest.raises(ValueError):
            list(read_arc(io.BufferedReader(io.BytesIO(data))))


def test_bad_records_are_left_out(spark, tmp_path):
    """What is wrong is told beside the file; the records around it are converted."""
    good = [arc_record(1, f"http://a/{i}", b"payload %d" % i) for i in range(3)]
    (tmp_path / "a.arc").write_bytes(warc._version_block(1, "a") + good[0] + b"junk line\nmore junk\n" + good[1] + good[2] + b"http://a/9 1.1.1.1 20000101000000 text/html 99\nshort")
    (tmp_path / "b.arc").write_bytes(b"no archive at all")
    (tmp_path / "c.arc").write_bytes(warc._version_block(2, "c") + arc_record(2, "http://c", b"HTTP/1.0 200 OK\nX-Page-Id: 7\n\nhello"))
    files = convert(spark.createDataFrame([(f"file://{tmp_path}/{x}.arc",) for x in "abc"], "path string"))
    errors = sorted([e["number"] for e in r["errors"]] for r in files.collect())
    assert errors == [[], [-1], [1, 4]]
    got = sorted((r["url"], r["payload_bytes"], r["error"], r["page_id"]) for r in read_warc(files).collect())
    assert got == [("http://a/0", 9, None, None), ("http://a/1", 9, None, None), ("http://a/2", 9, None, None), ("http://c", 5, None, 7)]


def test_dates():
    assert warc_date("19970102030405") == "1997-01-02T03:04:05Z"
    assert warc_date("199701") == "1997-01-01T00:00:00Z"
    assert warc_date("junk") == "1970-01-01T00:00:00Z"
    assert warc_date("20001399000000") == "2000-01-01T00:00:00Z"


@pytest.mark.parametrize("size", [1 << 24, 200])
def test_round_trip(spark, monkeypatch, size):
    monkeypatch.setattr(warc, "FILE_BYTES", size)
    big, small = "é<p>" * 400, "tiny"
    rows = [(i, f"http://h/{i}", big if i % 3 == 0 else f"{i}" * 1200 if i % 3 == 1 else small) for i in range(40)]
    rows += [(100, None, None), (101, "", ""), (102, "http://a\nb c", "WARC/1.1\r\n\r\n" * 100), (103, "x", "y" * 200_000), (None, "no id", big), (39, "http://h/39", big)]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, record_type string").repartition(3)
    files = convert(write_arc(pages))
    got = read_warc(files, payloads=True).collect()
    assert len(got) == len(rows)
    copies = {}
    for p, _, html in rows:
        copies.setdefault(html or "", []).append(-1 if p is None else p)
    ids = {r["record_id"]: r for r in got}
    assert len(ids) == len(rows)
    whole = {}
    for r in got:
        data = next((h or "") for p, _, h in rows if p == r["page_id"]).encode()
        assert r["payload_bytes"] == len(data) and r["payload_digest"] == hashlib.sha1(data).hexdigest() and r["date"] == "2000-01-01T00:00:00Z"
        if r["record_type"] == "response":
            assert bytes(r["payload"]) == data and r["refers_to"] is None
            whole.setdefault(data, []).append(r["page_id"])
        else:
            assert len(data) >= 1000 and r["refers_to"] == max(copies[data.decode()]) and ids[r["refers_to_record"]]["record_type"] == "response"
    for html, pages_ in copies.items():
        assert len(whole[html.encode()]) == (1 if len(html.encode()) >= 1000 else len(pages_))
    path = files.first()["path"]
    fs, name = opened(path)
    text = gzip.decompress(fs.open_input_stream(name, compression=None).read())
    assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string, html string")
    assert read_warc(convert(write_arc(pages))).count() == 0
