from __future__ import annotations

import base64
import gzip
import hashlib
import io

import pytest

from tesserae.llm.warc import list_archives, make_record, members, page_of, parse, read_archives, write_archives


def test_round_trip(spark, tmp_path):
    big = "<p>é</p>" * 30_000
    rows = [(1, "http://a/", big), (3, "http://b/", "x" * 100), (2, "http://c/\r\nX: y", "x" * 100), (4, "http://d/", "x" * 99), (5, "http://e/", "x" * 99), (6, None, None), (7, "", ""), (None, "http://f/", big), (9, "http://g/", big), (3, "http://b/", "x" * 100), (8, "u", "a\r\n\r\nb\x00")]
    pages = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    folder, manifest = write_archives(pages, f"file://{tmp_path}/out")
    found = read_archives(folder, manifest).collect()
    assert len(found) == len(rows)
    text = {(i, u): h for i, u, h in rows}
    first = {}
    for i, _, h in rows:
        if i is not None and h and len(h.encode()) >= 100:
            first[h] = min(first.get(h, i), i)
    for r in found:
        html = next(h for (i, u), h in text.items() if i == r["page_id"])
        raw = (html or "").encode()
        revisit = r["page_id"] is not None and first.get(html, r["page_id"]) != r["page_id"]
        assert (r["payload_bytes"], r["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        assert (r["record_type"], r["refers_to"]) == (("revisit", first[html]) if revisit else ("response", None))
        assert r["payload"] is None if revisit else bytes(r["payload"]) == raw
    for path in (tmp_path / "out").glob("*.gz"):
        assert gzip.decompress(path.read_bytes()).startswith(b"WARC/1.1\r\n")
    folder, manifest = write_archives(pages.limit(0))
    assert read_archives(folder, manifest).count() == 0


def test_framing_and_digests():
    record = make_record(1, "u", b"payload", hashlib.sha256(b"payload").hexdigest(), None)
    assert [page_of(parse(m))[2] for m in members(io.BytesIO(record * 3))] == [7, 7, 7]
    with pytest.raises(ValueError, match="inside a record"):
        list(members(io.BytesIO(record[:-5])))
    plain = gzip.decompress(record)
    with pytest.raises(ValueError, match="block digest"):
        parse(plain.replace(b"payload\r\n\r\n", b"paYload\r\n\r\n"))
    with pytest.raises(ValueError, match="its length"):
        parse(plain + b"more")
    with pytest.raises(ValueError, match="payload differs"):
        page_of(parse(gzip.decompress(make_record(1, "u", b"payload", "0" * 64, None))))


def _foreign(kind, block, **headers):
    lines = [f"WARC-Type: {kind}", "WARC-Record-ID: <urn:uuid:0a1b>", f"Content-Length: {len(block)}", *[f"{k.replace('_', '-')}: {v}" for k, v in headers.items()]]
    return gzip.compress("\r\n".join(["WARC/1.0", *lines]).encode() + b"\r\n\r\n" + block + b"\r\n\r\n")


def test_archives_of_others(spark, tmp_path):
    plain = b"HTTP/1.1 200 OK\r\nContent-Length: 5\r\n\r\nhello"
    sha1 = base64.b32encode(hashlib.sha1(b"hello").digest()).decode()
    chunked = b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n3\r\nhel\r\n2;x=1\r\nlo\r\n0\r\n\r\n"
    own = [
        _foreign("warcinfo", b"software: x\r\n", Content_Type="application/warc-fields"),
        _foreign("request", b"GET / HTTP/1.1\r\n\r\n"),
        _foreign("response", plain, WARC_Target_URI="http://a/", Content_Type="application/http; msgtype=response"),
        _foreign("response", plain, WARC_Payload_Digest=f"sha1:{sha1}", WARC_Block_Digest=f"sha1:{base64.b32encode(hashlib.sha1(plain).digest()).decode()}"),
        _foreign("response", chunked),
        _foreign("response", plain[:-2], WARC_Truncated="length", WARC_Payload_Digest="odd:1"),
        _foreign("resource", b"hello", Content_Type="text/plain"),
        _foreign("revisit", b"", WARC_Payload_Digest=f"sha1:{sha1}", WARC_Refers_To="<urn:uuid:0c>"),
        _foreign("response", b""),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(own))
    (tmp_path / "b.txt").write_bytes(b"no archive")
    found = read_archives(f"file://{tmp_path}", list_archives(spark, f"file://{tmp_path}")).collect()
    whole = hashlib.sha256(b"hello").hexdigest()
    texts = [None if r["payload"] is None else bytes(r["payload"]) for r in found]
    assert texts == [b"hello", b"hello", b"hello", b"hel", b"hello", None, b""]
    assert [r["payload_digest"] for r in found[:3]] == [whole] * 3
    assert (found[5]["payload_digest"], found[5]["payload_bytes"], found[5]["record_type"]) == (sha1, None, "revisit")
    assert {(r["page_id"], r["refers_to"], r["record_id"]) for r in found} == {(None, None, "<urn:uuid:0a1b>")}
    with pytest.raises(ValueError, match="payload differs"):
        page_of(parse(gzip.decompress(_foreign("response", plain, WARC_Payload_Digest="sha1:" + "A" * 32))))
