import gzip
import hashlib
import zlib

import pytest

from millrace.llm import warc

SCHEMA = "page_id long, url string, html string, keeper long, records int"


def test_round_trip(spark):
    long = "é" * 600
    rows = [(1, "http://a/", "x", 1, 1), (2, "http://b/", "x", 1, 1), (3, None, None, 1, 1), (None, "u\r\nEvil: 1", "", 1, 1), (4, "u", long, 1, 1), (9, "u", long, None, 1), (5, "u", long, 1, 1), (None, "u", long, 1, 1), (9, "u", long, 1, 1), (6, "u", "WARC/1.1\r\n\r\n" * 200_000, 1, 1), (None, "z", "q" * 1000, 1, 1)]
    got = warc.warc_round_trip(spark.createDataFrame(rows, SCHEMA)).collect()
    want = []
    for page, _, html, *_ in rows:
        body = (html or "").encode()
        keeper = None if len(body) < 1000 else max((r[0] for r in rows if r[2] == html and r[0] is not None), default=None)
        again = keeper is not None and keeper != page
        want.append((page, len(body), hashlib.sha1(body).hexdigest(), "revisit" if again else "response", keeper if again else None))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=str) == sorted(want, key=str)
    assert {r.html for r in got if r.record_type == "response"} == {r[2] or "" for r in rows}


def test_empty(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], SCHEMA)).count() == 0


def test_members_and_index(tmp_path):
    raw = [warc.record("response", i, f"http://x/{i}", b"p" * i * 1000, hashlib.sha1(b"p" * i * 1000).digest()) for i in range(30)]
    whole = tmp_path / "whole.warc.gz"
    whole.write_bytes(gzip.compress(b"".join(raw[:10])) + gzip.compress(b"".join(raw[10:])))
    index, n = warc.normalise_archive(whole.as_uri(), (tmp_path / "members.warc.gz").as_uri())
    assert n == 30
    data, at = (tmp_path / "members.warc.gz").read_bytes(), 0
    for one in raw:
        engine = zlib.decompressobj(31)
        assert engine.decompress(data[at:]) == one
        at = len(data) - len(engine.unused_data)
    assert [r["page_id"] for r in warc.read_indexed((tmp_path / "members.warc.gz").as_uri(), index)] == list(range(30))


def test_broken_stream():
    with pytest.raises(ValueError):
        list(warc.split_records([b"WARC/1.1\r\nContent-Length: 5\r\n\r\nab"]))
