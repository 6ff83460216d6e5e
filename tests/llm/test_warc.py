import base64
import gzip
import hashlib
import json

import pytest

from tallyline.llm.warc import marked, normalise, read_archives, write_archives

SCHEMA = "page_id long, url string, html string, payload string, same int"


def round_trip(frame, folder, **settings):
    written = write_archives(marked(frame, "page_id", "html", **settings), f"{folder}/whole")
    return written, normalise(written, f"{folder}/records")


def digest(text):
    return base64.b32encode(hashlib.sha1(text.encode()).digest()).decode()


ROWS = [
    (5, "http://a/é?x=\r\nWARC/1.1", "same é"),
    (3, "http://b", "same é"),
    (9, None, "same é"),
    (4, "http://c", ""),
    (7, "http://d", None),
    (8, "http://e", "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"),
    (None, "http://f", "same é"),
    (None, "http://g", "alone"),
    (11, "http://h", "twice"),
    (11, "http://h", "twice"),
    (12, "http://i", "long " * 700_000),
]


@pytest.mark.parametrize("least", [0, 1])
def test_round_trip(spark, folder, least):
    frame = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).repartition(2)
    written, records = round_trip(frame, folder, min_revisit=least)
    got = {}
    for r in read_archives(records, folder, payloads=True).collect():
        got.setdefault(None if r.page_id is None else int(r.page_id), []).append(r)
        assert (r.payload or b"") == (b"" if r.record_type == "revisit" else r.payload)
    assert sum(map(len, got.values())) == len(ROWS)
    for page, url, text in ROWS:
        r = next(r for r in got[page] if r.payload_digest == digest(text or ""))
        assert (r.payload_bytes, r.target_uri) == (len((text or "").encode()), url or "")
        first = {"same é": 3, "": 4 if not least else page}.get(text or "", page)
        assert (r.record_type, r.refers_to) == (("response", None) if first == page else ("revisit", str(first)))
        assert r.payload == ((text or "").encode() if first == page else b"")
    assert [r.record_type for r in got[11]] == ["response"] * 2


def test_files(spark, folder):
    frame = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA).coalesce(1)
    written, records = round_trip(frame, folder)
    (source,), (target,) = written.collect(), records.collect()
    assert source.records == target.records == len(ROWS)
    # One stream before, a member for each record after, the same content.
    whole = open(source.path, "rb").read()
    assert gzip.decompress(whole) == gzip.decompress(open(target.path, "rb").read())
    content = open(target.path, "rb").read()
    index = [json.loads(line) for line in open(f"{target.path}.idx", encoding="utf-8")]
    assert [e["offset"] for e in index] == [sum(x["length"] for x in index[:i]) for i in range(len(index))]
    assert sum(e["length"] for e in index) == len(content) == target.bytes
    for entry in index:
        one = gzip.decompress(content[entry["offset"] : entry["offset"] + entry["length"]])
        assert one.startswith(b"WARC/1.1\r\n") and entry["record_id"].encode() in one


def test_empty(spark, folder):
    frame = spark.createDataFrame([], SCHEMA)
    _, records = round_trip(frame, folder)
    assert read_archives(records, folder).collect() == []
