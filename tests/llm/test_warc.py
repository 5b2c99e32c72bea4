import gzip
import hashlib
import os
import tempfile

import pytest

from ehrflow.llm import warc

PAGES = "page_id long, url string, html string, digest string, part int"


def _pages(spark):
    big, other = "<p>é😀" * 400, "y" * 1000
    rows = [(1, "http://a/ä b\r\nX: y", big), (2, None, big), (9, "http://c", big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""),
            (7, "u", other), (8, "u", other), (8, "v", other), (None, "u", "z" * 2000), (None, "u", big), (10, "u", "q" * 300_000), (11, "u", "x\r\n\r\ny" * 200)]
    return spark.createDataFrame([(*r, "own", 1) for r in rows], PAGES), rows


def _new():
    return tempfile.mkdtemp(prefix="warc-") + "/archive"


def test_round_trip(spark):
    pages, rows = _pages(spark)
    folder = _new()
    manifest = warc.write(pages, folder, roll_bytes=500, shard_bytes=100_000)
    assert manifest.count() > 3 and not [f for f in os.listdir(folder) if f.startswith("_temporary")]
    found = warc.read(spark, folder).collect()
    want = []
    for i, _, html in rows:
        data = (html or "").encode()
        same = [j for j, _, h in rows if h == html and len(data) >= 1000 and j is not None]
        best = max(same) if same else i
        want.append((i, len(data), hashlib.sha1(data).hexdigest(), "response" if i == best else "revisit", None if i == best else best))
    key = lambda r: (r[0] or 0, *map(str, r[1:]))
    assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found), key=key) == sorted(want, key=key)
    assert all(hashlib.sha1(r.payload).hexdigest() == r.payload_digest for r in found if r.record_type == "response")
    for m in manifest.collect():
        data = open(f"{folder}/{m.final}", "rb").read()
        assert len(data) == m.bytes and hashlib.sha256(data).hexdigest() == m.sha256
        assert gzip.decompress(data).count(b"WARC/1.1\r\nWARC-Type: ") == m.records


def test_reruns_give_the_same_bytes(spark):
    pages, _ = _pages(spark)
    made = [sorted((m.final, m.sha256) for m in warc.write(pages, _new(), 500, 100_000).collect()) for _ in range(2)]
    assert made[0] == made[1]


def test_commit_can_run_again(spark):
    pages, _ = _pages(spark)
    folder = _new()
    lines = warc.write(pages, folder)
    again = lines.selectExpr("shard", "roll", "'_temporary-gone' as temporary", "final", "records", "bytes", "sha256")
    assert again.mapInArrow(warc._committer(warc.uri(folder)), warc.MANIFEST_SCHEMA).count() == lines.count()


def test_damage_is_an_error():
    data = warc.record(1, "http://a", b"payload", hashlib.sha1(b"payload").hexdigest(), "response", None)
    assert warc.parse(data)[:4] == (1, 7, hashlib.sha1(b"payload").hexdigest(), "response")
    for broken in (data.replace(b"payload\r", b"paYload\r"), data[:-2]):
        with pytest.raises(ValueError):
            warc.parse(broken)


def test_empty(spark):
    folder = _new()
    assert warc.write(spark.createDataFrame([], PAGES), folder).count() == 0
    assert warc.read(spark, folder).count() == 0


def test_half_written_archive_is_not_read(spark):
    with pytest.raises(Exception):
        warc.read(spark, _new()).count()
