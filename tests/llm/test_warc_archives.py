import gzip
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import warc
from ledgerloom.llm.common import scratch_path


def record(kind, rid, block, more=(), content_type="application/http; msgtype=response"):
    head = [b"WARC/1.1", b"WARC-Type: " + kind.encode(), f"WARC-Record-ID: <urn:uuid:{rid}>".encode(), b"WARC-Date: 2020-05-05T00:00:00Z", *more, f"Content-Type: {content_type}".encode(), f"Content-Length: {len(block)}".encode()]
    return b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n"


def http(body, length=True):
    return b"HTTP/1.1 200 OK\r\n" + (f"Content-Length: {len(body)}\r\n".encode() if length else b"X-Way: 1\r\n") + b"\r\n" + body


def page(i):
    return f"WARC-Page-ID: {i}".encode()


LATIN = "caf\xe9 \xff\x00 page".encode("latin-1") * 3
ARCHIVE = [
    record("warcinfo", "info", b"software: x\r\n", content_type="application/warc-fields"),
    # A revisit with a smaller id than its response, one whose original is elsewhere, one that says nothing of itself.
    record("revisit", "r1", http(b"", False)[: -len(b"")] or b"", [page(1), b"WARC-Payload-Digest: sha1:" + warc._sha1(b"<p>body</p>").encode(), b"WARC-Profile: " + warc.PROFILE.encode(), b"WARC-Refers-To: <urn:uuid:gone>"]),
    record("response", "r2", http(b"<p>body</p>"), [page(2), b"WARC-IP-Address: 10.0.0.1", b"WARC-Block-Digest: sha1:OLD"]),
    record("revisit", "foreign", b"HTTP/1.1 200 OK\r\nContent-Length: 77\r\n\r\n", [page(3), b"WARC-Payload-Digest: sha1:ELSEWHERE", b"WARC-Refers-To: <urn:uuid:far>"]),
    record("revisit", "mute", b"", [page(4)], "text/plain"),
    record("request", "q1", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", [b"WARC-Concurrent-To: <urn:uuid:r2>"], "application/http; msgtype=request"),
    record("request", "q2", b"GET / HTTP/1.1\r\nHost: a\r\n\r\n", [b"WARC-Concurrent-To: <urn:uuid:r5>"], "application/http; msgtype=request"),
    record("response", "r5", http(b"<p>body</p>", False), [page(5)]),
    record("response", "r6", http(LATIN), [page(6), b"X-Note: caf\xe9"]),
    record("response", "r7", http(LATIN), [page(7)]),
    record("metadata", "m", b"\xff\xfe\r\n\r\nWARC/1.1\r\n\r\n", [], "application/octet-stream"),
    record("resource", "res", b"<p>body</p>", [page(8)], "text/html"),
]


def all_records(spark, path):
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content").collect()
    return {r.get("warc-record-id")[10:-1]: r for f in files for r in warc.records(bytes(f.content))}


@pytest.mark.parametrize("members", [False, True])
def test_archives_with_revisits_lose_nothing(spark, tmp_path, members):
    given = b"".join(gzip.compress(r) for r in ARCHIVE) if members else gzip.compress(b"".join(ARCHIVE))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.warc.gz").write_bytes(given)
    before = {r.get("warc-record-id")[10:-1]: r for r in warc.records(given)}
    first, second = scratch_path(spark, "w"), scratch_path(spark, "w")
    warc.dedupe_archives(spark, f"file://{tmp_path}/in", first)
    warc.dedupe_archives(spark, first, second)
    for path in (first, second):
        after = all_records(spark, path)
        assert set(after) == set(before)
        for name in ("info", "foreign", "mute", "q1", "q2", "m", "res"):
            assert (after[name].fields, after[name].block) == (before[name].fields, before[name].block), name
        assert {n: after[n].kind for n in ("r1", "r2", "r5", "r6", "r7")} == {"r1": "revisit", "r2": "response", "r5": "revisit", "r6": "response", "r7": "revisit"}
        assert after["r2"].http()[1] == b"<p>body</p>" and after["r6"].http()[1] == LATIN and after["r6"].get("x-note") == "caf\udce9"
        assert after["r2"].get("warc-ip-address") == "10.0.0.1" and after["r2"].get("warc-date") == "2020-05-05T00:00:00Z"
        assert after["r2"].get("warc-block-digest") == "sha1:" + warc._sha1(after["r2"].block)
        for name, of in (("r1", "r2"), ("r5", "r2"), ("r7", "r6")):
            assert after[name].get("warc-refers-to") == f"<urn:uuid:{of}>" and after[name].get("warc-refers-to-page-id") == of[1:]
            assert after[name].get("warc-payload-digest") == "sha1:" + warc._sha1(after[of].http()[1])
        headers = {r.record_id[10:-1]: r for r in warc.read_headers(spark, path).collect()}
        assert (headers["r5"].payload_bytes, headers["r7"].payload_bytes, headers["foreign"].payload_bytes) == (11, len(LATIN), 77)
        assert headers["mute"].payload_bytes is None and headers["mute"].payload_digest is None and headers["foreign"].payload_digest == "ELSEWHERE"
        assert headers["r7"].refers_to == "6" and headers["res"].record_type == "resource"


def test_pages_of_bytes_and_small_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rng = random.Random(3)
    rows = [(i, "u", bytes(rng.randrange(256) for _ in range(1000)) if i % 3 else b"\xe9same") for i in range(30)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html binary")
    raw, out = scratch_path(spark, "w"), scratch_path(spark, "w")
    warc.write_archives(pages, raw)
    assert spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(raw).count() >= 6
    monkeypatch.setattr(warc, "BROADCAST_REVISITS", 2)  # archives and lists meet by shuffle
    warc.dedupe_archives(spark, raw, out)
    kept = {int(r.get("warc-page-id")): r for r in all_records(spark, out).values()}
    assert {i for i, r in kept.items() if r.kind == "revisit"} == {i for i in range(3, 30, 3)}
    assert all(kept[i].http()[1] == body for i, _, body in rows if i % 3 or i == 0)
    assert warc.read_headers(spark, out).where(F.col("record_type") == "revisit").select("refers_to").distinct().collect()[0][0] == "0"


def test_records_as_a_stream():
    data = b"".join(record("resource", str(i), bytes([i]) * (5000 * i), content_type="text/plain") for i in range(12))
    for archive in (gzip.compress(data), gzip.compress(data[:9000]) + gzip.compress(data[9000:])):
        got = list(warc.records(archive, chunk=777))
        assert [r.block for r in got] == [bytes([i]) * (5000 * i) for i in range(12)]
        assert all(data[r.offset :].startswith(b"WARC/1.1") for r in got)
    with pytest.raises(ValueError):
        list(warc.records(gzip.compress(b"nothing\r\n\r\n")))
