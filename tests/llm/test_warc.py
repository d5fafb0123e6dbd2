import base64
import gzip
import hashlib
import io
import random
from collections import Counter

import pytest

from stagelight.llm import warc as W
from stagelight.sources.scratch import scratch_dir


def b32(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def brute(rows, min_bytes=0):
    """(page_id, payload_bytes, digest, type, refers_to) counts; of repeated rows one is the response."""
    best = {}
    for i, html in rows:
        key = (html or "").encode()
        best[key] = max(best.get(key, -(10**9)), -(10**9) if i is None else i)
    out, used = Counter(), set()
    for i, html in rows:
        p = (html or "").encode()
        first = best[p] == (-(10**9) if i is None else i) and p not in used
        if first or len(p) < min_bytes:
            used.add(p)
            out[i, len(p), b32(p), "response", None] += 1
        else:
            out[i, len(p), b32(p), "revisit", None if best[p] == -(10**9) else best[p]] += 1
    return out


@pytest.fixture(scope="module")
def rows():
    r = random.Random(5)
    texts = ["<p>" + "".join(r.choice("abcé\r\n𝒳 \0") for _ in range(r.randint(0, 300))) for _ in range(40)] + [None, "", "\r\n\r\n", "WARC/1.1\r\n\r\n", "long " * 60_000]
    given = [(i, r.choice(texts)) for i in range(200)] + [(i, "hot page") for i in range(1000, 1150)] + [(5, "again"), (5, "again"), (None, "again"), (None, None), (None, "alone"), (None, "alone")]
    r.shuffle(given)
    return given


def frame(spark, rows):
    return spark.createDataFrame([(i, f"http://h/{i}\r\nX: y z" if i else None, t, "k", 1) for i, t in rows], "page_id long, url string, html string, key string, n_bytes int").repartition(5)


def got(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


@pytest.mark.parametrize("min_bytes", [0, 9, 10**9])
def test_pages_come_back(spark, rows, monkeypatch, min_bytes):
    monkeypatch.setattr(W, "SALTS", 7)
    assert got(W.archived_pages(frame(spark, rows), min_bytes=min_bytes)) == brute(rows, min_bytes)


def test_payloads_and_layout(spark, rows, monkeypatch):
    folder = scratch_dir(spark)
    W.write_warc(frame(spark, rows), folder).write.parquet(f"{folder}/written")
    written = spark.read.parquet(f"{folder}/written")
    records = W.read_warc(written, payloads=True).collect()
    assert Counter((W.page_of(r.record_id), bytes(r.payload)) for r in records if r.type == "response").keys() <= {(None if i is None else str(i), (t or "").encode()) for i, t in rows}
    names = {r.record_id for r in records if r.type == "response"}
    assert all(r.refers_to in names and r.payload is None for r in records if r.type == "revisit")
    assert all("\r" not in (r.target_uri or "") and " " not in (r.target_uri or "") for r in records)
    for a in written.collect():  # any gzip reader sees the whole archive, and each record's member starts at its offset
        body = open(a.archive, "rb").read()
        mine = sorted((r.offset, r.type, r.record_id) for r in records if r.archive == a.archive)
        assert len(body) == a.bytes and len(mine) == a.records and gzip.decompress(body).count(b"WARC/1.1\r\nWARC-Type: ") == a.records
        for (offset, kind, name), end in zip(mine, [*[m[0] for m in mine[1:]], len(body)]):
            text = gzip.decompress(body[offset:end])
            assert text.startswith(f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: {name}\r\n".encode()) and text.endswith(b"\r\n\r\n")


def test_text_ids_and_an_empty_table(spark):
    d = spark.createDataFrame([("*", "x"), ("a:b>%", "x"), ("", "x"), (None, "x"), ("é", "y")], "page_id string, html string")
    folder = scratch_dir(spark)
    W.write_warc(d, folder, url_col=None).write.parquet(f"{folder}/written")
    out = {r.page_id: (r.record_type, r.refers_to) for r in W.page_records(W.read_warc(spark.read.parquet(f"{folder}/written")), "string").collect()}
    assert out == {"a:b>%": ("response", None), "*": ("revisit", "a:b>%"), "": ("revisit", "a:b>%"), None: ("revisit", "a:b>%"), "é": ("response", None)}
    assert W.archived_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def record(payload=b"p" * 200_000):
    return W.page_record("7", 1, "http://x", payload, None, "2024-01-01T00:00:00Z")


def test_reader_is_sequential_and_bounded(monkeypatch):
    monkeypatch.setattr(W, "CHUNK", 97)
    revisit = W.page_record("8", 2, None, b"p" * 200_000, W.record_urn("7", 1), "2024-01-01T00:00:00Z")
    other = W.member([("WARC-Type", "resource"), ("WARC-Record-ID", "<urn:x>"), ("X-Long", "a\r\n b")], [b"plain ", b"block"])
    found = list(W.records_of(io.BytesIO(record() + revisit + other), payloads=True))
    assert [(r["type"], r["payload_bytes"]) for r in found] == [("response", 200_000), ("revisit", 200_000), ("resource", 11)]
    assert found[0]["payload"] == b"p" * 200_000 and found[1]["payload_digest"] == found[0]["payload_digest"] == b32(b"p" * 200_000) and found[2]["payload"] == b"plain block"
    assert [r["offset"] for r in found] == [0, len(record()), len(record() + revisit)]


@pytest.mark.parametrize("old, new, said", [
    (b"pppp", b"pqpp", "digest"), (b"Content-Length: 200", b"Content-Length: 100", "content length"), (b"Length: 2000", b"Length: 9000", "shorter"), (b"WARC/1.1", b"WERC/1.1", "WARC record")])
def test_damage_is_found(old, new, said):
    text = gzip.decompress(record())
    where = text.rindex(old) if old == b"pppp" else text.index(old)
    if b"Length" in old:
        where = text.index(old, text.index(b"WARC-Block-Digest"))
    bad = gzip.compress(text[:where] + new + text[where + len(old) :])
    with pytest.raises(ValueError, match=said):
        list(W.records_of(io.BytesIO(bad)))
    with pytest.raises(ValueError, match="inside a member"):
        list(W.records_of(io.BytesIO(record()[:-9])))
