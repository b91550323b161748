from __future__ import annotations

import base64
import gzip
import hashlib
import random
from urllib.parse import urlparse

from tidemill.llm import warc_shards as W

SCHEMA = "page_id long, url string, html string, refers_to string"


def pages():
    rng = random.Random(4)
    rows = [(i, f"http://x/{i}", "é" * rng.randrange(400) + str(i % 37 if i % 3 else i), "own") for i in range(500)]
    rows += [(10**15, "far", "z", "own"), (-5, "a b\r\nc", "", "own"), (600, None, None, "own"), (None, "n", "z", "own"), (None, "n", "only null", "own"), (7, "again", rows[7][2], "own"), (7, rows[7][1], rows[7][2], "own")]
    return rows


def expected(rows, least):
    out, seen = [], set()
    data = [(i, (h or "").encode()) for i, _, h, _ in rows]
    keep: dict = {}
    for i, b in data:
        keep[b] = max((x for x in (keep.get(b), i) if x is not None), default=None)
    for i, b in data:
        digest = base64.b32encode(hashlib.sha1(b).digest()).decode()
        first = (i, b) not in seen
        response = len(b) < least or i == keep[b] and first
        if i == keep[b]:
            seen.add((i, b))
        out.append((i, len(b), digest, "response" if response else "revisit", None if response else keep[b]))
    return sorted(out, key=repr)


def test_round_trip(spark):
    rows = pages()
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    for least in (0, 100):
        manifest = W.write_archives(df, min_dedup=least, shard_bytes=20_000, roll_bytes=3_000)
        got = W.read_archives(manifest, payloads=True).collect()
        assert sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got), key=repr) == expected(rows, least)
        assert all(r.digest_ok for r in got)
        html = {(i, (h or "").encode()) for i, _, h, _ in rows}
        assert all((r.page_id, bytes(r.payload)) in html for r in got if r.record_type == "response")
        files = manifest.collect()
        assert len({r.shard for r in files}) > 3 and len(files) > len({r.shard for r in files})
        assert sum(r.records for r in files) == len(rows)
    again = W.write_archives(df.repartition(2), min_dedup=100, shard_bytes=20_000, roll_bytes=3_000).collect()
    assert sorted(r[:5] for r in again) == sorted(r[:5] for r in files)
    base = urlparse(files[0].base).path
    import os

    assert sorted(x for x in os.listdir(base) if x != "manifest") == sorted(r.file for r in files)  # no temporary name is left
    ids = []
    for r in sorted(files, key=lambda r: r.file):
        text = gzip.open(f"{base}/{r.file}").read()
        assert text.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
        ids += [int(x.split(b":")[0]) for x in text.split(b"WARC-Record-ID: <urn:x-page:")[1:] if not x.startswith(b"null")]
    assert ids == sorted(ids)


def test_hot_ids_are_cut(spark):
    df = spark.createDataFrame([(None if i % 2 else 3, "u", f"{i}" * 50, "") for i in range(400)], SCHEMA)
    manifest = W.write_archives(df, shard_bytes=2_000)
    assert len({r.shard for r in manifest.collect()}) > 4
    assert W.read_archives(manifest).count() == 400


def test_empty(spark):
    manifest = W.write_archives(spark.createDataFrame([], SCHEMA))
    assert manifest.count() == 0 and W.read_archives(manifest).count() == 0


def test_revisits_name_their_response(spark):
    """A page id stored under many payloads, some of which other pages repeat: headers agree with digests."""
    rows = [(5, "u", f"payload {k}", "") for k in range(8)] + [(i, "v", f"payload {i}", "") for i in range(3)] + [(5, "u", "payload 1", ""), (None, "n", "payload 2", "")]
    files = W.write_archives(spark.createDataFrame(rows, SCHEMA), shard_bytes=100).collect()
    by, refers = {}, []
    for r in files:
        for x in gzip.open(f"{urlparse(r.base).path}/{r.file}").read().split(b"WARC/1.1\r\n")[1:]:
            head = dict(line.split(b": ", 1) for line in x.split(b"\r\n\r\n")[0].split(b"\r\n"))
            if head[b"WARC-Type"] == b"warcinfo":
                continue
            assert head[b"WARC-Record-ID"] not in by
            by[head[b"WARC-Record-ID"]] = (head[b"WARC-Type"], head[b"WARC-Payload-Digest"])
            if b"WARC-Refers-To" in head:
                refers.append((head[b"WARC-Refers-To"], head[b"WARC-Payload-Digest"]))
    assert len(by) == len(rows) and len(refers) == 5
    assert all(by[name] == (b"response", digest) for name, digest in refers)
