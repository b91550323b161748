"""Deterministic sharded WARC writer and reader.

Records are sorted by page id and digest. Shards are ranges of that order: bytes are added up
in BINS equal ranges of it, a range that holds much is parted again until none does, and running
totals over the ranges give the cuts, all in tables, so the same rows give the same files
however they come and however many shards there are. A shard's records go to one task, and there
to gzip members in one file after another; a file is closed once it has
`roll_bytes` compressed bytes. Each record's headers and digests are made from
its payload. A file is written under a temporary name with the task attempt in
it, then moved to its final name; the manifest, written last, lists the
committed files with their sizes and SHA-1. A record is named by its page id, its payload's digest
and its place among repeated rows, so a revisit names its response wherever that is. A task that runs again makes the
same bytes under the same name. The reader opens what the manifest lists.

Of records with equal payloads of at least `min_dedup` bytes the one with the
largest page id is the response, the others are revisits that refer to it. Null
html is an empty payload. Rows with a null page id sort first; among equal
payloads they count as the smallest. Of repeated rows (same id, same payload)
one is the response. A payload is held whole by the task that writes it, one at a time, so a very
long one needs a few times its size there; an empty table gives no file. Only page id, url and html
of the input are read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R

BINS = 4096
SHARD_BYTES, SHARD_MOST, ROLL_BYTES = 16 << 20, 1 << 30, 16 << 20
MANIFEST = "shard long, file string, records long, bytes long, sha1 string"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, digest_ok boolean, payload binary, ordinal long"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def placed(rows: DataFrame) -> DataFrame:
    """`rows` with `key`, a number in the order of (i, k), null ids first, and `path`, the range it is in."""
    key = F.expr("cast(coalesce(cast(i as decimal(20,0)) + 9223372036854775809BD, 0BD) * 4294967296BD + k as decimal(38,0))")
    return rows.withColumns({"key": key, "path": F.lit("")})


def parted(rows: DataFrame, heavy: DataFrame) -> DataFrame:
    """Rows of the ranges in `heavy` (path, lo, hi) go to the BINS ranges that each is cut into."""
    wide = heavy.select("path", "lo", F.expr(f"cast(floor((hi - lo) / {BINS}BD) + 1 as decimal(38,0))").alias("width"))
    step = F.expr("lpad(cast((key - lo) div width as string), 5, '0')")
    return rows.join(wide, "path", "left").withColumn("path", F.when(F.col("lo").isNull(), F.col("path")).otherwise(F.concat("path", step))).drop("lo", "width")


def ranges(rows: DataFrame, shard_bytes: int) -> tuple[list[DataFrame], DataFrame]:
    """What to cut, step by step, and the shard of each range at the end (path, shard).

    No range holds more than a quarter of a shard, unless it is one key (copies of one payload under one id)."""
    cuts, state = [], placed(rows)
    while True:
        held = R.written(state.groupBy("path").agg(F.sum("n").alias("n"), F.min("key").alias("lo"), F.max("key").alias("hi")), "warc-ranges")
        heavy = held.where((F.col("n") > shard_bytes // 4) & (F.col("hi") > F.col("lo")))
        if heavy.isEmpty():
            break
        heavy._tidemill_at = held._tidemill_at
        cuts.append(heavy)
        state = parted(state, heavy)
    # running totals over the first cut's ranges (BINS at most), then inside each of them
    top = held.withColumn("top", F.substring("path", 1, 5))
    tops = top.groupBy("top").agg(F.sum("n").alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = tops.select("top", before(Window.orderBy("top")).alias("base"))
    inner = top.withColumn("inner", before(Window.partitionBy("top").orderBy("path")))
    return cuts, R.written(inner.join(bases, "top").select("path", F.expr(f"(base + inner) div {shard_bytes}").alias("shard")), "warc-shards")


def http(payload: bytes) -> bytes:
    return b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)


def record(page_id: int | None, ordinal: int, url: str, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    name = lambda i, k: f"<urn:x-page:{'null' if i is None else i}:{base32_sha1(payload)}:{k}>"
    block = http(payload) + (b"" if revisit else payload)
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id, ordinal)}", "WARC-Date: 1970-01-01T00:00:00Z",
        "WARC-Target-URI: " + "".join(c if c > " " else f"%{ord(c):02X}" for c in url), "Content-Type: application/http;msgtype=response", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to, 0)}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def gz(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)  # a gzip member without a time stamp
    return z.compress(data) + z.flush()


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri)


class Roller:
    """Writes one shard's files, each under a temporary name until it is whole."""

    def __init__(self, base: str, shard: int, roll_bytes: int, attempt: int) -> None:
        self.fs, self.path = open_fs(base)
        self.shard, self.roll_bytes, self.attempt = shard, roll_bytes, attempt
        self.seq, self.out, self.done = 0, None, []

    def add(self, member: bytes) -> None:
        if self.out is None:
            self.name = f"part-{self.shard:07d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.path}/.{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.n, self.sha = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha1()
            self.add(gz(b"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:x-file:%s>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\nWARC-Filename: %s\r\nContent-Length: 0\r\n\r\n\r\n\r\n" % (self.name.encode(), self.name.encode())))
        self.out.write(member)
        self.sha.update(member)
        self.size += len(member)
        self.n += 1
        if self.size >= self.roll_bytes:
            self.close()

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            self.fs.move(self.temp, f"{self.path}/{self.name}")
            self.done.append((self.shard, self.name, self.n - 1, self.size, self.sha.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def write_archives(pages: DataFrame, base: str | None = None, min_dedup: int = 0, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes all rows of `pages` under `base`, a folder that every machine sees; returns the manifest."""
    spark = pages.sparkSession
    R.ship(spark)
    base = base or R.fresh_dir(spark, "warc")
    at, path = open_fs(base)
    at.create_dir(path, recursive=True)
    rows = pages.select(F.col("page_id").cast("long").alias("i"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "utf-8").alias("p"))
    digest = F.unhex(F.sha1("p"))
    k = F.conv(F.hex(F.substring("d", 1, 4)), 16, 10).cast("long")
    small = R.written(rows.select("i", digest.alias("d"), F.length("p").cast("long").alias("n")).withColumn("k", k), "warc-digests")
    total = small.agg(F.sum("n")).first()[0] or 0
    shard_bytes = max(shard_bytes, min(SHARD_MOST, total // BINS))
    cuts, shards = ranges(small, shard_bytes)
    groups = small.where(F.col("n") >= min_dedup).groupBy("d").agg(F.max("i").alias("keep"), F.count(F.lit(1)).alias("c")).where("c > 1").drop("c")
    members = small.groupBy("i", "d", "k").agg(F.lit(1).alias("one")).join(groups, "d")
    verdicts = members.select("i", "d", "k", F.lit(0).alias("kind"), F.col("keep"), F.lit("").alias("url"), F.lit(None).cast("binary").alias("p"))
    payloads = rows.withColumn("d", digest).withColumn("k", k).select("i", "d", "k", F.lit(1).alias("kind"), F.lit(None).cast("long").alias("keep"), "url", "p")
    both = placed(verdicts.unionByName(payloads))
    for heavy in cuts:
        both = parted(both, heavy)
    both = both.join(shards, "path").drop("path", "key").repartitionById(total // shard_bytes + 1, F.col("shard").cast("int")).sortWithinPartitions(F.col("shard"), F.asc_nulls_first("i"), "k", "d", "kind", "url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt = TaskContext.get().taskAttemptId()
        roller: Roller | None = None
        verdict: tuple | None = None
        last, ordinal, responded = None, 0, None
        for batch in batches:
            for b in R.pieces(batch, "p"):
                for i, d, kind, keep, url, p, s in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("i", "d", "kind", "keep", "url", "p", "shard"))):
                    if kind == 0:
                        verdict = (i, d, keep)
                        continue
                    if roller is None or roller.shard != s:
                        if roller is not None:
                            roller.close()
                            if roller.done:
                                yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "bytes", "sha1"), x)) for x in roller.done], schema=arrow)
                        roller, last = Roller(base, s, roll_bytes, attempt), None
                    ordinal = ordinal + 1 if last == (i, d) else 0
                    last = (i, d)
                    copy = verdict is not None and verdict[:2] == (i, d)
                    revisit = copy and (verdict[2] != i or responded == (i, d))
                    if not revisit:
                        responded = (i, d)
                    roller.add(gz(record(i, ordinal, url, p, verdict[2] if copy else None, revisit)))
        if roller is not None:
            roller.close()
            if roller.done:
                yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "records", "bytes", "sha1"), x)) for x in roller.done], schema=arrow)

    arrow = pa.schema([("shard", pa.int64()), ("file", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha1", pa.string())])
    manifest = both.mapInArrow(run, MANIFEST)
    manifest.write.json(f"{base}/manifest")
    R.drop(small, shards, *cuts)
    return spark.read.schema(MANIFEST).json(f"{base}/manifest").withColumn("base", F.lit(base))


def members(data: bytes) -> Iterator[bytes]:
    """The gzip members' contents; each is fed in parts, so none is scanned to the file's end."""
    view, at = memoryview(data), 0
    while at < len(data):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if at >= len(data):
                raise ValueError("a gzip member is cut off")
            step = view[at : at + (1 << 14)]
            parts.append(z.decompress(step))
            at += len(step) - len(z.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def read_archives(manifest: DataFrame, payloads: bool = False) -> DataFrame:
    """Every record of the manifest's files, its digests computed again from what is stored; RECORDS."""
    R.ship(manifest.sparkSession)
    arrow = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("digest_ok", pa.bool_()), ("payload", pa.binary()), ("ordinal", pa.int64())])
    number = lambda x: None if x == "null" else int(x)

    def one(raw: bytes) -> dict | None:
        f, block = parse(raw)
        if f["WARC-Type"] == "warcinfo":
            return None
        _, name, _, ordinal = f["WARC-Record-ID"][1:-1].rsplit(":", 3)
        said, payload = f["WARC-Payload-Digest"].removeprefix("sha1:"), None
        ok = f["WARC-Block-Digest"] == f"sha1:{base32_sha1(block)}"
        if f["WARC-Type"] == "response":
            payload = block.partition(b"\r\n\r\n")[2]
            ok = ok and base32_sha1(payload) == said
        refers = f.get("WARC-Refers-To")
        return {
            "page_id": number(name), "url": f["WARC-Target-URI"], "payload_bytes": int(f["X-Payload-Length"]) if payload is None else len(payload), "payload_digest": said, "record_type": f["WARC-Type"],
            "refers_to": number(refers[1:-1].rsplit(":", 3)[1]) if refers else None, "digest_ok": ok, "payload": payload if payloads else None, "ordinal": int(ordinal),
        }

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for base, name, sha in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("base", "file", "sha1"))):
                at, path = open_fs(base)
                with at.open_input_stream(f"{path}/{name}", compression=None) as f:
                    data = f.read()
                if hashlib.sha1(data).hexdigest() != sha:
                    raise ValueError(f"{name} is not what the manifest says")
                rows = []
                for raw in members(data):
                    if (x := one(raw)) is not None:
                        rows.append(x)
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    n = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return manifest.repartition(max(n, 8), "file").mapInArrow(run, RECORDS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = read_archives(write_archives(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "digest_ok")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op8_warc_shards": query}
ORACLE_SQL = {
    "op8_warc_shards": r"""
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
h AS (SELECT page_id, octet_length(b) AS n, upper(sha1(b)) AS h, max(page_id) OVER (PARTITION BY b) AS keep FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  CAST((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS INTEGER), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
  CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS digest_ok FROM h""",
}
