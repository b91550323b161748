"""N-gram Jaccard join by token-combination prefixes.

A document's set is its distinct 5-word shingles. Shingles are ordered by how many
documents have them (counted over all, in a table of hash buckets whose size is
bounded; any fixed order is right, the counts make it fast), rare ones first.
Of two sets with overlap o or more, the one whose prefix ends first loses at most
size - o of its prefix to the other. Rare shingles are indexed alone and each counts 1; the
frequent ones are dealt into parts by a hash, indexed as pairs within a part, and
c of a part count c - 1. A prefix is extended until it counts more than what can be
lost, so linked sets share an indexed shingle or pair. The number of parts follows
the size (a document uses the scheme of its size band and the next, so any two that
can be linked have one in common). What shares a signature is verified on the sets.

Copies (equal sets) are one class from the start and are joined once. A set of one or
two shingles is linked to its copies only. Texts without words, empty ones and nulls
are linked with nothing. Sets and shingles are 64-bit hashes. Rows with a null id are
documents; their component has the least id that isn't null. Repeated rows each get
their row. Very long texts are one set like others; an empty table gives an empty one. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import _kernel as K
from tidemill.llm import _links as L
from tidemill.llm import _runtime as R

NUM, DEN, WORDS = 75, 100, 5
LEAST_BITS, MOST_BITS, PART, CHUNK = 16, 22, 16, 1 << 14


def text_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    return docs.select(F.col(id_col).alias("i"), F.xxhash64(id_col, F.col(text_col).cast("string")).alias("key"), F.col(text_col).cast("string").alias("t"))


def shingle_sets(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All texts' sets in one array: (members, first of each set and one past the last)."""
    words, first = K.text_words(column)
    return K.segment_sets(words, first[:-1], first[1:], WORDS)


def sizes_and_counts(rows: DataFrame, kind: str, bits: int) -> tuple[DataFrame, np.ndarray]:
    """(i, key, n, fp of each row; bucket counts of the shingles) in one scan."""
    schema = f"chunk int, data binary, i {kind}, key long, n int, fp long, bits binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << bits, np.int32)
        names = ["chunk", "data", "i", "key", "n", "fp", "bits"]
        types = None
        for batch in batches:
            types = batch.schema.field(0).type
            for b in R.pieces(batch, "t"):
                s, first = shingle_sets(b.column(2))
                bucket, times = np.unique((s >> np.uint64(64 - bits)).astype(np.uint32), return_counts=True)
                counts[bucket] += times.astype(np.int32)
                none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
                own = pa.array(np.diff(first).astype(np.int32)), pa.array(K.fingerprints(s, first)), pa.array(L.parity_bits_of(s, first), pa.binary())
                yield pa.record_batch([*none, b.column(0), b.column(1), *own], names=names)
        if types is not None:
            for c in range(0, 1 << bits, CHUNK):
                part = counts[c : c + CHUNK]
                if part.any():
                    above = np.flatnonzero(part > 255).astype(np.int32)
                    data = np.minimum(part, 255).astype(np.uint8).tobytes() + above.tobytes() + part[above].tobytes()
                    yield pa.record_batch([pa.array([c // CHUNK], pa.int32()), pa.array([data], pa.binary()), pa.nulls(1, types), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary())], names=names)
        del counts
        R.relieve()

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(CHUNK, np.int64)
        for x in table.column("data").to_pylist():
            total += np.frombuffer(x, np.uint8, CHUNK)
            at, n = np.frombuffer(x, np.int32, offset=CHUNK).reshape(2, -1)
            total[at] += n - 255
        return pa.table({"chunk": table.column("chunk")[:1], "data": pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())})

    got = R.written(rows.mapInArrow(run, schema), "shingle-sizes")
    counts = np.zeros(1 << bits, np.int32)
    summed = got.where("chunk is not null").select("chunk", "data").groupBy("chunk").applyInArrow(add, "chunk int, data binary")
    for chunk, data in summed.toLocalIterator():  # 2**bits counts: 16 MB at most
        counts[chunk * CHUNK : (chunk + 1) * CHUNK] = np.frombuffer(data, np.int32)
    return got.where("chunk is null").select("i", "key", "n", "fp", "bits"), counts


def parts_of_band(band: int) -> int:
    return max(1, int((4 / 3) ** band / PART))


def band_of(n: int) -> int:
    """Bands of sizes, each 4/3 of the one before; linked sets are in one or in neighbours."""
    b = 0
    while (4**b) * 1 < n * (3**b):
        b += 1
    return b


_SALT = np.uint64(0xA0761D6478BD642F)


def signatures(s: np.ndarray, level: np.ndarray, num: int = NUM, den: int = DEN) -> np.ndarray:
    """What a set is indexed by. `level`: of each shingle, 0 if rare, else higher the more frequent."""
    n = len(s)
    if n < 3:
        return s[:0]
    lost = n - -(-num * n // den)
    rare = s[level == 0]
    if len(rare) > lost:
        return rare[: lost + 1]
    often = level > 0
    f = s[often][np.argsort(level[often], kind="stable")]
    need, out = lost + 1 - len(rare), [rare]
    band = band_of(n)
    for b in (band, band + 1):
        part = ((K.mix(f ^ _SALT) >> np.uint64(32)) % np.uint64(parts_of_band(b))).astype(np.int64)
        _, firsts = np.unique(part, return_index=True)
        counts = np.ones(len(f), np.int64)
        counts[firsts] = 0
        end = int(np.searchsorted(np.cumsum(counts), need)) + 1
        g, p = f[:end], part[:end]
        order = np.argsort(p, kind="stable")
        g, p = g[order], p[order]
        for d in range(1, len(g)):
            hit = np.flatnonzero(p[d:] == p[:-d])
            if not len(hit):
                break
            lo, hi = np.minimum(g[hit], g[hit + d]), np.maximum(g[hit], g[hit + d])
            out.append(K.mix(K.mix(lo) + hi * np.uint64(0x9E3779B97F4A7C15) + np.uint64(b)))
    return np.concatenate(out)


def levels_from(counts: np.ndarray) -> np.ndarray:
    """By bucket: 0 unless the count stands out from what rare shingles alone add up to, else its power of 2."""
    usual = counts.mean() + 3 * np.sqrt(counts.mean()) + L.SMALL / 2
    return np.where(counts <= usual, 0, np.log2(np.maximum(counts, 1)).astype(np.int8) + 1).astype(np.int8)


def _linked(docs: DataFrame, id_col: str, text_col: str, num: int, den: int, flush: int) -> tuple[DataFrame, DataFrame]:
    """Of each row i, key, n and fp; of each set fp, least (id), first (the row with it), copies, and its component's root, null if it has no links."""
    if 4 * num < 3 * den:
        raise ValueError("the bands of sizes and what sets of one or two shingles match hold from 0.75 up")
    spark = docs.sparkSession
    R.ship(spark)
    kind = dict(docs.dtypes)[id_col]
    size = R.input_bytes(docs)
    bits = min(MOST_BITS, max(LEAST_BITS, (size >> 5).bit_length()))
    rows = text_rows(docs, id_col, text_col)
    units, counts = sizes_and_counts(rows, kind, bits)
    level = spark.sparkContext.broadcast(levels_from(counts))
    cells = R.cell_count(spark, size)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = L.Dealer(cells, flush)
        by_bucket = level.value
        for batch in batches:
            for b in R.pieces(batch, "t"):
                s, first = shingle_sets(b.column(2))
                high, fps = by_bucket[(s >> np.uint64(64 - bits)).astype(np.int64)], K.fingerprints(s, first).tolist()
                for fp, x, y in zip(fps, first[:-1].tolist(), first[1:].tolist()):
                    sig = signatures(s[x:y], high[x:y], num, den)
                    if len(sig):
                        yield from dealer.add(L.postings(sig, fp, y - x))
        yield from dealer.flush()
        R.relieve()

    by_class = R.written(units.where("fp <> 0").groupBy("fp").agg(F.min("i").alias("least"), F.min(F.struct(F.col("i").isNull().alias("none"), "i", "key")).alias("first"), F.first("n").alias("n"), F.first("bits").alias("bits"), F.count(F.lit(1)).alias("copies")).withColumn("key", F.col("first.key")), "classes")

    def sets_for(fps: DataFrame) -> DataFrame:
        wanted = R.written(fps.join(by_class.select("fp", "key"), "fp"), "wanted")
        bits_ = spark.sparkContext.broadcast(L.bitmap(wanted))

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(L.in_bitmap(bits_.value, batch.column(1).to_numpy())))
                for b in R.pieces(batch, "t"):
                    s, first = shingle_sets(b.column(2))
                    yield pa.record_batch([pa.array(K.fingerprints(s, first)), b.column(1), K.blobs(s, first)], names=["fp", "key", "members"])

        return rows.mapInArrow(fetch, "fp long, key long, members binary").join(wanted, ["fp", "key"]).select("fp", "members")

    with R.scratch() as keep:
        met = L.candidates(rows.mapInArrow(index, L.SCHEMA), cells)
        roots = keep(L.components(L.links(*met, by_class.select("fp", "n", "bits"), sets_for, num, den)))
    joined = by_class.select("fp", "least", "first", "copies").join(roots.withColumnRenamed("node", "fp"), "fp", "left")
    return units, joined


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", num: int = NUM, den: int = DEN, flush: int = L.FLUSH) -> DataFrame:
    """id_col, n_shingles, component_id of every row. Linked are sets with den * intersection >= num * union; num / den is 0.75 or more."""
    units, joined = _linked(docs, id_col, text_col, num, den, flush)
    merged = joined.where("root is not null")
    least = merged.groupBy("root").agg(F.min("least").alias("component_id"))
    of_class = merged.join(least, "root").select("fp", "component_id").unionByName(joined.where("root is null and copies > 1").select("fp", F.col("least").alias("component_id")))
    out = units.select("i", "n", "fp").join(of_class, "fp", "left")
    return out.select(F.col("i").alias(id_col), F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "i").alias("component_id"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component stays, once: that with the least id (null last; of several with that id, one); texts without words stay."""
    safe, back = R.apart(docs, ("_row", "_rows"))
    units, joined = _linked(safe, "doc_id", "text", NUM, DEN, L.FLUSH)
    first = joined.groupBy(F.coalesce("root", "fp").alias("root")).agg(F.min("first").alias("first")).select(F.col("first.key").alias("key"), F.lit(True).alias("stays"))
    rows = units.groupBy("key").agg(F.count(F.lit(1)).alias("rows"), F.min(F.col("fp") == 0).alias("bare")).join(first, "key", "left")
    kept = R.written(rows.where("bare or stays").select(F.col("key").alias("_row"), F.when(F.col("bare"), 1).otherwise(F.col("rows")).alias("_rows")), "kept")
    out = safe.withColumn("_row", F.xxhash64("doc_id", F.col("text").cast("string"))).join(kept, "_row")
    one = lambda d: back(d.drop("_row", "_rows"))
    if kept.where("_rows > 1").isEmpty():
        return one(out)
    return one(out.where("_rows = 1")).unionByName(one(out.where("_rows > 1").dropDuplicates(["doc_id", "text"])))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op5_ngram_jaccard": query}
ORACLE_SQL = {
    "op5_ngram_jaccard": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n nx ON nx.doc_id = x JOIN n ny ON ny.doc_id = y WHERE 100 * o >= 75 * (nx.n + ny.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(m.m, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT x AS doc_id, min(y) AS m FROM r GROUP BY x) m USING (doc_id)""",
}
