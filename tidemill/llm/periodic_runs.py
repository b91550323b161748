"""Periodic runs of words by online sparse diagonal DP.

A run is a stretch of consecutive words whose smallest period is q (words q apart are
identical), of length max(`shortest`, `repeats` * q) or more, that no neighbouring word
extends. On the table of a text against itself it is a stretch of the diagonal at lag q:
each word looks up its earlier occurrences, which lengthen the diagonals of their
lags; a diagonal that a word doesn't lengthen has ended, and gives its run at once if it
is long enough.

What keeps the table sparse: no diagonal counts that is shorter than the run's length less
its period, so an occurrence only counts with the `span` words up to it. For
periods in (span / 2, span] that is the nearest one: inside such a run, `span` words
recur at multiples of the period and nowhere else, and with repeats >= 3 the run is longer
than span + period. So each span (a power of two; the least one, for all periods up to it,
is at most shortest / 2) has one active diagonal, and its lag is the smallest period by itself. A
text of n words takes O(n log n) steps, also if it repeats one word. Longer spans look
at texts only in which the span before recurred. The tables of a batch's texts are filled at once.

Words are `[^\\x20\\x09-\\x0D]+`, compared by 64-bit hashes within a text. Null, empty and blank
texts have no words, no runs and an empty `collapsed`. Very long texts are read whole.
Repeated rows each get their row, null ids too; an empty table gives an empty one. Only id and text are read,
so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R

SHORTEST, REPEATS = 24, 3
RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
Run = tuple[int, int, int]


def _stirred(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _doubled(h: np.ndarray, span: int) -> np.ndarray:
    """Hashes of the 2 * span elements that end at each place, from those of span elements."""
    before = np.concatenate((np.zeros(min(span, len(h)), np.uint64), h[: len(h) - span] if len(h) > span else h[:0]))
    return _stirred(h * np.uint64(0x9E3779B97F4A7C15) + before)


def _diagonals(doc: np.ndarray, at: np.ndarray, lag: np.ndarray, span: int, shortest: int, repeats: int) -> Iterator[tuple[int, Run]]:
    """The online part, over the words that recur, in order: one active diagonal, emitted when it ends."""
    text = last = active = -1
    matched = 0
    for d, i, q in zip(doc.tolist(), at.tolist(), lag.tolist()):
        if q == active and i == last + 1 and d == text:
            matched += 1
        else:
            length = matched + active
            if matched and length >= max(shortest, repeats * active):
                yield text, (last + 1 - length, length, active)
            text, active, matched = d, q, span
        last = i
    length = matched + active
    if matched and length >= max(shortest, repeats * active):
        yield text, (last + 1 - length, length, active)


def runs_of(texts: list[list[bytes]], shortest: int = SHORTEST, repeats: int = REPEATS) -> list[list[Run]]:
    """(start, length, period) of every run of each text, by start, then period."""
    if shortest < 2 or repeats < 3:
        raise ValueError("runs have two words and three repeats at least")
    out: list[list[Run]] = [[] for _ in texts]
    size = np.array([len(w) for w in texts], np.int64)
    n = int(size.sum())
    doc = np.repeat(np.arange(len(texts)), size)
    at = np.arange(n) - np.repeat(np.cumsum(size) - size, size)
    h = np.fromiter((hash(w) for text in texts for w in text), np.int64, n).view(np.uint64)
    h = _stirred(h + _stirred(doc.astype(np.uint64)))  # a word is met again in its own text only
    span, least = 1, 1 << ((shortest // 2).bit_length() - 1)
    while n:
        if span >= least:
            whole = np.flatnonzero(at >= span - 1)
            order = whole[np.argsort(h[whole], kind="stable")]
            met = h[order[1:]] == h[order[:-1]]
            later, lag = order[1:][met], at[order[1:][met]] - at[order[:-1][met]]
            near = (lag <= span) & ((2 * lag > span) | (span == least))
            where = np.argsort(later[near])
            where, lags = later[near][where], lag[near][where]
            for d, run in _diagonals(doc[where], at[where], lags, span, shortest, repeats):
                out[d].append(run)
            stay = np.zeros(len(texts), bool)
            stay[doc[later]] = True  # where these words don't recur, twice as many don't
            stay &= size >= repeats * (span + 1)
            mine = stay[doc]
            doc, at, h = doc[mine], at[mine], h[mine]
            n = len(h)
        h = _doubled(h, span)
        span *= 2
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in out]


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words less those that any run has after its first period."""
    if not runs:
        return b" ".join(words)
    kept = np.ones(len(words), bool)
    for start, length, period in runs:
        kept[start + period : start + length] = False
    return b" ".join(w for w, k in zip(words, kept.tolist()) if k)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = SHORTEST, repeats: int = REPEATS) -> DataFrame:
    """id_col, runs (array of start, length, period), collapsed (the text with each run cut to one period)."""
    R.ship(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in R.pieces(batch, "t"):
                texts = [(x or b"").split() for x in b.column(1).cast(pa.binary()).to_pylist()]
                found = runs_of(texts, shortest, repeats)
                cut = pa.array([collapsed(w, r) for w, r in zip(texts, found)], pa.binary()).cast(pa.string())
                yield pa.record_batch([b.column(0), pa.array([[dict(zip(("start", "length", "period"), x)) for x in r] for r in found], pa.list_(RUN)), cut], names=["i", "runs", "collapsed"])

    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.mapInArrow(run, f"i {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("i", id_col)


def _let(value: Column, then: Callable[[Column], Column]) -> Column:
    """`then` of a value that is computed once."""
    return F.transform(F.array(value), then)[0]


def planted(doc_id: Column, text: Column) -> Column:
    """The text with a tail made periodic in documents with crc32(id) % 10 = 0; a null id plants nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)

    def cycled(w: Column) -> Column:
        n = F.size(w).cast("long")
        a = g % n
        p = 1 + F.floor((n - a) / (3 + g % 8))
        of = lambda i: F.get(w, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))
        return F.when(n > 0, F.array_join(F.transform(F.sequence(F.lit(0).cast("long"), n - 1), of), " ")).otherwise(F.lit(""))

    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    return F.when((h % 10 == 0) & text.isNotNull(), _let(words, cycled)).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    got = periodic_runs(docs)
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.reduce("runs", F.get("runs", F.lit(0)), lambda y, x: F.when(longer(x, y), x).otherwise(y))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    return got.withColumn("best", best).select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period", F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op11_periodic_runs": query}

#: Every pair of equal 8-word stretches of a text, cut into unbroken diagonals; those that one of a smaller period covers go.
ORACLE_SQL = {
    "op11_periodic_runs": r"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
    xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) ELSE xor(a >> 1, 3988292384 * (a & 1)) END)) AS h FROM documents),
    e AS (SELECT *, h // 10 AS g, CAST(len(w) AS BIGINT) AS n, CASE WHEN len(w) > 0 THEN (h // 10) % len(w) END AS a FROM d),
    t AS (SELECT rid, doc_id, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[1 + CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END]) ELSE w END AS w FROM e),
    x AS (SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS s FROM t),
    k AS (SELECT rid, i, s || ' ' || lead(s, 1) OVER o || ' ' || lead(s, 2) OVER o || ' ' || lead(s, 3) OVER o || ' ' || lead(s, 4) OVER o || ' ' || lead(s, 5) OVER o || ' ' || lead(s, 6) OVER o || ' ' || lead(s, 7) OVER o AS s
      FROM x WINDOW o AS (PARTITION BY rid ORDER BY i)),
    m AS (SELECT b.rid, b.i - a.i AS q, b.i FROM k a JOIN k b ON a.rid = b.rid AND a.s = b.s AND a.i < b.i),
    y AS (SELECT rid, q, min(i) - q AS start, count(*) + 7 + q AS length FROM (SELECT *, i - row_number() OVER (PARTITION BY rid, q ORDER BY i) AS island FROM m) z GROUP BY rid, q, island HAVING count(*) + 7 + q >= greatest(24, 3 * q)),
    r AS (SELECT * FROM y WHERE NOT EXISTS (SELECT 1 FROM y p WHERE p.rid = y.rid AND p.q < y.q AND p.start <= y.start AND p.start + p.length >= y.start + y.length)),
    s AS (SELECT rid, count(*) AS n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' ORDER BY start, q) AS lines, first(struct_pack(start := start, length := length, q := q) ORDER BY length / CAST(q AS DOUBLE) DESC, start, q) AS best FROM r GROUP BY rid),
    c AS (SELECT rid, string_agg(s, ' ' ORDER BY i) AS kept FROM x WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.rid = x.rid AND x.i >= r.start + r.q AND x.i < r.start + r.length) GROUP BY rid)
    SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, CAST(best.start AS BIGINT) AS start, CAST(best.length AS BIGINT) AS length, CAST(best.q AS BIGINT) AS period, CAST(1000 * best.length // best.q AS BIGINT) AS exponent_milli,
    sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(kept, '')) AS collapsed_sha256 FROM t LEFT JOIN s USING (rid) LEFT JOIN c USING (rid)"""
}
