"""Benchmark decontamination by greedy string tiling.

Documents and test items are sequences of words (A-Z as a-z, ASCII punctuation and
white space apart). Shared seeds of SEED words join them: an item stays a document's
candidate if the item's words inside seeds that the document has reach the
threshold, an upper bound of what tiles can cover. Each candidate is tiled: the longest
common runs of unmarked words, found by a running Karp-Rabin hash of falling
length, are marked, longest first and without overlap, down to SEED words. The
marked share of the item is its coverage, whatever order its parts stand in. A document
is contaminated by the items of which it covers the threshold or more.

The benchmark's seeds are sent to all tasks if there are at most SEEDS of them,
which is counted first; a larger benchmark is taken in blocks of that size, each sent, used
and written before the next. Documents are never compared with each other. Very long texts are
checked whole; an empty table gives an empty one, an empty benchmark finds nothing. Matches are extended word by word: a pair of texts
that both repeat one word thousands of times takes as many steps as the product of their lengths.

Items of fewer than SEED words say too little and match nothing, as do null and empty
ones. Repeated items count as their least id. Null and empty texts are clean. Of items with
equal coverage the least id is the best. Repeated rows each get their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import _kernel as K
from tidemill.llm import _runtime as R

SEED, THRESHOLD, SEEDS = 5, 0.5, 2_000_000
ADDED = ("contaminated", "item_id", "coverage", "n_tiles", "items", "_matches", "_ranked", "_digest")
_BASE, _MOD = 1_000_003, (1 << 61) - 1


def windows(words: list[int], marked: list[bool], size: int) -> Iterator[tuple[int, int]]:
    """(start, hash) of the windows of unmarked words, by a running hash."""
    high = pow(_BASE, size - 1, _MOD)
    h = held = 0
    for i, w in enumerate(words):
        if marked[i]:
            h = held = 0
            continue
        if held == size:
            h = (h - words[i - size] * high) % _MOD
            held -= 1
        h = (h * _BASE + w) % _MOD
        held += 1
        if held == size:
            yield i - size + 1, h


def tiles(item: list[int], text: list[int], least: int) -> list[tuple[int, int, int]]:
    """(start in item, start in text, length) of the greedy tiling's matches."""
    free_i, free_t = [False] * len(item), [False] * len(text)
    out, size = [], min(len(item), len(text))
    while size >= least:
        longest, matches = 0, []
        at: dict[int, list[int]] = {}
        for i, h in windows(item, free_i, size):
            at.setdefault(h, []).append(i)
        for t, h in windows(text, free_t, size) if at else ():
            for i in at.get(h, ()):
                n = 0
                while i + n < len(item) and t + n < len(text) and item[i + n] == text[t + n] and not free_i[i + n] and not free_t[t + n]:
                    n += 1
                if n >= size:
                    longest = max(longest, n)
                    matches.append((n, i, t))
        for n, i, t in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if not any(free_i[i : i + n]) and not any(free_t[t : t + n]):
                free_i[i : i + n] = free_t[t : t + n] = [True] * n
                out.append((i, t, n))
        # what a longer match has covered in part comes again with the next length
        size = size - 1 if size <= 2 * least else max(least, size // 2) if not matches else size - 1
    return out


class Items:
    """Test items' words and their seeds, sorted."""

    def __init__(self, ids: list[int], words: list[np.ndarray]) -> None:
        self.ids, self.words = np.array(ids, np.int64), words
        seeds = [K.grams(w, SEED) for w in words]
        item = np.repeat(np.arange(len(words)), [len(s) for s in seeds])
        place = np.concatenate([np.arange(len(s)) for s in seeds]) if seeds else np.zeros(0, np.int64)
        flat = np.concatenate(seeds) if seeds else np.zeros(0, np.uint64)
        order = np.lexsort((place, item, flat))
        self.seed, self.item, self.place = flat[order], item[order], place[order]
        self.length = np.array([len(w) for w in words], np.int64)

    def coverage(self, words: np.ndarray, threshold: float) -> list[tuple[int, float, int]]:
        """(item id, coverage, tiles) of the items covered by the threshold or more."""
        own = K.grams(words, SEED)
        if not len(own) or not len(self.seed):
            return []
        lo = np.searchsorted(self.seed, own)
        lo[lo == len(self.seed)] = 0
        hit = np.flatnonzero(self.seed[lo] == own)
        if not len(hit):
            return []
        met, first = np.unique(own[hit], return_index=True)
        a, b = np.searchsorted(self.seed, met), np.searchsorted(self.seed, met, "right")
        rows = np.repeat(a, b - a) + np.arange((b - a).sum()) - np.repeat(np.cumsum(b - a) - (b - a), b - a)
        item, place = self.item[rows], self.place[rows]
        out = []
        covered = np.unique((item[:, None] * (1 << 32) + place[:, None] + np.arange(SEED)).ravel()) >> 32
        ids, n = np.unique(covered, return_counts=True)
        near = np.zeros(len(words), bool)
        for k in range(SEED):
            near[np.minimum(hit + k, len(words) - 1)] = True
        for i in ids[n >= threshold * self.length[ids]]:
            seeds = set(K.grams(self.words[i], SEED).tolist())
            at = hit[[x in seeds for x in own[hit].tolist()]]
            mine = np.zeros(len(words) + 1, bool)
            for k in range(SEED):
                mine[at + k] = True
            text: list[int] = []
            for p in np.split(np.flatnonzero(mine), np.flatnonzero(np.diff(np.flatnonzero(mine)) > 1) + 1):
                text += [int(x) % _MOD for x in words[p]] + [-1 - len(text)]
            found = tiles([int(x) % _MOD for x in self.words[i]], text, SEED)
            share = sum(m for _, _, m in found) / int(self.length[i])
            if share >= threshold:
                out.append((int(self.ids[i]), share, len(found)))
        return sorted(out, key=lambda x: (-x[1], x[0]))


def items_of(benchmark: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return benchmark.where(F.col("item_id").isNotNull() & text.isNotNull()).groupBy(text.alias("text")).agg(F.min("item_id").cast("long").alias("item_id"))


def block_count(benchmark: DataFrame, most: int) -> int:
    """How many blocks of about `most` seeds the benchmark has; a seed begins at a word."""
    words = F.size(F.split("text", "[\\x09-\\x0D\\x20-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E]+"))
    return max(1, -(-int(items_of(benchmark).agg(F.sum(words)).first()[0] or 0) // most))


def item_block(benchmark: DataFrame, k: int, n: int) -> Items:
    ids, words = [], []
    for r in sorted(items_of(benchmark).where(F.pmod(F.xxhash64("text"), F.lit(n)) == k).toLocalIterator(), key=lambda r: r.item_id):
        w = next(K.doc_words(pa.array([r.text]), K.PUNCTUATED))
        if len(w) >= SEED:
            ids.append(r.item_id)
            words.append(w)
    return Items(ids, words)


def checked(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD, most: int = SEEDS) -> DataFrame:
    """`docs` with contaminated, item_id (the best item), its coverage and n_tiles, and all items added, in place of columns of these names."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    R.ship(spark)
    out = docs.withColumn("text", F.col("text").cast("string"))
    place, names, n = docs.columns.index("text"), docs.columns, block_count(benchmark, most)
    kind = "array<struct<item_id: long, coverage: double, n_tiles: long>>"

    def matches(held, column: pa.Array) -> pa.Array:
        return pa.array([[{"item_id": i, "coverage": c, "n_tiles": k} for i, c, k in held.value.coverage(words, threshold)] for words in K.doc_words(column, K.PUNCTUATED)], _MATCHES)

    if n == 1:
        held = spark.sparkContext.broadcast(item_block(benchmark, 0, 1))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for b in R.pieces(batch, "text"):
                    yield pa.record_batch([*b.columns, matches(held, b.column(place))], names=[*names, "_matches"])

        out = out.mapInArrow(run, T.StructType([*out.schema.fields, T.StructField("_matches", T._parse_datatype_string(kind))]))
    else:  # a block's items are sent, used and let go before the next one's; what is found goes by the text's digest
        texts, tables = out.where("text is not null").select(F.sha2("text", 256).alias("_digest"), "text"), []
        for k in range(n):
            held = spark.sparkContext.broadcast(item_block(benchmark, k, n))

            def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
                for batch in batches:
                    for b in R.pieces(batch, "text"):
                        yield pa.record_batch([b.column(0), matches(held, b.column(1))], names=["_digest", "_matches"])

            tables.append(R.written(texts.mapInArrow(run, f"_digest string, _matches {kind}").where("size(_matches) > 0"), "matches"))
            held.destroy()
        found = tables[0]
        for t in tables[1:]:
            found = found.unionByName(t)
        found = found.select("_digest", F.explode("_matches").alias("_m")).distinct().groupBy("_digest").agg(F.collect_list("_m").alias("_matches"))
        out = out.withColumn("_digest", F.sha2("text", 256)).join(found, "_digest", "left").select(*names, F.coalesce("_matches", F.array().cast(kind)).alias("_matches"))
    ranked = F.array_sort("_matches", lambda x, y: F.when(x["coverage"] != y["coverage"], F.when(x["coverage"] > y["coverage"], -1).otherwise(1)).otherwise(F.when(x["item_id"] < y["item_id"], -1).when(x["item_id"] > y["item_id"], 1).otherwise(0)))
    best = F.try_element_at("_ranked", F.lit(1))
    out = out.withColumn("_ranked", ranked)
    return out.withColumns({
        "contaminated": F.size("_ranked") > 0, "item_id": best["item_id"], "coverage": F.coalesce(best["coverage"], F.lit(0.0)),
        "n_tiles": F.coalesce(best["n_tiles"], F.lit(0).cast("long")), "items": F.transform("_ranked", lambda m: m["item_id"]),
    }).drop("_matches", "_ranked")


_MATCHES = pa.list_(pa.struct([("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int64())]))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = checked(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return got.select("doc_id", "contaminated", "item_id", F.round("coverage", 6).alias("coverage"), "n_tiles", "items")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that no test item is found in."""
    safe, back = R.apart(docs, ADDED)
    return back(checked(safe, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where("not contaminated"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op6_decontamination": query}
