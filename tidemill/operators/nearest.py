"""Nearest vectors: exact, and approximate by inverted lists."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.shared import fresh

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors needn't have this package

SAMPLE, MOST_LISTS, TURNS = 16_384, 4096, 12
#: Rows of a tile (it has a quarter as many queries), and similarities that are held at once.
TILE, BLOCK = 16_384, 1 << 21


def _unit(x: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(x, axis=1, keepdims=True)
    return x / np.where(n > 0, n, 1)


def _vectors(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def _best(queries: pa.Table, x: np.ndarray, rows: pa.Table, v: np.ndarray, k: int, hidden: Callable[[slice], np.ndarray] | None = None) -> pa.Table:
    """The `k` of greatest cosine (to nine places, NaN first; ties: least id) among `rows` for each of `queries`, columns q and i, whose unit vectors are `x` and `v`:
    null similarities, of rows of NaN that are null vectors, come last. Not itself, nor what is `hidden` from a slice of the queries."""
    schema = pa.schema([("q", queries.schema.field("q").type), ("other", rows.schema.field("i").type), ("similarity", pa.float64())])
    asked, ids = queries.column("q").combine_chunks(), rows.column("i").combine_chunks()
    q_ids, i_ids = (c.to_numpy(zero_copy_only=False) for c in (asked, ids))
    no_x, no_v = (t.column(c).combine_chunks().is_null().to_numpy(zero_copy_only=False) for t, c in ((queries, "x"), (rows, "v")))
    order = np.argsort(i_ids, kind="stable")
    ids, i_ids, v, no_v = ids.take(pa.array(order)), i_ids[order], v[order], no_v[order]
    step, most, out = max(1, BLOCK // max(1, len(ids))), min(k, len(ids)), []
    for at in range(0, len(asked) if most else 0, step):
        some = slice(at, at + step)
        s = np.round(x[some] @ v.T, 9)
        s[np.isnan(s)] = 3
        s[no_x[some]] = -3
        s[:, no_v] = -3
        if hidden is not None:
            s[hidden(some)[:, order]] = -np.inf
        s[q_ids[some, None] == i_ids[None, :]] = -np.inf
        least = np.partition(s, len(ids) - most, axis=1)[:, len(ids) - most]
        r, c = np.nonzero((s >= least[:, None]) & (s > -np.inf))
        first = np.lexsort((c, -s[r, c], r))
        r, c = r[first], c[first]
        top = np.arange(len(r)) - np.searchsorted(r, r) < k
        r, c = r[top], c[top]
        found = s[r, c]
        similarity = pa.array(np.where(found == 3, np.nan, found), mask=found == -3, from_pandas=False)
        out.append(pa.table([asked.take(pa.array(at + r)), ids.take(pa.array(c)), similarity], schema=schema))
    return pa.concat_tables(out) if out else schema.empty_table()


def _ranked(met: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("q").orderBy(F.desc("similarity"), "other")
    return met.withColumn("rk", F.row_number().over(w).cast("long")).where(F.col("rk") <= k).select(F.col("q").alias("query"), "other", "similarity", "rk")


def _parted(key: str, parts: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def _to(parts: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))


def exact(vectors: DataFrame, queries: DataFrame, id_col: str, vector_col: str, k: int) -> DataFrame:
    """query, other, similarity, rk: the `k` vectors of greatest cosine (to nine places; ties: least id) for each query among all, not itself.

    Rows and queries, each dealt by a hash of its id, meet in tiles of TILE rows and a quarter as many queries, a tile by matrix products of
    bounded size in its task. Every pair is compared; a tile gives its best `k` for each query, the best of those are the answer. Vectors
    are of one length; a similarity with a zero vector or an entry that isn't finite is NaN, which is greatest, one with a null vector null, which is least."""
    fine = lambda c: F.when(F.forall(c, lambda e: e.isNotNull()), F.col(c)).alias(c)
    left = queries.select(F.col(id_col).alias("q"), F.col(vector_col).alias("x")).where("q is not null").select("q", fine("x"))
    right = vectors.select(F.col(id_col).alias("i"), F.col(vector_col).alias("v")).where("i is not null").select("i", fine("v"))
    parts, cuts = max(1, -(-vectors.count() // TILE)), max(1, -(-queries.count() * 4 // TILE))

    def vectors_of(column: pa.ChunkedArray) -> np.ndarray:
        column = column.combine_chunks()
        lengths = column.value_lengths().to_numpy(zero_copy_only=False)
        known = column.is_valid().to_numpy(zero_copy_only=False)
        if len(np.unique(lengths[known])) > 1:
            raise ValueError("vectors are not of one length")
        x = np.full((len(column), int(lengths[known][0]) if known.any() else 0), np.nan)
        x[known] = _vectors(column.drop_null())
        with np.errstate(invalid="ignore", divide="ignore"):
            return x / np.linalg.norm(x, axis=1, keepdims=True)

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        x, v = vectors_of(a.column("x")), vectors_of(b.column("v"))
        if x.shape[1] != v.shape[1]:
            if not (np.isnan(x).all() or np.isnan(v).all()):
                raise ValueError("vectors are not of one length")
            x, v = np.full((len(x), 1), np.nan), np.full((len(v), 1), np.nan)
        return _best(a, x, b, v, k)

    a = left.withColumn("cut", _parted("q", cuts)).withColumn("part", _to(parts))
    b = right.withColumn("part", _parted("i", parts)).withColumn("cut", _to(cuts))
    kinds = dict(queries.dtypes)[id_col], dict(vectors.dtypes)[id_col]
    met = a.groupBy("part", "cut").cogroup(b.groupBy("part", "cut")).applyInArrow(best, f"q {kinds[0]}, other {kinds[1]}, similarity double")
    return _ranked(met, k)


def centres(vectors: DataFrame, id_col: str, vector_col: str, lists: int, sample: int = SAMPLE) -> np.ndarray:
    """`lists` unit vectors by spherical k-means of the `sample` rows whose ids hash lowest: a bounded sample, on the driver."""
    rows = vectors.orderBy(F.xxhash64(id_col), id_col).limit(sample).select(vector_col).toArrow()
    x = _unit(_vectors(rows.column(0).combine_chunks()))
    rng = np.random.default_rng(1)
    c = x[rng.choice(len(x), min(lists, len(x)), replace=False)]
    for _ in range(TURNS):
        near = (x @ c.T).argmax(1)
        sums = np.zeros_like(c)
        np.add.at(sums, near, x)
        empty = np.bincount(near, minlength=len(c)) == 0
        sums[empty] = x[rng.choice(len(x), int(empty.sum()))]
        c = _unit(sums)
    return c


class Index:
    """Every vector in the list of its nearest centre; a table in the shared folder. Null vectors, and those that aren't of `dims` finite numbers, are in none."""

    def __init__(self, table: DataFrame, centres: np.ndarray, id_type: str, sizes: dict[int, int]) -> None:
        self.table, self.centres, self.id_type, self.sizes = table, centres, id_type, sizes


def _clean(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    v = F.col(vector_col).cast("array<double>")
    fine = vectors.select(F.col(id_col).alias("i"), v.alias("v")).where(v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    return fine.where(F.size("v") > 0)


def indexed(vectors: DataFrame, id_col: str, vector_col: str, lists: int | None = None, sample: int = SAMPLE) -> Index:
    """Lists: the root of the number of rows if not stated, MOST_LISTS at most; vectors are of one length."""
    spark = vectors.sparkSession
    rows = _clean(vectors, id_col, vector_col)
    lists = lists or int(max(1, min(MOST_LISTS, rows.count() ** 0.5)))
    c = centres(rows, "i", "v", lists, sample)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                near = (_unit(_vectors(b.column(1))) @ c.T).argmax(1)
                yield pa.record_batch([b.column(0), b.column(1), pa.array(near.astype(np.int32))], names=["i", "v", "list"])

    kind = dict(vectors.dtypes)[id_col]
    at = fresh(spark, "inverted-lists")
    rows.mapInArrow(assign, f"i {kind}, v array<double>, list int").write.parquet(at)
    table = spark.read.parquet(at)
    return Index(table, c, kind, {r["list"]: r["count"] for r in table.groupBy("list").count().collect()})


def _shards(sizes: dict[int, int]) -> tuple[dict[int, tuple[int, int]], int]:
    """Each list's first shard and its number of shards, and the number of all: a list of more than TILE rows has some of its own, smaller ones share one."""
    at: dict[int, tuple[int, int]] = {}
    shards, room = 0, 0
    for n in sorted(sizes):
        if sizes[n] > TILE:
            at[n], shards, room = (shards, -(-sizes[n] // TILE)), shards - (-sizes[n] // TILE), 0
            continue
        if sizes[n] > room:
            shards, room = shards + 1, TILE
        at[n], room = (shards - 1, 1), room - sizes[n]
    return at, shards


def search(index: Index, queries: DataFrame, id_col: str, vector_col: str, k: int, probes: int) -> DataFrame:
    """query, other, similarity, rk: the `k` vectors of greatest cosine (to nine places; ties: least id) for each query, in the `probes` lists whose centres are nearest; not itself.

    Lists are dealt to shards of TILE rows on average: a list that holds a third of all rows has many, small ones share one. A query goes once to each shard
    that has some of its lists, with their numbers, and meets the rows there in tiles, a quarter as many queries as rows, by matrix products of
    bounded size. A tile gives its best `k` for each query, the best of those are the answer."""
    c = index.centres
    probes = min(probes, len(c))
    at, _ = _shards(index.sizes)
    base, parts = (np.array([at.get(n, (0, 0))[j] for n in range(len(c))]) for j in (0, 1))
    asked = _clean(queries, id_col, vector_col)
    cuts = max(1, -(-asked.count() * 4 // TILE))

    def probing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for b in (whole.slice(k, 1024) for k in range(0, whole.num_rows, 1024)):
                near = np.argsort(-(_unit(_vectors(b.column(1))) @ c.T), axis=1, kind="stable")[:, :probes]
                lists, rows = near.ravel(), np.repeat(np.arange(b.num_rows), probes)
                times = parts[lists]
                lists, rows = np.repeat(lists, times), np.repeat(rows, times)
                shard = base[lists] + np.arange(len(lists)) - np.repeat(np.cumsum(times) - times, times)
                order = np.lexsort((shard, rows))
                lists, rows, shard = lists[order], rows[order], shard[order]
                starts = np.flatnonzero(np.diff(rows, prepend=-1) | np.diff(shard, prepend=-1))
                ends = np.append(starts, len(lists)).astype(np.int32)
                r = pa.array(rows[starts])
                yield pa.record_batch([b.column(0).take(r), b.column(1).take(r), pa.array(shard[starts].astype(np.int32)), pa.ListArray.from_arrays(ends, pa.array(lists.astype(np.int32)))], names=["q", "x", "shard", "lists"])

    to = index.table.sparkSession.createDataFrame([(n, *v) for n, v in at.items()], "list int, base int, parts int")  # a row a list
    left = asked.mapInArrow(probing, f"q {index.id_type}, x array<double>, shard int, lists array<int>").withColumn("cut", _parted("q", cuts))
    right = index.table.join(F.broadcast(to), "list").select("i", "v", "list", (F.col("base") + F.pmod(F.xxhash64("i"), F.col("parts"))).cast("int").alias("shard"), _to(cuts).alias("cut"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        probed = a.column("lists").combine_chunks()
        here, of = np.unique(b.column("list").to_numpy(), return_inverse=True)
        sees = np.zeros((len(probed), len(c)), bool)
        sees[np.repeat(np.arange(len(probed)), probed.value_lengths().to_numpy()), probed.flatten().to_numpy()] = True
        sees = sees[:, here]
        x, v = (_unit(_vectors(t.column(n).combine_chunks())) if t.num_rows else np.zeros((0, c.shape[1])) for t, n in ((a, "x"), (b, "v")))
        return _best(a, x, b, v, k, lambda some: ~sees[some][:, of])

    met = left.groupBy("shard", "cut").cogroup(right.groupBy("shard", "cut")).applyInArrow(best, f"q {index.id_type}, other {index.id_type}, similarity double")
    return _ranked(met, k)
