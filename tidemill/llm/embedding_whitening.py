"""Embedding whitening by shifted CholeskyQR.

The centred rows A are orthogonalised in passes over the fit list: each pass sums the Gram
matrix G of A R1^-1 ... Rk^-1 (every task solves its rows against the triangular factors and
adds up its own d x d matrix; the matrices are summed by row of G), and the driver takes
R(k+1) = chol(G + shift). The first shift makes G positive definite whatever its condition, later ones are
of the order of rounding, and there is none once G is close to the identity. Passes end when
G is a projection to rounding (the identity, if A has full rank; its trace is the rank). With R = Rk ... R1,
A'A = R'R, so the SVD of R alone gives the components (right singular vectors) and
eigenvalues (squares over n). No covariance matrix is formed and squared conditions don't matter.

Whole numbers stand for the entries: x = floor(scale * c) + offset, c as double. The fit list
has each distinct x vector once; its count n and sums S are exact, and a centred entry is the
exact whole number n * x - S, divided by n.

What the driver and each task hold is d x d, d the dimension; rows never meet in one place.
Copies go before the shuffle that finds distinct vectors (a hot vector is one row a task).

Rows whose vector is null, is empty, or holds null or non-finite entries or entries whose x has more than
52 bits, are dropped, and so are those of another length than most distinct vectors have (ties: the
longer). Repeated rows each get their rows, null ids too. Directions without variance are no
components: with rank r, components end at r. One distinct vector only, or an empty table: no
rows. A deviation that no long holds is null. Only id and vector are read, so other columns may have any name.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R

SCALE, OFFSET, COMPONENTS = 64.0, 1_000_000, 16
PASSES, WITHIN = 12, 1e-12
EPS = float(np.finfo(float).eps)


@dataclass
class Whitening:
    n: int
    sums: list[int]
    components: np.ndarray  # a column each
    eigenvalues: np.ndarray
    trace: float
    passes: int


def whole_numbers(rows: DataFrame, id_col: str, vector_col: str, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """i, x: x has a vector's whole numbers as 64-bit little-endian bytes."""
    kind = dict(rows.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = b.column(1)
            at, size = pc.list_parent_indices(vectors).to_numpy(), pc.fill_null(pc.list_value_length(vectors), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            c = pc.fill_null(pc.list_flatten(vectors).cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
            good = np.isfinite(c)
            scaled = np.floor(scale * np.where(good, c, 0.0))
            good &= np.abs(scaled) < 2.0**52 - abs(offset)
            x = np.where(good, scaled, 0).astype("<i8") + offset
            fine = (size > 0) & (np.bincount(at, weights=~good, minlength=len(size)) == 0)
            ends = np.cumsum(size) * 8
            raw = x.tobytes()
            packed = [raw[e - 8 * n : e] for e, n in zip(ends[fine].tolist(), size[fine].tolist())]
            yield pa.record_batch([b.column(0).filter(pa.array(fine)), pa.array(packed, pa.binary())], names=["i", "x"])

    good = rows.select(F.col(id_col).alias("i"), F.col(vector_col).cast("array<double>").alias("v"))
    return good.mapInArrow(run, f"i {kind}, x binary")


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<i8").reshape(-1, d)


def _in_parts(batches: Iterator[pa.RecordBatch], column: int, d: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    rows = max(1, (4 << 20) // (8 * d))
    for b in batches:
        for k in range(0, b.num_rows, rows):
            part = b.slice(k, rows)
            yield part, _matrix(part.column(column), d)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, as whole numbers of any size."""
    if len(x) and n * int(np.abs(x).max()) + max(map(abs, sums)) < 2**62:
        return n * x - np.array(sums, np.int64)
    return n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return (deviations(x, n, sums) / n).astype(float)


def _totals(fit: DataFrame, d: int) -> tuple[int, list[int]]:
    """n and the exact sums; the high and low halves of each number are added up apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for _, x in _in_parts(batches, 0, d):
            n, high, low = n + len(x), high + (x >> 24).sum(0), low + (x & 0xFFFFFF).sum(0)
        yield pa.record_batch([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high), pa.array(low)], names=["j", "n", "high", "low"])

    rows = fit.select("x").mapInArrow(run, "j long, n long, high long, low long").groupBy("j").agg(*(F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("n", "high", "low"))).collect()
    by = {r.j: r for r in rows}
    return int(by[0].n) if by else 0, [(int(by[j].high) << 24) + int(by[j].low) for j in range(d)] if by else []


def _gram(fit: DataFrame, d: int, width: int, values: Callable[[np.ndarray], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """V'V and the sums of V's columns, V = `values` of the fit list: a task sends a row of V'V for each of V's columns, whatever it has read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g, s = np.zeros((width, width)), np.zeros(width)
        for _, x in _in_parts(batches, 0, d):
            v = values(x)
            g += v.T @ v
            s += v.sum(0)
        yield pa.record_batch([pa.array(np.arange(width)), pa.array(list(np.column_stack((g, s))), pa.list_(pa.float64()))], names=["j", "g"])

    sums = fit.select("x").mapInArrow(run, "j long, g array<double>").groupBy("j").agg(*(F.sum(F.get("g", F.lit(k))).alias(f"g{k}") for k in range(width + 1)))
    out = np.zeros((width, width + 1))
    for r in sums.collect():
        out[r[0]] = r[1:]
    g = out[:, :width]
    return (g + g.T) / 2, out[:, width]


def _solved(a: np.ndarray, factors: list[np.ndarray]) -> np.ndarray:
    """A R1^-1 R2^-1 ..., by a triangular solve for each factor."""
    for r in factors:
        q = np.empty_like(a)
        for j in range(a.shape[1]):  # forward, column by column
            q[:, j] = (a[:, j] - q[:, :j] @ r[:j, j]) / r[j, j]
        a = q
    return a


def _factor(g: np.ndarray, shift: float) -> np.ndarray:
    while True:
        try:
            return np.linalg.cholesky(g + shift * np.eye(len(g))).T
        except np.linalg.LinAlgError:
            shift = max(shift, EPS * float(np.trace(g))) * 10


def orthogonalised(fit: DataFrame, d: int, n: int, sums: list[int]) -> tuple[np.ndarray, int, int]:
    """R with A'A = R'R of the centred fit list A, the rank of A, and the number of passes."""
    factors: list[np.ndarray] = []
    for k in range(PASSES):
        done = tuple(factors)
        g, _ = _gram(fit, d, d, lambda x: _solved(centred(x, n, sums), list(done)))
        if not np.trace(g) > 0:
            return np.zeros((d, d)), 0, k + 1
        near = float(np.abs(g - np.eye(d)).max()) < 0.5
        factors.append(_factor(g, 11 * d * (d + 1) * EPS * float(np.trace(g)) if not k else 0.0 if near else d * EPS))
        if k and np.abs(g @ g - g).max() < WITHIN:
            break
    r = np.eye(d)
    for f in factors:
        r = f @ r
    return r, round(float(np.trace(g))), k + 1


def fitted(xs: DataFrame, components: int = COMPONENTS) -> tuple[Whitening | None, DataFrame, int]:
    """The whitening of `whole_numbers`, its fit list (a table in the shared folder) and the dimension."""
    fit = R.written(xs.select("x").distinct(), "whitening-fit")
    lengths = fit.groupBy(F.octet_length("x").alias("b")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("b")).first()
    if lengths is None:
        return None, fit, 0
    d = lengths.b // 8
    same = fit.where(F.octet_length("x") == 8 * d)
    n, sums = _totals(same, d)
    r, rank, passes = orthogonalised(same, d, n, sums)
    _, sigma, vt = np.linalg.svd(r)
    kept = min(components, rank, int((sigma > sigma[0] * d * EPS * 8).sum()))
    if not kept:
        return None, same, d
    return Whitening(n, sums, vt[:kept].T, sigma[:kept] ** 2 / n, float((sigma**2).sum() / n), passes), same, d


def identity_error(w: Whitening, fit: DataFrame, d: int) -> float:
    """The largest entry of the whitened fit list's covariance less the identity."""
    g, s = _gram(fit, d, len(w.eigenvalues), lambda x: (centred(x, w.n, w.sums) @ w.components) / np.sqrt(w.eigenvalues))
    return float(np.abs(g / w.n - np.outer(s, s) / w.n**2 - np.eye(len(s))).max())


def whitened(rows: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS, scale: float = SCALE, offset: int = OFFSET) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained, identity_error: a row for each good vector and component."""
    spark = rows.sparkSession
    R.ship(spark)
    kind = dict(rows.dtypes)[id_col]
    xs = whole_numbers(rows, id_col, vector_col, scale, offset)
    w, fit, d = fitted(xs, components)
    schema = f"i {kind}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if w is None:
        R.drop(fit)
        return spark.createDataFrame([], schema).withColumnRenamed("i", id_col)
    error = identity_error(w, fit, d)
    R.drop(fit)
    k, explained = len(w.eigenvalues), w.eigenvalues / w.trace

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, x in _in_parts(batches, 1, d):
            dev = deviations(x, w.n, w.sums)
            if len(dev) and d * float(np.abs(dev).max()) ** 2 < 2.0**62:
                square = pa.array((dev.astype(np.int64) ** 2).sum(1))
            else:
                square = pa.array([y if (y := sum(int(e) ** 2 for e in row)) < 2**63 else None for row in dev], pa.int64())
            y = ((dev / w.n).astype(float) @ w.components) / np.sqrt(w.eigenvalues)
            rows = np.repeat(np.arange(len(x)), k)
            yield pa.record_batch(
                [b.column(0).take(pa.array(rows)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(rows), w.n)), square.take(pa.array(rows)), pa.array(y.ravel()), pa.array(np.tile(explained, len(x))), pa.array(np.full(len(rows), error))],
                names=["i", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return xs.where(F.octet_length("x") == 8 * d).mapInArrow(run, schema).withColumnRenamed("i", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op12_embedding_whitening": query}
