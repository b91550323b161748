from __future__ import annotations

import math

import numpy as np
import pytest

from tidemill.llm import embedding_whitening as W

DATA = "/root/testdata/sf0.001"


def brute(rows: list) -> tuple[dict, dict]:
    """By an SVD of all centred rows at once; deviations as Python's whole numbers."""
    good = [(i, tuple(math.floor(64 * float(c)) + 1_000_000 for c in v)) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({x for _, x in good})
    n, sums = len(fit), [sum(c) for c in zip(*fit)]
    a = np.array([[(n * c - s) / n for c, s in zip(x, sums)] for x in fit])
    _, sigma, vt = np.linalg.svd(a, full_matrices=False)
    e, v = sigma**2 / n, vt.T
    out = {}
    for i, x in good:
        dev = [n * c - s for c, s in zip(x, sums)]
        out.setdefault(i, []).append((sum(y * y for y in dev), np.array([y / n for y in dev]) @ v))
    return out, {"n": n, "e": e}


def check(got: list, rows: list, count: int) -> None:
    out, fit = brute(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.vec_id, {}).setdefault(r.component, []).append(r)
    assert set(by) == set(out)
    sign = {}
    biggest = {k: max(out, key=lambda i: abs(out[i][0][1][k - 1])) for k in range(1, count + 1)}
    for k, i in biggest.items():
        sign[k] = math.copysign(1, out[i][0][1][k - 1] * by[i][k][0].whitened)
    for i, parts in by.items():
        assert set(parts) == set(range(1, count + 1))
        for k, rs in parts.items():
            assert len(rs) == len(out[i])
            for r in rs:
                assert (r.n, r.deviation) == (fit["n"], out[i][0][0] if out[i][0][0] < 2**63 else None)
                assert r.whitened == pytest.approx(sign[k] * out[i][0][1][k - 1] / math.sqrt(fit["e"][k - 1]), abs=1e-7)
                assert r.explained == pytest.approx(fit["e"][k - 1] / fit["e"].sum(), rel=1e-9) and 0 <= r.identity_error < 1e-9
    assert len({r.identity_error for r in got}) == 1


def test_query(spark):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{DATA}/embeddings.parquet").collect()]
    check(W.query(spark, DATA).collect(), rows, 16)


def test_bad_rows_copies_and_clashing_names(spark):
    rng = np.random.default_rng(12)
    v = rng.normal(size=(80, 6)) @ np.diag([9, 5, 3, 2, 1, 0.5])
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(v)] + [(200 + i, [float(c) for c in v[3]]) for i in range(300)]
    rows += [(5, [float(c) for c in v[5]]), (None, [float(c) for c in v[7]]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (902, [float("nan")] * 6), (903, [float("-inf")] + [0.0] * 5)]
    df = spark.createDataFrame([(*r, 1, "c") for r in rows + [(904, []), (905, [1.0] * 7)]], "vec_id long, embedding array<double>, n int, component string")
    check(W.whitened(df).collect(), rows, 6)
    assert W.whitened(df.limit(0)).collect() == []
    assert W.whitened(df.where("vec_id between 200 and 400")).collect() == []


def test_conditions_and_ranks(spark):
    """Directions 1e5 times as wide as others, and a table of rank 3 in 5 dimensions."""
    rng = np.random.default_rng(4)
    wide = rng.normal(size=(300, 4)) @ np.diag([1e5, 1e3, 10, 1]) @ np.linalg.qr(rng.normal(size=(4, 4)))[0]
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(wide)]
    got = W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    check(got, rows, 4)
    low = rng.integers(-9, 9, (60, 3)) @ rng.integers(-3, 3, (3, 5))
    rows = [(i, [float(c) for c in x]) for i, x in enumerate(low)]
    check(W.whitened(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect(), rows, 3)


def test_exact_beyond_a_long():
    x = np.array([[2**51, -(2**51)], [0, 5]])
    n, sums = 3_000_000_000, [7, -9]
    assert [[int(y) for y in r] for r in W.deviations(x, n, sums)] == [[n * 2**51 - 7, -n * 2**51 + 9], [-7, 5 * n + 9]]
