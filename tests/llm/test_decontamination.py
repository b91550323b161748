from __future__ import annotations

import random

from tidemill.llm import decontamination as D

W = [f"w{i}" for i in range(40)]


def test_documents(spark):
    docs = [
        (1, " ".join(W[20:] + ["x"] * 30 + W[:20])), (2, " ".join(W[:19])), (3, None), (4, ""), (5, (", ".join(W[35:] + W[10:30] + W[30:35] + W[0:10])).upper()), (6, " ".join(W)), (6, " ".join(W)),
        (None, "a b " + " ".join(W)), (7, "v " * 20_000 + " ".join(W[:21])), (8, "a b"),
    ]
    items = [(7, " ".join(W)), (3, "a b"), (9, None), (None, " ".join(W)), (8, " ".join(W)), (11, "")]
    df = spark.createDataFrame([(*d, "own") for d in docs], "doc_id long, text string, items string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (10, 2_000_000):
        got = sorted(((r.doc_id or 0, r.contaminated, r.item_id, round(r.coverage, 3), r.n_tiles) for r in D.checked(df, bench, most=most).collect()), key=repr)
        assert got == sorted(
            [(0, True, 7, 1.0, 1), (1, True, 7, 1.0, 2), (2, False, None, 0.0, 0), (3, False, None, 0.0, 0), (4, False, None, 0.0, 0), (5, True, 7, 1.0, 3), (6, True, 7, 1.0, 1), (6, True, 7, 1.0, 1), (7, True, 7, 0.525, 1), (8, False, None, 0.0, 0)], key=repr
        )
    assert {r.contaminated for r in D.checked(df, bench.limit(0)).collect()} == {False}
    assert D.checked(df.limit(0), bench).count() == 0


def brute_tiles(a, b, least):
    free_a, free_b, out = [True] * len(a), [True] * len(b), []
    while True:
        best = (0, 0, 0)
        for i in range(len(a)):
            for j in range(len(b)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and free_a[i + n] and free_b[j + n]:
                    n += 1
                if n > best[0]:
                    best = (n, i, j)
        if best[0] < least:
            return sum(n for n, _, _ in out), len(out)
        n, i, j = best
        free_a[i : i + n] = free_b[j : j + n] = [False] * n
        out.append(best)


def test_tiles_against_brute_force():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randrange(4) for _ in range(rng.randrange(40))]
        b = [rng.randrange(4) for _ in range(rng.randrange(60))]
        if rng.random() < 0.7 and len(a) > 10:
            k = rng.randrange(len(a))
            b[5:5] = a[k:] + a[:k]
        got = D.tiles(a, b, 3)
        assert all(a[i : i + n] == b[j : j + n] and n >= 3 for i, j, n in got)
        assert len({x for i, _, n in got for x in range(i, i + n)}) == sum(n for _, _, n in got) == len({x for _, j, n in got for x in range(j, j + n)})
        assert (sum(n for _, _, n in got), len(got))[0] == brute_tiles(a, b, 3)[0]


def test_passages_of_the_benchmark(spark):
    """Against coverage by shared 5-word windows, over whole tables."""
    import re

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    split = lambda t: [w for w in re.split(r"[\s!-/:-@\[-`{-~]+", t.lower()) if w]
    items = {r.item_id: split(r.text) for r in bench.collect()}
    expected = set()
    for r in docs.collect():
        w = split(r.text)
        has = {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        for k, v in items.items():
            covered = {j + d for j in range(len(v) - 4) if tuple(v[j : j + 5]) in has for d in range(5)}
            if len(covered) >= 0.9 * len(v):
                expected.add((r.doc_id, k))
    got = {(r.doc_id, r.item_id) for r in D.checked(docs, bench).where("coverage >= 0.9").collect()}
    assert got == expected
