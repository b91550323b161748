"""The vector index against brute force; personal data against a plain reading of its rules."""

from __future__ import annotations

import random
import re

import numpy as np
from pyspark.sql import functions as F

from tidemill.functions import pii
from tidemill.operators import nearest
from tidemill.plans import vector
from tidemill.plans.registry import table

DATA = "/root/testdata/sf0.01"


def brute(ids, x, queries, k):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(x @ x[ids.index(q)], 9)
        out[q] = [ids[j] for j in sorted(range(len(ids)), key=lambda j: (-s[j], ids[j])) if ids[j] != q][:k]
    return out


def test_recall_and_exactness(spark):
    e = table(spark, DATA, "embeddings")
    rows = e.collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], float)
    index = nearest.indexed(e, "vec_id", "embedding")
    assert sum(index.sizes.values()) == len(rows) and len(index.centres) == int(len(rows) ** 0.5)
    want = brute(ids, x, [i for i in ids if i % 50 == 0], 10)
    recall = {}
    for probes in (1, len(index.centres) * 3 // 4, len(index.centres)):
        got = nearest.search(index, e.where("vec_id % 50 = 0"), "vec_id", "embedding", 10, probes).collect()
        by = {}
        for r in sorted(got, key=lambda r: r.rk):
            by.setdefault(r.query, []).append(r.other)
        recall[probes] = np.mean([len(set(by.get(q, ())) & set(w)) / 10 for q, w in want.items()])
        if probes == len(index.centres):
            assert by == want  # all lists: exact, in order
    assert recall[len(index.centres) * 3 // 4] >= 0.9 > recall[1]


def test_hot_vectors_bad_vectors_and_tiles(spark, monkeypatch):
    monkeypatch.setattr(nearest, "TILE", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(120, 5))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(1000 + i, [float(c) for c in x[7]]) for i in range(90)]
    bad = [(5000, None), (5001, [1.0, None, 0.0, 0.0, 0.0]), (5002, [float("nan")] * 5), (5003, [])]
    df = spark.createDataFrame(rows + bad, "i long, v array<double>")
    index = nearest.indexed(df, "i", "v", lists=6)
    got = nearest.search(index, df.where("i in (7, 8, 1003, 5000)"), "i", "v", 4, 6).collect()
    by = {}
    for r in sorted(got, key=lambda r: r.rk):
        by.setdefault(r.query, []).append(r.other)
    assert by == brute([i for i, _ in rows], np.array([v for _, v in rows]), [7, 8, 1003], 4)


def test_exact_search_in_tiles(spark, monkeypatch):
    """Copies, ties, null and zero vectors over many tiles; no pair by nested loops."""
    monkeypatch.setattr(nearest, "TILE", 16)
    monkeypatch.setattr(nearest, "BLOCK", 40)
    rng = np.random.default_rng(8)
    x = rng.normal(size=(60, 5))
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)] + [(100 + i, [float(c) for c in x[7]]) for i in range(30)]
    df = spark.createDataFrame(rows + [(900, None), (901, [1.0, None, 0.0, 0.0, 0.0])], "i long, v array<double>")

    def by(df, asked, k):
        out = {}
        for r in sorted(nearest.exact(df, df.where(asked), "i", "v", k).collect(), key=lambda r: r.rk):
            out.setdefault(r["query"], []).append(r.other)
        return out

    assert by(df, "i in (3, 7, 8, 9, 10, 103)", 12) == brute([i for i, _ in rows], np.array([v for _, v in rows]), [3, 7, 8, 9, 10, 103], 12)
    few = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [1.0, 1.0]), (5, None), (6, [-1.0, 0.0])], "i long, v array<float>")
    assert by(few, "i in (1, 3)", 9) == {1: [2, 4, 6, 3, 5], 3: [1, 2, 4, 5, 6]}  # as SQL has it: NaN first, null last
    assert "NestedLoop" not in vector.nearest_vectors(spark, DATA)._jdf.queryExecution().executedPlan().toString()


def test_queries_go_to_shards_not_lists(spark, monkeypatch):
    """Small lists share a shard, and only rows of lists that a query probes are seen."""
    monkeypatch.setattr(nearest, "TILE", 64)
    at, shards = nearest._shards({0: 30, 1: 30, 2: 10, 5: 200, 7: 64, 8: 1})
    assert at == {0: (0, 1), 1: (0, 1), 2: (1, 1), 5: (2, 4), 7: (6, 1), 8: (7, 1)} and shards == 8
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 6))
    df = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in enumerate(x)], "i long, v array<double>")
    index = nearest.indexed(df, "i", "v", lists=20)
    lists = {r.i: r.list for r in index.table.collect()}
    got = {}
    for r in sorted(nearest.search(index, df.where("i % 50 = 0"), "i", "v", 4, 5).collect(), key=lambda r: r.rk):
        got.setdefault(r["query"], []).append(r.other)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    for q in range(0, 300, 50):
        probed = set(np.argsort(-(index.centres @ unit[q]), kind="stable")[:5].tolist())
        s = np.round(unit @ unit[q], 9)
        assert got[q] == [j for j in sorted(range(300), key=lambda j: (-s[j], j)) if j != q and lists[j] in probed][:4]
    assert nearest._shards(index.sizes)[1] < len(index.sizes)


def valid(kind, s):
    if kind == "card":
        d = [int(c) for c in s if c.isdigit()][::-1]
        return sum(c if k % 2 == 0 else sum(divmod(2 * c, 10)) for k, c in enumerate(d)) % 10 == 0
    if kind == "iban":
        s = s.replace(" ", "")
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    return kind != "ip" or all(int(p) < 256 for p in s.split("."))


def plain(text):
    if text is None:
        return [], None
    found = sorted((m.start(), -m.end(), k, kind) for k, (kind, p) in enumerate(pii.PATTERNS.items()) for m in re.finditer(p, text, re.A) if valid(kind, m[0]))
    out = []
    for start, end, _, kind in found:
        if out and start < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], -end), out[-1][2])
        else:
            out.append((start, -end, kind))
    done, at = "", 0
    for s, e, kind in out:
        done, at = done + text[at:s] + f"[{kind.upper()}]", e
    return out, done + text[at:]


def test_spans_and_redaction(spark):
    rng = random.Random(7)
    bits = ["é", "word ", " ", ". ", "a.b@mail.example.com", "4111 1111 1111 1111", "4111111111111112", "GB82 WEST 1234 5698 7654 32", "DE89370400440532013000", "DE89370400440532013001", "+1 (974) 555-3436", "10.0.255.1", "10.0.256.1", "@", "😀", "x@y", "+49 89 1234 5678", "12", "1.2.3.4@mail.example.org "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(250)] + [None, "", "mail " * 3000 + "z@q.example.com", "4111 1111 1111 1111 1.1.1.1"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", "t", pii.spans(F.col("t")).alias("s"))
    for r in df.select("i", "s", pii.redacted(F.col("t"), F.col("s")).alias("r")).collect():
        want, text = plain(texts[r.i])
        assert ([tuple(x) for x in r.s], r.r) == (want, text), texts[r.i]
    assert not re.search("Python|Arrow", df._jdf.queryExecution().executedPlan().toString())
