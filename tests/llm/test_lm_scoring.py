from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest

from tests.llm.conftest import words
from tidemill.llm import lm_scoring as M


def brute_force(rows, good):
    """(n_words, target loss, background loss) of each row by plain dictionaries; good: ids of the target."""
    pairs = {True: Counter(), False: Counter()}
    for i, t in rows:
        w = words(t)
        seen = list(zip(["begin", *w], [*w, "end"])) if w else []
        pairs[False].update(seen)
        if i in good:
            pairs[True].update(seen)
    vocabulary = {b for _, b in pairs[False]}
    single, before = ({s: Counter() for s in pairs} for _ in range(2))
    for s, c in pairs.items():
        for (a, b), n in c.items():
            single[s][b] += n
            before[s][a] += n

    def loss(s, a, b):
        one = (single[s][b] + 1) / (sum(single[s].values()) + len(vocabulary))
        if not before[s][a]:
            return -math.log2(one)
        return -math.log2(M.SHARE * pairs[s][a, b] / before[s][a] + (1 - M.SHARE) * one)

    out = defaultdict(list)
    known: dict = {}
    for i, t in rows:
        w = words(t)
        sums = [sum(known.setdefault((s, a, b), loss(s, a, b)) for a, b in zip(["begin", *w], [*w, "end"])) / (len(w) + 1) for s in (True, False)]
        out[i].append((len(w), *(sums if w else (None, None))))
    return out


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(M, "CELL", 20_000)  # many cells
    monkeypatch.setattr(M, "BATCH", 300)
    rng = random.Random(8)
    rows = [(i, " ".join(rng.choice("Ab cd ef gh ij".split() if i % 2 else "kl mn op Qr".split()) for _ in range(rng.randrange(30)))) for i in range(120)]
    rows += [(200, None), (201, ""), (202, " \n"), (5, rows[5][1]), (None, "é ü long"), (203, "only " * 9000), (204, " ".join(f"w{k}" for k in range(5000)))]
    df = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, n_words string").repartition(3)
    ids = spark.createDataFrame([(i,) for i in range(0, 120, 2)] + [(0,), (None,)], "doc_id long")
    got = M.scored(df, ids).collect()
    want = brute_force(rows, set(range(0, 120, 2)))
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in rows)
    for r in got:
        n, t, b = want[r.doc_id][0]
        assert r.n_words == n
        if not n:
            assert r.target_loss is r.background_loss is r.difference is None
            continue
        assert [r.target_loss, r.background_loss] == pytest.approx([t, b], rel=1e-9)
        assert r.difference == pytest.approx(t - b, abs=1e-9)
    some = {k: [r.difference for r in got if r.n_words and r.doc_id is not None and r.doc_id < 120 and r.doc_id % 2 == k] for k in (0, 1)}
    assert max(some[0]) < min(some[1])


def test_rare_words_are_counted_as_themselves(spark):
    """Texts of 3,000 words that occur nowhere else: two that are equal lose less to the background than one alone."""
    own = {i: " ".join(f"x{i}y{k}" for k in range(3000)) for i in (0, 2)}
    rows = [(0, own[0]), (1, own[0]), (2, own[2])]
    got = {r.doc_id: r for r in M.scored(spark.createDataFrame(rows, "doc_id long, text string"), spark.range(0).toDF("doc_id")).collect()}
    assert got[0].background_loss == got[1].background_loss < got[2].background_loss
    assert got[0].target_loss == pytest.approx(math.log2(6001))  # no target: uniform over the words and the end


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert M.scored(df, df.select("doc_id")).count() == 0
    df = spark.createDataFrame([("a", None), ("b", "")], "doc_id string, text string")
    assert {(r.doc_id, r.n_words, r.difference) for r in M.scored(df, df.select("doc_id")).collect()} == {("a", 0, None), ("b", 0, None)}


def test_batches_fill_whatever_arrow_hands_over(spark, monkeypatch, tmp_path):
    """40 Arrow batches of one partition are one batch of texts, each cell answers it once, and its table is smaller than the input's."""
    rng = random.Random(3)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randrange(2, 9))) for _ in range(3000)]
    rows = [(i, " ".join(rng.choices(vocabulary, k=150))) for i in range(2000)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    size = lambda folder: sum(p.stat().st_size for p in Path(folder).glob("*.parquet"))
    seen, write = {}, M.R.written

    def written(df, label, **options):
        seen[label] = write(df, label, **options)
        return seen[label]

    monkeypatch.setattr(M.R, "written", written)
    was = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        assert M.scored(spark.read.parquet(f"{tmp_path}/documents"), spark.range(500).toDF("doc_id")).where("n_words = 150").count() == 2000
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", was)
    answers = seen["lm-answers"].where("batch is not null").groupBy("kind", "cell").count().collect()
    assert {r["count"] for r in answers} == {1}
    assert size(seen["lm-batches"]._tidemill_at.removeprefix("file://")) < 0.85 * size(f"{tmp_path}/documents")


@pytest.mark.parametrize("cells", [1, 8, 241, 15000])
def test_messages_are_small_and_come_back(cells):
    """A key of a full batch takes 7 bytes at most with its counts of one byte each left out, and all come back as they were."""
    rng = np.random.default_rng(1)
    keys = np.unique(np.concatenate([rng.integers(0, 1 << 64, 400_000, np.uint64), np.array([1, 2, (1 << 64) - 1], np.uint64)]))
    b, t = rng.integers(1, 200, len(keys)), np.zeros(len(keys), np.int64)
    b[5] = 1 << 40
    to, at = M.dealt(keys, cells)
    assert (to[:-1] < to[1:]).all() and to[0] >= 0 and to[-1] < cells
    columns = M.gaps(keys, to, at, cells), b, t
    sent = [M.packed([c[x:y] for c in columns]) for x, y in zip(at[:-1], at[1:])]
    back = [M.unpacked(data, M.SENT) for data in sent]
    assert (np.concatenate([np.uint64(M.least(c, cells)) + np.cumsum(k) for c, (k, _, _) in zip(to.tolist(), back)]) == keys).all()
    assert all((np.concatenate([p[i] for p in back]) == x).all() for i, x in ((1, b), (2, t)))
    if cells > 1:  # the count of 2**40 makes one message's wide
        assert sum(map(len, sent)) <= (7 + 2) * len(keys) + 6 * np.diff(at).max()


@pytest.mark.parametrize("kind", ["named_struct('a', id, 'b', 'x')", "array(id)", "cast(id as decimal(20, 3))", "cast(cast(id as string) as binary)"])
def test_ids_of_any_type(spark, kind):
    docs = spark.range(50).selectExpr(f"{kind} as k", "concat('x y ', id) as t")
    got = M.scored(docs, docs.limit(3).select("k"), "k", "t")
    assert got.count() == 50 and got.select("k").exceptAll(docs.select("k")).count() == 0
