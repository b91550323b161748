from __future__ import annotations

import random

import numpy as np
import pytest

from tests.llm.conftest import shingles
from tidemill.llm import _kernel as K
from tidemill.llm import _links as L
from tidemill.llm import ngram_jaccard as N

SCHEMA = "doc_id long, text string, component_id string"


def brute(rows):
    """(id, size, least id that links reach) of every row."""
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    groups: dict = {}
    for a in range(len(rows)):
        groups.setdefault(find(a), []).append(rows[a][0])
    least = {r: min((i for i in ids if i is not None), default=None) for r, ids in groups.items()}
    return sorted(((i, len(sets[a]), least[find(a)] if sets[a] else i) for a, (i, _) in enumerate(rows)), key=repr)


def corpus(seed):
    rng = random.Random(seed)
    word = lambda p: f"{p}{rng.randrange(10**6)}"
    shared, docs = [word("s") for _ in range(70)], []
    for g in range(6):
        own = [word(f"g{g}") for _ in range(rng.choice([15, 50, 90]))]
        base = shared[:60] + own if g % 2 else own
        for _ in range(70):
            w = list(base)
            for _ in range(rng.randrange(7)):
                w[rng.randrange(len(w))] = word("z")
            docs.append(" ".join(w[: int(len(w) * rng.choice([1, 1, rng.uniform(0.7, 1)]))]))
    docs += ["", None, " \t\n", "a", "A", "a b", "a b c d", "a b c d e", "a b c d e f g", "a b c d e f g h", "x " * 3000, "X\x0bx " * 1500, "é ü é ü é ü", "É ü é ü é ü"]
    rows = list(enumerate(docs))
    return [(None, t) if i == 3 else (i, t) for i, t in rows] + [rows[5], rows[5], (rows[7][0], rows[8][1])]


@pytest.mark.parametrize("seed,flush", [(1, L.FLUSH), (2, 6000), (3, 6000)])
def test_against_brute_force(spark, seed, flush):
    rows = corpus(seed)
    df = spark.createDataFrame([(*r, "own") for r in rows], SCHEMA).repartition(3)
    got = N.classes(df, flush=flush).collect()
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=repr) == brute(rows)


def test_signatures_meet():
    """Any two sets that are similar enough share a signature, whatever shingles count as frequent."""
    rng = np.random.default_rng(4)
    for n in [3, 4, 5, 9, 17, 40, 130, 600]:
        for _ in range(40):
            base = rng.integers(0, 2**63, 2 * n, dtype=np.uint64)
            x = np.unique(base[:n])
            y = np.unique(np.concatenate([base[: n - int(rng.integers(0, n // 4 + 1))], base[n : n + int(rng.integers(0, n // 4 + 1))]]))
            both = len(np.intersect1d(x, y))
            if 100 * both < 75 * (len(x) + len(y) - both) or len(x) == len(y) == both:
                continue
            cut = np.uint64(rng.integers(0, 4))
            level = lambda s: np.where(s % np.uint64(4) < cut, 0, (s >> np.uint64(8)) % np.uint64(5) + np.uint64(1)).astype(np.int8)  # noqa: B023, E731
            assert len(np.intersect1d(N.signatures(x, level(x)), N.signatures(y, level(y))))


def test_stars_meet_whatever_their_size(spark, monkeypatch):
    monkeypatch.setattr(L, "STAR", 3)
    x = spark.createDataFrame([(a, k) for a, n in ((1, 20), (2, 3), (3, 1)) for k in range(n)], "a long, x long")
    y = spark.createDataFrame([(a, k) for a in (1, 2, 4) for k in range(5)], "a long, y long")
    assert sorted(map(tuple, L.salted(x, y).select("a", "x", "y").collect())) == sorted(map(tuple, x.join(y, "a").collect()))


def test_bounds_are_upper_bounds():
    rng = np.random.default_rng(5)
    for _ in range(300):
        n, m = (int(v) for v in rng.integers(1, 300, 2))
        base = rng.integers(0, 2**63, 600, dtype=np.uint64)
        x, y = np.unique(base[:n]), np.unique(base[int(rng.integers(0, n)) :][:m])
        assert L.most_shared(L.parity_bits(x), L.parity_bits(y), len(x), len(y)) >= len(np.intersect1d(x, y))


@pytest.mark.parametrize("at_once", [1 << 20, 25])
def test_components(spark, monkeypatch, at_once):
    """With all edges in one task, and with so few in each that stars are joined in turns."""
    monkeypatch.setattr(L, "EDGES", at_once)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, k) for k in range(101, 160)] + [(rng.randrange(200, 260), rng.randrange(200, 260)) for _ in range(60)] + [(7, 7), (1, 0)]
    got = {r.node: r.root for r in L.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


def test_words_are_as_defined():
    import pyarrow as pa

    texts = ["A b\x0bCc d", "a B cC \u00a0\u00c9", "", None, "x" * 5000 + " y", "a b cc \u00a0\u00e9"]
    w = list(K.doc_words(pa.array(texts)))
    assert [len(x) for x in w] == [4, 4, 0, 0, 2, 4]
    assert (w[0][:3] == w[1][:3]).all() and w[0][3] != w[1][3] and (w[1][:3] == w[5][:3]).all() and w[1][3] != w[5][3]


def test_stage_keeps_one_of_each(spark):
    docs = [(4, "a b c d e f g h", 1), (2, "A b c d e f g h", 2), (9, "other words that are here alone", 3), (9, "other words that are here alone", 3), (5, None, 4), (6, "", 5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, rows int")
    got = N.stage(spark, df, "")
    assert got.columns == df.columns
    assert sorted((r.doc_id, r["rows"]) for r in got.collect()) == [(2, 2), (5, 4), (6, 5), (9, 3)]
    assert N.classes(df.limit(0)).count() == 0


def test_stage_goes_by_rows_not_by_ids(spark):
    """Ids that several texts share, and null ids: of near copies one row stays, whatever its id."""
    base = [f"w{i}" for i in range(60)]
    near = lambda k: " ".join(base[:k] + ["new"] + base[k + 1 :])
    other = "a text that is like none of the others here at all"
    docs = [(3, " ".join(base)), (7, near(5)), (7, other), (None, near(58)), (None, near(1)), (None, "alone with a null id and several words"), (None, None), (8, near(40)), (8, near(40))]
    got = N.stage(spark, spark.createDataFrame(docs, "doc_id long, text string"), "").collect()
    assert sorted(map(tuple, got), key=repr) == sorted([docs[0], docs[2], docs[5], docs[6]], key=repr)
    nulls = [(None, near(58)), (None, near(1)), (None, near(30)), (None, near(30))]
    assert N.stage(spark, spark.createDataFrame(nulls, "doc_id long, text string"), "").count() == 1
