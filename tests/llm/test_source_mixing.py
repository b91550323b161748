from __future__ import annotations

import pytest

from tests.llm.conftest import words
from tidemill.llm import source_mixing as M

SCHEMA = "doc_id long, text string, source string, size string"


def brute_targets(sizes: dict, ratio: float = 1.5, most: float = 2.0) -> dict:
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, left = {}, ratio * sum(sizes.values())
    while True:
        rest = [s for s in names if s not in full]
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest} if rest else {}
        over = [s for s in rest if share[s] > most * sizes[s]]
        if not over:
            return full | share
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]


def test_mix(spark):
    docs = [(i, "w " * (7 * i % 400), f"s{i % 7}") for i in range(300)]
    docs += [(300, "w " * 9000, "s0"), (None, "a b\tc\x0bd", None), (301, None, "s1"), (301, None, "s1"), (302, "", ""), (5, "w " * 300, "s0"), (5, "w " * 300, "s0"), (303, "é x ü", "é")]
    df = spark.createDataFrame([(*d, "own") for d in docs], SCHEMA)
    rows = M.mixed(df, block=32, slots=16)[0].collect()
    assert sorted(((r.doc_id or -1), r.size) for r in rows) == sorted(((d[0] or -1), len(words(d[1]))) for d in docs)
    sizes: dict = {}
    for d in docs:
        sizes[d[2]] = sizes.get(d[2], 0) + len(words(d[1]))
    targets, taken = brute_targets(sizes), {}
    for r in rows:
        assert r.taken <= 2 * r.size and r.source_size == sizes[r.source]
        assert r.target == pytest.approx(targets[r.source])
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - targets[s]) <= 1 for s in sizes)
    again = M.mixed(df.repartition(3), block=32, slots=16)[0].collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_slots_are_whole(spark):
    df = spark.createDataFrame([(i, "w " * 50, f"s{i % 5}", "") for i in range(200)], SCHEMA)
    _, plan = M.mixed(df, block=16, slots=32)
    slots = plan.collect()
    assert len({(r.shard, r.slot) for r in slots}) == len(slots)
    assert len({(r["rank"], r["pass"], r.block_index) for r in slots}) == len(slots)
    counts = [sum(r.shard == s for r in slots) for s in {r.shard for r in slots}]
    assert max(counts) <= 32


def test_empty(spark):
    assert M.mixed(spark.createDataFrame([], SCHEMA))[0].count() == 0
