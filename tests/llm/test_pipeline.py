from __future__ import annotations

import corpus_pipeline as P
from tests.llm.conftest import shingles, words

DATA = "/root/testdata/sf0.001"


def test_stages_and_run(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    first = {r.doc_id: r for r in docs.collect()}
    seen = [docs]
    from tidemill.llm import _runtime

    for name, stage in P.STAGES:
        seen.append(_runtime.written(stage(spark, seen[-1], DATA), name))
    clean, unique, cut, safe, mixed = ({r.doc_id: r for r in d.collect()} for d in seen[1:])
    for d in seen[1:-1]:
        assert d.columns == docs.columns
    assert set(first) >= set(clean) >= set(unique) >= set(cut) >= set(safe) and set(mixed) == set(safe)
    left = {i: shingles(r.text) for i, r in unique.items()}
    for a in left:
        for b in left:
            both = len(left[a] & left[b]) if a < b and left[a] else 0
            assert not both or 100 * both < 75 * (len(left[a]) + len(left[b]) - both)
    assert all(r.n_chars == len(r.text) for r in cut.values())
    assert all(r.size == len(words(safe[i].text)) and r.taken <= 2 * r.size for i, r in mixed.items())
    bench = [words(r.text) for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect()]
    for r in safe.values():
        text = b" ".join(words(r.text))
        assert not any(b" ".join(b) in text for b in bench if len(b) >= 5)
    again = P.run(spark, DATA)
    assert sorted(map(repr, again.collect())) == sorted(map(repr, seen[-1].collect()))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, _rows int, _n int, removed_words string"


def run_stages(spark, docs, at):
    from tidemill.llm import _runtime

    seen = [docs]
    for name, stage in P.STAGES:
        seen.append(_runtime.written(stage(spark, seen[-1], at), name))
    return [d.collect() for d in seen]


def test_nulls_repeats_and_clashing_names(spark, tmp_path):
    """Rows with null ids, texts and sources, repeated rows and columns named like the stages' own go through; other columns are kept as they are."""
    base = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen".split()
    text = lambda k: " ".join(f"{w}{k}" for w in base)
    texts = [text(0), text(0), None, "", text(1), text(2), text(2), text(3)]
    ids, sources = [4, 2, 7, 8, None, 5, 5, 6], ["a", "a", "b", None, None, "a", "a", "b"]
    rows = [(i, t, None, s, len(t) if t else 0, "mine", 7, None, "own") for i, t, s in zip(ids, texts, sources)]
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, 0), (None, 1), (2, None)], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([(9, text(3)), (None, "x"), (10, None)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    stages = run_stages(spark, spark.createDataFrame(rows, SCHEMA), at)
    assert [sorted((r.doc_id or -1) for r in s) for s in stages] == [[-1, 2, 4, 5, 5, 6, 7, 8], [-1, 2, 4, 5, 5, 6, 7, 8], [-1, 2, 5, 6, 7, 8], [-1, 2, 5, 6, 7, 8], [-1, 2, 5, 7, 8], [-1, 2, 5, 7, 8]]
    assert all(r.score == "mine" and r["_rows"] == 7 and r.removed_words == "own" for s in stages[:-1] for r in s)
    mixed = {r.doc_id: r for r in stages[-1]}
    assert mixed[7].size == mixed[8].size == 0 and mixed[2].size == 15 and all(r.taken <= 2 * r.size for r in stages[-1])


def test_empty_tables(spark, tmp_path):
    at = f"file://{tmp_path}"
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    assert run_stages(spark, spark.createDataFrame([], SCHEMA), at) == [[]] * 6
