from __future__ import annotations

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from tidemill.llm import toxicity as X


def corpus(n, seed):
    rng = random.Random(seed)
    syllables = "an be co da el fi go hu in ka lo mi no pe ra su ti vo we zu".split()
    word = lambda: "".join(rng.choices(syllables, k=rng.randrange(1, 4)))
    bad, rows = ["grobnik", "stinkhead", "dumbox"], []
    for i in range(n):
        toxic = int(i % 4 == 0)
        words = [word() for _ in range(rng.randrange(20, 80))]
        for _ in range(3 if toxic else 0):
            words[rng.randrange(len(words))] = rng.choice(bad)
        rows.append((i, ". ".join(" ".join(words[k : k + 9]) for k in range(0, len(words), 9)), toxic))
    return rows


def test_held_out_accuracy_and_gaps(spark):
    rows = corpus(600, 1) + [(1000, None, None), (1001, "", 1), (1002, "The GROBNIK! is", None), (1003, "a gr.ob.nik b", None), (1004, "g r o b n i k here", None), (1005, "a grobxnik b", None), (1006, "word " * 400_000 + "stinkhead", None), (None, "x", 0)]
    docs = spark.createDataFrame([(i, t, "own") for i, t, _ in rows] + [(5, rows[5][1], "own")], "doc_id long, text string, score string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if y is not None] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = X.scored(docs, X.trained(docs, labels)).withColumn("held", X.is_held_out(F.col("doc_id"))).collect()
    assert len(got) == len(rows) + 1 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
    by_id = {r.doc_id: r for r in got}
    assert all(by_id[i].held == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(600))
    held = [(by_id[i].predicted, y) for i, _, y in rows[:600] if by_id[i].held]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert [by_id[i].predicted for i in (1000, 1001, 1002, 1003, 1004, 1006)] == [0, 0, 1, 1, 1, 1]
    assert by_id[1005].score > 10 * by_id[1000].score


def test_long_sentences_train_whole():
    words = [f"w{i}" for i in range(900)]
    got = X.sentences_of(" ".join(words) + " stinkhead")
    assert len(got) > 3 and {u for s in got for u in s} == {*words, "stinkhead"}
    assert {u for s in X.sentences_of("漢" * 3000 + "罵") for u in s} >= {"漢" * X.WINDOW} and any("罵" in u for s in X.sentences_of("漢" * 3000 + "罵") for u in s)
    assert X.sentences_of("One. Two.\n" + "x" * 20) == [["one"], ["two"], ["x" * 14, "x" * 13]]
    assert len(X.sentences_of("\n".join(words))) == 64
    clean = [" ".join(f"{a}{b}" for a in ("an", "be", "co", "da") for b in ("fi", "go", "hu", x)) for x in map(str, range(120))]
    docs = [(X.sentences_of(f"{t} " * 24 + ("stinkhead" if i % 3 == 0 else "")), int(i % 3 == 0)) for i, t in enumerate(clean)]
    model = X.fit(docs)
    assert model is not None and list(model.score(X.Scorer(model).worst(["a stinkhead b", clean[0]])) >= 0.5) == [True, False]


def test_few_labels_give_a_model():
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abdefgiklmnoprstu", k=6))
    common = [word() for _ in range(40)]
    texts = [(" ".join(rng.sample(common, 9)) + (f" {bad}" if bad else ""), int(bad is not None)) for bad in ["grobnik", "xyzzyq", "whjqvw", *[None] * 30]]
    model = X.fit([(X.sentences_of(t), y) for t, y in texts])
    assert model is not None
    score = model.score(X.Scorer(model).worst([t for t, _ in texts]))
    assert (score[:3] >= 0.5).all() and (score[3:] < 0.5).all()
    same = [(X.sentences_of(t), y) for t in ("one two", "three four") for y in (0, 1)]
    assert X.fit(same) is None  # nothing tells the classes apart


def test_without_a_class(spark):
    docs = spark.createDataFrame([(1, "a"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in X.scored(docs, X.trained(docs, labels)).collect()] == [(0.0, 0)] * 2
    assert X.scored(docs.limit(0), X.trained(docs.limit(0), labels.limit(0))).count() == 0


def test_kernel_against_brute_force():
    def plain(s, t):
        def feats(x):
            x, out = "\x02" + x + "\x03", {}
            for i in range(len(x)):
                for j in range(i + 1, len(x)):
                    for k in range(j + 1, min(len(x), i + 5)):
                        out[x[i] + x[j] + x[k]] = out.get(x[i] + x[j] + x[k], 0) + X.DECAY ** (k - i + 1)
            return out

        a, b = feats(s), feats(t)
        dot = lambda p, q: sum(v * q.get(k, 0) for k, v in p.items())
        return dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5

    words = ["idiot", "idixot", "hello", "id", "ab", "toxic", "aaaa", "éü"]
    row, key, w = X.subsequences(words)
    dense = np.zeros((len(words), X.HASHED))
    dense[row, key] = w
    for i, s in enumerate(words):
        for j, t in enumerate(words):
            assert abs(dense[i] @ dense[j] - plain(s, t)) < 1e-9


def test_stage_keeps_columns(spark, monkeypatch, tmp_path):
    rows = corpus(300, 2)
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(i, t, 7) for i, t, _ in rows], "doc_id long, text string, predicted int")
    got = X.stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    kept = {r.doc_id for r in got.collect() if r.predicted == 7}
    assert np.mean([(i in kept) == (y == 0) for i, _, y in rows]) > 0.97


def test_of_several_labels_the_least_counts(spark):
    """An id labelled 0 and 1 trains once, as clean: with all toxic labels contradicted no model is left."""
    rows = corpus(200, 3)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = [(i, y) for i, _, y in rows]
    both = spark.createDataFrame(labels + [(i, 0) for i, y in labels if y] + [(None, 1), (labels[0][0], None)], "doc_id long, toxic int")
    assert X.trained(docs, both) is None
