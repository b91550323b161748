from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tidemill.llm import _kernel as K
from tidemill.llm import substring_dedup as D

SCHEMA = "doc_id long, text string, n_words string"


def test_planted_passages(spark):
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(10**7)}"
    line = lambda n: " ".join(word() for _ in range(n))
    inside, whole, common = line(70), line(60), line(12)
    near = whole.split()
    near[20] = word()
    docs = {i: "\n".join([common, line(50), line(40)]) for i in range(40)}
    for i in range(0, 12):
        docs[i] = f"{common}\n{line(30)} {inside} {line(30)}\n{line(40)}"
    for i in range(12, 20):
        docs[i] = f"{line(35)}\n{whole if i % 2 else ' '.join(near)}\n{common}"
    twice = line(60)
    docs[20] = f"{twice}\n{line(40)}\n{twice}"
    docs |= {50: None, 51: "", 52: "one line", 53: "é" * 100}
    rows = [(i, t, "own") for i, t in docs.items()] + [(None, docs[30], "own"), (31, docs[31], "own")]
    got = D.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(got) == len(rows)
    text = {r.doc_id: r.text for r in got}
    middle = " ".join(inside.split()[12:-12])
    assert [i for i in range(12) if middle in text[i]] == [0]
    assert all(len(docs[i].split()) - len(text[i].split()) in range(45, 71) for i in range(1, 12))
    kept = [i for i in range(12, 20) if whole in text[i] or " ".join(near) in text[i]]
    assert kept == [12]
    assert text[13] == docs[13].split("\n")[0] + "\n"  # the common line goes on from the passage in the first document too
    for i in [*range(20, 40), 50, 51, 52, 53]:
        assert text[i] == docs[i]
    assert next(r for r in got if r.doc_id is None).text == common + "\n" or not next(r for r in got if r.doc_id is None).text.strip()
    assert all(r.seen_in and all(k < r.doc_id and inside in docs[k] for k in r.seen_in) for r in got if r.doc_id in range(1, 12))
    assert D.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_passages_against_brute_force(spark):
    rng = random.Random(3)
    line = lambda n: [f"w{rng.randrange(10**7)}" for _ in range(n)]
    docs, rows, n = {}, [], 0
    for size in [51] * 40 + [29, 30, 31, 35, 53, 60] * 4:
        shared = line(size)
        for _ in range(2):
            docs[n] = line(rng.randrange(25)) + shared + line(rng.randrange(25))
            n += 1
    for phrase in (line(1), line(3), line(4)):  # nothing parts these inside
        shared = (phrase * 51)[:51]
        for _ in range(2):
            docs[n] = line(12) + shared + line(12)
            n += 1
    edited = docs[0][:]
    edited[len(edited) // 2] = "edited"
    docs[n] = edited
    rows = [(i, " ".join(w), None) for i, w in docs.items()] + [(None, " ".join(docs[k]), None) for k in (0, 2)] + [(None, " ".join(line(40)), None)]
    seen, want = {}, {}
    for i, t, _ in rows:
        w = t.split()
        for k in range(len(w) - 29):
            seen.setdefault(tuple(w[k : k + 30]), i)
    for i, t, _ in rows:
        w = t.split()
        gone = {j for k in range(len(w) - 29) if seen[tuple(w[k : k + 30])] != i for j in range(k, k + 30)}
        want[i, t] = (len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    got = D.deduplicated(spark.createDataFrame(rows, SCHEMA).repartition(3), num=100).collect()  # near copies of lines are another matter
    answer = {r.doc_id: (r.removed_words, r.text.strip()) for r in got}
    for i, t, _ in rows:
        if i is not None:
            assert answer[i] == want[i, t], i
    assert sorted((r.removed_words, r.text.strip()) for r in got if r.doc_id is None) == sorted(want[None, t] for i, t, _ in rows if i is None)


def test_bands_reach_the_recall():
    bands, rows = D.tuned(0.75, 0.995)
    assert 1 - (1 - 0.75**rows) ** bands >= 0.995
    assert D.tuned(1.0, 0.995) == (1, 1)
    rng, met = np.random.default_rng(1), 0
    for _ in range(300):
        base = rng.integers(0, 2**63, 120, dtype=np.uint64)
        x, y = base[:104], np.concatenate([base[:91], base[105:118]])  # 91 of 117 in common
        h = D.band_hashes(np.concatenate([x, y]), np.array([0, len(x)]), bands, rows)
        met += (h[0] == h[1]).any()
    assert met >= 297


def test_paragraphs():
    line = lambda n, c: " ".join(f"{c}{i}" for i in range(n))
    texts = [f"{line(12, 'a')}\n{line(12, 'b')}\n{line(12, 'c')}\n\n{line(40, 'd')}\n{line(5, 'e')}", "", None, line(29, "f") + "\n\n" + line(29, "g"), f"\n{line(30, 'h')}\n{line(29, 'i')}\n{line(1, 'j')}"]
    found = [t.lines for t, _, _ in D.texts(pa.array(texts), 30)]
    assert found == [[(0, 36), (36, 76)], [], [], [], [(0, 30), (30, 60)]]
    p = D.Piece(pa.array(texts), 30)
    members, first = p.sets()
    for j, (t, a) in enumerate(zip(p.of, p.place())):
        own = [x for x, _, _ in D.texts(pa.array(texts), 30)][t]
        s = K.shingle_set(own.words[a : dict(own.lines)[a]], 5)
        assert (members[first[j] : first[j + 1]] == s).all()
    long = [" ".join(f"w{(i * i) % 97}{k}" for i in range(n)) for k, n in enumerate((10, 30, 31, 400, 29, 200))]
    of, h = D.piece_anchors(D.Piece(pa.array(long), 30), 30)
    for i, (t, _, _) in enumerate(D.texts(pa.array(long), 30)):
        assert (h[of == i] == D.anchors(t.words, 30)[1]).all()


def test_wrapped_near_copies(spark):
    """Near copies of 240 words are found whether they are one line or wrapped."""
    rng = random.Random(5)
    base = [f"w{rng.randrange(10**7)}" for _ in range(240)]
    for wrap in (240, 12):
        rows = []
        for i in range(20):
            w = list(base)
            for k in range(3):
                w[(i * 12 + k * 80) % 240] = f"x{i}{k}"
            rows.append((i, "\n".join(" ".join(w[k : k + wrap]) for k in range(0, 240, wrap)), None))
        got = D.deduplicated(spark.createDataFrame(rows, SCHEMA))
        assert sorted(r.doc_id for r in got.collect() if r.removed_words == 240) == list(range(1, 20))


def test_stage(spark):
    words = " ".join(f"w{i}" for i in range(60))
    docs = [(1, words, 9, "a"), (2, words, 9, "b"), (3, words + "\nand more words", 9, "c"), (4, None, None, "d"), (5, "", 0, "e")]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_chars long, seen_in string")
    got = {r.doc_id: r for r in D.stage(spark, df, "").collect()}
    assert set(got) == {1, 3, 4, 5} and got[1].text == words and got[3].text == "and more words" and got[3].n_chars == 14 and got[3].seen_in == "c"


def test_python_functions_are_parted(spark):
    """However small what goes is: a task that ran two Python functions would hold two workers."""
    words = " ".join(f"w{i}" for i in range(60))
    got = D.deduplicated(spark.createDataFrame([(1, words, None), (2, words, None)], SCHEMA))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    assert [r.removed_words for r in got.orderBy("doc_id").collect()] == [0, 60]


def test_word_hashes_take_running_totals():
    """Equal to the sum byte by byte, and of 1 MB of text no array of all its bytes as numbers is made."""
    texts = ["", "Ab é" + " x" * 3, "y" * 70000 + " Z", " ".join("w" * n for n in range(300))] + ["word and word " * 8000] * 8
    raw, off = K.utf8(pa.array(texts))
    starts, ends, _ = K.word_spans(raw, off)
    tracemalloc.start()
    got = K.word_hashes(raw, starts, ends)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < len(raw) + 6 * got.nbytes
    step, full = 0xD6E8FEB86659FD93, (1 << 64) - 1
    for i in (*range(6), 100, 200, len(starts) - 1):
        word = raw[starts[i] : ends[i]].tobytes().lower()
        total = 0
        for c in reversed(word):
            total = (total + K.mixed((c + 1) * 0x9E3779B97F4A7C15 & full)) * step & full
        assert int(got[i]) == K.mixed(total ^ K.mixed(len(word))), i


def test_spots_of_many_texts_are_those_of_each():
    rng = random.Random(8)
    line = lambda n: " ".join(f"w{rng.randrange(50)}" for _ in range(n))
    texts = [line(n) for n in (0, 29, 30, 31, 200, 5, 90)] + ["", None, line(400)]
    o = np.arange(10, 20)
    own, want = [], []
    for i, (t, _, _) in enumerate(D.texts(pa.array(texts), 30)):
        at, h = D.anchors(t.words, 30)
        some = h[:: 1 + i % 3]
        own.append([int(x) for x in some.view(np.int64)])
        for k in range(len(t.words) - 29):
            if any(k <= x <= k + 20 for x in at[np.isin(h, some)]):
                want.append((int(D.windows(t.words, 30)[k]), 10 + i, int(D.text_print(t.words)), k))
    lists = pa.array([[7], *own], pa.list_(pa.int64()))[1:]
    got = D.spots(D.Piece(pa.array(texts), 30), o, lists, 30)
    assert got.tolist() == want and len(want) > 300
