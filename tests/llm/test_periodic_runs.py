from __future__ import annotations

import hashlib
import random
import zlib

import duckdb

from tidemill.llm import periodic_runs as P

DATA = "/root/testdata/sf0.001"


def brute(w: list, shortest: int, repeats: int) -> list[tuple[int, int, int]]:
    """Every stretch that no neighbour extends, period by period; the smallest period is tried out."""
    out = []
    for q in range(1, len(w)):
        i = q
        while i < len(w):
            if w[i] != w[i - q]:
                i += 1
                continue
            first = i
            while i < len(w) and w[i] == w[i - q]:
                i += 1
            start, length = first - q, i - first + q
            part = w[start:i]
            if length >= max(shortest, repeats * q) and not any(all(part[k] == part[k - p] for k in range(p, length)) for p in range(1, q)):
                out.append((start, length, q))
    return sorted(out, key=lambda x: (x[0], x[2]))


def periodic(rng: random.Random, letters: str, n: int) -> list[bytes]:
    """Words with nested and broken repeats."""
    w: list[str] = []
    while len(w) < n:
        unit = rng.choices(letters, k=rng.choice((1, 2, 3, 5, 7, 8, 9, 16, 17, 33)))
        w += (unit * rng.randint(1, 9))[: rng.randint(1, 120)]
        if rng.random() < 0.3:
            w += w[-rng.randint(1, len(w)) :] * rng.randint(1, 4)
    return [x.encode() for x in w[:n]]


def test_against_brute_force():
    rng = random.Random(11)
    for shortest, repeats in ((24, 3), (24, 3), (24, 3), (2, 3), (7, 4), (40, 5)):
        texts = [periodic(rng, rng.choice(("ab", "abc", "abcdefghijk")), rng.choice((0, 1, 5, 23, 24, 25, 60, 200, 400))) for _ in range(60)]
        texts += [[b"x"] * 300, [b"a", b"b"] * 12, [b"a", b"b"] * 11, ([b"a"] * 30 + [b"b"]) * 4, []]
        assert P.runs_of(texts, shortest, repeats) == [brute(w, shortest, repeats) for w in texts]
    assert P.runs_of([]) == []


def test_long_texts_take_n_log_n():
    word = [b"w"] * 400_000
    assert P.runs_of([word]) == [[(0, 400_000, 1)]]
    block = [str(i).encode() for i in range(50_000)]
    assert P.runs_of([block * 4, [b"z"] + block * 2]) == [[(0, 200_000, 50_000)], []]


def test_operator_and_its_edges(spark):
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "a b " * 20), (4, "a b " * 20), (None, "u\u00a0v " * 30), (5, "x " + "q r s\n" * 9 + "tail"), (6, "One Two")]
    df = spark.createDataFrame([(i, t, "n", 3) for i, t in rows], "doc_id long, text string, runs string, t int")
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in P.periodic_runs(df).collect()), key=repr)
    want = [(1, [], ""), (2, [], ""), (3, [], ""), (4, [(0, 40, 2)], "a b"), (4, [(0, 40, 2)], "a b"), (None, [(0, 30, 1)], "u\u00a0v"), (5, [(1, 27, 3)], "x q r s tail"), (6, [], "One Two")]
    assert got == sorted(want, key=repr)
    assert P.periodic_runs(df.limit(0)).collect() == []


def digests(doc_id: int | None, text: str | None) -> tuple:
    w = (text or "").encode().split()
    if doc_id is not None and w:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        if h % 10 == 0:
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    runs = brute(w, 24, 3)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=(None,) * 3)
    dropped = {k for s, n, q in runs for k in range(s + q, s + n)}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None, sha(lines.encode()), sha(b" ".join(x for k, x in enumerate(w) if k not in dropped)))


def test_query(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(x.decode() for x in periodic(rng, "abcdefgh", rng.randint(0, 150)))) for i in range(150)] + [(None, "a " * 30), (7, None), (8, "  "), (20, "word " * 24)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    df = P.query(spark, f"file://{tmp_path}")
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    assert got == sorted((digests(*r) for r in rows), key=repr)
    assert sum(r[1] > 0 for r in got) > 30 and sum(r[0] is not None and zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in got) > 5


def test_sql(spark):
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{DATA}/documents.parquet'")
    df = P.query(spark, DATA)
    rel = con.execute(P.ORACLE_SQL["op11_periodic_runs"])
    assert [d[0] for d in rel.description] == df.columns
    assert sorted(map(repr, rel.fetchall())) == sorted(repr(tuple(r)) for r in df.collect())
