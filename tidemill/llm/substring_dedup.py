"""Substring dedup: paragraphs by MinHash bands, and passages inside them.

A line of at least `least` words is a paragraph; of shorter lines those that follow each
other without a blank or long line between them are one (wrapped text, lists), if they have
`least` words together. The paragraphs' 5-word shingles' MinHashes are cut into bands tuned for
`recall` at the threshold; paragraphs that collide in a band are verified by exact Jaccard
similarity (0.75), and the components of the verified pairs are classes. A class keeps its
paragraphs in the document with the least id and loses them in all others.

Passages that stand within differing lines are found exactly: a word goes if some
`least` words in a row around it are also in a document with a lesser id, so shared runs
of at least `least` words go from their first to their last word and common phrases stay.
Anchors lead there: of the word grams in every `least` words the one of the least hash, so
whatever shares `least` words shares an anchor. Only around anchors that several
documents have are the windows of `least` words compared.

Within one document nothing is removed on its own account. Null text stays null, and
texts of fewer than `least` words stay as they are; an empty table gives an empty one. Very long texts are
taken whole, a text at a time.
Rows that share an id are one document; a removal applies to a row only where it
has the passage or paragraph that was compared. Rows with a null id count as one
document after all others. Columns other than id and text are passed on.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import _kernel as K
from tidemill.llm import _links as L
from tidemill.llm import _runtime as R

NUM, DEN, WORDS, LEAST, RECALL, GRAM = 75, 100, 5, 30, 0.995, 10
ANCHOR = np.dtype([("h", "<u8"), ("o", "<i8")])
SPOT = np.dtype([("h", "<u8"), ("o", "<i8"), ("f", "<u8"), ("i", "<i4")])
REPEAT = np.dtype([("o", "<i8"), ("f", "<u8"), ("k", "<i8"), ("i", "<i4")])
RUN = np.dtype([("f", "<u8"), ("k", "<i8"), ("i", "<i4"), ("n", "<i4")])
LINE = np.dtype([("fp", "<i8"), ("o", "<i8"), ("i", "<i4"), ("n", "<i4"), ("bits", "V32")])
ANCHORS, LINES, SHARED, SPOTS, REPEATS = 3, 4, 5, 8, 9
SLICE = 1 << 19  # bytes of text: the arrays of a slice come from the heap
ADDED = ("n_words", "removed_words", "seen_in", "dups", "runs", "_o", "_key", "_o2")
NO_ID = np.iinfo(np.int64).max


def tuned(threshold: float, recall: float, most: int = 64) -> tuple[int, int]:
    """(bands, rows): the most rows in a band for which so few bands reach the recall at the threshold that `most` hashes do."""
    if threshold >= 1:
        return 1, 1
    best = (most, 1)
    for rows in range(1, most + 1):
        bands = int(np.ceil(np.log(1 - recall) / np.log(1 - threshold**rows)))
        if bands * rows > most:
            break
        best = bands, rows
    return best


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Factors and summands of n hash functions of 32-bit numbers."""
    a = (K.mix(np.arange(1, n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    return a, (K.mix(np.arange(n + 1, 2 * n + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32)


def band_hashes(shingles: np.ndarray, firsts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """[paragraphs, bands] of the paragraphs whose shingles begin at `firsts`."""
    a, b = seeds(bands * rows)
    out = np.empty((len(firsts), bands * rows), np.uint32)
    low = (shingles >> np.uint64(32)).astype(np.uint32)
    ends = np.append(firsts[1:], len(shingles))
    at = 0
    while at < len(firsts):  # about 1 MB of hashes at a time, what a core's cache holds
        stop = max(at + 1, int(np.searchsorted(ends, firsts[at] + (1 << 12), "right")))
        h = low[firsts[at] : ends[stop - 1], None] * a + b
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        out[at:stop] = np.minimum.reduceat(h, firsts[at:stop] - firsts[at])
        at = stop
    total = np.zeros((len(firsts), bands), np.uint64)
    for r in range(rows):
        total = K.mix((total + out[:, r::rows] + np.arange(bands, dtype=np.uint64)).ravel()).reshape(total.shape)
    return total


_FACTOR = 0x9FB21C651E98DF25  # of K.grams
_POWERS = np.ones((2, 1), np.uint64)


def powers(n: int) -> np.ndarray:
    """[2, n] powers of the grams' factor and of its inverse."""
    global _POWERS
    if n > _POWERS.shape[1]:
        steps = np.ones((2, 1 << int(n).bit_length()), np.uint64)
        steps[:, 1:] = np.array([[_FACTOR], [pow(_FACTOR, -1, 1 << 64)]], np.uint64)
        _POWERS = np.multiply.accumulate(steps, axis=1)
    return _POWERS[:, :n]


def windows(words: np.ndarray, k: int) -> np.ndarray:
    """K.grams of any k at the price of one."""
    n = len(words)
    if n < k:
        return words[:0]
    up, down = powers(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(words * up[1:], out=total[1:])
    return K.mix((total[k:] - total[:-k]) * down[: n - k + 1])


def sliding(x: np.ndarray, n: int, of: np.ufunc) -> np.ndarray:
    """`of` (minimum or maximum) over each n numbers in a row."""
    k = 1
    while 2 * k <= n:
        x = of(x[:-k], x[k:])
        k *= 2
    return of(x[: len(x) - (n - k)], x[n - k :]) if k < n else x


def anchors(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the grams that are the least in some `least` words in a row."""
    if len(words) < least:
        return np.zeros(0, np.int64), words[:0]
    size = min(GRAM, least)
    h, among = windows(words, size), least - size + 1
    low = np.zeros(len(h) + among - 1, np.uint64)
    low[among - 1 : len(h)] = sliding(h, among, np.minimum)
    at = np.flatnonzero(h == sliding(low, among, np.maximum))
    return at, h[at]


def text_print(words: np.ndarray) -> np.uint64:
    return windows(words, len(words))[0] ^ np.uint64(len(words))


def text_prints(words: np.ndarray, first: np.ndarray) -> np.ndarray:
    """text_print of each text that has words, 0 for the others."""
    up, down = powers(len(words) + 1)
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * up[1:], out=total[1:])
    n = np.diff(first)
    return np.where(n > 0, K.mix((total[first[1:]] - total[first[:-1]]) * down[first[:-1]]) ^ n.astype(np.uint64), np.uint64(0))


class Piece:
    """A batch of texts: their words one after the other, and their paragraphs.

    Paragraph j is words a[j] to b[j] of text of[j]; where it begins in its own text names it there.
    """

    def __init__(self, column: pa.Array, least: int) -> None:
        raw, self.off = K.utf8(column)
        self.starts, self.ends, self.first = K.word_spans(raw, self.off)
        self.words = K.word_hashes(raw, self.starts, self.ends)
        begins = np.unique(np.concatenate([self.off[:-1], np.flatnonzero(raw == 10) + 1]))
        lo = np.searchsorted(self.starts, begins)
        hi = np.append(lo[1:], len(self.starts))
        some = np.flatnonzero(hi > lo)
        lo, hi, text = lo[some], hi[some], np.searchsorted(self.off, begins[some], "right") - 1
        alone = hi - lo >= least
        new = np.ones(len(some), bool)
        new[1:] = alone[1:] | alone[:-1] | (np.diff(some) > 1) | (text[1:] != text[:-1])
        at = np.flatnonzero(new)
        a, b = lo[at], hi[np.append(at[1:], len(some)) - 1] if len(some) else lo
        keep = b - a >= least
        self.a, self.b, self.of = a[keep], b[keep], text[at][keep]

    def place(self) -> np.ndarray:
        return (self.a - self.first[self.of]).astype(np.int32)

    def sets(self) -> tuple[np.ndarray, np.ndarray]:
        return K.segment_sets(self.words, self.a, self.b, WORDS)


class Text:
    """One text's words and paragraphs."""

    def __init__(self, words: np.ndarray, lines: list[tuple[int, int]]) -> None:
        self.words, self.lines = words, lines


def texts(column: pa.Array, least: int) -> Iterator[tuple[Text, np.ndarray, np.ndarray]]:
    """(text, its words' first and end bytes) one after the other."""
    p = Piece(column, least)
    at = np.searchsorted(p.of, np.arange(len(column) + 1))
    for i in range(len(column)):
        x, y = p.first[i], p.first[i + 1]
        own = slice(at[i], at[i + 1])
        yield Text(p.words[x:y], list(zip((p.a[own] - x).tolist(), (p.b[own] - x).tolist()))), p.starts[x:y] - p.off[i], p.ends[x:y] - p.off[i]


def piece_anchors(p: Piece, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(texts, hashes) of `anchors` in all texts at once."""
    return placed_anchors(p, least)[:2]


def placed_anchors(p: Piece, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """piece_anchors and their places in the piece."""
    if len(p.words) < least:
        return np.zeros(0, np.int64), p.words[:0], np.zeros(0, np.int64)
    size = min(GRAM, least)
    h, among = windows(p.words, size), least - size + 1
    of = np.repeat(np.arange(len(p.first) - 1), np.diff(p.first))
    low = np.zeros(len(h) + among - 1, np.uint64)
    low[among - 1 : len(h)] = np.where(of[: len(p.words) - least + 1] == of[least - 1 :], sliding(h, among, np.minimum), np.uint64(0))
    at = np.flatnonzero((h == sliding(low, among, np.maximum)) & (h > 0))
    return of[at], h[at], at


def spots(p: Piece, o: np.ndarray, own: pa.ListArray, least: int) -> np.ndarray:
    """SPOTs of the windows of `least` words around the anchors that are among their text's `own`; `o` are the texts'."""
    of, h, at = placed_anchors(p, least)
    salt = K.mix(np.arange(1, len(o) + 1, dtype=np.uint64))
    wanted = own.flatten().to_numpy().view(np.uint64) ^ np.repeat(salt, pc.fill_null(pc.list_value_length(own), 0).to_numpy())
    some = np.isin(h ^ salt[of], wanted)
    of, at = of[some], at[some]
    edge = np.zeros(len(p.words) + 1, np.int32)
    np.add.at(edge, np.maximum(at + min(GRAM, least) - least, p.first[of]), 1)
    np.add.at(edge, np.minimum(at, p.first[of + 1] - least) + 1, -1)
    i = np.flatnonzero(np.cumsum(edge))
    text = np.searchsorted(p.first, i, "right") - 1
    out = np.empty(len(i), SPOT)
    out["h"], out["o"], out["f"], out["i"] = windows(p.words, least)[i], o[text], text_prints(p.words, p.first)[text], i - p.first[text]
    return out


def line_bits(members: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Parity bits in 32 bytes for a set of any size; they part less of the longest paragraphs."""
    n = len(first) - 1
    row = np.repeat(np.arange(n), np.diff(first)) * 256 + (members & np.uint64(255)).astype(np.int64)
    counts = np.bincount(row, minlength=256 * n).astype(np.uint8) & 1
    return np.packbits(counts.reshape(n, 256), axis=1, bitorder="little").view("V32").ravel()


def order_of(docs: DataFrame, id_col: str) -> Column:
    """A long that orders documents: an integer id itself, else a hash; null last."""
    integral = dict(docs.dtypes)[id_col] in ("tinyint", "smallint", "int", "bigint")
    return F.coalesce(F.col(id_col).cast("long") if integral else F.when(F.col(id_col).isNotNull(), F.xxhash64(id_col)), F.lit(NO_ID))


def common(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(anchors that several documents have, every anchor once with its least document)."""
    p = p[np.lexsort((p["o"], p["h"]))]
    new = np.ones(len(p), bool)
    new[1:] = (p["h"][1:] != p["h"][:-1]) | (p["o"][1:] != p["o"][:-1])
    p = p[new]
    first = np.flatnonzero(np.concatenate(([True], p["h"][1:] != p["h"][:-1])))
    size = np.diff(np.append(first, len(p)))
    return p[np.repeat(size > 1, size)], p[first]


def repeated(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(windows that a document with a lesser id has too, the others)."""
    p = p[np.lexsort((p["o"], p["h"]))]
    first = np.ones(len(p), bool)
    first[1:] = p["h"][1:] != p["h"][:-1]
    keeper = p["o"][np.flatnonzero(first)[np.cumsum(first) - 1]]
    later = p["o"] != keeper
    out = np.empty(int(later.sum()), REPEAT)
    for c in ("o", "f", "i"):
        out[c] = p[c][later]
    out["k"] = keeper[later]
    return out, p[~later]


def cell_of(x: np.ndarray, cells: int) -> np.ndarray:
    return (K.mix(x) >> np.uint64(32)) % np.uint64(cells)


def passages(rows: DataFrame, shared: DataFrame, least: int, cells: int) -> DataFrame:
    """o, and RUNs of windows that documents with lesser ids have too; `shared` has o and the anchors that others have."""
    bits = rows.sparkSession.sparkContext.broadcast(L.bitmap(shared.select(F.xxhash64("o").alias("key"))))

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(L.in_bitmap(bits.value, batch.column(1).to_numpy())))

    def sent(p: np.ndarray) -> Iterator[pa.RecordBatch]:
        later, p = repeated(p)
        if len(later):
            yield L.by_cell(REPEATS, later, cell_of(later["o"].view(np.uint64), cells))
        yield L.by_cell(SPOTS, p, cell_of(p["h"], cells))

    def around(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for b in R.pieces(batch, "t", SLICE):
                p = spots(Piece(b.column(1), least), b.column(0).to_numpy(), b.column(2), least)
                if len(p):
                    held.append(p)
                    n += len(p)
                if n >= L.FLUSH:
                    yield from sent(np.concatenate(held))
                    held, n = [], 0
        if n:
            yield from sent(np.concatenate(held))
        R.relieve()

    def meet(table: pa.Table) -> pa.Table:
        data = table.filter(pc.equal(table.column("kind"), SPOTS)).column("data")
        out = table.filter(pc.equal(table.column("kind"), REPEATS)).to_batches()
        if len(data):
            later, _ = repeated(np.concatenate([np.frombuffer(x.as_buffer(), SPOT) for x in data]))
            if len(later):
                out.append(L.by_cell(REPEATS, later, cell_of(later["o"].view(np.uint64), cells)))
        return pa.Table.from_batches(out, L.ARROW)

    def runs(table: pa.Table) -> pa.Table:
        p = np.concatenate([np.frombuffer(x.as_buffer(), REPEAT) for x in table.column("data")])
        p = p[np.lexsort((p["i"], p["f"], p["o"]))]
        new = np.ones(len(p), bool)
        new[1:] = (p["i"][1:] != p["i"][:-1] + 1) | (p["k"][1:] != p["k"][:-1]) | (p["f"][1:] != p["f"][:-1]) | (p["o"][1:] != p["o"][:-1])
        first = np.flatnonzero(new)
        r = np.empty(len(first), RUN)
        r["f"], r["k"], r["i"], r["n"] = p["f"][first], p["k"][first], p["i"][first], np.diff(np.append(first, len(p)))
        o = p["o"][first]
        at = np.flatnonzero(np.concatenate(([True], o[1:] != o[:-1])))
        return pa.table({"o": pa.array(o[at]), "runs": pa.array([r[x:y].tobytes() for x, y in zip(at, np.append(at[1:], len(r)))], pa.binary())})

    keyed = rows.select("o", F.xxhash64("o").alias("key"), "t")
    # merged, not broadcast: an exchange parts the two Python functions, so that a task needs a worker for one at a time
    some = keyed.mapInArrow(touched, keyed.schema).join(shared.hint("merge"), "o").select("o", "t", "anchors")
    met = some.mapInArrow(around, L.SCHEMA).repartition(cells, "cell").groupBy("cell").applyInArrow(meet, L.SCHEMA)
    return met.repartition(cells, "cell").groupBy("cell").applyInArrow(runs, "o long, runs binary")


def found(docs: DataFrame, id_col: str, text_col: str, least: int, num: int, den: int, recall: float) -> DataFrame:
    """o, what goes from that document: its paragraphs (`dups`) and RUNs of windows (`runs`)."""
    spark = docs.sparkSession
    rows = docs.select(order_of(docs, id_col).alias("o"), F.col(text_col).cast("string").alias("t"))
    cells = R.cell_count(spark, R.input_bytes(docs))
    bands, per_band = tuned(num / den, recall)

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dealer = L.Dealer(cells)
        held: list[np.ndarray] = []
        n = 0

        def send() -> Iterator[pa.RecordBatch]:
            many, p = common(np.concatenate(held))
            yield from L.packed(SHARED, many, cells)
            yield L.by_cell(ANCHORS, p, cell_of(p["h"], cells))

        for batch in batches:
            for b in R.pieces(batch, "t", SLICE):
                o, piece = b.column(0).to_numpy(), Piece(b.column(1), least)
                of, h = piece_anchors(piece, least)
                if len(h):
                    p = np.empty(len(h), ANCHOR)
                    p["h"], p["o"] = h, o[of]
                    held.append(p)
                    n += len(p)
                if len(piece.a):
                    members, first = piece.sets()
                    lines = np.empty(len(piece.a), LINE)
                    lines["fp"], lines["o"], lines["i"] = K.fingerprints(members, first), o[piece.of], piece.place()
                    lines["n"], lines["bits"] = np.diff(first), line_bits(members, first)
                    sig = band_hashes(members, first[:-1], bands, per_band)
                    post = np.empty(sig.size, L.POSTING)
                    post["sig"], post["fp"], post["n"] = sig.ravel(), np.repeat(lines["fp"], bands), np.repeat(lines["n"], bands)
                    yield from dealer.add(post)
                    yield from L.packed(LINES, lines, cells)
                if n >= L.FLUSH:
                    yield from send()
                    held, n = [], 0
        if n:
            yield from send()
        yield from dealer.flush()
        R.relieve()

    def cell(table: pa.Table) -> pa.Table:
        kind, data = table.column("kind").to_pylist(), table.column("data")
        out = [*L.cell_pairs(table, cells), *table.filter(pc.is_in(table.column("kind"), pa.array([LINES, SHARED], pa.int32()))).to_batches()]
        got = [np.frombuffer(data[i].as_buffer(), ANCHOR) for i, k in enumerate(kind) if k == ANCHORS]
        if got:
            out += L.packed(SHARED, common(np.concatenate(got))[0])
        R.relieve()
        return pa.Table.from_batches(out, L.ARROW)

    met = R.written(rows.mapInArrow(index, L.SCHEMA).repartition(cells, "cell").groupBy("cell").applyInArrow(cell, L.SCHEMA), "paragraphs")

    def unlined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                p = np.frombuffer(x, LINE)
                yield pa.record_batch([*(pa.array(p[c].copy()) for c in ("fp", "o", "i", "n")), pa.array([x.tobytes() for x in p["bits"]], pa.binary())], names=["fp", "o", "i", "n", "bits"])

    def unshared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                p = np.frombuffer(x, ANCHOR)
                yield pa.record_batch([pa.array(p["o"].copy()), pa.array(p["h"].astype(np.int64))], names=["o", "h"])

    lines = met.where(F.col("kind") == LINES).select("data").mapInArrow(unlined, "fp long, o long, i int, n int, bits binary")
    by_set = R.written(lines.groupBy("fp").agg(F.min(F.struct("o", "i")).alias("m"), F.max("o").alias("last"), F.first("n").alias("n"), F.first("bits").alias("bits")).select("fp", "m.o", "m.i", "last", "n", "bits"), "paragraph-sets")

    def sets_for(fps: DataFrame) -> DataFrame:
        wanted = R.written(fps.join(by_set.select("fp", "o", "i"), "fp"), "wanted")
        bits = spark.sparkContext.broadcast(L.bitmap(wanted.select(F.xxhash64("o").alias("key"))))
        keyed = rows.select("o", F.xxhash64("o").alias("key"), "t")

        def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                batch = batch.filter(pa.array(L.in_bitmap(bits.value, batch.column(1).to_numpy())))
                for b in R.pieces(batch, "t", SLICE):
                    piece = Piece(b.column(2), least)
                    if len(piece.a):
                        members, first = piece.sets()
                        yield pa.record_batch([pa.array(K.fingerprints(members, first)), pa.array(b.column(0).to_numpy()[piece.of]), pa.array(piece.place()), K.blobs(members, first)], names=["fp", "o", "i", "members"])
            R.relieve()

        return keyed.mapInArrow(fetch, "fp long, o long, i int, members binary").join(wanted, ["fp", "o", "i"]).select("fp", "members")

    roots = L.components(L.links(*L.pairs_and_stars(met, cells), by_set.select("fp", "n", "bits"), sets_for, num, den)).withColumnRenamed("node", "fp")
    joined = by_set.select("fp", "o", "last").join(roots, "fp", "left")
    merged = joined.where("root is not null")
    keeper = merged.groupBy("root").agg(F.min("o").alias("k"))
    of_set = merged.join(keeper, "root").select("fp", "k").unionByName(joined.where("root is null and last > o").select("fp", F.col("o").alias("k")))
    line_dups = lines.select("fp", "o", "i").join(of_set, "fp").where("o <> k").select("o", "i", F.col("fp").alias("h"), "k")
    shared = met.where(F.col("kind") == SHARED).select("data").mapInArrow(unshared, "o long, h long")
    shared = R.written(shared.groupBy("o").agg(F.collect_list("h").alias("anchors")), "anchors")
    of_lines = line_dups.groupBy("o").agg(F.collect_list(F.struct("i", "h", "k")).alias("dups"))
    return of_lines.join(R.written(passages(rows, shared, least, cells), "passages"), "o", "full")


def marked(t: Text, dups: list[dict] | None, runs: bytes | None, least: int) -> tuple[np.ndarray, list[int]]:
    """(which words go, documents that keep them)."""
    gone, keep = np.zeros(len(t.words), bool), set()
    r = np.frombuffer(runs or b"", RUN)
    if len(r) and len(t.words):
        for _, k, i, n in r[r["f"] == text_print(t.words)].tolist():
            gone[i : i + n - 1 + least] = True
            keep.add(k)
    lines = {d["i"]: d for d in dups or ()}
    for a, b in t.lines:
        d = lines.get(a)
        if d is not None and K.fingerprint(K.shingle_set(t.words[a:b], WORDS)) == d["h"]:
            gone[a:b] = True
            keep.add(d["k"])
    return gone, sorted(keep - {NO_ID})


def cut_text(raw: bytes, gone: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """The text without the words that go and the white space after each run of them; a line left empty goes too."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.view(np.int8), [0]])))
    out, at = [], 0
    for a, b in zip(edge[::2], edge[1::2]):
        out.append(raw[at : starts[a]])
        at = int(starts[b]) if b < len(starts) else len(raw)
        between = raw[ends[b - 1] : at]
        if b"\n" in between and out[-1] and not out[-1].endswith(b"\n"):
            out.append(b"\n")
    out.append(raw[at:])
    return b"".join(out).decode("utf-8")


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, num: int = NUM, den: int = DEN, recall: float = RECALL) -> DataFrame:
    """`docs` with the text cut, and n_words, removed_words, seen_in (for what went, ids of earlier documents
    that have it, not always the first ones: which depends on how the rows were read) added, in place of columns of these names."""
    spark = docs.sparkSession
    docs = docs.drop(*ADDED)
    R.ship(spark)
    with R.scratch() as keep:
        dups = keep(R.written(found(docs, id_col, text_col, least, num, den, recall), "duplicates"))
    bits = spark.sparkContext.broadcast(L.bitmap(dups.select(F.xxhash64("o").alias("key"))))
    keyed = docs.withColumn(text_col, F.col(text_col).cast("string")).withColumns({"_o": order_of(docs, id_col), "_key": F.xxhash64(order_of(docs, id_col))})
    docs_columns, place = docs.columns, docs.columns.index(text_col)
    schema = docs.withColumn(text_col, F.col(text_col).cast("string")).schema
    full = T.StructType([*schema.fields, T.StructField("n_words", T.LongType()), T.StructField("removed_words", T.LongType()), T.StructField("seen_in", T.ArrayType(T.LongType()))])

    def answer(b: pa.RecordBatch, text: pa.Array, n: list, removed: list, seen: list) -> pa.RecordBatch:
        cols = [b.column(i) for i in range(len(docs_columns))]
        cols[place] = text
        return pa.record_batch([*cols, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(seen, pa.list_(pa.int64()))], names=[*docs_columns, "n_words", "removed_words", "seen_in"])

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy()
            batch = batch.filter(pa.array(~L.in_bitmap(bits.value, key)))
            for b in R.pieces(batch, text_col, SLICE):
                raw, off = K.utf8(b.column(place))
                _, _, first = K.word_spans(raw, off)
                yield answer(b, b.column(place), np.diff(first).tolist(), [0] * b.num_rows, [[]] * b.num_rows)
        R.relieve()

    def touched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.column(batch.num_columns - 1).to_numpy()
            yield batch.filter(pa.array(L.in_bitmap(bits.value, key)))

    def applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in R.pieces(batch, text_col, SLICE):
                out, n, removed, seen = [], [], [], []
                dups, runs = (b.column(b.num_columns - k).to_pylist() for k in (2, 1))
                for raw, d, r, (t, starts, ends) in zip(b.column(place).to_pylist(), dups, runs, texts(b.column(place), least)):
                    n.append(len(t.words))
                    gone, keep = marked(t, d, r, least) if d or r else (np.zeros(0, bool), [])
                    removed.append(int(gone.sum()))
                    seen.append(keep)
                    out.append(cut_text(raw.encode(), gone, starts, ends) if gone.any() else raw)
                yield answer(b, pa.array(out, pa.string()), n, removed, seen)
        R.relieve()

    whole = keyed.mapInArrow(untouched, full)
    some = keyed.mapInArrow(touched, keyed.schema).join(dups.withColumnRenamed("o", "_o2").hint("merge"), F.col("_o") == F.col("_o2"), "left").drop("_o2")
    return whole.unionByName(some.mapInArrow(applied, full))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", "n_words", "removed_words", "text")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without what an earlier document has; documents of which no word is left go."""
    safe, back = R.apart(docs, ADDED)
    cut = deduplicated(safe)
    changed = F.col("removed_words") > 0
    cut = cut.where(~changed | (F.col("removed_words") < F.col("n_words")))
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(changed, F.length("text")).otherwise(F.col("n_chars")).cast(dict(docs.dtypes)["n_chars"]))
    return back(cut)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op9_substring_dedup": query}
