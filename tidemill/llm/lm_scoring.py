"""Language-model scoring by cross-entropy difference.

Two bigram models are matched: one vocabulary, one order, one discount, one smoothing. The target
model counts the documents labelled as good, the background model counts all documents. The
vocabulary is every word of the corpus, and every pair of words is counted as itself, so what is
gathered grows with the input; nothing but four totals comes to the driver or is broadcast.

A document is its words and an end; each of them is predicted from the word before it, the first
from a beginning. A pair's share of what follows its first word counts SHARE, and the rest goes to
unigrams smoothed by one over the vocabulary and the end (Jelinek-Mercer). A document's score is the
mean over its words and its end of the target's loss minus the background's, in bits: lower is more
like the target.

Texts are taken in batches of about BATCH bytes, whatever Spark hands over at a time, and kept
compressed. A batch sends each of its different pairs and words once, with its counts, to the cell
that has its hash in its range; the number of cells grows with the input, and a pair's cell goes by
the pair, so a frequent word has no cell of its own. Keys are sent in order, as the gaps between
them. A cell adds up what all batches have sent and answers each in the order of its keys. What is
frequent costs its cell one row a batch, however often the batch has it.

Words are runs of `[^\\x20\\x09-\\x0D]+`, A-Z as a-z, and stand as 64-bit hashes. Texts are read
whole; a very long one is a batch of its own. Null and empty texts have no words, no part in the
counts, and null losses. Without target documents the target model is uniform. Of target ids, nulls
and repeats count once or not at all; rows that repeat a document's id or text each count and each
get their row. There is no order and no cut-off, so there are no ties. Empty tables give empty
tables. Other columns of the input, whatever their names, are not read and not returned.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import _kernel as K
from tidemill.llm import _runtime as R

SHARE = 0.75
BATCH, CELL = 8 << 20, 4 << 20
PARTITIONS = 1 << 17
KNOWN_IDS = 2_000_000
BEGIN, END = np.uint64(1), np.uint64(2)
PAIRS, WORDS = 0, 1
#: Of a message: the gap before a pair's or word's hash, and how often a batch has it in background and target; of an answer: how often all have it.
SENT, ANSWER = 3, 2


def packed(columns: list[np.ndarray]) -> bytes:
    """The columns one after the other, each by its first bytes, its second ones and so on, up to the last that any number in it needs."""
    widths = [max(1, (int(x.max(initial=0)).bit_length() + 7) // 8) for x in columns]
    return bytes(widths) + b"".join(np.ascontiguousarray(x, "<u8").view(np.uint8).reshape(-1, 8)[:, :w].T.tobytes() for x, w in zip(columns, widths))


def unpacked(data: bytes, columns: int) -> list[np.ndarray]:
    widths, at = data[:columns], columns
    n = (len(data) - at) // sum(widths)
    out = []
    for w in widths:
        x = np.zeros((n, 8), np.uint8)
        x[:, :w] = np.frombuffer(data, np.uint8, n * w, at).reshape(w, n).T
        out.append(x.view("<u8").ravel())
        at += n * w
    return out


def stream(rows: pa.Table) -> bytes:
    """`rows` as a compressed Arrow stream."""
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 3))) as out:
        out.write_table(rows)
    return sink.getvalue().to_pybytes()


def streamed(data: pa.BinaryScalar) -> pa.Table:
    return pa.ipc.open_stream(data.as_buffer()).read_all()


def distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(what sorts `keys`, where each different key begins then)."""
    order = np.argsort(keys)
    k = keys[order]
    return order, np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.zeros(0, np.int64)


def dealt(keys: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """(the cells that get some of `keys`, which are in order, where they begin and the end): each cell has a range of hashes."""
    cell = ((keys >> np.uint64(32)) * np.uint64(cells)) >> np.uint64(32)
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    return cell[at].astype(np.int64), np.append(at, len(cell))


def least(cell: int, cells: int) -> int:
    """The first hash of a cell's range."""
    return -(-(cell << 32) // cells) << 32


def gaps(keys: np.ndarray, cell: np.ndarray, at: np.ndarray, cells: int) -> np.ndarray:
    """How far each key is from the one before it in its cell, or from where its cell begins."""
    before = np.empty_like(keys)
    before[1:] = keys[:-1]
    before[at[:-1]] = np.array([least(c, cells) for c in cell.tolist()], np.uint64)
    return keys - before


class Keys:
    """Different keys in order, and the place among them of each of those given."""

    def __init__(self, keys: np.ndarray) -> None:
        self.order, self.at = distinct(keys)
        self.keys = keys[self.order[self.at]]
        self.times = np.diff(np.append(self.at, len(keys)))

    def sums(self, x: np.ndarray) -> np.ndarray:
        return np.add.reduceat(x[self.order].astype(np.int64), self.at) if len(self.at) else np.zeros(0, np.int64)

    def places(self) -> np.ndarray:
        out = np.empty(len(self.order), np.int64)
        out[self.order] = np.repeat(np.arange(len(self.at)), self.times)
        return out


class Pairs:
    """The number of words of some texts, and for each word and end its hash, the one before and the pair's."""

    def __init__(self, column: pa.Array) -> None:
        raw, off = K.utf8(column)
        starts, ends, first = K.word_spans(raw, off)
        self.n = np.diff(first)
        self.has = self.n > 0
        h = K.word_hashes(raw, starts, ends)
        self.before, self.after = np.insert(h, first[:-1][self.has], BEGIN), np.insert(h, first[1:][self.has], END)
        self.key = K.mix(K.mix(self.before) + self.after)
        self.asked = {PAIRS: Keys(self.key), WORDS: Keys(self.before)}


def table_of(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.Table:
    columns = zip(*rows) if rows else ([] for _ in names)
    return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


MESSAGE = "kind int, cell long, batch long, data binary"
_MESSAGE = (["kind", "cell", "batch", "data"], [pa.int32(), pa.int64(), pa.int64(), pa.binary()])
_TOTALS = (["n", "b", "t"], [pa.int64()] * 3)


def batched(rows: DataFrame) -> DataFrame:
    """Batches of rows, each with its number and its i, t and good as a stream; to be written, as the numbers are drawn."""

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def one() -> pa.RecordBatch:
            at = int.from_bytes(os.urandom(8), "little") >> 1
            return pa.record_batch([pa.array([at], pa.int64()), pa.array([stream(pa.Table.from_batches(held).combine_chunks())], pa.binary())], names=["batch", "data"])

        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            for b in R.pieces(batch, "t", max(1, BATCH // 8)):
                n = b.column(1).nbytes
                if held and size + n > BATCH:
                    yield one()
                    held, size = [], 0
                held.append(b)
                size += n
        if held:
            yield one()

    return rows.select("i", "t", "good").mapInArrow(number, "batch long, data binary")


def messages(table: DataFrame, cells: int) -> DataFrame:
    """What each batch sends: its pairs and its words with their counts."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                b = streamed(data)
                p = Pairs(b.column("t").combine_chunks())
                if not len(p.key):
                    continue
                good = np.repeat(b.column("good").to_numpy(), np.where(p.has, p.n + 1, 0))
                rows = []
                for kind, a in p.asked.items():
                    to, at = dealt(a.keys, cells)
                    columns = gaps(a.keys, to, at, cells), a.times, a.sums(good)
                    rows += [(kind, int(cell), number, packed([c[x:y] for c in columns])) for cell, x, y in zip(to, at[:-1], at[1:])]
                yield table_of(rows, *_MESSAGE).combine_chunks().to_batches()[0]
        R.relieve()

    return table.select("batch", "data").mapInArrow(send, MESSAGE)


def answers(table: DataFrame, cells: int) -> DataFrame:
    """The counts over all batches of what each batch has sent, in its order; and, without a batch, for
    each cell of words n different ones, b and t in all."""

    def add(got: pa.Table) -> pa.Table:
        kind, cell = got.column("kind")[0].as_py(), got.column("cell")[0].as_py()
        sent = [unpacked(data, SENT) for data in got.column("data").to_pylist()]
        first = np.uint64(least(cell, cells))
        a = Keys(np.concatenate([first + np.cumsum(k) for k, _, _ in sent]))
        b, t = (a.sums(np.concatenate([p[c] for p in sent])) for c in (1, 2))
        place = a.places()
        rows, end = [], 0
        for batch, (k, _, _) in zip(got.column("batch").to_pylist(), sent):
            x, end = end, end + len(k)
            rows.append((kind, cell, batch, packed([b[place[x:end]], t[place[x:end]]]), None, None, None))
        if kind == WORDS:
            rows.append((kind, cell, None, None, len(a.keys), int(b.sum()), int(t.sum())))
        return table_of(rows, [*_MESSAGE[0], *_TOTALS[0]], [*_MESSAGE[1], *_TOTALS[1]])

    sent = messages(table, cells).repartition(min(cells, PARTITIONS), "kind", "cell").groupBy("kind", "cell")
    return sent.applyInArrow(add, MESSAGE + ", n long, b long, t long")


def loss(c: np.ndarray, before: np.ndarray, after: np.ndarray, total: int, size: int) -> np.ndarray:
    """Bits of a word that occurs `after` times, after one that occurs `before` times, `c` times with this."""
    single = (after + 1.0) / (total + size)
    return -np.log2(np.where(before > 0, SHARE * c / np.maximum(before, 1) + (1 - SHARE) * single, single))


def with_target(docs: DataFrame, target_ids: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """i, t and whether the document is in the target; the ids are broadcast if they are at most KNOWN_IDS."""
    ids = target_ids.select(F.col(target_ids.columns[0]).alias("_j")).where("_j is not null").distinct().withColumn("_good", F.lit(True))
    few = ids.limit(KNOWN_IDS + 1).count() <= KNOWN_IDS
    rows = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t"))
    return rows.join(F.broadcast(ids) if few else ids, F.col("i") == F.col("_j"), "left").select("i", "t", F.coalesce("_good", F.lit(False)).alias("good"))


def scored(docs: DataFrame, target_ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_words, target_loss, background_loss, difference of every row."""
    spark = docs.sparkSession
    R.ship(spark)
    id_type = dict(docs.dtypes)[id_col]
    i_type = spark.createDataFrame([], f"i {id_type}").toArrow().schema.field("i").type  # may be null all through, unlike in the batches
    cells = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), R.input_bytes(docs) // CELL)
    with R.scratch() as keep:
        table = keep(R.written(batched(with_target(docs, target_ids, id_col, text_col)), "lm-batches"))
        found = keep(R.written(answers(table, cells), "lm-answers", compression="zstd"))
        size, total_b, total_t = (x or 0 for x in found.agg(F.sum("n"), F.sum("b"), F.sum("t")).first())

    def losses(column: pa.Array, answered: dict[int, list[tuple[int, bytes]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(words, target's loss, background's loss) of each text of a batch; answers come in the order of the questions."""
        p = Pairs(column)
        out = np.full((2, len(p.n)), np.nan)
        if len(p.key):
            place = {}
            counts = {}
            for kind, a in p.asked.items():
                told = sorted(answered[kind])
                parts = [unpacked(data, ANSWER) for _, data in told]
                to, at = dealt(a.keys, cells)
                if [c for c, _ in told] != to.tolist() or [len(x[0]) for x in parts] != np.diff(at).tolist():
                    raise ValueError("answers don't fit the questions of this batch")
                counts[kind] = {name: np.concatenate([x[c] for x in parts]) for c, name in enumerate("bt")}
                place[kind] = a.places()
            after = np.searchsorted(p.asked[WORDS].keys, np.where(p.after == END, BEGIN, p.after))  # as many ends as beginnings
            first = np.concatenate(([0], np.cumsum(p.n[p.has] + 1)[:-1]))
            pair, word = counts[PAIRS], counts[WORDS]
            for side, (c, total) in enumerate((("t", total_t), ("b", total_b))):
                bits = loss(pair[c][place[PAIRS]], word[c][place[WORDS]], word[c][after], total, size)
                out[side, p.has] = np.add.reduceat(bits, first) / (p.n[p.has] + 1)
        return p.n, out[0], out[1]

    def score(batch: pa.Table, got: pa.Table) -> pa.Table:
        if batch.num_rows != 1:
            raise ValueError(f"{batch.num_rows} batches of one number")
        rows = streamed(batch.column("data")[0])
        answered: dict[int, list[tuple[int, bytes]]] = {PAIRS: [], WORDS: []}
        for kind, cell, data in zip(*(got.column(c).to_pylist() for c in ("kind", "cell", "data"))):
            answered[kind].append((cell, data))
        n, t, b = losses(rows.column("t").combine_chunks(), answered)
        cols = [pa.array(x, pa.float64(), from_pandas=True) for x in (t, b, t - b)]
        return pa.table([rows.column("i").cast(i_type), pa.array(n, pa.int64()), *cols], names=["i", "n_words", "target_loss", "background_loss", "difference"])

    told = found.where("batch is not null").select(*_MESSAGE[0])
    kind = f"i {id_type}, n_words long, target_loss double, background_loss double, difference double"
    return table.groupBy("batch").cogroup(told.groupBy("batch")).applyInArrow(score, kind).withColumnRenamed("i", id_col)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    got = scored(spark.read.parquet(f"{sf_dir}/documents.parquet"), good)
    return got.select("doc_id", "n_words", *(F.round(c, 6).alias(c) for c in ("target_loss", "background_loss", "difference")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op4_lm_scoring": query}
