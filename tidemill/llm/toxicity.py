"""Toxicity by a subsequence string-kernel support vector machine.

The kernel compares two strings by their gapped subsequences of three characters
within five (each counts decay ** span, so a gap or an inserted character weakens
a match and doesn't undo it), normalised to 1 for equal strings. A sentence is as
toxic as its worst unit: a word without the punctuation around it, long words
in overlapping windows, words with marks inside also as their letters alone, and
rows of single characters joined.

Training: sentences of a bounded sample of labelled documents; a sentence has its
document's label, and a toxic one is stood for by its witness, the unit that the
present model finds worst (at first, the one whose subsequences are most
over-represented in toxic documents). `landmarks` units span the Nyström
approximation; a squared-hinge machine is solved by Newton steps in their space.
Its decision function is then one weight for each hashed subsequence, so a unit
is scored without the landmarks. A document's score is a logistic function,
fitted on the training documents, of its worst unit; 0.5 parts the classes.

Bounds: `per_class` documents of either label (the ones whose ids hash lowest),
`sentences` of each of them (evenly spread), read whole: of a longer sentence than
PART characters each part of about so many trains as a sentence. Everything else reads
all rows and whole texts. Null or empty texts get the score of a text without toxic units.
Very long texts are scored in parts cut at white space. Null labels are left out; of several labels of an id the least
counts, and of several texts of a labelled id the least trains. An empty table gives an empty one, empty labels give no model; if a class is missing from the labels, or no toxic document
has a unit that clean ones lack, all scores are 0. Repeated rows each get their row.
"""

import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.llm import _kernel as K
from tidemill.llm import _runtime as R

HASHED, DECAY, WINDOW = 1 << 20, 0.5, 14
PER_CLASS, SENTENCES, LANDMARKS, COST = 800, 64, 256, 1.0
PART = 1024
KNOWN = 1 << 17
#: Where in the machine's margin (-1 to 1) half may stand, toxic side first in doubt: unseen clean words reach a little over 0.
INSIDE = (0.25, 0.75)
_OFFSETS = [(j, k) for k in range(2, 5) for j in range(1, k)]
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_MARKS = re.compile(r"[\W_]+")
_SINGLES = re.compile(r"(?:(?<!\S)\S\s+){2,}\S(?!\S)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def units(token: str) -> list[str]:
    """The strings that a lower-case word is scored by."""
    word = _EDGE.sub("", token)
    out = []
    for w in {word, _MARKS.sub("", word)} if word else ():
        out += [w[i : i + WINDOW] for i in range(0, max(1, len(w) - WINDOW // 2), WINDOW // 2)]
    return out


def slices(text: str, n: int = 1 << 20) -> Iterator[str]:
    """A text in parts of about n characters, cut at white space where there is some."""
    at = 0
    while len(text) - at > n:
        cut = max(text.rfind(" ", at, at + n), text.rfind("\n", at, at + n))
        cut = at + n if cut <= at else cut
        yield text[at:cut]
        at = cut
    yield text[at:]


def tokens(text: str) -> set[str]:
    text = text.lower()
    found = set(text.split())
    for m in _SINGLES.finditer(text):
        found.add("".join(m[0].split()))
    return found


def subsequences(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(string, hashed subsequence, weight) in the strings' order, a row for each pair, weights of unit length."""
    marked = ["\x02" + s + "\x03" for s in strings]
    size = np.array([len(s) for s in marked], np.int64)
    code = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.repeat(np.arange(len(marked)), size)
    rows, keys, weights = [], [], []
    for j, k in _OFFSETS:
        if len(code) <= k:
            continue
        ok = np.flatnonzero(owner[k:] == owner[:-k])
        h = K.mix(code[ok] | code[ok + j] << np.uint64(21) | code[ok + k] << np.uint64(42))
        rows.append(owner[ok])
        keys.append((h & np.uint64(HASHED - 1)).astype(np.int64))
        weights.append(np.full(len(ok), DECAY ** (k + 1)))
    if not rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    pair = np.concatenate(rows) * HASHED + np.concatenate(keys)
    order = np.argsort(pair, kind="stable")
    pair, weight = pair[order], np.concatenate(weights)[order]
    first = np.flatnonzero(np.concatenate(([True], pair[1:] != pair[:-1])))
    weight, pair = np.add.reduceat(weight, first), pair[first]
    row = pair // HASHED
    norm = np.sqrt(np.bincount(row, weight**2, len(strings)))
    return row, pair % HASHED, weight / norm[row]


class Model:
    """Weights of the hashed subsequences, the bias, and the logistic function's two numbers."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float) -> None:
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def decide(self, strings: list[str]) -> np.ndarray:
        """Decision values; 4096 strings at a time, so many new words don't take much memory."""
        out = np.empty(len(strings))
        for a in range(0, len(strings), 4096):
            part = strings[a : a + 4096]
            row, key, w = subsequences(part)
            out[a : a + len(part)] = np.bincount(row, w * self.weights[key], len(part)) + self.bias
        return out

    def to_bytes(self) -> bytes:
        at = np.flatnonzero(self.weights).astype(np.int32)
        return np.array([self.bias, self.slope, self.shift]).tobytes() + np.int64(len(at)).tobytes() + at.tobytes() + self.weights[at].astype(np.float32).tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> "Model":
        bias, slope, shift = np.frombuffer(data, np.float64, 3).tolist()
        n = int(np.frombuffer(data, np.int64, 1, 24)[0])
        weights = np.zeros(HASHED, np.float32)
        weights[np.frombuffer(data, np.int32, n, 32)] = np.frombuffer(data, np.float32, n, 32 + 4 * n)
        return cls(weights, bias, slope, shift)

    def score(self, worst: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * worst + self.shift, -60, 60)))


def newton_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 15) -> tuple[np.ndarray, float]:
    """Squared hinge loss and a ridge, by Newton steps over the rows inside the margin; the last column of x is 1."""
    w, ridge = np.zeros(x.shape[1]), np.ones(x.shape[1])
    ridge[-1] = 1e-3
    for _ in range(rounds):
        inside = np.flatnonzero(1 - y * (x @ w.astype(np.float32)) > 0)
        h, g = np.diag(ridge), np.zeros(x.shape[1])
        for k in range(0, len(inside), 2048):
            part = inside[k : k + 2048]
            rows = x[part].astype(np.float64)
            a = rows * weight[part, None]
            h += rows.T @ a
            g += a.T @ y[part]
        new = np.linalg.solve(h, g)
        if np.abs(new - w).max() < 1e-6:
            break
        w = 0.5 * (w + new)
    return new[:-1], float(new[-1])


def table(strings: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first row of each string and one past the last, hashed subsequences, weights)."""
    most = sum((len(s) + 2) * len(_OFFSETS) for s in strings)  # memory that isn't filled isn't taken
    firsts, keys, weights, n = [np.zeros(1, np.int64)], np.empty(most, np.int32), np.empty(most, np.float32), 0
    for a in range(0, len(strings), 4096):
        part = strings[a : a + 4096]
        row, key, w = subsequences(part)
        firsts.append(n + np.cumsum(np.bincount(row, minlength=len(part))))
        keys[n : n + len(row)], weights[n : n + len(row)] = key, w
        n += len(row)
    return np.concatenate(firsts), keys[:n], weights[:n]


class Units:
    """All units of the training sentences with their subsequences, and the sentences as numbers of units."""

    def __init__(self, docs: Iterable[tuple[list[list[str]], int]]) -> None:
        labels, index, self.bags = [], {}, []
        for d, (sentences, y) in enumerate(docs):
            labels.append(y)
            self.bags += [(d, np.array(sorted({index.setdefault(u, len(index)) for u in s}), np.int32)) for s in sentences if s]
        self.labels = np.array(labels)
        self.n = len(index)
        names = list(index)
        index.clear()
        self.first, self.key, self.w = table(names) if names else (np.zeros(1, np.int64), np.zeros(0, np.int32), np.zeros(0, np.float32))
        self.size = np.diff(self.first)

    def every(self, ids: np.ndarray) -> np.ndarray:
        """Places of the units' subsequences."""
        n = self.size[ids]
        return np.repeat(self.first[ids], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)

    def decide(self, weights: np.ndarray) -> np.ndarray:
        out = np.empty(self.n)
        for a in range(0, self.n, 1 << 14):
            b = min(self.n, a + (1 << 14))
            s = slice(self.first[a], self.first[b])
            out[a:b] = np.add.reduceat(self.w[s] * weights[self.key[s]], self.first[a:b] - self.first[a])
        return out

    def most(self, odds: np.ndarray, k: int) -> np.ndarray:
        """The mean of each unit's k highest odds."""
        out = np.empty(self.n)
        for a in range(0, self.n, 1 << 14):
            b = min(self.n, a + (1 << 14))
            n = self.size[a:b]
            row = np.repeat(np.arange(b - a), n)
            value = odds[self.key[self.first[a] : self.first[b]]]
            order = np.lexsort((-value, row))
            top = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) < k
            out[a:b] = np.bincount(row, np.where(top, value[order], 0), b - a) / k
        return out


def fit(docs: Iterable[tuple[list[list[str]], int]], landmarks: int = LANDMARKS, rounds: int = 3) -> "Model | None":
    """A machine from all documents (sentences as lists of units, label). Its logistic function comes from two machines that each score the half they weren't fitted to."""
    units = Units(docs)
    del docs
    every = np.ones(len(units.labels), bool)
    whole = fit_machine(units, every, landmarks, rounds)
    if whole is None:
        return None
    worst, judged = np.full(len(every), -np.inf), np.zeros(len(every), bool)
    for k in (0, 1):
        other = np.arange(len(every)) % 2 == k
        half = fit_machine(units, ~other, landmarks, rounds)
        if half is not None:
            judged |= other
            worst[other] = np.maximum(units_worst(units, half), half[1])[other]
    if (units.labels[judged] == 1).sum() < 2 or (units.labels[judged] == 0).sum() < 2:
        worst, judged = np.maximum(units_worst(units, whole), whole[1]), every
    return Model(whole[0], whole[1], *logistic(worst[judged], units.labels[judged]))


def units_worst(units: Units, machine: tuple[np.ndarray, float]) -> np.ndarray:
    """By document, the decision value of its worst unit."""
    score = units.decide(machine[0]) + machine[1]
    worst = np.full(len(units.labels), -np.inf)
    for d, ids in units.bags:
        worst[d] = max(worst[d], score[ids].max())
    return worst


def fit_machine(units: Units, used: np.ndarray, landmarks: int, rounds: int) -> tuple[np.ndarray, float] | None:
    """(weights of the hashed subsequences, bias) from the documents in `used`."""
    labels, first, key, w, size = units.labels, units.first, units.key, units.w, units.size
    bags = [(d, ids) for d, ids in units.bags if used[d]]
    if len({int(labels[d]) for d, _ in bags}) < 2:
        return None
    # copies of a sentence count once, as clean if a clean document has it
    once: dict[bytes, tuple[int, np.ndarray]] = {}
    for d, ids in bags:
        once[ids.tobytes()] = (min(int(labels[d]), once.get(ids.tobytes(), (1,))[0]), ids)
    # in how many sentences of either label a unit and a subsequence are
    unit_in, sub_in, n = np.zeros((2, units.n), np.float32), np.zeros((2, HASHED), np.float32), np.zeros(2)
    for y, ids in once.values():
        unit_in[y, ids] += 1
        sub_in[y, np.unique(key[units.every(ids)])] += 1
        n[y] += 1
    once.clear()
    odds = np.log((sub_in[1] + 2) / (n[1] + 4)) - np.log((sub_in[0] + 2) / (n[0] + 4))
    score = units.most(odds, 4)  # a unit's first score
    clean, seen = unit_in
    present = int(((clean + seen) > 0).sum())
    # units in more toxic sentences, and hardly any clean ones, than chance gives any of so many are insults in any sentence
    chance = -np.log(n[1] / n.sum()) if 0 < n[1] < n.sum() else 1.0
    sure = np.flatnonzero((seen >= np.log(present) / chance + 1) & (seen / (n[1] + 1) > 12 * (clean + 1) / (n[0] + 1)))
    is_sure = np.zeros(units.n, bool)
    is_sure[sure] = True
    apart = np.flatnonzero((clean > 0) & ~is_sure)
    if not len(apart):
        return None
    common = apart[np.argsort(-clean[apart], kind="stable")]
    against = common[:4096]
    # other toxic documents are stood for by their worst unit, if a twentieth of them share its subsequences
    shared = max(np.log(HASHED / 8) / chance + 2, 0.05 * (labels[used] == 1).sum())
    plain = np.log((shared + 2) / 2 * (n[0] + 4) / (n[1] + 4))
    witness = set(sure.tolist())
    for d, ids in bags:
        if labels[d] == 1 and not is_sure[ids].any():
            ids = ids[clean[ids] == 0]
            if len(ids) and score[ids].max() > plain:
                witness.add(int(ids[np.argmax(score[ids])]))
    if not witness:  # with few or diverse labels nothing is frequent enough: every toxic document's worst unit that no clean one has
        best: dict[int, int] = {}
        for d, ids in bags:
            ids = ids[clean[ids] == 0]
            if labels[d] == 1 and len(ids):
                best[d] = max(best.get(d, ids[0]), ids[np.argmax(score[ids])], key=lambda u: score[u])
        witness = {int(u) for u in best.values()}
    if not witness:
        return None
    positive = np.array(sorted(witness), np.int64)
    for _ in range(rounds):
        hard = apart[np.argsort(-score[apart], kind="stable")]
        against = negative = np.unique(np.concatenate([against, hard[:6000], hard[:: max(1, len(hard) // 8192)]]))
        rest = positive[~is_sure[positive]]
        rest = rest[np.argsort(-score[rest], kind="stable")]
        room = max(0, landmarks // 2 - len(sure))
        rest = rest[np.unique(np.linspace(0, len(rest) - 1, min(len(rest), room)).astype(int))] if len(rest) and room else rest[:0]
        marks = np.concatenate([sure[: landmarks // 2], rest])
        marks = np.unique(np.concatenate([marks, common[: (landmarks - len(marks)) // 2], hard[: (landmarks - len(marks)) // 2]]))
        own = np.unique(key[units.every(marks)])  # a landmark's own subsequences; the last row stands for all others
        place = np.full(HASHED, len(own), np.int32)
        place[own] = np.arange(len(own))
        dense = np.zeros((len(own) + 1, len(marks)), np.float32)
        for c, u in enumerate(marks):
            dense[place[key[first[u] : first[u + 1]]], c] = w[first[u] : first[u + 1]]
        values, vectors = np.linalg.eigh(dense.T.astype(np.float64) @ dense)
        good = values > 1e-4 * values.max()
        half = vectors[:, good] / np.sqrt(values[good])
        rows = np.concatenate([positive, negative])
        x = np.ones((len(rows), half.shape[1] + 1), np.float32)
        for a in range(0, len(rows), 128):
            ids = rows[a : a + 128]
            at = units.every(ids)
            x[a : a + 128, :-1] = np.add.reduceat(dense[place[key[at]]] * w[at][:, None], np.cumsum(size[ids]) - size[ids]) @ half
        y = np.where(np.arange(len(rows)) < len(positive), 1.0, -1.0)
        weight = np.sqrt(seen[positive])
        cost = np.concatenate([0.2 * len(negative) * weight / weight.sum(), np.ones(len(negative))]) * COST
        v, bias = newton_svm(x, y, cost)
        weights = np.zeros(HASHED, np.float32)
        weights[own] = (dense @ (half @ v))[:-1]
        score = units.decide(weights) + bias
    return weights, bias


def logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the score's logistic function."""
    high, low = np.quantile(x[y == 0], 0.995), np.quantile(x[y == 1], 0.01)
    if low > high:  # parted: half stands nearer to the toxic side, as unseen clean texts bring more new words than unseen toxic ones
        middle = float(np.clip(high + 0.6 * (low - high), *INSIDE))
        slope = 8 / (low - high)
        return float(slope), float(-slope * middle)
    # if the classes overlap, half stands where the fewest are on the wrong side, clean ones counted twice
    order = np.argsort(x, kind="stable")
    wrong = np.cumsum(y[order] == 1) + 2 * ((y == 0).sum() - np.cumsum(y[order] == 0))
    k = int(np.flatnonzero(wrong == wrong.min())[-1])
    middle = x[order[k]] if k + 1 == len(x) else 0.4 * x[order[k]] + 0.6 * x[order[k + 1]]
    middle = float(np.clip(middle, *INSIDE))
    slope = 4 / max(float(x.std()), 1e-6)
    return float(slope), float(-slope * middle)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def sentences_of(text: str, most: int = SENTENCES) -> list[list[str]]:
    parts = [p for p in _SENTENCE.split(text) if p.strip()]
    if len(parts) > most:
        parts = [parts[i * len(parts) // most] for i in range(most)]
    return [[u for t in sorted(tokens(part)) for u in units(t)] for p in parts for part in slices(p, PART)]


def trained(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS, sentences: int = SENTENCES, landmarks: int = LANDMARKS) -> "Model | None":
    """A model of `labels` (doc_id, toxic), fitted in a task to at most 2 * per_class documents' sentences; the driver gets the model alone."""
    R.ship(docs.sparkSession)
    known = labels.select(F.col("doc_id").alias("i"), F.col("toxic").cast("int").alias("y")).where(F.col("i").isNotNull() & F.col("y").isin(0, 1) & ~is_held_out(F.col("i")))
    known = known.groupBy("i").agg(F.min("y").alias("y"))
    ids = [known.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(per_class) for y in (0, 1)]
    sample = ids[0].unionByName(ids[1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [("\x1e".join("\x1f".join(s) for s in sentences_of(t or "", sentences))) for t in batch.column(1).to_pylist()]
            yield pa.record_batch([batch.column(0), batch.column(2), pa.array(got, pa.string())], names=["i", "y", "s"])

    texts = docs.select(F.col("doc_id").alias("i"), F.col("text").cast("string").alias("t")).join(F.broadcast(sample), "i").groupBy("i", "y").agg(F.min("t").alias("t")).select("i", "t", "y")

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [(str(i), y, s) for b in batches for i, y, s in zip(*(c.to_pylist() for c in b.columns))]
        rows.sort()  # a bounded sample
        model = fit((([s.split("\x1f") for s in text.split("\x1e") if s], y) for _, y, text in rows), landmarks) if rows else None
        del rows
        R.relieve()
        if model is not None:
            yield pa.record_batch([pa.array([model.to_bytes()], pa.binary())], names=["model"])

    sample = texts.mapInArrow(run, f"i {dict(docs.dtypes)['doc_id']}, y int, s string").repartition(1)
    got = sample.mapInArrow(fitted, "model binary").collect()
    return Model.from_bytes(bytes(got[0].model)) if got else None


class Scorer:
    """Documents' worst decision values; remembers words up to a bound."""

    def __init__(self, model: Model) -> None:
        self.model, self.known = model, {}

    def learn(self, words: list[str]) -> None:
        if len(self.known) + len(words) > KNOWN:
            self.known.clear()
        parts = [(t, units(t)) for t in words]
        flat = [u for _, us in parts for u in us]
        value = self.model.decide(flat) if flat else np.zeros(0)
        at = 0
        for t, us in parts:
            self.known[t] = float(value[at : at + len(us)].max()) if us else self.model.bias
            at += len(us)

    def worst(self, texts: list[str]) -> np.ndarray:
        out = np.full(len(texts), self.model.bias)
        for i, text in enumerate(texts):
            for part in slices(text):
                found = tokens(part)
                new = [t for t in found if t not in self.known]
                if new:
                    self.learn(new)
                    if any(t not in self.known for t in found):
                        self.learn([t for t in found if t not in self.known])
                if found:
                    out[i] = max(out[i], max(map(self.known.__getitem__, found)))
        return out


def scored(docs: DataFrame, model: "Model | None") -> DataFrame:
    """`docs` with score (0 to 1) and predicted added, in place of columns of these names; no other column is changed."""
    spark = docs.sparkSession
    docs = docs.drop("score", "predicted")
    R.ship(spark)
    text = docs.withColumn("text", F.col("text").cast("string"))
    if model is None:
        return text.withColumns({"score": F.lit(0.0), "predicted": F.lit(0)})
    held = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")
    schema = T.StructType([*text.schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(held.value)
        for batch in batches:
            for b in R.pieces(batch, "text"):
                score = held.value.score(scorer.worst([x or "" for x in b.column(place).to_pylist()]))
                yield pa.record_batch([*b.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*b.schema.names, "score", "predicted"])
        del scorer
        R.relieve()

    return text.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    got = scored(docs, trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return got.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that aren't found toxic."""
    model = trained(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    safe, back = R.apart(docs, ("score", "predicted"))
    return back(scored(safe, model).where("predicted = 0"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op3_toxicity": query}
