"""Token counts of byte-level BPE by rank-synchronous merging of ragged arrays.

A batch's unseen pre-tokens are held as one flat symbol array with their sequence
numbers. Each round looks up every adjacent pair's merge rank, takes each
sequence's lowest one, merges all its occurrences (left to right, without
overlap) in all sequences at once, and drops the sequences that are done. A
pair that holds a merged symbol always ranks after the merge that made it, so
this gives what a queue of single merges gives.

Texts: null counts as empty (0 bytes, 0 tokens). Strings of special tokens in a
text are one token each, as the library does by default. Nothing is truncated: very long texts are
counted whole, and so are their very long pre-tokens. Repeated rows, and null ids, each get their row; an empty table gives an empty
one; other columns of the input are not read, so they may have any name.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R

#: Fixed value: the byte-level pre-tokenizer's pattern, white space spelled out.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
KNOWN, LONG = 1 << 19, 4096
FREE = np.iinfo(np.int64).max


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in the vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = (b for b in range(256) if b not in set(plain))
    to = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [to[b] for b in range(256)]


class Merger:
    """Counts the symbols that a pre-token is left with."""

    def __init__(self, spec: str) -> None:
        d = json.loads(spec)
        vocab, merges = d["model"]["vocab"], [m if isinstance(m, list) else m.split(" ") for m in d["model"]["merges"]]
        self.byte = np.array([vocab[c] for c in byte_letters()], np.int64)
        key = np.array([vocab[a] << 32 | vocab[b] for a, b in merges], np.int64)
        order = np.argsort(key, kind="stable")
        self.key, self.rank = key[order], order.astype(np.int64)
        self.made = np.array([vocab[a + b] for a, b in merges], np.int64)
        special = [t["content"] for t in d.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.split = regex.compile(PATTERN)
        self.known: dict[str, int] = {}
        self.pairs: dict[int, int] | None = None

    def lengths(self, tokens: list[str]) -> np.ndarray:
        """Symbols left of each pre-token, all merged together."""
        raw = [t.encode("utf-8", "surrogatepass") for t in tokens]
        size = np.array([len(x) for x in raw], np.int64)
        sym = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        seq = np.repeat(np.arange(len(raw)), size)
        left = size.copy()
        while len(sym) > 1:
            at = np.flatnonzero(seq[1:] == seq[:-1])
            key = sym[at] << 32 | sym[at + 1]
            place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            rank = np.where(self.key[place] == key, self.rank[place], FREE)
            low = np.full(len(raw), FREE)
            first = np.flatnonzero(np.concatenate(([True], seq[at][1:] != seq[at][:-1]))) if len(at) else at
            if not len(first):
                break
            low[seq[at][first]] = np.minimum.reduceat(rank, first)
            hit = (rank == low[seq[at]]) & (rank != FREE)
            if not hit.any():
                break
            where, ranks = at[hit], rank[hit]
            begins = np.concatenate(([True], where[1:] != where[:-1] + 1))
            run = np.flatnonzero(begins)[np.cumsum(begins) - 1]
            every_other = (np.arange(len(where)) - run) % 2 == 0
            where, ranks = where[every_other], ranks[every_other]
            sym[where] = self.made[ranks]
            left -= np.bincount(seq[where], minlength=len(raw))
            stay = (low != FREE)[seq]
            stay[where + 1] = False
            sym, seq = sym[stay], seq[stay]
        return left

    def long_length(self, token: str) -> int:
        """The same for one very long pre-token: positions are kept by the rank of their pair, so a round touches its merges only."""
        if self.pairs is None:
            self.pairs = {int(k): int(r) for k, r in zip(self.key, self.rank)}
            self.sides = dict(zip(self.rank.tolist(), self.key.tolist()))
        ids = self.byte[np.frombuffer(token.encode("utf-8", "surrogatepass"), np.uint8)]
        n = left = len(ids)
        key = ids[:-1] << 32 | ids[1:]
        place = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        at = np.flatnonzero(self.key[place] == key)
        ranks = self.rank[place[at]]
        order = np.argsort(ranks, kind="stable")
        at, ranks = at[order], ranks[order]
        ends = np.append(np.flatnonzero(np.diff(ranks)) + 1, len(ranks)) if len(ranks) else []
        held: dict[int, list[int]] = {}
        start = 0
        for e in ends:
            held[int(ranks[start])] = at[start:e].tolist()
            start = e
        todo = sorted(held)
        sym, after, before = ids.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        while todo:
            rank = heapq.heappop(todo)
            a, b = self.sides[rank] >> 32, self.sides[rank] & 0xFFFFFFFF
            made = int(self.made[rank])
            for i in sorted(held.pop(rank)):
                j = after[i]
                if sym[i] != a or j >= n or sym[j] != b:
                    continue
                sym[i], sym[j], k, left = made, -1, after[j], left - 1
                after[i] = k
                if k < n:
                    before[k] = i
                for x, y in ((before[i], i), (i, k)):
                    if x >= 0 and y < n and (r := self.pairs.get(sym[x] << 32 | sym[y])) is not None:
                        if r not in held:
                            held[r] = []
                            heapq.heappush(todo, r)
                        held[r].append(x)
        return left

    def learn(self, tokens: set[str]) -> None:
        if len(self.known) + len(tokens) > KNOWN:
            self.known.clear()
        batch, size = [], 0
        for t in [*tokens, None]:
            if t is None or size > 1 << 20:
                if batch:
                    self.known.update(zip(batch, self.lengths(batch).tolist()))
                batch, size = [], 0
            if t is not None and len(t) > LONG:
                self.known[t] = self.long_length(t)
            elif t is not None:
                batch.append(t)
                size += len(t)

    def counts(self, texts: list[str]) -> list[int]:
        out = []
        for text in texts:
            total, parts = 0, [text]
            if self.special is not None:
                parts = self.special.split(text)
                total = len(parts) - 1
            for part in parts:
                found = (m.group() for m in self.split.finditer(part)) if len(part) > 1 << 20 else iter(self.split.findall(part))
                while tokens := list(islice(found, 1 << 16)):
                    known = self.known
                    try:
                        total += sum(map(known.__getitem__, tokens))
                    except KeyError:
                        self.learn({t for t in tokens if t not in known})
                        missing = {t for t in tokens if t not in known}
                        if missing:
                            self.learn(missing)
                        total += sum(map(known.__getitem__, tokens))
            out.append(total)
        return out


def token_counts(docs: DataFrame, spec_path: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 1024) -> DataFrame:
    """id_col, n_bytes, n_tokens, over_limit, bytes_per_token of each row of `docs`.

    `spec_path` is a tokenizer file on the driver; its vocabulary (a few MB, fixed) is sent along.
    """
    spark = docs.sparkSession
    R.ship(spark)
    with open(spec_path, encoding="utf-8") as f:
        spec = spark.sparkContext.broadcast(f.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merger: Merger | None = None
        for batch in batches:
            merger = merger or Merger(spec.value)
            for b in R.pieces(batch, "t"):
                texts = [x or "" for x in b.column(1).to_pylist()]
                n = np.array(merger.counts(texts), np.int64)
                size = pc.fill_null(pc.binary_length(b.column(1)), 0).cast(pa.int64())
                yield pa.record_batch([b.column(0), size, pa.array(n)], names=["i", "n_bytes", "n_tokens"])

    found = docs.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).mapInArrow(run, f"i {kind}, n_bytes long, n_tokens long")
    return found.select(
        F.col("i").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"),
        F.when(F.col("n_tokens") > 0, F.col("n_bytes") / F.col("n_tokens")).alias("bytes_per_token"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op2_token_counts": query}
