"""Links between sets that share signatures, down to their exact components.

Postings (signature, set, size) are dealt by signature into cells; the sets of one
signature are a group. Every group gives its star: one set, the pivot (that whose hash is least),
with each other. A frequent signature's group gives stars within a task first, so
that a task sends one pivot for it and not its sets; the cell where the tasks' pivots
meet names their common pivot, which gets the stars of all of them. Pairs are judged by an upper
bound of their intersection first and on the sets after that. What the stars leave
open are pairs that aren't connected by what has been found: of a group of at most
SMALL sets, all of them; of a larger one those that the pivot doesn't rule out (the Jaccard
distance is a metric, so two sets can be linked only if their distances to the
pivot differ by no more than the allowed distance), STARS more pivots among its sets that aren't
linked to the first one getting stars before their pairs are taken. The joins that pair a group's
sets compare parity bits first and give only what these can't rule out. So no component
is missed, and groups of near copies don't give all their pairs.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tidemill.llm import _kernel as K
from tidemill.llm import _runtime as R

SMALL, STARS, FLUSH, LONGS = 32, 4, 1 << 18, 32
POSTING = np.dtype([("sig", "<u8"), ("fp", "<i8"), ("n", "<i4")])
PAIR = np.dtype([("a", "<i8"), ("b", "<i8")])
GROUP = np.dtype([("g", "<i8"), ("fp", "<i8"), ("n", "<i4")])


def postings(sig: np.ndarray, fp: int, n: int) -> np.ndarray:
    out = np.empty(len(sig), POSTING)
    out["sig"], out["fp"], out["n"] = sig, fp, n
    return out


def paired(p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(small groups' stars, their members if more than two, large groups' stars, pivots that other pivots' stars go to, postings that go on).

    A posting whose n is negative stands for a task's large group; a group that has one is large.
    """
    p = p[np.argsort(np.ascontiguousarray(p["sig"]))]
    if len(p):  # most signatures stand alone: only the others' postings are put in order
        same = np.flatnonzero(p["sig"][1:] == p["sig"][:-1])
        at = np.unique(np.concatenate([same, same + 1]))
        q = p[at]
        p[at] = q[np.lexsort((q["n"], K.mix(q["fp"].view(np.uint64)), q["sig"]))]
    if not len(p):
        return np.empty(0, PAIR), np.empty(0, GROUP), np.empty(0, PAIR), np.empty(0, PAIR), p
    new = np.ones(len(p), bool)
    new[1:] = (p["sig"][1:] != p["sig"][:-1]) | (p["fp"][1:] != p["fp"][:-1])
    p = p[new]
    first = np.flatnonzero(np.concatenate(([True], p["sig"][1:] != p["sig"][:-1])))
    size = np.diff(np.append(first, len(p)))
    pivot = np.repeat(first, size)
    stands = p["n"] < 0
    large = (size > SMALL) | np.logical_or.reduceat(stands, first)
    leaf = np.repeat(large, size) & (np.arange(len(p)) != pivot)
    stars = unique_pairs(as_pairs(p["fp"][pivot[leaf]], p["fp"][leaf]))
    onto = leaf & stands
    chain = unique_pairs(as_pairs(p["fp"][pivot[onto]], p["fp"][onto]))
    name = np.add.reduceat(K.mix(p["fp"].view(np.uint64)), first) ^ K.mix(size.astype(np.uint64))
    small = np.flatnonzero((size > 1) & ~large)
    small = small[np.unique(name[small], return_index=True)[1]]  # groups of the same sets count once
    at = np.repeat(first[small], size[small]) + np.arange(size[small].sum()) - np.repeat(np.cumsum(size[small]) - size[small], size[small])
    ends = at[at != pivot[at]]
    pairs = unique_pairs(as_pairs(p["fp"][pivot[ends]], p["fp"][ends]))
    more = at[np.repeat(size[small] > 2, size[small])]
    groups = np.empty(len(more), GROUP)
    groups["g"], groups["fp"], groups["n"] = np.repeat(name, size)[more].view(np.int64), p["fp"][more], p["n"][more]
    lead = first[large]
    p["n"][lead] = -np.abs(p["n"][lead])
    return pairs, groups, stars, chain, p[~leaf]


def as_pairs(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.empty(len(a), PAIR)
    out["a"], out["b"] = a, b
    return out


def unique_pairs(p: np.ndarray) -> np.ndarray:
    """`p` in order of its first two fields, equal ones once."""
    x, y = p.dtype.names[:2]
    p = p[np.lexsort((p[y], p[x]))]
    new = np.ones(len(p), bool)
    new[1:] = (p[x][1:] != p[x][:-1]) | (p[y][1:] != p[y][:-1])
    return p[new]


def pair_cell(p: np.ndarray, cells: int) -> np.ndarray:
    x, y = (p[c].view(np.uint64) if p[c].flags.c_contiguous else p[c].astype(np.uint64) for c in p.dtype.names[:2])
    return (K.mix(x ^ K.mix(y)) >> np.uint64(32)) % np.uint64(cells)


SCHEMA = "kind int, cell int, data binary"
ARROW = pa.schema([("kind", pa.int32()), ("cell", pa.int32()), ("data", pa.binary())])
POSTS, PAIRS, STAR, GROUPS, CHAIN = 0, 1, 2, 6, 7


def packed(kind: int, data: np.ndarray, cells: int = 1, step: int = 1 << 16) -> Iterator[pa.RecordBatch]:
    """Rows that pass through the cells as they are, spread over them."""
    for a in range(0, len(data), step):
        part = data[a : a + step].tobytes()
        yield pa.record_batch([pa.array([kind], pa.int32()), pa.array([zlib.crc32(part[:64]) % cells], pa.int32()), pa.array([part], pa.binary())], schema=ARROW)


def by_cell(kind: int, data: np.ndarray, cell: np.ndarray) -> pa.RecordBatch:
    """A row for each cell that has some of `data`."""
    order = np.argsort(cell.astype(np.uint16) if len(cell) and cell.max() < 1 << 16 else cell, kind="stable")  # numbers of 16 bits are sorted by radix
    data, cell = data[order], cell[order].astype(np.int32)
    at = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
    ends = np.append(at[1:], len(cell))
    return pa.record_batch([pa.array(np.full(len(at), kind, np.int32)), pa.array(cell[at]), pa.array([data[a:b].tobytes() for a, b in zip(at, ends)], pa.binary())], schema=ARROW)


class Dealer:
    """A task's postings on their way to the cells."""

    def __init__(self, cells: int, most: int = FLUSH) -> None:
        self.cells, self.most = cells, most
        self.held: list[np.ndarray] = []
        self.n = 0

    def add(self, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        self.held.append(p)
        self.n += len(p)
        if self.n >= self.most:
            yield from self.flush()

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.n:
            return
        p = np.concatenate(self.held)
        self.held, self.n = [], 0
        _, _, stars, _, rest = paired(p)
        if len(stars):
            yield by_cell(STAR, stars, pair_cell(stars, self.cells))
        if len(rest):
            yield by_cell(POSTS, rest, (K.mix(rest["sig"]) >> np.uint64(32)) % np.uint64(self.cells))


def unpacked(data: DataFrame, kind: np.dtype = PAIR) -> DataFrame:
    """Blobs of PAIR or GROUP as rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column(0).to_pylist():
                p = np.frombuffer(x, kind)
                yield pa.record_batch([pa.array(p[c].copy()) for c in kind.names], names=list(kind.names))

    return data.select("data").mapInArrow(run, ", ".join(f"{c} {'int' if kind[c].itemsize == 4 else 'long'}" for c in kind.names))


def cell_pairs(table: pa.Table, cells: int) -> Iterator[pa.RecordBatch]:
    """A cell's pairs, groups and stars, and the stars that tasks have made."""
    kind = table.column("kind").to_pylist()
    data = table.column("data")
    posts = [np.frombuffer(data[i].as_buffer(), POSTING) for i, k in enumerate(kind) if k == POSTS]
    if posts:
        pairs, groups, stars, chain, _ = paired(np.concatenate(posts))
        for k, p in ((PAIRS, pairs), (GROUPS, groups), (STAR, stars), (CHAIN, chain)):
            if len(p):
                yield by_cell(k, p, pair_cell(p, cells))
    yield from table.filter(pc.equal(table.column("kind"), STAR)).to_batches()


def candidates(dealt: DataFrame, cells: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What `links` takes, from what the dealers have sent."""

    def cell(table: pa.Table) -> pa.Table:
        out = pa.Table.from_batches(list(cell_pairs(table, cells)), ARROW)
        R.relieve()
        return out

    return pairs_and_stars(R.written(dealt.repartition(cells, "cell").groupBy("cell").applyInArrow(cell, SCHEMA), "pairs"), cells)


def pairs_and_stars(met: DataFrame, cells: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(small groups' stars, large groups' stars, small groups' members).

    Sets that share several signatures meet in several cells: each pair is dealt by its own
    hash once more, as blobs, so that it becomes one row.
    """
    kinds = {PAIRS: PAIR, STAR: PAIR, CHAIN: PAIR, GROUPS: GROUP}

    def once(table: pa.Table) -> pa.Table:
        kind, data = np.array(table.column("kind").to_pylist()), table.column("data")
        out = [x for k, t in kinds.items() if (kind == k).any() for x in packed(k, unique_pairs(np.concatenate([np.frombuffer(data[int(i)].as_buffer(), t) for i in np.flatnonzero(kind == k)])))]
        return pa.Table.from_batches(out, ARROW)

    met = R.written(met.where(F.col("kind").isin(*kinds)).repartition(cells, "cell").groupBy("cell").applyInArrow(once, SCHEMA), "pairs-once")
    of = lambda k: unpacked(met.where(F.col("kind") == k), kinds[k])
    stars = of(STAR)
    onto = of(CHAIN).select(F.col("a").alias("p"), F.col("b").alias("a"))
    merged = stars.join(onto, "a").select(F.col("p").alias("a"), "b").where("a <> b")
    return of(PAIRS), stars.union(merged).distinct(), of(GROUPS)


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, inter, na, nb of the pairs; `sets` has fp and members (sorted 64-bit numbers as bytes)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b in R.pieces(batch, "y", 8 << 20):
                inter, na, nb = [], [], []
                for x, y in zip(b.column(2), b.column(3)):
                    x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                    both = np.concatenate([x, y])
                    both.sort(kind="stable")
                    inter.append(int((both[1:] == both[:-1]).sum()))
                    na.append(len(x))
                    nb.append(len(y))
                yield pa.record_batch([b.column(0), b.column(1), pa.array(inter, pa.int64()), pa.array(na, pa.int64()), pa.array(nb, pa.int64())], names=["a", "b", "inter", "na", "nb"])
        R.relieve()

    one = pairs.join(sets.select(F.col("fp").alias("a"), F.col("members").alias("x")), "a")
    two = one.join(sets.select(F.col("fp").alias("b"), F.col("members").alias("y")), "b")
    return two.select("a", "b", "x", "y").mapInArrow(run, "a long, b long, inter long, na long, nb long")


def parity_bits(members: np.ndarray, least: int = 64) -> bytes:
    """A bitmap with a bit toggled for each member, of 4 to 8 times as many bits as there are members (a power of 2)."""
    size = max(least, 4 << max(0, len(members) - 1).bit_length())
    counts = np.bincount((members & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(counts.astype(bool), bitorder="little").tobytes()


def parity_bits_of(members: np.ndarray, first: np.ndarray, least: int = 64) -> list[bytes]:
    """parity_bits of each set: sets of one bitmap size at a time."""
    n = np.diff(first)
    size = np.maximum(least, 4 << np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
    out: list[bytes] = [b""] * len(n)
    for z in np.unique(size):
        own = np.flatnonzero(size == z)
        for a in range(0, len(own), max(1, (1 << 22) // int(z))):
            part = own[a : a + max(1, (1 << 22) // int(z))]
            m = n[part]
            at = np.repeat(first[part] - (np.cumsum(m) - m), m) + np.arange(m.sum())
            row = np.repeat(np.arange(len(part)), m) * int(z) + (members[at] & np.uint64(z - 1)).astype(np.int64)
            counts = np.bincount(row, minlength=len(part) * int(z)).astype(np.uint8) & 1
            packed_bits = np.packbits(counts.reshape(len(part), int(z)), axis=1, bitorder="little")
            for i, x in zip(part.tolist(), packed_bits):
                out[i] = x.tobytes()
    return out


def most_shared(x: bytes, y: bytes, nx: int, ny: int) -> int:
    """An upper bound of the intersection: every toggled bit that differs is a member that only one has."""
    p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    while len(p) > len(q):
        p = p[: len(p) // 2] ^ p[len(p) // 2 :]
    while len(q) > len(p):
        q = q[: len(q) // 2] ^ q[len(q) // 2 :]
    return min(nx, ny, (nx + ny - int(np.bitwise_count(p ^ q).sum())) // 2)


def bounded(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """a, b, na, nb, inter of the pairs, inter an upper bound from `sketches` (fp, n, bits)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            na, nb = b.column(2), b.column(3)
            most = [most_shared(x, y, m, n) for x, y, m, n in zip(b.column(4).to_pylist(), b.column(5).to_pylist(), na.to_pylist(), nb.to_pylist())]
            yield pa.record_batch([b.column(0), b.column(1), na, nb, pa.array(most, pa.int64())], names=["a", "b", "na", "nb", "inter"])

    one = pairs.join(sketches.select(F.col("fp").alias("a"), F.col("n").cast("long").alias("na"), F.col("bits").alias("x")), "a")
    two = one.join(sketches.select(F.col("fp").alias("b"), F.col("n").cast("long").alias("nb"), F.col("bits").alias("y")), "b")
    return two.select("a", "b", "na", "nb", "x", "y").mapInArrow(run, "a long, b long, na long, nb long, inter long")


def folded(sketches: DataFrame) -> DataFrame:
    """fp and its parity bits as LONGS numbers, larger bitmaps folded, smaller ones as they are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                p = np.frombuffer(x, np.uint64)
                while len(p) > LONGS:
                    p = p[: len(p) // 2] ^ p[len(p) // 2 :]
                out.append(p.view(np.int64))
            yield pa.record_batch([b.column(0), pa.array(out, pa.list_(pa.int64()))], names=["fp", "arr"])

    return sketches.select("fp", "bits").mapInArrow(run, "fp long, arr array<long>")


def may_link(num: int, den: int) -> Column:
    """Whether parity bits ax, ay leave x and y (of sizes nx, ny) a link; bitmaps of unlike length say nothing."""
    differ = F.lit(0)
    for i in range(LONGS):
        differ = differ + F.coalesce(F.bit_count(F.get("ax", F.lit(i)).bitwiseXOR(F.get("ay", F.lit(i)))), F.lit(0))
    return (F.size("ax") != F.size("ay")) | ((num + den) * differ <= (den - num) * (F.col("nx") + F.col("ny")))


def links(pairs: DataFrame, stars: DataFrame, groups: DataFrame, sketches: DataFrame, sets_for: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """Links (a, b) among the candidates, enough for their components: den * intersection >= num * union.

    `sketches` has fp, n and the parity bits of every set; pairs that they show to be too far
    apart aren't looked at again. `sets_for` gives the sets (fp, members) of the others.
    """
    linked = den * F.col("inter") >= num * (F.col("na") + F.col("nb") - F.col("inter"))
    far = 1 - F.col("inter") / (F.col("na") + F.col("nb") - F.col("inter"))

    def judged(both: DataFrame) -> DataFrame:
        """a, b, star, na, nb, linked, far (a lower bound of the distance where not linked) of pairs a, b, star."""
        sets = None
        rough = R.written(bounded(both.select("a", "b").distinct(), sketches).withColumns({"linked": linked, "far": far}), "bounds")
        near = rough.where("linked").select("a", "b")
        if near.isEmpty():
            exact = rough
        else:
            sets = R.written(sets_for(near.select(F.col("a").alias("fp")).union(near.select(F.col("b").alias("fp"))).distinct()), "candidate-sets")
            exact = verified(near, sets).withColumns({"linked": linked, "far": far}).select("a", "b", "na", "nb", "inter", "linked", "far").unionByName(rough.where("not linked"))
        out = R.written(both.join(exact, ["a", "b"]), "judged")
        R.drop(rough, sets, both)
        return out

    groups = R.written(groups, "groups")
    todo = pairs.withColumn("star", F.lit(False)).unionByName(stars.withColumn("star", F.lit(True)))
    sizes = den * F.least("nx", "ny") >= num * F.greatest("nx", "ny")
    got = judged(R.written(todo, "candidates"))
    found, seen = got.where("linked").select("a", "b"), got.where("star")
    off = seen.where("not linked").select("a", F.col("b").alias("y"), F.col("nb").alias("ny"), F.col("far").alias("fy"))
    on = seen.where("linked").select("a", F.col("b").alias("x"), F.col("nb").alias("nx"), F.col("far").alias("fx"))
    some_off = not off.isEmpty()
    if some_off:
        # a star's sets that its pivot isn't linked to: STARS of them, and one that is linked, get stars with them all
        least = off.withColumn("s", F.pmod(F.xxhash64("y"), F.lit(STARS))).groupBy("a", "s").agg(F.min(F.struct(F.xxhash64("y").alias("h"), F.col("y").alias("p"))).alias("m")).select("a", "m.p")
        pivots = least.unionByName(on.groupBy("a").agg(F.min(F.struct(F.xxhash64("x").alias("h"), F.col("x").alias("p"))).alias("m")).select("a", "m.p"))
        more = off.join(pivots, "a").where("y <> p").select(F.least("p", "y").alias("a"), F.greatest("p", "y").alias("b"), F.lit(False).alias("star")).distinct()
        found = found.unionByName(judged(R.written(more, "candidates")).where("linked").select("a", "b"))
    # what is still open: pairs of one star that aren't connected by what has been found
    roots = R.written(components(found), "roots")
    with_root = lambda d, c: d.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
    as_edge = lambda d: d.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    arrays = R.written(folded(sketches), "bits")
    with_bits = lambda d, c: with_root(d, c).join(arrays.select(F.col("fp").alias(c), F.col("arr").alias(f"a{c}")), c)
    as_x = lambda d: d.withColumnsRenamed({"y": "x", "ny": "nx", "ry": "rx", "ay": "ax", "fy": "fx"})
    apart = (F.col("x") < F.col("y")) & (F.col("rx") != F.col("ry")) & sizes & may_link(num, den)
    member = R.written(with_bits(groups.select("g", F.col("fp").alias("y"), F.col("n").alias("ny")), "y"), "members")
    mixed = member.groupBy("g").agg(F.min("ry").alias("r1"), F.max("ry").alias("r2")).where("r1 <> r2").select("g")
    member = member.join(mixed, "g", "left_semi")
    rest = as_edge(member.join(as_x(member), "g").where(apart))
    if some_off:
        y = R.written(with_bits(off, "y"), "open")
        near = (F.col("rx") != F.col("ry")) & (F.col("fy") - F.col("fx") <= 1 - num / den + 1e-9) & sizes & may_link(num, den)
        rest = rest.unionByName(as_edge(salted(with_bits(on, "x"), y).where(near))).unionByName(as_edge(salted(as_x(y), y).where(apart)))
    last = judged(R.written(rest.distinct().withColumn("star", F.lit(False)), "candidates"))
    return roots.select(F.col("root").alias("a"), F.col("node").alias("b")).unionByName(last.where("linked").select("a", "b"))


def salted(x: DataFrame, y: DataFrame) -> DataFrame:
    """x joined with y on the star `a`; a star's x are dealt to a task for each STAR of them, and its y go to all of these."""
    tasks = x.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / STAR).alias("salts"))
    each = x.join(tasks, "a").withColumn("salt", F.pmod(F.xxhash64("x"), F.col("salts"))).drop("salts")
    every = y.join(tasks, "a").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    return each.join(every, ["a", "salt"]).drop("salt")


STAR = 8192
EDGES = 1 << 20


def contracted(edges: DataFrame) -> DataFrame:
    """Edges (v, u), v < u, that connect what `edges` (a, b) connect: each task's edges, EDGES at a time, as stars from the least node."""

    def stars(v: np.ndarray, u: np.ndarray) -> pa.RecordBatch:
        node, at = np.unique(np.concatenate([v, u]), return_inverse=True)
        x, y = at[: len(v)], at[len(v) :]
        root = np.arange(len(node))
        while True:
            low = np.minimum(root[x], root[y])
            new = root.copy()
            np.minimum.at(new, root[x], low)
            np.minimum.at(new, root[y], low)
            new = new[new]
            if (new == root).all():
                break
            root = new
        leaf = np.flatnonzero(root != np.arange(len(node)))
        return pa.record_batch([pa.array(node[root[leaf]]), pa.array(node[leaf])], names=["v", "u"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            n += batch.num_rows
            if n >= EDGES:
                yield stars(*map(np.concatenate, zip(*held)))
                held, n = [], 0
        if n:
            yield stars(*map(np.concatenate, zip(*held)))

    return edges.select("a", "b").mapInArrow(run, "v long, u long")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge; the root is the least node.

    Tasks of EDGES edges contract theirs to stars, twice. What was one task's then, at most EDGES edges, is done; of more, large-star and
    small-star turns join the tasks' stars until nothing changes."""
    state, last = None, None
    first, seen = contracted(edges), Observation()
    first = R.written(first.observe(seen, F.count(F.lit(1)).alias("n")), "edges")
    tasks = max(1, -(-int(seen.get["n"]) // EDGES))
    now = contracted(first.select(F.col("v").alias("a"), F.col("u").alias("b")).coalesce(tasks))
    if tasks == 1:
        now = R.written(now, "edges")
        R.drop(first)
        return _rooted(now)
    now = now.distinct()
    while True:
        seen = Observation()
        now = R.written(now.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")), "edges")
        mark = seen.get
        R.drop(last, first)
        last, first = now, None
        if mark == state:
            return _rooted(now)
        state = mark
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        lower = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        m = lower.groupBy("u").agg(F.min("v").alias("m"))
        now = lower.join(m, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(m.select("u", F.col("m").alias("v"))).distinct()


def _rooted(stars: DataFrame) -> DataFrame:
    """node, root of a written table of stars (v, u), on which the result rests."""
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
    out._tidemill_at = stars._tidemill_at
    return out


def bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap with the bits of the long column `key` set; rows that miss it aren't in `keys`.

    It has 16 bits for each key, from 2**16 to 2**27 of them (16 MB): of many more keys it only lets more rows through.
    """
    bits = min(27, max(16, (16 * keys.count()).bit_length()))
    h = F.pmod(F.col("key"), F.lit(1 << bits))
    rows = keys.select(h.alias("h")).groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h % 64 as int))")).alias("m")).toArrow()  # 2**(bits - 6) rows at most
    out = np.zeros(1 << (bits - 6), np.int64)
    out[rows.column("w").to_numpy()] = rows.column("m").to_numpy()
    return out.view(np.uint64)


def in_bitmap(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    h = keys.astype(np.int64) & np.int64(len(bits) * 64 - 1)
    return (bits[h >> 6] >> (h & 63).astype(np.uint64)) & np.uint64(1) != 0
