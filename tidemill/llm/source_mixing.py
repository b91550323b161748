"""Mixing sources to target weights, in DataFrame operations only.

A source's words, document after document, are packed into blocks of a fixed
number of words. Output shards have a fixed number of slots; every slot draws its
source from the target shares by a seeded hash, so a shard's counts are
multinomial. A source's slots are numbered over the shards; number k is block
k mod n of the source under an affine permutation of its n blocks seeded by the
pass k div n, and the block is joined by its index. A source's slots beyond its
target are open again and go, in order, to sources that have drawn too few. The
last slot of a source is cut so that the source gives its target's words.

Targets: sources ordered by code point, null last, weigh 5, 2, 1, 5, ...; they
share `ratio` times all sizes, none above `most` times its own size, the excess
shared again by weight: target = min(most * size, level * weight) at the one
level that fills the whole. `taken` is what the mix takes of a document; with
most = 2 no block is used more than twice, so no document above 2 times its size.

A document's size is its number of words `[^\\x20\\x09-\\x0D]+`; null text has 0. Rows
with a null id sort first in their source. Repeated rows are documents of their
own. Empty tables give empty results. Columns of the input other than id, text
and source are not read.

A hot source holds no task up: documents are dealt by (source, chunk of the id)
and only the chunks' sums are added up in order of the source; shards are added up in groups of
GROUP, and then the groups. What is a row a source (targets, quotas, passes) is ordered in one
task and broadcast only if its files are small, else joined with salt. Very long texts are one document whose words span many blocks.
Ids that aren't integers are placed by their hash.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm import _runtime as R

WEIGHTS = (5.0, 2.0, 1.0)
BLOCK, SLOTS, CHUNKS, SEED = 256, 512, 1024, 17
GROUP, BINS, SMALL = 4096, 4096, 32 << 20
_PRIME = 2147483647


def word_count(text: Column) -> Column:
    return F.when(text.isNull(), F.lit(0)).otherwise(F.size(F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), ""))).cast("long")


def sizes_of(docs: DataFrame) -> DataFrame:
    text = F.col("text").cast("string")
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(text).alias("size"))


def source_targets(sizes: DataFrame, ratio: float, most: float, weights: tuple[float, ...]) -> DataFrame:
    """source, rank, weight, source_size, target. A row a source: the number of sources is what it grows with."""
    total = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.asc_nulls_last("source"))
    ranked = total.withColumn("rank", F.row_number().over(order).cast("long") - 1)
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(most)).withColumn("fills_at", F.col("cap") / F.col("weight"))
    up = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy("fills_at", "rank").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    all_of_it = F.sum("source_size").over(whole) * F.lit(ratio)
    weight_left = F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(up), F.lit(0.0))
    # the level if all that fill earlier are full and this one isn't
    level = (all_of_it - F.coalesce(F.sum("cap").over(up), F.lit(0.0))) / weight_left
    leveled = ranked.withColumn("level", level)
    # those that fill below their level are full; the first that doesn't has the right level
    right = F.min(F.when(F.col("level") <= F.col("fills_at"), F.struct("fills_at", "rank", "level"))).over(whole)["level"]
    target = F.when(right.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), right * F.col("weight")))
    return leveled.withColumn("target", target).select("source", "rank", "weight", "source_size", "target")


def placed_documents(sizes: DataFrame) -> DataFrame:
    """Documents with their first word's place in their source's words."""
    integral = dict(sizes.dtypes)["doc_id"] in ("tinyint", "smallint", "int", "bigint")
    number = F.col("doc_id").cast("long") if integral else F.xxhash64("doc_id")
    chunk = F.coalesce(F.pmod(F.pmod(number, F.lit(1000003)) * 7919, F.lit(CHUNKS)), F.lit(0))
    parts = sizes.withColumn("chunk", chunk)
    sums = parts.groupBy("source", "chunk").agg(F.sum("size").alias("n"))
    before = Window.partitionBy("source").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = sums.select("source", "chunk", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("chunk_start"))
    inner = Window.partitionBy("source", "chunk").orderBy(F.asc_nulls_first("doc_id"), "size").rowsBetween(Window.unboundedPreceding, -1)
    inside = parts.withColumn("offset", F.coalesce(F.sum("size").over(inner), F.lit(0)))
    joined = inside.alias("a").join(starts.alias("b"), F.col("a.source").eqNullSafe(F.col("b.source")) & (F.col("a.chunk") == F.col("b.chunk")))
    return joined.select("a.doc_id", "a.source", "a.size", (F.col("chunk_start") + F.col("offset")).alias("start"))


def drawn(*parts: Column | int) -> Column:
    """A number from 0 to 2**31 - 2 by a hash of the parts that any SQL engine can compute."""
    text = F.concat_ws(":", F.lit(str(SEED)), *[(p if isinstance(p, Column) else F.lit(p)).cast("string") for p in parts])
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(_PRIME))


def with_small(left: DataFrame, small: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """`left` joined with a table of a few rows a source: broadcast if its files are small, else each key's rows of `left` are dealt to 16 tasks."""
    small = R.written(small, "mix-small")
    if R.input_bytes(small) <= SMALL:
        return left.join(F.broadcast(small), on, how)
    salted = left.withColumn("_salt", F.pmod(F.xxhash64(*left.columns), F.lit(16)))
    return salted.join(small.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long")))), [*on, "_salt"], how).drop("_salt")


def in_ranges(left: DataFrame, value: str, ranges: DataFrame, width: float) -> DataFrame:
    """`left` with the row of `ranges` whose [lo, hi) its value is in: both go to bins of `width`, so only a bin's ranges are compared."""
    bin_of = lambda c: F.floor(c / F.lit(width)).cast("long")
    cut = ranges.withColumn("bin", F.explode(F.sequence(bin_of(F.col("lo")), bin_of(F.col("hi")))))
    met = with_small(left.withColumn("bin", bin_of(F.col(value))), cut, ["bin"])
    return met.where((F.col(value) >= F.col("lo")) & (F.col(value) < F.col("hi"))).drop("bin", "lo", "hi")


def running(counts: DataFrame, keys: list[str]) -> DataFrame:
    """`counts` (keys, shard, c) with `base`, the sum of c over the shards before: by groups of shards first, so no task has all shards."""
    before = lambda w, c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    grouped = counts.withColumn("group", F.floor(F.col("shard") / GROUP))
    sums = grouped.groupBy(*keys, "group").agg(F.sum("c").alias("n"))
    starts = sums.select(*keys, "group", before((Window.partitionBy(*keys) if keys else Window).orderBy("group"), "n").alias("start"))
    inner = grouped.withColumn("inner", before(Window.partitionBy(*keys, "group").orderBy("shard"), "c"))
    return inner.join(starts, [*keys, "group"]).withColumn("base", F.col("start") + F.col("inner")).drop("group", "start", "inner")


def slot_plan(targets: DataFrame, block: int, slots: int) -> DataFrame:
    """shard, slot, rank, k, block_index, pass, words: which block of which source each output slot takes."""
    spark = targets.sparkSession
    t = targets.withColumn("want", F.round("target").cast("long")).withColumn("blocks", F.ceil(F.col("source_size") / block)).where("source_size > 0 and want > 0")
    t = t.withColumn("full", F.floor(F.col("want") / F.col("source_size"))).withColumn("rest", F.col("want") - F.col("full") * F.col("source_size"))
    t = t.withColumn("last_len", F.col("source_size") - (F.col("blocks") - 1) * block)
    # the last pass takes whole blocks in its order until `rest` words are there; one more block makes up for the short one
    t = t.withColumn("quota", F.col("full") * F.col("blocks") + F.least(F.col("blocks"), F.when(F.col("rest") > 0, F.ceil(F.col("rest") / block) + 1).otherwise(0)))
    t = R.written(t.select("rank", "source_size", "want", "blocks", "full", "rest", "last_len", "quota"), "mix-sources")
    cum = Window.orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    shares = t.withColumn("hi", F.sum("want").over(cum)).withColumn("lo", F.col("hi") - F.col("want"))
    n = t.agg(F.sum("quota")).first()[0] or 0
    total = t.agg(F.sum("want")).first()[0] or 1
    shards = -(-n // slots)
    grid = spark.range(0, n, 1, max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")) * 4, shards))).select(F.floor(F.col("id") / slots).alias("shard"), (F.col("id") % slots).alias("slot"))
    grid = grid.withColumn("u", (drawn("shard", F.col("shard"), "slot", F.col("slot")) / F.lit(float(_PRIME)) * F.lit(total)))
    draws = R.written(in_ranges(grid, "u", shares.select("rank", "lo", "hi"), max(1.0, total / BINS)).select("shard", "slot", "rank"), "mix-draws")
    # number a source's slots over the shards: the counts of a shard, added up
    counts = draws.groupBy("rank", "shard").agg(F.count(F.lit(1)).alias("c"))
    numbered = draws.withColumn("j", F.row_number().over(Window.partitionBy("rank", "shard").orderBy("slot")) - 1).join(running(counts, ["rank"]), ["rank", "shard"]).withColumn("k", F.col("base") + F.col("j"))
    quotas = t.select("rank", "quota")
    judged = R.written(with_small(numbered, quotas, ["rank"]).select("shard", "slot", "rank", "k", "quota"), "mix-numbered")
    kept = judged.where("k < quota").select("shard", "slot", "rank", "k")
    # slots beyond their source's quota are filled by the sources that drew too few
    spare = judged.where("k >= quota").select("shard", "slot")
    got = judged.groupBy("rank").agg(F.count(F.lit(1)).alias("got"))
    short = quotas.join(got, "rank", "left").select("rank", F.coalesce("got", F.lit(0)).alias("got"), "quota").where("got < quota")
    runs = short.withColumn("hi", F.sum(F.col("quota") - F.col("got")).over(cum)).withColumn("lo", F.col("hi") - (F.col("quota") - F.col("got"))).withColumn("from", F.col("lo"))
    per_shard = spare.groupBy("shard").agg(F.count(F.lit(1)).alias("c"))
    opened = spare.withColumn("j", F.row_number().over(Window.partitionBy("shard").orderBy("slot")) - 1).join(running(per_shard, []), "shard").withColumn("o", F.col("base") + F.col("j"))
    filled = in_ranges(opened, "o", runs.select("rank", "got", "from", "lo", "hi"), max(1.0, n / BINS)).select("shard", "slot", "rank", (F.col("got") + F.col("o") - F.col("from")).alias("k"))
    slotted = with_small(kept.unionByName(filled), t, ["rank"])
    return slotted.withColumns({"pass": F.floor(F.col("k") / F.col("blocks")), "pos": F.col("k") % F.col("blocks")}).transform(lambda d: permuted(d, t, block))


def permuted(slots: DataFrame, sources: DataFrame, block: int) -> DataFrame:
    """The block behind each position: position * step + shift mod blocks, with a step that has no divisor with it.

    The steps tried are a seeded start and the 39 next ones; of so many in a row one has no divisor with `blocks` unless that
    has ten prime factors or more, and then the step is 1, a rotation."""
    n = F.col("blocks")
    start = drawn("step", F.col("rank"), F.col("pass")) % n
    step_of = F.filter(F.transform(F.sequence(F.lit(0), F.lit(39)), lambda i: (start + i) % n), lambda s: greatest_divisor(s, n) == 1)
    passes = sources.select("rank", "blocks", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - 1) / F.col("blocks")))).alias("pass"))
    steps = passes.select("rank", "pass", F.coalesce(F.try_element_at(step_of, F.lit(1)), F.lit(1)).cast("long").alias("step"), (drawn("shift", F.col("rank"), F.col("pass")) % n).alias("shift"))
    at = with_small(slots, steps, ["rank", "pass"])
    wide = lambda c: c.cast("decimal(19,0)")
    index = F.when(n > 1, ((wide(F.col("pos")) * wide(F.col("step")) + F.col("shift")) % wide(n)).cast("long")).otherwise(F.lit(0).cast("long"))
    at = at.withColumn("block_index", index)
    # where the last, short block stands in this pass: what came before it tells the words taken so far
    short_at = at.where("block_index = blocks - 1").select("rank", "pass", F.col("pos").alias("short_pos"))
    at = with_small(at, short_at, ["rank", "pass"], "left")
    length = F.when(F.col("block_index") == n - 1, F.col("last_len")).otherwise(F.lit(block))
    so_far = F.col("pos") * block - F.when(F.col("short_pos") < F.col("pos"), F.lit(block) - F.col("last_len")).otherwise(0)
    words = F.when(F.col("pass") < F.col("full"), length).otherwise(F.greatest(F.lit(0), F.least(length, F.col("rest") - so_far)))
    return at.withColumn("words", words.cast("long")).where("words > 0").select("shard", "slot", "rank", "k", "pass", "block_index", "words")


def greatest_divisor(a: Column, b: Column) -> Column:
    """gcd by Euclid's steps, as many as 64-bit numbers of blocks can need (the rest are no-ops)."""
    pair = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.struct(a.cast("long").alias("a"), b.cast("long").alias("b")), lambda p, _: F.when(p["a"] == 0, p).otherwise(F.struct((p["b"] % F.when(p["a"] == 0, F.lit(1)).otherwise(p["a"])).alias("a"), p["a"].alias("b"))))
    return pair["b"]


def mixed(docs: DataFrame, ratio: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS, block: int = BLOCK, slots: int = SLOTS) -> tuple[DataFrame, DataFrame]:
    """(documents with source_size, target and taken; the output's slots)."""
    R.ship(docs.sparkSession)
    sizes = R.written(sizes_of(docs), "mix-sizes")
    targets = R.written(source_targets(sizes, ratio, most, weights), "mix-targets")
    with R.scratch() as keep:
        plan = keep(R.written(slot_plan(targets, block, slots), "mix-slots"))
    used = plan.groupBy("rank", "block_index", "words").agg(F.count(F.lit(1)).alias("times"))
    known = targets.select(F.col("source").alias("s"), "rank", "source_size", "target")
    placed = placed_documents(sizes).join(known, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    some = placed.where("size > 0").withColumn("block_index", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))))
    lo = F.greatest(F.col("start"), F.col("block_index") * block)
    hi = F.least(F.col("start") + F.col("size"), F.col("block_index") * block + F.col("words"))
    met = some.join(used, ["rank", "block_index"], "left").withColumn("got", F.coalesce(F.greatest(F.lit(0), hi - lo) * F.col("times"), F.lit(0)))
    took = met.groupBy("doc_id", "source", "rank", "start", "size", "source_size", "target").agg(F.sum("got").alias("taken"))
    none = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    cols = ["doc_id", "size", "source_size", "target", "taken", "source"]
    return took.select(*cols).unionByName(none.select(*cols)), plan


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0]


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus: every document with size, source_size, target and the words that the mix takes of it, in place of columns of these names."""
    docs = docs.drop("size", "source_size", "target", "taken", "_n")
    mix = mixed(docs)[0]
    keys = ["doc_id", "source", "size"]
    own = docs.withColumn("size", word_count(F.col("text").cast("string"))).withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.xxhash64(*docs.columns))))
    got = mix.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("taken")))).select(*(F.col(c).alias(f"_m_{c}") for c in keys), F.col("_n").alias("_m_n"), "source_size", "target", "taken")
    same = [F.col(c).eqNullSafe(F.col(f"_m_{c}")) for c in ("doc_id", "source")] + [F.col(c) == F.col(f"_m{'' if c == '_n' else '_'}{c}") for c in ("size", "_n")]
    met = own.join(got, same[0] & same[1] & same[2] & same[3])
    return met.select(*docs.columns, "size", "source_size", "target", "taken")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {"op1_source_mixing": query}
ORACLE_SQL = {
    "op1_source_mixing": r"""
WITH d AS (SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size FROM documents),
a AS (SELECT source, CAST(sum(size) AS BIGINT) AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
b AS (SELECT *, CASE rank % 3 WHEN 0 THEN 5.0::DOUBLE WHEN 1 THEN 2.0 ELSE 1.0 END AS w, s * 2.0::DOUBLE AS cap FROM a),
c AS (SELECT *, (sum(s) OVER () * 1.5::DOUBLE - coalesce(sum(cap) OVER up, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER up, 0)) AS level
  FROM b WINDOW up AS (ORDER BY cap / w, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
lv AS (SELECT arg_min(level, (cap / w, rank)) FILTER (WHERE level <= cap / w) AS level FROM c),
t AS (SELECT source, rank, s, CASE WHEN lv.level IS NULL THEN cap ELSE least(cap, lv.level * w) END AS target FROM c, lv),
q0 AS (SELECT rank, s, CAST(round(target) AS BIGINT) AS want, CAST(ceil(s / 256) AS BIGINT) AS blocks FROM t WHERE s > 0 AND round(target) > 0),
q1 AS (SELECT *, want // s AS whole, want - want // s * s AS rest, s - (blocks - 1) * 256 AS last_len FROM q0),
q AS (SELECT *, whole * blocks + least(blocks, CASE WHEN rest > 0 THEN CAST(ceil(rest / 256) AS BIGINT) + 1 ELSE 0 END) AS quota,
  CAST(sum(want) OVER (ORDER BY rank) AS BIGINT) AS hi, CAST(sum(want) OVER (ORDER BY rank) AS BIGINT) - want AS lo FROM q1),
g AS (SELECT i // 512 AS shard, i % 512 AS slot FROM (SELECT unnest(range(CAST((SELECT sum(quota) FROM q) AS BIGINT))) AS i)),
u AS (SELECT shard, slot, CAST('0x' || substr(md5('17:shard:' || shard || ':slot:' || slot), 1, 15) AS BIGINT) % 2147483647 / 2147483647.0::DOUBLE * (SELECT sum(want) FROM q) AS u FROM g),
k AS (SELECT shard, slot, rank, quota, row_number() OVER (PARTITION BY rank ORDER BY shard, slot) - 1 AS k FROM u JOIN q ON u.u >= q.lo AND u.u < q.hi),
o AS (SELECT shard, slot, row_number() OVER (ORDER BY shard, slot) - 1 AS o FROM k WHERE k >= quota),
f AS (SELECT rank, got, CAST(sum(quota - got) OVER (ORDER BY rank) AS BIGINT) AS upto, CAST(sum(quota - got) OVER (ORDER BY rank) AS BIGINT) - (quota - got) AS since
  FROM (SELECT q.rank, q.quota, count(k.k) AS got FROM q LEFT JOIN k ON k.rank = q.rank GROUP BY ALL) WHERE got < quota),
m AS (SELECT rank, k FROM k WHERE k < quota UNION ALL SELECT rank, got + o - since FROM o JOIN f ON o >= since AND o < upto),
p AS (SELECT m.rank, q.blocks, q.whole, q.rest, q.last_len, k // q.blocks AS pass, k % q.blocks AS pos FROM m JOIN q ON m.rank = q.rank),
z AS (SELECT rank, pass, coalesce(list_filter(list_transform(range(40), lambda i: (CAST('0x' || substr(md5('17:step:' || rank || ':' || pass), 1, 15) AS BIGINT) % 2147483647 % blocks + i) % blocks), lambda x: gcd(x, blocks) = 1)[1], 1) AS step,
  CAST('0x' || substr(md5('17:shift:' || rank || ':' || pass), 1, 15) AS BIGINT) % 2147483647 % blocks AS shift FROM (SELECT DISTINCT rank, pass, blocks FROM p)),
x AS (SELECT p.*, CASE WHEN blocks > 1 THEN (pos * step + shift) % blocks ELSE 0 END AS i FROM p JOIN z USING (rank, pass)),
y AS (SELECT x.*, r.pos AS short_pos FROM x LEFT JOIN (SELECT rank, pass, pos FROM x WHERE i = blocks - 1) r USING (rank, pass)),
v AS (SELECT rank, i, CASE WHEN pass < whole THEN CASE WHEN i = blocks - 1 THEN last_len ELSE 256 END
  ELSE greatest(0, least(CASE WHEN i = blocks - 1 THEN last_len ELSE 256 END, rest - pos * 256 + CASE WHEN short_pos < pos THEN 256 - last_len ELSE 0 END)) END AS words FROM y),
e AS (SELECT doc_id, source, size, coalesce(sum(size) OVER (PARTITION BY source ORDER BY coalesce(((doc_id % 1000003 + 1000003) % 1000003 * 7919) % 1024, 0), doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM d)
SELECT e.doc_id, e.size, t.s AS source_size, t.target, CAST(coalesce(sum(CASE WHEN v.i IS NULL THEN 0 ELSE greatest(0, least(e.start + e.size, v.i * 256 + v.words) - greatest(e.start, v.i * 256)) END), 0) AS BIGINT) AS taken, e.source
FROM e JOIN t ON e.source IS NOT DISTINCT FROM t.source LEFT JOIN v ON v.rank = t.rank AND v.i >= e.start // 256 AND v.i <= (e.start + e.size) // 256 AND e.size > 0
GROUP BY e.doc_id, e.size, t.s, t.target, e.source, e.start""",
}
