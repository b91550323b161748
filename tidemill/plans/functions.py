"""More scalar functions: strings, numbers, casts, dates, maps, nested rows, variants."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.plans.registry import query, table


@query(
    "string_functions",
    """SELECT c_custkey, trim('  ' || c_name || ' ') AS t, split_part(c_name, '#', 2) AS part, concat_ws('-', c_mktsegment, c_name) AS joined, CAST(instr(c_name, '0') AS BIGINT) AS at, reverse(c_name) AS back,
    repeat(left(c_name, 2), 3) AS thrice, right(c_name, 3) AS tail, translate(c_name, '0123', 'abcd') AS moved, md5(c_name) AS m, sha256(c_name) AS s, CAST(ascii(c_name) AS BIGINT) AS a, starts_with(c_name, 'Cust') AS starts FROM customer""",
)
def string_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("c_name")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.trim(F.concat(F.lit("  "), n, F.lit(" "))).alias("t"), F.split_part(n, F.lit("#"), F.lit(2)).alias("part"), F.concat_ws("-", "c_mktsegment", n).alias("joined"),
        F.instr(n, "0").cast("long").alias("at"), F.reverse(n).alias("back"), F.repeat(F.left(n, F.lit(2)), 3).alias("thrice"), F.right(n, F.lit(3)).alias("tail"), F.translate(n, "0123", "abcd").alias("moved"),
        F.md5(n).alias("m"), F.sha2(n, 256).alias("s"), F.ascii(n).cast("long").alias("a"), n.startswith("Cust").alias("starts"),
    )


@query(
    "regular_expressions",
    r"""SELECT event_id, regexp_extract(props, '"k": (\d+)', 1) AS k, regexp_replace(props, '[{}" ]', '', 'g') AS bare, regexp_matches(props, ': 8') AS eighty FROM events""",
)
def regular_expressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("props")
    return table(spark, sf_dir, "events").select("event_id", F.regexp_extract(p, r'"k": (\d+)', 1).alias("k"), F.regexp_replace(p, r'[{}" ]', "").alias("bare"), p.rlike(": 8").alias("eighty"))


@query(
    "number_functions",
    """SELECT p_partkey, round(ln(p_retailprice), 9) AS l, round(log10(p_retailprice), 9) AS l10, round(exp(p_size / 10.0::DOUBLE), 6) AS e, round(pow(p_size, 1.5), 6) AS p, round(sqrt(p_retailprice), 9) AS s, sign(p_size - 25)::DOUBLE AS g,
    p_size % 7 AS m, greatest(p_size, 10) AS hi, least(p_size, 10) AS lo, CAST(ceil(p_retailprice) AS BIGINT) AS up, CAST(floor(p_retailprice) AS BIGINT) AS down, round(atan2(p_size, 3), 9) AS a, abs(p_size - 25) AS d,
    p_size & 6 AS b, xor(p_size, 5) AS x, p_size << 2 AS sh FROM part""",
)
def number_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    r, z = F.col("p_retailprice"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.round(F.ln(r), 9).alias("l"), F.round(F.log10(r), 9).alias("l10"), F.round(F.exp(z / 10.0), 6).alias("e"), F.round(F.pow(z, 1.5), 6).alias("p"), F.round(F.sqrt(r), 9).alias("s"), F.sign(z - 25).alias("g"),
        (z % 7).alias("m"), F.greatest(z, F.lit(10)).alias("hi"), F.least(z, F.lit(10)).alias("lo"), F.ceil(r).cast("long").alias("up"), F.floor(r).cast("long").alias("down"), F.round(F.atan2(z, F.lit(3.0)), 9).alias("a"),
        F.abs(z - 25).alias("d"), z.bitwiseAND(6).alias("b"), z.bitwiseXOR(5).alias("x"), F.shiftleft(z, 2).alias("sh"),
    )


@query(
    "casts_and_decimals",
    """SELECT p_partkey, try_cast(split_part(p_brand, '#', 2) AS INTEGER) AS brand, try_cast(p_name AS INTEGER) AS none, nullif(p_size, 7) AS size, coalesce(nullif(p_size, 7), -1) AS filled,
    CAST(CAST(p_retailprice AS DECIMAL(12, 2)) * CAST(1.19 AS DECIMAL(4, 2)) AS VARCHAR) AS gross, CAST(p_size AS VARCHAR) AS text, CASE WHEN p_size < 10 THEN 's' WHEN p_size < 30 THEN 'm' ELSE 'l' END AS class FROM part""",
)
def casts_and_decimals(spark: SparkSession, sf_dir: str) -> DataFrame:
    z = F.col("p_size")
    gross = F.col("p_retailprice").cast("decimal(12,2)") * F.lit("1.19").cast("decimal(4,2)")
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.split_part("p_brand", F.lit("#"), F.lit(2)).try_cast("int").alias("brand"), F.col("p_name").try_cast("int").alias("none"), F.nullif(z, F.lit(7)).alias("size"), F.coalesce(F.nullif(z, F.lit(7)), F.lit(-1)).alias("filled"),
        gross.cast("string").alias("gross"), z.cast("string").alias("text"), F.when(z < 10, "s").when(z < 30, "m").otherwise("l").alias("class"),
    )


@query(
    "decimal_sums",
    "SELECT l_returnflag, CAST(sum(CAST(l_extendedprice AS DECIMAL(15, 2)) * CAST(l_discount AS DECIMAL(4, 2))) AS VARCHAR) AS cut, CAST(sum(CAST(l_tax AS DECIMAL(4, 2))) AS VARCHAR) AS tax FROM lineitem GROUP BY l_returnflag",
)
def decimal_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c, n: F.col(c).cast(f"decimal({n},2)")
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.sum(d("l_extendedprice", 15) * d("l_discount", 4)).cast("string").alias("cut"), F.sum(d("l_tax", 4)).cast("string").alias("tax"))


@query(
    "date_functions",
    """SELECT o_orderkey, CAST(extract('dow' FROM o_orderdate) AS BIGINT) + 1 AS dow, CAST(o_orderdate + INTERVAL 1 MONTH AS DATE) AS next_month, last_day(o_orderdate) AS month_end, CAST(date_trunc('quarter', o_orderdate) AS DATE) AS quarter,
    CAST(extract('doy' FROM o_orderdate) AS BIGINT) AS doy, strftime(o_orderdate, '%Y/%m/%d') AS text, CAST(extract('week' FROM o_orderdate) AS BIGINT) AS week, CAST(epoch(o_orderdate) AS BIGINT) AS seconds FROM orders""",
)
def date_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.dayofweek(d).cast("long").alias("dow"), F.add_months(d, 1).alias("next_month"), F.last_day(d).alias("month_end"), F.trunc(d, "quarter").alias("quarter"), F.dayofyear(d).cast("long").alias("doy"),
        F.date_format(d, "yyyy/MM/dd").alias("text"), F.weekofyear(d).cast("long").alias("week"), F.expr("cast(timestampdiff(SECOND, timestamp_ntz'1970-01-01 00:00:00', o_orderdate) as bigint)").alias("seconds"),
    )


@query(
    "maps",
    """WITH m AS (SELECT o_custkey, o_orderstatus AS s, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, string_agg(s, '' ORDER BY s) AS keys, CAST(sum(n) AS BIGINT) AS total, CAST(coalesce(max(n) FILTER (WHERE s = 'F'), 0) AS BIGINT) AS f, count(*) FILTER (WHERE n > 1) AS often FROM m GROUP BY o_custkey""",
)
def maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count(F.lit(1)).alias("n")).groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "n"))).alias("m"))
    return m.select(
        "o_custkey", F.array_join(F.array_sort(F.map_keys("m")), "").alias("keys"), F.aggregate(F.map_values("m"), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"),
        F.coalesce(F.try_element_at("m", F.lit("F")), F.lit(0)).alias("f"), F.size(F.map_keys(F.map_filter("m", lambda k, v: v > 1))).cast("long").alias("often"),
    )


@query(
    "nested_rows",
    """SELECT l_orderkey, CAST(count(*) AS BIGINT) AS n, round(sum(l_quantity) FILTER (WHERE l_quantity > 10), 2) AS large, max(l_partkey) AS top FROM lineitem GROUP BY l_orderkey""",
)
def nested_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list(F.struct(F.col("l_partkey").alias("part"), F.col("l_quantity").alias("qty"))).alias("lines"))
    large = F.filter("lines", lambda x: x["qty"] > 10)
    return lines.select(
        "l_orderkey", F.size("lines").cast("long").alias("n"), F.when(F.size(large) > 0, F.round(F.aggregate(large, F.lit(0.0), lambda a, x: a + x["qty"]), 2)).alias("large"), F.array_max(F.transform("lines", lambda x: x["part"])).alias("top")
    )


@query("variants", "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(json_extract(props, '$.none') AS BIGINT) AS none FROM events")
def variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.parse_json("props")
    return table(spark, sf_dir, "events").select("event_id", F.variant_get(v, "$.k", "bigint").alias("k"), F.try_variant_get(v, "$.none", "bigint").alias("none"))
