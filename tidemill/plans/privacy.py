"""Personal data in the documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions import pii
from tidemill.plans.registry import query, table

_VALID = {
    "iban": """list_reduce([0] || list_transform(string_split(substr(replace(s, ' ', ''), 5) || substr(replace(s, ' ', ''), 1, 4), ''), lambda c: CASE WHEN c BETWEEN '0' AND '9' THEN ascii(c) - 48 ELSE ascii(c) - 55 END),
      lambda a, v: (a * CASE WHEN v > 9 THEN 100 ELSE 10 END + v) % 97) = 1""",
    "card": """list_sum(list_transform(string_split(reverse(regexp_replace(s, '[^0-9]', '', 'g')), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) WHEN CAST(c AS INTEGER) > 4 THEN CAST(c AS INTEGER) * 2 - 9 ELSE CAST(c AS INTEGER) * 2 END)) % 10 = 0""",
    "ip": "list_bool_and(list_transform(string_split(s, '.'), lambda x: CAST(x AS INTEGER) <= 255))",
}
_KIND = " UNION ALL ".join(
    f"SELECT doc_id, {k} AS rank, '{kind}' AS kind, regexp_extract_all(text, '{p}') AS m, regexp_split_to_array(text, '{p}') AS b FROM documents WHERE text IS NOT NULL" for k, (kind, p) in enumerate(pii.PATTERNS.items())
)
_SQL = f"""WITH k AS ({_KIND}), e AS (SELECT doc_id, rank, kind, unnest(range(len(m))) AS i, unnest(m) AS s, unnest(b[1:len(m)]) AS b FROM k WHERE len(m) > 0),
    p AS (SELECT *, sum(length(b) + length(s)) OVER (PARTITION BY doc_id, rank ORDER BY i) AS stop FROM e),
    v AS (SELECT doc_id, rank, kind, CAST(stop - length(s) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM p WHERE CASE {" ".join(f"WHEN kind = '{k}' THEN {t}" for k, t in _VALID.items())} ELSE true END),
    o AS (SELECT *, coalesce(start >= max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM v),
    g AS (SELECT *, sum(CAST(fresh AS INTEGER)) OVER (PARTITION BY doc_id ORDER BY start, stop DESC, rank ROWS UNBOUNDED PRECEDING) AS island FROM o),
    s AS (SELECT doc_id, island, min(start) AS start, max(stop) AS stop, first(kind ORDER BY start, stop DESC, rank) AS kind FROM g GROUP BY doc_id, island),
    t AS (SELECT s.*, coalesce(lag(stop) OVER (PARTITION BY doc_id ORDER BY start), 0) AS before FROM s),
    r AS (SELECT t.doc_id, count(*) AS n_spans, {", ".join(f"count(*) FILTER (WHERE kind = '{k}') AS {k}s" for k in pii.KINDS)},
      string_agg(substr(text, before + 1, start - before) || '[' || upper(kind) || ']', '' ORDER BY start) || substr(any_value(text), max(stop) + 1) AS plain FROM t JOIN documents d ON d.doc_id = t.doc_id GROUP BY t.doc_id)
    SELECT d.doc_id, coalesce(n_spans, 0) AS n_spans, {", ".join(f"coalesce({k}s, 0) AS {k}s" for k in pii.KINDS)}, md5(coalesce(plain, text)) AS redacted_md5 FROM documents d LEFT JOIN r USING (doc_id)"""


@query("personal_data", _SQL)
def personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document by kind, and a digest of the text without it."""
    found = table(spark, sf_dir, "documents").select("doc_id", "text", pii.spans(F.col("text")).alias("spans"))
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", F.size("spans").cast("long").alias("n_spans"), *(of(k).alias(f"{k}s") for k in pii.KINDS), F.md5(pii.redacted(F.col("text"), F.col("spans"))).alias("redacted_md5"))
