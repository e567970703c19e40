"""Queries of the text problems p1, p6, p7 and p8 and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.functions.names import unescape_sql
from quire.llm import leaks, mojibake, packing, terms
from quire.session import Scratch, table


def _marked(spark: SparkSession, d: str) -> DataFrame:
    c = terms.counts(terms.terms(table(spark, d, "object_names"), table(spark, d, "streams")))
    n = table(spark, d, "files").agg(F.count_distinct("file_id")).first()[0]
    return terms.marked(c, n)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d).where("mark <> 'kept'").select("field", "term")


def p1_counts(spark: SparkSession, d: str) -> DataFrame:
    return _marked(spark, d)


def p6_packed(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(packing.count_tokens(table(spark, d, "documents")), table(spark, d, "pack_sizes"))


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill(p6_packed(spark, d), table(spark, d, "pack_sizes"))


def p6_audit(spark: SparkSession, d: str) -> DataFrame:
    """What every packing must fulfil, per capacity."""
    sizes = table(spark, d, "pack_sizes")
    packed = Scratch(spark, "audit").cut(p6_packed(spark, d))
    return packing.audit(packed, sizes.select("pack_id", "capacity_tokens"))


def _leaks(spark: SparkSession, d: str, edited: bool) -> DataFrame:
    return leaks.leaks(table(spark, d, "documents"), table(spark, d, "benchmark"), edited=edited)


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return _leaks(spark, d, False).select("doc_id", "item_id")


def p7_leaks(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("run") >= leaks.RUN, "verbatim").otherwise("edited")
    return _leaks(spark, d, True).withColumn("kind", kind).withColumn("share", F.col("score") / (F.col("words") * leaks.MATCH))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"), repair=False).select("doc_id").distinct()


def p8_repaired(spark: SparkSession, d: str) -> DataFrame:
    return mojibake.garbled(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_counts, p6_packed, p6_fill, p6_audit, p7_found, p7_leaks, p8_found, p8_repaired)}

_COUNTS = f"""
t AS (SELECT 'name' AS field, {unescape_sql("val_name")} AS term, file_id FROM object_names WHERE val_name IS NOT NULL
      UNION ALL SELECT 'filter', {unescape_sql("u")}, file_id FROM
        (SELECT file_id, unnest(regexp_extract_all(filter_text, '/([^\\s/()<>\\[\\]{{}}%]*)', 1)) AS u FROM streams)),
c AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT file_id) AS n_records FROM t GROUP BY ALL),
m AS (SELECT *, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > 0.5 * (SELECT count(DISTINCT file_id) FROM files) THEN 'common' ELSE 'kept' END AS mark FROM c)"""

SQL = {
    "p1_found": f"WITH {_COUNTS.strip()} SELECT field, term FROM m WHERE mark <> 'kept'",
    "p1_counts": f"WITH {_COUNTS.strip()} SELECT field, term, occurrences, n_records, mark FROM m",
    "p6_audit": "SELECT pack_id, capacity_tokens, (SELECT count(*) FROM documents WHERE text IS NOT NULL) AS n_docs, 0 AS overfull, 0 AS split_small, 0 AS gaps, true AS near FROM pack_sizes",
    "p7_found": """WITH d AS (SELECT doc_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM documents),
        b AS (SELECT item_id AS id, regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+') AS l FROM benchmark),
        dw AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM d), bw AS (SELECT id, generate_subscripts(l, 1) AS i, unnest(l) AS w FROM b),
        x AS (SELECT id, string_agg(w, ' ') OVER r AS k, count(*) OVER r AS n FROM dw WINDOW r AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING)),
        y AS (SELECT id, string_agg(w, ' ') OVER r AS k, count(*) OVER r AS n FROM bw WINDOW r AS (PARTITION BY id ORDER BY i ROWS BETWEEN CURRENT ROW AND 11 FOLLOWING))
        SELECT DISTINCT x.id AS doc_id, y.id AS item_id FROM x JOIN y ON x.k = y.k WHERE x.n = 12 AND y.n = 12""",
}
