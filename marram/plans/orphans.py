"""Queries of the reference-integrity operator and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marram.operators import references as R
from marram.sources.tables import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    refs = R.benchmark_references(table(spark, root, "retrieval_questions"), table(spark, root, "questions"))
    return R.orphan_references(refs, table(spark, root, "chunks"))


def p1_by_period(spark: SparkSession, root: str) -> DataFrame:
    return R.orphans_by_period(p1_found(spark, root))


_FOUND = """
WITH refs AS (
  SELECT DISTINCT 'retrieval_questions' AS ref_table, id, r AS ref, created_at, false AS by_lead
  FROM (SELECT id, created_at, unnest(relevant_chunk_ids) AS r FROM retrieval_questions) WHERE r IS NOT NULL
  UNION ALL
  SELECT DISTINCT 'questions', id, r, created_at, true
  FROM (SELECT id, created_at, unnest(expected_sources) AS r FROM questions) WHERE r IS NOT NULL
), hits AS (
  SELECT f.ref_table, f.id, f.ref, f.created_at,
         count(c.id) AS n,
         count(*) FILTER (c.ingested_at <= f.created_at) AS n_seen,
         count(*) FILTER (c.ingested_at <= f.created_at AND (c.deleted_at IS NULL OR c.deleted_at > f.created_at)) AS n_valid
  FROM refs f LEFT JOIN chunks c ON c.id = f.ref OR (f.by_lead AND starts_with(c.id, f.ref || '::'))
  GROUP BY ALL
)
SELECT DISTINCT ref_table, id, ref,
       CASE WHEN n = 0 THEN 'missing' WHEN n_seen = 0 THEN 'late' ELSE 'deleted' END AS reason,
       strftime(created_at, '%Y-%m') AS period
FROM hits WHERE n_valid = 0
"""

QUERIES = {"p1_found": p1_found, "p1_by_period": p1_by_period}

SQL = {
    "p1_found": _FOUND,
    "p1_by_period": f"""
SELECT ref_table, period, reason, CAST(count(*) AS BIGINT) AS n_refs, CAST(count(DISTINCT id) AS BIGINT) AS n_questions
FROM ({_FOUND}) GROUP BY ALL
""",
}
