"""Queries of the general problems (the ones that live in the core)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.intervals import sweep, year_spans
from tessera.plans.registry import islands_sql, spans_sql
from tessera.session import once, read


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Continuous periods of every issue and the gaps between them."""
    context = once(read(spark, d, "engine_year_context", "ctx_id", "issue_id", "years"), "ctx_id").select("issue_id", "years")
    issues = once(read(spark, d, "issues", "issue_id", "affected_years"), "issue_id").select("issue_id", F.col("affected_years").alias("years"))
    spans = context.unionByName(issues).where("issue_id is not null").select("issue_id", F.inline(year_spans(F.col("years"))))
    return sweep(spans, "issue_id").select("issue_id", "kind", F.col("lo").alias("year_lo"), F.col("hi").alias("year_hi"))


QUERIES = {"p6_found": p6_found}

ORACLE = {
    "p6_found": "WITH " + spans_sql("SELECT k, t FROM (SELECT DISTINCT ctx_id::VARCHAR AS c, issue_id AS k, years AS t FROM engine_year_context UNION ALL SELECT DISTINCT 'i', issue_id, affected_years FROM issues)") + ", " + islands_sql("span") + r""",
nxt AS (SELECT k AS issue_id, lo, hi, lead(lo) OVER (PARTITION BY k ORDER BY lo) AS n FROM isl)
SELECT issue_id, 'period' AS kind, lo::INT AS year_lo, hi::INT AS year_hi FROM nxt
UNION ALL SELECT issue_id, 'gap', (hi + 1)::INT, (n - 1)::INT FROM nxt WHERE n IS NOT NULL
"""
}
