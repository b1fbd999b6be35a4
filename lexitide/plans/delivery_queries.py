"""Queries on deliveries (problem 5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexitide.operators.deliveries import one_per_message
from lexitide.runtime import table


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return one_per_message(table(spark, sf, "tweets"), columns=()).where("n_deliveries > 1").select("id")


def p5_messages(spark: SparkSession, sf: str) -> DataFrame:
    """The kept delivery of every message."""
    kept = one_per_message(table(spark, sf, "tweets"), columns=("full_text", "batch_no", "line_no"))
    return kept.select("id", "full_text", "batch_no", "line_no", "n_deliveries")


_NUMBER = r"""CASE WHEN regexp_full_match(regexp_replace(id, '^\s+|\s+$', '', 'g'), '[+-]?[0-9]+') THEN try_cast(regexp_replace(id, '^\s+|\s+$', '', 'g') AS BIGINT) END"""

QUERIES = {"p5_found": p5_found, "p5_messages": p5_messages}
ORACLE = {
    "p5_found": f"SELECT k AS id FROM (SELECT {_NUMBER} AS k FROM tweets) WHERE k IS NOT NULL GROUP BY k HAVING count(*) > 1",
    "p5_messages": f"""
WITH t AS (SELECT *, {_NUMBER} AS k FROM tweets),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY received_at NULLS LAST, batch_no NULLS LAST, line_no NULLS LAST) AS r, count(*) OVER (PARTITION BY k) AS n FROM t WHERE k IS NOT NULL)
SELECT k AS id, full_text, batch_no, line_no, n AS n_deliveries FROM r WHERE r = 1""",
}
