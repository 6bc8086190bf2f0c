"""Queries over term statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.termfreq import marked_terms
from loomline.session import table

FIELDS = ["body", "path_terms"]


def p3_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return marked_terms(table(spark, sf_dir, "search_docs"), "doc_id", FIELDS)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_terms(spark, sf_dir).where("mark IS NOT NULL").select("field", "term", "mark")


TERMS_SQL = r"""
WITH texts AS (SELECT DISTINCT doc_id, 'body' AS field, body AS text FROM search_docs WHERE body IS NOT NULL
               UNION ALL SELECT DISTINCT doc_id, 'path_terms', path_terms FROM search_docs WHERE path_terms IS NOT NULL),
pairs AS (SELECT field, doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS term FROM texts),
counts AS (SELECT field, term, count(*) AS occurrences, count(DISTINCT doc_id) AS records FROM pairs GROUP BY ALL),
totals AS (SELECT field, count(DISTINCT doc_id) AS total FROM texts GROUP BY ALL),
marked AS (SELECT field, term, occurrences, records,
                  CASE WHEN records < 3 THEN 'rare' WHEN records > total * 0.1 THEN 'common' END AS mark
           FROM counts JOIN totals USING (field))
"""

QUERIES = {"p3_found": p3_found, "p3_terms": p3_terms}
ORACLES = {
    "p3_found": TERMS_SQL + "SELECT field, term, mark FROM marked WHERE mark IS NOT NULL",
    "p3_terms": TERMS_SQL + "SELECT field, term, occurrences, records, mark FROM marked",
}
