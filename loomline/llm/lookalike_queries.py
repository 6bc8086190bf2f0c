"""Queries over visually identical text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.lookalikes import Field, consistent_values, lookalike_pairs
from loomline.session import table


def p1_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    commits, docs = table(spark, sf_dir, "commits"), table(spark, sf_dir, "search_docs")
    return consistent_values([Field(commits, "commit_no", "message", "message"), Field(docs, "doc_id", "title", "title"), Field(docs, "doc_id", "body", "body")])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lookalike_pairs(p1_forms(spark, sf_dir))


QUERIES = {"p1_found": p1_found, "p1_forms": p1_forms}
ORACLES: dict[str, str] = {}
