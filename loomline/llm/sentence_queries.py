"""Queries over sentence units."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from loomline.llm.sentences import sentences
from loomline.session import table


def p8_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents"))


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p8_sentences(spark, sf_dir).select("doc_id", "char_start", "char_end")


QUERIES = {"p8_found": p8_found, "p8_sentences": p8_sentences}
ORACLES: dict[str, str] = {}
