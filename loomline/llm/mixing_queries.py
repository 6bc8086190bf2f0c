"""Queries over source mixing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.mixing import mix, mix_report
from loomline.session import table


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "mix_targets"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the draw used up without reaching their share."""
    return p7_shares(spark, sf_dir).where("short").select("source")


def p7_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The targets, and whether the draw met them: to 2 % and one text, unless the source was used up."""
    shares = p7_shares(spark, sf_dir)
    longest = F.lit(4 * 4096)
    off = F.abs(F.col("drawn_tokens") - F.col("target_tokens"))
    met = (off <= 0.02 * F.col("target_tokens") + longest) | (F.col("short") & (F.col("drawn_tokens") <= F.col("capacity_tokens")))
    return shares.select("source", F.round("target_share", 9).alias("target_share"), F.round("target_tokens", 3).alias("target_tokens"), "texts", "texts_tokens", "capacity_tokens", "short", met.alias("met"))


QUERIES = {"p7_found": p7_found, "p7_mix": p7_mix, "p7_shares": p7_shares, "p7_targets": p7_targets}
_HELD = """
WITH docs AS (SELECT m.source, text FROM documents d JOIN mix_targets m ON lower(trim(d.source)) = lower(trim(m.source))),
budget AS (SELECT sum(strlen(text)) AS b FROM docs),
held AS (SELECT source, count(*) AS texts, sum(strlen(text)) AS tokens FROM (SELECT DISTINCT source, text FROM docs WHERE text IS NOT NULL) GROUP BY source)"""
ORACLES = {
    "p7_found": _HELD + """
SELECT m.source FROM mix_targets m LEFT JOIN held USING (source), budget
WHERE coalesce(tokens, 0) * max_repeats < weight / (SELECT sum(weight) FROM mix_targets) * b""",
    "p7_targets": _HELD + """, t AS (SELECT *, weight / (SELECT sum(weight) FROM mix_targets) AS share FROM mix_targets)
SELECT source, round(share, 9) AS target_share, round(share * b, 3) AS target_tokens, coalesce(texts, 0)::BIGINT AS texts, coalesce(tokens, 0)::BIGINT AS texts_tokens,
  (coalesce(tokens, 0) * max_repeats)::BIGINT AS capacity_tokens, coalesce(tokens, 0) * max_repeats < share * b AS short, true AS met
FROM t LEFT JOIN held USING (source), budget""",
}
