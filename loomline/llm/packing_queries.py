"""Queries over container packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.packing import container_report, pack
from loomline.session import table


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def p6_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    return container_report(p6_containers(spark, sf_dir))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that the packing had to split."""
    return p6_containers(spark, sf_dir).where("pieces > 1 AND piece = 0").select("doc_id")


def p6_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under three limits that all bind (4,096 tokens, 16 segments, 1,024 loss-bearing tokens): its
    pieces, their tokens and loss-bearing tokens, whether they follow one another, and whether all limits hold in
    all of its containers."""
    packed = pack(table(spark, sf_dir, "documents"), max_segments=LIMITS[1], max_loss_tokens=LIMITS[2])
    length = F.col("token_end") - F.col("token_start")
    per = packed.groupBy("container").agg(F.sum(length).alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"), F.max("position").alias("p"), F.countDistinct("position").alias("d"))
    holds = F.expr(f"t <= {LIMITS[0]} AND s <= {LIMITS[1]} AND l <= {LIMITS[2]} AND p = s - 1 AND d = s")
    placed = packed.join(per.select("container", holds.alias("holds")), "container")
    before = F.lag("token_end", 1, 0).over(Window.partitionBy("doc_id").orderBy("piece"))
    ordered = placed.withColumn("follows", F.col("token_start") == before)
    return ordered.groupBy("doc_id").agg(F.count("*").alias("pieces"), F.sum(length).alias("tokens"), F.sum("loss_tokens").alias("loss_tokens"), F.every("follows").alias("follow"), F.every("holds").alias("hold"))


def p6_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under those limits: whether at most 5 % more containers are used than the scarcest limit needs at least, and
    which limit that is."""
    packed = pack(table(spark, sf_dir, "documents"), max_segments=LIMITS[1], max_loss_tokens=LIMITS[2])
    sums = packed.agg(F.count_distinct("container").alias("used"), F.sum(F.col("token_end") - F.col("token_start")).alias("t"), F.count("*").alias("s"), F.sum("loss_tokens").alias("l"))
    need = [F.ceil(F.col(c) / m) for c, m in zip("tsl", LIMITS, strict=True)]
    least = F.greatest(*need)
    scarce = F.when(need[2] == least, "loss").when(need[0] == least, "tokens").otherwise("segments")
    return sums.select(least.alias("least"), scarce.alias("scarcest"), (F.col("used") <= least * 1.05 + 1).alias("near"))


#: Tokens, segments and loss-bearing tokens of a container in ``p6_limits`` and ``p6_use``.
LIMITS = (4096, 16, 1024)

QUERIES = {"p6_found": p6_found, "p6_containers": p6_containers, "p6_fill": p6_fill, "p6_limits": p6_limits, "p6_use": p6_use}

_PIECES = r"""
WITH d AS (SELECT doc_id, strlen(text) AS n, strlen(regexp_extract(text, '(?s)^(.*?\n[ \t\r]*\n)', 1)) AS p FROM documents WHERE text IS NOT NULL),
h AS (SELECT *, CASE WHEN p < n THEN p // 4096 ELSE greatest(0, (n + 4095) // 4096 - 1) END AS head FROM d),
m AS (SELECT *, least(n, (head + 1) * 4096, greatest(p, head * 4096) + 1024) AS mixed FROM h),
k AS (SELECT doc_id, n, greatest(0, n - p) AS loss, head + 1 + (n - mixed + 1023) // 1024 AS pieces FROM m)"""
ORACLES = {
    "p6_found": "SELECT doc_id FROM documents WHERE strlen(text) > 4096",
    "p6_limits": _PIECES + " SELECT doc_id, pieces, n AS tokens, loss AS loss_tokens, true AS follow, true AS hold FROM k",
    "p6_use": _PIECES + """, s AS (SELECT (sum(n) + 4095) // 4096 AS t, (sum(pieces) + 15) // 16 AS s, (sum(loss) + 1023) // 1024 AS l FROM k)
SELECT greatest(t, s, l)::BIGINT AS least, CASE WHEN l >= t AND l >= s THEN 'loss' WHEN t >= s THEN 'tokens' ELSE 'segments' END AS scarcest, true AS near FROM s""",
}
