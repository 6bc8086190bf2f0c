"""Evaluation of ranked results against judged queries."""

from __future__ import annotations

import math
import time
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import parameters

#: Categories with expected hits, in the order of reports.
CATEGORIES = ("exact_identifier", "natural_language", "korean", "typo", "paraphrase")
DEPTH = 10

FIXTURE_TYPE = "qid int, text string, category string, expected array<struct<path string, kind string, title string>>, forbidden array<struct<path string, path_prefix string>>"


def fixture_violations(fixtures: DataFrame) -> DataFrame:
    """(qid, problem) of fixtures that break a rule: a negative query has no expected hits and at least one
    forbidden rule, each of exactly one kind; any other has expected hits and no forbidden rule."""
    size = lambda c: F.coalesce(F.size(c), F.lit(0))
    negative = F.col("category") == "negative"
    odd = F.exists(F.coalesce("forbidden", F.array().cast("array<struct<path string, path_prefix string>>")), lambda r: r["path"].isNull() == r["path_prefix"].isNull())
    problems = F.array(
        F.when(~F.col("category").isin(*CATEGORIES, "negative"), "unknown category"),
        F.when(negative & (size("expected") > 0), "negative with expected hits"),
        F.when(negative & (size("forbidden") <= 0), "negative without forbidden rules"),
        F.when(negative & odd, "rule with not exactly one of path and path_prefix"),
        F.when(~negative & (size("expected") <= 0), "no expected hits"),
        F.when(~negative & (size("forbidden") > 0), "forbidden rules"),
    )
    return fixtures.select("qid", F.explode(F.filter(problems, lambda p: p.isNotNull())).alias("problem"))


def relevant_hits(fixtures: DataFrame, hits: DataFrame) -> DataFrame:
    """Hits among the first ten that some expected hit describes: same path, and kind and title where given.
    A title is compared without the place that follows it in brackets. hits: (qid, rank, kind, path, title)."""
    expected = fixtures.where("category <> 'negative'").select("qid", F.explode("expected").alias("e")).select("qid", "e.path", F.col("e.kind").alias("_kind"), F.col("e.title").alias("_title"))
    name = F.substring_index("title", " (", 1)
    same = (F.col("_kind").isNull() | (F.lower("_kind") == F.col("kind"))) & (F.col("_title").isNull() | (F.col("_title") == name))
    return hits.where(F.col("rank") <= DEPTH).join(F.broadcast(expected), ["qid", "path"]).where(same).select("qid", "rank", "path").distinct()


def per_query(fixtures: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, category, mrr, recall_5, recall_10, ndcg_10, first_rank, hit_paths) of every query that is not negative.

    Recall counts hits, not distinct expected ones, up to the number expected; the ideal of NDCG has as many hits
    as are expected, so it can exceed 1.
    """
    positive = fixtures.where("category <> 'negative'").select("qid", "category", F.size("expected").alias("n"))
    rank = F.col("rank")
    found = relevant_hits(fixtures, hits).groupBy("qid").agg(
        F.min("rank").alias("first_rank"),
        F.count_if(rank <= 5).alias("h5"),
        F.count("*").alias("h10"),
        F.sum(1 / F.log2(rank + 1.0)).alias("dcg"),
        F.size(F.collect_set("path")).alias("hit_paths"),
    )
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("n", F.lit(DEPTH))), F.lit(0.0), lambda s, r: s + 1 / F.log2(r + 1.0))
    recall = lambda c: F.least(F.coalesce(F.col(c), F.lit(0)), F.col("n")) / F.greatest("n", F.lit(1))
    return positive.join(found, "qid", "left").select(
        "qid",
        "category",
        F.round(F.coalesce(1 / F.col("first_rank"), F.lit(0.0)), 6).alias("mrr"),
        F.round(recall("h5"), 6).alias("recall_5"),
        F.round(recall("h10"), 6).alias("recall_10"),
        F.round(F.when(F.col("n") == 0, 1.0).otherwise(F.coalesce("dcg", F.lit(0.0)) / ideal), 6).alias("ndcg_10"),
        "first_rank",
        F.coalesce("hit_paths", F.lit(0)).alias("hit_paths"),
    )


def hit_paths(fixtures: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, position, path): the different relevant paths of each query in the order in which they first appear."""
    first = relevant_hits(fixtures, hits).groupBy("qid", "path").agg(F.min("rank").alias("first"))
    return first.select("qid", F.row_number().over(Window.partitionBy("qid").orderBy("first", "path")).alias("position"), "path")


METRICS = ("mrr", "recall_5", "recall_10", "ndcg_10")


def overall(evaluated: DataFrame) -> DataFrame:
    return evaluated.agg(*(F.round(F.coalesce(F.avg(m), F.lit(0.0)), 6).alias(m) for m in METRICS), F.count("*").alias("n"))


def by_category(evaluated: DataFrame) -> DataFrame:
    """One row for each category in the order of reports, zeros where it has no query."""
    order = parameters(evaluated.sparkSession, list(enumerate(CATEGORIES)), "position int, category string")
    grouped = evaluated.groupBy("category").agg(*(F.round(F.avg(m), 6).alias(m) for m in METRICS), F.count("*").alias("n"))
    return order.join(grouped, "category", "left").na.fill(0, [*METRICS, "n"])


def violations(fixtures: DataFrame, hits: DataFrame) -> DataFrame:
    """(qid, rank, path, rule): hits among the first ten that a forbidden rule of a negative query matches."""
    rules = fixtures.where("category = 'negative'").select("qid", F.explode("forbidden").alias("r")).select("qid", F.col("r.path").alias("_path"), F.col("r.path_prefix").alias("_prefix"))
    hit = (F.col("path") == F.col("_path")) | (F.col("_path").isNull() & F.startswith("path", F.col("_prefix")))
    rule = F.when(F.col("_path").isNotNull(), F.concat(F.lit("path="), "_path")).otherwise(F.concat(F.lit("path_prefix="), "_prefix"))
    return hits.where((F.col("rank") <= DEPTH) & F.col("path").isNotNull()).join(F.broadcast(rules), "qid").where(hit).select("qid", "rank", "path", rule.alias("rule"))


def negatives(fixtures: DataFrame, hits: DataFrame) -> DataFrame:
    """(n, pass_rate): the share of negative queries without a violation, 0 if there is none."""
    bad = violations(fixtures, hits).select("qid").distinct().withColumn("_bad", F.lit(1))
    judged = fixtures.where("category = 'negative'").select("qid").join(bad, "qid", "left")
    return judged.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.col("_bad").isNull().cast("double")), F.lit(0.0)).alias("pass_rate"))


def latency(samples: list[float], elapsed: float) -> dict[str, float]:
    """Nearest-rank percentiles, mean and rate of samples in milliseconds; zeros if there are none."""
    ordered = sorted(samples)
    n = len(ordered)

    def at(p: float) -> float:
        return ordered[max(0, min(n, math.ceil(p * n)) - 1)] if n else 0.0

    return {"p50": at(0.50), "p95": at(0.95), "p99": at(0.99), "mean": sum(ordered) / n if n else 0.0, "qps": n / elapsed if elapsed > 0 else 0.0, "n": n}


def run_perf(search: Callable[[Any], Any], queries: list, warmup: int = 3, iters: int = 10) -> tuple[dict[str, float], list]:
    """Times a search over all queries ``iters`` times after warming up; the last round's results are returned."""
    for _ in range(warmup):
        for q in queries:
            search(q)
    samples, results, began = [], [], time.perf_counter()
    for _ in range(iters):
        results = []
        for q in queries:
            t = time.perf_counter()
            results.append(search(q))
            samples.append((time.perf_counter() - t) * 1000)
    return latency(samples, time.perf_counter() - began), results
