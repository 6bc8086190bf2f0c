"""Queries over periodic full snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.snapshots import file_changes
from loomline.session import table


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return file_changes(table(spark, sf_dir, "tree_snapshots"))


def p2_change_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Change counts of each snapshot in the sense of added, modified and deleted lists."""
    per = file_changes(table(spark, sf_dir, "tree_snapshots")).groupBy("repo", "snapshot_no")
    return per.agg(*(F.count_if(F.col("change") == c).alias(c) for c in ("added", "modified", "deleted")))


CHANGES_SQL = r"""
WITH win AS (SELECT repo, snapshot_no, max(delivery_no) AS delivery_no FROM tree_snapshots GROUP BY ALL),
snaps AS (SELECT repo, snapshot_no, delivery_no,
                 lag(snapshot_no) OVER (PARTITION BY repo ORDER BY snapshot_no) AS prev FROM win),
files AS (SELECT DISTINCT t.repo, t.snapshot_no, s.prev,
                 regexp_replace(regexp_replace(path, '/(\./|/)+', '/', 'g'), '^(\./|/)+', '') AS path,
                 lower(blob_oid) AS blob, mode
          FROM tree_snapshots t JOIN snaps s USING (repo, snapshot_no, delivery_no) WHERE kind = 'file'),
later AS (SELECT * FROM files WHERE prev IS NOT NULL),
earlier AS (SELECT s.repo, s.snapshot_no, f.path, f.blob, f.mode
            FROM snaps s JOIN files f ON f.repo = s.repo AND f.snapshot_no = s.prev),
changes AS (SELECT coalesce(l.repo, e.repo) AS repo, coalesce(l.snapshot_no, e.snapshot_no) AS snapshot_no,
                   coalesce(l.path, e.path) AS path,
                   CASE WHEN e.path IS NULL THEN 'added' WHEN l.path IS NULL THEN 'deleted' ELSE 'modified' END AS change
            FROM later l FULL JOIN earlier e ON l.repo = e.repo AND l.snapshot_no = e.snapshot_no AND l.path = e.path
            WHERE e.path IS NULL OR l.path IS NULL OR l.blob IS DISTINCT FROM e.blob OR l.mode IS DISTINCT FROM e.mode)
"""

QUERIES = {"p2_found": p2_found, "p2_change_lists": p2_change_lists}
ORACLES = {
    "p2_found": CHANGES_SQL + "SELECT repo, snapshot_no, path, change FROM changes",
    "p2_change_lists": CHANGES_SQL + "SELECT repo, snapshot_no, count(*) FILTER (change = 'added') AS added,"
    " count(*) FILTER (change = 'modified') AS modified, count(*) FILTER (change = 'deleted') AS deleted"
    " FROM changes GROUP BY ALL",
}
