"""The relations that the queries share, and their SQL for the oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators.snapshots import canonical_path
from loomline.session import table

COMMIT_COLUMNS = ["commit_no", "oid", "short_id", "repo", "author", "ts", "message", "topo_pos", "parents"]


def commits(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The commit log without repeated loads, which have the same content; only the columns asked for are read."""
    wanted = list(dict.fromkeys(["oid", *(columns or COMMIT_COLUMNS)]))
    return table(spark, sf_dir, "commits").select(*wanted).dropDuplicates(["oid"])


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Search documents without repeated rows."""
    wanted = list(dict.fromkeys(["doc_id", *columns]))
    docs = table(spark, sf_dir, "search_docs").select(*wanted) if columns else table(spark, sf_dir, "search_docs")
    return docs.dropDuplicates(["doc_id"])


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, vec): the latest vector of each document, if it is valid."""
    latest = table(spark, sf_dir, "doc_vectors").groupBy("doc_id").agg(F.max(F.struct("encoded_at", "vec")).alias("_v"))
    valid = latest.select("doc_id", F.col("_v.vec").alias("vec")).where(F.size("vec") == 256)
    bad = F.exists("vec", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return valid.where(~bad & F.exists("vec", lambda x: x != 0))


def head_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(repo, path, name, kind, blob_oid, size): entries of the last snapshot of each repo, from its last delivery."""
    tree = table(spark, sf_dir, "tree_snapshots")
    # One row a repo: the highest delivery of the highest snapshot.
    last = tree.groupBy("repo").agg(F.max(F.struct("snapshot_no", "delivery_no")).alias("_l")).select("repo", "_l.*")
    rows = tree.join(last, ["repo", "snapshot_no", "delivery_no"])
    return rows.select("repo", canonical_path(F.col("path")).alias("path"), "name", "kind", F.lower("blob_oid").alias("blob_oid"), "size").groupBy("repo", "path").agg(F.min(F.struct("name", "kind", "blob_oid", "size")).alias("_e")).select("repo", "path", "_e.*")


COMMITS_SQL = "commit_log AS (SELECT DISTINCT commit_no, oid, short_id, repo, author, ts, message, topo_pos, parents FROM commits)"
DOCS_SQL = "docs AS (SELECT DISTINCT * FROM search_docs)"
VECTORS_SQL = """vectors AS (SELECT doc_id, vec::DOUBLE[] AS vec FROM (
    SELECT doc_id, vec, row_number() OVER (PARTITION BY doc_id ORDER BY encoded_at DESC) AS r FROM doc_vectors)
  WHERE r = 1 AND len(vec) = 256 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(vec, lambda x: x <> 0)) > 0)"""
HEAD_SQL = r"""last AS (SELECT repo, max((snapshot_no, delivery_no)) AS l FROM tree_snapshots GROUP BY repo),
head AS (SELECT DISTINCT t.repo, regexp_replace(regexp_replace(path, '/(\./|/)+', '/', 'g'), '^(\./|/)+', '') AS path, name, kind, lower(blob_oid) AS blob_oid, size
         FROM tree_snapshots t JOIN last USING (repo) WHERE (snapshot_no, delivery_no) = l)"""
