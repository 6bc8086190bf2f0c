"""Queries through the persistent index: built, brought up to date and searched."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import index as I
from loomline.operators import search as S
from loomline.plans.base import VECTORS_SQL, documents, vectors
from loomline.plans.history_queries import LAST_SQL, last_changes
from loomline.plans.search_queries import BATCH, LIMIT, bm25_sql
from loomline.plans.text_queries import ALIASES_SQL, PATH_TERMS_SQL
from loomline.session import checkpoint_dir, table

COLUMNS = ("kind", "title", "commit_oid", "path", "line_start", "line_end", "body")

#: Ids of documents that an update adds are those of their files, from here on.
NEW_IDS = 1_000_000_000


def _built(spark: SparkSession, sf_dir: str) -> tuple[str, I.Meta]:
    """A full build over all documents, in the shared folder."""
    folder = f"{checkpoint_dir(spark)}/index-{uuid.uuid4().hex}"
    docs = documents(spark, sf_dir, *COLUMNS)
    return folder, I.build(spark, folder, "first", docs, vectors(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi"))


def _updated(spark: SparkSession, sf_dir: str) -> I.Index:
    """That build, brought up to the changes of the last snapshots: files added or modified come anew."""
    folder, _ = _built(spark, sf_dir)
    changes = last_changes(spark, sf_dir)
    fresh = changes.where(F.col("change").isin("added", "modified")).select("repo", "path").distinct()
    files = table(spark, sf_dir, "source_files").where("content IS NOT NULL").join(fresh, ["repo", "path"], "left_semi")
    none = F.lit(None).cast("int")
    new = files.select((F.lit(NEW_IDS) + F.col("file_id")).alias("doc_id"), F.lit("file").alias("kind"), F.col("path").alias("title"), "commit_oid", "path", none.alias("line_start"), none.alias("line_end"), F.col("content").alias("body"))
    I.update(spark, folder, "second", changes, new, vectors(spark, sf_dir).limit(0))
    return I.Index.open(spark, folder)


def index_build_search(spark, sf_dir):
    """The batch of queries against a built index."""
    folder, _ = _built(spark, sf_dir)
    return I.Index.open(spark, folder).bm25(BATCH, LIMIT)


def index_incremental(spark, sf_dir):
    """The batch of queries against an index that was brought up to date."""
    return _updated(spark, sf_dir).bm25(BATCH, LIMIT)


def index_state(spark, sf_dir) -> DataFrame:
    """What is in such an index: documents of each kind, and of each field how many have it and its mean length."""
    index = _updated(spark, sf_dir)
    kinds = index.docs.groupBy(F.col("kind").alias("name")).agg(F.count("*").alias("n"), F.lit(None).cast("double").alias("avgdl"))
    known = spark.createDataFrame([("pointer", index.meta.documents, None)], "name string, n long, avgdl double")
    return kinds.unionByName(index.stats.select(F.col("field").alias("name"), "n", F.round("avgdl", 6).alias("avgdl"))).unionByName(known)


def index_nearest(spark, sf_dir):
    """The vectors of an index nearest to those of the documents whose id is divisible by 20."""
    folder, _ = _built(spark, sf_dir)
    index = I.Index.open(spark, folder)
    asked = index.vectors.where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")
    found = index.nearest(asked, LIMIT)
    return found.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


QUERIES = {"index_build_search": index_build_search, "index_incremental": index_incremental, "index_state": index_state, "index_nearest": index_nearest}

_OLD = "old AS (SELECT DISTINCT doc_id, kind, title, body, path FROM search_docs)"
_NEW = f"""live AS (SELECT * FROM old WHERE path IS NULL OR path NOT IN (SELECT path FROM last_changes WHERE change IN ('modified', 'deleted'))
  UNION ALL SELECT {NEW_IDS} + file_id, 'file', path, content, path FROM source_files JOIN (SELECT DISTINCT repo, path FROM last_changes WHERE change IN ('added', 'modified')) USING (repo, path) WHERE content IS NOT NULL)"""
_TERMS = f"docs AS (SELECT doc_id, kind, title, body, path, CASE WHEN path IS NOT NULL THEN rtrim({PATH_TERMS_SQL} || ' ' || {ALIASES_SQL}, ' ') END AS path_terms FROM live)"
_SEARCH = f"{bm25_sql(BATCH)} SELECT * FROM words WHERE rank <= {LIMIT}"
ORACLES = {
    "index_build_search": f"WITH {_OLD}, live AS (SELECT * FROM old), {_TERMS}, {_SEARCH}",
    "index_incremental": f"{LAST_SQL}, {_OLD}, {_NEW}, {_TERMS}, {_SEARCH}",
    "index_state": f"""{LAST_SQL}, {_OLD}, {_NEW}, {_TERMS}, {bm25_sql([S.Query(1, "title:a path_terms:a path:a body:ab")])},
        sizes AS (SELECT field AS name, count(*) AS n, round(avg(len(terms)), 6) AS avgdl FROM analysed GROUP BY field)
        SELECT kind AS name, count(*) AS n, NULL::DOUBLE AS avgdl FROM live GROUP BY kind UNION ALL SELECT * FROM sizes UNION ALL SELECT 'pointer', count(*), NULL FROM live""",
    "index_nearest": f"""WITH {VECTORS_SQL}, live AS (SELECT * FROM vectors WHERE doc_id IN (SELECT doc_id FROM search_docs)), asked AS (SELECT doc_id::INT AS qid, vec FROM live WHERE doc_id % 20 = 0),
        s AS (SELECT qid, doc_id, round(list_dot_product(q.vec, v.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(v.vec, v.vec)), 9) AS score FROM asked q, live v)
        SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {LIMIT}""",
}
