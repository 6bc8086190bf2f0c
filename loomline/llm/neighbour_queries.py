"""Queries over nearest vectors."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.llm.neighbours import Index, both_ways, comparisons, current_vectors, distinct_vectors, listed, nearest, rerank, search, search_blocks, similar_pairs, top
from loomline.session import cut, table

INDEX = Index()


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_pairs(nearest(table(spark, sf_dir, "doc_vectors"), table(spark, sf_dir, "search_docs"), index=INDEX, least_cosine=0.90), 0.90)


def p4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 most similar of every vector."""
    return nearest(table(spark, sf_dir, "doc_vectors"), table(spark, sf_dir, "search_docs"), index=INDEX)


def p4_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the hashing of either query, by cosine, against brute force: the true 5 neighbours of the vectors
    whose id is divisible by 20, among all. With it the configuration that was fitted (tables, axes, order), how
    often a vector is shuffled, and the share of all pairs that are compared, repeats counted.

    A neighbour counts as found if one as similar was: of copies any will do.
    """
    vectors, docs = table(spark, sf_dir, "doc_vectors"), table(spark, sf_dir, "search_docs")
    current = current_vectors(vectors, docs, INDEX.dim, "doc_id", "vec", "encoded_at").persist(StorageLevel.MEMORY_AND_DISK)
    asked = current.select("id").where("id % 20 = 0")
    exact = both_ways(rerank(search_blocks(asked, current, INDEX.dim, 5), current, INDEX.dim, None))
    true = top(exact.join(asked, "id", "left_semi"), 5)
    band = F.when(F.col("cosine") >= 0.9, "0.9").when(F.col("cosine") >= 0.5, "0.5").otherwise("below")
    distinct, classes = distinct_vectors(current)
    out = []
    for name, least in (("p4_found", 0.90), ("p4_neighbours", None)):
        groups, found, rows, h, tasks = search(distinct, INDEX, 5, least)
        hits = cut(listed(found, classes, 5).join(asked, "id", "left_semi"))
        last = hits.where("rank = 5").select("id", F.col("cosine").alias("last"))
        wanted = true if least is None else true.where(F.col("cosine") >= least)
        hit = F.col("hit").isNotNull() | F.coalesce(F.col("cosine") <= F.col("last") + 1e-9, F.lit(False))
        scored = wanted.join(hits.select("id", "neighbour", F.lit(True).alias("hit")), ["id", "neighbour"], "left").join(last, "id", "left").groupBy(band.alias("cosine_from"))
        scored = scored.agg(F.count("*").alias("neighbours"), F.avg(hit.cast("int")).alias("recall"))
        share = comparisons(groups, h, tasks).first()["compared"] / max(1.0, rows * (rows - 1) / 2)
        facts = {"search": name, "vectors": rows, "tables": h.tables, "axes": h.axes, "cell_axes": h.order, "copies": h.copies, "compared_share": share}
        out.append(scored.select(*(F.lit(v).alias(n) for n, v in facts.items()), "cosine_from", "neighbours", "recall"))
    return out[0].unionByName(out[1])


QUERIES = {"p4_found": p4_found, "p4_neighbours": p4_neighbours, "p4_recall": p4_recall}
ORACLES = {
    "p4_found": """
WITH latest AS (SELECT doc_id, vec::DOUBLE[] AS vec FROM (SELECT doc_id, vec, row_number() OVER (PARTITION BY doc_id ORDER BY encoded_at DESC) AS r FROM doc_vectors) WHERE r = 1),
valid AS (SELECT * FROM latest WHERE len(vec) = 256 AND len(list_filter(vec, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(vec, lambda x: x <> 0)) > 0
          AND doc_id IN (SELECT doc_id FROM search_docs)),
unit AS (SELECT doc_id, list_transform(vec, lambda x: x / sqrt(list_dot_product(vec, vec))) AS u FROM valid),
near AS (SELECT a.doc_id AS a, b.doc_id AS b, list_dot_product(a.u, b.u) AS c FROM unit a JOIN unit b ON a.doc_id <> b.doc_id),
best AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS r FROM near WHERE c >= 0.9)
SELECT DISTINCT least(a, b) AS id_a, greatest(a, b) AS id_b FROM best WHERE r <= 5""",
}
