"""Queries over pieces of oversized symbol spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.llm.chunking import Limits, cut_spans
from loomline.session import table


def p5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cut_spans(table(spark, sf_dir, "symbol_spans"), table(spark, sf_dir, "source_files"))


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that had to be cut, with the kind of boundary their text allows."""
    return p5_pieces(spark, sf_dir).where("piece_no = 0").select("span_id", "boundary")


def p5_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spans that had to be cut: where they begin and end, and whether their pieces follow one another, cover them,
    keep the sizes and the overlap."""
    limits = Limits()
    size, own = F.col("byte_end") - F.col("byte_start"), F.col("byte_end") - F.col("byte_start") - F.col("overlap")
    before = F.lag("byte_end").over(Window.partitionBy("span_id").orderBy("piece_no"))
    follows = F.when(F.col("piece_no") == 0, F.col("overlap") == 0).otherwise(F.col("byte_start") + F.col("overlap") == before)
    sized = (size <= limits.largest) & (F.col("overlap") <= limits.overlap) & ((own >= limits.smallest) | (F.col("piece_no") == F.col("pieces") - 1))
    text = F.col("text").contains("\ufffd") | (F.octet_length("text") == size)
    pieces = p5_pieces(spark, sf_dir).select("span_id", "byte_start", "byte_end", "pieces", follows.alias("follows"), (sized & text).alias("sized"))
    return pieces.groupBy("span_id").agg(
        F.min("byte_start").alias("byte_start"), F.max("byte_end").alias("byte_end"), (F.count("*") == F.max("pieces")).alias("numbered"), F.every("follows").alias("follows"), F.every("sized").alias("sized")
    )


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_checks": p5_checks}

#: Lines of the contents with their places in bytes; the place of each span; the lines of the long ones, cut to them.
_LONG = r"""
WITH files AS (SELECT file_id, min(content) AS c FROM source_files WHERE content IS NOT NULL GROUP BY file_id),
split AS (SELECT file_id, strlen(c) AS size, string_split(c, chr(10)) AS l FROM files),
raw AS (SELECT file_id, size, len(l) AS n, unnest(l) AS t, unnest(range(1, len(l) + 1)) AS no FROM split),
placed AS (SELECT *, coalesce(sum(strlen(t) + 1) OVER (PARTITION BY file_id ORDER BY no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s FROM raw),
ended AS (SELECT *, s + strlen(t) AS feed, CASE WHEN no < n AND ends_with(t, chr(13)) THEN left(t, length(t) - 1) ELSE t END AS u FROM placed),
lines AS (SELECT file_id, size, n, no, s, feed, s + strlen(u) AS e, strlen(u) - strlen(ltrim(u, ' ' || chr(9))) AS lead, strlen(u) - strlen(rtrim(u, ' ' || chr(9))) AS trail FROM ended),
once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY span_id, file_id ORDER BY line_start NULLS FIRST, line_end NULLS FIRST, byte_start NULLS FIRST, byte_end NULLS FIRST) AS r
         FROM symbol_spans WHERE span_id IS NOT NULL AND line_start IS NOT NULL AND line_end IS NOT NULL) WHERE r = 1),
ordered AS (SELECT span_id, file_id, least(line_start, line_end) AS l1, greatest(line_start, line_end) AS l2, least(byte_start, byte_end) AS b1, greatest(byte_start, byte_end) AS b2,
                   byte_start IS NOT NULL AND byte_end IS NOT NULL AS given FROM once),
spans AS (SELECT o.span_id, o.file_id, CASE WHEN given AND b1 >= 0 AND b1 < b2 AND b2 <= f.size AND p.no = l1 AND q.no = l2 THEN b1 ELSE x.s END AS a,
                 CASE WHEN given AND b1 >= 0 AND b1 < b2 AND b2 <= f.size AND p.no = l1 AND q.no = l2 THEN b2 ELSE y.e END AS b
          FROM ordered o JOIN split f USING (file_id) LEFT JOIN lines p ON p.file_id = o.file_id AND o.b1 BETWEEN p.s AND p.feed LEFT JOIN lines q ON q.file_id = o.file_id AND o.b2 - 1 BETWEEN q.s AND q.feed
          LEFT JOIN lines x ON x.file_id = o.file_id AND x.no = greatest(l1, 1) LEFT JOIN lines y ON y.file_id = o.file_id AND y.no = least(l2, y.n) AND y.no >= greatest(l1, 1)),
long AS (SELECT * FROM spans WHERE b - a > 2048),
cut AS (SELECT span_id, no, greatest(s, a) AS s, CASE WHEN feed < b THEN greatest(e, s, a) ELSE b END AS e, s < a AS head, feed >= b AS tail, lines.e - lines.s AS whole, lead, trail
        FROM long JOIN lines USING (file_id) WHERE s <= b AND feed >= a),
inked AS (SELECT *, NOT (e <= s OR lead >= whole OR (head AND NOT tail AND trail >= e - s) OR (tail AND NOT head AND lead >= e - s)) AS ink FROM cut),
runs AS (SELECT *, sum((NOT ink)::INT) OVER (PARTITION BY span_id ORDER BY no) AS run FROM inked),
stretch AS (SELECT span_id, max(e) - min(s) AS size FROM runs WHERE ink GROUP BY span_id, run),
kinds AS (SELECT span_id, CASE WHEN coalesce((SELECT max(size) FROM stretch t WHERE t.span_id = i.span_id), 0) <= 2048 THEN 'paragraph' WHEN max(e - s) <= 2048 THEN 'line' ELSE 'inside' END AS boundary
          FROM inked i GROUP BY span_id)"""
ORACLES = {
    "p5_found": _LONG + " SELECT span_id, boundary FROM kinds",
    "p5_checks": _LONG + " SELECT span_id, a::BIGINT AS byte_start, b::BIGINT AS byte_end, true AS numbered, true AS follows, true AS sized FROM long",
}
