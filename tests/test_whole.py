"""Queries that do the whole job, on tables small enough to work out the result another way."""

from __future__ import annotations

import os
from collections import Counter
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
T0 = datetime(2024, 1, 1)


def query(name):
    import __spark_entry__

    return __spark_entry__.queries()[name]


def duck(sql):
    """Rows of a statement over the smallest tables."""
    import duckdb

    c = duckdb.connect()
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f[:-8]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return set(c.execute(sql).fetchall())


def test_chunk_to_meta_has_large_files(spark, tmp_path):
    pad = "// pad\n" * 3000
    files = [
        ("small.rs", "fn tiny() {\n}\n"),
        ("large.rs", pad + "fn one() {\n  1;\n}\nfn line() {}\nstruct Two {\n  x: u8,\n}\n"),
        ("bare.rs", pad),
        ("notes.txt", "text\n" * 5000),
        ("none.rs", None),
    ]
    spark.createDataFrame([(i, "c1", p, c) for i, (p, c) in enumerate(files)], "file_id long, commit_oid string, path string, content string").write.parquet(str(tmp_path / "source_files.parquet"))
    spark.createDataFrame([(1, "c1", "c1", "r", "a", T0, "Title\nbody", 0, [])], "commit_no long, oid string, short_id string, repo string, author string, ts timestamp, message string, topo_pos int, parents array<string>").write.parquet(str(tmp_path / "commits.parquet"))
    got = {tuple(r) for r in query("chunk_to_meta")(spark, str(tmp_path)).collect()}
    assert got == {
        ("commit", "Title", "c1", None, None, None),
        ("file", "small.rs", "c1", "small.rs", None, None),
        ("symbol", "one (large.rs)", "c1", "large.rs", 3001, 3003),
        ("symbol", "Two (large.rs)", "c1", "large.rs", 3005, 3007),
        ("file", "bare.rs", "c1", "bare.rs", None, None),
        ("file", "notes.txt", "c1", "notes.txt", None, None),
    }


@pytest.fixture(scope="module")
def vector_tables(tmp_path_factory, spark):
    """90 documents with vectors, some of them copies, so that scores tie."""
    rng = np.random.RandomState(6)
    x = rng.randn(90, 256).astype(np.float32)
    x[30:45] = x[60]
    folder = str(tmp_path_factory.mktemp("vectors"))
    spark.createDataFrame([(i, [float(a) for a in v], T0) for i, v in enumerate(x)], "doc_id long, vec array<float>, encoded_at timestamp").write.parquet(f"{folder}/doc_vectors.parquet")
    return folder, x.astype(np.float64)


@pytest.mark.parametrize("most", [10_000, 4])
def test_vector_topk_takes_all_queries(spark, vector_tables, monkeypatch, most):
    from loomline.operators import search

    monkeypatch.setattr(search, "MAX_QUERIES", most)
    folder, x = vector_tables
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    want = [(q, r + 1, int(d), round(score[q, d], 6)) for q in range(0, 90, 20) for r, d in enumerate(np.lexsort((np.arange(90), -score[q]))[:10])]
    assert sorted(tuple(r) for r in query("vector_topk")(spark, folder).collect()) == [(q, r, d, pytest.approx(s, abs=2e-6)) for q, r, d, s in want]


@pytest.mark.parametrize(("most", "passes"), [(10_000, 8), (2, 8), (1, 2)])
def test_vector_topk_takes_wide_ids(spark, vector_tables, tmp_path, monkeypatch, most, passes):
    """Ids beyond 32 bits are query ids too, in one pass, in several and in several portions of passes."""
    from loomline.operators import search

    monkeypatch.setattr(search, "MAX_QUERIES", most)
    monkeypatch.setattr(search, "PASSES", passes, raising=False)
    folder, x = vector_tables
    far = 20 * 10**9
    spark.read.parquet(f"{folder}/doc_vectors.parquet").withColumn("doc_id", F.col("doc_id") + far).write.parquet(f"{tmp_path}/doc_vectors.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    want = [(far + q, r + 1, far + int(d), round(score[q, d], 6)) for q in range(0, 90, 20) for r, d in enumerate(np.lexsort((np.arange(90), -score[q]))[:10])]
    assert sorted(tuple(r) for r in query("vector_topk")(spark, str(tmp_path)).collect()) == [(q, r, d, pytest.approx(s, abs=2e-6)) for q, r, d, s in want]


@pytest.mark.parametrize("most", [10_000, 2])
def test_index_nearest_takes_all_queries(spark, vector_tables, tmp_path, monkeypatch, most):
    """More queries than go with one pass, of ids beyond 32 bits."""
    from loomline.operators import search

    monkeypatch.setattr(search, "MAX_QUERIES", most)
    folder, x = vector_tables
    far = 20 * 10**9
    moved = spark.read.parquet(f"{folder}/doc_vectors.parquet").withColumn("doc_id", F.col("doc_id") + far)
    moved.write.parquet(f"{tmp_path}/doc_vectors.parquet")
    none = F.lit(None)
    moved.select("doc_id", F.lit("commit").alias("kind"), F.lit("Title").alias("title"), F.lit("c").alias("commit_oid"), none.cast("string").alias("path"), none.cast("int").alias("line_start"), none.cast("int").alias("line_end"), F.lit("a text").alias("body")).write.parquet(f"{tmp_path}/search_docs.parquet")
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    score = np.round(u @ u.T, 9)
    want = [(far + q, r + 1, far + int(d), round(score[q, d], 6)) for q in range(0, 90, 20) for r, d in enumerate(np.lexsort((np.arange(90), -score[q]))[:10])]
    assert sorted(tuple(r) for r in query("index_nearest")(spark, str(tmp_path)).collect()) == [(q, r, d, pytest.approx(s, abs=2e-6)) for q, r, d, s in want]


def test_l2_normalize_is_linear_in_the_width(spark):
    """The norm is worked out once for a vector and not once for each of its components."""
    import time

    from loomline.functions import text

    wide = spark.range(400).select(F.transform(F.sequence(F.lit(1), F.lit(8192)), lambda i: i.cast("double")).alias("vec"))
    began = time.perf_counter()
    first = wide.select(text.l2_normalize(F.col("vec"))[8191].alias("x")).agg(F.min("x"), F.max("x")).first()
    assert first[0] == first[1] == pytest.approx(8192 / np.sqrt((np.arange(1, 8193.0) ** 2).sum()))
    assert time.perf_counter() - began < 20


def test_vector_topk_is_exact_among_near_equals(spark):
    """Cosines that single precision cannot tell apart, in batches large enough to be searched by their tops."""
    from loomline.operators import search

    rng = np.random.RandomState(8)
    base = rng.randn(3, 64)
    x = np.concatenate([base[i % 3] + rng.randn(64) * 10.0 ** -rng.randint(1, 7) for i in range(6000)]).reshape(-1, 64)
    x[100:130] = x[7]
    u, v = x / np.linalg.norm(x, axis=1, keepdims=True), base / np.linalg.norm(base, axis=1, keepdims=True)
    score = np.round(v @ u.T, 9)
    rows = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)] + [(9999, [float("nan")] * 64)], "doc_id long, vec array<double>").coalesce(1)
    asked = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(base)], "qid int, vec array<double>")
    found = search.vector_topk(rows, asked, 10)
    assert dict(found.dtypes)["qid"] == "int"
    got = {(r.qid, r["rank"]): r.score for r in found.collect()}
    assert len(got) == 30
    for q in range(3):
        assert [got[q, r + 1] for r in range(10)] == pytest.approx(np.sort(score[q])[::-1][:10], abs=2e-9)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_bm25_path_title_takes_the_whole_batch(spark):
    from loomline.operators import grammar
    from loomline.plans import search_queries as Q

    got = {tuple(r) for r in query("bm25_path_title")(spark, SF).collect()}
    assert got == duck(f"WITH {Q.DOCS_SQL}, {Q.bm25_sql(Q.BATCH, grammar.PATH_TITLE_WEIGHTS)} SELECT qid, rank, doc_id, score FROM words WHERE rank <= {Q.LIMIT}")
    assert {r[0] for r in got} - {1, 2, 3}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_term_stats_has_the_body(spark):
    from loomline.functions.text import bigrams
    from loomline.plans.base import documents

    docs = {}
    for i, grams in documents(spark, SF, "body").where("body IS NOT NULL").select("doc_id", bigrams(F.col("body"))).collect():
        docs[i] = Counter(grams)
    df, n = Counter(g for c in docs.values() for g in c), sum(docs.values(), Counter())
    mean = round(n.total() / len(docs), 6)
    got = {r.term: (r.df, r.n, r.avgdl) for r in query("term_stats")(spark, SF).where("field = 'body'").collect()}
    assert got == {g: (df[g], n[g], pytest.approx(mean, abs=2e-6)) for g in n} and got


def test_diffs_of_all_source_files(spark, tmp_path):
    files = [(1, "a {\n  b\n}\nc\n}\n"), (2, "x\n"), (3, "}\n}\ny {\n}\n"), (4, None)]
    spark.createDataFrame(files, "file_id long, content string").write.parquet(str(tmp_path / "source_files.parquet"))
    assert {tuple(r) for r in query("diff_stats")(spark, str(tmp_path)).collect()} == {(1, 0, 2), (3, 0, 3)}
    rows = {tuple(r) for r in query("diff_align")(spark, str(tmp_path)).collect()}
    assert rows == {(1, "a {", "a {", 0, 0), (1, "  b", "  b", 1, 1), (1, "}", None, 2, None), (1, "c", "c", 3, 3), (1, "}", None, 4, None)} | {(3, "}", None, 0, None), (3, "}", None, 1, None), (3, "y {", "y {", 2, 2), (3, "}", None, 3, None)}


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_small_diff(spark):
    """The nine lines of the SQL, which has no table."""
    from loomline.operators import history as H
    from loomline.plans import history_queries as Q

    lines = spark.createDataFrame(Q.DIFF_ROWS, "file string, pos int, kind string, content string")
    aligned = H.align_diff(lines, ["file"]).select("file", "old", "new", "old_pos", "new_pos")
    assert {tuple(r) for r in aligned.collect()} == duck(Q.SMALL_ORACLES["diff_align"])
    assert {tuple(r) for r in H.diff_stats(lines, ["file"]).collect()} == duck(Q.SMALL_ORACLES["diff_stats"])
