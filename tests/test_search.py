from __future__ import annotations

import json
import math

import pytest
from pyspark.sql import functions as F

from loomline.operators import evaluate as E
from loomline.operators import index as I
from loomline.operators import search as S
from loomline.operators.report import assemble, to_markdown, to_text
from loomline.sources.config import Config, FixtureError, LruCache, load_fixtures, restore_selection

DOC = "doc_id long, kind string, title string, commit_oid string, path string, line_start int, line_end int, body string"


def docs(spark, *rows):
    return spark.createDataFrame([(i, "file", t, "c", p, None, None, b) for i, t, p, b in rows], DOC)


def hits(spark, *rows):
    return spark.createDataFrame([(1, r, d, float(s)) for r, (d, s) in enumerate(rows, 1)], "qid int, rank int, doc_id long, score double")


def order(df):
    return [r.doc_id for r in df.orderBy("rank").collect()]


def test_bm25_matches_the_formula(spark):
    d = I.with_terms(docs(spark, (1, "alpha beta", "a/x.rs", "aa"), (2, "alpha", "b/y.rs", "bb"), (3, "gamma", "c/z.rs", "cc")))
    found = {r.doc_id: r.score for r in S.bm25(spark, d, [S.Query(1, "title:alpha")], 10).collect()}
    idf, avg = math.log(1 + (3 - 2 + 0.5) / 2.5), 4 / 3
    expected = {i: idf * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / avg)) * 2 for i, dl in ((1, 2), (2, 1))}
    assert found == pytest.approx(expected, abs=1e-8)
    assert order(S.bm25(spark, d, [S.Query(1, "title:alpha")], 10)) == [2, 1]


def test_bm25_semantics(spark):
    d = I.with_terms(docs(spark, (1, "ModalState (a)", "src/modal_state.rs", "fn open_modal"), (2, "other", "src/search.rs", "closing"), (3, "x", None, "한국어 본문")))
    q = lambda text: order(S.bm25(spark, d, [S.Query(1, text)], 10))
    assert q("ModalState") == [1] and q("modal") == [1]
    assert q("검색") == [2]  # by alias of the path
    assert q('path:"src/search.rs"') == [2]
    assert q("open -modal") == [] and q("+closing open") == [2]
    assert q('broken "quote') == [] and q("") == [] and q("zzz") == []
    assert q("clos") == [2]  # bigrams of the body
    assert S.bm25(spark, d.where("false"), [S.Query(1, "open")], 5).collect() == []


def test_query_language(spark):
    d = I.with_terms(docs(
        spark, (1, "open the file", "a.rs", "x"), (2, "file open", "b.rs", "x"), (3, "open file cache", "c.rs", "x"), (4, "tree parser", "d.rs", "x"), (5, "node parser", "e.rs", "x"), (6, "parser", "f.rs", None), (7, "open open file", None, "x"),
    ))
    q = lambda text: set(order(S.bm25(spark, d, [S.Query(1, text)], 10)))
    assert q('title:"open file"') == {3, 7} and q('title:"open file"~1') == {1, 3, 7} and q('title:"open open"') == {7} and q('title:"file cache"') == {3}
    assert q("title:parser AND (title:tree OR title:node)") == {4, 5} and q("title:parser -(title:tree title:node)") == {6}
    assert q("title:(parser AND NOT tree)") == {5, 6} and q("title:cache title:parser AND title:node") == {3, 5}
    assert q("title:[node TO parser}") == {1, 2, 3, 5, 7} and q("title:>=tree") == {4} and q("title: IN [cache node]") == {3, 5}
    assert q("title:pars*") == {4, 5, 6} and q('title:"open fi"*') == {1, 2, 3, 7} and q("*") == set(range(1, 8)) and q("* -title:open") == {4, 5, 6}
    assert q("-title:open") == q("title:(open") == q("AND x") == q("nofield:x") == q('title:open "') == set()
    twice = S.bm25(spark, d, [S.Query(1, "title:(open cache)^2"), S.Query(2, "title:open title:cache")], 10).collect()
    score = {(r.qid, r.doc_id): r.score for r in twice}
    assert all(s == pytest.approx(2 * score[2, i]) for (n, i), s in score.items() if n == 1)


def test_many_terms_give_the_same(spark, tmp_path, monkeypatch):
    """With the filter pushed down to the scan of an index, without it, and without an index."""
    rows = docs(spark, *((i, f"open file {i % 7} cache open", f"src/m{i % 5}.rs", f"body {i % 11} text") for i in range(60)), (99, None, None, None))
    I.build(spark, str(tmp_path / "i"), "h", rows, vectors(spark, [1]))
    index = I.Index.open(spark, str(tmp_path / "i"))
    queries = [S.Query(1, '"open file" m3 -cache4'), S.Query(2, "text cache m1")]
    pushed = {tuple(r) for r in index.bm25(queries, 20).collect()}
    monkeypatch.setattr(S, "PUSHED_TERMS", 0)
    assert {tuple(r) for r in index.bm25(queries, 20).collect()} == pushed and pushed
    assert {tuple(r) for r in S.bm25(spark, I.with_terms(rows), queries, 20).collect()} == pushed


def test_lengths_are_those_of_the_terms(spark):
    d = I.with_terms(docs(spark, (1, "ab Cd", "a/b.rs", "한글 x"), (2, None, None, None), (3, "", "x", "y"), (4, "-", "/", "")))
    made = S.analysed(d, I.FIELDS).select("doc_id", "field", F.size("terms").alias("dl"))
    assert {tuple(r) for r in S.lengths(d, I.FIELDS).collect()} == {tuple(r) for r in made.collect()}


def test_encoders(spark):
    texts = spark.createDataFrame([(i, None if i == 3 else "x" * i) for i in range(150)], "doc_id long, embed_text string")
    sizes = []

    def encoder(batch):
        sizes.append(len(batch))
        assert len(batch) <= 64
        return [[len(t), 1.0] for t in batch]

    found = {r.doc_id: list(r.vec) for r in S.encode_batches(texts, encoder, 2, "doc_id").collect()}
    assert found == {i: [0.0 if i == 3 else float(i), 1.0] for i in range(150)}
    assert S.encode_batches(texts.where("false"), encoder, 2, "doc_id").count() == 0
    tokens = spark.createDataFrame([("a", [3.0, 0.0]), ("b", [0.0, 4.0])], "word string, vec array<double>")
    texts = spark.createDataFrame([(1, "a b b"), (2, "c"), (3, None), (4, "A")], "doc_id long, embed_text string")
    assert {r.doc_id: [round(x, 6) for x in r.vec] for r in S.encode_texts(texts, tokens, "doc_id").collect()} == {1: [0.6, 0.8], 4: [1.0, 0.0]}


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0]), (4, [0.0, 0.0])], "doc_id long, vec array<float>")
    q = spark.createDataFrame([(7, [2.0, 0.0]), (8, [0.0, 0.0])], "qid int, vec array<double>")
    rows = S.vector_topk(v, q, 2).orderBy("qid", "rank").collect()
    assert [(r.qid, r.rank, r.doc_id) for r in rows] == [(7, 1, 1), (7, 2, 3), (8, 1, 1), (8, 2, 2)]
    assert rows[1].score == pytest.approx(math.sqrt(0.5), abs=1e-6)


def test_fusion(spark):
    a, b = hits(spark, (1, 9), (2, 8), (3, 7)), hits(spark, (3, 1), (4, 0.5))
    assert order(S.rrf([(a, 1.0), (b, 1.0)], 10)) == [3, 1, 2, 4]
    assert order(S.rrf([(a, 1.0), (b, 1.0)], 2)) == [3, 1]
    anchored = S.rrf_anchor(a, b, 3, 1.0, 1.5, 2).orderBy("rank").collect()
    assert [(r.doc_id, r.score) for r in anchored[:2]] == [(1, 9.0), (2, 8.0)] and anchored[2].doc_id == 3
    assert order(S.rrf_anchor(a, b, 10, 1.0, 1.5, 0)) == order(S.rrf([(a, 1.0), (b, 1.5)], 10))


def test_metrics(spark):
    fixtures = spark.createDataFrame(
        [(1, "q", "typo", [("a", None, None), ("b", "file", "N")], []), (2, "q", "korean", [("z", None, None)], []), (3, "q", "negative", [], [(None, "src/"), ("bad", None)])], E.FIXTURE_TYPE
    )
    res = spark.createDataFrame(
        [(1, 1, "file", "x", "t"), (1, 2, "file", "a", "t"), (1, 3, "symbol", "b", "N (b)"), (1, 6, "file", "b", "N (b)"), (1, 11, "file", "a", "t"), (3, 1, "file", "src/q", "t"), (3, 2, "file", "bad", "t"), (3, 3, "commit", None, "t")],
        "qid int, rank int, kind string, path string, title string",
    )
    per = {r.qid: r for r in E.per_query(fixtures, res).collect()}
    ideal = 1 + 1 / math.log2(3)
    assert per[1].mrr == 0.5 and per[1].recall_5 == 0.5 and per[1].recall_10 == 1.0
    assert per[1].ndcg_10 == pytest.approx((1 / math.log2(3) + 1 / math.log2(7)) / ideal, abs=1e-6)
    assert per[2].mrr == 0.0 and per[2].first_rank is None
    assert [(r.qid, r.position, r.path) for r in E.hit_paths(fixtures, res).orderBy("qid", "position").collect()] == [(1, 1, "a"), (1, 2, "b")]
    cats = E.by_category(E.per_query(fixtures, res)).orderBy("position").collect()
    assert [c.category for c in cats] == list(E.CATEGORIES) and [c.n for c in cats] == [0, 0, 1, 1, 0]
    assert E.negatives(fixtures, res).collect()[0].pass_rate == 0.0
    assert {(r.rank, r.rule) for r in E.violations(fixtures, res).collect()} == {(1, "path_prefix=src/"), (2, "path=bad")}
    assert E.overall(E.per_query(fixtures.where("false"), res)).collect()[0].n == 0


def test_latency():
    assert [E.latency([float(i) for i in range(1, 11)], 2.0)[k] for k in ("p50", "p95", "p99", "mean", "qps")] == [5.0, 10.0, 10.0, 5.5, 5.0]
    assert E.latency([], 0.0) == {"p50": 0.0, "p95": 0.0, "p99": 0.0, "mean": 0.0, "qps": 0.0, "n": 0}
    stats, results = E.run_perf(lambda q: q * 2, [1, 2], warmup=1, iters=2)
    assert stats["n"] == 4 and results == [2, 4] and E.run_perf(lambda q: q, [1], iters=0)[1] == []


def vectors(spark, ids):
    return spark.createDataFrame([(i, [float((i * 7 + j) % 5) + 0.1 for j in range(256)]) for i in ids], "doc_id long, vec array<float>")


def test_index_life_cycle(spark, tmp_path):
    folder = str(tmp_path / "index")
    assert I.status(spark, folder) == "missing"
    with pytest.raises(I.IndexNotFound):
        I.Index.open(spark, folder)
    first = docs(spark, (1, "alpha", "a.rs", "one two"), (2, "beta", "b.rs", "two three"), (3, "gamma", None, "three"))
    I.build(spark, folder, "h1", first, vectors(spark, [1, 2, 3]))
    assert I.status(spark, folder) == "ready"
    new = docs(spark, (12, "beta2", "b.rs", "two four"), (14, "delta", "d.rs", "one"))
    changes = spark.createDataFrame([("b.rs", "modified"), ("d.rs", "added"), ("a.rs", "deleted")], "path string, change string")
    steps = []
    meta = I.update(spark, folder, "h2", changes, new, vectors(spark, [12, 14]), steps.append)
    index = I.Index.open(spark, folder)
    assert meta.head == "h2" and meta.documents == 3 and steps[-1] == "done"
    assert {r.doc_id for r in index.docs.collect()} == {3, 12, 14} == {r.doc_id for r in index.vectors.collect()}
    assert len(meta.segments) == 2 and meta.kinds == {"file": 3}
    # An incremental build equals a full one over the live documents.
    rebuilt = str(tmp_path / "again")
    live = docs(spark, (3, "gamma", None, "three"), (12, "beta2", "b.rs", "two four"), (14, "delta", "d.rs", "one"))
    I.build(spark, rebuilt, "h2", live, vectors(spark, [3, 12, 14]))
    other = I.Index.open(spark, rebuilt)
    for name in ("docs", "postings", "stats"):
        columns = sorted(getattr(other, name).columns)
        a, b = (getattr(i, name).select(*columns) for i in (index, other))
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count(), name
    merged = I.compact(spark, folder)
    index = I.Index.open(spark, folder)
    assert len(merged.segments) == 1 and merged.kinds == meta.kinds
    for name in ("docs", "postings", "stats", "lengths"):
        columns = sorted(getattr(other, name).columns)
        a, b = (getattr(i, name).select(*columns) for i in (index, other))
        assert a.exceptAll(b).count() == 0 == b.exceptAll(a).count(), name
    assert set(I.vacuum(spark, folder, 0)) == set(meta.segments) and I.vacuum(spark, folder, 0) == []
    assert order(index.bm25([S.Query(1, "two")])) == [12]
    assert index.nearest(spark.createDataFrame([(1, [1.0] * 256)], "qid int, vec array<double>"), 2).count() == 2
    fixtures = spark.createDataFrame([(1, "two", "typo", [("b.rs", None, None)], []), (2, "one", "negative", [], [("d.rs", None)])], E.FIXTURE_TYPE)
    report = assemble(index, fixtures, index.bm25([S.Query(1, "two"), S.Query(2, "one")]), "h3", {"p50": 1.0}, folder)
    assert report.stale and report.overall["mrr"] == 1.0 and report.negatives["pass_rate"] == 0.0 and report.size > 0
    assert "| typo | 1 | 1.000" in to_markdown(report) and "out of date" in to_text(report)


def test_index_errors(spark, tmp_path):
    folder = str(tmp_path / "index")
    d = docs(spark, (1, "a", "a", "a"))
    with pytest.raises(I.DuplicateId):
        I.build(spark, folder, "h", d.union(d), vectors(spark, [1]))
    with pytest.raises(I.DuplicateId):
        I.build(spark, folder, "h", d, vectors(spark, [1, 1]))
    with pytest.raises(I.DimensionMismatch):
        I.build(spark, folder, "h", d, spark.createDataFrame([(1, [1.0])], "doc_id long, vec array<float>"))
    assert I.status(spark, folder) == "missing"  # a failed build leaves no pointer
    I.build(spark, folder, "h", d, vectors(spark, [1]))
    path = tmp_path / "index" / "meta.json"
    raw = json.loads(path.read_text())
    for change, error in (({"version": 99}, I.VersionMismatch), ({"tokenizer": "x"}, I.IncompatibleTokenizer)):
        for crc in (tmp_path / "index").glob(".meta.json*"):
            crc.unlink()
        path.write_text(json.dumps(raw | change))
        assert I.status(spark, folder) == "outdated"
        with pytest.raises(error):
            I.Index.open(spark, folder)


def test_build_decision():
    meta = I.Meta("old", ["s"])
    yes, no = (lambda a, b: True), (lambda a, b: False)

    def fails(a, b):
        raise RuntimeError

    assert I.decide(None, "new", False, yes) == "full" and I.decide(meta, "new", True, yes) == "full"
    assert I.decide(meta, "old", False, no) == "current" and I.decide(meta, "new", False, yes) == "incremental"
    assert I.decide(meta, "new", False, no) == "full" and I.decide(meta, "new", False, fails) == "full"
    assert I.decide(I.Meta("old", ["s"], version=0), "new", False, yes) == "full"


def test_config_and_fixtures(spark, tmp_path):
    path = tmp_path / "c.toml"
    assert Config.load(path) == Config()
    Config(ui={"mouse": True}, theme={"name": 'a"b'}).save(path)
    assert Config.load(path) == Config(ui={"mouse": True}, theme={"name": 'a"b'})
    good = tmp_path / "f.toml"
    good.write_text('[[queries]]\ntext = "q"\ncategory = "typo"\nexpected = [{path = "a", kind = "File"}]\n[[queries]]\ntext = "n"\ncategory = "negative"\nforbidden = [{path_prefix = "src/"}]\n')
    assert load_fixtures(spark, good).select(F.get("expected", F.lit(0))["kind"].alias("k")).where("k IS NOT NULL").collect()[0].k == "file"
    for bad in ("", '[[queries]]\ntext = "q"\n', '[[queries]]\ntext = "q"\ncategory = "typo"\n', '[[queries]]\ntext = "q"\ncategory = "negative"\nforbidden = [{path = "a", path_prefix = "b"}]\n'):
        good.write_text(bad)
        with pytest.raises(FixtureError):
            load_fixtures(spark, good)


def test_small_services():
    cache = LruCache(2)
    calls = []
    for key in "abacab":
        cache.get_or_compute(key, lambda k=key: calls.append(k) or k)
    assert calls == ["a", "b", "c", "b"] and len(cache) == 2
    assert restore_selection(["a", "b"], "b", 0) == 1 and restore_selection(["a", "b"], "x", 9) == 1 and restore_selection([], None, 3) == 0
