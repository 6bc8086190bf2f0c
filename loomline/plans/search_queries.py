"""Queries over retrieval and its evaluation, on search documents and their vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import evaluate as E
from loomline.operators import grammar
from loomline.operators import history as H
from loomline.operators import search as S
from loomline.plans.base import COMMITS_SQL, DOCS_SQL, VECTORS_SQL, commits, documents, vectors
from loomline.session import parameters

LIMIT, FIELDS = 10, ["path_terms", "title", "body"]

#: The query set of the retrieval queries.
BATCH = [
    S.Query(1, "reload index"),
    S.Query(2, "merge the stale cache before the commit"),
    S.Query(3, "검색 인덱스"),
    S.Query(4, 'scroll viewport path:"src/find/walk.rs"'),
    S.Query(5, "+filter -index token"),
    S.Query(6, 'path:"src/panel.rs"'),
    S.Query(7, "title:snapshot^3 vector"),
    S.Query(8, "parser AND tree"),
    S.Query(9, "IndexCache reload_walker"),
    S.Query(10, "색인"),
]

#: One query for each form of the query language.
GRAMMAR = [
    S.Query(1, "title:parser AND (title:tree OR title:node)"),
    S.Query(2, "title:cache -(title:stale title:merge)"),
    S.Query(3, 'title:"open file"~2 title:"merge cache"'),
    S.Query(4, "+title:[cache TO index} path:>=src/p"),
    S.Query(5, "title: IN [viewport snapshot]"),
    S.Query(6, "title:vec* path:{src/a TO src/c}"),
    S.Query(7, "path_terms:(find walk)^2 AND NOT title:scroll"),
    S.Query(8, "title:a AND (title:b OR (title:cache AND -title:index))"),
    S.Query(9, "* -title:index"),
    S.Query(10, "-(title:a title:b)"),
    S.Query(11, "title:(cache"),
    S.Query(12, 'title:"reload in"*'),
]

#: Judged queries: (qid, text, category, expected hits, forbidden rules).
FIXTURES = [
    (1, "walk find", "exact_identifier", [("src/find/walk.rs", None, None)], []),
    (2, "scroll the panel", "natural_language", [("src/panel.rs", "File", None), ("src/find/walk.rs", None, None)], []),
    (3, "검색 walk", "korean", [("src/find/walk.rs", "symbol", None)], []),
    (4, "mrge walker", "typo", [("src/vcs/walker/merge.rs", None, None)], []),
    (5, "merging of walkers", "paraphrase", [("src/vcs/walker/merge.rs", "Symbol", None), ("src/vcs/walker/merge.rs", "file", None)], []),
    (6, "lens query bench", "negative", [], [(None, "src/"), ("docs/pager_manifest.ts", None)]),
    (7, "zxcvb", "negative", [], [(None, "src/")]),
]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return documents(spark, sf_dir, "kind", "title", "body", "path", "path_terms")


def _vectors(spark: SparkSession, sf_dir: str, docs: DataFrame) -> DataFrame:
    """Valid vectors of documents that exist."""
    return vectors(spark, sf_dir).join(docs.select("doc_id"), "doc_id", "left_semi")


def _text_queries() -> list[S.Query]:
    return [S.Query(q, text) for q, text, *_ in FIXTURES]


def bm25_search(spark, sf_dir):
    return S.bm25(spark, _docs(spark, sf_dir), BATCH, LIMIT)


def bm25_path_title(spark, sf_dir):
    return S.bm25(spark, documents(spark, sf_dir, "title", "path", "path_terms"), BATCH, LIMIT, grammar.PATH_TITLE_WEIGHTS)


def bm25_grammar(spark, sf_dir):
    """All forms of the query language, over all documents."""
    return S.bm25(spark, _docs(spark, sf_dir), GRAMMAR, LIMIT)


def query_parse(spark, sf_dir):
    """The clauses that those queries are read as: one row for each group of terms or pattern of a query."""
    rows = []
    for q in GRAMMAR:
        parsed = grammar.parse(q.text)
        if parsed is None:
            rows.append((q.qid, None, None, "refused", None))
            continue
        occur = {n.number: n for n in parsed.nodes}

        def way(number: int, occur=occur) -> str:
            return "" if number < 0 else f"{way(occur[number].parent)}/{occur[number].occur}"

        rows += [(q.qid, g.field, " ".join(g.terms), way(g.number), g.weight) for g in parsed.groups]
        rows += [(q.qid, p.field, p.prefix or "|".join(p.values or ()) or f"{p.low or ''}..{p.high or ''}", way(p.number), p.weight) for p in parsed.patterns]
    return parameters(spark, rows, "qid int, field string, terms string, way string, weight double")


def term_stats(spark, sf_dir):
    """Document frequency and number of each term of each field, and the fields' mean length."""
    docs = documents(spark, sf_dir, *FIELDS)
    counts = S.postings(S.analysed(docs, FIELDS)).groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("n"))
    return counts.join(F.broadcast(S.field_stats(S.lengths(docs, FIELDS)).select("field", F.round("avgdl", 6).alias("avgdl"))), "field")


def _query_vectors(spark, sf_dir) -> DataFrame:
    """Stated query vectors: those of the documents whose id is divisible by 20, by this id."""
    return vectors(spark, sf_dir).where("doc_id % 20 = 0").select(F.col("doc_id").alias("qid"), "vec")


def vector_topk(spark, sf_dir):
    """The vectors nearest to each query vector."""
    found = S.vector_topk(vectors(spark, sf_dir), _query_vectors(spark, sf_dir), LIMIT)
    return found.select("qid", "rank", "doc_id", F.round("score", 6).alias("score"))


def _lists(spark, sf_dir, limit: int = 20) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    near = _vectors(spark, sf_dir, docs)
    return S.bm25(spark, docs, BATCH, limit), S.vector_topk(near, S.encode_queries(docs, near, BATCH), limit)


def rrf_fuse(spark, sf_dir):
    words, near = _lists(spark, sf_dir)
    return S.rrf([(words, 1.0), (near, 1.0)], LIMIT)


def rrf_weighted(spark, sf_dir):
    words, near = _lists(spark, sf_dir)
    return S.rrf([(words, 1.0), (near, 1.5)], LIMIT)


def rrf_anchor(spark, sf_dir):
    words, near = _lists(spark, sf_dir)
    return S.rrf_anchor(words, near, LIMIT, 1.0, 1.5, 3)


def diagnose(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    near = _vectors(spark, sf_dir, docs)
    words = S.bm25(spark, docs, BATCH, LIMIT)
    return S.diagnose(spark, words, S.vector_topk(near, S.encode_queries(docs, near, BATCH, whole=True), LIMIT), BATCH, LIMIT)


def query_tokens(spark, sf_dir):
    """The tokens that a query gives in the body, as a diagnosis lists them."""
    texts = parameters(spark, [(q.qid, q.text) for q in BATCH], "qid int, text string")
    return texts.select("qid", F.posexplode(T.bigrams(F.col("text"))).alias("pos", "token"))


def _hybrid(spark, sf_dir, queries: list[S.Query]) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    near = _vectors(spark, sf_dir, docs)
    return docs, S.hybrid(spark, docs, near, queries, S.encode_queries(docs, near, queries), LIMIT)


def hybrid_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, BATCH)[1]


def search_hydrate(spark, sf_dir):
    docs, hits = _hybrid(spark, sf_dir, BATCH)
    return S.hydrate(hits, docs).select("qid", "rank", "doc_id", "kind", "title", "path")


def result_navigation(spark, sf_dir):
    """Where selecting each hit of the hybrid search leads."""
    hits = _hybrid(spark, sf_dir, BATCH)[1]
    docs = documents(spark, sf_dir, "kind", "commit_oid", "path", "line_start")
    return H.navigation(hits, docs, commits(spark, sf_dir, "parents"))


def path_filtered_search(spark, sf_dir):
    return _hybrid(spark, sf_dir, [q for q in BATCH if q.path])[1]


def path_filter_parse(spark, sf_dir):
    rows = [(q.qid, *grammar.extract_path_filter(q.text)) for q in BATCH]
    return parameters(spark, rows, "qid int, path string, rest string")


def _fixtures(spark) -> DataFrame:
    return parameters(spark, FIXTURES, E.FIXTURE_TYPE)


def _judged(spark, sf_dir) -> DataFrame:
    docs, hits = _hybrid(spark, sf_dir, _text_queries())
    return S.hydrate(hits, docs).select("qid", "rank", "kind", "path", "title")


def eval_per_query(spark, sf_dir):
    return E.per_query(_fixtures(spark), _judged(spark, sf_dir))


def eval_hit_paths(spark, sf_dir):
    return E.hit_paths(_fixtures(spark), _judged(spark, sf_dir))


def eval_overall(spark, sf_dir):
    return E.overall(eval_per_query(spark, sf_dir))


def eval_by_category(spark, sf_dir):
    return E.by_category(eval_per_query(spark, sf_dir))


def negative_violations(spark, sf_dir):
    return E.violations(_fixtures(spark), _judged(spark, sf_dir))


def eval_negatives(spark, sf_dir):
    return E.negatives(_fixtures(spark), _judged(spark, sf_dir))


def fixture_violations(spark, sf_dir):
    bad = [*FIXTURES, (8, "x", "negative", [("a", None, None)], []), (9, "y", "typo", [], [("a", None)]), (10, "z", "negative", [], [("a", "b")]), (11, "w", "other", [("a", None, None)], [])]
    return E.fixture_violations(parameters(spark, bad, E.FIXTURE_TYPE))


QUERIES = {
    "bm25_search": bm25_search, "bm25_path_title": bm25_path_title, "bm25_grammar": bm25_grammar, "query_parse": query_parse, "term_stats": term_stats, "vector_topk": vector_topk,
    "rrf_fuse": rrf_fuse, "rrf_weighted": rrf_weighted, "rrf_anchor": rrf_anchor, "diagnose": diagnose, "hybrid_search": hybrid_search,
    "search_hydrate": search_hydrate, "result_navigation": result_navigation, "path_filtered_search": path_filtered_search, "path_filter_parse": path_filter_parse,
    "eval_per_query": eval_per_query, "eval_hit_paths": eval_hit_paths, "query_tokens": query_tokens, "eval_overall": eval_overall, "eval_by_category": eval_by_category,
    "negative_violations": negative_violations, "eval_negatives": eval_negatives, "fixture_violations": fixture_violations,
}


def _quote(v) -> str:
    return "NULL" if v is None else "'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v).lower() if isinstance(v, bool) else str(v)


def _values(rows: list[tuple], name: str, columns: str) -> str:
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in rows) + ")"


_CAMEL = r"regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g')"
_WORDS = r"regexp_extract_all(lower({0}), '[\p{{L}}\p{{N}}]+')"
_FIELD_SQL = {
    "title": _WORDS.format(_CAMEL.format("title")),
    "path_terms": _WORDS.format(_CAMEL.format(r"translate(path_terms, '/.-_\', '     ')")),
    "body": "CASE WHEN length(body) >= 2 THEN list_transform(range(1, length(body)), lambda i: lower(substring(body, i, 2))) WHEN body IS NOT NULL THEN [] END",
    "path": "CASE WHEN path IS NOT NULL THEN [path] END",
}


def _pattern_sql(pattern: grammar.Pattern) -> str:
    """The condition on a term ``t``."""
    out = ["true"]
    if pattern.low is not None:
        out.append(f"t {'>=' if pattern.low_in else '>'} {_quote(pattern.low)}")
    if pattern.high is not None:
        out.append(f"t {'<=' if pattern.high_in else '<'} {_quote(pattern.high)}")
    if pattern.prefix is not None:
        out.append(f"starts_with(t, {_quote(pattern.prefix)})")
    if pattern.values is not None:
        out.append("t IN (" + ", ".join(map(_quote, pattern.values)) + ")")
    return " AND ".join(out)


def bm25_sql(queries: list[S.Query], weights=None) -> str:
    """CTEs up to ``words``(qid, rank, doc_id, score), all ranks. A phrase is a pattern over the terms of the title."""
    a = S.asked(queries, weights)
    rows = []
    for q in queries:
        for i, g in enumerate((grammar.parse(q.text, weights) or grammar.Parsed()).groups):
            gap = rf" (\S+ ){{0,{g.slop}}}" if g.slop else " "
            rows += [(q.qid, i, g.number, g.field, t, len(g.terms), g.weight, f" {gap.join(g.phrase)} " if g.phrase else None) for t in g.terms]
    analysed = " UNION ALL ".join(f"SELECT doc_id, '{f}' AS field, {_FIELD_SQL[f]} AS terms FROM docs" for f in sorted({*a.fields, "title"}))
    leaves = ["SELECT qid, doc_id, number, s FROM grp"]
    for qid, p in a.patterns:
        where = "true" if p.field == "*" else f"field = '{p.field}' AND len(list_filter(terms, lambda t: {_pattern_sql(p)})) > 0"
        leaves.append(f"SELECT DISTINCT {qid}, doc_id, {p.number}, {p.weight}::DOUBLE FROM analysed WHERE {where}" if p.field != "*" else f"SELECT {qid}, doc_id, {p.number}, {p.weight}::DOUBLE FROM docs")
    deepest = max(n[4] for n in a.nodes)
    levels = ""
    for depth in range(deepest, 0, -1):
        inner = f" UNION ALL SELECT * FROM level{depth + 1}" if depth < deepest else ""
        levels += f""",
level{depth} AS (SELECT m.qid, doc_id, n.parent AS number, sum(CASE WHEN n.occur <> 'not' THEN s ELSE 0 END) AS s
      FROM (SELECT qid, doc_id, number, sum(s) AS s FROM (SELECT * FROM leaves WHERE (qid, number) IN (SELECT (qid, number) FROM node WHERE depth = {depth}){inner}) GROUP BY ALL) m
      JOIN node n ON n.qid = m.qid AND n.number = m.number JOIN node p ON p.qid = m.qid AND p.number = n.parent GROUP BY m.qid, doc_id, n.parent
      HAVING count(*) FILTER (n.occur = 'not') = 0 AND count(*) FILTER (n.occur <> 'not') > 0 AND count(*) FILTER (n.occur = 'must') = max(p.musts))"""
    return f"""{_values(rows, "q", "qid, grp, number, field, term, need, weight, phrase")}, {_values(a.nodes, "node", "qid, number, parent, occur, depth, musts")},
analysed AS (SELECT * FROM ({analysed}) WHERE terms IS NOT NULL),
titles AS (SELECT doc_id, ' ' || array_to_string(terms, ' ') || ' ' AS title FROM analysed WHERE field = 'title'),
stats AS (SELECT field, count(*) AS n, avg(len(terms)) AS avgdl FROM analysed GROUP BY field),
posts AS (SELECT field, term, doc_id, count(*) AS tf, max(dl) AS dl FROM (SELECT field, doc_id, len(terms) AS dl, unnest(terms) AS term FROM analysed)
          WHERE (field, term) IN (SELECT (field, term) FROM q) GROUP BY ALL),
dfs AS (SELECT field, term, count(*) AS df FROM posts GROUP BY ALL),
scored AS (SELECT p.field, p.term, doc_id, ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * dl / avgdl)) AS s
           FROM posts p JOIN dfs USING (field, term) JOIN stats USING (field)),
grp AS (SELECT qid, doc_id, number, grp, sum(s * weight::DOUBLE) AS s FROM scored s JOIN q ON s.field = q.field AND s.term = q.term LEFT JOIN titles USING (doc_id)
        GROUP BY qid, doc_id, number, grp HAVING count(*) = max(need) AND (max(phrase) IS NULL OR regexp_matches(max(titles.title), max(phrase)))),
leaves AS ({" UNION ALL ".join(leaves)}){levels},
hits AS (SELECT qid, doc_id, round(s, 9) AS score FROM level1),
words AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM hits)"""


def _near_sql(queries: list[S.Query], whole: bool = False) -> str:
    """CTEs up to ``near``(qid, rank, doc_id, score), all ranks, for the words of the queries."""
    words = sorted({(q.qid, w) for q in queries for w in grammar.word_terms(q.text if whole else q.embed_text)})
    return f"""{_values(words, "asked", "qid, word")},
live AS (SELECT * FROM vectors WHERE doc_id IN (SELECT doc_id FROM docs)),
has AS (SELECT doc_id, unnest(list_distinct({_FIELD_SQL["title"]})) AS word FROM docs),
wide AS (SELECT word, unnest(vec) AS x, unnest(range(256)) AS i FROM has JOIN live USING (doc_id) WHERE word IN (SELECT word FROM asked)),
tok AS (SELECT word, i, avg(x) AS x FROM wide GROUP BY ALL),
qmean AS (SELECT qid, i, avg(x) AS x FROM tok JOIN asked USING (word) GROUP BY ALL),
qv AS (SELECT qid, list(x ORDER BY i) AS vec FROM qmean GROUP BY qid),
near AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score
         FROM (SELECT qid, doc_id, round(list_dot_product(q.vec, v.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(v.vec, v.vec)), 9) AS score FROM qv q, live v))"""


_BASE = f"WITH {DOCS_SQL}, {VECTORS_SQL}, "


def _both(queries: list[S.Query]) -> str:
    return _BASE + bm25_sql(queries) + ", " + _near_sql(queries)


_LISTS = _both(BATCH) + ", a AS (SELECT * FROM words WHERE rank <= 20), b AS (SELECT * FROM near WHERE rank <= 20)"


def _rrf_sql(w: float) -> str:
    return f""", fused AS (SELECT qid, doc_id, round(sum(s), 9) AS score FROM (SELECT qid, doc_id, 1.0::DOUBLE / (60 + rank) AS s FROM a UNION ALL SELECT qid, doc_id, {w}::DOUBLE / (60 + rank) FROM b) GROUP BY ALL),
rrf AS (SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank, doc_id, score FROM fused)"""


def _hybrid_sql(queries: list[S.Query]) -> str:
    facts = [(q.qid, S.candidate_limit(q, LIMIT), q.path, grammar.has_hangul(q.embed_text), q.embed_text != "") for q in queries]
    return f"""{_both(queries)}, {_values(facts, "facts", "qid, wanted, filter, korean, semantic")},
u AS (SELECT w.qid, doc_id, 1.0::DOUBLE / (60 + rank) AS s, CASE WHEN NOT semantic OR (korean AND rank <= 3) THEN rank END AS pin, score FROM words w JOIN facts USING (qid) WHERE rank <= wanted
      UNION ALL SELECT n.qid, doc_id, CASE WHEN korean THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank), NULL, NULL FROM near n JOIN facts USING (qid) WHERE rank <= wanted AND semantic),
f AS (SELECT qid, doc_id, round(sum(s), 9) AS s, min(pin) AS pin, max(score) AS score FROM u GROUP BY ALL),
l AS (SELECT qid, doc_id, CASE WHEN pin IS NOT NULL THEN score ELSE s END AS score, row_number() OVER (PARTITION BY qid ORDER BY pin IS NULL, pin, s DESC, doc_id) AS place FROM f),
m AS (SELECT l.qid, l.doc_id, l.score, row_number() OVER (PARTITION BY l.qid ORDER BY place) AS rank FROM l JOIN facts USING (qid) JOIN docs d ON l.doc_id = d.doc_id
      WHERE place <= wanted AND (filter IS NULL OR d.path = filter)),
hybrid AS (SELECT qid, rank, doc_id, score FROM m WHERE rank <= {LIMIT})"""


def _eval_sql() -> str:
    exp = [(q, c, p, k, t) for q, _, c, e, _ in FIXTURES for p, k, t in e]
    neg = [(q, p, x) for q, _, c, _, f in FIXTURES if c == "negative" for p, x in f]
    judged = [(q, c, len(e)) for q, _, c, e, _ in FIXTURES]
    return f"""{_hybrid_sql(_text_queries())}, {_values(exp, "expected", "qid, category, path, kind, title")}, {_values(neg, "rules", "qid, path, path_prefix")}, {_values(judged, "judged", "qid, category, n")},
res AS (SELECT h.qid, h.rank, d.kind, d.path, d.title FROM hybrid h JOIN docs d USING (doc_id)),
rel AS (SELECT DISTINCT r.qid, r.rank, r.path FROM res r JOIN expected e ON r.qid = e.qid AND r.path = e.path
        WHERE (e.kind IS NULL OR lower(e.kind) = r.kind) AND (e.title IS NULL OR e.title = string_split(r.title, ' (')[1])),
agg AS (SELECT qid, min(rank) AS first_rank, count(*) FILTER (rank <= 5) AS h5, count(*) AS h10, sum(1 / log2(rank + 1)) AS dcg, count(DISTINCT path) AS hit_paths FROM rel GROUP BY qid),
per AS (SELECT j.qid, j.category, round(coalesce(1.0::DOUBLE / first_rank, 0), 6) AS mrr, round(least(coalesce(h5, 0), n)::DOUBLE / greatest(n, 1), 6) AS recall_5,
               round(least(coalesce(h10, 0), n)::DOUBLE / greatest(n, 1), 6) AS recall_10,
               round(coalesce(dcg, 0) / list_sum(list_transform(range(1, least(n, 10) + 1), lambda r: 1 / log2(r + 1))), 6) AS ndcg_10, first_rank, coalesce(hit_paths, 0) AS hit_paths
        FROM judged j LEFT JOIN agg USING (qid) WHERE j.category <> 'negative'),
viol AS (SELECT r.qid, r.rank, r.path, CASE WHEN f.path IS NOT NULL THEN 'path=' || f.path ELSE 'path_prefix=' || f.path_prefix END AS rule
         FROM res r JOIN rules f ON r.qid = f.qid WHERE r.path IS NOT NULL AND (r.path = f.path OR (f.path IS NULL AND starts_with(r.path, f.path_prefix))))"""


#: How the queries of ``GRAMMAR`` are to be read, written by hand.
READ = [
    (1, "title", "parser", "/must", 2.0), (1, "title", "tree", "/must/should", 2.0), (1, "title", "node", "/must/should", 2.0),
    (2, "title", "cache", "/should", 2.0), (2, "title", "stale", "/not/should", 2.0), (2, "title", "merge", "/not/should", 2.0),
    (3, "title", "open file", "/should", 2.0), (3, "title", "merge cache", "/should", 2.0),
    (4, "title", "cache..index", "/must", 2.0), (4, "path", "src/p..", "/should", 1.0),
    (5, "title", "viewport|snapshot", "/should", 2.0),
    (6, "title", "vec", "/should", 2.0), (6, "path", "src/a..src/c", "/should", 1.0),
    (7, "path_terms", "find", "/must/should", 4.0), (7, "path_terms", "walk", "/must/should", 4.0), (7, "title", "scroll", "/not", 2.0),
    (8, "title", "a", "/must", 2.0), (8, "title", "b", "/must/should", 2.0), (8, "title", "cache", "/must/should/must", 2.0), (8, "title", "index", "/must/should/not", 2.0),
    (9, "*", "..", "/should", 1.0), (9, "title", "index", "/not", 2.0),
    (10, None, None, "refused", None), (11, None, None, "refused", None),
    (12, "title", "reload", "/should/should/must", 2.0), (12, "title", "in", "/should/should/must", 2.0),
]

_EVAL = _eval_sql()
_AVG = ", ".join(f"round(coalesce(avg({m}), 0), 6) AS {m}" for m in E.METRICS)

ORACLES = {
    "bm25_search": f"WITH {DOCS_SQL}, {bm25_sql(BATCH)} SELECT * FROM words WHERE rank <= {LIMIT}",
    "bm25_path_title": f"WITH {DOCS_SQL}, {bm25_sql(BATCH, grammar.PATH_TITLE_WEIGHTS)} SELECT * FROM words WHERE rank <= {LIMIT}",
    "bm25_grammar": f"WITH {DOCS_SQL}, {bm25_sql(GRAMMAR)} SELECT * FROM words WHERE rank <= {LIMIT}",
    "query_parse": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_quote, r)) + ")" for r in READ) + ") AS v(qid, field, terms, way, weight)",
    "term_stats": f"""WITH {DOCS_SQL}, a AS (SELECT doc_id, 'title' AS field, {_FIELD_SQL["title"]} AS terms FROM docs UNION ALL SELECT doc_id, 'path_terms', {_FIELD_SQL["path_terms"]} FROM docs UNION ALL SELECT doc_id, 'body', {_FIELD_SQL["body"]} FROM docs WHERE body IS NOT NULL),
        s AS (SELECT field, round(avg(len(terms)), 6) AS avgdl FROM a WHERE terms IS NOT NULL GROUP BY field),
        t AS (SELECT field, doc_id, unnest(terms) AS term FROM a) SELECT field, term, count(DISTINCT doc_id) AS df, count(*) AS n, avgdl FROM t JOIN s USING (field) GROUP BY ALL""",
    "vector_topk": f"""WITH {VECTORS_SQL}, asked AS (SELECT doc_id::INT AS qid, vec FROM vectors WHERE doc_id % 20 = 0),
        s AS (SELECT qid, doc_id, round(list_dot_product(q.vec, v.vec) / sqrt(list_dot_product(q.vec, q.vec) * list_dot_product(v.vec, v.vec)), 9) AS score FROM asked q, vectors v)
        SELECT qid, rank, doc_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= {LIMIT}""",
    "rrf_fuse": _LISTS + _rrf_sql(1.0) + f" SELECT * FROM rrf WHERE rank <= {LIMIT}",
    "rrf_weighted": _LISTS + _rrf_sql(1.5) + f" SELECT * FROM rrf WHERE rank <= {LIMIT}",
    "rrf_anchor": _LISTS + _rrf_sql(1.5) + f""", p AS (SELECT qid, doc_id, 0 AS part, rank AS place, score FROM a WHERE rank <= 3 UNION ALL SELECT qid, doc_id, 1, rank, score FROM rrf WHERE rank <= {LIMIT} + 3),
        o AS (SELECT qid, doc_id, min((part, place, score)) AS b FROM p GROUP BY ALL)
        SELECT qid, rank, doc_id, score FROM (SELECT qid, doc_id, b[3] AS score, row_number() OVER (PARTITION BY qid ORDER BY b) AS rank FROM o) WHERE rank <= {LIMIT}""",
    "diagnose": f"""{_BASE}{bm25_sql(BATCH)}, {_near_sql(BATCH, whole=True)}, {_values([(q.qid, grammar.has_hangul(q.text)) for q in BATCH], "facts", "qid, korean")},
        u AS (SELECT w.qid, doc_id, 1.0::DOUBLE / (60 + rank) AS s, CASE WHEN korean AND rank <= 3 THEN rank END AS pin, score, rank AS a, NULL AS b FROM words w JOIN facts USING (qid) WHERE rank <= {LIMIT}
              UNION ALL SELECT n.qid, doc_id, CASE WHEN korean THEN 1.5::DOUBLE ELSE 1.0::DOUBLE END / (60 + rank), NULL, NULL, NULL, rank FROM near n JOIN facts USING (qid) WHERE rank <= {LIMIT}),
        f AS (SELECT qid, doc_id, round(sum(s), 9) AS s, max(pin) AS pin, max(score) AS score, max(a) AS a, max(b) AS b FROM u GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY pin IS NULL, pin, s DESC, doc_id) AS rank FROM f)
        SELECT qid, rank, doc_id, CASE WHEN pin IS NOT NULL THEN score ELSE s END AS score, a AS bm25_rank, b AS vector_rank FROM r WHERE rank <= {LIMIT}""",
    "query_tokens": f"WITH {_values([(q.qid, q.text) for q in BATCH], 'q', 'qid, t')} SELECT qid, unnest(range(length(t) - 1))::INT AS pos, unnest(list_transform(range(1, length(t)), lambda i: lower(substring(t, i, 2)))) AS token FROM q",
    "eval_hit_paths": _EVAL + " SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY r, path) AS position, path FROM (SELECT qid, path, min(rank) AS r FROM rel GROUP BY ALL)",
    "hybrid_search": _hybrid_sql(BATCH) + " SELECT * FROM hybrid",
    "search_hydrate": _hybrid_sql(BATCH) + " SELECT qid, rank, h.doc_id, kind, title, path FROM hybrid h JOIN docs d ON h.doc_id = d.doc_id",
    "result_navigation": _hybrid_sql(BATCH).replace("WITH ", f"WITH {COMMITS_SQL}, ", 1) + """, fp AS (SELECT c.oid, p.oid AS parent FROM commit_log c LEFT JOIN commit_log p ON c.parents[1] = p.oid)
        SELECT qid, rank, CASE WHEN kind = 'commit' AND parent IS NOT NULL THEN 'diff' ELSE 'view' END AS target, d.commit_oid AS oid, CASE WHEN kind = 'commit' THEN parent END AS parent,
               CASE WHEN kind <> 'commit' THEN path END AS path, CASE WHEN kind <> 'commit' THEN coalesce(line_start, 1) END AS line
        FROM hybrid h JOIN docs d ON h.doc_id = d.doc_id LEFT JOIN fp ON fp.oid = d.commit_oid""",
    "path_filtered_search": _hybrid_sql([q for q in BATCH if q.path]) + " SELECT * FROM hybrid",
    "path_filter_parse": f"""WITH {_values([(q.qid, q.text) for q in BATCH], "q", "qid, t")}
        SELECT qid, CASE WHEN regexp_matches(t, 'path:"[^"]*"') THEN regexp_extract(t, 'path:"([^"]*)"', 1) END AS path, trim(regexp_replace(t, '\\s*path:"[^"]*"\\s*', ' ')) AS rest FROM q""",
    "eval_per_query": _EVAL + " SELECT * FROM per",
    "eval_overall": _EVAL + f" SELECT {_AVG}, count(*) AS n FROM per",
    "eval_by_category": _EVAL + f", {_values(list(enumerate(E.CATEGORIES)), 'cats', 'position, category')} SELECT position, c.category, {_AVG}, count(per.qid) AS n FROM cats c LEFT JOIN per ON c.category = per.category GROUP BY ALL",
    "negative_violations": _EVAL + " SELECT * FROM viol",
    "eval_negatives": _EVAL + " SELECT count(*) AS n, coalesce(avg(CASE WHEN v.qid IS NULL THEN 1.0::DOUBLE ELSE 0 END), 0) AS pass_rate FROM judged j LEFT JOIN (SELECT DISTINCT qid FROM viol) v USING (qid) WHERE category = 'negative'",
    "fixture_violations": "SELECT * FROM (VALUES (8, 'negative with expected hits'), (8, 'negative without forbidden rules'), (9, 'no expected hits'), (9, 'forbidden rules'), (10, 'rule with not exactly one of path and path_prefix'), (11, 'unknown category')) AS v(qid, problem)",
}
