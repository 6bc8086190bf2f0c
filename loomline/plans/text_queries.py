"""Queries over text scalars, analyzers and the cutting of files into documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators.corpus import chunk_meta, commit_chunks, file_chunks, indexable, whole_documents
from loomline.operators.search import encode_texts, mean_vectors, token_vectors
from loomline.plans.base import COMMITS_SQL, DOCS_SQL, HEAD_SQL, VECTORS_SQL, commits, documents, head_tree, vectors
from loomline.session import table


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "tree_snapshots").select("path").distinct()


def camel_split(spark, sf_dir):
    return documents(spark, sf_dir, "title").where("title IS NOT NULL").select("doc_id", T.split_camel_case(F.col("title")).alias("split"))


def path_terms(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", T.path_to_terms(F.col("path")).alias("terms"))


def path_depth(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", T.path_depth(F.col("path")).alias("depth"))


def detect_language(spark, sf_dir):
    lang = T.language(F.col("path"))
    return _paths(spark, sf_dir).select("path", lang.alias("language"), T.has_symbols(lang).alias("symbols"))


def alias_expand(spark, sf_dir):
    return _paths(spark, sf_dir).select("path", T.korean_aliases(F.col("path")).alias("aliases"))


def word_tokens(spark, sf_dir):
    """Word counts of the titles' camel-split form."""
    tokens = documents(spark, sf_dir, "title").select("doc_id", F.explode(T.words(T.split_camel_case(F.col("title")))).alias("term"))
    return tokens.groupBy("doc_id", "term").agg(F.count("*").alias("tf"))


def bigrams(spark, sf_dir):
    grams = documents(spark, sf_dir, "body").select(F.explode(T.bigrams(F.col("body"))).alias("gram"))
    return grams.groupBy("gram").agg(F.count("*").alias("n"))


def detect_hangul(spark, sf_dir):
    return commits(spark, sf_dir, "message").select("oid", F.coalesce(T.has_hangul(F.col("message")), F.lit(False)).alias("korean"))


def split_message(spark, sf_dir):
    m = F.col("message")
    return commits(spark, sf_dir, "message").where("message IS NOT NULL").select("oid", T.message_title(m).alias("title"), T.message_body(m).alias("body"))


def split_subject(spark, sf_dir):
    subject, rest = T.display_split(F.col("message"))
    return commits(spark, sf_dir, "message").where("message IS NOT NULL").select("oid", subject.alias("subject"), rest.alias("rest"))


def commit_line(spark, sf_dir):
    return commits(spark, sf_dir, "short_id", "ts", "message").select("oid", T.commit_line(F.col("short_id"), F.col("ts"), F.col("message")).alias("line"))


def expand_tabs(spark, sf_dir):
    return table(spark, sf_dir, "source_files").where("content IS NOT NULL").select("file_id", F.md5(T.expand_tabs(F.col("content"))).alias("digest"))


def line_count(spark, sf_dir):
    return table(spark, sf_dir, "source_files").where("content IS NOT NULL").select("file_id", T.line_count(F.col("content")).cast("long").alias("lines"))


def binary_files(spark, sf_dir):
    files = table(spark, sf_dir, "source_files").where("content IS NOT NULL")
    return files.select("file_id", T.is_binary(F.encode("content", "UTF-8")).alias("is_binary"))


def doc_label(spark, sf_dir):
    docs = documents(spark, sf_dir)
    return docs.select("doc_id", T.doc_label(*(F.col(c) for c in ("kind", "path", "commit_oid", "line_start", "line_end", "title"))).alias("label"))


def l2_normalize(spark, sf_dir):
    """Normalised stored vectors, as their first component and their length."""
    unit = vectors(spark, sf_dir).select("doc_id", T.l2_normalize(F.col("vec")).alias("u"))
    return unit.select("doc_id", F.round(F.col("u")[0], 6).alias("first"), F.round(T.dot(F.col("u"), F.col("u")), 6).alias("length"))


def mean_pool(spark, sf_dir):
    """Mean vector of the documents of each path, the pooling of an encoder that averages token vectors."""
    docs = documents(spark, sf_dir, "path").where("path IS NOT NULL").join(vectors(spark, sf_dir), "doc_id")
    return mean_vectors(docs, "path").select("path", F.posexplode("vec").alias("i", "x")).select("path", F.col("i").cast("long").alias("i"), F.round("x", 6).alias("mean"))


def indexable_files(spark, sf_dir):
    files = indexable(table(spark, sf_dir, "source_files"))
    return files.select("file_id", F.octet_length("content").alias("bytes"))


def chunk_routing(spark, sf_dir):
    """How each indexable file is cut: as a whole, or by symbols if it is large and its language has a grammar."""
    files = indexable(table(spark, sf_dir, "source_files"))
    large = F.octet_length("content") >= T.WHOLE_FILE_BYTES
    return files.select("file_id", F.when(large & T.has_symbols(T.language(F.col("path"))), "symbols").otherwise("whole").alias("route"))


def commit_chunk_rows(spark, sf_dir):
    return commit_chunks(commits(spark, sf_dir)).select("commit_oid", "title", "body", "author_time", "embed_text")


def embed_text(spark, sf_dir):
    chunks = file_chunks(table(spark, sf_dir, "source_files"))
    return chunks.select("commit_oid", "path", "chunk_kind", F.coalesce("line_start", F.lit(0)).alias("line_start"), "symbol_name", F.md5("embed_text").alias("digest"))


def whole_file_texts(spark, sf_dir):
    """What is embedded of the files that go in whole by size or language: path and beginning."""
    files = indexable(table(spark, sf_dir, "source_files"))
    whole = files.where((F.octet_length("content") < T.WHOLE_FILE_BYTES) | ~T.has_symbols(T.language(F.col("path"))))
    return whole_documents(whole).select("commit_oid", "path", F.md5("embed_text").alias("digest"))


def embed_commits(spark, sf_dir):
    """Vectors of all commit messages, from the vectors of their words; of each its two first components and length."""
    chunks = commit_chunks(commits(spark, sf_dir, "message", "ts"))
    docs = documents(spark, sf_dir, "title")
    vec = encode_texts(chunks, token_vectors(docs, vectors(spark, sf_dir)), "commit_oid")
    return vec.select("commit_oid", F.round(F.col("vec")[0], 5).alias("first"), F.round(F.col("vec")[1], 5).alias("second"), F.round(T.dot(F.col("vec"), F.col("vec")), 6).alias("length"))


def symbol_checks(spark, sf_dir):
    """Of every file with symbols: whether they lie on their lines, in order, beside one another, and each holds its name."""
    from loomline.operators.corpus import symbols

    files = indexable(table(spark, sf_dir, "source_files"))
    found = symbols(files, ["file_id", "content"])
    raw = F.encode("content", "UTF-8")
    feeds = lambda end: F.length(F.regexp_replace(F.decode(F.substr(raw, F.lit(1), end), "UTF-8"), "[^\n]", ""))
    lines = (feeds(F.col("byte_start").cast("int")) + 1 == F.col("line_start")) & (feeds(F.col("byte_end").cast("int") - 1) + 1 == F.col("line_end"))
    whole = F.decode(F.substr(raw, F.col("byte_start").cast("int") + 1, (F.col("byte_end") - F.col("byte_start")).cast("int")), "UTF-8") == F.col("text")
    before = F.lag("byte_end", 1, 0).over(Window.partitionBy("file_id").orderBy("byte_start"))
    checked = found.select("file_id", (lines & whole & F.contains("text", F.col("name"))).alias("right"), (F.col("byte_start") >= before).alias("apart"))
    return checked.groupBy("file_id").agg(F.every("right").alias("right"), F.every("apart").alias("apart")).where("NOT (right AND apart)")


def extract_symbols(spark, sf_dir):
    """Symbols found in every file of a language with symbols."""
    from loomline.operators.corpus import symbols

    return symbols(indexable(table(spark, sf_dir, "source_files"))).select("file_id", "kind", "name", "line_start", "line_end", "byte_start", "byte_end")


def chunk_to_meta(spark, sf_dir):
    """Documents of commits, of files that go in whole and of the symbols of large files, with their titles."""
    chunks = commit_chunks(commits(spark, sf_dir)).unionByName(file_chunks(table(spark, sf_dir, "source_files")), allowMissingColumns=True)
    return chunk_meta(chunks).select("kind", "title", "commit_oid", "path", "line_start", "line_end")


def index_stats(spark, sf_dir):
    kinds = documents(spark, sf_dir, "kind").groupBy("kind").agg(F.count("*").alias("n"))
    return kinds.agg(*(F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(k) for k in ("commit", "file", "symbol")), F.sum("n").alias("total"))


def next_doc_id(spark, sf_dir):
    return table(spark, sf_dir, "search_docs").agg((F.coalesce(F.max("doc_id"), F.lit(0)) + 1).alias("next_id"))


def doc_store(spark, sf_dir):
    """Complete documents: those with id, kind, title and oid."""
    docs = documents(spark, sf_dir).where("kind IS NOT NULL AND title IS NOT NULL AND commit_oid IS NOT NULL")
    return docs.select("doc_id", "kind", "title", "commit_oid", "path", "line_start", "line_end")


def tree_expand(spark, sf_dir):
    """All directories of the head trees, derived from the paths of their files."""
    parts = F.split("path", "/")
    files = head_tree(spark, sf_dir).where("kind = 'file'").select("repo", parts.alias("p"))
    ups = F.transform(F.sequence(F.lit(1), F.size("p") - 1), lambda i: F.array_join(F.slice("p", F.lit(1), i), "/"))
    dirs = files.where(F.size("p") > 1).select("repo", F.explode(ups).alias("path"))
    return dirs.groupBy("repo", "path").agg(F.count("*").alias("files"))


QUERIES = {
    "camel_split": camel_split, "path_terms": path_terms, "path_depth": path_depth, "detect_language": detect_language,
    "alias_expand": alias_expand, "word_tokens": word_tokens, "bigrams": bigrams, "detect_hangul": detect_hangul,
    "split_message": split_message, "split_subject": split_subject, "commit_line": commit_line, "expand_tabs": expand_tabs,
    "line_count": line_count, "binary_files": binary_files, "doc_label": doc_label, "l2_normalize": l2_normalize,
    "mean_pool": mean_pool, "indexable_files": indexable_files, "chunk_routing": chunk_routing, "commit_chunks": commit_chunk_rows,
     "extract_symbols": extract_symbols, "chunk_to_meta": chunk_to_meta, "index_stats": index_stats,
    "embed_text": embed_text, "whole_file_texts": whole_file_texts, "embed_commits": embed_commits, "symbol_checks": symbol_checks, "next_doc_id": next_doc_id, "doc_store": doc_store, "tree_expand": tree_expand,
}

_SP = T.SPACE
_CAMEL = r"regexp_replace(regexp_replace({0}, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g')"
PATH_TERMS_SQL = _CAMEL.format(r"translate(path, '/.-_\', '     ')")
_ALIASES = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.KOREAN_ALIASES.items()) + "}"
ALIASES_SQL = f"coalesce(list_aggregate(list_filter(list_transform(string_split_regex(lower({PATH_TERMS_SQL}), '\\s+'), lambda t: map_extract_value({_ALIASES}, t)), lambda x: x IS NOT NULL), 'string_agg', ' '), '')"
_LANGS = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in T.LANGUAGES.items()) + "}"
_LANG = f"map_extract_value({_LANGS}, nullif(regexp_extract(path, '[^/]\\.([^./]+)$', 1), ''))"
_SYMBOLS = ", ".join(f"'{x}'" for x in T.SYMBOL_LANGUAGES)
_TITLE = rf"regexp_replace(string_split(message, chr(10))[1], '\A{_SP}+|{_SP}+\z', '', 'g')"
_BODY = rf"CASE WHEN contains(message, chr(10)) THEN regexp_replace(substring(message, instr(message, chr(10)) + 1), '\A{_SP}+|{_SP}+\z', '', 'g') ELSE '' END"
_FILES = "files AS (SELECT * FROM source_files WHERE content IS NOT NULL AND strlen(content) <= 1000000 AND NOT contains(content[:8000], chr(0)))"
_PATHS = "paths AS (SELECT DISTINCT path FROM tree_snapshots)"

ORACLES = {
    "camel_split": f"WITH {DOCS_SQL} SELECT doc_id, {_CAMEL.format('title')} AS split FROM docs WHERE title IS NOT NULL",
    "path_terms": f"WITH {_PATHS} SELECT path, {PATH_TERMS_SQL} AS terms FROM paths",
    "path_depth": f"WITH {_PATHS} SELECT path, length(rtrim(path, '/')) - length(replace(rtrim(path, '/'), '/', '')) AS depth FROM paths",
    "detect_language": f"WITH {_PATHS} SELECT path, {_LANG} AS language, coalesce({_LANG} IN ({_SYMBOLS}), false) AS symbols FROM paths",
    "alias_expand": f"WITH {_PATHS} SELECT path, {ALIASES_SQL} AS aliases FROM paths",
    "word_tokens": rf"WITH {DOCS_SQL}, t AS (SELECT doc_id, unnest(regexp_extract_all(lower({_CAMEL.format('title')}), '[\p{{L}}\p{{N}}]+')) AS term FROM docs) SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL",
    "bigrams": f"WITH {DOCS_SQL}, g AS (SELECT unnest(list_transform(range(1, length(body)), lambda i: lower(substring(body, i, 2)))) AS gram FROM docs WHERE length(body) >= 2) SELECT gram, count(*) AS n FROM g GROUP BY ALL",
    "detect_hangul": f"WITH {COMMITS_SQL} SELECT oid, coalesce(regexp_matches(message, '[가-힯]'), false) AS korean FROM commit_log",
    "split_message": f"WITH {COMMITS_SQL} SELECT oid, {_TITLE} AS title, {_BODY} AS body FROM commit_log WHERE message IS NOT NULL",
    "split_subject": f"""WITH {COMMITS_SQL}, pos AS (SELECT oid, message, instr(message, chr(10) || chr(10)) AS b, instr(message, chr(10)) AS l FROM commit_log WHERE message IS NOT NULL)
        SELECT oid, CASE WHEN b > 0 THEN substring(message, 1, b - 1) WHEN l > 0 THEN substring(message, 1, l - 1) ELSE message END AS subject,
               CASE WHEN b > 0 THEN substring(message, b + 2) WHEN l > 0 THEN substring(message, l + 1) ELSE '' END AS rest FROM pos""",
    "commit_line": f"WITH {COMMITS_SQL} SELECT oid, concat_ws(' ', short_id, strftime(ts, '%Y-%m-%d %H:%M'), string_split(message, chr(10))[1]) AS line FROM commit_log",
    "expand_tabs": "SELECT file_id, md5(replace(content, chr(9), '    ')) AS digest FROM source_files WHERE content IS NOT NULL",
    "line_count": "SELECT file_id, CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + CASE WHEN ends_with(content, chr(10)) THEN 0 ELSE 1 END END AS lines FROM source_files WHERE content IS NOT NULL",
    "binary_files": "SELECT file_id, contains(content[:8000], chr(0)) AS is_binary FROM source_files WHERE content IS NOT NULL",
    "doc_label": f"WITH {DOCS_SQL} SELECT doc_id, rpad(kind, 6, ' ') || ' ' || coalesce(path, commit_oid) || CASE WHEN line_start IS NOT NULL AND line_end IS NOT NULL THEN ':' || line_start || '-' || line_end ELSE '' END || '  — ' || coalesce(title, '') AS label FROM docs",
    "l2_normalize": f"WITH {VECTORS_SQL} SELECT doc_id, round(vec[1] / sqrt(list_dot_product(vec, vec)), 6) AS first, 1.0::DOUBLE AS length FROM vectors",
    "mean_pool": f"WITH {VECTORS_SQL}, {DOCS_SQL}, parts AS (SELECT path, unnest(vec) AS x, unnest(range(256)) AS i FROM docs JOIN vectors USING (doc_id) WHERE path IS NOT NULL) SELECT path, i, round(avg(x), 6) AS mean FROM parts GROUP BY ALL",
    "indexable_files": f"WITH {_FILES} SELECT file_id, strlen(content) AS bytes FROM files",
    "chunk_routing": f"WITH {_FILES} SELECT file_id, CASE WHEN strlen(content) >= 16384 AND coalesce({_LANG} IN ({_SYMBOLS}), false) THEN 'symbols' ELSE 'whole' END AS route FROM files",
    "commit_chunks": f"""WITH {COMMITS_SQL}, m AS (SELECT oid, ts, {_TITLE} AS title, {_BODY} AS body FROM commit_log WHERE message IS NOT NULL)
        SELECT oid AS commit_oid, title, body, epoch(ts)::BIGINT AS author_time, CASE WHEN body = '' THEN title ELSE title || chr(10) || body END AS embed_text FROM m""",
    "whole_file_texts": f"""WITH {_FILES} SELECT commit_oid, path, md5(path || chr(10) || CASE WHEN strlen(content) <= 2048 THEN content
          ELSE left(content, list_max(list_filter(range(500, 2049), lambda i: strlen(left(content, i)) <= 2048))) END) AS digest
        FROM files WHERE strlen(content) < 16384 OR NOT coalesce({_LANG} IN ({_SYMBOLS}), false)""",
    "embed_commits": rf"""WITH {COMMITS_SQL}, {VECTORS_SQL}, {DOCS_SQL}, m AS (SELECT oid, {_TITLE} AS title, {_BODY} AS body FROM commit_log WHERE message IS NOT NULL),
        e AS (SELECT oid, CASE WHEN body = '' THEN title ELSE title || chr(10) || body END AS text FROM m),
        has AS (SELECT doc_id, unnest(list_distinct(regexp_extract_all(lower({_CAMEL.format('title')}), '[\p{{L}}\p{{N}}]+'))) AS word FROM docs),
        wide AS (SELECT word, unnest(vec) AS x, unnest(range(256)) AS i FROM has JOIN vectors USING (doc_id)),
        tok AS (SELECT word, i, avg(x) AS x FROM wide GROUP BY ALL), words AS (SELECT oid, unnest(list_distinct(regexp_extract_all(lower({_CAMEL.format('text')}), '[\p{{L}}\p{{N}}]+'))) AS word FROM e),
        mean AS (SELECT oid, i, avg(x) AS x FROM words JOIN tok USING (word) GROUP BY ALL)
        SELECT oid AS commit_oid, round(max(CASE WHEN i = 0 THEN x END) / sqrt(sum(x * x)), 5) AS first, round(max(CASE WHEN i = 1 THEN x END) / sqrt(sum(x * x)), 5) AS second, 1.0::DOUBLE AS length FROM mean GROUP BY oid""",
    "symbol_checks": "SELECT file_id, false AS right, false AS apart FROM source_files WHERE false",
    "index_stats": f"WITH {DOCS_SQL} SELECT count(*) FILTER (kind = 'commit') AS commit, count(*) FILTER (kind = 'file') AS file, count(*) FILTER (kind = 'symbol') AS symbol, count(*) AS total FROM docs",
    "next_doc_id": "SELECT coalesce(max(doc_id), 0) + 1 AS next_id FROM search_docs",
    "doc_store": f"WITH {DOCS_SQL} SELECT doc_id, kind, title, commit_oid, path, line_start, line_end FROM docs WHERE kind IS NOT NULL AND title IS NOT NULL AND commit_oid IS NOT NULL",
    "tree_expand": f"""WITH {HEAD_SQL}, files AS (SELECT repo, string_split(path, '/') AS p FROM head WHERE kind = 'file'),
        dirs AS (SELECT repo, unnest(list_transform(range(1, len(p)), lambda i: array_to_string(p[1:i], '/'))) AS path FROM files) SELECT repo, path, count(*) AS files FROM dirs GROUP BY ALL""",
}
