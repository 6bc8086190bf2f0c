"""Queries over commit logs, the commit graph, trees, diffs and event-like state."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomline.functions.highlight import highlight
from loomline.functions.linediff import line_diff
from loomline.operators import history as H
from loomline.operators.index import delete
from loomline.operators.snapshots import file_changes
from loomline.plans.base import COMMITS_SQL, DOCS_SQL, HEAD_SQL, commits, documents, head_tree
from loomline.plans.snapshot_queries import CHANGES_SQL
from loomline.session import table
from loomline.sources.git import ignore_expression
from loomline.streaming.head import head_changes, read_observations

FILTER, PREFIX, REPO = "index", "relo", "kelpforge"
IGNORED = ["*.md", "!README.md", "src/**/w*.rs", "/docs/", "?.toml"]
COLLAPSED = ["src/view", "docs", "crates/core"]

#: A line that only closes a block.
CLOSING = r"^[ \t]*\}[ \t\r]*$"

#: A small diff, that of a unit test: (file, pos, kind, content).
DIFF_ROWS = [
    ("a.rs", 0, "context", "fn main() {"), ("a.rs", 1, "removed", "  let x = 1;"), ("a.rs", 2, "removed", "  let y = 2;"), ("a.rs", 3, "added", "  let x = 3;"),
    ("a.rs", 4, "context", "}"), ("a.rs", 5, "added", "// end"), ("b.rs", 0, "added", "new"), ("b.rs", 1, "added", "file"), ("c.rs", 0, "removed", "old"),
]


def commit_log(spark, sf_dir):
    log = commits(spark, sf_dir, "repo", "topo_pos", "short_id", "author", "ts")
    return log.select("repo", "topo_pos", "oid", "short_id", "author", "ts")


def commit_page(spark, sf_dir):
    """The second page of the largest repo's log."""
    log = commits(spark, sf_dir, "repo", "topo_pos").where(F.col("repo") == REPO)
    return H.page(log, "topo_pos", 19, 200).select("topo_pos", "oid")


def commit_filter(spark, sf_dir):
    return H.commit_filter(commits(spark, sf_dir, "message", "author", "short_id"), FILTER).select("oid")


def commit_prefix_search(spark, sf_dir):
    return H.prefix_search(commits(spark, sf_dir, "message", "author", "short_id"), PREFIX).select("oid")


def lookup_commits(spark, sf_dir):
    """The commits that documents name, from the first page of the largest repo's log where that has them."""
    log = commits(spark, sf_dir, "repo", "topo_pos", "author")
    loaded = H.page(log.where(F.col("repo") == REPO), "topo_pos", None, 200)
    return H.lookup(documents(spark, sf_dir, "commit_oid").select(F.col("commit_oid").alias("oid")).distinct(), loaded, log)


def tree_ignored(spark, sf_dir):
    """Entries of the head trees that ignore patterns leave out."""
    tree = head_tree(spark, sf_dir).select("repo", "path")
    return tree.where(ignore_expression(F.col("path"), IGNORED))


def first_parent_pairs(spark, sf_dir):
    return H.first_parents(commits(spark, sf_dir, "parents"))


def adjacent_commit_pairs(spark, sf_dir):
    return H.adjacent_pairs(commits(spark, sf_dir, "repo", "topo_pos"))


def commits_since(spark, sf_dir):
    """Of each repo the commits since the one in the middle of its log."""
    log = commits(spark, sf_dir, "repo", "topo_pos", "parents")
    ends = log.groupBy("repo").agg(F.max("topo_pos").alias("_last"))
    middle = log.join(ends, "repo").where(F.col("topo_pos") == F.floor(F.col("_last") / 2)).select(F.col("repo").alias("range"), F.col("oid").alias("old"))
    head = log.where("topo_pos = 0").select(F.col("repo").alias("range"), F.col("oid").alias("new"))
    return H.commits_since(log, middle.join(head, "range"), "repo").select(F.col("range").alias("repo"), "oid")


def tree_visible(spark, sf_dir):
    tree = head_tree(spark, sf_dir).select("repo", "path", "kind")
    folded = spark.createDataFrame([(p,) for p in COLLAPSED], "path string")
    return H.visible(tree, folded).select("repo", "path")


def last_changes(spark, sf_dir) -> DataFrame:
    """Changes between the last two snapshots of each repo."""
    tree = table(spark, sf_dir, "tree_snapshots")
    last = tree.groupBy("repo").agg(F.max("snapshot_no").alias("snapshot_no"))
    return file_changes(tree).join(last, ["repo", "snapshot_no"], "left_semi").select("repo", "path", "change")


def snapshot_changes(spark, sf_dir):
    return last_changes(spark, sf_dir)


def next_changed(spark, sf_dir):
    changed = last_changes(spark, sf_dir).where("change <> 'deleted'")
    return H.changed_neighbours(head_tree(spark, sf_dir).select("repo", "path", "kind"), changed)


def tree_order(spark, sf_dir):
    """The place of each entry of each repo's head tree in git's order."""
    tree = head_tree(spark, sf_dir).select("repo", "path", "kind")
    return tree.withColumn("pos", F.row_number().over(Window.partitionBy("repo").orderBy(H.tree_order(F.col("path"), F.col("kind"))))).select("repo", "path", "pos")


def nearest_ancestor(spark, sf_dir):
    """Where a view of a path deleted last lands in the head tree."""
    gone = last_changes(spark, sf_dir).where("change = 'deleted'").select("repo", "path")
    return H.nearest_ancestor(gone, head_tree(spark, sf_dir).select("repo", "path"))


def dir_change_rollup(spark, sf_dir):
    changed = last_changes(spark, sf_dir).where("change <> 'deleted'")
    return H.change_rollup(head_tree(spark, sf_dir).select("repo", "path", "kind"), changed)


def stale_docs(spark, sf_dir):
    return H.stale_documents(documents(spark, sf_dir, "path"), last_changes(spark, sf_dir)).select("doc_id")


def incremental_docs(spark, sf_dir):
    """Documents after an incremental build: those of modified and deleted paths are gone, and the files added or
    modified have come anew; all others stay as they are."""
    old = documents(spark, sf_dir, "kind", "title", "path")
    changes = last_changes(spark, sf_dir)
    live = delete(old, H.stale_documents(old, changes)).select("kind", "title", "path")
    fresh = changes.where(F.col("change").isin("added", "modified")).select("path").distinct()
    return live.unionByName(fresh.select(F.lit("file").alias("kind"), F.col("path").alias("title"), "path"))


def topological_depth(spark, sf_dir):
    return H.topological_depth(commits(spark, sf_dir, "repo", "parents"), "repo")


def highlight_spans(spark, sf_dir):
    """Spans of each kind in each source file."""
    found = highlight(table(spark, sf_dir, "source_files"))
    return found.groupBy("file_id", "kind").agg(F.count("*").alias("spans"), F.sum(F.col("end") - F.col("start")).alias("characters"))


def diff_align(spark, sf_dir):
    """The diff of each source file side by side."""
    return H.align_diff(line_diff_rows(spark, sf_dir), ["file_id"]).select(F.col("file_id").alias("file"), "old", "new", "old_pos", "new_pos")


def diff_stats(spark, sf_dir):
    return H.diff_stats(line_diff_rows(spark, sf_dir), ["file_id"]).withColumnRenamed("file_id", "file")


def line_diff_rows(spark, sf_dir):
    """Diff of each source file against its content without the lines that only close a block. The other lines are
    all kept, so there is one shortest diff only."""
    files = table(spark, sf_dir, "source_files").where("content IS NOT NULL")
    kept = F.filter(F.split("content", "\n"), lambda line: ~line.rlike(CLOSING))
    return line_diff(files.select("file_id", F.col("content").alias("old"), F.array_join(kept, "\n").alias("new")), "file_id")


def latency_percentiles(spark, sf_dir):
    """Nearest-rank percentiles of event values, as of latencies, and samples a second."""
    samples = table(spark, sf_dir, "events").where("value IS NOT NULL").groupBy("event_type")
    p = [F.expr(f"percentile_disc({x}) WITHIN GROUP (ORDER BY value)").alias(n) for x, n in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))]
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    elapsed = F.max(at) - F.min(at)
    qps = F.when(elapsed > 0, F.count("*") / (elapsed / 1e6)).otherwise(0.0)
    return samples.agg(*p, F.round(F.avg("value"), 6).alias("mean"), F.round(qps, 9).alias("qps"), F.count("*").alias("n"))


def debounce_last(spark, sf_dir):
    """Of each user's bursts of events, with gaps of under 30 minutes, the last event."""
    burst = F.session_window("ts", "30 minutes")
    last = table(spark, sf_dir, "events").groupBy("user_id", burst).agg(F.max(F.struct("ts", "event_id")).alias("_l"), F.count("*").alias("events"))
    return last.select("user_id", F.col("_l.event_id").alias("event_id"), "events")


def head_change_stream(spark, sf_dir):
    """Changes of each repo's head as a stream of observations of (oid, ref) reports them."""
    return head_changes(read_observations(spark, os.path.join(sf_dir, "commits.parquet")))


QUERIES = {
    "commit_log": commit_log, "commit_page": commit_page, "commit_filter": commit_filter, "commit_prefix_search": commit_prefix_search,
    "first_parent_pairs": first_parent_pairs, "lookup_commits": lookup_commits, "tree_ignored": tree_ignored, "adjacent_commit_pairs": adjacent_commit_pairs, "commits_since": commits_since,
    "tree_visible": tree_visible, "snapshot_changes": snapshot_changes, "tree_order": tree_order, "next_changed": next_changed, "nearest_ancestor": nearest_ancestor,
    "dir_change_rollup": dir_change_rollup, "stale_docs": stale_docs, "incremental_docs": incremental_docs, "topological_depth": topological_depth, "highlight_spans": highlight_spans, "diff_align": diff_align, "diff_stats": diff_stats,
    "line_diff": line_diff_rows, "latency_percentiles": latency_percentiles, "debounce_last": debounce_last, "head_change_stream": head_change_stream,
}

LAST_SQL = CHANGES_SQL + ", last_no AS (SELECT repo, max(snapshot_no) AS snapshot_no FROM tree_snapshots GROUP BY repo), last_changes AS (SELECT repo, path, change FROM changes JOIN last_no USING (repo, snapshot_no))"
_LAST_HEAD = LAST_SQL + ", " + HEAD_SQL
_SMALL = "diff AS (SELECT * FROM (VALUES " + ", ".join(str(r) for r in DIFF_ROWS) + ") AS v(file, pos, kind, content))"
_DIFF = rf"""split AS (SELECT file_id, string_split(CASE WHEN ends_with(content, chr(10)) THEN content[:-2] ELSE content END, chr(10)) AS l FROM source_files WHERE content <> ''),
numbered AS (SELECT file_id, unnest(l) AS content, unnest(range(1, len(l) + 1)) AS old_no FROM split),
marked AS (SELECT *, regexp_full_match(content, '[ \t]*\}}[ \t\r]*')::INT AS gone FROM numbered),
near AS (SELECT *, old_no - sum(gone) OVER (PARTITION BY file_id ORDER BY old_no) AS new_no,
         max(gone) OVER (PARTITION BY file_id ORDER BY old_no ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING) AS shown FROM marked),
diff AS (SELECT file_id AS file, (row_number() OVER (PARTITION BY file_id ORDER BY old_no) - 1)::INT AS pos, CASE WHEN gone = 1 THEN 'removed' ELSE 'context' END AS kind,
         old_no::INT AS old_no, CASE WHEN gone = 0 THEN new_no::INT END AS new_no, content FROM near WHERE shown = 1)"""
_ALIGN = """, b AS (SELECT *, sum(CASE WHEN kind = 'context' THEN 1 ELSE 0 END) OVER (PARTITION BY file ORDER BY pos) * 2 - CASE WHEN kind = 'context' THEN 1 ELSE 0 END AS block FROM diff),
        n AS (SELECT *, row_number() OVER (PARTITION BY file, block, kind ORDER BY pos) AS r FROM b)
        SELECT file, max(content) FILTER (kind <> 'added') AS old, max(content) FILTER (kind <> 'removed') AS new,
               max(pos) FILTER (kind <> 'added') AS old_pos, max(pos) FILTER (kind <> 'removed') AS new_pos FROM n GROUP BY file, block, r"""
_STATS = " SELECT file, count(*) FILTER (kind = 'added') AS added, count(*) FILTER (kind = 'removed') AS removed FROM diff GROUP BY file"
SMALL_ORACLES = {"diff_align": f"WITH {_SMALL}{_ALIGN}", "diff_stats": f"WITH {_SMALL}{_STATS}"}
_UP = "list_transform(range(1, len(string_split(path, '/'))), lambda i: array_to_string(string_split(path, '/')[1:i], '/'))"

_ORDER = "h.path || CASE WHEN h.kind = 'directory' THEN '/' ELSE '' END"

ORACLES = {
    "commit_log": f"WITH {COMMITS_SQL} SELECT repo, topo_pos, oid, short_id, author, ts FROM commit_log",
    "commit_page": f"WITH {COMMITS_SQL} SELECT topo_pos, oid FROM commit_log WHERE repo = '{REPO}' AND topo_pos > 19 ORDER BY topo_pos LIMIT 200",
    "commit_filter": f"WITH {COMMITS_SQL} SELECT oid FROM commit_log WHERE coalesce(contains(lower(message), '{FILTER}'), false) OR coalesce(contains(lower(author), '{FILTER}'), false) OR starts_with(short_id, '{FILTER}')",
    "commit_prefix_search": rf"WITH {COMMITS_SQL} SELECT oid FROM commit_log WHERE len(list_filter(string_split_regex(lower(concat_ws(' ', message, author, short_id)), '\s+'), lambda w: starts_with(w, '{PREFIX}'))) > 0",
    "first_parent_pairs": f"WITH {COMMITS_SQL} SELECT c.oid, p.oid AS parent FROM commit_log c LEFT JOIN commit_log p ON c.parents[1] = p.oid",
    "lookup_commits": f"""WITH {COMMITS_SQL}, {DOCS_SQL}, loaded AS (SELECT oid FROM commit_log WHERE repo = '{REPO}' ORDER BY topo_pos LIMIT 200), w AS (SELECT DISTINCT commit_oid AS oid FROM docs)
        SELECT w.oid, repo, topo_pos, author, CASE WHEN c.oid IS NULL THEN NULL WHEN w.oid IN (SELECT oid FROM loaded) THEN 'loaded' ELSE 'log' END AS found FROM w LEFT JOIN commit_log c ON c.oid = w.oid""",
    "tree_ignored": rf"""WITH {HEAD_SQL} SELECT DISTINCT repo, path FROM head WHERE regexp_matches(path, '(^|/)[^/]\.toml(/|$)') OR starts_with(path, 'docs/') OR regexp_matches(path, '^src/(.*/)?w[^/]*\.rs(/|$)')
        OR (regexp_matches(path, '\.md(/|$)') AND NOT regexp_matches(path, '(^|/)README\.md(/|$)'))""",
    "head_change_stream": """WITH seen AS (SELECT repo, loaded_at AS seen_at, oid, 'main' AS ref, lag(oid) OVER (PARTITION BY repo ORDER BY loaded_at, oid) AS old_oid FROM commits WHERE repo IS NOT NULL AND oid IS NOT NULL)
        SELECT repo, seen_at, old_oid, oid AS new_oid, ref FROM seen WHERE old_oid IS DISTINCT FROM oid""",
    "adjacent_commit_pairs": f"WITH {COMMITS_SQL} SELECT repo, oid, lead(oid) OVER w AS older, lag(oid) OVER w AS newer FROM commit_log WINDOW w AS (PARTITION BY repo ORDER BY topo_pos)",
    "commits_since": f"""WITH RECURSIVE {COMMITS_SQL}, ends AS (SELECT repo, max(topo_pos) // 2 AS m FROM commit_log GROUP BY repo),
        news(repo, oid) AS (SELECT repo, oid FROM commit_log WHERE topo_pos = 0 UNION SELECT n.repo, p.oid FROM news n JOIN commit_log c ON c.oid = n.oid, unnest(c.parents) AS u(x) JOIN commit_log p ON p.oid = x),
        olds(repo, oid) AS (SELECT c.repo, c.oid FROM commit_log c JOIN ends e ON c.repo = e.repo AND c.topo_pos = e.m UNION SELECT n.repo, p.oid FROM olds n JOIN commit_log c ON c.oid = n.oid, unnest(c.parents) AS u(x) JOIN commit_log p ON p.oid = x)
        SELECT repo, oid FROM news EXCEPT SELECT repo, oid FROM olds""",
    "tree_visible": f"WITH {HEAD_SQL} SELECT DISTINCT repo, path FROM head WHERE NOT (" + " OR ".join(f"starts_with(path, '{p}/')" for p in COLLAPSED) + ")",
    "snapshot_changes": LAST_SQL + " SELECT repo, path, change FROM last_changes",
    "next_changed": _LAST_HEAD + """, flagged AS (SELECT h.repo, h.path, """ + _ORDER + """ AS o, CASE WHEN l.path IS NOT NULL AND h.kind = 'file' THEN h.path END AS m
        FROM (SELECT DISTINCT repo, path, kind FROM head) h LEFT JOIN last_changes l ON h.repo = l.repo AND h.path = l.path AND l.change <> 'deleted')
        SELECT repo, path, first_value(m IGNORE NULLS) OVER (PARTITION BY repo ORDER BY o ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_changed,
               last_value(m IGNORE NULLS) OVER (PARTITION BY repo ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS previous_changed FROM flagged""",
    "tree_order": f"WITH {HEAD_SQL} SELECT repo, path, row_number() OVER (PARTITION BY repo ORDER BY {_ORDER}) AS pos FROM (SELECT DISTINCT repo, path, kind FROM head) h",
    "nearest_ancestor": _LAST_HEAD + """, gone AS (SELECT repo, path FROM last_changes WHERE change = 'deleted'),
        best AS (SELECT g.repo, g.path, max_by(h.path, length(h.path)) AS found FROM gone g JOIN head h ON h.repo = g.repo AND (h.path = g.path OR starts_with(g.path, h.path || '/')) GROUP BY ALL)
        SELECT g.repo, g.path, found FROM gone g LEFT JOIN best USING (repo, path)""",
    "dir_change_rollup": _LAST_HEAD + f""", up AS (SELECT repo, unnest({_UP}) AS path FROM last_changes WHERE change <> 'deleted')
        SELECT repo, path, count(*) AS changed FROM up JOIN (SELECT DISTINCT repo, path FROM head WHERE kind = 'directory') USING (repo, path) GROUP BY ALL""",
    "stale_docs": LAST_SQL + f", {DOCS_SQL} SELECT doc_id FROM docs WHERE path IN (SELECT path FROM last_changes WHERE change IN ('modified', 'deleted'))",
    "incremental_docs": LAST_SQL + f""", {DOCS_SQL} SELECT kind, title, path FROM docs WHERE path IS NULL OR path NOT IN (SELECT path FROM last_changes WHERE change IN ('modified', 'deleted'))
        UNION ALL SELECT 'file', path, path FROM (SELECT DISTINCT path FROM last_changes WHERE change IN ('added', 'modified'))""",
    "topological_depth": f"""WITH RECURSIVE {COMMITS_SQL}, ways(oid, depth) AS (SELECT oid, 0 FROM commit_log
        UNION SELECT c.oid, w.depth + 1 FROM ways w JOIN (SELECT oid, unnest(parents) AS p FROM commit_log) c ON c.p = w.oid) SELECT oid, max(depth) AS depth FROM ways GROUP BY oid""",
    "line_diff": f"WITH {_DIFF} SELECT file AS file_id, pos, kind, old_no, new_no, content FROM diff",
    "diff_align": f"WITH {_DIFF}{_ALIGN}",
    "diff_stats": f"WITH {_DIFF}{_STATS}",
    "latency_percentiles": "SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, round(avg(value), 6) AS mean, round(count(*) / ((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6), 9) AS qps, count(*) AS n FROM events WHERE value IS NOT NULL GROUP BY event_type",
    "debounce_last": """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS s FROM events),
        b AS (SELECT *, sum(s) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS burst FROM g)
        SELECT user_id, max_by(event_id, (ts, event_id)) AS event_id, count(*) AS events FROM b GROUP BY user_id, burst""",
}
