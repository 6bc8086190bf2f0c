"""Relations of version-control history: logs, the commit graph, trees and diffs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import cut


def page(log: DataFrame, position: str, after: int | None, size: int = 200) -> DataFrame:
    """The next rows of a log by key set, not by offset: a page costs the same wherever it lies."""
    rest = log if after is None else log.where(F.col(position) > after)
    return rest.orderBy(position).limit(size)


def commit_filter(log: DataFrame, query: str) -> DataFrame:
    """Commits whose message or author contains the query, or whose short id begins with it, in any case; an
    empty query keeps all."""
    if not query:
        return log
    q = F.lit(query.lower())
    found = (F.contains(F.lower("message"), q), F.contains(F.lower("author"), q), F.startswith("short_id", q))
    return log.where(F.coalesce(found[0], F.lit(False)) | F.coalesce(found[1], F.lit(False)) | F.coalesce(found[2], F.lit(False)))


def prefix_search(log: DataFrame, query: str) -> DataFrame:
    """Commits of which a word of message, author or short id begins with the whole trimmed query, in any case;
    an empty query finds none, and a query of several words never matches."""
    q = query.strip().lower()
    if not q:
        return log.where(F.lit(False))
    text = F.lower(F.concat_ws(" ", "message", "author", "short_id"))
    return log.where(F.exists(F.split(text, r"\s+"), lambda w: F.startswith(w, F.lit(q))))


def first_parents(log: DataFrame) -> DataFrame:
    """(oid, parent): the first parent of each commit that is itself in the log, null for a root."""
    child = log.select("oid", F.get("parents", F.lit(0)).alias("parent"))
    known = log.select(F.col("oid").alias("_known"))
    return child.join(known, F.col("parent") == F.col("_known"), "left").select("oid", F.col("_known").alias("parent"))


def lookup(wanted: DataFrame, loaded: DataFrame, log: DataFrame) -> DataFrame:
    """The wanted commits (oid) with their rows, from the loaded page where it has them, else from the log; ``found``
    says where: ``loaded``, ``log``, or null for a commit that neither has. All share the log's columns."""
    columns = [c for c in log.columns if c != "oid"]
    rows = loaded.select("oid", *columns, F.lit(0).alias("_from")).unionByName(log.select("oid", *columns, F.lit(1).alias("_from")))
    known = rows.join(wanted.select("oid").distinct(), "oid", "left_semi").groupBy("oid").agg(F.min_by(F.struct("_from", *columns), "_from").alias("_r"))
    found = F.when(F.col("_r._from") == 0, "loaded").when(F.col("_r._from") == 1, "log")
    return wanted.select("oid").join(known, "oid", "left").select("oid", *(F.col(f"_r.{c}").alias(c) for c in columns), found.alias("found"))


#: Positions of a log that one task orders.
POSITION_BLOCK = 65_536


def adjacent_pairs(log: DataFrame, group: str = "repo", position: str = "topo_pos") -> DataFrame:
    """(group, oid, older, newer): neighbours of each commit in the order of the log.

    A log is ordered in blocks of positions, and the ends of the blocks are matched afterwards, so that no task
    orders the whole log of a repository.
    """
    rows = log.select(group, "oid", F.col(position).alias("_p"), F.floor(F.col(position) / POSITION_BLOCK).alias("_b"))
    inside = Window.partitionBy(group, "_b").orderBy("_p")
    ends = rows.groupBy(group, "_b").agg(F.min_by("oid", "_p").alias("_first"), F.max_by("oid", "_p").alias("_last"))
    across = Window.partitionBy(group).orderBy("_b")
    ends = ends.select(group, "_b", F.lead("_first").over(across).alias("_after"), F.lag("_last").over(across).alias("_before"))
    known = rows.select(group, "_b", "oid", F.lead("oid").over(inside).alias("_older"), F.lag("oid").over(inside).alias("_newer")).join(ends, [group, "_b"], "left")
    return known.select(group, "oid", F.coalesce("_older", "_after").alias("older"), F.coalesce("_newer", "_before").alias("newer"))


#: Tasks' portions of a log's graph, and rows that a walk gives at once.
GRAPH_BUCKETS, WALK_ROWS = 1024, 65_536


def _components(pairs: DataFrame) -> DataFrame:
    """(_g, _to): of each number in the pairs (_u, _v) the least that it is connected with, itself left out.

    Large and small stars by turns: rounds are logarithmic in the number of pairs, which never grow.
    """
    edges, before = pairs, None
    while True:
        both = edges.union(edges.select("_v", "_u")).toDF("_u", "_v")
        least = both.groupBy("_u").agg(F.least(F.min("_v"), F.first("_u")).alias("_m"))
        large = both.join(least, "_u").where("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).distinct()
        stars = large.join(large.groupBy("_u").agg(F.min("_v").alias("_m")), "_u")
        ends = F.explode(F.array("_u", "_v")).alias("_u")
        edges = cut(stars.select(ends, F.col("_m").alias("_v")).where("_u <> _v").distinct())
        now = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("_u", "_v"))).first()
        if now == before:
            return edges.toDF("_g", "_to")
        before = now


def graph(log: DataFrame, group: str | None) -> DataFrame:
    """(_b, oid, parents): the commits, those that hang together in one bucket. Groups (repositories) that mention the
    same commit are one; without a group the whole log is."""
    rows = log.select("oid", "parents", (F.xxhash64(group) if group else F.lit(0).cast("long")).alias("_g"))
    if group:
        named = F.concat(F.array("oid"), F.coalesce("parents", F.array().cast("array<string>")))
        mentions = rows.select("_g", F.explode(named).alias("oid")).where("oid IS NOT NULL")
        shared = cut(mentions.groupBy("oid").agg(F.min("_g").alias("_v"), F.max("_g").alias("_last")).where("_v < _last").select("oid", "_v"))
        if not shared.isEmpty():
            joined = _components(mentions.join(shared, "oid").where("_g <> _v").select(F.col("_g").alias("_u"), "_v").distinct())
            rows = rows.join(joined, "_g", "left").select("oid", "parents", F.coalesce("_to", "_g").alias("_g"))
    return rows.select(F.pmod(F.xxhash64("_g"), F.lit(GRAPH_BUCKETS)).alias("_b"), "oid", "parents")


def _indexed(batches: list[pa.RecordBatch]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(oids, child, parent): the different commits, and by their numbers the edges between them."""
    oids = pa.chunked_array([b.column("oid") for b in batches], pa.string())
    lists = [b.column("parents") for b in batches]
    known = oids.unique()
    child = pc.index_in(oids, value_set=known).to_numpy()
    child = np.repeat(child, np.concatenate([x.value_lengths().fill_null(0).to_numpy(zero_copy_only=False) for x in lists]))
    parent = pc.index_in(pa.chunked_array([x.flatten() for x in lists], pa.string()), value_set=known, skip_nulls=True).fill_null(-1).to_numpy()
    there = parent >= 0
    return known, child[there], parent[there]


def _next(near: np.ndarray, far: np.ndarray, n: int) -> tuple[list[int], list[int]]:
    """(at, to): from v edges lead to ``to[at[v] : at[v + 1]]``."""
    return np.concatenate([[0], np.cumsum(np.bincount(near, minlength=n))]).tolist(), far[np.argsort(near, kind="stable")].tolist()


def _walks(log: DataFrame, starts: DataFrame, group: str | None) -> DataFrame:
    """(names, oid) of commits reachable from a name's starts but not from those of its starts that are ``_less``.

    starts: (oid, _less) and any columns that name the start. The graph of what hangs together is in one task, which
    walks it commit by commit: time and memory grow with the commits and with what is found, not with its depth.
    """
    names = [c for c in starts.columns if c not in ("oid", "_less")]
    types = {c: t for c, t in starts.dtypes if c in names}
    rows = graph(log, group)
    known = starts.join(rows.select("oid", "_b").distinct(), "oid")
    side = [F.collect_list(F.when(F.col("_less") == less, F.col("oid"))).alias(c) for c, less in (("_from", False), ("_not", True))]
    asked = known.groupBy("_b", *names).agg(*side)
    none = [F.lit(None).cast("array<string>").alias(c) for c in ("_from", "_not")]
    tagged = rows.select("_b", "oid", "parents", *none, *(F.lit(None).cast(types[c]).alias(c) for c in names))
    tagged = tagged.unionByName(asked.where(F.size("_from") > 0).select("_b", F.lit(None).cast("string").alias("oid"), F.lit(None).cast("array<string>").alias("parents"), "_from", "_not", *names))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, tasks = [], []
        for b in batches:
            start = b.column("_from").is_valid()
            nodes.append(b.filter(pc.invert(start)).select(["oid", "parents"]))
            tasks.append(b.filter(start).select(["_from", "_not", *names]))
        asked = pa.Table.from_batches(tasks)
        if not asked.num_rows:
            return
        oids, child, parent = _indexed(nodes)
        at, to = _next(child, parent, len(oids))
        seen = [-1] * len(oids)

        def walk(first: list[int], mark: int) -> list[int]:
            todo, found = [], []
            for v in first:
                if seen[v] != mark:
                    seen[v] = mark
                    todo.append(v)
            while todo:
                v = todo.pop()
                found.append(v)
                for w in to[at[v] : at[v + 1]]:
                    if seen[w] != mark:
                        seen[w] = mark
                        todo.append(w)
            return found

        def give(who: list[int], found: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
            i, v = np.repeat(who, [len(f) for f in found]), np.concatenate(found)
            for k in range(0, len(v), WALK_ROWS):
                named = asked.select(names).take(pa.array(i[k : k + WALK_ROWS])).combine_chunks()
                columns = [x.chunk(0) for x in named.columns]
                yield pa.RecordBatch.from_arrays([*columns, oids.take(pa.array(v[k : k + WALK_ROWS]))], names=[*names, "oid"])

        def numbers(column: str) -> tuple[np.ndarray, list[int]]:
            lists = asked.column(column).chunks
            sizes = np.concatenate([x.value_lengths().to_numpy(zero_copy_only=False) for x in lists])
            flat = pc.index_in(pa.chunked_array([x.flatten() for x in lists], pa.string()), value_set=oids).to_numpy()
            return np.concatenate([[0], np.cumsum(sizes)]), flat.tolist()

        (f_at, f), (n_at, n) = numbers("_from"), numbers("_not")
        who, found, held = [], [], 0
        for i in range(asked.num_rows):
            walk(n[n_at[i] : n_at[i + 1]], i)
            found.append(np.array(walk(f[f_at[i] : f_at[i + 1]], i), np.int64))
            who.append(i)
            held += len(found[-1])
            if held >= WALK_ROWS:
                yield from give(who, found)
                who, found, held = [], [], 0
        if held:
            yield from give(who, found)

    return tagged.groupBy("_b").applyInArrow(run, ", ".join([*(f"`{c}` {types[c]}" for c in names), "oid string"]))


def reachable(log: DataFrame, starts: DataFrame, group: str | None = None) -> DataFrame:
    """The start columns with all commits of the log reachable from the start's ``oid``, itself included.

    starts: ``oid`` and any columns that name the start. group: a column of the log that commits which hang together
    mostly share.
    """
    return _walks(log, starts.withColumn("_less", F.lit(False)), group).select(*(c for c in starts.columns if c != "oid"), "oid")


def commits_since(log: DataFrame, ranges: DataFrame, group: str | None = None) -> DataFrame:
    """(range, oid) of commits reachable from ``new`` but not from ``old``; ranges: (range, old, new)."""
    sides = F.array(*(F.struct((F.lit(s) == "old").alias("_less"), F.col(s).alias("oid")) for s in ("old", "new")))
    return _walks(log, ranges.select("range", F.explode(sides).alias("e")).select("range", "e._less", "e.oid"), group)


def is_ancestor(log: DataFrame, old: str, new: str) -> bool:
    """Whether ``old`` is ``new`` or one of its ancestors."""
    start = log.sparkSession.createDataFrame([("s", new)], "start string, oid string")
    return not reachable(log, start).where(F.col("oid") == old).isEmpty()


def ancestors(path: Column) -> Column:
    """All directories above a path, nearest last."""
    parts = F.split(path, "/")
    return F.when(F.size(parts) > 1, F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))).otherwise(F.array().cast("array<string>"))


def visible(tree: DataFrame, collapsed: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Entries of a tree that are not below a collapsed directory; ``collapsed`` has (keys, path).

    Each entry is exploded to its few ancestors, which makes this an equi-join and not one on prefixes.
    """
    keys = keys or []
    above = tree.select(*keys, "path", F.explode(ancestors(F.col("path"))).alias("_above"))
    hidden = above.join(collapsed.select(*keys, F.col("path").alias("_above")), [*keys, "_above"], "left_semi").select(*keys, "path")
    return tree.join(hidden, [*keys, "path"], "left_anti")


def tree_order(path: Column, kind: Column) -> Column:
    """What the entries of a tree are sorted by to come in git's order: by bytes, a directory as its path with a
    slash, so ``foo.rs`` and ``foo-x`` come before ``foo`` and what is below it."""
    return F.when(kind == "directory", F.concat(path, F.lit("/"))).otherwise(path)


def changed_neighbours(tree: DataFrame, changed: DataFrame, group: str = "repo") -> DataFrame:
    """(group, path, next_changed, previous_changed): for each entry in git's tree order the nearest changed files.

    What is below one directory of the second level stands together in that order. These blocks are searched each by
    itself; beyond them the first or last changed file of the nearest block that has one is taken.
    """
    flagged = tree.join(changed.select(group, "path", F.lit(True).alias("_c")), [group, "path"], "left")
    place = tree_order(F.col("path"), F.col("kind"))
    block = F.regexp_extract(place, "^((?:[^/]*/){2})", 1)
    rows = flagged.select(group, "path", place.alias("_o"), F.when(block != "", block).otherwise(place).alias("_b"), F.when(F.col("_c") & (F.col("kind") == "file"), F.col("path")).alias("_m"))

    def nearest(order: Window, first: str, last: str) -> tuple[Column, Column]:
        after = F.first(first, ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing))
        return after, F.last(last, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1))

    marked = F.when(F.col("_m").isNotNull(), F.struct("_o", "_m"))
    ends = rows.groupBy(group, "_b").agg(F.min(marked)["_m"].alias("_first"), F.max(marked)["_m"].alias("_last"))
    after, before = nearest(Window.partitionBy(group).orderBy("_b"), "_first", "_last")
    ends = ends.select(group, "_b", after.alias("_after"), before.alias("_before"))
    after, before = nearest(Window.partitionBy(group, "_b").orderBy("_o"), "_m", "_m")
    known = rows.select(group, "_b", "path", after.alias("_n"), before.alias("_p")).join(ends, [group, "_b"], "left")
    return known.select(group, "path", F.coalesce("_n", "_after").alias("next_changed"), F.coalesce("_p", "_before").alias("previous_changed"))


def nearest_ancestor(wanted: DataFrame, tree: DataFrame, group: str = "repo") -> DataFrame:
    """(group, path, found): the wanted path if the tree has it, else its nearest directory that the tree has."""
    options = wanted.select(group, "path", F.posexplode(F.concat(ancestors(F.col("path")), F.array("path"))).alias("_d", "_p"))
    known = options.join(tree.select(group, F.col("path").alias("_p")), [group, "_p"])
    best = known.groupBy(group, "path").agg(F.max_by("_p", "_d").alias("found"))
    return wanted.select(group, "path").join(best, [group, "path"], "left")


def change_rollup(tree: DataFrame, changed: DataFrame, group: str = "repo") -> DataFrame:
    """(group, path, changed): directories with how many changed files lie below them."""
    below = changed.select(group, F.explode(ancestors(F.col("path"))).alias("path")).groupBy(group, "path").agg(F.count("*").alias("changed"))
    return tree.where("kind = 'directory'").join(below, [group, "path"]).select(group, "path", "changed")


def stale_documents(docs: DataFrame, touched: DataFrame) -> DataFrame:
    """Documents of paths that were modified or deleted."""
    return docs.join(touched.where(F.col("change").isin("modified", "deleted")).select("path").distinct(), "path", "left_semi")


def diff_stats(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Added and removed lines of each file of a diff."""
    return lines.groupBy(*keys).agg(F.count_if(F.col("kind") == "added").alias("added"), F.count_if(F.col("kind") == "removed").alias("removed"))


def align_diff(lines: DataFrame, keys: list[str], position: str = "pos") -> DataFrame:
    """Side-by-side rows of a diff: (keys, block, row, old, new, old_pos, new_pos).

    Runs between context lines are blocks; the i-th removed line of a block stands beside the i-th added one,
    what is left over stands alone, and a context line beside itself.
    """
    by_file = Window.partitionBy(*keys).orderBy(position)
    blocks = lines.withColumn("_context", (F.col("kind") == "context").cast("int"))
    blocks = blocks.withColumn("block", F.sum("_context").over(by_file) * 2 - F.col("_context"))
    row = F.row_number().over(Window.partitionBy(*keys, "block", "kind").orderBy(position))
    numbered = blocks.withColumn("row", row)
    old = F.col("kind").isin("removed", "context")
    new = F.col("kind").isin("added", "context")
    return numbered.groupBy(*keys, "block", "row").agg(
        F.max(F.when(old, F.col("content"))).alias("old"),
        F.max(F.when(new, F.col("content"))).alias("new"),
        F.max(F.when(old, F.col(position))).alias("old_pos"),
        F.max(F.when(new, F.col(position))).alias("new_pos"),
    )


def navigation(hits: DataFrame, docs: DataFrame, log: DataFrame) -> DataFrame:
    """(qid, rank, target, oid, parent, path, line): where selecting a hit leads. A commit opens its diff against
    its first parent, or its tree if it is a root; a file or symbol opens at its path and first line."""
    meta = docs.select("doc_id", "kind", "commit_oid", "path", "line_start").join(hits.select("qid", "rank", "doc_id"), "doc_id")
    parents = first_parents(log).select(F.col("oid").alias("commit_oid"), "parent")
    joined = meta.join(parents, "commit_oid", "left")
    commit = F.col("kind") == "commit"
    target = F.when(commit & F.col("parent").isNotNull(), "diff").otherwise("view")
    return joined.select(
        "qid",
        "rank",
        target.alias("target"),
        F.col("commit_oid").alias("oid"),
        F.when(commit, F.col("parent")).alias("parent"),
        F.when(~commit, F.col("path")).alias("path"),
        F.when(~commit, F.coalesce("line_start", F.lit(1))).alias("line"),
    )


def topological_depth(log: DataFrame, group: str | None = None) -> DataFrame:
    """(oid, depth): the length of the longest way down to a root, an order in which parents come first.

    What hangs together is in one task (see ``graph``), which takes each commit when all of its parents have been.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        oids, child, parent = _indexed(list(batches))
        at, to = _next(parent, child, len(oids))
        waits = np.bincount(child, minlength=len(oids))
        todo, waits = np.flatnonzero(waits == 0).tolist(), waits.tolist()
        depth, done = [0] * len(oids), 0
        while todo:
            v = todo.pop()
            done += 1
            longer = depth[v] + 1
            for w in to[at[v] : at[v + 1]]:
                if depth[w] < longer:
                    depth[w] = longer
                waits[w] -= 1
                if not waits[w]:
                    todo.append(w)
        if done < len(oids):
            raise ValueError(f"{len(oids) - done} commits are their own ancestors or descend from such")
        yield from pa.table([oids, pa.array(depth, pa.int32())], names=["oid", "depth"]).to_batches(WALK_ROWS)

    return graph(log, group).groupBy("_b").applyInArrow(run, "oid string, depth int")
