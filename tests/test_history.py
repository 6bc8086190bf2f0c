from __future__ import annotations

import os
import subprocess

import pytest
from pyspark.sql import functions as F

from loomline.operators import history as H
from loomline.sources import git


@pytest.fixture(scope="module")
def repo(tmp_path_factory):
    path = str(tmp_path_factory.mktemp("repo"))
    env = os.environ | {"GIT_AUTHOR_NAME": "Test", "GIT_AUTHOR_EMAIL": "test@test.com", "GIT_COMMITTER_NAME": "Test", "GIT_COMMITTER_EMAIL": "test@test.com", "HOME": path}

    def run(*args):
        subprocess.run(["git", "-C", path, *args], check=True, capture_output=True, env=env)

    def commit(message, **files):
        for name, content in files.items():
            target = os.path.join(path, name.replace("__", "/"))
            if content is None:
                os.remove(target)
                continue
            os.makedirs(os.path.dirname(target), exist_ok=True)
            with open(target, "wb") as f:
                f.write(content)
        run("add", "-A")
        run("commit", "-q", "-m", message)

    run("init", "-q", "-b", "main")
    commit("Add keep\n\nbody", keep=b"v1", src__a=b"a\n", bin=b"a\x00b")
    commit("Edit", keep=b"v2", new=b"n", src__a=None, empty=b"", lines=b"a\nb\n")
    return path


def test_git_sources(spark, repo):
    log = git.read(spark, "git_log", repo).orderBy("topo_pos").collect()
    assert [r.message for r in log] == ["Edit", "Add keep\n\nbody"]
    assert log[0].parents == [log[1].oid] and log[1].parents == [] and log[0].author == "Test <test@test.com>"
    tree = {r.path: r.kind for r in git.read(spark, "git_tree", repo, rev=log[1].oid).collect()}
    assert tree == {"keep": "file", "src": "directory", "src/a": "file", "bin": "file"}
    blobs = {r.path: r for r in git.read(spark, "git_blob", repo, rev=log[1].oid).collect()}
    assert blobs["keep"].text == "v1" and blobs["bin"].is_binary and not blobs["src/a"].is_binary
    diff = {r.path: r.change for r in git.read(spark, "git_diff", repo, rev=log[1].oid, to=log[0].oid).collect()}
    assert diff == {"keep": "modified", "new": "added", "src/a": "deleted", "empty": "added", "lines": "added"}
    assert {r.path: bytes(r.content) for r in git.read(spark, "git_blob", repo).collect()} == {"keep": b"v2", "new": b"n", "bin": b"a\0b", "empty": b"", "lines": b"a\nb\n"}
    assert git.head_info(repo) == (log[0].oid, "main")
    assert git.open_repo(os.path.join(repo, ".")) == os.path.realpath(repo)
    with pytest.raises(git.RepoNotFound):
        git.open_repo("/")


def test_tree_order_is_gits(spark, tmp_path):
    path = str(tmp_path)
    for name in ("foo/a", "foo/b/c", "foo.rs", "foo-x", "foo0", "a/z", "a.b", "é", "Z"):
        target = tmp_path / name
        target.parent.mkdir(parents=True, exist_ok=True)
        target.write_text(name)
    for args in (["init", "-q"], ["add", "-A"], ["-c", "user.name=t", "-c", "user.email=t@t", "commit", "-q", "-m", "m"]):
        subprocess.run(["git", "-C", path, *args], check=True, capture_output=True)
    listed = subprocess.run(["git", "-C", path, "ls-tree", "-r", "-t", "-z", "--name-only", "HEAD"], check=True, capture_output=True).stdout.decode().split("\0")[:-1]
    tree = git.read(spark, "git_tree", path)
    assert [r.path for r in tree.orderBy(H.tree_order(F.col("path"), F.col("kind"))).collect()] == listed
    assert [r.path for r in tree.orderBy("pos").collect()] == listed
    changed = spark.createDataFrame([("r", "foo/a"), ("r", "a.b")], "repo string, path string")
    found = {r.path: (r.previous_changed, r.next_changed) for r in H.changed_neighbours(tree.withColumn("repo", F.lit("r")), changed).collect()}
    assert found["foo.rs"] == ("a.b", "foo/a") and found["foo0"] == ("foo/a", None) and found["Z"] == (None, "a.b")


def test_ignore_patterns(spark):
    paths = spark.createDataFrame([(p,) for p in ("a.log", "src/b.log", "target/x", "src/target", "keep.log", "docs/a/b.md")], "path string")
    flag = git.ignore_expression(F.col("path"), ["# c", "*.log", "!keep.log", "target/", "docs/**/b.md"])
    assert {r.path for r in paths.where(flag).collect()} == {"a.log", "src/b.log", "target/x", "docs/a/b.md"}


def test_ignore_signs(spark, tmp_path):
    """As git itself decides."""
    names = ["a.c", "ab.c", "a/c", "src/x.o", "src/y.o", "src/z1.o", "src/deep/x.o", "lib/a-b", "lib/a+b", "docs/n.md", "docs/sub/n.md", "build/out", "x/build/out", "keep.o"]
    patterns = ["a?c", "src/[xy].o", "z[!2-9].o", "lib/a+b", "/docs/**/n.md", "build/", "!keep.o"]
    subprocess.run(["git", "init", "-q", str(tmp_path)], check=True)
    (tmp_path / ".gitignore").write_text("\n".join(patterns))
    out = subprocess.run(["git", "-C", str(tmp_path), "check-ignore", "--no-index", "--stdin"], input="\n".join(names), capture_output=True, text=True, check=False).stdout.split("\n")
    paths = spark.createDataFrame([(n,) for n in names], "path string")
    assert {r.path for r in paths.where(git.ignore_expression(F.col("path"), patterns)).collect()} == set(filter(None, out))


def test_lookup(spark):
    log = spark.createDataFrame([("a", "m1"), ("b", "m2")], "oid string, message string")
    loaded = spark.createDataFrame([("a", "page")], "oid string, message string")
    wanted = spark.createDataFrame([("a",), ("b",), ("c",)], "oid string")
    assert {tuple(r) for r in H.lookup(wanted, loaded, log).collect()} == {("a", "page", "loaded"), ("b", "m2", "log"), ("c", None, None)}


def graph(spark, edges):
    return spark.createDataFrame([(o, p, i) for i, (o, p) in enumerate(edges.items())], "oid string, parents array<string>, topo_pos int")


def test_reachability(spark):
    log = graph(spark, {"e": ["d", "c"], "d": ["b"], "c": ["b"], "b": ["a"], "a": [], "x": ["a", "lost"]})
    ranges = spark.createDataFrame([("r", "b", "e"), ("s", "e", "b"), ("t", "nowhere", "x")], "range string, old string, new string")
    found = {(r.range, r.oid) for r in H.commits_since(log, ranges).collect()}
    assert found == {("r", "e"), ("r", "d"), ("r", "c"), ("t", "x"), ("t", "a")}
    assert H.is_ancestor(log, "a", "e") and not H.is_ancestor(log, "e", "a") and not H.is_ancestor(log, "x", "e")


def test_long_chain(spark):
    log = graph(spark, {str(i): [str(i + 1)] if i < 300 else [] for i in range(301)})
    assert H.reachable(log, spark.createDataFrame([("0",)], "oid string")).count() == 301


@pytest.fixture
def bounded_cuts(monkeypatch):
    """Fails as soon as what is cut has more rows than a few for each commit."""

    def limit(most):
        cut = H.cut

        def counted(df, *a):
            assert df.count() <= most
            return cut(df, *a)

        monkeypatch.setattr(H, "cut", counted)

    return limit


def test_commits_since_is_linear(spark, bounded_cuts):
    """No step makes pairs of commits: the work grows with the history, not with its depth."""
    n = 3000
    edges = {str(i): [str(j) for j in (i + 1, i + 2) if j <= n] if i % 10 == 0 else [str(i + 1)] if i < n else [] for i in range(n + 1)}
    bounded_cuts(4 * n)
    ranges = spark.createDataFrame([("r", "1500", "0"), ("s", "0", "1500"), ("t", "2", "1")], "range string, old string, new string")
    found = {(r.range, int(r.oid)) for r in H.commits_since(graph(spark, edges), ranges).collect()}
    assert found == {("r", i) for i in range(1500)} | {("t", 1)}


def test_history_follows_parents_into_other_groups(spark):
    """Forks: a parent in another repository, over several of them, and repositories that share nothing."""
    rows = [("a", "r1", ["b"]), ("b", "r2", ["c", None]), ("c", "r3", ["d"]), ("d", "r4", None), ("e", "r1", ["c"]), ("x", "r5", ["y"]), ("y", "r5", []), ("z", "r6", ["gone"]), ("w", None, ["y"])]
    log = spark.createDataFrame(rows, "oid string, repo string, parents array<string>")
    ranges = spark.createDataFrame([(1, "e", "a"), (2, "x", "a"), (3, None, "w"), (4, "a", "z"), (5, "d", "e"), (5, "y", "x")], "range int, old string, new string")
    want = {(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (2, "d"), (3, "w"), (3, "y"), (4, "z"), (5, "e"), (5, "c"), (5, "x")}
    assert sorted(tuple(r) for r in H.commits_since(log, ranges, "repo").collect()) == sorted(want)
    starts = spark.createDataFrame([("p", 1, "b"), ("p", 1, "e"), ("q", 2, "z"), ("q", 3, "lost")], "name string, number int, oid string")
    assert sorted(tuple(r) for r in H.reachable(log, starts, "repo").collect()) == [("p", 1, "b"), ("p", 1, "c"), ("p", 1, "d"), ("p", 1, "e"), ("q", 2, "z")]


def test_chained_components(spark):
    edges = [(i, i + 1) for i in range(60) if i != 40] + [(50, 58)]
    found = {r._g: r._to for r in H._components(spark.createDataFrame([(a, b) if a % 3 else (b, a) for a, b in edges], "_u long, _v long")).collect()}
    assert found == {i: 0 for i in range(1, 41)} | {i: 41 for i in range(42, 61)}


def test_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "POSITION_BLOCK", 3)
    positions = [0, 1, 2, 4, 9, 10, 30]
    log = spark.createDataFrame([(r, f"{r}{p}", p) for r in "ab" for p in positions], "repo string, oid string, topo_pos int")
    want = {(r, f"{r}{p}", *(f"{r}{positions[j]}" if 0 <= j < len(positions) else None for j in (i + 1, i - 1))) for r in "ab" for i, p in enumerate(positions)}
    assert {tuple(r) for r in H.adjacent_pairs(log).collect()} == want
    files = ["a/b/c/x", "a/b/y", "a/z", "b/c/d", "b/c-d/e", "b.rs", "c/d/e/f/g", "c/d/h", "top"]
    dirs = sorted({f.rsplit("/", i)[0] for f in files for i in range(1, f.count("/") + 1)})
    tree = spark.createDataFrame([("r", f, "file") for f in files] + [("r", d, "directory") for d in dirs], "repo string, path string, kind string")
    order = [p for p, _ in sorted([(f, f) for f in files] + [(d, d + "/") for d in dirs], key=lambda x: x[1])]
    for marked in (["a/b/y", "c/d/h"], ["b/c/d"], [], ["top", "a/b/c/x", "b.rs"]):
        changed = spark.createDataFrame([("r", p) for p in marked], "repo string, path string")
        got = {r.path: (r.next_changed, r.previous_changed) for r in H.changed_neighbours(tree, changed).collect()}
        for i, p in enumerate(order):
            assert got[p] == (next((x for x in order[i + 1 :] if x in marked), None), next((x for x in reversed(order[:i]) if x in marked), None))


def test_fold_visibility(spark):
    tree = spark.createDataFrame([("src", "directory"), ("src/a", "file"), ("src/b/c", "file"), ("srcfoo", "file"), ("docs/x", "file")], "path string, kind string")
    folded = spark.createDataFrame([("src",)], "path string")
    assert {r.path for r in H.visible(tree, folded).collect()} == {"src", "srcfoo", "docs/x"}
    assert H.visible(tree, folded.where("false")).count() == 5


def test_filters(spark):
    log = spark.createDataFrame([("1", "Fix Parser", "Ann", "abc1234"), ("2", None, "Parse", "def"), ("3", "other", None, "pars")], "oid string, message string, author string, short_id string")
    ids = lambda df: {r.oid for r in df.collect()}
    assert ids(H.commit_filter(log, "PARS")) == {"1", "2", "3"} and ids(H.commit_filter(log, "")) == {"1", "2", "3"}
    assert ids(H.prefix_search(log, " pars ")) == {"1", "2", "3"} and ids(H.prefix_search(log, "fix parser")) == set() and ids(H.prefix_search(log, " ")) == set()
    assert [r.oid for r in H.page(log.withColumn("pos", F.col("oid").cast("int")), "pos", 1, 1).collect()] == ["2"]


def test_align(spark):
    kinds = "crraacaarrr"
    names = {"c": "context", "r": "removed", "a": "added"}
    lines = spark.createDataFrame([("f", i, names[k], f"{k}{i}") for i, k in enumerate(kinds)], "file string, pos int, kind string, content string")
    rows = H.align_diff(lines, ["file"]).orderBy("block", "row").collect()
    assert [(r.old, r.new) for r in rows] == [("c0", "c0"), ("r1", "a3"), ("r2", "a4"), ("c5", "c5"), ("r8", "a6"), ("r9", "a7"), ("r10", None)]


def test_topological_depth_is_linear(spark, bounded_cuts):
    """No step makes pairs of commits; merges take the longest way."""
    n = 3000
    edges = {str(i): [str(j) for j in (i + 2, i + 1) if j <= n] if i % 10 == 0 else [str(i + 1)] if i < n else [] for i in range(n + 1)}
    bounded_cuts(4 * n)
    assert {int(r.oid): r.depth for r in H.topological_depth(graph(spark, edges)).collect()} == {i: n - i for i in range(n + 1)}


def test_topological_depth_over_groups(spark):
    """Parents in other repositories count, missing ones do not; a circle is an error and no endless loop."""
    rows = [("a", "r1", ["b", "d"]), ("b", "r2", ["c", None]), ("c", "r3", ["d"]), ("d", "r4", None), ("x", None, ["lost"]), ("y", "r5", ["x", "d"])]
    log = spark.createDataFrame(rows, "oid string, repo string, parents array<string>")
    for group in ("repo", None):
        assert {r.oid: r.depth for r in H.topological_depth(log, group).collect()} == {"a": 3, "b": 2, "c": 1, "d": 0, "x": 0, "y": 1}
    circle = spark.createDataFrame([("a", ["b"]), ("b", ["a"]), ("c", ["a"])], "oid string, parents array<string>")
    with pytest.raises(Exception, match="3 commits are their own ancestors"):
        H.topological_depth(circle).collect()
