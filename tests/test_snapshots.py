from __future__ import annotations

import random

from loomline.operators.snapshots import file_changes

TYPE = "repo string, snapshot_no int, delivery_no int, path string, kind string, mode string, blob_oid string, size long, `key` string, _g string"


def rows(spark, data):
    return spark.createDataFrame([(*r, None, "k", "g") for r in data], TYPE)


def changes(spark, data, **options):
    return sorted((r.repo, r.snapshot_no, r.path, r.change) for r in file_changes(rows(spark, data), **options).collect())


def test_added_modified_deleted_and_renamed(spark):
    data = [
        ("a", 1, 1, "keep", "file", "100644", "x"), ("a", 1, 1, "edit", "file", "100644", "x"), ("a", 1, 1, "gone", "file", "100644", "x"),
        ("a", 1, 1, "run", "file", "100644", "x"),
        ("a", 3, 1, "./keep", "file", "100644", "X"), ("a", 3, 1, "edit", "file", "100644", "y"), ("a", 3, 1, "new", "file", "100644", "x"),
        ("a", 3, 1, "run", "file", "100755", "x"), ("a", 3, 1, "d", "directory", "040000", None),
    ]
    assert changes(spark, data) == [("a", 3, "edit", "modified"), ("a", 3, "gone", "deleted"), ("a", 3, "new", "added"), ("a", 3, "run", "modified")]


def test_dirty_rows_have_a_defined_result(spark):
    data = [
        ("a", 1, None, "old", "file", "1", "x"), ("a", 1, 1, "p", "file", "1", "x"), ("a", 1, 1, "p", "file", "1", "x"),
        ("a", 2, 1, "p", "file", "1", "late"), ("a", 2, 2, "p", "file", "1", "x"), (None, 2, 1, "p", "file", "1", "x"),
        ("a", None, 1, "p", "file", "1", "x"), ("a", 2, 2, None, "file", "1", "x"), ("b", 1, 1, "q", "file", "1", None),
        ("b", 2, 1, "q", "file", "1", None), ("b", 3, 1, "only/dir", "directory", "0", None),
    ]
    assert changes(spark, data) == [("b", 3, "q", "deleted")]
    assert changes(spark, data, broadcast_rows=0) == [("b", 3, "q", "deleted")]
    assert changes(spark, []) == []


def test_against_brute_force(spark):
    rng = random.Random(7)
    data = []
    for repo in "abc":
        for no in sorted(rng.sample(range(20), 6)):
            for delivery in range(rng.choice([1, 1, 2])):
                for p in rng.sample(range(30), 20):
                    data.append((repo, no, delivery, rng.choice(["", "./"]) + f"src/f{p}", "file", "1", rng.choice(["x", "X", "y"])))
    expected = []
    for repo in "abc":
        snaps = {}
        for no in {r[1] for r in data if r[0] == repo}:
            last = max(r[2] for r in data if r[:2] == (repo, no))
            snaps[no] = {r[3].removeprefix("./"): r[6].lower() for r in data if r[:3] == (repo, no, last)}
        ordered = sorted(snaps)
        for a, b in zip(ordered, ordered[1:], strict=False):
            for p in snaps[a].keys() | snaps[b].keys():
                if snaps[a].get(p) != snaps[b].get(p):
                    expected.append((repo, b, p, "added" if p not in snaps[a] else "deleted" if p not in snaps[b] else "modified"))
    assert changes(spark, data) == sorted(expected)
