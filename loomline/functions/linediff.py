"""Line diffs: a shortest edit script (Myers 1986, linear-space variant) with context lines."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _middle(a: list[int], b: list[int]) -> tuple[int, int, int, int]:
    """The middle snake of a shortest edit script: (x, y) begin and (u, v) end, found from both ends at once."""
    n, m = len(a), len(b)
    delta = n - m
    forward, backward = {1: 0}, {1: 0}
    for d in range((n + m + 1) // 2 + 1):
        for k in range(-d, d + 1, 2):
            x = forward[k + 1] if k == -d or k != d and forward[k - 1] < forward[k + 1] else forward[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[x] == b[y]:
                x, y = x + 1, y + 1
            forward[k] = x
            if delta % 2 and abs(k - delta) < d and x + backward.get(delta - k, -1) >= n and delta - k in backward:
                return x0, y0, x, y
        for k in range(-d, d + 1, 2):
            x = backward[k + 1] if k == -d or k != d and backward[k - 1] < backward[k + 1] else backward[k - 1] + 1
            y = x - k
            x0, y0 = x, y
            while x < n and y < m and a[n - 1 - x] == b[m - 1 - y]:
                x, y = x + 1, y + 1
            backward[k] = x
            if not delta % 2 and abs(delta - k) <= d and delta - k in forward and forward[delta - k] + x >= n:
                return n - x, m - y, n - x0, m - y0
    raise AssertionError("no edit script")


def edit_script(a: list, b: list) -> list[tuple[str, int, int]]:
    """(kind, index in a, index in b) of every line in order: context, removed and added; -1 where it has none."""
    codes: dict = {}
    x = [codes.setdefault(line, len(codes)) for line in a]
    y = [codes.setdefault(line, len(codes)) for line in b]
    out: list[tuple[str, int, int]] = []
    work = [(0, len(x), 0, len(y))]
    while work:
        i, n, j, m = work.pop()
        if i >= 0 and (n - i == 0 or m - j == 0):
            out += [("removed", k, -1) for k in range(i, n)] + [("added", -1, k) for k in range(j, m)]
            continue
        head = 0
        while i + head < n and j + head < m and x[i + head] == y[j + head]:
            head += 1
        out += [("context", i + k, j + k) for k in range(head)]
        i, j = i + head, j + head
        tail = 0
        while n - tail > i and m - tail > j and x[n - tail - 1] == y[m - tail - 1]:
            tail += 1
        if tail:
            work.append((n - tail, n, m - tail, m))
        n, m = n - tail, m - tail
        if i == n or j == m:
            out += [("removed", k, -1) for k in range(i, n)] + [("added", -1, k) for k in range(j, m)]
            continue
        p, q, u, v = _middle(x[i:n], y[j:m])
        work += [(i + u, n, j + v, m)]
        if u > p:
            work.append((i + p, i + u, j + q, j + v))
        work.append((i, i + p, j, j + q))
    return out


def diff_lines(old: str | None, new: str | None, context: int = 3) -> list[tuple[int, str, int | None, int | None, str]]:
    """(pos, kind, old_no, new_no, content) of a diff with context lines around changes; numbers count from 1.
    A missing side is an empty file; equal texts have no diff. Line ends are not part of the content."""
    a = [] if not old else old.removesuffix("\n").split("\n")
    b = [] if not new else new.removesuffix("\n").split("\n")
    script = edit_script(a, b)
    near = [False] * len(script)
    for i, (kind, _, _) in enumerate(script):
        if kind != "context":
            for k in range(max(0, i - context), min(len(script), i + context + 1)):
                near[k] = True
    rows = []
    for i, (kind, x, y) in enumerate(script):
        if near[i]:
            rows.append((len(rows), kind, x + 1 if x >= 0 else None, y + 1 if y >= 0 else None, a[x] if x >= 0 else b[y]))
    return rows


def line_diff(pairs: DataFrame, key: str, old: str = "old", new: str = "new", context: int = 3) -> DataFrame:
    """(key, pos, kind, old_no, new_no, content) of the diff of each pair of texts, one row a line."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, a, b in zip(batch["k"], batch["a"], batch["b"], strict=True) for r in diff_lines(a, b, context)]
            out = pd.DataFrame(rows, columns=["k", "pos", "kind", "old_no", "new_no", "content"])
            yield out.astype({"old_no": "Int32", "new_no": "Int32"})

    source = pairs.select(F.col(key).alias("k"), F.col(old).alias("a"), F.col(new).alias("b"))
    schema = f"k {dict(source.dtypes)['k']}, pos int, kind string, old_no int, new_no int, content string"
    return source.mapInPandas(run, schema).withColumnRenamed("k", key)
