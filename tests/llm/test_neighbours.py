from __future__ import annotations

from dataclasses import replace
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomline.llm import neighbours as N

DIM = 64
INDEX = N.Index(dim=DIM)
T0 = datetime(2024, 1, 1)
TYPE = "doc_id long, vec array<float>, encoded_at timestamp, rank int, code string"


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(a) for a in v], T0, 0, "c") for i, v in zip(ids, x, strict=True)], TYPE)


def clustered(n=300, groups=60, seed=0, noise=0.25):
    rng = np.random.RandomState(seed)
    centres = rng.randn(groups, DIM)
    return (centres[rng.randint(groups, size=n)] + noise * rng.randn(n, DIM)).astype(np.float32)


def brute(x, k=5):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    return s, -np.sort(-s, axis=1)[:, :k]


def test_rotation_keeps_length():
    x = np.random.RandomState(0).randn(20, 48).astype(np.float32)
    r = N.rotation(48, 3)
    assert r.shape == (48, 64)
    assert np.allclose(np.linalg.norm(x @ r, axis=1), np.linalg.norm(x, axis=1), rtol=1e-4)
    h = N.hadamard(np.eye(8, dtype=np.float32))
    assert np.allclose(h @ h.T, np.eye(8), atol=1e-5)


@pytest.mark.parametrize("index", [INDEX, replace(INDEX, cell_limit=40), replace(INDEX, sample=20)])
def test_close_neighbours_are_found(spark, index):
    x = clustered()
    s, best = brute(x)
    found = N.nearest(table(spark, x), index=index).collect()
    got = {(r.doc_id, r.neighbour): r.cosine for r in found}
    assert all(abs(c - s[a, b]) < 1e-5 for (a, b), c in got.items())
    want = [(a, b) for a in range(len(x)) for b in range(len(x)) if s[a, b] >= best[a, 4] and a != b]
    assert np.mean([p in got for p in want]) >= 0.9


@pytest.mark.parametrize("order", [1, 2, 3])
def test_vectors_meet_that_share_so_many_axes(spark, order):
    """A thousand vectors, really hashed: the candidates are those that share ``order`` axes of a table, no others."""
    x = clustered(1000, 40, noise=0.8)
    h = N.Hash(2, 6, order)
    current = N.current_vectors(table(spark, x), None, DIM, "doc_id", "vec", "encoded_at")
    u = N.unit(x)
    near = [[set(a) for a in N.nearest_axes(u, N.table_seed(INDEX, t), h.axes)] for t in range(h.tables)]
    groups = N.balanced(N.to_groups(current, INDEX, h), N.large_groups(current, INDEX, h), INDEX)
    assert groups.count() == 1000 * h.copies
    met = set()
    for rows in groups.toPandas().groupby("cell"):
        ids, axes = rows[1]["id"].to_numpy(), np.frombuffer(b"".join(rows[1]["axes"]), np.uint16).reshape(len(rows[1]), -1)
        for c in N._cells(axes, order):
            met |= {(a, b) for a in ids[c] for b in ids[c] if a < b}
    assert met == {(a, b) for a in range(1000) for b in range(a + 1, 1000) if any(len(n[a] & n[b]) >= order for n in near)}
    got = {(r.id, r.other) for r in N.candidates(groups, h, 4, 5, -1.0).collect()}
    s, _ = brute(x)
    for a in range(0, 1000, 50):
        partners = sorted((b for b in range(1000) if (min(a, b), max(a, b)) in met), key=lambda b: -s[a, b])[:5]
        # A group can be compared whole, so even better ones can have come in their place.
        fifth = (sorted((s[a, b] for i, b in got if i == a), reverse=True) + [2.0] * 5)[4]
        assert all((a, b) in got or fifth < 2 and s[a, b] < fifth + N.MARGIN for b in partners)


def test_few_pairs_meet():
    """Recall of the pairs of the wanted cosine holds, while cells become smaller parts of the collection."""
    index = N.Index()
    rng = np.random.RandomState(9)
    any_ = [rng.randn(3000, 256).astype(np.float32) for _ in range(2)]
    any_ = tuple(v / np.linalg.norm(v, axis=1, keepdims=True) for v in any_)
    for cosine, wanted, most in ((0.9, index.sure, index.sure_share), (0.45, index.recall, index.share)):
        shares = []
        for rows in (1_000, 100_000, 1_000_000, 10_000_000):
            near = N.synthetic_pairs(index, cosine)
            h = N.choose(index, rows, near, any_, wanted, most)
            shared = N.shared_axes(*near, index, h.tables, (h.axes,))[h.axes]
            assert (shared >= h.order).any(axis=0).mean() >= wanted
            shares.append((N.shared_axes(*any_, index, h.tables, (h.axes,))[h.axes] >= h.order).any(axis=0).mean())
        assert max(shares) <= most and shares[-1] <= shares[0]


def test_least_cosine_is_a_filter(spark):
    x = clustered(noise=0.1)
    s, best = brute(x)
    want = {(a, b) for a, b in np.argwhere(s >= np.maximum(best[:, 4:5], 0.9))}
    cut = {(r.doc_id, r.neighbour) for r in N.nearest(table(spark, x), index=INDEX, least_cosine=0.9).collect()}
    assert want == cut and want


def test_copies_ties_and_dirty_rows(spark):
    rng = np.random.RandomState(2)
    base = rng.randn(3, DIM)
    rows = [(i, [float(a) for a in base[0]], T0) for i in range(40)]  # copies of one vector
    rows += [(100, [float(a) for a in base[0] + 0.01 * base[1]], T0), (101, [float(a) for a in base[1]], T0)]
    rows += [(102, [float(a) for a in base[0]], T0), (102, [float(a) for a in base[2]], T0 + timedelta(1)), (102, [float(a) for a in base[2]], T0 + timedelta(1))]
    rows += [(103, [float(a) for a in base[0]], T0), (103, None, T0 + timedelta(1)), (104, [1.0], T0), (105, [0.0] * DIM, T0), (106, [float("nan")] * DIM, T0), (107, [float("inf")] * DIM, None), (None, [1.0] * DIM, T0)]
    rows += [(108, [float(a) for a in base[0]], None), (109, [None] * DIM, T0), (110, [1e30 * float(a) for a in base[1]], T0)]
    df = spark.createDataFrame([(*r, 0, "c") for r in rows], TYPE)
    keep = spark.createDataFrame([(i,) for i in range(120) if i != 7] + [(None,)], "doc_id long")
    out = {}
    for r in N.nearest(df, keep, index=INDEX).collect():
        out.setdefault(r.doc_id, []).append((r["rank"], r.neighbour, round(r.cosine, 4)))
    assert set(out) <= {*range(40), 100, 101, 102, 108, 110} - {7}
    assert [n for _, n, _ in sorted(out[3])] == [0, 1, 2, 4, 5] and all(c == 1.0 for _, _, c in out[3])
    assert [n for _, n, _ in sorted(out[100])] == [0, 1, 2, 3, 4]
    assert sorted(out[110])[0][1] == 101 and sorted(out[101])[0][1] == 110
    pairs = {(r.id_a, r.id_b) for r in N.similar_pairs(N.nearest(df, keep, index=INDEX), 0.9).collect()}
    assert (0, 1) in pairs and (101, 110) in pairs and all(a < b for a, b in pairs)
    assert N.nearest(df.where("false"), index=INDEX).count() == 0
    assert N.nearest(df.where("doc_id = 101"), index=INDEX).count() == 0


def grouped(spark, x, index, order=1):
    """All vectors in one group, as its only cell."""
    later = np.full((len(x), 3), N.NO_AXIS, np.uint16)
    later[:, : order - 1] = 9
    rows = [(7, i, bytes(c), bytes(a)) for i, (c, a) in enumerate(zip(N._small(N.unit(x)), later, strict=True))]
    groups = spark.createDataFrame(rows, "cell long, id long, small binary, axes binary")
    return N.balanced(groups, spark.createDataFrame([(7, len(x))] if len(x) > index.cell_limit else [], "cell long, rows long"), index)


@pytest.mark.parametrize("order", [1, 2])
def test_large_cells_are_compared_whole(spark, order):
    """A topic of a third of all vectors, in a cell far beyond the limit: all pairs of the cell meet."""
    rng = np.random.RandomState(4)
    x = rng.randn(600, DIM)
    x[::3] = rng.randn(DIM) + 0.6 * rng.randn(200, DIM)
    whole = grouped(spark, x, N.Index(dim=DIM, cell_limit=64), order)
    met = {(a, b) for r in whole.groupBy("cell", "block_a", "block_b").agg(F.collect_list("id").alias("ids")).collect() for a in r.ids for b in r.ids if a < b}
    assert len(met) == 600 * 599 // 2
    s, best = brute(x)
    pairs = {(r.id, r.other) for r in N.candidates(whole, N.Hash(1, 4, order), 4, 10, -1.0).collect()}
    assert all((a, b) in pairs for a, b in np.argwhere(s >= best[:, 4:5]))


@pytest.mark.parametrize("least", [-1.0, 0.5])
def test_true_neighbours_of_nearly_equal_cosine_are_candidates(spark, least):
    """In a tight topic more than a few partners are as good as the best by the 6-bit cosine; none may fall out."""
    rng = np.random.RandomState(8)
    x = rng.randn(256) + 0.2 * rng.randn(1500, 256)
    s, best = brute(x)
    index = N.Index()
    got = {(r.id, r.other) for r in N.candidates(grouped(spark, x, index), N.Hash(1, 4, 1), 4, 5, least).collect()}
    assert all((a, b) in got for a, b in np.argwhere(s >= best[:, 4:5]))


def test_the_6_bit_cosine_is_within_the_margin():
    x = np.random.RandomState(5).randn(3000, 256)
    u, v = N.unit(x), N._from_small([bytes(c) for c in N._small(N.unit(x))])
    assert np.abs((u[:1500] * u[1500:]).sum(1) - (v[:1500] * v[1500:]).sum(1)).max() < N.MARGIN / 1.2


def test_search_in_blocks_is_exact(spark):
    rng = np.random.RandomState(10)
    x = (rng.randn(DIM) + 0.05 * rng.randn(800, DIM)).astype(np.float32)
    s, best = brute(x.astype(np.float64))
    current = N.current_vectors(table(spark, x), None, DIM, "doc_id", "vec", "encoded_at")
    got = {(r.id_a, r.id_b) for r in N.search_blocks(current.where("id < 100"), current, DIM, 5, 300).collect()}
    assert all((min(a, b), max(a, b)) in got for a, b in np.argwhere(s >= best[:, 4:5]) if a < 100)
