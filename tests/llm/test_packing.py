from __future__ import annotations

import numpy as np
import pytest

from loomline.llm.packing import container_report, pack, pack_vectors


def test_limits_hold_and_little_is_wasted():
    rng = np.random.RandomState(0)
    tokens = rng.randint(1, 2000, 1500)
    loss = (tokens * rng.rand(1500)).astype(int)
    sizes = np.column_stack([tokens, loss, np.ones(1500, int)])
    limits = np.array([4096, 3000, 8])
    bins, pos = pack_vectors(sizes, limits)
    used = np.zeros((bins.max() + 1, 3), int)
    np.add.at(used, bins, sizes)
    assert (used <= limits).all()
    assert len(used) <= 1.04 * max(np.ceil(sizes.sum(0) / limits)) + 1
    for b in range(bins.max() + 1):
        assert sorted(pos[bins == b]) == list(range((bins == b).sum()))


def test_small_cases_match_the_best():
    assert len(set(pack_vectors(np.array([[3, 3, 1], [3, 3, 1], [2, 2, 1], [2, 2, 1]]), np.array([5, 5, 9]))[0])) == 2
    assert len(set(pack_vectors(np.array([[1, 1, 1]] * 10), np.array([99, 99, 4]))[0])) == 3
    assert len(pack_vectors(np.zeros((0, 3), int), np.array([5, 5, 5]))[0]) == 0
    with pytest.raises(ValueError):
        pack_vectors(np.array([[9, 1, 1]]), np.array([5, 5, 5]))


def test_operator(spark):
    texts = [(1, None), (2, ""), (3, "x" * 4096), (4, "y" * 4097), (5, "é" * 5000), (6, "a"), (6, "a"), (None, "b"), (7, "head\n\nbody")] + [(100 + i, "z" * (37 * i % 900)) for i in range(200)]
    df = spark.createDataFrame([(*t, 1, "p") for t in texts], "doc_id long, text string, piece int, container string")
    out = pack(df, group_items=50).collect()
    got = {}
    for r in out:
        got.setdefault(r.doc_id, []).append(r)
    assert 1 not in got and len(got[2]) == 1 and len(got[3]) == 1 and len(got[6]) == 2 and len(got[None]) == 1
    assert [(r.piece, r.pieces, r.token_start, r.token_end) for r in sorted(got[4], key=lambda r: r.piece)] == [(0, 2, 0, 4096), (1, 2, 4096, 4097)]
    assert sum(r.token_end - r.token_start for r in got[5]) == 10000 and len(got[5]) == 3
    assert got[7][0].loss_tokens == 4
    per = {}
    for r in out:
        per.setdefault(r.container, []).append(r)
    for rows in per.values():
        assert sum(r.token_end - r.token_start for r in rows) <= 4096 and len(rows) <= 64
        assert sorted(r.position for r in rows) == list(range(len(rows)))
    assert container_report(pack(df)).collect()[0]["items"] == len(out)
    assert pack(df.where("false")).count() == 0
    with pytest.raises(ValueError):
        pack(df, max_loss_tokens=0)


def test_all_three_limits_bind(spark):
    rng = np.random.RandomState(3)
    rows = [(i, "h" * int(rng.randint(0, 3000)) + "\n\n" + "b" * int(rng.choice([5, 400, 1500, 6000]))) for i in range(400)]
    rows += [(1000 + i, "x") for i in range(300)] + [(2000, "h" * 9000 + "\n\n" + "b" * 3000), (2001, "h" * 9000 + "\n\n"), (2002, "\n\n" + "b" * 1024), (2003, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = pack(df, max_segments=5, max_loss_tokens=1024, group_items=300).collect()
    per, of = {}, {}
    for r in out:
        per.setdefault(r.container, []).append(r)
        of.setdefault(r.doc_id, []).append(r)
    used = np.array([[sum(r.token_end - r.token_start for r in c), len(c), sum(r.loss_tokens for r in c)] for c in per.values()])
    assert (used <= [4096, 5, 1024]).all() and (used.max(axis=0) == [4096, 5, 1024]).all()
    for i, text in rows:
        found = sorted(of[i], key=lambda r: r.piece)
        head = text.find("\n\n") + 2 if "\n\n" in text else 0
        assert [r.piece for r in found] == list(range(found[0].pieces))
        assert found[0].token_start == 0 and found[-1].token_end == len(text)
        assert all(a.token_end == b.token_start for a, b in zip(found, found[1:], strict=False))
        assert all(r.loss_tokens == max(0, r.token_end - max(r.token_start, head)) for r in found)
        assert len(found) == 1 or len(text) > 4096 or len(text) - head > 1024
    assert len(of[2002]) == 1 and len(of[2001]) == 3
