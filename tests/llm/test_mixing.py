from __future__ import annotations

import math
from collections import Counter

import pytest

from loomline.llm.mixing import capped_mean, mix, mix_report, poisson_rate, poisson_window


def test_poisson_inversion():
    for cap in (1, 2, 4, 10):
        for share in (0.01, 0.3, 0.7, 0.99):
            assert capped_mean(poisson_rate(share * cap, cap), cap) == pytest.approx(share * cap, rel=1e-6)
    assert poisson_rate(0, 3) == 0.0 and poisson_rate(3, 3) == math.inf and poisson_rate(1, 0) == 0.0


def test_large_means():
    for target, cap in ((900, 2000), (5000, 5100), (3, 10**9), (699.5, 700)):
        assert capped_mean(poisson_rate(target, cap), cap) == pytest.approx(target, rel=1e-9)
    first, cdf = poisson_window(900.0, 2000)
    assert first < 700 and len(cdf) < 700 and cdf[900 - first] == pytest.approx(0.5, abs=0.02) and cdf[-1] == pytest.approx(1.0)
    assert poisson_window(math.inf, 3) == (3, []) and poisson_window(0.0, 3)[1] == [1.0] and poisson_window(0.0, 0) == (0, [])


def test_draws_at_mean_900(spark):
    docs = spark.createDataFrame([(i, f"text {i:04d}", "a") for i in range(300)], "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2000)], "source string, weight double, max_repeats int")
    drawn = mix(docs, targets, budget_tokens=900 * 300 * 9).groupBy("doc_id").count().collect()
    counts = [r["count"] for r in drawn]
    assert len(counts) == 300 and sum(counts) / 300 == pytest.approx(900, rel=0.001)
    assert 20 < (sum((c - 900) ** 2 for c in counts) / 300) ** 0.5 < 40


def test_the_report_is_drawn(spark):
    docs, targets = tables(spark, 60)
    plan = mix_report(docs, targets)._jdf.queryExecution().optimizedPlan().toString()
    assert "xxhash64" in plan and "filter" in plan.lower()


def tables(spark, n=3000):
    rows = [(i, f"{'abc'[i % 3]} text {i} " + "x" * (i * 13 % 200), [" A", "b ", "C"][i % 3]) for i in range(n)]
    rows += [(n + 1, None, "a"), (n + 2, "", "b"), (n + 3, "lost", None), (n + 4, "lost", "other")]
    docs = spark.createDataFrame([(*r, 1, 1.0) for r in rows], "doc_id long, text string, source string, repeats int, weight double")
    targets = spark.createDataFrame([("a", 1.0, 1), ("B", 2.0, 2), ("c", 5.0, 1), ("none", 1.0, 4), (None, 1.0, 1), ("neg", -1.0, 1), ("nul", None, None)], "source string, weight double, max_repeats int")
    return docs, targets


def test_shares(spark):
    docs, targets = tables(spark)
    report = {r.source: r for r in mix_report(docs, targets).collect()}
    assert set(report) == {"a", "B", "c", "none", "neg", "nul"}
    assert report["a"].target_share == pytest.approx(1 / 9)
    for s in ("a", "B"):
        assert report[s].drawn_tokens == pytest.approx(report[s].target_tokens, rel=0.01) and not report[s].short
    assert report["c"].short and report["c"].drawn_tokens == report["c"].capacity_tokens
    assert report["none"].short and report["none"].drawn_tokens == 0 and not report["neg"].short
    assert sum(r.actual_share for r in report.values()) == pytest.approx(1.0)


def test_draws(spark):
    docs, targets = tables(spark)
    drawn = mix(docs, targets).collect()
    uses = Counter(r.doc_id for r in drawn)
    limit = {"a": 1, "B": 2, "c": 1}
    assert all(uses[r.doc_id] <= limit[r.source] for r in drawn)
    assert {r.source for r in drawn} == {"a", "B", "c"}
    keys = [r.shuffle_key for r in drawn]
    assert keys == sorted(keys)
    again = mix(docs.repartition(7), targets).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, drawn))
    other = {(r.doc_id, r.repeat_no) for r in mix(docs, targets, seed=7).where("source = 'B'").collect()}
    assert other != {(r.doc_id, r.repeat_no) for r in drawn if r.source == "B"}


def test_equal_texts_share_their_limit(spark):
    rows = [(i, f"t{i % 5}", s) for i, s in enumerate(["a", "b"] * 50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    targets = spark.createDataFrame([("a", 1.0, 2), ("b", 1.0, 3)], "source string, weight double, max_repeats int")
    uses = Counter()
    text = {i: t for i, t, _ in rows}
    for r in mix(docs, targets, budget_tokens=10**6).collect():
        uses[text[r.doc_id]] += 1
    assert uses == {f"t{i}": 3 for i in range(5)}


def test_empty(spark):
    docs, targets = tables(spark, 3)
    assert mix(docs.where("false"), targets).count() == 0 and mix(docs, targets.where("false")).count() == 0
    assert mix_report(docs.where("false"), targets).count() == 6 and mix_report(docs, targets.where("false")).count() == 0
