from __future__ import annotations

import random
import re
from collections import Counter

import pyarrow as pa
import pytest

from loomline.llm.termfreq import _scan_runs, marked_terms, term_frequencies


def test_against_brute_force(spark):
    rng = random.Random(2)
    texts = {i: " ".join(rng.choice(["the", "Index", "é1", "x_y", "rare%d" % rng.randrange(40)]) for _ in range(rng.randrange(15))) for i in range(80)}
    rows = [(i, s, "c", "f") for i, s in texts.items()] + [(i, texts[i], "c", "f") for i in range(0, 80, 7)] + [(900, None, "c", "f"), (None, "the", "c", "f"), (901, "", "c", "f")]
    docs = spark.createDataFrame(rows, "id long, body string, term string, field string").repartition(5)
    records, total = Counter(), Counter()
    for s in texts.values():
        found = re.findall(r"[^\W_]+", s.lower())
        total.update(found)
        records.update(set(found))
    out = {r.term: r for r in marked_terms(docs, "id", ["body"]).collect()}
    assert {k: (r.occurrences, r.records) for k, r in out.items()} == {k: (total[k], records[k]) for k in total}
    n = len(texts) + 1
    assert all(r.mark == ("rare" if r.records < 3 else "common" if r.records > 0.1 * n else None) for r in out.values())


def test_empty_and_long(spark):
    docs = spark.createDataFrame([(1, "a " * 100_000), (2, "a")], "id long, body string")
    assert [(r.occurrences, r.records) for r in term_frequencies(docs, "id", ["body"]).collect()] == [(100_001, 2)]
    assert term_frequencies(docs.where("false"), "id", ["body"]).count() == 0


@pytest.mark.parametrize("size", [1, 2, 3, 7, 100])
def test_runs_across_batches(size):
    rows = [("f", t, i, p) for t, i, p in [("a", 1, 0), ("a", 1, 0), ("a", 1, 3), ("a", 2, 1), ("b", 2, 1), ("b", 2, 1), ("c", 1, 0), ("c", 2, 0), ("c", 3, 0)]] + [("g", "c", 3, 0)]
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("id", pa.int64()), ("place", pa.int32())])
    batches = [pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows[i : i + size]], schema) for i in range(0, len(rows), size)]
    out = Counter()
    for b in _scan_runs(iter(batches)):
        for r in b.to_pylist():
            out[r["field"], r["term"], "o"] += r["occurrences"]
            out[r["field"], r["term"], "r"] += r["records"]
    assert out == {("f", "a", "o"): 3, ("f", "a", "r"): 2, ("f", "b", "o"): 1, ("f", "b", "r"): 1, ("f", "c", "o"): 3, ("f", "c", "r"): 3, ("g", "c", "o"): 1, ("g", "c", "r"): 1}
