from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from loomline.llm.chunking import Limits, Lines, boundary_kind, cut_spans, pieces_of

L = Limits()


def pieces(raw: bytes, limits=L):
    data = np.frombuffer(raw, np.uint8)
    return pieces_of(data, Lines.of(data), limits)


def check(raw: bytes, limits=L):
    found = pieces(raw, limits)
    assert found[0][0] == found[0][1] == 0 and found[-1][2] == len(raw)
    for i, (start, own, end) in enumerate(found):
        assert end - start <= limits.largest and own - start <= limits.overlap and (own < end or not raw)
        if i:
            assert own == found[i - 1][2] and start >= found[i - 1][0]
    return found


def text(rng, kind, n):
    if kind == "lines":
        return "".join("".join(rng.choice("abc é한 ") for _ in range(rng.randrange(1, 90))) + rng.choice(["\n", "\r\n"]) for _ in range(n))
    if kind == "paragraphs":
        return "\n \n".join("\n".join("word " * rng.randrange(1, 12) for _ in range(rng.randrange(1, 10))) for _ in range(n))
    return "".join(rng.choice("abcdefgé한👀") for _ in range(n * 30))


@pytest.mark.parametrize("kind", ["lines", "paragraphs", "solid"])
def test_cover_and_limits(kind):
    rng = random.Random(4)
    for n in (80, 200, 500):
        raw = text(rng, kind, n).encode()
        found = check(raw)
        for _, own, end in found[:-1]:
            (raw[own:end]).decode()  # whole characters
            if kind == "lines":
                assert raw[end - 1 : end] == b"\n"
            if kind == "paragraphs":
                assert raw[:end].rstrip(b" ").endswith(b"\n\n") or raw[end - 1 : end] == b"\n" and raw[:end].split(b"\n")[-2].strip() == b"" or raw[end:].lstrip(b" ").startswith(b"\n")


def test_edits_stay_local():
    rng = random.Random(9)
    raw = text(rng, "lines", 3000).encode()
    before = {raw[a:b] for _, a, b in pieces(raw)}
    at = raw.index(b"\n", len(raw) // 2) + 1
    after = [(raw[:at] + b"inserted line\n" + raw[at:])[a:b] for _, a, b in pieces(raw[:at] + b"inserted line\n" + raw[at:])]
    assert sum(p not in before for p in after) <= 6 < len(after)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["x", "word ", "é", "한글 ", "👀", "\n", "\r\n", "\n \n", "\t"]), st.integers(1, 400)), max_size=40), st.sampled_from([(2048, 512, 128, 512), (2048, 1024, 128, 512), (300, 100, 40, 64), (64, 16, 0, 16)]))
def test_sizes_and_overlap(parts, sizes):
    limits = Limits(*sizes)
    raw = "".join(p * n for p, n in parts).encode()
    found = check(raw, limits)
    for start, own, end in found[:-1]:
        assert limits.smallest <= end - own
        raw[own:end].decode()


def test_a_small_paragraph_before_a_long_one():
    raw = b"a" * 300 + b"\n\n" + b"word " * 900
    found = check(raw, Limits(smallest=1024))
    assert all(1024 <= end - own for _, own, end in found[:-1])


def kind(raw: bytes):
    return boundary_kind(Lines.of(np.frombuffer(raw, np.uint8)), 2048)


def test_boundary_kind():
    assert kind(b"x" * 2048 + b"\n\t \n" + b"y" * 100) == "paragraph"
    assert kind(b"x" * 2048 + b"\r\n\r\n" + b"y" * 2048 + b"\r\n") == "paragraph"
    assert kind(b"x" * 1500 + b"\n" + b"y" * 1500) == "line"
    assert kind(b"x" * 2049 + b"\n\n" + b"y") == "inside"
    assert kind(b"\n" * 5000) == "paragraph"


def test_operator_cases(spark):
    long = "\n".join(f"line {i} " + "x" * 40 for i in range(100))
    files = spark.createDataFrame([(1, long, 9), (1, long, 8), (2, None, 1), (3, "﻿" + "é" * 3000, 1), (None, "x", 1), (4, "", 1)], "file_id long, content string, span_id int")
    spans = [
        (1, 1, 1, 100, 0, len(long)), (1, 1, 1, 100, 0, len(long)), (2, 1, 100, 1, len(long), 0), (3, 1, 1, 100, None, None), (4, 1, 1, 2, 0, 40),
        (5, 2, 1, 9, 0, 9), (6, 99, 1, 9, 0, 9), (7, 3, 1, 1, None, 5), (8, 1, 500, 900, None, None), (9, 1, 50, 9999, None, None), (10, 1, None, 5, 0, 4000),
        (11, 1, 1, 100, 5, 999999), (None, 1, 1, 100, None, None), (12, None, 1, 1, 0, 1), (13, 4, 1, 1, 0, 0), (14, 1, 1, 99, 0, len(long)),
    ]
    df = spark.createDataFrame([(*s, "c", "b") for s in spans], "span_id long, file_id long, line_start int, line_end int, byte_start long, byte_end long, content string, boundary string")
    out = {}
    for r in cut_spans(df, files, spans_at_once=2).collect():
        out.setdefault(r.span_id, []).append(r)
    assert set(out) == {1, 2, 3, 7, 9, 11, 14}
    assert len({tuple((r.piece_no, r.byte_start, r.byte_end) for r in sorted(out[i], key=lambda r: r.piece_no)) for i in (1, 2, 3, 11)}) == 1
    assert max(r.byte_end for r in out[14]) == long.rindex("\n")  # whole lines, as the bytes run on to line 100
    assert {r.boundary for r in out[7]} == {"inside"} and {r.boundary for r in out[1]} == {"line"}
    joined = "".join(r.text.encode()[r.overlap :].decode() for r in sorted(out[7], key=lambda r: r.piece_no))
    assert joined == "﻿" + "é" * 3000
    assert cut_spans(df.where("false"), files).count() == 0 and cut_spans(df, files.where("false")).count() == 0
