from __future__ import annotations

import time

import pytest

from loomline.llm.sentences import PRIOR, examples, fit, sentences, split


def units(text, weights=PRIOR):
    return [text[a:b] for a, b in split(text, weights)]


CASES = [
    ("It rose from 3.63 to 13.70. Then it fell.", ["It rose from 3.63 to 13.70.", "Then it fell."]),
    ("See Dr. Smith, e.g. on Monday. He knows.", ["See Dr. Smith, e.g. on Monday.", "He knows."]),
    ("The idea came from L. Gullum. It waits... and waits.", ["The idea came from L. Gullum.", "It waits... and waits."]),
    ("“Is it empty?” asked the reviewer. Yes!", ["“Is it empty?” asked the reviewer.", "Yes!"]),
    ("The log said \"It is stale. Run it.\" and stopped. Next.", ["The log said \"It is stale. Run it.\" and stopped.", "Next."]),
    ("(It is a copy.) Should it go?", ["(It is a copy.)", "Should it go?"]),
    ("A heading\n\nA sentence that\ngoes on. End", ["A heading", "A sentence that\ngoes on.", "End"]),
    ("Das heißt, z. B. nichts. Fall Nr. 620 ist neu.", ["Das heißt, z. B. nichts.", "Fall Nr. 620 ist neu."]),
    ("索引已过期。请重新运行！为什么？", ["索引已过期。", "请重新运行！", "为什么？"]),
    ("पुरानी है। फिर चलाएँ।", ["पुरानी है।", "फिर चलाएँ।"]),
    ("ดัชนีเก่า ตอนนี้ใหม่ ไฟล์ a.rs ไม่จำเป็น", ["ดัชนีเก่า", "ตอนนี้ใหม่", "ไฟล์ a.rs ไม่จำเป็น"]),
    ("Use `a.b. C` here. Done.", ["Use `a.b. C` here.", "Done."]),
    ("¿Está vacío?, preguntó. ¡Sí!", ["¿Está vacío?, preguntó.", "¡Sí!"]),
    ("One; two: three. Four", ["One; two: three.", "Four"]),
    ("spät.Bitte prüfe es.", ["spät.", "Bitte prüfe es."]),
    ("", []), ("  \n \n ", []), ("...", ["..."]), ("a\r\n\r\nb", ["a", "b"]),
]


@pytest.mark.parametrize(("text", "expected"), CASES)
def test_cases(text, expected):
    assert units(text) == expected


def test_positions_are_code_points_and_cover_the_text():
    text = "👀 One. 👀 Two!\n\n Drei"
    out = split(text, PRIOR)
    assert [text[a:b] for a, b in out] == ["👀 One. 👀 Two!", "Drei"] or [text[a:b] for a, b in out] == ["👀 One.", "👀 Two!", "Drei"]
    covered = {i for a, b in out for i in range(a, b)}
    assert all(text[i].isspace() for i in range(len(text)) if i not in covered)


def test_training_learns_an_unknown_abbreviation():
    docs = []
    for i in range(400):
        a, b = f"W{'abcdefgh'[i % 8]}rd", f"V{'xyz'[i % 3]}rt"
        docs.append(f"The {a} met Xq. {b} again. It held.\n\nSome {b} ran away. All is {a.lower()} again.\n\nIt held. They ran away.\n\nLast one {i}.")
    counts = {}
    for d in docs:
        for label, feats, keys in examples(d):
            key = (label, "\x1f".join(feats), "\x1e".join("\x1f".join(k) for k in keys))
            counts[key] = counts.get(key, 0) + 1
    model = fit(sorted((*k, n) for k, n in counts.items()))
    assert units("He met Xq. Vert again. It held. Then he ran away. All is well.", model) == ["He met Xq. Vert again.", "It held.", "Then he ran away.", "All is well."]


def test_operator_cases(spark):
    rows = [(1, None), (2, ""), (3, "One. Two."), (3, "One. Two."), (None, "x."), (4, "A word " * 50_000 + ". End")]
    df = spark.createDataFrame([(*r, 0, "s") for r in rows], "doc_id long, text string, sentence_no int, sentence string")
    out = [(r.doc_id, r.sentence_no, r.char_start, r.char_end) for r in sentences(df).collect()]
    assert sorted(o for o in out if o[0] == 3) == [(3, 0, 0, 4), (3, 0, 0, 4), (3, 1, 5, 9), (3, 1, 5, 9)]
    assert {o[0] for o in out} == {3, 4} and len([o for o in out if o[0] == 4]) == 2
    assert sentences(df.where("false")).count() == 0


def test_endless_tokens_take_linear_time():
    """Texts without a space, or without a letter, of hundreds of thousands of marks."""
    for text in ("“" + "It is. " * 40_000 + "”", "a.b" * 200_000, "1." * 300_000, "。1" * 100_000, "x" * 500_000 + ". Y"):
        began = time.perf_counter()
        found = split(text, PRIOR)
        assert "".join(text[a:b] for a, b in found) .replace(" ", "") == text.replace(" ", "") and time.perf_counter() - began < 30
