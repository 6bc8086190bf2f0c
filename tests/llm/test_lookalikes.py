from __future__ import annotations

import random

import pytest

from loomline.llm.lookalikes import PART_ROWS, Field, consistent_form, consistent_values, lookalike_pairs, tables


@pytest.fixture(scope="module")
def t(spark):
    return tables(spark)


SAME = [
    ("paypal", "pаypаl"), ("fix model", "ｆｉx ⅿodel"), ("été", "été"), ("バッチ", "ﾊﾞｯﾁ"), ("a b", "a b"), ("a b", "a　b"), ("ab", "a​b﻿­"),
    ("Kelvin", "Kelvin"), ("проверка сор", "пpовepка cop"), ("token", "tοken"), ("리", "리"), ("III", "Ⅲ"), ("file", "ﬁle"), ("x\ny", "x\r\ny"), ("プロセス", "プ口セス"), ("queue", "ԛueue"), ("index queue", "іndех ԛuеuе"),
]
DIFFERENT = [
    ("a", "A"), ("e", "é"), ("é", "è"), ("a b", "a  b"), ("x2", "x²"), ("3", "③"), ("ß", "ss"), ("l", "I"), ("l", "1"), ("O", "0"), ("I", "1"), ("rn", "m"), ("i", "ı"), ("σ", "o"), ("г", "r"), ("п", "n"),
    ("👩‍💻", "👩💻"), ("З", "3"), ("d", "đ"), ("a", "ɑ"), ("…", "..."),
]


@pytest.mark.parametrize(("a", "b"), SAME)
def test_same(t, a, b):
    assert consistent_form(a, t)[0] == consistent_form(b, t)[0]


@pytest.mark.parametrize(("a", "b"), DIFFERENT)
def test_different(t, a, b):
    assert consistent_form(a, t)[0] != consistent_form(b, t)[0]


def test_script_is_chosen(t):
    assert consistent_form("рrоverka", t) == ("proverka", 1, 0)
    assert consistent_form("cop", t)[0] == "cop"
    assert consistent_form("это cop и ещё", t)[0] == "это сор и ещё"
    assert consistent_form("空のベクトルへ", t)[0] == "空のベクトルへ"
    assert consistent_form("人口", t)[0] == "人口"


def test_form_is_stable_and_depends_on_looks_only(t):
    rng = random.Random(5)
    alphabet = "abcehopxyАВЕКМНОРСТаеорсухіјё пдж é한へヘロ口ｗＡ１２③ⅳ​  -_.,👩‍💻"
    for _ in range(400):
        s = "".join(rng.choice(alphabet) for _ in range(rng.randrange(12)))
        form = consistent_form(s, t)[0]
        assert consistent_form(form, t)[0] == form
        other = "".join(t.members[t.classes[c]][rng.choice(sorted(t.members[t.classes[c]]))] if c in t.classes and rng.random() < 0.5 else c for c in s)
        assert consistent_form(other, t)[0] == form


def test_operator_cases(spark):
    rows = [(1, "tоken"), (1, "tоken"), (2, "token"), (3, "token"), (4, None), (None, "token"), (5, ""), (6, ""), (7, "x" * 200_000 + "а"), (8, "x" * 200_000 + "a"), (9, "Token")]
    df = spark.createDataFrame([(*r, "f", "v") for r in rows], "id long, text string, form string, value string")
    values = consistent_values([Field(df, "id", "text", "t")])
    assert values.where("id IS NULL OR value IS NULL").count() == 0
    assert {(r.id_a, r.id_b) for r in lookalike_pairs(values).collect()} == {(1, 2), (1, 3), (7, 8)}
    assert lookalike_pairs(consistent_values([Field(df.where("false"), "id", "text", "t")])).count() == 0


def test_pairs_against_brute_force(spark, t):
    rng = random.Random(11)
    words = ["cop", "token", "cache", "modal"]
    rows = []
    for i in range(120):
        w = rng.choice(words)
        rows.append((i, "".join(t.members[t.classes[c]].get(rng.choice(["Latn", "Cyrl", "Grek"]), c) if c in t.classes and rng.random() < 0.2 else c for c in w)))
    df = spark.createDataFrame(rows, "id long, text string")
    found = {(r.id_a, r.id_b) for r in lookalike_pairs(consistent_values([Field(df, "id", "text", "t")])).collect()}
    form = {i: consistent_form(s, t)[0] for i, s in rows}
    text = dict(rows)
    assert found == {(a, b) for a in text for b in text if a < b and form[a] == form[b] and text[a] != text[b]}


def test_a_spelling_of_a_third_of_all_rows(spark):
    """The records of the hot spelling are joined in parts; all pairs come out, each once."""
    n = 3 * PART_ROWS
    rows = spark.range(n).selectExpr("id", f"CASE WHEN id < {n // 3 + 10} THEN 'token' WHEN id < {n // 3 + 12} THEN 'tоken' ELSE concat('other ', id) END AS text")
    found = lookalike_pairs(consistent_values([Field(rows, "id", "text", "t")]))
    assert found.count() == found.distinct().count() == 2 * (n // 3 + 10)
