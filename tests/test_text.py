from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.linediff import diff_lines, edit_script
from loomline.functions.symbols import scan_symbols
from loomline.operators import grammar


def one(spark, make, *values):
    names = [f"c{i}" for i in range(len(values))]
    row = spark.range(1).select(*(F.lit(v).alias(n) for v, n in zip(values, names, strict=True)))
    return row.select(make(*(F.col(n) for n in names)).alias("x")).collect()[0].x


@pytest.mark.parametrize(("raw", "split"), [("BuildIndex", "Build Index"), ("HTTPServer", "HTTPServer"), ("Rev2", "Rev 2"), ("a", "a"), ("", ""), ("한글Aa1", "한글Aa 1"), ("bm25_search", "bm 25_search")])
def test_camel_case(spark, raw, split):
    assert one(spark, T.split_camel_case, raw) == split == grammar.split_camel_case(raw)


def test_paths(spark):
    assert one(spark, T.path_to_terms, r"src/search/bm25.rs\x-y_zAb") == "src search bm 25 rs x y z Ab"
    assert one(spark, T.korean_aliases, "src/search/indexer.rs") == "검색 인덱스 인덱서"
    assert one(spark, T.korean_aliases, "src/research.rs") == ""
    assert one(spark, T.path_depth, "a/b/c/") == 2
    assert [one(spark, T.language, p) for p in ("a/b.rs", "x.S", "x.s", ".bashrc", "Makefile", "a.tsx", "a.RS")] == ["rust", "asm", "asm", None, None, "tsx", None]


def test_messages(spark):
    m = "\u00a0Title here \n\n body\nmore  "
    assert one(spark, T.message_title, m) == "Title here"
    assert one(spark, T.message_body, m) == "body\nmore"
    assert one(spark, T.message_body, "only") == ""
    subject, rest = T.display_split(F.lit("a\nb\n\nc"))
    assert tuple(spark.range(1).select(subject, rest).collect()[0]) == ("a\nb", "c")


def test_bigrams_and_words(spark):
    assert one(spark, T.bigrams, "A b👀c") == ["a ", " b", "b👀", "👀c"]
    assert one(spark, T.bigrams, "x") == [] == one(spark, T.bigrams, "")
    assert one(spark, T.words, "Größe_1 한글!x") == ["größe", "1", "한글", "x"]
    assert one(spark, T.has_hangul, "가") and not one(spark, T.has_hangul, "abc日本")


def test_truncation_keeps_characters(spark):
    for s in ("가" * 10, "a" + "가" * 10, "ab" + "é" * 20, "x" * 40, "👀" * 9):
        for n in (1, 5, 8, 9, 30):
            raw = s.encode()[:n]
            assert one(spark, lambda c, n=n: T.truncate_bytes(c, n), s) == raw.decode("utf-8", "ignore")


def test_lines_and_binary(spark):
    assert [one(spark, T.line_count, s) for s in ("", "a", "a\n", "a\nb", "\n")] == [0, 1, 1, 2, 1]
    assert one(spark, T.is_binary, bytearray(b"ab\x00c")) and not one(spark, T.is_binary, bytearray(b"a\x10\x0bb"))
    assert not one(spark, T.is_binary, bytearray(b"a" * 8000 + b"\x00"))


def test_normalize(spark):
    v = one(spark, T.l2_normalize, [3.0, 4.0])
    assert v == pytest.approx([0.6, 0.8])
    assert one(spark, T.l2_normalize, [0.0, 0.0]) == [0.0, 0.0]


def brute_distance(a, b):
    d = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) + 1):
        for j in range(len(b) + 1):
            if i == 0 or j == 0:
                d[i][j] = i + j
            else:
                d[i][j] = d[i - 1][j - 1] if a[i - 1] == b[j - 1] else 1 + min(d[i - 1][j], d[i][j - 1])
    return d[-1][-1]


def test_edit_scripts_are_shortest():
    import random

    rng = random.Random(3)
    for _ in range(400):
        a = [rng.choice("abc") for _ in range(rng.randrange(12))]
        b = [rng.choice("abc") for _ in range(rng.randrange(12))]
        script = edit_script(a, b)
        assert [a[i] for k, i, _ in script if k != "added"] == a
        assert [b[j] for k, _, j in script if k != "removed"] == b
        assert all(a[i] == b[j] for k, i, j in script if k == "context")
        assert sum(k != "context" for k, _, _ in script) == brute_distance(a, b)


def test_diff_lines_have_context():
    old = "\n".join(str(i) for i in range(20)) + "\n"
    new = old.replace("10\n", "ten\n")
    rows = diff_lines(old, new)
    assert [r[1] for r in rows] == ["context"] * 3 + ["removed", "added"] + ["context"] * 3
    assert diff_lines(old, old) == [] and diff_lines(None, None) == []
    assert [r[1] for r in diff_lines(None, "a\nb")] == ["added", "added"]


RUST = '''// fn not_me() {}
pub fn alpha(x: i32) -> i32 {
    let s = "} fn no() {";
    fn nested() {}
    x
}
struct Unit;
pub struct Point { x: i32 }
enum Kind { A, B }
pub trait Shape { fn area(&self) -> f64; fn name(&self) -> String { "x".into() } }
impl Point {
    pub fn new() -> Self { Point { x: 0 } }
}
type Alias = Vec<u8>;
'''


def names(source, lang):
    return [(s[0], s[1]) for s in scan_symbols(source, lang)]


def test_symbols():
    assert names(RUST, "rust") == [("function", "alpha"), ("struct", "Unit"), ("struct", "Point"), ("enum", "Kind"), ("trait", "Shape"), ("method", "area"), ("method", "name"), ("method", "new"), ("typealias", "Alias")]
    for kind, name, a, b, start, end in scan_symbols(RUST, "rust"):
        text = RUST.encode()[start:end].decode()
        assert name in text and RUST.encode()[:start].count(b"\n") + 1 == a and b >= a, kind
    assert names("def a():\n  def b(): pass\nclass C:\n  def m(self): pass\n", "python") == [("function", "a"), ("class", "C")]
    assert names("def broken(:\n", "python") == []
    assert names("function a() {}\nclass B {}\nconst c = () => { return 1; };\nconst d = 5;\nlet e = function() {};\n", "javascript") == [("function", "a"), ("class", "B"), ("function", "c"), ("function", "e")]
    assert names("export function a() {}\ninterface I { x: number }\ntype T = string;\nclass K {}\n", "typescript") == [("function", "a"), ("struct", "I"), ("struct", "T"), ("class", "K")]
    assert names("func Free() {}\nfunc (r *Repo) Open() error { return nil }\ntype Repo struct { a int }\n", "go") == [("function", "Free"), ("method", "Open"), ("struct", "Repo")]
    assert names("func f() {}\nclass C {}\nstruct S {}\nenum E {}\nprotocol P {}\ntypealias T = Int\nextension S {}\n", "swift") == [("function", "f"), ("class", "C"), ("struct", "S"), ("enum", "E"), ("trait", "P"), ("typealias", "T"), ("other", "S")]
    assert scan_symbols("x", "java") == []


def test_grammar():
    assert grammar.extract_path_filter('a path:"x/y" b') == ("x/y", "a b")
    assert grammar.extract_path_filter('path:"x"') == ("x", "")
    assert grammar.extract_path_filter('a path:"x') == (None, 'a path:"x')
    p = grammar.parse("+must -never title:word^2 x AND y")
    assert [(n.number, n.parent, n.occur) for n in p.nodes] == [(0, -1, "must"), (1, -1, "not"), (2, -1, "should"), (3, -1, "should"), (4, 3, "must"), (5, 3, "must")]
    assert [(g.field, g.weight) for g in p.groups if g.number == 2] == [("title", 4.0)]
    assert grammar.parse('bad "quote') is None and grammar.parse("(open") is None and grammar.parse("nofield:x") is None
    assert {g.field for g in grammar.parse("검색").groups} == {"title", "path_terms"}
    assert [g.terms for g in grammar.parse("AbcDef").groups if g.field == "path_terms"] == [("abc", "def")]
    assert grammar.parse("").groups == []
