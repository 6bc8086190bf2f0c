"""Spans of source text by kind, for display: comments, strings, numbers, keywords."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T

#: Texts above this many bytes are shown plain.
MAX_BYTES = 256 * 1024

_WORDS = {
    "rust": "as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while",
    "python": "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield",
    "javascript": "async await break case catch class const continue default delete do else export extends false finally for function if import in instanceof let new null of return super switch this throw true try typeof var void while yield",
    "go": "break case chan const continue default defer else fallthrough false for func go goto if import interface map nil package range return select struct switch true type var",
    "swift": "as break case catch class continue default defer do else enum extension false for func guard if import in init let nil protocol return self static struct switch throw throws true try var where while",
    "c": "break case char const continue default do double else enum extern float for goto if int long return short signed sizeof static struct switch typedef union unsigned void volatile while",
    "java": "abstract boolean break case catch class const continue default do double else enum extends false final finally float for if implements import int interface long new null package private protected public return static super switch this throw true try void while",
    "bash": "case do done elif else esac fi for function if in local return then until while",
    "json": "true false null",
    "toml": "true false",
    "yaml": "true false null",
}
_WORDS |= {"typescript": _WORDS["javascript"] + " abstract any boolean declare enum implements interface keyof namespace number private protected public readonly string type", "cpp": _WORDS["c"] + " bool catch class delete false namespace new nullptr operator private protected public template this throw true try using virtual"}
_WORDS["tsx"] = _WORDS["typescript"]
_HASH = ("python", "bash", "toml", "yaml")


def _pattern(lang: str) -> re.Pattern:
    comment = r"\#[^\n]*" if lang in _HASH else r"//[^\n]*|/\*.*?\*/"
    string = r'"""(?:.*?)"""|' if lang == "python" else ""
    string += r'"(?:\\.|[^"\\\n])*"|`[^`]*`' + ("" if lang == "rust" else r"|'(?:\\.|[^'\\\n])*'")
    words = "|".join(sorted(_WORDS[lang].split(), key=len, reverse=True))
    return re.compile(rf"(?P<comment>{comment})|(?P<string>{string})|(?P<number>\b\d[\w.]*)|(?P<keyword>\b(?:{words})\b)", re.S)


_PATTERNS = {lang: _pattern(lang) for lang in _WORDS}


def spans(source: str, lang: str | None) -> list[tuple[int, int, int, str]]:
    """(line, start, end, kind), lines from 1 and columns from 0, a span that runs over lines once for each; a text
    that is too large or of no known language has none."""
    pattern = _PATTERNS.get(lang or "")
    if pattern is None or len(source.encode("utf-8")) > MAX_BYTES:
        return []
    starts = [0, *(m.end() for m in re.finditer("\n", source))]
    out, line = [], 0
    for m in pattern.finditer(source):
        while line + 1 < len(starts) and starts[line + 1] <= m.start():
            line += 1
        at = line
        for k, part in enumerate(m[0].split("\n")):
            begin = m.start() - starts[at] if k == 0 else 0
            if part:
                out.append((at + 1, begin, begin + len(part), m.lastgroup))
            at += 1
    return out


def highlight(files: DataFrame, key: str = "file_id") -> DataFrame:
    """(key, line, start, end, kind) of all spans of all files."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *s) for k, content, lang in zip(batch["k"], batch["content"], batch["lang"], strict=True) for s in spans(content, lang)]
            yield pd.DataFrame(rows, columns=["k", "line", "start", "end", "kind"])

    source = files.where("content IS NOT NULL").select(F.col(key).alias("k"), "content", T.language(F.col("path")).alias("lang"))
    return source.mapInPandas(run, f"k {dict(source.dtypes)['k']}, line int, start int, end int, kind string").withColumnRenamed("k", key)
