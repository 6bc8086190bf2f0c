"""Sentence boundaries across languages and scripts, by a maximum-entropy classifier trained on the input itself."""

from __future__ import annotations

import functools
import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents, at most about this many, from which the classifier is fitted (those with the lowest hash of the id).
TRAIN_DOCS = 8000

_BLANK = regex.compile(r"(?:\r\n?|\n)(?:[^\S\r\n]*(?:\r\n?|\n))+")
_MARKS = regex.compile(r"[.!?…\p{Sentence_Terminal}]+")
_THAI_GAP = regex.compile(r"(?<=\p{Thai})[^\S\r\n]+(?=\p{Thai})")
_QUOTES = regex.compile("[\"“”„«»()\\[\\]{}`（）「」『』【】《》〈〉‹›‚‘]")
_OPENERS = {"“": "”", "„": "“”", "«": "»", "(": ")", "[": "]", "{": "}", "（": "）)", "「": "」", "『": "』", "【": "】", "《": "》", "〈": "〉", "‹": "›"}
_SPACED_CLOSER = regex.compile(r"[^\S\r\n]?[»›]")
# These two match backwards from where they are asked to end.
_LEFT = regex.compile(r"(?r)(?:[^\s\"“”„«»()（）「」『』\[\]{}`、，,;；:：!?…。！？।؟]|(?<=\d),(?=\d))+")
_AFTER_CJK = regex.compile(r"(?r)[^\p{Han}\p{Hiragana}\p{Katakana}ー]+")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー]")
_LETTER = regex.compile(r"\p{L}")
_RIGHT = regex.compile(r"[\p{L}\p{M}\p{N}_]+(?:[.\-/][\p{L}\p{N}_]+)*")
_DIGITS = regex.compile(r"\d+")
_SCRIPTS = [(n, regex.compile(rf"[{p}]")) for n, p in (("L", r"\p{Latin}"), ("C", r"\p{Cyrillic}"), ("H", r"\p{Hangul}"), ("Z", r"\p{Han}"), ("J", r"\p{Hiragana}\p{Katakana}ー"), ("D", r"\p{Devanagari}"), ("T", r"\p{Thai}"), ("A", r"\p{Arabic}"), ("G", r"\p{Greek}"))]

#: Scripts written without spaces between sentences.
UNSPACED = frozenset("ZJT")

#: Abbreviations of general use whose period seldom ends a sentence, as a feature of the classifier.
ABBREVIATIONS = frozenset(
    "dr mr mrs ms prof st jr sr no nos fig figs sec ch chap vol vs cf e.g i.e eg ie approx ca al ed eds pp p dept est inc ltd gen rev hon "
    "nr bzw z.b d.h u.a s bd abs art hr fr str evtl ggf sog m mme mlle ex pág núm sr sra ej av tel "
    "г т.е т.к т.н см рис стр тыс млн млрд ул им напр".split()
)

#: Prior means of the classifier's weights: what holds where the input says nothing else.
PRIOR = {
    "m:!": 1.0, "m:?": 1.0, "m:。": 4.0, "m:！": 3.0, "m:？": 3.0, "m:।": 4.0, "m:؟": 3.0, "m:...": -0.5, "m:…": -0.5,
    "r:up": 3.0, "r:low": -5.0, "r:id": 1.0, "r:camel": 1.0, "r:dig": 0.5, "r:open": 2.0, "r:com": -7.0, "r:unc": 2.0, "r:sym": 0.0, "r:dash": -1.0,
    "tight": -5.0, "tight:up": 3.0, "tight:unc": 3.0, "tight:open": 2.0, "c+low": -1.0, "c+tight+unc": -4.0,
    "s:u1": -5.0, "s:l1": -4.0, "s:ip": -4.0, "s:n1": -2.5, "s:ab": -5.0, "s:id": 0.5,
}


@functools.lru_cache(maxsize=4096)
def script_of(c: str) -> str:
    return next((n for n, p in _SCRIPTS if p.match(c)), "o")


@functools.lru_cache(maxsize=65536)
def _is_cjk(c: str) -> bool:
    return bool(_CJK.match(c))


@functools.lru_cache(maxsize=65536)
def _word(token: str) -> str:
    """The token in small letters, all numbers alike."""
    return _DIGITS.sub("9", token.lower())


@functools.lru_cache(maxsize=65536)
def _left_shape(token: str) -> str:
    low = token.lower()
    if low in ABBREVIATIONS:
        return "ab"
    if not token:
        return "none"
    if token.isdigit():
        return "n1" if len(token) < 3 else "n"
    if _DIGITS.search(token):
        return "nd" if not _LETTER.search(token) else "id"
    if len(token) == 1:
        return "u1" if token.isupper() else "l1" if token.islower() else "w"
    if "_" in token or "." in token and max(map(len, token.split("."))) > 2 or any(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False)):
        return "id"
    if "." in token:
        return "ip"
    return ("C" if token[0].isupper() else "w") + str(min(len(token), 4))


@functools.lru_cache(maxsize=65536)
def _right_kind(text: str) -> tuple[str, str]:
    c = text[0]
    if c in "\"“„«(（「『¿¡[`【《‹":
        return "open", "o"
    if c in ",;:)]}，；：、）」』”»%/\\*،؛":
        return "com", "o"
    if c in "-–—=+<>|~":
        return "dash", "o"
    if c.isdigit():
        return "dig", "o"
    script = script_of(c)
    token = m[0] if (m := _RIGHT.match(text)) else ""
    name = "_" in token or "." in token or any(x.isdigit() for x in token) or any(a.islower() and b.isupper() for a, b in zip(token, token[1:], strict=False))
    if c.isupper() or c.istitle():
        return "camel" if name else "up", script
    if c.islower():
        return "id" if name else "low", script
    return ("unc", script) if c.isalpha() else ("sym", "o")


def _pairs(p: str) -> list[tuple[int, int]]:
    """Matched quotations, brackets and code spans of a paragraph, outermost only; unmatched signs are ignored."""
    stack: list[tuple[str, int]] = []
    found = []
    for m in _QUOTES.finditer(p):
        c, i = m[0], m.start()
        close = next((k for k in range(len(stack) - 1, -1, -1) if (c in _OPENERS.get(stack[k][0], stack[k][0]))), None)
        if c in '"`':
            opens = close is None
        else:
            opens = c in _OPENERS and not (close is not None and c == "“")
        if opens:
            stack.append((c, i))
        elif close is not None:
            found.append((stack[close][1], i))
            del stack[close:]
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        if not out or a > out[-1][1]:
            out.append((a, b))
    return out


#: A token is known to the classifier by the characters nearest to the mark, at most so many, so that a text of one
#: endless token takes linear time. Longer ones are not words.
TOKEN_CHARS = 256


def _features(p: str, start: int, letter: str, marks: str, closers: str, tight: bool, text: str, at: int) -> tuple[tuple[str, ...], tuple, str]:
    """(features, evidence keys, kind of what follows) of marks at ``start`` of a paragraph, before ``at`` of a text;
    letter is the last one before the marks."""
    if start and _is_cjk(p[start - 1]):
        token = p[start - 1]
    else:
        token = m[0] if (m := _LEFT.match(p, max(0, start - TOKEN_CHARS), start)) else ""
        if token and (m := _AFTER_CJK.match(token)):
            token = m[0]
    token = token.lstrip(".'’-")
    script = script_of(letter) if letter else "o"
    word = _word(token)
    shape = _left_shape(token)
    mark = marks if len(marks) < 4 else marks[:3]
    kind, right_script = _right_kind(m[0] if (m := _RIGHT.match(text, at, at + TOKEN_CHARS)) else text[at])
    gap = "0" if tight else "1"
    f = [
        f"m:{mark}", f"r:{kind}", f"s:{shape}", f"w:{word}|{mark}", f"S:{script}|{mark}|{closers}|{gap}", f"x:{mark}|{closers}|{gap}|{kind}",
        f"y:{shape}|{kind}|{gap}", f"z:{script}|{right_script}|{gap}", f"v:{script}|{word}|{kind}",
    ]
    if tight:
        f += ["tight", f"tight:{kind}"]
    if closers:
        f.append("c+" + kind)
        if tight:
            f.append("c+tight+" + kind)
    return tuple(f), ((script, word, mark, closers), (script, "", mark, closers)), kind


def candidates(p: str) -> Iterator[tuple[int, int, tuple | None]]:
    """(end, start of the next unit, features) of every candidate boundary in a paragraph; the features of a mark
    that ends the paragraph are None. Marks within a quotation, bracket or code span are no candidates."""
    spans = _pairs(p)
    k = seen = 0
    letter = ""
    for m in _MARKS.finditer(p):
        start, end = m.span()
        i = start - 1
        while i >= seen and not p[i].isalpha():
            i -= 1
        letter, seen = p[i] if i >= seen else letter, end
        while k < len(spans) and spans[k][1] < start:
            k += 1
        e = end
        if k < len(spans) and spans[k][0] < start:
            close = spans[k][1]
            i = end
            while i < close and p[i].isspace():
                i += 1
            if i < close:
                continue
            e = close + 1
            while e < len(p) and (n := _SPACED_CLOSER.match(p, e)):
                e = n.end()
        if e < len(p) and _MARKS.match(p, e):
            continue
        rest = e
        while rest < len(p) and p[rest].isspace():
            rest += 1
        marks, closers = m[0], p[end:e].strip()
        if rest == len(p):
            yield e, rest, None if e < len(p.rstrip()) else (start, letter, marks, closers)
            continue
        yield e, rest, _features(p, start, letter, marks, closers, rest == e, p, rest)


def paragraphs(text: str) -> Iterator[tuple[int, str]]:
    at = 0
    for m in _BLANK.finditer(text):
        yield at, text[at : m.start()]
        at = m.end()
    yield at, text[at:]


def examples(text: str) -> Iterator[tuple[str, tuple, tuple]]:
    """(label, features, evidence keys) of a document. Reliable boundaries are the ends of paragraphs: the last
    mark before a blank line, seen with the beginning of the next paragraph, once after a space and once without.
    Reliable non-boundaries are followed by a plain small-letter word or a comma, or lie within a token; after a
    letter of a script without spaces only the comma is reliable. All other candidates are unlabelled (u)."""
    ps = [p.strip() for _, p in paragraphs(text)]
    ps = [p for p in ps if p]
    for i, p in enumerate(ps):
        for _, _, f in candidates(p):
            if f is None:
                continue
            if isinstance(f[0], int):  # a mark that ends the paragraph
                if i + 1 < len(ps):
                    for tight in (False, True):
                        feats, keys, kind = _features(p, *f, tight, ps[i + 1], 0)
                        if not tight or kind in ("up", "unc", "open") or keys[0][0] in UNSPACED:
                            yield "p", feats, keys
                continue
            feats, keys, kind = f
            before = next((x for x in feats if x[0] == "s"), "")
            unspaced = keys[0][0] in UNSPACED and before in ("s:w", "s:none")
            sure = kind == "com" or not unspaced and (kind == "low" or "tight" in feats and kind in ("dig", "id"))
            yield ("n" if sure else "u"), feats, keys


def fit(rows: list[tuple[str, str, str, int]], steps: int = 300, strength: float = 1.0) -> dict[str, float]:
    """Weights of the maximum-entropy model, by gradient ascent on the posterior with a Gaussian prior around
    PRIOR. rows: (label, features, evidence keys, count).

    An unlabelled candidate counts as a non-boundary if its evidence key (script, word, mark, closers), or the
    key without the word, never ends a paragraph although it is so frequent that this is no chance (under
    1 in 10,000); abbreviations, initials and ellipses within sentences are found in this way.
    """
    ends: Counter = Counter()
    seen: Counter = Counter()
    by_script: dict[str, list[int]] = defaultdict(lambda: [0, 0])
    for label, feats, keys, n in rows:
        joined = "tight" in feats.split("\x1f")
        if label == "p" and joined:
            continue  # the same paragraph end, once more
        for key in keys.split("\x1e"):
            seen[key] += n
            ends[key] += n * (label == "p")
        script = keys.split("\x1f", 1)[0]
        by_script[script][0] += n * (label == "p")
        by_script[script][1] += n

    def never(key: str) -> bool:
        e, n = by_script[key.split("\x1f", 1)[0]]
        rate = min(0.5, e / n) if n else 0.0
        return ends[key] == 0 and rate > 0 and seen[key] * math.log1p(-rate) < math.log(1e-4)

    kept = []
    for label, feats, keys, n in rows:
        if label == "u":
            if not any(never(k) for k in keys.split("\x1e")):
                continue
            label = "n"
        kept.append((label == "p", feats.split("\x1f"), 1.0 + math.log(n)))
    index: dict[str, int] = {}
    for _, feats, _ in kept:
        for f in feats:
            index.setdefault(f, len(index))
    for f in PRIOR:
        index.setdefault(f, len(index))
    prior = np.zeros(len(index) + 1)
    for f, w in PRIOR.items():
        prior[index[f]] = w
    if kept:
        width = max(len(f) for _, f, _ in kept)
        x = np.full((len(kept), width), len(index))
        for i, (_, feats, _) in enumerate(kept):
            x[i, : len(feats)] = [index[f] for f in feats]
        y = np.array([p for p, _, _ in kept], float)
        c = np.array([n for _, _, n in kept])
        # Accelerated ascent, each weight at the step that its bound on the curvature allows.
        bound = 0.25 * width * np.bincount(x.ravel(), np.repeat(c, width), minlength=len(prior)) + strength
        w = look = prior.copy()
        for step in range(1, steps + 1):
            z = look[x].sum(axis=1)
            g = c * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
            grad = np.bincount(x.ravel(), np.repeat(g, width), minlength=len(prior)) + strength * (look - prior)
            grad[-1] = 0.0
            new = look - grad / bound
            look = new + (step - 1) / (step + 2) * (new - w)
            w = new
    else:
        w = prior
    return {f: round(float(w[i]), 4) for f, i in index.items() if abs(w[i]) > 1e-3}


def train(docs: DataFrame, item_id: str, text: str, train_docs: int = TRAIN_DOCS) -> dict[str, float]:
    """Fits the classifier on a bounded sample of the documents; examples are counted on the executors."""
    total = docs.count()
    share = min(1.0, train_docs / max(1, total))
    sample = docs.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    if share < 1.0:
        sample = sample.where(F.pmod(F.xxhash64("id"), F.lit(1 << 30)) < int(share * (1 << 30)))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found: Counter = Counter()
            for t in batch["text"]:
                for label, feats, keys in examples(t):
                    found[label, "\x1f".join(feats), "\x1e".join("\x1f".join(k) for k in keys)] += 1
            yield pd.DataFrame([(*k, n) for k, n in found.items()], columns=["label", "feats", "keys", "n"])

    counted = sample.select("text").mapInPandas(count, "label string, feats string, keys string, n long")
    rows = counted.groupBy("label", "feats", "keys").agg(F.sum("n").alias("n")).collect()
    return fit(sorted((r.label, r.feats, r.keys, r.n) for r in rows))


def split(text: str, weights: dict[str, float]) -> list[tuple[int, int]]:
    """(start, end) of every sentence, in code points, without white space around."""
    out = []
    known: dict[tuple, bool] = {}
    for at, p in paragraphs(text):
        cuts = [(m.start(), m.end()) for m in _THAI_GAP.finditer(p)]
        for e, rest, f in candidates(p):
            if f is None or isinstance(f[0], int):
                continue
            feats = f[0]
            yes = known.get(feats)
            if yes is None:
                yes = known[feats] = sum(weights.get(x, 0.0) for x in feats) > 0
            if yes:
                cuts.append((e, rest))
        start = 0
        for e, rest in [*sorted(cuts), (len(p), len(p))]:
            unit = p[start:e]
            core = unit.strip()
            if core:
                a = at + start + len(unit) - len(unit.lstrip())
                out.append((a, a + len(core)))
            start = rest
    return out


def sentences(docs: DataFrame, item_id: str = "doc_id", text: str = "text", *, train_docs: int = TRAIN_DOCS, weights: dict[str, float] | None = None) -> DataFrame:
    """(id, sentence_no, char_start, char_end, sentence) of every document; positions are code points, end exclusive.

    Candidate boundaries are sentence marks with their closing quotes and brackets, of any script. Each is
    classified by a maximum-entropy model of neighbouring tokens, case, length, digits and script, fitted to the
    reliable boundaries of a bounded sample of the input (``train_docs``) around general priors. Blank lines
    always end a sentence; marks within a quotation or bracket never do; in Thai a space between Thai characters
    does. Splitting needs no shuffle; the model is the only thing that reaches the executors.

    Defined cases: null and empty texts, and texts of white space, have no sentences; a text without marks is one
    sentence; repeated ids give the sentences of each row; an empty table gives an empty result. Extra columns
    are not read.
    """
    model = weights if weights is not None else train(docs, item_id, text, train_docs)
    kind = dict(docs.dtypes)[item_id]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids, numbers, starts, ends, units = [], [], [], [], []
            for i, t in zip(batch["id"], batch["text"], strict=True):
                for k, (a, b) in enumerate(split(t, model)):
                    ids.append(i)
                    numbers.append(k)
                    starts.append(a)
                    ends.append(b)
                    units.append(t[a:b])
            yield pd.DataFrame({"id": pd.Series(ids, dtype=batch["id"].dtype), "sentence_no": np.array(numbers, np.int32), "char_start": np.array(starts, np.int64), "char_end": np.array(ends, np.int64), "sentence": pd.Series(units, dtype=object)})

    source = docs.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where(F.col("text").isNotNull() & F.col("id").isNotNull())
    return source.mapInPandas(run, f"id {kind}, sentence_no int, char_start long, char_end long, sentence string").withColumnRenamed("id", item_id)
