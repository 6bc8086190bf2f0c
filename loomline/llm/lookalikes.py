"""One consistent form for text that looks the same but is written with different characters."""

from __future__ import annotations

import functools
import sys
import unicodedata
from collections import Counter, defaultdict
from dataclasses import dataclass, field

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.session import cut

#: Letters drawn like an ASCII letter though their capitals differ from its capital.
SMALL_ONLY = {"һ": "h", "ԁ": "d", "ν": "v", "ѵ": "v", "ո": "n", "ս": "u", "ց": "g", "զ": "q", "ԛ": "q", "ɡ": "g"}

#: Scripts whose letters have look-alikes in one another, in the order in which an undecided token takes them.
SCRIPTS = ("Latn", "Cyrl", "Grek", "Armn", "Copt", "Cher", "Lisu", "Kata", "Hira", "Hani")

#: Their names as Unicode properties, with those of the scripts that share a writing system with them.
NAMES = {"Latn": "Latin", "Cyrl": "Cyrillic", "Grek": "Greek", "Armn": "Armenian", "Copt": "Coptic", "Cher": "Cherokee", "Lisu": "Lisu", "Kata": "Katakana", "Hira": "Hiragana", "Hani": "Han", "Hang": "Hangul", "Bopo": "Bopomofo"}

#: Writing systems that use several scripts at once (UTS 39, augmented script sets).
SYSTEMS = {"Jpan": ("Hani", "Hira", "Kata"), "Kore": ("Hang", "Hani"), "Hanb": ("Hani", "Bopo")}

#: Which of several comes first.
RANK = {p: i for i, p in enumerate((*SCRIPTS, *SYSTEMS))}

#: Combining voice marks of kana.
VOICED = "\u3099\u309a"

# What may stand between words of an emoji sequence, after a virama, or between Arabic letters, and is visible there.
_KEPT_JOINER = regex.compile(
    r"(?<=\p{Extended_Pictographic}[️\U0001F3FB-\U0001F3FF]*)‍(?=\p{Extended_Pictographic})"
    r"|(?<=\p{Extended_Pictographic})(?<![0-9#*])[︎️]"
    r"|(?<=\p{InSC=Virama})[‌‍]|(?<=\p{Script=Arabic})‌(?=\p{Script=Arabic})"
)
_IGNORABLE = regex.compile(r"\p{Default_Ignorable_Code_Point}")
_TOKEN = regex.compile(r"[\p{L}\p{M}]+")
_ASCII_LETTERS_ONLY = regex.compile(r"[^\p{L}\p{M}]*(?:[A-Za-z][^\p{L}\p{M}]*)*")


#: Tokens and spellings that a task remembers, at most, of tokens of at most so many characters.
MEMORY, REMEMBERED_CHARS = 50_000, 64


@dataclass(frozen=True)
class Token:
    """What a token can be: its letters with their look-alikes, the scripts in which it can be written as a whole,
    whether it has look-alikes at all, and whether it mixes scripts or could be written in several."""

    letters: list
    plain: list[str]
    ambiguous: bool
    mixed: bool
    whole: bool


@dataclass
class Tables:
    """fold: one character to what is drawn the same in general use. classes: letter -> class number. members:
    for each class, the letter of each script. scripts: letter -> the scripts that use it."""

    fold: dict[int, str]
    classes: dict[str, int]
    members: list[dict[str, str]]
    _scripts: dict[str, frozenset] = field(default_factory=dict)
    _patterns: list = field(default_factory=list)
    _tokens: dict[str, Token] = field(default_factory=dict)
    _spellings: dict[tuple, str] = field(default_factory=dict)

    def scripts(self, letter: str) -> frozenset:
        known = self._scripts.get(letter)
        if known is None:
            if not self._patterns:
                self._patterns = [(s, regex.compile(rf"\p{{Script_Extensions={n}}}")) for s, n in NAMES.items()]
            known = frozenset(s for s, p in self._patterns if p.match(letter)) or frozenset(["other"])
            self._scripts[letter] = known
        return known


def _fold_table() -> dict[int, str]:
    """Width and no-break forms, kinds of space, Roman numerals, radicals, ligatures, digraphs and joining forms.

    Raised, circled, squared, fraction and font forms are visibly different and stay.
    """
    fold = {}
    for cp in range(0x80, sys.maxunicode + 1):
        c = chr(cp)
        category = unicodedata.category(c)
        if category in ("Cn", "Co", "Cs"):
            continue
        if category == "Zs":
            fold[cp] = " "
            continue
        kind, _, rest = unicodedata.decomposition(c).partition(" ")
        if not kind.startswith("<"):
            continue
        plain = "".join(chr(int(x, 16)) for x in rest.split())
        joined = kind in ("<initial>", "<medial>", "<final>", "<isolated>") and len(plain) == 1
        sign = kind == "<compat>" and (category in ("Nl", "So") and plain.isalpha() or 0xFB00 <= cp <= 0xFB06 or "DIGRAPH" in (n := unicodedata.name(c)) or "LIGATURE" in n or cp == 0xB5 or n.startswith(("LATIN CAPITAL LETTER DZ", "LATIN SMALL LETTER DZ", "LATIN CAPITAL LETTER LJ", "LATIN SMALL LETTER LJ", "LATIN CAPITAL LETTER NJ", "LATIN SMALL LETTER NJ")))
        if kind in ("<wide>", "<narrow>", "<noBreak>") or joined or sign:
            fold[cp] = plain
    # To the end: a folded character may fold again (the no-break and wide forms of a space).
    return {cp: "".join(fold.get(ord(x), x) for x in s) for cp, s in fold.items()}


def _skeletons(spark: SparkSession, letters: list[str]) -> list[str]:
    """The Unicode confusables prototype of each letter, from the ICU library that Spark ships, in one call."""
    icu = spark.sparkContext._jvm.com.ibm.icu.text.SpoofChecker
    return icu.Builder().build().getSkeleton(0, "\n".join(letters)).split("\n")


@functools.lru_cache(maxsize=1)
def tables(spark: SparkSession) -> Tables:
    """Classes of identically drawn letters, built by rule from the Unicode confusables data.

    Letters join a class if their prototypes agree and also their case and their dot (i, j); a small letter of
    another script joins an ASCII letter only if their capitals look alike too, or it is in ``SMALL_ONLY``. Of
    several letters of one script the one with a look-alike capital, then the first, belongs to the class; all
    others stay distinct, as do all different ASCII letters. Letters never look like digits.
    """
    fold = _fold_table()
    soft_dotted = regex.compile(r"\p{Soft_Dotted}")
    cased = [c for c in map(chr, range(0x41, sys.maxunicode + 1)) if unicodedata.category(c) in ("Lu", "Ll") and not unicodedata.decomposition(c)]
    lisu = [chr(c) for c in range(0xA4D0, 0xA4F8)]
    kana = [c for c in map(chr, range(0x3041, 0x30FF)) if unicodedata.category(c) == "Lo" and not unicodedata.decomposition(c)]
    han = [chr(c) for c in range(0x4E00, 0xA000)]
    letters = cased + lisu + kana + han
    skeleton = dict(zip(letters, _skeletons(spark, letters), strict=True))
    t = Tables(fold, {}, [])

    def shape(c: str) -> tuple:
        return skeleton.get(c), unicodedata.category(c) != "Ll", bool(soft_dotted.match(c))

    def capital(c: str) -> str | None:
        up = c.upper()
        return skeleton.get(up) if len(up) == 1 and up != c else None

    groups: dict[tuple, list[str]] = defaultdict(list)
    for c in cased + lisu:
        if "Latn" not in t.scripts(c) or ord(c) < 0x100 or c in SMALL_ONLY:
            groups[shape(c)].append(c)
    for group in groups.values():
        ascii_letters = [c for c in group if c.isascii()]
        if len(group) < 2:
            continue
        if len(ascii_letters) > 1:
            raise AssertionError(f"ASCII letters {ascii_letters} would look the same")
        for root in ascii_letters or [None]:
            members: dict[str, str] = {"Latn": root} if root else {}
            same = {root} if root else set()
            rest = [c for c in group if c != root]
            if root and root.islower():
                rest = [c for c in rest if capital(c) == skeleton[root.upper()] or SMALL_ONLY.get(c) == root]
            for c in sorted(rest, key=lambda c: (capital(c) is None or (root is not None and capital(c) != skeleton[root.upper()]), ord(c))):
                script = next((s for s in SCRIPTS if s in t.scripts(c)), None)
                if script and script not in members:
                    members[script] = c
                    same.add(c)
                elif root and SMALL_ONLY.get(c) == root:
                    same.add(c)
            if len(same) > 1:
                t.members.append(members)
                t.classes |= dict.fromkeys(same, len(t.members) - 1)
    drawn: dict[str, list[str]] = defaultdict(list)
    for c in kana + han:
        drawn[skeleton[c]].append(c)
    for group in drawn.values():
        if len(group) > 1 and any(not "一" <= c for c in group):
            members = {}
            for c in group:
                members.setdefault(next(s for s in SCRIPTS if s in t.scripts(c)), c)
            if len(members) > 1:
                t.members.append(members)
                t.classes |= dict.fromkeys(members.values(), len(t.members) - 1)
    t._scripts, t._patterns = {}, []
    return t


def _choices(token: str, t: Tables) -> list[tuple[str, dict[str, str] | None, frozenset]]:
    out = []
    for c in token:
        k = t.classes.get(c)
        if k is not None:
            out.append((c, t.members[k], frozenset(t.members[k])))
        elif unicodedata.category(c)[0] == "M" or unicodedata.category(c) == "Lm":
            out.append((c, None, frozenset()))  # takes the script of what it stands on
        else:
            out.append((c, None, t.scripts(c)))
    return out


@functools.lru_cache(maxsize=4096)
def _augmented(scripts: frozenset) -> frozenset:
    return scripts | {name for name, parts in SYSTEMS.items() if scripts & set(parts)}


def resolve(token: str, t: Tables) -> tuple[list, frozenset]:
    """The letters with their look-alikes, and the scripts or writing systems in which the whole token can be
    written: the intersection over its letters of the scripts in which each has a spelling."""
    letters = _choices(token, t)
    sets = [_augmented(s) for _, _, s in letters if s]
    return letters, frozenset.intersection(*sets) if sets else frozenset()


def _token(token: str, t: Tables) -> Token:
    """A token resolved; tokens come again and again, so they are remembered."""
    known = t._tokens.get(token)
    if known is None:
        letters, possible = resolve(token, t)
        own = frozenset.intersection(*x) if (x := [_augmented(t.scripts(c)) for c, _, scripts in letters if scripts]) else frozenset()
        plain = [p for p in (*SCRIPTS, *SYSTEMS) if p in possible and not (p in SYSTEMS and possible & set(SYSTEMS[p]))]
        ambiguous = any(members for _, members, _ in letters)
        known = Token(letters, plain, ambiguous, not own and len(x) > 1, ambiguous and len(plain) > 1)
        if len(token) <= REMEMBERED_CHARS:
            if len(t._tokens) >= MEMORY:
                t._tokens.clear()
            t._tokens[token] = known
    return known


def _spelled(token: str, known: Token, script: str | None, t: Tables) -> str:
    out = t._spellings.get((token, script))
    if out is None:
        out = _spell(known.letters, script)
        if len(token) <= REMEMBERED_CHARS:
            if len(t._spellings) >= MEMORY:
                t._spellings.clear()
            t._spellings[token, script] = out
    return out


def _spell(letters: list, script: str | None) -> str:
    """The token in one script or writing system; in none, each letter follows the nearest certain one before
    it, else after it, else the order of SCRIPTS."""
    order = SYSTEMS.get(script, (script,)) if script else ()
    certain = [next((s for s in SCRIPTS if s in scripts), None) if members is None else None for _, members, scripts in letters]
    # For each letter the scripts of the nearest certain letters before and after it, in one pass each way.
    nearest_before, nearest_after = list(certain), list(certain)
    for i in range(1, len(certain)):
        nearest_before[i] = nearest_before[i] or nearest_before[i - 1]
        nearest_after[-1 - i] = nearest_after[-1 - i] or nearest_after[-i]
    out = []
    for i, (c, members, _) in enumerate(letters):
        if members is None:
            out.append(c)
            continue
        before, after = nearest_before[i], nearest_after[i]
        if script in members:
            out.append(members[script])
        else:
            if after == "Kata":  # a word in Katakana begins or goes on
                beside = ("Kata",)
            elif before == "Kata" and "Hira" in members and not (i + 1 < len(letters) and letters[i + 1][0] in VOICED):
                beside = ("Hira",)  # a particle follows it
            else:
                beside = (before, after)
            pick = next((s for s in (*beside, *order, *SCRIPTS) if s in members and (not order or s in order)), None)
            out.append(members[pick] if pick else c)
    return "".join(out)


def consistent_form(text: str, t: Tables) -> tuple[str, int, int]:
    """(form, mixed-script tokens, whole-script confusable tokens) of a value.

    The form depends only on what the value looks like: characters are folded to how they are drawn, letters to
    their class, and the script of each token is chosen from the classes alone. A token that could be written
    wholly in several scripts takes the one that prevails among the value's certain tokens, else the first.
    """
    s = text.translate(t.fold).replace("\r\n", "\n")
    if _IGNORABLE.search(s):
        kept = {m.start() for m in _KEPT_JOINER.finditer(s)}
        s = _IGNORABLE.sub(lambda m: m[0] if m.start() in kept else "", s)
    s = unicodedata.normalize("NFC", s).translate(t.fold)
    if _ASCII_LETTERS_ONLY.fullmatch(s):
        return s, 0, 0
    s = unicodedata.normalize("NFD", s)
    found, votes = [], Counter()
    mixed = whole = 0
    for m in _TOKEN.finditer(s):
        token = m[0]
        known = _token(token, t)
        mixed += known.mixed
        whole += known.whole
        if len(known.plain) == 1 or not known.ambiguous:
            votes[known.plain[0] if known.plain else "other"] += len(token)
        if known.ambiguous:
            found.append((m.start(), m.end(), token, known))
    out, at = [], 0
    for start, end, token, known in found:
        script = min(known.plain, key=lambda p: (-votes[p], RANK[p])) if known.plain else None
        out += [s[at:start], _spelled(token, known, script, t)]
        at = end
    return unicodedata.normalize("NFC", "".join([*out, s[at:]])), int(mixed), int(whole)


FORM_TYPE = "form string, mixed_tokens int, whole_script_tokens int"


def form_udf(spark: SparkSession):
    """An Arrow-batched UDF string -> (form, mixed_tokens, whole_script_tokens); nulls stay null."""
    t = tables(spark)

    @F.pandas_udf(FORM_TYPE)
    def form(values: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if v is None else consistent_form(v, t) for v in values]
        frame = pd.DataFrame(rows, columns=["form", "mixed_tokens", "whole_script_tokens"])
        return frame.astype({"mixed_tokens": "Int32", "whole_script_tokens": "Int32"})

    return form


def with_form(df: DataFrame, text: str) -> DataFrame:
    """Adds form, mixed_tokens and whole_script_tokens. Values of ASCII characters, where nothing looks like
    anything else, stay on the JVM; their form is the value."""
    value = F.col(text)
    plain = value.rlike(r"\A[\x00-\x0C\x0E-\x7F]*\z")
    out = df.withColumn("_f", form_udf(df.sparkSession)(F.when(~plain, value)))
    return (
        out.withColumn("form", F.when(plain, value).otherwise(F.col("_f.form")))
        .withColumn("mixed_tokens", F.when(plain, F.lit(0)).otherwise(F.col("_f.mixed_tokens")))
        .withColumn("whole_script_tokens", F.when(plain, F.lit(0)).otherwise(F.col("_f.whole_script_tokens")))
        .drop("_f")
    )


@dataclass(frozen=True)
class Field:
    table: DataFrame
    record_id: str
    column: str
    name: str


def consistent_values(fields: list[Field]) -> DataFrame:
    """(field, id, value, form, mixed_tokens, whole_script_tokens) of every value that is not null.

    Text is brought to one form by resolved script sets: for each token the scripts of all spellings of its
    letters are intersected, mixed-script and whole-script confusable tokens are counted, and the token is
    written in the consistent script; other differences that cannot be seen (width, composition, invisible
    characters, kinds of space) are normalised away.

    Defined cases: null values and ids are left out; an empty value has an empty form; very long values are
    processed whole; repeated rows come out once for each row. Other columns are not read.
    """
    parts = [
        f.table.select(F.lit(f.name).alias("field"), F.col(f.record_id).cast("long").alias("id"), F.col(f.column).alias("value")).where("id IS NOT NULL AND value IS NOT NULL")
        for f in fields
    ]
    return with_form(functools.reduce(DataFrame.unionByName, parts), "value")


#: Parts in which the records of a spelling are looked up, and records of a part in which they are paired.
SALTS, PART_ROWS = 16, 4096


def _pair(h: Column) -> list[Column]:
    return [F.xxhash64(h), F.xxhash64(h, F.lit(1))]


def lookalike_pairs(values: DataFrame) -> DataFrame:
    """(field, id_a, id_b), id_a < id_b, of records whose values have the same form but not the same characters.

    Works on hashes of value and form. Forms with one spelling, which is nearly all, are dropped by one
    aggregation; then pairs of different spellings of a form are found, and only those are expanded to records.
    The work is in proportion to the input and to the pairs that come out. The records of a common spelling are
    found in ``SALTS`` parts and joined in parts of about ``PART_ROWS``, so that no task holds them all.
    """
    v1, v2 = _pair(F.col("value"))
    f1, f2 = _pair(F.col("form"))
    key, spelling = ["field", "f1", "f2"], ["field", "f1", "f2", "v1", "v2"]
    hashed = cut(values.select("field", "id", v1.alias("v1"), v2.alias("v2"), f1.alias("f1"), f2.alias("f2")).distinct())
    counted = hashed.groupBy(*spelling).agg(F.count("*").alias("n"))
    several = counted.groupBy(*key).agg(F.count("*").alias("k")).where("k > 1").drop("k")
    spellings = cut(counted.join(several, key).select(*spelling, F.ceil(F.col("n") / PART_ROWS).cast("int").alias("parts")))
    salted = spellings.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    found = hashed.withColumn("_s", F.pmod(F.xxhash64("id"), F.lit(SALTS)).cast("int")).join(salted, [*spelling, "_s"])
    members = found.select("field", "v1", "v2", "id", F.pmod(F.xxhash64("id", F.lit(1)), F.col("parts")).cast("int").alias("part"))

    other = spellings.withColumnsRenamed({"v1": "w1", "v2": "w2", "parts": "other_parts"})
    pairs = spellings.join(other, key).where("v1 < w1 OR (v1 = w1 AND v2 < w2)")
    each = pairs.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("other_parts") - 1)))
    right = members.select("field", F.col("v1").alias("w1"), F.col("v2").alias("w2"), F.col("id").alias("id_r"), F.col("part").alias("other"))
    left = members.withColumnRenamed("id", "id_l")
    out = each.join(left, ["field", "v1", "v2", "part"]).join(right, ["field", "w1", "w2", "other"]).where("id_l <> id_r")
    return out.select("field", F.least("id_l", "id_r").alias("id_a"), F.greatest("id_l", "id_r").alias("id_b")).distinct()
