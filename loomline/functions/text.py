"""Text scalars as Column expressions: they stay in generated code and need no Python worker."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: English path token -> Korean alias, so that a Korean query reaches English paths.
KOREAN_ALIASES = {
    "search": "검색",
    "index": "인덱스",
    "indexer": "인덱스 인덱서",
    "build": "빌드",
    "embed": "임베딩",
    "embedding": "임베딩",
    "vector": "벡터",
    "modal": "모달",
    "state": "상태",
    "theme": "테마",
    "commit": "커밋",
    "diff": "디프 비교",
    "revwalk": "순회 그래프",
    "walk": "순회",
    "graph": "그래프",
    "chunk": "청크 조각",
    "tokenizer": "토크나이저",
    "token": "토큰",
    "highlight": "하이라이트 강조",
    "engine": "엔진",
    "store": "저장소",
    "repo": "저장소",
    "cache": "캐시",
    "config": "설정",
    "pick": "선택",
    "view": "보기",
    "ui": "화면",
    "report": "리포트",
    "fixture": "픽스처",
    "rrf": "융합 합치",
    "fusion": "융합",
    "bm25": "비엠",
    "symbol": "심볼 기호",
    "metric": "지표",
}

#: File extension -> language.
LANGUAGES = {
    "rs": "rust",
    "py": "python",
    "js": "javascript",
    "mjs": "javascript",
    "ts": "typescript",
    "tsx": "tsx",
    "go": "go",
    "c": "c",
    "h": "c",
    "cpp": "cpp",
    "cc": "cpp",
    "cxx": "cpp",
    "hpp": "cpp",
    "java": "java",
    "sh": "bash",
    "bash": "bash",
    "zsh": "bash",
    "zig": "zig",
    "s": "asm",
    "S": "asm",
    "asm": "asm",
    "ld": "linkerscript",
    "lds": "linkerscript",
    "lis": "lisette",
    "toml": "toml",
    "json": "json",
    "jsonc": "json",
    "yaml": "yaml",
    "yml": "yaml",
    "md": "markdown",
    "swift": "swift",
    "html": "html",
    "css": "css",
}

#: Languages whose large files are cut into symbols.
SYMBOL_LANGUAGES = ("rust", "python", "javascript", "typescript", "tsx", "go", "swift")

#: Fixed values, in bytes: files from this size on are cut into symbols; text that is embedded of a file; files left out.
WHOLE_FILE_BYTES, EMBED_BYTES, MAX_FILE_BYTES = 16 * 1024, 2048, 1_000_000

#: Bytes in which a zero byte makes a blob binary.
BINARY_PREFIX = 8000


def _literal_map(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in values.items() for x in pair))


def split_camel_case(s: Column) -> Column:
    """A space before a capital that follows a small letter, and before a digit that follows a letter (ASCII)."""
    return F.regexp_replace(s, r"(?<=[a-z])(?=[A-Z])|(?<=[A-Za-z])(?=[0-9])", " ")


def path_to_terms(path: Column) -> Column:
    return split_camel_case(F.translate(path, "/.-_\\", "     "))


def words(s: Column) -> Column:
    """Word analyzer: maximal runs of letters and digits, lower-cased."""
    return F.regexp_extract_all(F.lower(s), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1))


def bigrams(s: Column) -> Column:
    """All pairs of neighbouring characters, spaces and punctuation too, lower-cased, in linear time; null of null."""
    chars = F.split(s, "")
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars) - 1), lambda a, b: F.lower(F.concat(a, b)))
    return F.when(F.length(s) >= 2, pairs).when(s.isNotNull(), F.array().cast("array<string>"))


def korean_aliases(path: Column) -> Column:
    """Aliases of the path's terms, in the order of the terms, repeats kept; empty if there are none."""
    aliases = _literal_map(KOREAN_ALIASES)
    found = F.transform(F.filter(F.split(F.lower(path_to_terms(path)), r"\s+"), lambda t: F.map_contains_key(aliases, t)), lambda t: F.element_at(aliases, t))
    return F.array_join(found, " ")


def has_hangul(s: Column) -> Column:
    return s.rlike("[가-힯]")


#: White space of Unicode, as a character class that Java and RE2 both read.
SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def trim(s: Column) -> Column:
    return F.regexp_replace(s, rf"\A{SPACE}+|{SPACE}+\z", "")


def message_title(message: Column) -> Column:
    return trim(F.substring_index(message, "\n", 1))


def message_body(message: Column) -> Column:
    """What follows the first line, trimmed; empty for a message of one line."""
    at = F.locate("\n", message)
    return F.when(at > 0, trim(F.substr(message, at + 1))).otherwise(F.when(message.isNotNull(), ""))


def display_split(message: Column) -> tuple[Column, Column]:
    """(subject, rest) at the first blank line, else at the first line end."""
    blank, line = F.locate("\n\n", message), F.locate("\n", message)
    subject = F.when(blank > 0, F.substr(message, F.lit(1), blank - 1)).when(line > 0, F.substr(message, F.lit(1), line - 1)).otherwise(message)
    rest = F.when(blank > 0, F.substr(message, blank + 2)).when(line > 0, F.substr(message, line + 1)).otherwise(F.when(message.isNotNull(), ""))
    return subject, rest


def truncate_bytes(s: Column, size: int) -> Column:
    """The longest prefix of whole characters within the bytes: a cut character at the end is dropped."""
    cut = F.substring(F.encode(s, "UTF-8"), 1, size)
    tail = F.regexp_replace(F.decode(F.make_valid_utf8(cut.cast("string")).cast("binary"), "UTF-8"), "�+$", "")
    return F.when(F.octet_length(s) <= size, s).otherwise(tail)


def language(path: Column) -> Column:
    """Language of a path by its extension, with case; a name that only begins with a dot has none."""
    extension = F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)
    return F.element_at(_literal_map(LANGUAGES), F.when(extension != "", extension))


def has_symbols(lang: Column) -> Column:
    return F.coalesce(lang.isin(*SYMBOL_LANGUAGES), F.lit(False))


def is_binary(content: Column) -> Column:
    """Whether a zero byte is in the first bytes of a blob, given as binary."""
    return F.hex(F.substring(content, 1, BINARY_PREFIX)).rlike("^(?:[0-9A-F]{2})*?00")


def expand_tabs(s: Column) -> Column:
    return F.replace(s, F.lit("\t"), F.lit("    "))


def path_depth(path: Column) -> Column:
    trimmed = F.regexp_replace(path, "/+$", "")
    return F.length(trimmed) - F.length(F.replace(trimmed, F.lit("/"), F.lit("")))


def line_count(s: Column) -> Column:
    """Lines of a text; a line end at the end begins no further line."""
    feeds = F.length(s) - F.length(F.replace(s, F.lit("\n"), F.lit("")))
    return F.when(s == "", 0).otherwise(feeds + F.when(F.endswith(s, F.lit("\n")), 0).otherwise(1))


def commit_line(short_id: Column, ts: Column, message: Column) -> Column:
    return F.concat_ws(" ", short_id, F.date_format(ts, "yyyy-MM-dd HH:mm"), F.substring_index(message, "\n", 1))


def doc_label(kind: Column, path: Column, oid: Column, line_start: Column, line_end: Column, title: Column) -> Column:
    """``kind place:lines  — title``, the place a path or, of a commit, its oid."""
    lines = F.when(line_start.isNotNull() & line_end.isNotNull(), F.concat(F.lit(":"), line_start.cast("string"), F.lit("-"), line_end.cast("string"))).otherwise("")
    return F.concat(F.rpad(kind, F.lit(6), F.lit(" ")), F.lit(" "), F.coalesce(path, oid), lines, F.lit("  — "), F.coalesce(title, F.lit("")))


def l2_normalize(vec: Column) -> Column:
    """The vector at length 1; one shorter than 1e-12 stays as it is."""
    wide = F.transform(vec, lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(wide, F.lit(0.0), lambda a, x: a + x * x))
    # Bound to a lambda's argument the norm is worked out once; as an expression within one, again for each component.
    bound = F.array(F.struct(wide.alias("v"), norm.alias("n")))
    return F.get(F.transform(bound, lambda b: F.when(b["n"] < 1e-12, b["v"]).otherwise(F.transform(b["v"], lambda x: x / b["n"]))), F.lit(0))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
