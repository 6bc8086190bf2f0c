"""Top-level symbols of source text: a scanner by brace depth, and the parser of the standard library for Python."""

from __future__ import annotations

import ast
import re

#: What a declaration looks like at top level: (pattern with group ``name``, kind).
_RUST = [
    (r"(?:pub(?:\([^)]*\))?\s+)?(?:default\s+)?(?:const\s+)?(?:async\s+)?(?:unsafe\s+)?(?:extern\s+\"[^\"]*\"\s+)?fn\s+(?P<name>\w+)", "function"),
    (r"(?:pub(?:\([^)]*\))?\s+)?struct\s+(?P<name>\w+)", "struct"),
    (r"(?:pub(?:\([^)]*\))?\s+)?enum\s+(?P<name>\w+)", "enum"),
    (r"(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+(?P<name>\w+)", "trait"),
    (r"(?:pub(?:\([^)]*\))?\s+)?type\s+(?P<name>\w+)", "typealias"),
]
_JS = [
    (r"(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)", "function"),
    (r"class\s+(?P<name>[\w$]+)", "class"),
    (r"(?:const|let)\s+(?P<name>[\w$]+)\s*=\s*(?:async\s+)?(?:function\b|\([^()]*\)\s*=>|[\w$]+\s*=>)", "function"),
]
_TS = [
    (r"(?:async\s+)?function\s*\*?\s*(?P<name>[\w$]+)", "function"),
    (r"(?:abstract\s+)?class\s+(?P<name>[\w$]+)", "class"),
    (r"interface\s+(?P<name>[\w$]+)", "struct"),
    (r"type\s+(?P<name>[\w$]+)(?:<[^=]*>)?\s*=", "struct"),
]
_GO = [
    (r"func\s+\([^)]*\)\s*(?P<name>\w+)", "method"),
    (r"func\s+(?P<name>\w+)", "function"),
    (r"type\s+(?P<name>\w+)\s", "struct"),
]
_SWIFT_PRE = r"(?:@\w+(?:\([^)]*\))?\s+)*(?:(?:public|private|internal|fileprivate|open|final|static|indirect|mutating)\s+)*"
_SWIFT = [
    (_SWIFT_PRE + r"func\s+(?P<name>\w+)", "function"),
    (_SWIFT_PRE + r"class\s+(?P<name>\w+)", "class"),
    (_SWIFT_PRE + r"struct\s+(?P<name>\w+)", "struct"),
    (_SWIFT_PRE + r"enum\s+(?P<name>\w+)", "enum"),
    (_SWIFT_PRE + r"protocol\s+(?P<name>\w+)", "trait"),
    (_SWIFT_PRE + r"typealias\s+(?P<name>\w+)", "typealias"),
    (_SWIFT_PRE + r"extension\s+(?P<name>[\w.]+)", "other"),
]
_RULES = {k: [(re.compile(p), kind) for p, kind in rules] for k, rules in {"rust": _RUST, "javascript": _JS, "typescript": _TS, "tsx": _TS, "go": _GO, "swift": _SWIFT}.items()}
_RUST_BLOCK = re.compile(r"(?:unsafe\s+)?impl\b|(?:pub(?:\([^)]*\))?\s+)?(?:unsafe\s+)?trait\s+\w+")
_COMMENT = {"rust": r"//[^\n]*|/\*.*?\*/", "go": r"//[^\n]*|/\*.*?\*/"}
_STRING = {
    "rust": r"r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|b?'(?:\\.[^']*|[^'\\\n])'",
    "go": r"`[^`]*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])+'",
}
_PLAIN = r"//[^\n]*|/\*.*?\*/|`(?:\\.|[^`\\])*`|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"


def _blank(source: str, lang: str) -> str:
    """The source with comments and the insides of strings blanked out, every character kept in place."""
    pattern = f"{_COMMENT[lang]}|{_STRING[lang]}" if lang in _COMMENT else _PLAIN
    return re.sub(pattern, lambda m: re.sub(r"[^\n]", " ", m[0]), source, flags=re.S)


def _end(code: str, start: int, lang: str) -> int:
    """End of the declaration that begins at ``start``: its closing brace, or the ``;`` or line end before any."""
    depth = 0
    for m in re.compile(r"[{}()\[\];\n]").finditer(code, start):
        c = m[0]
        if c in "{([":
            depth += 1
        elif c in "})]":
            depth -= 1
            if depth < 0:
                return m.start()
            if depth == 0 and c == "}":
                return m.end()
        elif depth == 0 and c == ";":
            return m.end()
        elif depth == 0 and c == "\n" and lang in ("go", "swift", "javascript", "typescript", "tsx") and not re.match(r"\s*(?:\{|=|where\b|->|=>|\()", code[m.end() :][:80]):
            return m.start()
    return len(code.rstrip())


def _python(source: str) -> list[tuple]:
    try:
        tree = ast.parse(source.lstrip("﻿"))
    except (SyntaxError, ValueError, RecursionError):
        return []
    lead = len(source) - len(source.lstrip("﻿"))
    offsets = [lead * 3]
    for line in source.lstrip("﻿").encode("utf-8").split(b"\n"):
        offsets.append(offsets[-1] + len(line) + 1)
    out = []
    for node in tree.body:
        if isinstance(node, ast.FunctionDef | ast.AsyncFunctionDef | ast.ClassDef):
            kind = "class" if isinstance(node, ast.ClassDef) else "function"
            out.append((kind, node.name, node.lineno, node.end_lineno, offsets[node.lineno - 1] + node.col_offset, offsets[node.end_lineno - 1] + node.end_col_offset))
    return out


def scan_symbols(source: str, lang: str) -> list[tuple]:
    """(kind, name, line_start, line_end, byte_start, byte_end) of top-level symbols, and in Rust also of the
    functions in ``impl`` and ``trait`` blocks as methods. Lines count from 1; the byte end is exclusive. Nested
    symbols are left out; a source that cannot be parsed has none."""
    if lang == "python":
        return _python(source)
    rules = _RULES.get(lang)
    if not rules:
        return []
    code = _blank(source, lang)
    found: list[tuple[str, str, int, int]] = []

    def scan(start: int, stop: int, methods: bool) -> None:
        depth, at = 0, start
        for m in re.compile(r"[{}()\[\]]|(?<![\w.$])[A-Za-z@]").finditer(code, start, stop):
            c = m[0]
            if m.start() < at:
                continue
            if c in "{([":
                depth += 1
            elif c in "})]":
                depth -= 1
            elif depth == 0:
                if methods:
                    hit = rules[0][0].match(code, m.start(), stop)
                    if hit:
                        end = _end(code, m.start(), lang)
                        found.append(("method", hit["name"], m.start(), end))
                        at = end
                    continue
                for pattern, kind in rules:
                    hit = pattern.match(code, m.start(), stop)
                    if hit:
                        end = _end(code, m.start(), lang)
                        found.append((kind, hit["name"], m.start(), end))
                        at = end
                        break
                if lang == "rust" and _RUST_BLOCK.match(code, m.start(), stop):
                    end = _end(code, m.start(), lang)
                    brace = code.find("{", m.start(), end)
                    if brace >= 0:
                        scan(brace + 1, end - 1, True)
                    at = end

    scan(0, len(code), False)
    out = []
    for kind, name, a, b in sorted(found, key=lambda x: (x[2], -x[3])):
        byte = len(source[:a].encode("utf-8"))
        out.append((kind, name, source.count("\n", 0, a) + 1, source.count("\n", 0, max(a, b - 1)) + 1, byte, byte + len(source[a:b].encode("utf-8"))))
    return out
