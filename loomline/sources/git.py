"""Git repositories as Spark data sources, read through the git command line.

``spark.read.format("git_log").option("path", repo).load()`` and likewise ``git_tree``, ``git_blob`` and
``git_diff``. A log is listed once on the driver and its pages are read in parallel; trees and blobs are read by
the tasks. Option ``rev`` names the revision (default HEAD), ``to`` the second one of a diff.
"""

from __future__ import annotations

import re
import subprocess
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

PAGE = 200


class RepoNotFound(Exception):
    pass


def _git(path: str, *args: str, given: bytes | None = None) -> bytes:
    found = subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *args], input=given, capture_output=True, check=False)
    if found.returncode:
        raise RepoNotFound(f"git {args[0]} in {path}: {found.stderr.decode('utf-8', 'replace').strip()}")
    return found.stdout


def open_repo(path: str) -> str:
    """The top folder of the repository that holds the path; an error if there is none."""
    return _git(path, "rev-parse", "--show-toplevel").decode().strip()


def head_info(path: str) -> tuple[str, str] | None:
    """(oid, branch) of the head, the branch ``HEAD`` if detached; None before the first commit."""
    try:
        oid = _git(path, "rev-parse", "--verify", "HEAD").decode().strip()
    except RepoNotFound:
        return None
    return oid, _git(path, "rev-parse", "--abbrev-ref", "HEAD").decode().strip()


class _Slice(InputPartition):
    def __init__(self, first: int, items: list[str]) -> None:
        self.first, self.items = first, items


def _slices(items: list[str], size: int = PAGE) -> list[_Slice]:
    return [_Slice(i, items[i : i + size]) for i in range(0, len(items), size)]


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.path, self.rev, self.to = options["path"], options.get("rev", "HEAD"), options.get("to")


class _LogReader(_Reader):
    def partitions(self) -> list[_Slice]:
        return _slices(_git(self.path, "rev-list", "--topo-order", self.rev).decode().split())

    def read(self, part: _Slice) -> Iterator[tuple]:
        # Records end with a null byte, which no message holds; the fields before the message are lines.
        raw = _git(self.path, "show", "-s", "-z", "--format=%H%n%P%n%an <%ae>%n%ct%n%B", "--stdin", given="\n".join(part.items).encode()).decode("utf-8", "replace")
        for i, record in enumerate(r for r in raw.split("\0") if r):
            oid, parents, author, seconds, message = record.split("\n", 4)
            yield oid, oid[:7], author, datetime.fromtimestamp(int(seconds), UTC), message.strip(), part.first + i, parents.split()


class _TreeReader(_Reader):
    def partitions(self) -> list[_Slice]:
        return [_Slice(0, [self.rev])]

    def read(self, part: _Slice) -> Iterator[tuple]:
        oid = _git(self.path, "rev-parse", part.items[0]).decode().strip()
        raw = _git(self.path, "ls-tree", "-r", "-t", "-l", "-z", part.items[0]).decode("utf-8", "replace")
        pos = 0
        for record in raw.split("\0"):
            if not record:
                continue
            meta, path = record.split("\t", 1)
            mode, kind, blob, size = meta.split()
            if kind in ("blob", "tree"):  # submodules are skipped
                yield oid, pos, path.rsplit("/", 1)[-1], path, "file" if kind == "blob" else "directory", mode, blob if kind == "blob" else None, int(size) if size != "-" else None
                pos += 1


class _BlobReader(_Reader):
    def partitions(self) -> list[_Slice]:
        raw = _git(self.path, "ls-tree", "-r", "-z", self.rev).decode("utf-8", "replace")
        return _slices([r for r in raw.split("\0") if r.split(" ", 2)[1:2] == ["blob"]])

    def read(self, part: _Slice) -> Iterator[tuple]:
        # One process for all blobs of the partition: each comes as a line "oid kind size" and its bytes.
        names = [(record.split("\t", 1)[1], record.split("\t", 1)[0].split()[2]) for record in part.items]
        raw, at = _git(self.path, "cat-file", "--batch", given="".join(f"{blob}\n" for _, blob in names).encode()), 0
        for path, blob in names:
            end = raw.index(b"\n", at)
            size = int(raw[at:end].split()[-1])
            content = raw[end + 1 : end + 1 + size]
            at = end + size + 2
            yield path, blob, content, content.decode("utf-8", "replace"), b"\0" in content[:8000]


class _DiffReader(_Reader):
    def partitions(self) -> list[_Slice]:
        return [_Slice(0, [self.rev, self.to or "HEAD"])]

    def read(self, part: _Slice) -> Iterator[tuple]:
        names = {"A": "added", "D": "deleted", "M": "modified", "T": "modified"}
        raw = _git(self.path, "diff", "--no-renames", "--name-status", "-z", *part.items).decode("utf-8", "replace").split("\0")
        for status, path in zip(raw[::2], raw[1::2], strict=False):
            if status[:1] in names:
                yield path, names[status[:1]]


class _Source(DataSource):
    reader_type: type = _Reader
    columns = ""

    def schema(self) -> str:
        return self.columns

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return self.reader_type(self.options)


class GitLog(_Source):
    reader_type, columns = _LogReader, "oid string, short_id string, author string, ts timestamp, message string, topo_pos long, parents array<string>"

    @classmethod
    def name(cls) -> str:
        return "git_log"


class GitTree(_Source):
    reader_type, columns = _TreeReader, "commit_oid string, pos long, name string, path string, kind string, mode string, blob_oid string, size long"

    @classmethod
    def name(cls) -> str:
        return "git_tree"


class GitBlob(_Source):
    reader_type, columns = _BlobReader, "path string, blob_oid string, content binary, text string, is_binary boolean"

    @classmethod
    def name(cls) -> str:
        return "git_blob"


class GitDiff(_Source):
    reader_type, columns = _DiffReader, "path string, change string"

    @classmethod
    def name(cls) -> str:
        return "git_diff"


def register(spark: SparkSession) -> None:
    for source in (GitLog, GitTree, GitBlob, GitDiff):
        spark.dataSource.register(source)


def read(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format(kind).options(path=open_repo(path), **options).load()


def _glob(piece: str) -> str:
    """A regular expression for one part of an ignore pattern; no sign but a double star crosses a slash."""
    out, i = [], 0
    while i < len(piece):
        c = piece[i]
        close = piece.find("]", i + 2) if c == "[" else -1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif close > 0:
            inside = piece[i + 1 : close]
            inverted = inside[0] in "!^"
            out.append("[" + ("^/" if inverted else "") + re.sub(r"([\\\[&~|])", r"\\\1", inside[inverted:]) + "]")
            i = close
        else:
            if c == "\\" and i + 1 < len(piece):
                i += 1
                c = piece[i]
            out.append(re.escape(c))
        i += 1
    return "".join(out)


def ignore_pattern(line: str) -> tuple[str, bool] | None:
    """(regular expression over paths, whether it takes back) of a line of a ``.gitignore``; None for a comment."""
    line = line.rstrip("\n").rstrip()
    if not line or line.startswith("#"):
        return None
    keep, line = line.startswith("!"), line.removeprefix("!")
    below = line.endswith("/")
    line = line.rstrip("/")
    anchored = "/" in line
    parts = {"/**/": "/(?:.*/)?", "**/": "(?:.*/)?", "/**": "/.*", "**": ".*"}
    body = "".join(parts.get(piece) or _glob(piece) for piece in re.split(r"(/\*\*/|\*\*/|/\*\*|\*\*)", line.removeprefix("/")))
    return ("^" if anchored else "(?:^|/)") + body + ("/" if below else "(?:/|$)"), keep


def ignore_expression(path: Column, patterns: list[str]) -> Column:
    """Whether ignore patterns (of a ``.gitignore``) leave a path out: the last that matches decides, ``!`` takes
    back, a slash within anchors to the root, a trailing slash matches what is below a directory."""
    out = F.lit(False)
    for found in map(ignore_pattern, patterns):
        if found:
            out = F.when(path.rlike(found[0]), F.lit(not found[1])).otherwise(out)
    return out
