"""Cutting oversized items at natural boundaries, by content-defined chunking."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Multiplier of the rolling hash (odd, so it has an inverse modulo 2^64) and the bytes it covers.
_BASE, _WINDOW = 0x9E3779B97F4A7C15, 48
_INVERSE = pow(_BASE, -1, 1 << 64)


@dataclass(frozen=True)
class Limits:
    """Bytes: the largest and smallest piece, the largest overlap, and the mean distance of landmarks."""

    largest: int = 2048
    smallest: int = 512
    overlap: int = 128
    landmark_every: int = 512


def landmarks(data: np.ndarray, every: int) -> np.ndarray:
    """Positions whose preceding window has a rolling hash of 0 modulo ``every``; they depend on those bytes only."""
    n = len(data)
    if n <= _WINDOW:
        return np.zeros(0, np.int64)
    power = np.cumprod(np.concatenate([[1], np.full(n, _BASE)]).astype(np.uint64), dtype=np.uint64)
    inverse = np.cumprod(np.concatenate([[1], np.full(n - 1, _INVERSE)]).astype(np.uint64), dtype=np.uint64)
    sums = np.concatenate([[np.uint64(0)], np.cumsum((data.astype(np.uint64) + np.uint64(1)) * inverse, dtype=np.uint64)])
    rolled = (sums[_WINDOW:] - sums[:-_WINDOW]) * power[_WINDOW - 1 : n]
    mixed = (rolled ^ (rolled >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return np.flatnonzero((mixed >> np.uint64(32)) % np.uint64(every) == 0) + _WINDOW


@dataclass(frozen=True)
class Lines:
    """Line starts, and line ends without LF or CRLF, of some bytes; blank lines hold only spaces and tabs."""

    starts: np.ndarray
    ends: np.ndarray
    blank: np.ndarray

    @staticmethod
    def of(data: np.ndarray) -> Lines:
        feeds = np.flatnonzero(data == 10)
        starts = np.concatenate([[0], feeds + 1])
        ends = np.concatenate([feeds, [len(data)]])
        crlf = (feeds > starts[:-1]) & (data[np.maximum(feeds - 1, 0)] == 13) if len(feeds) else np.zeros(0, bool)
        ends[:-1] -= crlf
        ink = np.concatenate([[0], np.cumsum((data != 32) & (data != 9))])
        return Lines(starts, ends, ink[ends] == ink[starts])


def stretches(lines: Lines) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, end) of every run of lines that are not blank."""
    ink = np.concatenate([[False], ~lines.blank, [False]])
    first, after = np.flatnonzero(~ink[:-1] & ink[1:]), np.flatnonzero(ink[:-1] & ~ink[1:])
    return lines.starts[first], lines.ends[after - 1]


def boundary_kind(lines: Lines, largest: int) -> str:
    first, end = stretches(lines)
    if not len(first) or (end - first).max() <= largest:
        return "paragraph"
    return "line" if (lines.ends - lines.starts).max() <= largest else "inside"


def cut_points(data: np.ndarray, lines: Lines, limits: Limits) -> list[int]:
    """Ends of the pieces' own parts, which follow one another and cover the data.

    The first landmark beyond the smallest size calls for a cut, which snaps to the nearest natural boundary
    within the sizes: the start of the next stretch, any place between stretches, a line, a gap between words,
    a character; a weaker kind is tried only if no boundary of a stronger one lies between the sizes. No piece
    but the last is smaller than the smallest size. A cut depends only on the one before it and on the bytes
    up to the largest size after it, so pieces fall in step again soon after an edit.
    """
    n = len(data)
    marks = landmarks(data, limits.landmark_every)
    first, end = stretches(lines)
    next_stretch = first[1:]
    between = [end[:-1]]
    gap = lines.blank.copy()
    gap[1:] |= lines.blank[:-1]  # line starts next to a blank line
    between.append(lines.starts[gap])
    spaces = np.flatnonzero((data[:-1] == 32) | (data[:-1] == 9)) + 1 if n else np.zeros(0, np.int64)
    kinds = (next_stretch, np.unique(np.concatenate(between)), lines.starts[1:], spaces)
    out, at = [], 0
    while n - at > limits.largest:
        low, high = at + limits.smallest, at + limits.largest
        i = np.searchsorted(marks, low)
        wish = int(marks[i]) if i < len(marks) and marks[i] <= high else high
        cut = None
        for places in kinds:
            b, c = np.searchsorted(places, (low, high + 1))
            if b < c:
                window = places[b:c]
                cut = int(window[np.argmin(np.abs(window - wish))])
                break
        if cut is None:
            whole = [p for p in range(max(low, wish - 4), min(high, wish + 4) + 1) if (data[p] & 0xC0) != 0x80 and not (data[p] == 10 and data[p - 1] == 13)]
            cut = min(whole, key=lambda p: abs(p - wish), default=wish)
        out.append(cut)
        at = cut
    return [*out, n]


def overlap_start(data: np.ndarray, lines: Lines, start: int, end: int, before: int, limits: Limits) -> int:
    """Where the piece whose own part is [start, end) begins, with what it repeats of the piece before, which
    begins at ``before``: at a line or word within the overlap if there is one, else at a character."""
    low = max(before, start - min(limits.overlap, limits.largest - (end - start)))
    if low >= start:
        return start
    i = np.searchsorted(lines.starts, low)
    if i < len(lines.starts) and lines.starts[i] < start:
        return int(lines.starts[i])
    gaps = np.flatnonzero((data[low : start - 1] == 32) | (data[low : start - 1] == 9))
    if len(gaps):
        return int(low + gaps[0] + 1)
    while low < start and (data[low] & 0xC0) == 0x80:
        low += 1
    return low


def pieces_of(data: np.ndarray, lines: Lines, limits: Limits) -> list[tuple[int, int, int]]:
    """(start, own start, end) of every piece."""
    out, at = [], 0
    for cut in cut_points(data, lines, limits):
        start = overlap_start(data, lines, at, cut, out[-1][0], limits) if out else at
        out.append((start, at, cut))
        at = cut
    return out


def locate(lines: Lines, size: int, line_start, line_end, byte_start, byte_end) -> tuple[int, int] | None:
    """The byte range of a span: see ``cut_spans``."""
    if line_start is None or line_end is None:
        return None
    line_start, line_end = sorted((int(line_start), int(line_end)))
    if byte_start is not None and byte_end is not None:
        a, b = sorted((int(byte_start), int(byte_end)))
        if 0 <= a < b <= size:
            on = np.searchsorted(lines.starts, (a, b - 1), side="right")
            if on[0] == line_start and on[1] == line_end:
                return a, b
    first, last = max(line_start, 1), min(line_end, len(lines.starts))
    return (int(lines.starts[first - 1]), int(lines.ends[last - 1])) if first <= last else None


PIECE_TYPE = "span_id {span}, file_id {file}, piece_no int, pieces int, byte_start long, byte_end long, overlap int, boundary string, text string"


def cut_spans(spans: DataFrame, files: DataFrame, limits: Limits = Limits(), spans_at_once: int = 512) -> DataFrame:
    """(span_id, file_id, piece_no, pieces, byte_start, byte_end, overlap, boundary, text): the pieces of every
    span of more than ``limits.largest`` bytes, numbered from 0, byte offsets into the file's UTF-8 content.

    Content-defined chunking: landmarks of a rolling hash snap to the nearest natural boundary within the
    smallest and largest size, so that an edit alters only neighbouring pieces. A piece begins with ``overlap``
    bytes of the piece before. boundary tells how good the span's natural boundaries are: ``paragraph`` if no
    stretch between blank lines exceeds the largest size, else ``line`` if no line does, else ``inside``.

    A span is its bytes if they are given, lie in the content and begin and end on its lines, else its whole
    lines without the last line end; swapped ends are put in order. Spans are gathered in bins of about
    ``spans_at_once`` of a file, so a file with very many spans is spread over tasks, and a file's content is
    joined to each bin once.

    Defined cases: spans with a null id, file or line, spans of no file, of a null content, or wholly outside
    its lines have no pieces, nor have spans within the size; lines beyond the content are left out; rows
    repeated under one span id of a file count once (the least in column order); of a file given more than once
    the least content counts; offsets that fall within a character give the replacement character in ``text``
    only. Empty tables give an empty result. Extra columns are not read.
    """
    fields = ("line_start", "line_end", "byte_start", "byte_end")
    known = spans.select("span_id", "file_id", *fields).where("span_id IS NOT NULL AND file_id IS NOT NULL")
    counts = known.groupBy("file_id").agg(F.ceil(F.count("*") / spans_at_once).alias("_bins"))
    bins = (
        known.join(counts, "file_id")
        .groupBy("file_id", F.pmod(F.xxhash64("span_id"), F.col("_bins")).alias("_bin"))
        .agg(F.collect_set(F.struct("span_id", *fields)).alias("_spans"))
        .drop("_bin")
    )
    contents = files.select("file_id", "content").where("file_id IS NOT NULL AND content IS NOT NULL").groupBy("file_id").agg(F.min("content").alias("content"))
    types = dict(known.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["span_id", "file_id", "piece_no", "pieces", "byte_start", "byte_end", "overlap", "boundary", "text"]
        for batch in batches:
            rows = []
            for file_id, content, of_file in zip(batch["file_id"], batch["content"], batch["_spans"], strict=True):
                raw = content.encode("utf-8")
                data = np.frombuffer(raw, np.uint8)
                lines = Lines.of(data)
                unique: dict = {}
                for s in of_file:
                    s = s.asDict() if hasattr(s, "asDict") else s
                    key = tuple((s[f] is not None, s[f] or 0) for f in fields)
                    if s["span_id"] not in unique or key < unique[s["span_id"]][0]:
                        unique[s["span_id"]] = (key, s)
                for span_id in sorted(unique):
                    s = unique[span_id][1]
                    place = locate(lines, len(raw), *(s[f] for f in fields))
                    if place is None or place[1] - place[0] <= limits.largest:
                        continue
                    part = data[place[0] : place[1]]
                    own = Lines.of(part)
                    kind = boundary_kind(own, limits.largest)
                    found = pieces_of(part, own, limits)
                    for k, (a, core, b) in enumerate(found):
                        rows.append((span_id, file_id, k, len(found), place[0] + a, place[0] + b, core - a, kind, raw[place[0] + a : place[0] + b].decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=columns)

    return contents.join(bins, "file_id").mapInPandas(run, PIECE_TYPE.format(span=types["span_id"], file=types["file_id"]))
