"""The most similar vectors of every vector, by cross-polytope hashing with exact reranking."""

from __future__ import annotations

import functools
import itertools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import cut

ID = "id long"


@dataclass(frozen=True)
class Index:
    """What the index shall reach. How it hashes is fitted to the collection (see ``fit``).

    recall: share of a vector's true neighbours that shall share a cell with it. sure: that share among pairs of the
    least cosine that a search wants, if it states one. share, sure_share: share of all pairs of vectors that may share
    a cell in either case, unless no configuration that keeps it has the recall. sample: vectors from which the index is fitted, at most: the
    recall of a configuration is that of their true neighbours among all vectors. cell_limit: rows of a group that
    one task compares; larger groups are compared in pairs of blocks, in which all of their rows meet.
    """

    dim: int = 256
    recall: float = 0.93
    sure: float = 0.997
    share: float = 0.1
    sure_share: float = 0.01
    sample: int = 256
    cell_limit: int = 16384
    seed: int = 1


@dataclass(frozen=True)
class Hash:
    """Cross-polytope hash tables, ``tables`` of them. In each, a pseudo-rotated vector probes its ``axes`` nearest
    signed axes, and its cells are all sets of ``order`` of them: two vectors meet if they share so many axes."""

    tables: int
    axes: int
    order: int

    @property
    def copies(self) -> int:
        """Times a vector is shuffled: once for each axis that can be the first one of a cell."""
        return self.tables * (self.axes - self.order + 1)


#: Configurations to choose from.
ORDERS, AXES, TABLES = (2, 3), (2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 16, 20, 24), (1, 2, 3, 4, 5, 6, 8)

#: Seconds, for choosing only: a copy of a vector on its way to a task; a comparison of one vector with another in a
#: matrix product; a matrix product as such; a comparison of a listed pair.
COPY_COST, COMPARE_COST, CELL_COST, PAIR_COST = 2e-5, 28e-9, 40e-6, 2e-7

#: Cells of no more rows are compared as listed pairs, all at once.
SMALL_CELL = 16

#: Seconds of work of a task, about.
TASK_SECONDS = 4.0

#: The 6-bit cosine is off by 0.0025 (standard deviation, at 256 components); the margin is six times that.
MARGIN = 0.015

#: Fills up lists of axes.
NO_AXIS = 65535


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows, scaled to keep their length."""
    h, n = 1, x.shape[1]
    while h < n:
        x = x.reshape(len(x), -1, 2, h)
        x = np.stack([x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]], 2).reshape(len(x), n)
        h *= 2
    return x / np.sqrt(n)


@functools.lru_cache(maxsize=64)
def rotation(dim: int, seed: int) -> np.ndarray:
    """A pseudo-rotation, three rounds of random signs and Hadamard transforms, applied to the unit vectors once
    so that batches are rotated by one matrix product. Dimensions are padded to a power of two."""
    size = 1 << (dim - 1).bit_length()
    out, signs = np.eye(dim, size, dtype=np.float32), np.random.RandomState(seed)
    for _ in range(3):
        out = hadamard(out * signs.choice([-1, 1], size).astype(np.float32)).astype(np.float32)
    return out


def nearest_axes(x: np.ndarray, seed: int, axes: int) -> np.ndarray:
    """The ``axes`` signed axes nearest to each rotated vector, in order of their numbers."""
    y = x @ rotation(x.shape[1], seed)
    signed = np.concatenate([y, -y], axis=1)
    axes = min(axes, y.shape[1])
    return np.sort(np.argpartition(-signed, axes - 1, axis=1)[:, :axes], axis=1)


def table_seed(index: Index, table: int) -> int:
    return index.seed * 1000 + table * 10


def shared_axes(x: np.ndarray, y: np.ndarray, index: Index, tables: int, axes: tuple[int, ...]) -> dict[int, np.ndarray]:
    """For each number of axes: (tables, rows) with how many nearest axes x[i] and y[i] share in each table."""
    out = {a: np.zeros((tables, len(x)), int) for a in axes}
    most = max(axes)
    for t in range(tables):
        r = rotation(index.dim, table_seed(index, t))
        ranks = []
        for z in (x @ r, y @ r):
            signed = np.concatenate([z, -z], axis=1)
            top = np.argpartition(-signed, min(most, signed.shape[1]) - 1, axis=1)[:, :most]
            top = np.take_along_axis(top, np.argsort(-np.take_along_axis(signed, top, 1), axis=1), 1)
            rank = np.full(signed.shape, most, np.uint8)
            np.put_along_axis(rank, top, np.arange(top.shape[1], dtype=np.uint8)[None, :], 1)
            ranks.append(rank)
        both = np.maximum(*ranks)  # both have the axis among their first so many
        for a in axes:
            out[a][t] = (both < a).sum(axis=1)
    return out


def synthetic_pairs(index: Index, cosine: float, pairs: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """Random pairs of unit vectors of one cosine."""
    rng = np.random.RandomState(index.seed)
    a, b = rng.randn(2, pairs, index.dim)
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b = cosine * a + np.sqrt(max(0.0, 1 - cosine**2)) * b / np.linalg.norm(b, axis=1, keepdims=True)
    return a.astype(np.float32), b.astype(np.float32)


def cells_met(shared: np.ndarray, axes: int, order: int) -> np.ndarray:
    """How many cells pairs of vectors share, from the axes that they share."""
    return np.array([math.comb(n, order) for n in range(axes + 1)])[shared]


def seconds(h: Hash, rows: int, dim: int, meets: float) -> float:
    """Estimated work for each vector; ``meets`` are the cells that two vectors share on average."""
    space = math.comb(2 << (dim - 1).bit_length(), h.order)
    in_cells = rows * math.comb(h.axes, h.order)  # of one table
    if in_cells <= SMALL_CELL * space:
        return h.copies * COPY_COST + rows * meets * PAIR_COST / 2
    return h.copies * COPY_COST + rows * meets * COMPARE_COST + h.tables * min(space, in_cells / 2) * CELL_COST / rows


def choose(index: Index, rows: int, near: tuple[np.ndarray, np.ndarray], any_: tuple[np.ndarray, np.ndarray], recall: float, most: float) -> Hash:
    """Of the configurations in which at least ``recall`` of the near pairs share a cell, and at most the share ``most``
    of any pairs, the one with the least work; if there is none, that of the least share that has the recall, or
    else the one of the most recall.

    As a collection grows comparisons outweigh copies, so cells become smaller parts of it.
    """
    close, random = (shared_axes(*pairs, index, max(TABLES), AXES) for pairs in (near, any_))
    options = []
    for axes in (a for a in AXES if a <= index.dim):
        for order in (o for o in ORDERS if o <= axes):
            met, others = (np.logical_or.accumulate(s[axes] >= order, axis=0) for s in (close, random))
            cells = cells_met(random[axes], axes, order)
            for tables in TABLES:
                h = Hash(tables, axes, order)
                reached = met[tables - 1].mean() if len(near[0]) else 1.0
                share = others[tables - 1].mean() if len(any_[0]) else 0.0
                meets = cells[:tables].sum(axis=0).mean() if len(any_[0]) else 0.0
                if reached < recall:
                    key = (2, -reached)
                else:
                    key = (1, share) if share > most else (0, seconds(h, max(rows, 2), index.dim, meets))
                options.append((key, h.copies, h.order, h))
    return min(options, key=lambda o: o[:3])[3]


def _binary(rows: np.ndarray) -> pa.Array:
    """One fixed-size byte string for each row of a matrix, as a binary column."""
    raw = np.ascontiguousarray(rows)
    width = raw.shape[1] * raw.itemsize
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * width
    return pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(raw.tobytes())])


def decode(codes: pd.Series | list, dim: int) -> np.ndarray:
    """Vectors from their bytes, half or single precision, as their length tells."""
    out = np.empty((len(codes), dim), np.float32)
    for kind in (np.float16, np.float32):
        at = [i for i, c in enumerate(codes) if len(c) == dim * np.dtype(kind).itemsize]
        if at:
            out[at] = np.frombuffer(b"".join(codes[i] for i in at), kind).reshape(-1, dim)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    scale = np.abs(x).max(axis=1, keepdims=True)
    x = x / scale
    return (x / np.sqrt((x * x).sum(axis=1, keepdims=True))).astype(np.float32)


def encode(vectors: DataFrame, dim: int) -> DataFrame:
    """(id, at, code): the vector as bytes, in half precision where that is exact, or null if it is invalid."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vec = batch.column(2)
            sizes = vec.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            right = np.flatnonzero(sizes == dim)
            flat = vec.take(pa.array(right)).flatten().cast(pa.float32())
            x = flat.fill_null(np.nan).to_numpy(zero_copy_only=False).reshape(-1, dim)
            ok = np.isfinite(x).all(axis=1) & (x != 0).any(axis=1)
            with np.errstate(over="ignore"):
                half = x.astype(np.float16)
                exact = ok & (half.astype(np.float32) == x).all(axis=1)
            rest = np.flatnonzero(ok & ~exact)
            at = np.full(len(batch), -1, np.int64)
            at[right[exact]] = np.arange(exact.sum())
            at[right[rest]] = exact.sum() + np.arange(len(rest))
            codes = pa.chunked_array([_binary(half[exact]), _binary(x[rest])]).combine_chunks()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), codes.take(pa.array(at, mask=at < 0))], names=["id", "at", "code"])

    return vectors.mapInArrow(run, "id long, at timestamp, code binary")


def current_vectors(vectors: DataFrame, keep: DataFrame | None, dim: int, item_id: str, vec: str, at: str) -> DataFrame:
    """(id, code) of every id whose latest vector is valid and which ``keep`` has: one shuffle of the vectors.

    Of rows with one time the greatest bytes count, so that repeated rows and ties give one result.
    """
    source = vectors.select(F.col(item_id).cast("long").alias("id"), F.col(at).cast("timestamp").alias("at"), F.col(vec).cast("array<float>").alias("vec")).where("id IS NOT NULL")
    latest = encode(source, dim).groupBy("id").agg(F.max(F.struct("at", "code")).alias("_v"))
    latest = latest.select("id", F.col("_v.code").alias("code")).where("code IS NOT NULL")
    if keep is None:
        return latest
    wanted = keep.select(F.col(item_id).cast("long").alias("id")).where("id IS NOT NULL").distinct()
    return latest.join(wanted, "id", "left_semi")


def _small(x: np.ndarray) -> np.ndarray:
    """Unit vectors in 6 bits a component, four in three bytes. They are rotated first, which keeps cosines and
    makes all components of one size, so that no vector loses more than others; the scale does not matter."""
    y = x @ rotation(x.shape[1], 0)
    q = (np.rint(y * (31 / np.abs(y).max(axis=1, keepdims=True))) + 32).astype(np.uint32)
    q = np.pad(q, ((0, 0), (0, -q.shape[1] % 4)), constant_values=32).reshape(len(q), -1, 4)
    word = q[:, :, 0] | q[:, :, 1] << 6 | q[:, :, 2] << 12 | q[:, :, 3] << 18
    return np.stack([word & 255, word >> 8 & 255, word >> 16], axis=2).astype(np.uint8).reshape(len(q), -1)


def _from_small(codes: list[bytes]) -> np.ndarray:
    """Rotated unit vectors, nearly."""
    raw = np.frombuffer(b"".join(codes), np.uint8).reshape(len(codes), -1, 3).astype(np.uint32)
    word = raw[:, :, 0] | raw[:, :, 1] << 8 | raw[:, :, 2] << 16
    x = np.stack([word & 63, word >> 6 & 63, word >> 12 & 63, word >> 18], axis=2).astype(np.float32).reshape(len(codes), -1) - 32
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


#: Groups are numbered table * TABLE_STEP + first axis.
TABLE_STEP = 1 << 24


def _batches(batches: Iterator[pa.RecordBatch], dim: int, step: int = 4096) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, unit vectors) of batches of (id, code), a bounded number at a time."""
    for batch in batches:
        for part in (batch.slice(i, step) for i in range(0, len(batch), step)):
            yield part.column(0), unit(decode(part.column(1).to_pylist(), dim))


def _groups(x: np.ndarray, index: Index, h: Hash) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(group of each vector, its axes after the first), for each place that the first axis of a cell can have."""
    for t in range(h.tables):
        near = nearest_axes(x, table_seed(index, t), h.axes)
        for i in range(near.shape[1] - h.order + 1):
            later = np.full((len(x), max(1, h.axes - 1)), NO_AXIS, np.uint16)
            later[:, : near.shape[1] - i - 1] = near[:, i + 1 :]
            yield np.int64(t) * TABLE_STEP + near[:, i], later


def to_groups(current: DataFrame, index: Index, h: Hash) -> DataFrame:
    """(cell, id, small, axes): every vector, with 6 bits a component, in the group of each axis that can be the
    first one of a cell, with its later axes, from which the task forms the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _batches(batches, index.dim):
            small = _binary(_small(x))
            for group, later in _groups(x, index, h):
                yield pa.RecordBatch.from_arrays([pa.array(group), ids, small, _binary(later)], names=["cell", "id", "small", "axes"])

    return current.select("id", "code").mapInArrow(run, "cell long, id long, small binary, axes binary")


def large_groups(current: DataFrame, index: Index, h: Hash) -> DataFrame:
    """(cell, rows) of the groups beyond the limit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for _, x in _batches(batches, index.dim):
            for group, _ in _groups(x, index, h):
                total.update(dict(zip(*np.unique(group, return_counts=True), strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int64()), pa.array([int(n) for n in total.values()], pa.int64())], names=["cell", "n"])

    counted = current.select("id", "code").mapInArrow(run, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("rows"))
    return counted.where(F.col("rows") > index.cell_limit)


def balanced(groups: DataFrame, large: DataFrame, index: Index) -> DataFrame:
    """(cell, block_a, block_b, id, small, axes, side): groups within the limit as they are; larger ones become
    pairs of blocks, in which every two rows of the group meet. large: (cell, rows) of the larger ones; there are
    no more groups than axes of the tables."""
    known = groups.join(F.broadcast(large), "cell", "left")
    blocks = F.coalesce(F.ceil(F.col("rows") * 2 / index.cell_limit), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("id"), F.col("_n")).cast("int")
    spread = known.withColumn("_n", blocks).withColumn("_b", own).withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    side = F.when(F.col("_b") == F.col("_o"), 0).when(F.col("_b") < F.col("_o"), 1).otherwise(2)
    return spread.select("cell", F.least("_b", "_o").alias("block_a"), F.greatest("_b", "_o").alias("block_b"), "id", "small", "axes", side.alias("side"))


def _cells(axes: np.ndarray, order: int) -> list[np.ndarray]:
    """Row numbers of each cell of a group with at least two rows: the rows that share ``order`` - 1 later axes."""
    if order == 1:
        return [np.arange(len(axes))]
    sets = np.array(list(itertools.combinations(range(axes.shape[1]), order - 1)))
    row, which = np.nonzero(axes[:, sets[:, -1]] != NO_AXIS)
    key = np.zeros(len(row), np.int64)
    for c in range(order - 1):
        key = key * 65536 + axes[row, sets[which, c]]
    at = np.argsort(key, kind="stable")
    row, key = row[at], key[at]
    return [c for c in np.split(row, np.flatnonzero(key[1:] != key[:-1]) + 1) if len(c) > 1]


Parts = list[tuple[np.ndarray, np.ndarray | None]]


def _parts(axes: np.ndarray, side: np.ndarray, order: int) -> tuple[Parts, np.ndarray, np.ndarray]:
    """What is compared in a group: (rows, None) for rows among themselves or (rows, rows) for those of two blocks;
    and the pairs (row, row) of all small cells, each once. A group is compared whole if its cells overlap so much
    that they would compare more."""
    cells = _cells(axes, order)
    none = np.zeros(0, np.int64)
    small, large = [c for c in cells if len(c) <= SMALL_CELL], [c for c in cells if len(c) > SMALL_CELL]
    if sum(len(c) ** 2 for c in large) >= len(axes) ** 2:
        small, large = [], [np.arange(len(axes))]
    sized = [np.array([c for c in small if len(c) == n]) for n in sorted({len(c) for c in small})]
    a, b = (np.concatenate([none, *(c[:, np.triu_indices(c.shape[1], 1)[i]].ravel() for c in sized)]) for i in (0, 1))
    once = np.unique(np.minimum(a, b) * np.int64(len(axes)) + np.maximum(a, b))
    a, b = once // max(1, len(axes)), once % max(1, len(axes))
    if not side.any():
        return [(c, None) for c in large], a, b
    two = [(c[side[c] == 1], c[side[c] == 2]) for c in large]
    cross = side[a] != side[b]
    return [(p, q) for p, q in two if len(p) and len(q)], a[cross], b[cross]


def _within_margin(row: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which entries are within the margin of the ``k``-th best of their row, or better."""
    order = np.lexsort((-score, row))
    r, c = row[order], score[order]
    kth = np.minimum(np.searchsorted(r, r) + k, np.searchsorted(r, r, "right")) - 1
    keep = np.zeros(len(row), bool)
    keep[order] = c >= c[kth] - MARGIN
    return keep


def compare_rows(x: np.ndarray, parts: Parts, listed_a: np.ndarray, listed_b: np.ndarray, k: int, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, other row, cosine), each pair from either side: for each row those that it meets in the parts and the
    listed pairs and that are within the margin of its ``k``-th best of them, or better, and reach ``least``."""
    rows, cols, scores = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.float32)]

    def add(p: np.ndarray, q: np.ndarray, score: np.ndarray, same: bool) -> None:
        if least > -1:
            a, b = np.nonzero(score >= least)
        else:
            n = min(k + same, score.shape[1])
            a, b = np.nonzero(score >= np.partition(score, score.shape[1] - n, axis=1)[:, score.shape[1] - n, None] - MARGIN)
        keep = p[a] != q[b]
        rows.append(p[a][keep])
        cols.append(q[b][keep])
        scores.append(score[a[keep], b[keep]])

    for p, q in parts:
        for i in range(0, len(p), 1024):
            block = p[i : i + 1024]
            other = p if q is None else q
            score = x[block] @ x[other].T
            add(block, other, score, q is None)
            if q is not None:
                add(other, block, np.ascontiguousarray(score.T), False)
    for i in range(0, len(listed_a), 8192):
        a, b = listed_a[i : i + 8192], listed_b[i : i + 8192]
        score = np.einsum("ij,ij->i", x[a], x[b])
        near = score >= least
        rows += [a[near], b[near]]
        cols += [b[near], a[near]]
        scores += [score[near], score[near]]
    row, col, score = (np.concatenate(v) for v in (rows, cols, scores))
    _, first = np.unique(row * np.int64(len(x)) + col, return_index=True)
    row, col, score = row[first], col[first], score[first]
    keep = _within_margin(row, score, k)
    return row[keep], col[keep], score[keep]


GROUP = ["cell", "block_a", "block_b"]


def tasks_for(groups: DataFrame, h: Hash, rows: int, work: float) -> int:
    """Groups are few bytes but much work, so the tasks follow the work (seconds a vector) and not the bytes."""
    least = int(groups.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(least, min(int(rows * work / TASK_SECONDS) + 1, 50_000))


def candidates(groups: DataFrame, h: Hash, tasks: int, k: int, least: float) -> DataFrame:
    """(id, other, score): for each vector the others that share a cell with it and whose 6-bit cosine is within the
    margin of its ``k``-th best among all that do, or better; each once."""

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        ids, side = rows["id"].to_numpy(), rows["side"].to_numpy()
        axes = np.frombuffer(b"".join(rows["axes"]), np.uint16).reshape(len(rows), -1)
        row, other, score = compare_rows(_from_small(list(rows["small"])), *_parts(axes, side, h.order), k, least)
        return pd.DataFrame({"id": ids[row], "other": ids[other], "score": score})

    found = groups.repartition(tasks, *GROUP).groupBy(*GROUP).applyInPandas(compare, "id long, other long, score float")
    # One shuffle, by id, for both: repeated pairs, and the best of each vector over all of its groups.
    once = found.repartition("id").groupBy("id", "other").agg(F.max("score").alias("score"))
    best = Window.partitionBy("id").orderBy(F.desc("score"), "other")
    kth = F.nth_value("score", k).over(best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return once.withColumn("_kth", kth).where(F.col("_kth").isNull() | (F.col("score") >= F.col("_kth") - MARGIN)).drop("_kth")


def comparisons(groups: DataFrame, h: Hash, tasks: int) -> DataFrame:
    """(compared): how many pairs all groups compare, each as often as it is compared. One row."""

    def count(rows: pd.DataFrame) -> pd.DataFrame:
        axes = np.frombuffer(b"".join(rows["axes"]), np.uint16).reshape(len(rows), -1)
        parts, pairs, _ = _parts(axes, rows["side"].to_numpy(), h.order)
        return pd.DataFrame({"compared": [len(pairs) + sum(len(p) * (len(p) - 1) // 2 if q is None else len(p) * len(q) for p, q in parts)]})

    slim = groups.withColumn("small", F.lit(None).cast("binary"))
    return slim.repartition(tasks, *GROUP).groupBy(*GROUP).applyInPandas(count, "compared long").agg(F.coalesce(F.sum("compared"), F.lit(0)).alias("compared"))


def undirected(found: DataFrame) -> DataFrame:
    """(id_a, id_b), id_a < id_b, each once."""
    return found.select(F.least("id", "other").alias("id_a"), F.greatest("id", "other").alias("id_b")).distinct()


def rerank(pairs: DataFrame, current: DataFrame, dim: int, least: float | None) -> DataFrame:
    """(id_a, id_b, cosine) of pairs, from the full vectors."""
    a, b = (current.select(F.col("id").alias(f"id_{s}"), F.col("code").alias(f"code_{s}")) for s in "ab")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (unit(decode(batch.column(i).to_pylist(), dim)).astype(np.float64) for i in (2, 3))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array((x * y).sum(axis=1))], names=["id_a", "id_b", "cosine"])

    exact = pairs.join(a, "id_a").join(b, "id_b").select("id_a", "id_b", "code_a", "code_b").mapInArrow(run, "id_a long, id_b long, cosine double")
    return exact if least is None else exact.where(F.col("cosine") >= least)


def both_ways(pairs: DataFrame) -> DataFrame:
    """(id, neighbour, cosine): each pair seen from either side, in one pass."""
    ends = F.array(F.struct(F.col("id_a").alias("id"), F.col("id_b").alias("neighbour")), F.struct(F.col("id_b").alias("id"), F.col("id_a").alias("neighbour")))
    return pairs.select(F.explode(ends).alias("_e"), "cosine").select("_e.id", "_e.neighbour", "cosine")


def top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("id").orderBy(F.desc("cosine"), "neighbour")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def copies(current: DataFrame) -> DataFrame:
    """(id, first) of the ids whose vector another id has too, byte for byte: first is the lowest of them.

    Ids only are shuffled; a group of copies, however large, is merged map-side.
    """
    hashed = current.select("id", F.xxhash64("code").alias("h1"), F.xxhash64("code", F.lit(1)).alias("h2"))
    groups = hashed.groupBy("h1", "h2").agg(F.min("id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    return hashed.join(groups, ["h1", "h2"]).select("id", "first")


def _with_copies(found: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """Neighbours of all ids from those of the first of each group of copies: copies are one another's nearest,
    and a neighbour stands for its copies; of a group the k + 1 lowest ids are enough for any list of k."""
    order = Window.partitionBy("first").orderBy("id")
    lowest = classes.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1).groupBy("first").agg(F.sort_array(F.collect_list("id")).alias("ids"))
    other = found.join(lowest.withColumnRenamed("first", "neighbour"), "neighbour", "left")
    spread = other.select("id", F.explode(F.coalesce("ids", F.array("neighbour"))).alias("neighbour"), "cosine")
    own = lowest.select(F.col("first").alias("id"), F.explode("ids").alias("neighbour"), F.lit(1.0).alias("cosine"))
    joined = spread.unionByName(own).join(classes.withColumnRenamed("id", "_member"), F.col("id") == F.col("first"), "left")
    return joined.select(F.coalesce("_member", "id").alias("id"), "neighbour", "cosine").where("id <> neighbour").distinct()


def search_blocks(queries: DataFrame, current: DataFrame, dim: int, k: int, block_rows: int = 16384) -> DataFrame:
    """Candidate pairs of a stated query set (ids) against all vectors, in tiles of query and data blocks: the ``k``
    best of each tile by the full vectors, and what single precision cannot tell from them."""
    n_q, n_d = (max(1, -(-df.count() // block_rows)) for df in (queries, current))
    own = F.xxhash64("id")

    data = current.select("id", "code")
    asked = data.join(queries.select("id").distinct(), "id", "left_semi")
    q = asked.select(F.pmod(own, F.lit(n_q)).alias("q"), F.explode(F.sequence(F.lit(0), F.lit(n_d - 1))).alias("d"), "id", "code", F.lit(1).alias("side"))
    d = data.select(F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), F.pmod(own, F.lit(n_d)).alias("d"), "id", "code", F.lit(0).alias("side"))

    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        x, ids, side = unit(decode(list(rows["code"]), dim)), rows["id"].to_numpy(), rows["side"].to_numpy()
        p, other = np.flatnonzero(side == 1), np.flatnonzero(side == 0)
        found = [np.zeros((0, 2), np.int64)]
        for i in range(0, len(p), 1024):
            part = p[i : i + 1024]
            if len(other):
                score = x[part] @ x[other].T
                score[ids[part][:, None] == ids[other][None, :]] = -2
                at = score.shape[1] - min(k, score.shape[1])
                a, b = np.nonzero(score >= np.partition(score, at, axis=1)[:, at, None] - 1e-6)
                found.append(np.column_stack([ids[part[a]], ids[other[b]]]))
        pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pd.DataFrame({"id_a": pairs[:, 0], "id_b": pairs[:, 1]})

    tiles = q.select("q", "d", "id", "code", "side").unionByName(d.select("q", "d", "id", "code", "side"))
    return tiles.repartition(max(1, n_q * n_d), "q", "d").groupBy("q", "d").applyInPandas(compare, "id_a long, id_b long").distinct()


def sample_neighbours(current: DataFrame, index: Index, k: int) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
    """(near, any): the unit vectors of a sample's vectors and of their true ``k`` nearest among all vectors, and
    those of pairs of the sample. The sample, ``index.sample`` vectors of the lowest hash, goes to all tasks; a task
    gives the best that it has for each, so what comes back is bounded too."""
    rows = current.select("id", "code").orderBy(F.xxhash64("id"), "id").limit(index.sample).collect()
    if len(rows) < 2:
        none = np.zeros((0, index.dim), np.float32)
        return (none, none), (none, none)
    ids, x = np.array([r.id for r in rows]), unit(decode([bytes(r.code) for r in rows], index.dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, who = np.full((len(x), k), -2, np.float32), np.full((len(x), k), -1, np.int64)
        for other, y in _batches(batches, index.dim):
            named = other.to_numpy(zero_copy_only=False)
            score = x @ y.T
            score[ids[:, None] == named[None, :]] = -2
            score, name = np.concatenate([best, score], axis=1), np.concatenate([who, np.broadcast_to(named, (len(x), len(named)))], axis=1)
            at = np.argpartition(-score, k - 1, axis=1)[:, :k]
            best, who = np.take_along_axis(score, at, 1), np.take_along_axis(name, at, 1)
        q, at = np.nonzero(best > -2)
        yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(who[q, at]), pa.array(best[q, at])], names=["q", "id", "score"])

    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    best = current.select("id", "code").mapInArrow(run, "q int, id long, score float").withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    pairs = best.join(current.select("id", "code"), "id").select("q", "code").collect()  # sample x k rows
    near = unit(decode([bytes(r.code) for r in pairs], index.dim)) if pairs else np.zeros((0, index.dim), np.float32)
    a, b = np.triu_indices(len(x), 1)
    some = np.random.RandomState(index.seed).permutation(len(a))[:2000]
    return (x[[r.q for r in pairs]], near), (x[a[some]], x[b[some]])


def fit(current: DataFrame, index: Index, k: int, rows: int, least_cosine: float | None = None) -> tuple[Hash, float]:
    """The hash for a collection, and its estimated work in seconds for each vector.

    Without a least cosine, recall is that of the true neighbours of a bounded sample. With one, it is that of
    random pairs of just this cosine, the hardest that are wanted; nearer pairs meet more often.
    """
    near, any_ = sample_neighbours(current, index, k)
    wanted, most = index.recall, index.share
    if least_cosine is not None:
        near, wanted, most = synthetic_pairs(index, least_cosine), index.sure, index.sure_share
    h = choose(index, rows, near, any_, wanted, most)
    shared = shared_axes(*any_, index, h.tables, (h.axes,))[h.axes]
    meets = float(cells_met(shared, h.axes, h.order).sum(axis=0).mean()) if len(any_[0]) else 0.0
    return h, seconds(h, max(rows, 2), index.dim, meets)


def search(current: DataFrame, index: Index, k: int, least_cosine: float | None = None) -> tuple[DataFrame, DataFrame, int, Hash, int]:
    """The search over (id, code), persisted: its groups, what it found as (id, neighbour, cosine), the number of
    vectors, the hash and the number of tasks."""
    rows = current.count()
    h, work = fit(current, index, k, rows, least_cosine)
    groups = balanced(to_groups(current, index, h), cut(large_groups(current, index, h)), index)
    tasks = tasks_for(groups, h, rows, work)
    found = candidates(groups, h, tasks, k, -1.0 if least_cosine is None else least_cosine - MARGIN)
    return groups, both_ways(rerank(undirected(found), current, index.dim, least_cosine)), rows, h, tasks


def nearest(
    vectors: DataFrame,
    keep: DataFrame | None = None,
    *,
    k: int = 5,
    index: Index = Index(),
    item_id: str = "doc_id",
    vec: str = "vec",
    at: str = "encoded_at",
    least_cosine: float | None = None,
) -> DataFrame:
    """(id, rank, neighbour, cosine): for every vector the k most similar others, best first, ties by lower id.

    Cross-polytope hashing: fast Hadamard pseudo-rotations assign unit vectors to the nearest signed axes, and
    multiprobe tables collect candidates: a vector probes several axes of each table, and vectors meet that share
    as many of them as a cell has. Tables, probes and axes of a cell are fitted to the collection (``fit``), so that
    its recall stays while cells become smaller parts of a larger collection. A vector is shuffled once for each
    axis that can be the first of a cell, with 6 bits a component; its other cells are formed within the task. All
    candidates within ``MARGIN`` of a vector's k-th best are then reranked by the full vectors, exactly.

    least_cosine: neighbours below it are not wanted, and are dropped as early as they are known to be below.

    Defined cases: of an id the latest vector counts (null times are the earliest, ties go to the greater
    bytes); if it is null, of another length, all zero or not finite, or ``keep`` lacks the id, the id has no
    vector; null ids are dropped; equal vectors of different ids are hashed once and are one another's nearest;
    a collection of one vector, or an empty one, gives an empty result. Extra columns are not read.

    The current vectors stay persisted for the result; ``spark.catalog.clearCache()`` lets go of them.
    """
    # Read by several jobs; kept partitioned by id, in memory as far as it goes. A lost part is computed again.
    current = current_vectors(vectors, keep, index.dim, item_id, vec, at).persist(StorageLevel.MEMORY_AND_DISK)
    return nearest_of(current, k, index, least_cosine).withColumnRenamed("id", item_id)


def nearest_of(current: DataFrame, k: int, index: Index, least_cosine: float | None = None) -> DataFrame:
    """(id, rank, neighbour, cosine) for persisted current vectors: see ``nearest``."""
    distinct, classes = distinct_vectors(current)
    return listed(search(distinct, index, k, least_cosine)[1], classes, k)


def distinct_vectors(current: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """The first of each group of copies, and the groups (see ``copies``) if there are any."""
    classes = cut(copies(current))
    if classes.isEmpty():
        return current, None
    return current.join(classes.where("id <> first").select("id"), "id", "left_anti"), classes


def listed(found: DataFrame, classes: DataFrame | None, k: int) -> DataFrame:
    """(id, rank, neighbour, cosine): the ``k`` best of what was found, for copies too."""
    best = top(found, k)
    if classes is not None:
        best = top(_with_copies(best.select("id", "neighbour", "cosine"), classes, k), k)
    return best.select("id", "rank", "neighbour", "cosine")


def similar_pairs(found: DataFrame, least_cosine: float, item_id: str = "doc_id") -> DataFrame:
    """(id_a, id_b), id_a < id_b, of pairs of at least the cosine of which one is in the other's list."""
    good = found.where(F.col("cosine") >= least_cosine)
    return good.select(F.least(item_id, "neighbour").alias("id_a"), F.greatest(item_id, "neighbour").alias("id_b")).distinct()
