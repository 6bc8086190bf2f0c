"""Filling fixed-capacity containers with items of varying length under several limits at once."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Tasks of the packing, at most; with more groups than that a task packs several.
MAX_TASKS = 20_000


def utf8_tokens(text: Column) -> Column:
    """Tokens of the public byte-level tokenizer ByT5 without end mark: one for each UTF-8 byte."""
    return F.octet_length(text)


def prompt_tokens(text: Column) -> Column:
    """Tokens up to and with the first blank line: the heading of a text, which bears no loss."""
    return F.octet_length(F.regexp_extract(text, r"(?s)^(.*?\n[ \t\r]*\n)", 1))


def pack_vectors(sizes: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bin, position) of every item, by the dot-product heuristic for vector bin packing.

    One bin is open at a time. Of the items that fit in every dimension it takes the one whose size vector has
    the largest dot product with what is left of the bin, both as shares of the limits; if none fits, the next
    bin opens. Items of equal size vector are interchangeable, so the choice runs over distinct vectors. Ties go
    to the larger vector in order of the dimensions, equal items to the first one.
    """
    n = len(sizes)
    bins, positions = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, positions
    kinds, inverse, counts = np.unique(sizes, axis=0, return_inverse=True, return_counts=True)
    kinds, inverse, counts = kinds[::-1], len(kinds) - 1 - inverse.ravel(), counts[::-1].copy()
    members = np.split(np.argsort(inverse, kind="stable"), np.cumsum(counts)[:-1])
    taken, shares = np.zeros(len(kinds), np.int64), kinds / limits
    alive = np.arange(len(kinds))
    left, current, position = limits.astype(np.int64).copy(), 0, 0
    fits = alive
    while len(alive):
        fits = fits[(kinds[fits] <= left).all(axis=1) & (counts[fits] > 0)]
        if not len(fits):
            alive = alive[counts[alive] > 0]
            if position == 0 and len(alive):
                raise ValueError("an item is larger than the limits")
            left, current, position, fits = limits.astype(np.int64).copy(), current + 1, 0, alive
            continue
        best = int(fits[np.argmax(shares[fits] @ (left / limits))])
        item = members[best][taken[best]]
        bins[item], positions[item] = current, position
        taken[best] += 1
        counts[best] -= 1
        left -= kinds[best]
        position += 1
    return bins, positions


def pieces(docs: DataFrame, item_id: str, text: str, capacity: int, tokens: Callable[[Column], Column] = utf8_tokens, prompt: Callable[[Column], Column] = prompt_tokens, max_loss_tokens: int | None = None) -> DataFrame:
    """(id, piece, pieces, token_start, token_end, loss_tokens): a text within both limits is one piece. A longer
    one is cut so that each piece keeps them: every ``capacity`` tokens as long as these lie in its heading, which
    bears no loss, then where the loss-bearing tokens reach their limit or the tokens the capacity."""
    most_loss = min(capacity, max_loss_tokens if max_loss_tokens is not None else capacity)
    n, head = F.col("_n"), F.col("_head")
    known = docs.select(F.col(item_id).alias("_id"), tokens(F.col(text)).cast("long").alias("_n"), prompt(F.col(text)).cast("long").alias("_p")).where("_n IS NOT NULL")
    # Whole pieces of the heading; the end of the piece in which loss begins; pieces of loss-bearing tokens alone.
    sized = known.withColumn("_head", F.when(F.col("_p") < n, F.floor(F.col("_p") / capacity)).otherwise(F.greatest(F.lit(0).cast("long"), F.ceil(n / capacity) - 1)))
    sized = sized.withColumn("_mixed", F.least(n, (head + 1) * capacity, F.greatest(F.col("_p"), head * capacity) + most_loss))
    sized = sized.withColumn("_pieces", (head + 1 + F.ceil((n - F.col("_mixed")) / most_loss)).cast("int"))
    i = F.col("_i")
    start = F.when(i <= head, i * capacity).otherwise(F.col("_mixed") + (i - head - 1) * most_loss)
    end = F.when(i < head, (i + 1) * capacity).when(i == head, F.col("_mixed")).otherwise(F.least(n, F.col("_mixed") + (i - head) * most_loss))
    return (
        sized.withColumn("_i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_pieces") - 1)))
        .withColumns({"_start": start, "_end": end})
        .select(
            "_id",
            i.cast("int").alias("piece"),
            F.col("_pieces").alias("pieces"),
            F.col("_start").alias("token_start"),
            F.col("_end").alias("token_end"),
            F.greatest(F.lit(0).cast("long"), F.col("_end") - F.greatest("_start", "_p")).alias("loss_tokens"),
        )
    )


def pack(
    docs: DataFrame,
    item_id: str = "doc_id",
    text: str = "text",
    *,
    capacity: int = 4096,
    max_segments: int = 64,
    max_loss_tokens: int = 4096,
    group_items: int = 8192,
    tokens: Callable[[Column], Column] = utf8_tokens,
    prompt: Callable[[Column], Column] = prompt_tokens,
) -> DataFrame:
    """The container and position of every text or piece, by vector bin packing with the dot-product heuristic.

    A container holds at most ``capacity`` tokens, ``max_segments`` texts and ``max_loss_tokens`` loss-bearing
    tokens (those after a text's heading). Only a text that exceeds a limit by itself is split. Pieces, without their texts,
    are spread by hash over groups of about ``group_items`` and each group is packed by one task: groups have
    bounded size whatever the input, cost grows in proportion, and each group leaves at most about one container
    partly empty, under 0.1 % of its containers.

    Returns (id, piece, pieces, token_start, token_end, loss_tokens, container, position); containers are
    numbered group * 2^32 + n.

    Defined cases: a null text has no tokens and no row; an empty text is an item without tokens and takes a
    segment; texts repeated under other ids are items of their own, repeated ids too; an empty table gives an
    empty result. Extra columns are not read.
    """
    if min(capacity, max_segments, max_loss_tokens) < 1:
        raise ValueError("the limits must be positive")
    items = pieces(docs, item_id, text, capacity, tokens, prompt, max_loss_tokens)
    groups = max(1, -(-items.count() // group_items))
    limits = np.array([capacity, max_loss_tokens, max_segments])

    def pack_group(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["_id", "piece", "token_end"], kind="stable", ignore_index=True)
        sizes = np.column_stack([rows.token_end - rows.token_start, rows.loss_tokens, np.ones(len(rows), np.int64)])
        bins, positions = pack_vectors(sizes, limits)
        rows["container"] = (rows["_group"].to_numpy(np.int64) << 32) + bins
        rows["position"] = positions.astype(np.int32)
        return rows.drop(columns="_group")

    kind = dict(items.dtypes)["_id"]
    # The rows are few bytes but seconds of work a group, so the number of tasks follows the groups, not the bytes.
    return (
        items.withColumn("_group", F.pmod(F.xxhash64("_id", "piece"), F.lit(groups)).cast("int"))
        .repartition(min(groups, MAX_TASKS), "_group")
        .groupBy("_group")
        .applyInPandas(pack_group, f"_id {kind}, piece int, pieces int, token_start long, token_end long, loss_tokens long, container long, position int")
        .withColumnRenamed("_id", item_id)
    )


def container_report(packed: DataFrame, capacity: int = 4096) -> DataFrame:
    """One row: containers, items, tokens and the share of the containers' space that is used."""
    tokens = F.sum(F.col("token_end") - F.col("token_start"))
    per = packed.groupBy("container").agg(F.count("*").alias("items"), tokens.alias("tokens"))
    return per.agg(F.count("*").alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), (F.sum("tokens") / (F.count("*") * capacity)).alias("fill"))
