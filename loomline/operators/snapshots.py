"""Change sets between full snapshots of keyed tables, delivered periodically and not always cleanly."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.session import BROADCAST_ROWS, cut


def canonical_path(path: Column) -> Column:
    """A path relative to the repository root: no leading ``./`` or ``/``, no ``/./`` and no doubled slash."""
    return F.regexp_replace(F.regexp_replace(path, r"(?<=/)(?:\./|/)+", ""), r"^(?:\./|/)+", "")


def snapshot_catalog(deliveries: DataFrame, group: str, version: str, delivery: str) -> DataFrame:
    """One row for each snapshot of a group: the delivery that holds, and the snapshots before and after it.

    The window runs over snapshots, not over their rows, so a group with a third of all rows stays small here.
    """
    by_group = Window.partitionBy(group).orderBy(version)
    return (
        deliveries.groupBy(group, version)
        .agg(F.max(delivery).alias(delivery))
        .withColumn("next_version", F.lead(version).over(by_group))
        .withColumn("has_previous", F.lag(version).over(by_group).isNotNull())
    )


def snapshot_changes(
    rows: DataFrame,
    *,
    group: str,
    version: str,
    delivery: str,
    key: Column,
    content: list[Column],
    keep: Column | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Records added, modified or deleted between each snapshot of a group and the one delivered before it.

    A full outer join on the primary key compares canonical row hashes: a missing side is an addition or a
    deletion, unequal hashes are a modification. The two sides are a snapshot's own rows, and the same rows
    labelled with the number of the snapshot that follows; each is shuffled once, by the join key, which also
    serves to merge repeated rows (first map-side). The key holds path and snapshot, so no group is hot.

    rows: all deliveries of all snapshots. key: the canonical record key. content: the canonical columns whose
    difference counts as a modification. keep: which rows are records (others only prove that a snapshot was
    delivered). Returns (group, version, key, change), named as the arguments and ``key``.

    Defined cases: the highest delivery of a snapshot replaces the others wholly, a null delivery being the
    lowest; rows with a null group, version or key are no records; a key that occurs more than once in the
    delivery counts once, by its lowest hash; null content equals null content only; a group's first snapshot
    yields nothing; a snapshot without records deletes all; an empty table gives an empty result. Other columns
    are not read, so their names cannot clash.
    """
    lowest = F.lit(-(2**31)).cast("long")
    marks = [F.when(c.isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), c.cast("string"))) for c in content]
    clean = rows.select(
        F.col(group).alias("_g"),
        F.col(version).cast("long").alias("_v"),
        F.coalesce(F.col(delivery).cast("long"), lowest).alias("_d"),
        key.alias("_k"),
        F.xxhash64(*marks).alias("_h"),
        (keep if keep is not None else F.lit(True)).alias("_keep"),
    ).where("_g IS NOT NULL AND _v IS NOT NULL")
    catalog = cut(snapshot_catalog(clean, "_g", "_v", "_d"))
    small = catalog.count() <= broadcast_rows
    current = (
        clean.where("_keep AND _k IS NOT NULL")
        .join(F.broadcast(catalog) if small else catalog, ["_g", "_v", "_d"])
        .select("_g", "_k", "_v", "_h", "next_version", "has_previous")
    )
    after = current.where("has_previous").groupBy("_g", "_k", F.col("_v").alias("_at")).agg(F.min("_h").alias("new_hash"))
    before = current.where("next_version IS NOT NULL").groupBy("_g", "_k", F.col("next_version").alias("_at")).agg(F.min("_h").alias("old_hash"))
    change = F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "deleted").when(F.col("old_hash") != F.col("new_hash"), "modified")
    return (
        after.join(before, ["_g", "_k", "_at"], "full_outer")
        .select(F.col("_g").alias(group), F.col("_at").cast("int").alias(version), F.col("_k").alias("key"), change.alias("change"))
        .where("change IS NOT NULL")
    )


def file_changes(tree_snapshots: DataFrame, kind: str | None = "file", **options: object) -> DataFrame:
    """``snapshot_changes`` of tree entries: (repo, snapshot_no, path, change); kind None takes directories too."""
    entry = F.col("kind") if kind is None else F.lit(kind)
    return snapshot_changes(
        tree_snapshots,
        group="repo",
        version="snapshot_no",
        delivery="delivery_no",
        key=canonical_path(F.col("path")),
        content=[F.lower("blob_oid"), F.col("mode")],
        keep=F.col("kind") == entry,
        **options,
    ).withColumnRenamed("key", "path")
