"""Structured Streaming over observations of repository heads."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomline.session import checkpoint_dir


def read_observations(spark: SparkSession, path: str) -> DataFrame:
    """A stream of (repo, seen_at, oid, ref) from loads of commits: what a poll would have seen as head."""
    schema = spark.read.parquet(path).schema
    if os.path.isdir(path):
        stream = spark.readStream.schema(schema).parquet(path)
    else:
        stream = spark.readStream.schema(schema).option("pathGlobFilter", os.path.basename(path)).parquet(os.path.dirname(path))
    return stream.select("repo", F.col("loaded_at").alias("seen_at"), "oid", F.lit("main").alias("ref")).where("repo IS NOT NULL AND oid IS NOT NULL")


def _emit_changes(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows of a repo whose (oid, ref) differs from the one before; the last one is the state."""
    last = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values(["seen_at", "oid"])
    out = []
    for seen_at, oid, ref in zip(rows["seen_at"], rows["oid"], rows["ref"], strict=True):
        if (oid, ref) != tuple(last):
            out.append((key[0], seen_at, last[0], oid, ref))
            last = (oid, ref)
    state.update(last)
    yield pd.DataFrame(out, columns=["repo", "seen_at", "old_oid", "new_oid", "ref"])


def watch_heads(observations: DataFrame) -> DataFrame:
    """The stream of head changes: (repo, seen_at, old_oid, new_oid, ref); an unchanged head emits nothing."""
    return observations.groupBy("repo").applyInPandasWithState(
        _emit_changes, "repo string, seen_at timestamp, old_oid string, new_oid string, ref string", "oid string, ref string", "append", GroupStateTimeout.NoTimeout
    )


def head_changes(observations: DataFrame) -> DataFrame:
    """Runs the stream over all that is there now, and returns the changes it wrote to the shared folder."""
    spark = observations.sparkSession
    folder = f"{checkpoint_dir(spark)}/heads-{uuid.uuid4().hex}"
    changes = watch_heads(observations)
    query = changes.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(changes.schema).parquet(f"{folder}/out")


def follow(observations: DataFrame, refresh: Callable[[DataFrame, int], Any], checkpoint: str, interval: str = "5 seconds"):
    """Polls at an interval and hands each batch of head changes to ``refresh``, such as an incremental build."""
    return watch_heads(observations).writeStream.foreachBatch(refresh).option("checkpointLocation", checkpoint).trigger(processingTime=interval).start()


def debounce(events: DataFrame, key: str, at: str, value: str, quiet: str, late: str = "10 minutes") -> DataFrame:
    """The last value of each burst of events, once the burst has been quiet: a session window with a watermark."""
    burst = F.session_window(at, quiet)
    return events.withWatermark(at, late).groupBy(key, burst).agg(F.max_by(value, at).alias(value), F.max(at).alias(at))
