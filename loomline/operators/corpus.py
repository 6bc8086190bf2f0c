"""Cutting commits and files into the documents of an index."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.functions.symbols import scan_symbols

#: A symbol of fewer lines than this is no document.
MIN_SYMBOL_LINES = 2

CHUNK_COLUMNS = ["chunk_kind", "commit_oid", "path", "symbol_name", "symbol_kind", "line_start", "line_end", "title", "body", "author_time", "embed_text"]


def indexable(files: DataFrame) -> DataFrame:
    """Files that are read: not null, not binary and not too large."""
    content = F.col("content")
    return files.where(content.isNotNull() & (F.octet_length(content) <= T.MAX_FILE_BYTES) & ~T.is_binary(F.encode(content, "UTF-8")))


def commit_chunks(commits: DataFrame) -> DataFrame:
    """One document a commit: title is the first line, body the rest. A null message has none."""
    m = F.col("message")
    split = commits.where(m.isNotNull()).withColumns({"title": T.message_title(m), "body": T.message_body(m)})
    return split.select(
        F.lit("commit").alias("chunk_kind"),
        F.col("oid").alias("commit_oid"),
        "title",
        "body",
        F.unix_timestamp("ts").alias("author_time"),
        F.when(F.col("body") == "", F.col("title")).otherwise(F.concat("title", F.lit("\n"), "body")).alias("embed_text"),
    )


SYMBOL_TYPE = "kind string, name string, line_start int, line_end int, byte_start long, byte_end long"


def symbols(files: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The top-level symbols of each file whose language has them, with the ``keep`` columns (default the id)."""
    keep = ["file_id"] if keep is None else keep
    known = files.withColumn("_language", T.language(F.col("path"))).where(T.has_symbols(F.col("_language")) & F.col("content").isNotNull())
    types = dict(known.dtypes)
    schema = ", ".join([*(f"`{c}` {types[c]}" for c in keep), SYMBOL_TYPE, "text string"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for row in batch.itertuples(index=False):
                values = row._asdict() if hasattr(row, "_asdict") else dict(zip(batch.columns, row, strict=True))
                raw = values["content"].encode("utf-8")
                for s in scan_symbols(values["content"], values["language"]):
                    rows.append((*(values[c] for c in keep), *s, raw[s[4] : s[5]].decode("utf-8", "replace")))
            yield pd.DataFrame(rows, columns=[*keep, "kind", "name", "line_start", "line_end", "byte_start", "byte_end", "text"])

    wanted = list(dict.fromkeys([*keep, "content"]))
    return known.select(*wanted, F.col("_language").alias("language")).mapInPandas(run, schema)


def whole_documents(files: DataFrame) -> DataFrame:
    """One document a file."""
    return files.select(
        F.lit("file").alias("chunk_kind"),
        "commit_oid",
        "path",
        F.col("path").alias("title"),
        F.col("content").alias("body"),
        F.concat("path", F.lit("\n"), T.truncate_bytes(F.col("content"), T.EMBED_BYTES)).alias("embed_text"),
    )


def file_chunks(files: DataFrame) -> DataFrame:
    """Documents of files: a small file is one, a large one is cut into its symbols if there are any of at least
    two lines, else it is one too. The large branch alone goes through Python."""
    usable = indexable(files).select("file_id", "commit_oid", "path", "content")
    large = (F.octet_length("content") >= T.WHOLE_FILE_BYTES) & T.has_symbols(T.language(F.col("path")))
    cut = symbols(usable.where(large), ["file_id", "commit_oid", "path"]).where(F.col("line_end") - F.col("line_start") >= MIN_SYMBOL_LINES - 1)
    parts = cut.select(
        F.lit("symbol").alias("chunk_kind"),
        "commit_oid",
        "path",
        F.col("name").alias("symbol_name"),
        F.col("kind").alias("symbol_kind"),
        "line_start",
        "line_end",
        F.concat("name", F.lit(" ("), "path", F.lit(")")).alias("title"),
        F.col("text").alias("body"),
        F.concat("path", F.lit(" "), "name", F.lit("\n"), "text").alias("embed_text"),
    )
    uncut = usable.where(large).join(cut.select("file_id").distinct(), "file_id", "left_anti")
    whole = whole_documents(usable.where(~large).unionByName(uncut))
    return parts.unionByName(whole, allowMissingColumns=True)


def chunk_meta(chunks: DataFrame) -> DataFrame:
    """Document metadata of chunks, with an id that depends on the document only: no counter, no single task."""
    key = F.concat_ws("\x1f", *(c for c in ("chunk_kind", "commit_oid", "path", "symbol_name", "line_start") if c in chunks.columns))
    columns = {c: (F.col(c) if c in chunks.columns else F.lit(None).cast("int" if c.startswith("line") else "string")) for c in ("path", "line_start", "line_end")}
    return chunks.select(F.shiftrightunsigned(F.xxhash64(key), 1).alias("doc_id"), F.col("chunk_kind").alias("kind"), "title", "commit_oid", *(c.alias(n) for n, c in columns.items()), *[c for c in ("body", "embed_text") if c in chunks.columns])
