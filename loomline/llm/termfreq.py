"""Occurrences and record counts of every distinct term of a collection."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A term is a maximal run of Unicode letters and numbers of the lower-cased text.
TERM = r"([\p{L}\p{N}]+)"


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(1))


def _scan_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run-length scan of sorted (field, term, id, place): one partial (field, term, occurrences, records) per run.

    State between batches is the open term with its last record and place, so a run of any length needs
    constant memory. A repeated (term, record, place) comes from a record delivered again and counts once.
    """
    schema = pa.schema([("field", pa.string()), ("term", pa.string()), ("occurrences", pa.int64()), ("records", pa.int64())])
    def row(key: tuple, occurrences: int, records: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x], y.type) for x, y in zip((*key, occurrences, records), schema, strict=True)], schema=schema)

    open_key, last, total, records = None, None, 0, 0
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        field, term = (pc.dictionary_encode(batch.column(i)) for i in (0, 1))
        f, t = (c.indices.to_numpy(zero_copy_only=False) for c in (field, term))
        ids, places = (batch.column(i).to_numpy(zero_copy_only=False) for i in (2, 3))
        new_term = np.ones(n, bool)
        new_term[1:] = (t[1:] != t[:-1]) | (f[1:] != f[:-1])
        new_record = new_term.copy()
        new_record[1:] |= ids[1:] != ids[:-1]
        new_place = new_record.copy()
        new_place[1:] |= places[1:] != places[:-1]
        starts = np.flatnonzero(new_term)
        sums, counts = (np.add.reduceat(x.astype(np.int64), starts) for x in (new_place, new_record))
        names = [(field.dictionary[int(f[k])].as_py(), term.dictionary[int(t[k])].as_py()) for k in (starts[0], starts[-1])]
        if open_key == names[0]:
            sums[0] += total - (last == (ids[0], places[0]))
            counts[0] += records - (last[0] == ids[0])
        elif open_key is not None:
            yield row(open_key, total, records)
        closed = len(starts) - 1
        if closed:
            pick = pa.array(starts[:closed])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pick).cast(pa.string()), batch.column(1).take(pick).cast(pa.string()), pa.array(sums[:closed]), pa.array(counts[:closed])], schema=schema)
        open_key, last, total, records = names[1], (ids[-1], places[-1]), int(sums[-1]), int(counts[-1])
    if open_key is not None:
        yield row(open_key, total, records)


def term_frequencies(docs: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """(field, term, occurrences, records) of every distinct term of the fields, over all records.

    Range-partitioned external sort of (term, record) pairs, then a run-length scan of each sorted partition.
    Ranges cut on term and record id, so a term that fills a third of all pairs spreads over many partitions,
    and no record of a term is split between two; the partial runs of a term (one per partition it touches) are
    then added up.

    Defined cases: null texts and ids are no records; an empty text is a record without terms; a record
    delivered more than once counts once, and a term once at each place (number of the token in the text) where
    any delivery has it; an empty table gives an empty result. Other columns are not read.
    """
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).alias("text")) for f in fields)))
    pairs = (
        docs.where(F.col(record_id).isNotNull())
        .select(F.col(record_id).cast("long").alias("_id"), texts.alias("_x"))
        .where("_x.text IS NOT NULL")
        .select("_id", F.col("_x.field").alias("field"), F.posexplode(terms(F.col("_x.text"))).alias("place", "term"))
        .select("field", "term", "_id", "place")
    )
    ordered = pairs.repartitionByRange("field", "term", "_id").sortWithinPartitions("field", "term", "_id", "place")
    runs = ordered.mapInArrow(_scan_runs, "field string, term string, occurrences long, records long")
    return runs.groupBy("field", "term").agg(F.sum("occurrences").alias("occurrences"), F.sum("records").alias("records"))


def record_counts(docs: DataFrame, record_id: str, fields: list[str]) -> DataFrame:
    """(field, total): how many records have the field."""
    texts = F.explode(F.array(*(F.struct(F.lit(f).alias("field"), F.col(f).isNotNull().alias("has")) for f in fields)))
    has = docs.where(F.col(record_id).isNotNull()).select(F.col(record_id).alias("_id"), texts.alias("_x")).where("_x.has")
    return has.select("_id", F.col("_x.field").alias("field")).distinct().groupBy("field").agg(F.count("*").alias("total"))


def marked_terms(docs: DataFrame, record_id: str, fields: list[str], rare_below: int = 3, common_above: float = 0.10) -> DataFrame:
    """``term_frequencies`` with mark: ``rare`` in fewer than ``rare_below`` records, ``common`` in more than the
    share ``common_above`` of them, else null. A term that is both (in a tiny collection) is rare."""
    totals = F.broadcast(record_counts(docs, record_id, fields))  # one row a field
    mark = F.when(F.col("records") < rare_below, "rare").when(F.col("records") > F.col("total") * common_above, "common")
    return term_frequencies(docs, record_id, fields).join(totals, "field").select("field", "term", "occurrences", "records", mark.alias("mark"))
