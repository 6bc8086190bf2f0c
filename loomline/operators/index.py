"""Life cycle of the persistent index: full and incremental builds, status, opening, compaction, deletion.

An index directory holds immutable segments and one pointer file::

    <dir>/meta.json              which segments hold, oldest first, and what the index was built from
    <dir>/segment=<id>/docs      documents with their metadata and texts
    <dir>/segment=<id>/postings  (field, term, doc_id, tf, dl), partitioned by field, sorted by term
    <dir>/segment=<id>/lengths   (doc_id, field, dl)
    <dir>/segment=<id>/vectors   (doc_id, vec)
    <dir>/segment=<id>/gone      (doc_id): documents of older segments that this one removes
    <dir>/segment=<id>/stats     (field, n, total): what this segment adds to, or takes from, the sums of the index

An update writes one small segment and reads no old text: statistics are sums. Segments are merged when there are
``MAX_SEGMENTS``. The pointer is replaced last and in one rename, so a build that fails leaves the old index whole;
``vacuum`` deletes what no pointer names any more.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as T
from loomline.operators import search as S
from loomline.session import cut

VERSION, TOKENIZER, VECTOR_DIM = 2, "words+bigrams", 256
FIELDS = ["body", "path", "path_terms", "title"]

#: Segments of an index, at most: an update that makes more merges them.
MAX_SEGMENTS = 8


class IndexError_(Exception):
    """Base of all index failures."""


class IndexNotFound(IndexError_):
    pass


class VersionMismatch(IndexError_):
    pass


class IncompatibleTokenizer(IndexError_):
    pass


class DimensionMismatch(IndexError_):
    pass


class DuplicateId(IndexError_):
    pass


@dataclass
class Meta:
    head: str
    segments: list[str]
    version: int = VERSION
    tokenizer: str = TOKENIZER
    dim: int = VECTOR_DIM
    documents: int = 0
    kinds: dict[str, int] = field(default_factory=dict)
    built_at: str = ""


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return jvm, p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def read_meta(spark: SparkSession, folder: str) -> Meta | None:
    """The pointer file, or None if there is no index. Fields of other versions are left out."""
    jvm, path, fs = _fs(spark, f"{folder}/meta.json")
    if not fs.exists(path):
        return None
    stream = fs.open(path)
    try:
        raw = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return Meta(**{k: v for k, v in json.loads(raw).items() if k in Meta.__dataclass_fields__})


def write_meta(spark: SparkSession, folder: str, meta: Meta) -> None:
    """Replaces the pointer file in one step."""
    jvm, path, fs = _fs(spark, f"{folder}/meta.json")
    temporary = jvm.org.apache.hadoop.fs.Path(f"{folder}/meta.json.{uuid.uuid4().hex}")
    out = fs.create(temporary, True)
    try:
        out.write(bytearray(json.dumps(asdict(meta), ensure_ascii=False).encode("utf-8")))
    finally:
        out.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), spark.sparkContext._jsc.hadoopConfiguration()) if path.toUri().getScheme() else jvm.org.apache.hadoop.fs.FileContext.getFileContext(spark.sparkContext._jsc.hadoopConfiguration())
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    context.rename(temporary, path, options)


def status(spark: SparkSession, folder: str) -> str:
    """``missing``, ``outdated`` (another version or tokenizer) or ``ready``."""
    meta = read_meta(spark, folder)
    if meta is None:
        return "missing"
    return "ready" if (meta.version, meta.tokenizer) == (VERSION, TOKENIZER) else "outdated"


def decide(meta: Meta | None, head: str, force: bool, is_ancestor: Callable[[str, str], bool]) -> str:
    """``full``, ``incremental`` or ``current``: what a build has to do for the head. A history that cannot be
    followed from the old head, and another version, call for a full build."""
    if force or meta is None or meta.version != VERSION or meta.tokenizer != TOKENIZER:
        return "full"
    if meta.head == head:
        return "current"
    try:
        return "incremental" if is_ancestor(meta.head, head) else "full"
    except Exception:  # noqa: BLE001 - whatever hinders the comparison calls for a full build
        return "full"


def with_terms(docs: DataFrame) -> DataFrame:
    """Documents with the text of their path terms: the path in words, with its Korean aliases."""
    path = F.col("path")
    terms = F.concat_ws(" ", T.path_to_terms(path), F.when(T.korean_aliases(path) != "", T.korean_aliases(path)))
    return docs.withColumn("path_terms", F.when(path.isNotNull(), terms))


def check_unique(docs: DataFrame, column: str = "doc_id") -> None:
    twice = docs.groupBy(column).agg(F.count("*").alias("n")).where("n > 1").limit(1).collect()
    if twice:
        raise DuplicateId(f"{column} {twice[0][0]} occurs {twice[0]['n']} times")


def check_dim(vectors: DataFrame, dim: int) -> None:
    other = vectors.where(F.size("vec") != dim).limit(1).collect()
    if other:
        raise DimensionMismatch(f"a vector of {len(other[0]['vec'])} components in an index of {dim}")


def _sums(lengths: DataFrame) -> DataFrame:
    return lengths.groupBy("field").agg(F.count("*").alias("n"), F.sum("dl").cast("long").alias("total"))


def _write_segment(folder: str, docs: DataFrame, vectors: DataFrame, gone: DataFrame | None, taken: DataFrame | None, progress: Callable[[str], None]) -> str:
    """Writes a segment and gives its name. taken: (field, n, total) of the removed documents."""
    spark, name = docs.sparkSession, f"segment={uuid.uuid4().hex}"
    base = f"{folder}/{name}"
    progress("documents")
    docs.write.parquet(f"{base}/docs")
    stored = spark.read.parquet(f"{base}/docs")
    progress("postings")
    rows = S.analysed(stored, FIELDS)
    # Ranges of (field, term, document): a term that nearly all documents have is spread over tasks.
    S.postings(rows).repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.partitionBy("field").parquet(f"{base}/postings")
    S.lengths(stored, FIELDS).write.parquet(f"{base}/lengths")
    sums = _sums(spark.read.parquet(f"{base}/lengths"))
    if taken is not None:
        sums = sums.unionByName(taken.select("field", (-F.col("n")).alias("n"), (-F.col("total")).alias("total"))).groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    sums.coalesce(1).write.parquet(f"{base}/stats")  # one row a field
    progress("vectors")
    vectors.select("doc_id", T.l2_normalize(F.col("vec")).alias("vec")).write.parquet(f"{base}/vectors")
    (gone if gone is not None else stored.select("doc_id").limit(0)).write.parquet(f"{base}/gone")
    return name


def _point(spark: SparkSession, folder: str, head: str, segments: list[str], kinds: dict[str, int], progress: Callable[[str], None]) -> Meta:
    kinds = {k: n for k, n in sorted(kinds.items()) if n}
    meta = Meta(head=head, segments=segments, documents=sum(kinds.values()), kinds=kinds, built_at=datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ"))
    write_meta(spark, folder, meta)
    progress("done")
    return meta


def _kinds(docs: DataFrame) -> dict[str, int]:
    return {r["kind"]: r["n"] for r in docs.groupBy("kind").agg(F.count("*").alias("n")).collect()}


def build(spark: SparkSession, folder: str, head: str, docs: DataFrame, vectors: DataFrame, progress: Callable[[str], None] = lambda step: None) -> Meta:
    """Full build. docs: (doc_id, kind, title, commit_oid, path, line_start, line_end, body); vectors: (doc_id, vec)."""
    check_unique(docs)
    check_unique(vectors)
    check_dim(vectors, VECTOR_DIM)
    name = _write_segment(folder, with_terms(docs), vectors, None, None, progress)
    return _point(spark, folder, head, [name], _kinds(spark.read.parquet(f"{folder}/{name}/docs")), progress)


def delete(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    return docs.join(gone.select(key).distinct(), key, "left_anti")


def update(spark: SparkSession, folder: str, head: str, changes: DataFrame, new_docs: DataFrame, new_vectors: DataFrame, progress: Callable[[str], None] = lambda step: None) -> Meta:
    """Incremental build: documents of modified and deleted paths leave, new ones come; all others keep their rows,
    postings and the oid they were indexed at. changes: (path, change). Of the old documents only ids, paths, kinds
    and lengths are read; only new texts are analysed."""
    index = Index.open(spark, folder)
    check_dim(new_vectors, index.meta.dim)
    fresh = with_terms(new_docs)
    check_unique(fresh)
    check_unique(new_vectors)
    touched = changes.where(F.col("change").isin("modified", "deleted")).select("path").distinct()
    old = index.docs.select("doc_id", "path", "kind")
    stale = old.join(touched, "path", "left_semi").select("doc_id", "kind")
    again = old.join(new_docs.select("doc_id"), "doc_id", "left_semi").select("doc_id", "kind")
    gone = cut(stale.unionByName(again).distinct())
    lost = _kinds(gone)
    taken = _sums(index.lengths.join(gone.select("doc_id"), "doc_id", "left_semi"))
    name = _write_segment(folder, fresh.select(index.docs.columns), new_vectors, gone.select("doc_id"), taken, progress)
    kinds = dict(index.meta.kinds)
    for sign, counts in ((-1, lost), (1, _kinds(spark.read.parquet(f"{folder}/{name}/docs")))):
        for kind, n in counts.items():
            kinds[kind] = kinds.get(kind, 0) + sign * n
    meta = _point(spark, folder, head, [*index.meta.segments, name], kinds, progress)
    return compact(spark, folder) if len(meta.segments) > MAX_SEGMENTS else meta


def compact(spark: SparkSession, folder: str) -> Meta:
    """Merges all segments into one; the texts are not analysed again."""
    index = Index.open(spark, folder)
    name = f"segment={uuid.uuid4().hex}"
    base = f"{folder}/{name}"
    for part in ("docs", "lengths", "vectors"):
        getattr(index, part).write.parquet(f"{base}/{part}")
    index.postings.repartitionByRange("field", "term", "doc_id").sortWithinPartitions("field", "term", "doc_id").write.partitionBy("field").parquet(f"{base}/postings")
    _sums(spark.read.parquet(f"{base}/lengths")).coalesce(1).write.parquet(f"{base}/stats")
    index.docs.select("doc_id").limit(0).write.parquet(f"{base}/gone")
    return _point(spark, folder, index.meta.head, [name], index.meta.kinds, lambda step: None)


def vacuum(spark: SparkSession, folder: str, older_than_seconds: float = 3600.0) -> list[str]:
    """Deletes segments that the pointer does not name and that are old enough for no one to read or write them."""
    meta = read_meta(spark, folder)
    _, path, fs = _fs(spark, folder)
    live, deleted = set(meta.segments if meta else []), []
    now = datetime.now(UTC).timestamp()
    for entry in fs.listStatus(path):
        name = entry.getPath().getName()
        if name.startswith("segment=") and name not in live and now - entry.getModificationTime() / 1000 >= older_than_seconds:
            fs.delete(entry.getPath(), True)
            deleted.append(name)
    return deleted


@dataclass
class Index:
    """An open index: its metadata and relations, read lazily: of each segment what no later one removes."""

    meta: Meta
    docs: DataFrame
    postings: DataFrame
    lengths: DataFrame
    stats: DataFrame
    vectors: DataFrame

    @staticmethod
    def open(spark: SparkSession, folder: str) -> Index:
        meta = read_meta(spark, folder)
        if meta is None:
            raise IndexNotFound(folder)
        if meta.version != VERSION:
            raise VersionMismatch(f"expected {VERSION}, found {meta.version}")
        if meta.tokenizer != TOKENIZER:
            raise IncompatibleTokenizer(f"expected {TOKENIZER}, found {meta.tokenizer}")

        def segment(i: int, part: str) -> DataFrame:
            return spark.read.parquet(f"{folder}/{meta.segments[i]}/{part}")

        def live(part: str) -> DataFrame:
            parts = []
            for i in range(len(meta.segments)):
                later = [segment(j, "gone") for j in range(i + 1, len(meta.segments))]
                parts.append(delete(segment(i, part), functools.reduce(DataFrame.unionByName, later)) if later else segment(i, part))
            return functools.reduce(DataFrame.unionByName, parts)

        sums = functools.reduce(DataFrame.unionByName, (segment(i, "stats") for i in range(len(meta.segments))))
        stats = sums.groupBy("field").agg(F.sum("n").alias("n"), F.sum("total").alias("_t")).where("n > 0").select("field", "n", (F.col("_t") / F.col("n")).alias("avgdl"))
        return Index(meta, live("docs"), live("postings"), live("lengths"), stats, live("vectors"))

    def bm25(self, queries: list[S.Query], limit: int = 10) -> DataFrame:
        """Postings are pruned to the queries' fields and terms at the scan."""
        return S.bm25(self.docs.sparkSession, self.docs, queries, limit, index=(self.postings, self.stats))

    def nearest(self, query_vectors: DataFrame, limit: int = 10) -> DataFrame:
        return S.vector_topk(self.vectors, query_vectors, limit)
