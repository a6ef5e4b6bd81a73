"""The index on disk: Parquet segments per table, and a manifest that says which segments are live.

A *base* segment is laid out for pruning: documents by shard and slot of the id, term statistics by term bucket, postings
by shard and term bucket. Postings are also bucketed by *slice*, a part of a shard's documents: all postings of a document
are in one bucket, so that its score is summed up where they are read. A *delta* segment holds one upsert and is flat, so that a small batch makes few files. A segment
counts only once the manifest names it; a write that failed half-way is never read.

Every write has a segment number of its own, and a version is one file of the manifest that only one writer can create:
of two that started from the same version, the second gets a ``CommitConflict``.
"""

from __future__ import annotations

import hashlib
import json
import random
import threading
from dataclasses import dataclass, field
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import MAX_SHARDS, slice_number
from .tables import local_table

BYTES_PER_DIRECTORY = 4 << 30
FIELD_GAP = 1 << 32  # distance between the places of two fields, more than any text has words
MANIFEST = (
    "version long, base long, deltas array<long>, n_shards int, term_buckets int, doc_slots int, slices_per_shard int, "
    "lexicon boolean, numbers array<string>, fields array<string>, tag string"
)


@dataclass(frozen=True)
class Layout:
    """How many directories and slices the tables are cut into, and which text fields are analysed.

    Tasks that read postings are as many as slices. With a ``lexicon``, the keys by which patterns and fuzzy words find terms
    are stored. ``numbers`` are columns of the documents that ranges may ask for, beside ``indexed_at``.
    """

    n_shards: int = 8
    term_buckets: int = 8
    doc_slots: int = 1
    fields: tuple[str, ...] = ("id", "title", "body")
    slices_per_shard: int = 1
    lexicon: bool = False
    numbers: tuple[str, ...] = ()

    @classmethod
    def for_bytes(cls, corpus_bytes: int, n_shards: int = 8, **kwargs) -> "Layout":
        """Directories and slices of about 4 GiB each, up to 4,096 of them."""
        wanted = max(1, -(-corpus_bytes // BYTES_PER_DIRECTORY))
        shards = max(n_shards, 1)
        slots = min(4096 // shards, max(1, -(-wanted // shards)))
        # Slices times term buckets are files: as many slices as there is work for, term buckets only to skip most of a slice.
        buckets = int(min(64, max(8, wanted)))
        return cls(n_shards, buckets, int(slots), slices_per_shard=int(slots), **kwargs)

    @property
    def shard_count(self) -> int:
        return max(self.n_shards, 1)

    @property
    def slice_count(self) -> int:
        return self.shard_count * self.slices_per_shard

    # --- table schemas -------------------------------------------------------------------------------------

    def docs_schema(self) -> str:
        return (
            "id string, title string, body string, title_vector array<double>, title_norm double, "
            "indexed_at timestamp, numbers map<string,double>, shard int, slot int"
        )

    def postings_schema(self) -> str:
        per_field = ", ".join(f"tf_{f} int, dl_{f} int" for f in self.fields)
        return f"term string, id string, {per_field}, places array<long>, slice int, shard int, bucket int"

    def term_stats_schema(self) -> str:
        per_field = ", ".join(f"df_{f} long, ctf_{f} long" for f in self.fields)
        tops = ", ".join(f"tops_{f} array<struct<tf:int,dl:int>>" for f in (*self.fields, "all"))
        return f"term string, shard int, {per_field}, df_all long, {tops}, bucket int"

    def shard_stats_schema(self) -> str:
        return "shard int, n_docs long, " + ", ".join(f"len_{f} long" for f in self.fields)

    def grams_schema(self) -> str:
        return "key string, term string, bucket int"

    deletions_schema = grams_schema

    def tombstones_schema(self) -> str:
        return "id string, shard int, slot int, file string"


PIECES = {"docs": "id", "postings": "term", "term_stats": "term", "grams": "term", "deletions": "term"}
N_PIECES = 64
PARTITIONS = {"docs": ("shard", "slot"), **{t: ("bucket",) for t in ("term_stats", "grams", "deletions")}}
SLICED_DIRS = ("shard", "bucket")


@dataclass(frozen=True)
class SearchIndex:
    """A readable version of an index."""

    spark: SparkSession = field(repr=False)
    path: str
    version: int
    base: int
    deltas: tuple[int, ...]
    layout: Layout
    tag: str | None = None

    @property
    def segments(self) -> tuple[int, ...]:
        return (self.base, *self.deltas)

    def table_path(self, table: str, segment: int) -> str:
        return f"{self.path}/{table}/seg={segment}"

    @cached_property
    def _opened(self) -> dict[tuple[str, int], DataFrame]:
        return {}

    def segment(self, table: str, segment: int) -> DataFrame:
        """A written segment never changes, so its files are listed once."""
        key = (table, segment)
        if key not in self._opened:
            schema = getattr(self.layout, f"{table}_schema")()
            self._opened[key] = self.spark.read.schema(schema).parquet(self.table_path(table, segment))
        return self._opened[key]

    def sliced_postings(self) -> DataFrame:
        """Postings of the base as a bucketed table of the session's catalog, which is what lets Spark know how they lie. A
        session that didn't write the segment declares the table over its files."""
        key = ("postings by slice", self.base)
        if key not in self._opened:
            name = self.sliced_name()
            if not self.spark.catalog.tableExists(name):
                self.spark.sql(
                    f"CREATE TABLE IF NOT EXISTS {name} ({self.layout.postings_schema()}) USING parquet "
                    f"PARTITIONED BY ({', '.join(SLICED_DIRS)}) "
                    f"CLUSTERED BY (slice) SORTED BY (term) INTO {self.layout.slice_count} BUCKETS "
                    f"LOCATION '{qualified(self.spark, self.table_path('postings', self.base))}'"
                )
                self.spark.sql(f"MSCK REPAIR TABLE {name}")
            self._opened[key] = self.spark.table(name)
        return self._opened[key]

    def sliced_name(self) -> str:
        at = hashlib.md5(qualified(self.spark, self.path).encode()).hexdigest()[:16]
        return f"termloom_postings_{at}_{self.base}"

    def delta_rows(self, table: str) -> DataFrame:
        """All deltas in one scan, with their number as ``seg``."""
        key = (table, -1)
        if key not in self._opened:
            schema = getattr(self.layout, f"{table}_schema")()
            paths = [self.table_path(table, s) for s in self.deltas]
            reader = self.spark.read.schema(f"{schema}, seg long").option("basePath", f"{self.path}/{table}")
            self._opened[key] = reader.parquet(*paths)
        return self._opened[key]

    def parts(self, table: str) -> list[DataFrame]:
        """The base, and all deltas if there are any, each with ``seg``: two scans however many deltas there are."""
        base = self.sliced_postings() if table == "postings" else self.segment(table, self.base)
        base = base.withColumn("seg", F.lit(self.base).cast("long"))
        return [base, self.delta_rows(table)] if self.deltas else [base]

    def tombstones(self) -> DataFrame | None:
        """Ids replaced by a delta, with the segment that replaced them; None while there is only a base."""
        if not self.deltas:
            return None
        return self.delta_rows("tombstones").select("id", "seg")

    def drop_replaced(self, rows: DataFrame) -> DataFrame:
        """Keep only rows (with ``id`` and ``seg``) that no later segment has replaced."""
        dead = self.tombstones()
        if dead is None:
            return rows
        newest = dead.groupBy("id").agg(F.max("seg").alias("dead_before"))
        kept = rows.join(newest.withColumnRenamed("id", "dead_id"), F.col("id") == F.col("dead_id"), "left")
        return kept.where(F.coalesce(F.col("dead_before") <= F.col("seg"), F.lit(True))).drop("dead_id", "dead_before")

    def docs(self) -> DataFrame:
        """Live documents."""
        if not self.deltas:
            return self.segment("docs", self.base)
        return self.drop_replaced(union(self.parts("docs"))).drop("seg")

    def term_stats(self) -> DataFrame:
        """Document frequency per shard and term. Deltas hold differences, so segments add up."""
        if not self.deltas:
            return self.segment("term_stats", self.base)
        rows = union(self.parts("term_stats"))
        sums = [F.sum(c).alias(c) for c in rows.columns if c.startswith(("df_", "ctf_"))]
        return rows.groupBy("bucket", "term", "shard").agg(*sums).where(F.col("df_all") > 0)

    def shard_stats(self) -> DataFrame:
        """Document count and total field lengths per shard: at most 256 rows."""
        rows = union(self.parts("shard_stats")).drop("seg")
        sums = [F.sum(c).alias(c) for c in rows.columns if c != "shard"]
        return rows.groupBy("shard").agg(*sums)

    @cached_property
    def shard_rows(self) -> list:
        """The shard statistics on the driver; their number is bounded by the shard count."""
        rows = self.shard_stats().collect()
        assert len(rows) <= MAX_SHARDS
        return sorted(rows, key=lambda r: r["shard"])

    @cached_property
    def totals(self) -> dict[str, int]:
        names = ["n_docs", *(f"len_{f}" for f in self.layout.fields)]
        return {name: sum(row[name] for row in self.shard_rows) for name in names}

    def shard_literals(self) -> DataFrame:
        """The shard statistics as a local relation, which Spark knows to be tiny."""
        names = ["shard", *self.totals]
        schema = ", ".join(f"{n} {'int' if n == 'shard' else 'long'}" for n in names)
        return local_table(self.spark, [tuple(r[n] for n in names) for r in self.shard_rows], schema)


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df)
    return out


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its file system, which is how a catalog has to know it."""
    context = spark.sparkContext
    file = context._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(file).toString()


_slice_keys: dict[int, list[int]] = {}


def slice_keys(spark: SparkSession, n: int) -> list[int]:
    """For each of ``n`` slices the number that stands for it in the tables: the least one that Spark's hash puts into the
    bucket of the same number, so that every bucket holds one slice."""
    if n not in _slice_keys:
        tried = 16 * n
        while True:
            number = F.col("id").cast("int")
            rows = spark.range(tried).groupBy(F.pmod(F.hash(number), F.lit(n)).alias("b")).agg(F.min(number).alias("k")).collect()
            if len(rows) == n:
                break
            tried *= 2
        _slice_keys[n] = [r["k"] for r in sorted(rows, key=lambda r: r["b"])]
    return _slice_keys[n]


def with_slice(docs: DataFrame, layout: Layout) -> DataFrame:
    """Adds ``slice`` to rows with ``id`` and ``shard``."""
    keys = slice_keys(docs.sparkSession, layout.slice_count)
    number = slice_number(F.col("id"), F.col("shard"), layout.slices_per_shard)
    return docs.withColumn("slice", F.element_at(F.array(*map(F.lit, keys)), number + 1))


def stored_bytes(spark: SparkSession, path: str) -> int:
    """What a written table takes on disk."""
    context = spark.sparkContext
    file = context._jvm.org.apache.hadoop.fs.Path(path)
    return file.getFileSystem(context._jsc.hadoopConfiguration()).getContentSummary(file).getLength()


#: Of all tables of an index: texts take about half the disk that Spark's default leaves of them.
CODEC = "zstd"
#: Stored documents whose postings one task sorts in memory.
SORTED_BYTES = 11 << 20


def by_slice(docs: DataFrame, layout: Layout, n_bytes: int) -> DataFrame:
    """Rows with ``id`` and ``shard`` dealt out by slice, a slice to as many tasks as its share of ``n_bytes`` needs."""
    parts = max(1, -(-n_bytes // (layout.slice_count * SORTED_BYTES)))
    number = slice_number(F.col("id"), F.col("shard"), layout.slices_per_shard)
    part = F.pmod(F.xxhash64(F.lit("part"), F.col("id")), F.lit(parts)).cast("int")
    return with_slice(docs, layout).repartitionById(layout.slice_count * parts, number * parts + part)


def write_sliced(rows: DataFrame, index: SearchIndex) -> None:
    """Postings that already lie by slice, no task having two: no shuffle, a sort, and a file per task and directory."""
    path = qualified(index.spark, index.table_path("postings", index.base))
    writer = rows.write.option("compression", CODEC).partitionBy(*SLICED_DIRS).bucketBy(index.layout.slice_count, "slice").sortBy("term")
    writer.option("path", path).format("parquet").mode("errorifexists").saveAsTable(index.sliced_name())


def piece_of(column: str) -> Column:
    return F.pmod(F.shiftright(F.xxhash64(column), 32), F.lit(N_PIECES))


def write_segment(rows: DataFrame, path: str, table: str, order: tuple[str, ...], base: bool, placed: bool = False) -> None:
    """One shuffle that evens out file sizes, if rows aren't ``placed`` by directory and piece yet, then a sort, then a write.

    Directories are cut into pieces by term or id, so that a few directories still keep all tasks busy; pieces too big
    for one task, such as a term found in a third of the corpus, are split at run time, and small ones merged.
    """
    keys = PARTITIONS.get(table, ()) if base else ()
    if placed:
        pass
    elif table in PIECES:
        rows = rows.withColumn("_piece", piece_of(PIECES[table])).hint("rebalance", *keys, "_piece").drop("_piece")
    else:
        rows = rows.hint("rebalance")
    if order:
        rows = rows.sortWithinPartitions(*keys, *order)
    rows.write.mode("errorifexists").partitionBy(*keys).parquet(path, compression=CODEC)


SEGMENT_BITS = 36


def new_segment(version: int) -> int:
    """A number no other write has, above those of all earlier versions."""
    return version << SEGMENT_BITS | random.getrandbits(SEGMENT_BITS)


class CommitConflict(RuntimeError):
    """Another writer has committed this version."""


_creating = threading.Lock()


def commit(index: SearchIndex) -> SearchIndex:
    """Creates the manifest file of ``index.version``, which must not exist: a file system that shares files between
    machines lets one writer create it, and the lock does so between threads where the file system is local."""
    layout = index.layout
    row = {
        "version": index.version,
        "base": index.base,
        "deltas": list(index.deltas),
        "n_shards": layout.n_shards,
        "term_buckets": layout.term_buckets,
        "doc_slots": layout.doc_slots,
        "slices_per_shard": layout.slices_per_shard,
        "lexicon": layout.lexicon,
        "numbers": list(layout.numbers),
        "fields": list(layout.fields),
        "tag": index.tag,
    }
    context = index.spark.sparkContext
    file = context._jvm.org.apache.hadoop.fs.Path(f"{index.path}/manifest/version-{index.version:012d}.json")
    fs = file.getFileSystem(context._jsc.hadoopConfiguration())
    with _creating:
        if fs.exists(file):
            raise CommitConflict(f"version {index.version} of {index.path} was committed by another writer")
        try:
            out = fs.create(file, False)
        except Exception as e:
            if fs.exists(file):
                raise CommitConflict(f"version {index.version} of {index.path} was committed by another writer") from e
            raise
        out.write(bytearray((json.dumps(row) + "\n").encode()))
        out.close()
    return index


def manifest(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).json(f"{path}/manifest")


def open_index(spark: SparkSession, path: str, version: int | None = None) -> SearchIndex:
    """The newest version, or the one asked for."""
    rows = manifest(spark, path).where(F.col("version").isNotNull())  # a file that is just being written
    if version is not None:
        rows = rows.where(F.col("version") == version)
    row = rows.orderBy(F.desc("version")).limit(1).collect()
    if not row:
        raise FileNotFoundError(f"no committed index version at {path}")
    r = row[0]
    layout = Layout(
        r["n_shards"], r["term_buckets"], r["doc_slots"], tuple(r["fields"]), r["slices_per_shard"], r["lexicon"],
        tuple(r["numbers"]),
    )
    return SearchIndex(spark, path, r["version"], r["base"], tuple(r["deltas"]), layout, r["tag"])


__all__ = [
    "CommitConflict", "FIELD_GAP", "Layout", "SORTED_BYTES", "SearchIndex", "by_slice", "commit", "manifest", "new_segment", "open_index", "piece_of",
    "slice_keys", "stored_bytes", "union", "with_slice", "write_segment", "write_sliced",
]
