"""Building an index, upserting into it, compacting it."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import bucket_of, shard_of, slot_of
from ..functions.text import STOP_WORDS, embedding_text, string_or_empty, words
from ..functions.vectors import has_vector, norm
from ..sources.index_store import (
    FIELD_GAP,
    SORTED_BYTES,
    CommitConflict,
    Layout,
    SearchIndex,
    by_slice,
    commit,
    new_segment,
    open_index,
    piece_of,
    stored_bytes,
    union,
    with_slice,
    write_segment,
    write_sliced,
)
from .embedding import Encoder, embed_outcome
from .ingest import build_counters, take_first
from .lexicon import write_lexicon


def newest_per_id(docs: DataFrame) -> DataFrame:
    """The last record of each id. The row-number limit is applied before the shuffle, so copies stay local."""
    order = W.partitionBy("id").orderBy(F.desc_nulls_last("indexed_at"), F.desc(F.xxhash64("title", "body")))
    return docs.withColumn("_rn", F.row_number().over(order)).where(F.col("_rn") == 1).drop("_rn")


def prepare_docs(
    docs: DataFrame,
    layout: Layout,
    encoder: Encoder | None = None,
    unique_ids: bool = False,
    seen: Observation | None = None,
) -> DataFrame:
    """Documents in the shape of the ``docs`` table: empty ids dropped, one record per id, embedded, placed. ``seen`` gets
    the counters of ``build_counters`` while they are written."""
    types = {"title_vector": "array<double>", "indexed_at": "timestamp"}
    for name, kind in types.items():
        if name not in docs.columns:
            docs = docs.withColumn(name, F.lit(None).cast(kind))
    entries = [c for n in layout.numbers for c in (F.lit(n), (F.col(n) if n in docs.columns else F.lit(None)).cast("double"))]
    numbers = (F.create_map(*entries) if entries else F.lit(None)).cast("map<string,double>")
    docs = docs.where(F.col("id") != "").select(
        "id", "title", "body", F.col("title_vector").cast("array<double>").alias("title_vector"), "indexed_at",
        numbers.alias("numbers"),
    )
    if not unique_ids:
        docs = newest_per_id(docs)
    if encoder is not None:
        # A failed embedding leaves the vector the document came with, if any.
        docs = docs.withColumn("_fresh", embed_outcome(embedding_text(F.col("title"), F.col("body")), encoder))
    if seen is not None:
        outcome = F.lit(None).cast("string") if encoder is None else F.col("_fresh")["outcome"]
        docs = docs.observe(seen, *build_counters(outcome))
    if encoder is not None:
        docs = docs.withColumn("title_vector", F.coalesce(F.col("_fresh")["vector"], "title_vector")).drop("_fresh")
    v = F.col("title_vector")
    return docs.select(
        "id",
        "title",
        "body",
        "title_vector",
        F.when(has_vector(v), norm(v)).alias("title_norm"),
        "indexed_at",
        "numbers",
        shard_of(F.col("id"), layout.n_shards).alias("shard"),
        slot_of(F.col("id"), layout.doc_slots).alias("slot"),
    )


#: Words that are grouped at once.
GROUPED_WORDS = 1_000_000


def posting_rows(docs: DataFrame, layout: Layout) -> DataFrame:
    """One row per document and term: frequency and length per field, all places of the term, slice of the document.

    A place is ``field number * FIELD_GAP + position``, so one array serves all fields and neighbours never cross a
    field border. Words are grouped where their document is, a batch of documents at a time, so single words are never
    shuffled; the rows of a batch are sorted by bucket and term, which leaves the writer's sort a few runs to merge.
    """
    fields = layout.fields
    found = docs.select("id", "shard", "slice", *[words(string_or_empty(F.col(f))).alias(f"_w_{f}") for f in fields])
    buckets = [F.transform(f"_w_{f}", lambda w: bucket_of(w, layout.term_buckets)).alias(f"_b_{f}") for f in fields]
    found = found.select("*", *buckets)
    per_field = ", ".join(f"tf_{f} int, dl_{f} int" for f in fields)
    schema = f"term string, id string, {per_field}, places array<long>, slice int, shard int, bucket int"
    return found.mapInArrow(_grouped(len(fields)), schema)


def _grouped(n_fields: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches of documents, with the words of each field and their buckets, become batches of postings."""

    def postings(batch: pa.RecordBatch, stops: pa.Array) -> pa.RecordBatch:
        n = batch.num_rows
        terms, buckets, docs, places, field_of, lengths = [], [], [], [], [], []
        for i in range(n_fields):
            lists = batch.column(3 + i)
            sizes = np.diff(lists.offsets.to_numpy())
            flat = lists.flatten()
            first = np.repeat(np.cumsum(sizes) - sizes, sizes)
            keep = ~pc.is_in(flat, value_set=stops).to_numpy(zero_copy_only=False)
            doc = np.repeat(np.arange(n), sizes)[keep]
            terms.append(flat.filter(pa.array(keep)))
            buckets.append(batch.column(3 + n_fields + i).flatten().to_numpy()[keep])
            docs.append(doc)
            places.append((np.arange(len(flat)) - first)[keep] + i * FIELD_GAP)
            field_of.append(np.full(len(doc), i))
            lengths.append(np.bincount(doc, minlength=n).astype(np.int32))
        coded = pa.concat_arrays(terms).dictionary_encode()
        code = coded.indices.to_numpy()
        bucket_of_code = np.zeros(len(coded.dictionary), dtype=np.int32)
        bucket_of_code[code] = np.concatenate(buckets)
        by_term = pa.table({"bucket": pa.array(bucket_of_code), "term": coded.dictionary})
        by_term = by_term.take(pc.sort_indices(by_term, sort_keys=[("bucket", "ascending"), ("term", "ascending")])).combine_chunks()
        rank = np.empty(len(bucket_of_code), dtype=np.int64)
        rank[pc.index_in(by_term["term"], value_set=coded.dictionary).to_numpy()] = np.arange(len(rank))
        key = rank[code] * n + np.concatenate(docs)
        order = np.argsort(key, kind="stable")  # places stay in order
        key = key[order]
        starts = np.flatnonzero(np.diff(key, prepend=-1))
        of_term, of_doc = (pa.array(x) for x in np.divmod(key[starts], n))
        field = np.concatenate(field_of)[order]
        columns = [by_term["term"].take(of_term), batch.column(0).take(of_doc)]
        for i in range(n_fields):
            tf = np.add.reduceat((field == i).astype(np.int32), starts) if len(starts) else np.empty(0)
            columns += [pa.array(tf.astype(np.int32)), pa.array(lengths[i]).take(of_doc)]
        ends = pa.array(np.append(starts, len(key)).astype(np.int32))
        columns.append(pa.ListArray.from_arrays(ends, pa.array(np.concatenate(places)[order])))
        columns += [batch.column(2).take(of_doc), batch.column(1).take(of_doc), by_term["bucket"].take(of_term)]
        names = ["term", "id", *(f"{k}{i}" for i in range(n_fields) for k in ("tf", "dl")), "places", "slice", "shard", "bucket"]
        return pa.table(columns, names=names).combine_chunks()

    def group(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stops = pa.array(STOP_WORDS)
        for batch in batches:
            if not batch.num_rows:
                continue
            n_words = sum(np.diff(batch.column(3 + i).offsets.to_numpy()) for i in range(n_fields))
            cuts = np.flatnonzero(np.diff(np.cumsum(n_words) // GROUPED_WORDS, prepend=-1, append=-1))
            for start, end in zip(cuts, cuts[1:]):
                yield from postings(batch.slice(start, end - start), stops).to_batches()

    return group


LENGTH_CLASSES = 4  # to a doubling
#: Postings that are counted at once.
COUNTED_POSTINGS = 1_000_000
#: A shard and a class of lengths as one number; class 0 is that of postings that go.
CLASS_BITS = 9


def term_counts(postings: DataFrame, layout: Layout, gone: DataFrame | None = None) -> DataFrame:
    """Document and collection frequency per shard and term, less those of ``gone``, and ``tops``.

    ``tops`` hold for each class of document lengths the highest frequency and the least length, per field and for all:
    no document of the class can score more than one with both; ``gone`` has none. Postings are counted where they are read, and
    what a task counts moves once, as bytes. Rows come by bucket and piece, as ``write_segment`` lays them out, so that they need
    not move once more to be written.
    """
    names, n = [*layout.fields, "all"], len(layout.fields)
    rows = _task_counts(postings, layout)
    if gone is not None:
        rows = rows.unionByName(_task_counts(gone, layout, gone=True))
    placed = rows.repartition("bucket", piece_of("term")).sortWithinPartitions("bucket", "term", "cell")
    # A term of a shard has a row for each class of lengths and task, however frequent it is; they follow each other here.
    sums = [f"{k}_{f}" for f in layout.fields for k in ("df", "ctf")] + ["df_all"]
    schema = "bucket int, term string, shard int, " + ", ".join([f"{c} long" for c in sums] + [f"tops_{f} {TOPS}" for f in names])
    return placed.mapInArrow(_classes_united(2 * n + 1, n + 1), schema)


def _task_counts(postings: DataFrame, layout: Layout, gone: bool = False) -> DataFrame:
    length = sum((F.col(f"dl_{f}") for f in layout.fields[1:]), F.col(f"dl_{layout.fields[0]}"))
    of_class = F.lit(0) if gone else F.floor(LENGTH_CLASSES * F.log2(length + 1.0)).cast("int") + 1
    cell = (F.shiftleft(F.col("shard"), CLASS_BITS) + of_class).cast("int").alias("cell")
    columns = [f"{k}_{f}" for f in layout.fields for k in ("tf", "dl")]
    counted = _counted(len(layout.fields), gone)
    return postings.select("bucket", "term", cell, *columns).mapInArrow(counted, "bucket int, term string, cell int, counts binary")


def _counted(n_fields: int, gone: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Postings ``bucket, term, cell, tf, dl, ...`` become one row per term and cell: frequencies, then highest ``tf`` and
    least ``dl`` of each field and of all."""

    def counts(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(batches)
        pairs = [(rows.column(3 + 2 * i), rows.column(4 + 2 * i)) for i in range(n_fields)]
        tf, dl = pairs[0]
        for x, y in pairs[1:]:
            tf, dl = pc.add(tf, x), pc.add(dl, y)
        values, how = {f"c{i}": rows.column(i) for i in range(3)}, []

        def take(column: pa.ChunkedArray, f: str) -> None:
            values[f"v{len(how)}"] = column
            how.append((f"v{len(how)}", f))

        for i, (x, y) in enumerate([*pairs, (tf, dl)]):
            take(pc.cast(pc.greater(x, 0), pa.int64()), "sum")
            if i < n_fields:
                take(pc.cast(x, pa.int64()), "sum")
        for x, y in [*pairs, (tf, dl)]:
            take(x, "max")
            take(pc.if_else(pc.greater(x, 0), y, pa.scalar(None, y.type)), "min")
        out = pa.table(values).group_by(["c0", "c1", "c2"], use_threads=False).aggregate(how).combine_chunks()
        found = np.stack([pc.fill_null(out[f"{c}_{f}"], 0).to_numpy().astype(np.int64) for c, f in how], axis=1)
        if gone:
            found[:, 2 * n_fields + 1 :] = 0
        first = (out[f"c{i}"].combine_chunks() for i in range(3))
        names = ["bucket", "term", "cell", "counts"]
        return pa.table([*first, _packed(found)], names=names).to_batches()[0]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, n = [], 0
        for batch in batches:
            if batch.num_rows:
                rows.append(batch)
                n += batch.num_rows
            if n >= COUNTED_POSTINGS:
                yield counts(rows)
                rows, n = [], 0
        if rows:
            yield counts(rows)

    return count


def _packed(values: np.ndarray) -> pa.Array:
    """Rows of numbers from 0 on as bytes: one, two, four or eight for each, as the largest of the row needs."""
    n, k = values.shape
    most = values.max(axis=1)
    width = 1 << np.searchsorted([1 << 8, 1 << 16, 1 << 32], most, "right")
    offsets = np.append(0, np.cumsum(k * width))
    data = np.empty(offsets[-1], dtype=np.uint8)
    for w in (1, 2, 4, 8):
        some = np.flatnonzero(width == w)
        data[offsets[some][:, None] + np.arange(k * w)] = values[some].astype(f"<u{w}").view(np.uint8)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data)])


def _unpacked(packed: pa.Array, k: int) -> np.ndarray:
    n = len(packed)
    out = np.zeros((n, k), dtype=np.int64)
    if n:
        offsets = np.frombuffer(packed.buffers()[1], dtype=np.int32)[packed.offset : packed.offset + n + 1].astype(np.int64)
        data = np.frombuffer(packed.buffers()[2], dtype=np.uint8)
        width = np.diff(offsets) // k
        for w in (1, 2, 4, 8):
            some = np.flatnonzero(width == w)
            out[some] = data[offsets[some][:, None] + np.arange(k * w)].view(f"<u{w}")
    return out


def _classes_united(n_sums: int, n_tops: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Neighbouring rows with the same bucket, term and shard become one: counts are summed, class 0 taken away, pairs of
    ``tf, dl`` of the other classes listed."""
    top = pa.struct([("tf", pa.int32()), ("dl", pa.int32())])
    names = [str(i) for i in range(3 + n_sums + n_tops)]

    def united(rows: pa.RecordBatch, starts: np.ndarray) -> pa.RecordBatch:
        cell = rows.column(2).to_numpy()
        values = _unpacked(rows.column(3), n_sums + 2 * n_tops)
        fresh = np.append(True, cell[1:] != cell[:-1])
        fresh[starts] = True
        classes = np.flatnonzero(fresh)
        gone = cell & ((1 << CLASS_BITS) - 1) == 0
        first = pa.array(starts)
        columns = [rows.column(0).take(first), rows.column(1).take(first), pa.array((cell[starts] >> CLASS_BITS).astype(np.int32))]
        sums = np.add.reduceat(np.where(gone[:, None], -1, 1) * values[:, :n_sums], starts)
        columns += [pa.array(c) for c in sums.T]
        of_class = np.searchsorted(classes, np.append(starts, len(cell)))
        for i in range(n_sums, n_sums + 2 * n_tops, 2):
            tf, dl = values[:, i], values[:, i + 1]
            least = np.minimum.reduceat(np.where(tf > 0, dl, np.iinfo(np.int64).max), classes)
            tf = np.maximum.reduceat(tf, classes)
            has = tf > 0
            pairs = pa.StructArray.from_arrays([pa.array(x[has].astype(np.int32)) for x in (tf, least)], fields=list(top))
            ends = np.append(0, np.cumsum(has))[of_class].astype(np.int32)
            columns.append(pa.ListArray.from_arrays(pa.array(ends), pairs))
        return pa.RecordBatch.from_arrays(columns, names=names)

    def unite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            if rest is not None:
                batch = pa.Table.from_batches([rest, batch]).combine_chunks().to_batches()[0]
            if batch.num_rows:
                shard = batch.column(2).to_numpy() >> CLASS_BITS
                term = batch.column(1)
                same = pc.equal(term[1:], term[:-1]).to_numpy(zero_copy_only=False) & (shard[1:] == shard[:-1])
                starts = np.append(0, np.flatnonzero(~same) + 1)
                # The last group may go on in the next batch.
                rest = batch.slice(starts[-1])
                if len(starts) > 1:
                    yield united(batch.slice(0, starts[-1]), starts[:-1])
        if rest is not None and rest.num_rows:
            yield united(rest, np.zeros(1, dtype=np.int64))

    return unite


TOPS = "array<struct<tf:int,dl:int>>"


def summed_stats(rows: DataFrame) -> DataFrame:
    """Statistics of several segments as one: counts add up, tops are put side by side."""
    sums = [F.sum(c).alias(c) for c in rows.columns if c.startswith(("df_", "ctf_"))]
    lists = [F.flatten(F.collect_list(c)).alias(c) for c in rows.columns if c.startswith("tops_")]
    return rows.groupBy("bucket", "term", "shard").agg(*sums, *lists)


def shard_counts(docs: DataFrame, stats: DataFrame, layout: Layout, sign: int = 1) -> DataFrame:
    """Documents and total field lengths per shard. A field length is the sum of its term frequencies."""
    n_docs = docs.groupBy("shard").agg((F.count("*") * sign).alias("n_docs"))
    lengths = stats.groupBy("shard").agg(*[F.sum(f"ctf_{f}").alias(f"len_{f}") for f in layout.fields])
    return n_docs.join(lengths, "shard", "full").select(
        "shard",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        *[F.coalesce(f"len_{f}", F.lit(0)).alias(f"len_{f}") for f in layout.fields],
    )


TERM_ORDER = ("term",)


def build_index(
    docs: DataFrame,
    path: str,
    layout: Layout = Layout(),
    encoder: Encoder | None = None,
    unique_ids: bool = False,
    max_docs: int = 0,
    tag: str | None = None,
    seen: Observation | None = None,
) -> SearchIndex:
    """Write a base segment from ``docs(id, title, body[, title_vector, indexed_at])`` and open it.

    ``unique_ids`` skips the search for repeated ids; ``max_docs`` indexes the first so many by id, 0 means all. An index
    that is already at ``path`` gets a new version, which holds ``docs`` alone. ``seen`` counts documents and what the encoder
    made of them while they are written.
    """
    spark = docs.sparkSession
    if max_docs > 0:
        docs = take_first(docs.where(F.col("id") != ""), "id", max_docs)
    older = open_or_none(spark, path)
    version = older.version + 1 if older else 1
    index = SearchIndex(spark, path, version, new_segment(version), (), layout, tag)
    _write_base(index, prepare_docs(docs, layout, encoder, unique_ids, seen), dealt=not unique_ids)
    return commit(index)


#: Directories of documents up to which any task may write to all of them.
FEW_PLACES = 16


def _write_base(index: SearchIndex, docs: DataFrame, dealt: bool = False) -> None:
    """``dealt``: the documents lie by a hash of their ids."""
    at, seg, layout = index.table_path, index.base, index.layout
    # Ids that were dealt out to find the newest need not move again, if that makes few files to a task.
    write_segment(docs, at("docs", seg), "docs", ("id",), base=True, placed=dealt and layout.shard_count * layout.doc_slots <= FEW_PLACES)
    # From here on the written tables are read back: nothing upstream is computed twice or recomputed on a loss.
    docs = index.segment("docs", seg)
    # Texts move to their slices, which is far less than their postings would be.
    texts = docs.select("id", "shard", *[f for f in layout.fields if f != "id"])
    write_sliced(posting_rows(by_slice(texts, layout, stored_bytes(index.spark, at("docs", seg))), layout), index)
    write_segment(
        term_counts(index.sliced_postings(), layout), at("term_stats", seg), "term_stats", ("term", "shard"), base=True, placed=True
    )
    stats = shard_counts(docs, index.segment("term_stats", seg), layout)
    write_segment(stats, at("shard_stats", seg), "shard_stats", (), base=True)
    if layout.lexicon:
        write_lexicon(index)


MAX_ATTEMPTS = 5


def upsert_index(
    index: SearchIndex,
    docs: DataFrame,
    encoder: Encoder | None = None,
    unique_ids: bool = False,
    tag: str | None = None,
) -> SearchIndex:
    """Add documents, replacing those with the same id; the cost follows the batch, not the corpus.

    Goes on from the newest version, whichever ``index`` was opened at. When another writer commits first, the batch is
    applied again on top of that, a few times, before ``CommitConflict`` is raised; nothing committed is ever lost.
    """
    for attempt in range(MAX_ATTEMPTS):
        try:
            return _upsert(open_index(index.spark, index.path), docs, encoder, unique_ids, tag)
        except CommitConflict:
            if attempt + 1 == MAX_ATTEMPTS:
                raise
    raise AssertionError("unreachable")


def _upsert(
    index: SearchIndex, docs: DataFrame, encoder: Encoder | None, unique_ids: bool, tag: str | None
) -> SearchIndex:
    """Writes a delta segment: the new rows, the ids they replace, and the *differences* of the statistics, for which only
    the replaced documents are analysed again."""
    layout = index.layout
    seg = new_segment(index.version + 1)
    target = SearchIndex(index.spark, index.path, index.version + 1, index.base, (*index.deltas, seg), layout, tag)
    at = target.table_path
    write_segment(prepare_docs(docs, layout, encoder, unique_ids), at("docs", seg), "docs", ("id",), base=False, placed=not unique_ids)
    new = target.segment("docs", seg)
    replaced = find_live(index, new.select("shard", "slot", "id"))
    write_segment(replaced, at("tombstones", seg), "tombstones", ("id",), base=False)
    dead = target.segment("tombstones", seg)
    old = read_replaced(index, dead)
    # As in a base, texts are dealt out to as many tasks as can sort their postings in memory, not the postings.
    n_tasks = max(1, -(-stored_bytes(index.spark, at("docs", seg)) // SORTED_BYTES))
    texts = new.select("id", "shard", *[f for f in layout.fields if f != "id"]).repartition(n_tasks, "id")
    write_segment(
        posting_rows(with_slice(texts, layout), layout), at("postings", seg), "postings", TERM_ORDER, base=False, placed=True
    )
    delta = term_counts(target.segment("postings", seg), layout, gone=posting_rows(with_slice(old, layout), layout))
    write_segment(delta, at("term_stats", seg), "term_stats", ("term", "shard"), base=False, placed=True)
    change = union([
        new.groupBy("shard").agg(F.count("*").alias("n")),
        dead.groupBy("shard").agg((-F.count("*")).alias("n")),
    ])
    lengths = target.segment("term_stats", seg).groupBy("shard").agg(
        *[F.sum(f"ctf_{f}").alias(f"len_{f}") for f in layout.fields]
    )
    stats = change.groupBy("shard").agg(F.sum("n").alias("n_docs")).join(lengths, "shard", "full").select(
        "shard",
        F.coalesce("n_docs", F.lit(0)).alias("n_docs"),
        *[F.coalesce(f"len_{f}", F.lit(0)).alias(f"len_{f}") for f in layout.fields],
    )
    write_segment(stats, at("shard_stats", seg), "shard_stats", (), base=False)
    return commit(target)


def find_live(index: SearchIndex, ids: DataFrame) -> DataFrame:
    """Where the live documents with these ids are: ``id, shard, slot, file``. Reads no text."""
    place = ["shard", "slot", "id"]
    wanted = ids.where(F.length("id") > 0)  # always true; allows partition pruning on the other side
    found = [
        df.select(*place, "seg", F.col("_metadata.file_path").alias("file")).join(wanted, place, "left_semi")
        for df in index.parts("docs")
    ]
    return index.drop_replaced(union(found)).drop("seg")


def read_replaced(index: SearchIndex, dead: DataFrame) -> DataFrame:
    """``id, shard`` and the text fields of replaced documents: an id is live in one file at most, so place and file name
    its one live row. The directories are pruned by the join."""
    layout = index.layout
    columns = ["id", *(f for f in layout.fields if f != "id")]
    place = ["shard", "slot", "id", "file"]
    wanted = dead.select(*place).where(F.length("id") > 0)
    rows = union([
        df.select("shard", "slot", *columns, F.col("_metadata.file_path").alias("file")) for df in index.parts("docs")
    ])
    return rows.join(wanted, place, "left_semi").select(*columns, "shard")


def merge_deltas(index: SearchIndex) -> SearchIndex:
    """Fold all deltas into one, leaving the base alone: the cost follows the deltas, and later readers list few files."""
    if len(index.deltas) < 2:
        return index
    seg = new_segment(index.version + 1)
    target = SearchIndex(index.spark, index.path, index.version + 1, index.base, (seg,), index.layout, index.tag)
    at = target.table_path
    for table, order in (("docs", ("id",)), ("postings", TERM_ORDER)):
        live = index.drop_replaced(index.delta_rows(table)).drop("seg")
        write_segment(live, at(table, seg), table, order, base=False)
    gone = index.delta_rows("tombstones").groupBy("id", "shard", "slot").agg(F.max("file").alias("file"))
    write_segment(gone, at("tombstones", seg), "tombstones", ("id",), base=False)
    stats = summed_stats(index.delta_rows("term_stats").drop("seg"))
    write_segment(stats, at("term_stats", seg), "term_stats", ("term", "shard"), base=False)
    rows = index.delta_rows("shard_stats").drop("seg")
    sums = [F.sum(c).alias(c) for c in rows.columns if c != "shard"]
    write_segment(rows.groupBy("shard").agg(*sums), at("shard_stats", seg), "shard_stats", (), base=False)
    return commit(target)


def compact_index(index: SearchIndex, layout: Layout | None = None) -> SearchIndex:
    """Fold all deltas into a new base segment, optionally with another layout."""
    layout = layout or index.layout
    version = index.version + 1
    target = SearchIndex(index.spark, index.path, version, new_segment(version), (), layout, index.tag)
    live = index.docs()
    if layout != index.layout:
        live = live.withColumn("shard", shard_of(F.col("id"), layout.n_shards)).withColumn(
            "slot", slot_of(F.col("id"), layout.doc_slots)
        )
    _write_base(target, live)
    return commit(target)


def postings_long(index: SearchIndex) -> DataFrame:
    """Live postings with one row per field, all fields combined being ``_all``."""
    layout = index.layout
    rows = index.drop_replaced(union(index.parts("postings")))
    total = lambda kind: sum((F.col(f"{kind}_{f}") for f in layout.fields[1:]), F.col(f"{kind}_{layout.fields[0]}"))
    entries = [
        F.struct(F.lit(f).alias("field"), F.col(f"tf_{f}").alias("tf"), F.col(f"dl_{f}").alias("dl"))
        for f in layout.fields
    ]
    entries.append(F.struct(F.lit("_all").alias("field"), total("tf").alias("tf"), total("dl").alias("dl")))
    return (
        rows.select("term", "id", "shard", F.explode(F.array(*entries)).alias("e"))
        .select("term", "e.field", "id", "shard", "e.tf", "e.dl")
        .where(F.col("tf") > 0)
    )


def open_or_none(spark: SparkSession, path: str) -> SearchIndex | None:
    try:
        return open_index(spark, path)
    except Exception as e:  # no manifest yet
        if "PATH_NOT_FOUND" in str(e) or isinstance(e, FileNotFoundError):
            return None
        raise


__all__ = [
    "build_index",
    "compact_index",
    "merge_deltas",
    "newest_per_id",
    "open_or_none",
    "posting_rows",
    "postings_long",
    "prepare_docs",
    "shard_counts",
    "term_counts",
    "upsert_index",
]
