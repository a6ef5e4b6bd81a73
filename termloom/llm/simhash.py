"""SimHash near-dedup with covering locality-sensitive hashing.

``2^(r+1) - 1`` tables see each fingerprint through structured bit masks: every bit position has a nonzero vector of
``r+1`` bits, and table ``v`` keeps the positions whose vector has an odd product with ``v``. Any ``r`` positions are
orthogonal to at least one nonzero ``v``, so fingerprints within ``r`` bits agree in some table: no pair is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh_name, prepare, stored, text_or_empty
from .components import connected_components

BITS = 64
SEED = 42
#: Differing bits of linked fingerprints. Centres (see below) are exact for 2.
RADIUS = 2


def fingerprint(text: str, shingle: int = 3) -> int:
    """Signed 64-bit SimHash of one text: words without ASCII white space, A-Z lower-cased, repeats counted."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest, seed = xxhash.xxh64_intdigest, SEED
    hashes = np.array([digest(g, seed) for g in grams], dtype=np.uint64)
    ones = np.zeros(BITS, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):  # a slice at a time: a long text's bits needn't be in memory together
        part = hashes[i : i + (1 << 16)]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


@F.pandas_udf(T.LongType())
def _fingerprints(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def fingerprint_column(text: Column) -> Column:
    return _fingerprints(text)


def as_signed(value: int) -> int:
    return value - (1 << BITS) if value >= 1 << (BITS - 1) else value


def covering_masks(radius: int = RADIUS) -> list[int]:
    """The masks of all tables, as unsigned numbers."""
    n = (1 << (radius + 1)) - 1
    vectors = [i % n + 1 for i in range(BITS)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, n + 1)]


def _links(fps: DataFrame) -> DataFrame:
    """Edges ``(a, b)`` that connect exactly the distinct fingerprints ``fp`` within ``RADIUS`` bits.

    Members of a bucket agree on its mask, so two of them within 2 bits differ only outside it and meet in a common
    *centre*, at most one flipped bit away from both. All that share a centre are within 2 bits of each other, so each
    is linked with the smallest: a bucket of any size gives a number of rows in proportion to it, never its pairs.
    """
    masks = covering_masks()
    tables = F.array(
        *(F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(as_signed(m))).alias("k")) for t, m in enumerate(masks))
    )
    keyed = fps.select("fp", F.explode(tables).alias("x")).select("fp", "x.t", "x.k")
    shared = keyed.groupBy("t", "k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("t", "k")
    outside = F.element_at(F.array(*(F.lit(as_signed(~m & ((1 << BITS) - 1))) for m in masks)), F.col("t") + 1)
    free = keyed.join(shared, ["t", "k"]).groupBy("fp").agg(F.bit_or(outside).alias("free"))
    single = F.array(*(F.lit(as_signed(1 << i)) for i in range(BITS)))
    flips = F.concat(F.array(F.lit(0).cast("long")), F.filter(single, lambda b: F.col("free").bitwiseAND(b) != 0))
    centres = free.select("fp", F.explode(flips).alias("b")).select("fp", F.col("fp").bitwiseXOR(F.col("b")).alias("c"))
    least = centres.groupBy("c").agg(F.min("fp").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
    return centres.join(least.select("c", "m"), "c").where("fp <> m").select(F.col("fp").alias("a"), F.col("m").alias("b"))


def fingerprint_classes(fps: DataFrame) -> DataFrame:
    """``(fp, class_fp)`` for all distinct values of ``fp``: fingerprints linked directly or over others share one."""
    distinct = stored(fps.select("fp").distinct(), "fps")
    comps = connected_components(_links(distinct)).select(F.col("node").alias("fp"), F.col("component").alias("c"))
    return distinct.join(comps, "fp", "left").select("fp", F.coalesce("c", "fp").alias("class_fp"))


def simhash_components(docs: DataFrame) -> DataFrame:
    """``doc_id, fp, component_id`` for every row of ``docs (doc_id, text)``.

    A null or blank text has fingerprint 0 and is linked like any other. The component is the smallest ``doc_id``
    reachable; null ids take part but are never that id (a component of null ids only has null). Repeated rows give
    repeated rows. Other columns are ignored.
    """
    prepare(docs.sparkSession)
    rows = stored(docs.select("doc_id", fingerprint_column(text_or_empty()).alias("fp")), "simhash")
    classes = fingerprint_classes(rows)
    least = rows.groupBy("fp").agg(F.min("doc_id").alias("m"))
    ids = classes.join(least, "fp").groupBy("class_fp").agg(F.min("m").alias("component_id"))
    by_fp = classes.join(ids, "class_fp").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def keep_one_per_component(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` with one document of each component left: the smallest id, of equal ids the smallest
    fingerprint, of rows equal in both any one. All columns are returned as they came."""
    prepare(docs.sparkSession)
    fp, id_, null = (fresh_name(docs, f"_{n}") for n in ("fp", "id", "null"))
    with_fp = stored(docs.withColumn(fp, fingerprint_column(text_or_empty())), "simhash-docs")
    narrow = with_fp.select("doc_id", F.col(fp).alias("fp"))
    classes = fingerprint_classes(narrow)
    # Pre-aggregated by fingerprint, so that a large group of copies is one row before classes are joined.
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("fp"))
    first = narrow.groupBy("fp").agg(F.min(order).alias("o")).join(classes, "fp")
    best = first.groupBy("class_fp").agg(F.min("o").alias("o"))
    # A null id in two columns, so that the join and the search for repeated rows deal out texts by the same keys, once.
    keys = [id_, null, fp]
    best = best.select(
        F.coalesce("o.doc_id", F.lit(0)).alias(id_), F.col("o.no_id").alias(null), F.col("o.fp").alias(fp)
    )
    placed = with_fp.withColumn(id_, F.coalesce("doc_id", F.lit(0))).withColumn(null, F.col("doc_id").isNull())
    return placed.join(best, keys, "left_semi").dropDuplicates(keys).select(*docs.columns)
