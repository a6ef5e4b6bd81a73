"""Line dedup by the number of distinct sites a line appears on, in DataFrame functions only."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh_name, prepare, stored, text_or_empty

#: A line on this many sites is boilerplate.
MIN_SITES = 10
#: Registers of a sketch: 2^12, a standard error of 1.04 / 2^6 = 1.6 %.
LG_K = 12


def split_lines(text: Column) -> Column:
    return F.split(text, "\n")


def line_rows(docs: DataFrame, site: str) -> DataFrame:
    """``doc_id, tx, site, pos, h1, h2``: one row per line that isn't blank. ``tx`` tells apart texts under one id; a
    line is known by 128 bits of hash of what is left when its outer spaces are cut."""
    rows = docs.select(
        "doc_id",
        F.xxhash64(text_or_empty()).alias("tx"),
        F.col(site).cast("string").alias("site"),
        F.posexplode(split_lines(F.col("text"))).alias("pos", "line"),
    )
    line = F.trim("line")
    return rows.where(line != "").select(
        "doc_id", "tx", "site", "pos", F.xxhash64(line).alias("h1"), F.xxhash64(F.lit(1), line).alias("h2")
    )


def spread_lines(lines: DataFrame, min_sites: int = MIN_SITES, lg_k: int = LG_K) -> DataFrame:
    """``h1, h2`` of the lines on at least ``min_sites`` distinct sites; a null site is none.

    Sketches are merged by the aggregation, on the map side first, so a line in a third of all rows costs one small
    sketch per task. Where the estimate is within four standard errors (and 1) of the limit, the sites are counted.
    """
    band = 4 * 1.04 / math.sqrt(1 << lg_k) * min_sites + 1
    sketched = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", lg_k).alias("sketch"))
    estimate = F.hll_sketch_estimate("sketch")
    guessed = stored(
        sketched.select("h1", "h2", estimate.alias("sites")).where(F.col("sites") >= min_sites - band), "spread"
    )
    sure = guessed.where(F.col("sites") > min_sites + band).select("h1", "h2")
    near = guessed.where(F.col("sites") <= min_sites + band).select("h1", "h2")
    pairs = lines.join(near, ["h1", "h2"]).select("h1", "h2", "site").distinct()
    exact = pairs.groupBy("h1", "h2").agg(F.count("site").alias("n")).where(F.col("n") >= min_sites)
    return sure.unionByName(exact.select("h1", "h2"))


def remove_spread_lines(
    docs: DataFrame,
    site: str = "source",
    min_sites: int = MIN_SITES,
    counts: tuple[str, str] | None = None,
) -> DataFrame:
    """``docs`` with every line that appears on ``min_sites`` or more sites left in one place only: the smallest
    ``doc_id`` (null last), then the smallest text hash, then the first line. So no content leaves the corpus.

    All rows and columns stay; ``counts`` names two more columns, lines before and lines removed (0 for a null text,
    which stays null; an empty text is one line). Blank lines are never removed. Equal rows are changed alike. A text
    whose lines are all found elsewhere becomes empty.
    """
    prepare(docs.sparkSession)
    lines = stored(line_rows(docs, site), "lines")
    spread = spread_lines(lines, min_sites)
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("tx"), F.col("pos"))
    hits = stored(lines.join(spread, ["h1", "h2"]).select("h1", "h2", place.alias("place")), "hits")
    first = hits.groupBy("h1", "h2").agg(F.min("place").alias("first"))
    drops = (
        hits.join(first, ["h1", "h2"])
        .where(F.col("place") > F.col("first"))
        .groupBy(F.col("place.doc_id").alias("id"), F.col("place.tx").alias("tx"))
        .agg(F.collect_set("place.pos").alias("drop"))
    )
    tx, every, keep, drop, id_, tx_ = (fresh_name(docs, f"_{n}") for n in ("tx", "all", "keep", "drop", "id", "of"))
    drops = drops.select(F.col("id").alias(id_), F.col("tx").alias(tx_), F.col("drop").alias(drop))
    rows = docs.withColumn(tx, F.xxhash64(text_or_empty()))
    rows = rows.join(drops, rows["doc_id"].eqNullSafe(drops[id_]) & (rows[tx] == drops[tx_]), "left")
    rows = rows.withColumn(every, split_lines(F.col("text"))).withColumn(
        keep,
        F.when(F.col(drop).isNotNull(), F.array_except(F.sequence(F.lit(0), F.size(every) - 1), F.col(drop))),
    )
    cleaned = F.when(
        F.col(keep).isNotNull(), F.array_join(F.transform(keep, lambda i: F.get(F.col(every), i)), "\n")
    ).otherwise(F.col("text"))
    out = [cleaned.alias(c) if c == "text" else F.col(c) for c in docs.columns]
    if counts:
        n_lines = F.when(F.col("text").isNull(), F.lit(0)).otherwise(F.size(every))
        removed = F.coalesce(F.size(drop), F.lit(0))
        out += [n_lines.cast("long").alias(counts[0]), F.greatest(removed, F.lit(0)).cast("long").alias(counts[1])]
    return rows.select(*out)
