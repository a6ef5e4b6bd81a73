"""XML page dumps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

PAGE = "title string, revision array<struct<text:string>>, _broken string"


def read_pages(spark: SparkSession, path: str, row_tag: str = "page") -> DataFrame:
    """``page_no, title, text`` for every page element; of several revisions the last counts.

    ``page_no`` grows in input order. A missing title or text reads as the empty string; elements that cannot be
    decoded are skipped. The text is split at the closing tags, so a file of any size is read by many tasks, and a page
    across two splits belongs to the first.
    """
    close = f"</{row_tag}>"
    pieces = spark.read.option("lineSep", close).text(path)
    # What is before the opening tag isn't part of the page; a piece without one, such as the end of a file, is no page.
    start = F.regexp_instr("value", F.lit(rf"<{row_tag}[\s>]"))
    element = F.substring("value", start, F.length("value"))
    elements = pieces.where(start > 0).select(F.concat(element, F.lit(close)).alias("x"))
    options = {"rowTag": row_tag, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_broken", "ignoreSurroundingSpaces": "false"}
    page = elements.select(F.monotonically_increasing_id().alias("page_no"), F.from_xml("x", PAGE, options).alias("p"))
    return page.where(F.col("p").isNotNull() & F.col("p._broken").isNull()).select(
        "page_no",
        F.coalesce("p.title", F.lit("")).alias("title"),
        F.coalesce(F.try_element_at("p.revision", F.lit(-1))["text"], F.lit("")).alias("text"),
    )


def write_pages(pages: DataFrame, path: str) -> None:
    """``title, text`` as page elements."""
    revision = F.array(F.struct(F.col("text")))
    shaped = pages.select("title", revision.alias("revision"))
    shaped.write.format("xml").option("rootTag", "mediawiki").option("rowTag", "page").save(path)
