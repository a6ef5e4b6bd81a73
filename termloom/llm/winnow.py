"""Document fingerprints by winnowing, in DataFrame functions only.

Words are hashed, ``K`` of them in a row make a gram (a cyclic polynomial: the hash so far is rotated and the next one
xor-ed in, built up by doubling), and of every ``WINDOW`` grams in a row the smallest is chosen, the rightmost of equal
ones, with its place. So two texts that share ``K + WINDOW - 1`` words in a row share a chosen gram, and a match of fewer
than ``K`` words is never seen.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import prepare, text_or_empty

K = 5
WINDOW = 8
#: Buckets of neighbouring ids for each shuffle partition, so that partitions even out.
BUCKETS = 4


def _rotate(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def _append(n: int):
    """Hash of a row of words followed by ``n`` more."""
    return lambda a, b: _rotate(a, n).bitwiseXOR(b)


def _pairs(a: Column, b: Column, shift: int, n: Column, f) -> Column:
    """``f(a[i], b[i + shift])`` for the first ``n`` places."""
    n = F.greatest(n, F.lit(0))
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1 + shift), n), f)


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def fingerprints(df: DataFrame, text: str, out: str, k: int = K, window: int = WINDOW) -> DataFrame:
    """Adds ``<out>_hashes`` and ``<out>_places``, arrays of the chosen grams in their order.

    A text of fewer than ``k`` words is one gram, fewer than ``window`` grams are one window, no words give empty
    arrays; null is empty. Each step is a column of its own, because a column that a lambda reads must be computed before
    it; whatever is called ``_<out>...`` in ``df`` is overwritten.
    """
    if k < 1 or window < 1:
        raise ValueError("k and window must be positive")
    name = f"_{out}"
    keep = [c for c in df.columns if c not in (f"{out}_hashes", f"{out}_places")]

    def step(df: DataFrame, **columns: Column) -> DataFrame:
        return df.withColumns({f"{name}_{n}": c for n, c in columns.items()})

    def col(n: str) -> Column:
        return F.col(f"{name}_{n}")

    df = step(df, words=_words(F.coalesce(F.col(text), F.lit(""))))
    df = step(df, h1=F.transform(col("words"), lambda w: F.xxhash64(w)), n=F.size(col("words")))
    length = 1
    while 2 * length <= k:
        h = col(f"h{length}")
        df = step(df, **{f"h{2 * length}": _pairs(h, h, length, col("n") - 2 * length + 1, _append(length))})
        length *= 2
    grams, part = col(f"h{length}"), length // 2
    while length < k:
        if length + part <= k:
            longer = _pairs(grams, col(f"h{part}"), length, col("n") - length - part + 1, _append(part))
            df = step(df, **{f"g{length + part}": longer})
            length += part
            grams = col(f"g{length}")
        part //= 2
    if k > 1:
        few = F.array(F.xxhash64(F.array_join(col("words"), " ")))
        df = step(df, grams=F.when((col("n") > 0) & (col("n") < k), few).otherwise(grams))
        grams = col("grams")

    # The low bits of a gram give way to its place modulo a power of two above the window: enough to find the place again.
    bits = window.bit_length()
    low = (1 << bits) - 1
    placed = lambda x, i: x.bitwiseAND(F.lit(~low)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(low)))
    smaller = lambda a, b: F.when(
        F.shiftrightunsigned(a, bits) < F.shiftrightunsigned(b, bits), a
    ).otherwise(b)
    df = step(df, m1=F.transform(grams, placed))
    df = step(df, size=F.size(col("m1")))
    width = 1
    while 2 * width <= window:
        m = col(f"m{width}")
        df = step(df, **{f"m{2 * width}": _pairs(m, m, width, col("size") - 2 * width + 1, smaller)})
        width *= 2
    if width < window:
        m = col(f"m{width}")
        df = step(df, **{f"m{window}": _pairs(m, m, window - width, col("size") - window + 1, smaller)})
    short = F.array(F.aggregate(F.slice(col("m1"), 2, window), F.get(col("m1"), F.lit(0)), smaller))
    least = F.when(col("size") >= window, col(f"m{window}")).when(col("size") > 0, short).otherwise(col("m1"))
    df = step(df, least=least)
    starts = F.filter(
        F.sequence(F.lit(0), F.size(col("least")) - 1),
        lambda i: (i == 0) | (F.get(col("least"), i) != F.get(col("least"), i - 1)),
    )
    df = step(df, starts=F.when(F.size(col("least")) > 0, starts).otherwise(F.array().cast("array<int>")))
    at = lambda i: F.get(col("least"), i)
    places = F.transform(
        col("starts"), lambda i: i + F.pmod(at(i).bitwiseAND(F.lit(low)) - i, F.lit(low + 1)).cast("int")
    )
    hashes = F.transform(col("starts"), lambda i: F.shiftrightunsigned(at(i), bits))
    return df.select(*keep, hashes.alias(f"{out}_hashes"), places.alias(f"{out}_places"))


def likeness(a: Column, b: Column) -> Column:
    """Shared share of two arrays of chosen hashes as sets; 1 for two empty ones."""
    common = F.size(F.array_intersect(a, b))
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, F.lit(1.0)).otherwise(common / both)


def as_text(hashes: Column, places: Column) -> Column:
    """``hash:place`` of each chosen gram, the hash in hexadecimal digits."""
    one = lambda h, p: F.concat(F.lower(F.hex(h)), F.lit(":"), p.cast("string"))
    return F.array_join(F.zip_with(hashes, places, one), " ")


def _bucket(doc_id: Column, bounds: list[int]) -> Column:
    """How many of the sorted ``bounds`` are at most ``doc_id``; looked up in two steps, null is 0."""
    if not bounds:
        return F.lit(0)
    block = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*(F.lit(b) for b in bounds[::block]))
    fine = F.array(*(F.lit(b) for b in bounds))
    before = F.greatest(F.size(F.filter(coarse, lambda b: b <= doc_id)) - 1, F.lit(0)) * block
    return before + F.size(F.filter(F.slice(fine, before + 1, F.lit(block)), lambda b: b <= doc_id))


def bucketed(docs: DataFrame) -> DataFrame:
    """``doc_id, text, bucket, guest``: rows in buckets of neighbouring ids; the first row of each bucket is also a guest
    at the end of the one before (the very first: of the last), so that a window finds the next row without leaving it.

    The driver sees a few ids per shuffle partition: the buckets' limits and their first ids.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions")) * BUCKETS
    parts = [i / n for i in range(1, n)]
    bounds = rows.agg(F.percentile_approx("doc_id", parts, 20 * n).alias("b")).first()["b"] or []
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), sorted(set(bounds))))
    order = F.struct(F.col("doc_id").isNotNull().alias("known"), F.col("doc_id"))
    firsts = rows.groupBy("bucket").agg(F.min(order).alias("o")).select("bucket", "o.*").orderBy("bucket").collect()
    before = {r["bucket"]: firsts[i - 1]["bucket"] for i, r in enumerate(firsts)}
    moved = spark.createDataFrame(
        [(r["bucket"], r["doc_id"], before[r["bucket"]]) for r in firsts], "bucket int, first long, to int"
    )
    guests = rows.join(F.broadcast(moved), "bucket").where(F.col("doc_id").eqNullSafe(F.col("first")))
    guests = guests.select("doc_id", "text", F.col("to").alias("bucket"), F.lit(True).alias("guest"))
    return rows.select("doc_id", "text", "bucket", F.lit(False).alias("guest")).unionByName(guests)


def fingerprint_with_next(docs: DataFrame, k: int = K, window: int = WINDOW) -> DataFrame:
    """For each row of ``docs (doc_id, text)``: its fingerprint, that of its edited text, and that of the next document.

    ``doc_id, text, edited, text_hashes, text_places, edited_hashes, edited_places, next_hashes``. The edited text has its
    last half replaced by as much of the beginning of the next document: the next larger id, after the last the first;
    null ids come before all; among equal ids the order is that of a hash of the text. Null texts are empty, a table of
    one row is its own neighbour, other columns are ignored. Texts are shuffled once.
    """
    spark = docs.sparkSession
    prepare(spark)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = fingerprints(bucketed(docs).repartition(n, "bucket"), "text", "text", k, window)
    order = W.partitionBy("bucket").orderBy("guest", F.asc_nulls_first("doc_id"), F.xxhash64("text"))
    following = F.lead(F.struct("text", "text_hashes")).over(order)
    rows = rows.withColumn("following", following).where(~F.col("guest"))
    half = F.floor(F.char_length("text") / 2).cast("int")
    head = F.substring("text", F.lit(1), F.char_length("text") - half)
    edited = F.concat(head, F.substring("following.text", F.lit(1), half))
    rows = rows.select(
        "doc_id", "text", "text_hashes", "text_places", edited.alias("edited"), F.col("following.text_hashes").alias("next_hashes")
    )
    return fingerprints(rows, "edited", "edited", k, window)
