"""Vector compression by product codes: integer k-means per part of the vectors, with LAESA pivots in place of a full search.

Distances of every part to a few fixed pivots are computed once and kept beside it. In each round only the distances of
pivots to the new codebook entries are added: by the triangle inequality ``|d(part, pivot) - d(entry, pivot)|`` is never
more than ``d(part, entry)``, so the largest of them over the pivots orders the entries and ends the search as soon as it
passes the best distance so far. What is evaluated, is evaluated in exact integers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import prepare, spread_join, stored

#: Integer steps of one unit; parts of a vector; entries of a codebook; rounds of assignment and replacement.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4
PIVOTS = 16
#: Components beyond this size (in steps) aren't coded: squared distances stay far inside 64 bits.
LARGEST = 1 << 24
#: Parts whose bounds are held at once, and entries evaluated between two looks at the bounds.
BLOCK = 1024
STEP = 16
#: Relative slack of the bounds: they are 32-bit floats, and only ever loosened.
SLACK = np.float32(1e-6)


@dataclass(frozen=True)
class Coder:
    """Codebooks (entries x width per part) and the fixed pivots of each part."""

    books: tuple[np.ndarray, ...]
    pivots: tuple[np.ndarray, ...]

    @property
    def edges(self) -> np.ndarray:
        return np.cumsum([0] + [b.shape[1] for b in self.books])

    def parts(self, x: np.ndarray) -> list[np.ndarray]:
        e = self.edges
        return [x[:, e[i] : e[i + 1]] for i in range(len(self.books))]


def part_edges(width: int, parts: int) -> list[int]:
    """Where parts begin and end; equal ones if the width allows."""
    return [i * width // parts for i in range(parts + 1)]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Euclidean distances of integer rows to a few others."""
    out = np.empty((len(x), len(y)), dtype=np.float32)
    for j, row in enumerate(y):
        d = x - row
        out[:, j] = np.sqrt(np.einsum("ij,ij->i", d, d))
    return out


def choose_pivots(entries: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Entries far from each other: the first, then always the one farthest from those chosen (ties: the lower index)."""
    chosen = [0]
    near = distances(entries, entries[:1])[:, 0]
    while len(chosen) < min(n, len(entries)) and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(entries, entries[chosen[-1:]])[:, 0])
    return entries[chosen]


def nearest(x: np.ndarray, to_pivots: np.ndarray, book: np.ndarray, entry_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index and squared distance of each row's nearest entry, ties to the lower index, and how many were evaluated."""
    best = np.full(len(x), np.iinfo(np.int64).max)
    which = np.full(len(x), len(book))
    evaluated = 0
    for low in range(0, len(x), BLOCK):
        rows = x[low : low + BLOCK]
        dp = to_pivots[low : low + BLOCK]
        bound = np.zeros((len(rows), len(book)), dtype=np.float32)
        for p in range(dp.shape[1]):
            np.maximum(bound, np.abs(dp[:, p : p + 1] - entry_pivots[:, p]), out=bound)
        bound -= SLACK * (dp.max(axis=1, keepdims=True) + entry_pivots.max(axis=1))
        order = np.argsort(bound, axis=1)
        bound = np.take_along_axis(bound, order, axis=1)
        open_ = np.arange(len(rows))
        d_best, i_best = best[low : low + BLOCK], which[low : low + BLOCK]
        for k in range(0, len(book), STEP):
            # The bound may tie with the best: an equal distance at a lower index has to be seen.
            reach = np.sqrt(d_best[open_].astype(np.float64)) * (1 + float(SLACK))
            open_ = open_[bound[open_, k] <= reach]
            if not len(open_):
                break
            tried = order[open_, k : k + STEP]
            diff = rows[open_][:, None, :] - book[tried]
            d = np.einsum("ijk,ijk->ij", diff, diff)
            evaluated += d.size
            least = d.min(axis=1)
            index = np.where(d == least[:, None], tried, len(book)).min(axis=1)
            better = (least < d_best[open_]) | ((least == d_best[open_]) & (index < i_best[open_]))
            d_best[open_[better]], i_best[open_[better]] = least[better], index[better]
    return which, best, evaluated


def _matrix(column: pa.Array, dtype) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(dtype, copy=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def _with_pivots(coder: Coder):
    """Adds the distances of all parts to their pivots, one flat list a row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"), np.int64)
                found = np.hstack([distances(p, q) for p, q in zip(coder.parts(x), coder.pivots)])
                ends = pa.array(np.arange(0, found.size + 1, found.shape[1], dtype=np.int32))
                lists = pa.ListArray.from_arrays(ends, pa.array(found.ravel()))
                names = [*batch.schema.names, "to_pivots"]
                yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=names)

    return run


def _assigned(coder: Coder, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Per part: its rows, their entries and squared distances."""
    x, near = _matrix(batch.column("x"), np.int64), _matrix(batch.column("to_pivots"), np.float32)
    at = 0
    for rows, book, pivots in zip(coder.parts(x), coder.books, coder.pivots):
        which, error, _ = nearest(rows, near[:, at : at + len(pivots)], book, distances(book, pivots))
        at += len(pivots)
        yield rows, which, error


def _sums(coder: Coder):
    """Sums and counts per part and entry, one row each for a whole partition."""
    widest = max(b.shape[1] for b in coder.books)
    schema = pa.schema([("part", pa.int32()), ("entry", pa.int32()), ("n", pa.int64()), ("sums", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(b), dtype=np.int64) for b in coder.books]
        sums = [np.zeros((len(b), widest), dtype=np.int64) for b in coder.books]
        for batch in batches:
            if batch.num_rows:
                for i, (rows, which, _) in enumerate(_assigned(coder, batch)):
                    n[i] += np.bincount(which, minlength=len(n[i]))
                    np.add.at(sums[i][:, : rows.shape[1]], which, rows)
        for i in range(len(n)):
            used = np.flatnonzero(n[i])
            ends = pa.array(np.arange(0, len(used) * widest + 1, widest, dtype=np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.full(len(used), i, dtype=np.int32)),
                    pa.array(used.astype(np.int32)),
                    pa.array(n[i][used]),
                    pa.ListArray.from_arrays(ends, pa.array(sums[i][used].ravel())),
                ],
                schema=schema,
            )

    return run


def _codes(coder: Coder):
    schema = pa.schema([("vec_id", pa.int64()), ("label", pa.string()), ("code", pa.string()), ("error", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = list(_assigned(coder, batch))
                code = np.stack([which for _, which, _ in found], axis=1).astype(np.uint8)
                error = sum(e for _, _, e in found)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("vec_id"), batch.column("label"), pa.array([c.tobytes().hex() for c in code]), pa.array(error)],
                    schema=schema,
                )

    return run


def steps(embedding: Column) -> Column:
    """Components as whole steps, rounded down."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE))


def finite(embedding: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(embedding, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return embedding.isNotNull() & ~bad


def train(kept: DataFrame, width: int, parts: int, entries: int, rounds: int) -> tuple[Coder, DataFrame]:
    """Codebooks after all rounds, and ``kept (vec_id, label, x)`` with the distances to the pivots, written."""
    # As many rows as a codebook has entries; ties of ids go by the vector.
    first = kept.select("vec_id", "x").orderBy(F.asc_nulls_last("vec_id"), "x").limit(entries).collect()
    x = np.array([r["x"] for r in first], dtype=np.int64)
    edges = part_edges(width, parts)
    books = tuple(x[:, a:b] for a, b in zip(edges, edges[1:]))
    coder = Coder(books, tuple(choose_pivots(b) for b in books))
    schema = "vec_id long, label string, x array<int>, to_pivots array<float>"
    ready = stored(kept.mapInArrow(_with_pivots(coder), schema), "code-parts")
    widest = max(b.shape[1] for b in books)
    for _ in range(rounds):
        partial = ready.mapInArrow(_sums(coder), "part int, entry int, n long, sums array<long>")
        sums = F.array(*(F.sum(F.col("sums")[i]) for i in range(widest))).alias("sums")
        books = [b.copy() for b in coder.books]
        # Parts x entries rows at most.
        for r in partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), sums).collect():
            book = books[r["part"]]
            book[r["entry"]] = [s // r["n"] for s in r["sums"][: book.shape[1]]]
        coder = Coder(tuple(books), coder.pivots)
    return coder, ready


def books_sha256(coder: Coder) -> str:
    """Digest of all integer components by part, entry and place, joined by commas."""
    return hashlib.sha256(",".join(str(c) for b in coder.books for c in b.ravel().tolist()).encode()).hexdigest()


UNCODED = (("code", "string"), ("error", "long"), ("label_error", "long"), ("codebooks_sha256", "string"))


def vector_codes(
    vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS
) -> DataFrame:
    """``vec_id, label, code, error, label_error, codebooks_sha256`` of ``vectors (vec_id, embedding, label)``.

    ``code`` has two hex digits for the entry of each part; ``error`` is the squared distance over all parts,
    ``label_error`` its sum over equal labels, null labels together. Codebooks begin as the vectors of the smallest ids.

    Rows whose vector is null or has a null or non-finite component are dropped. All others are in the result, repeated
    rows and null ids (which come last) too. Vectors of another width than that of the smallest id, empty ones, and those
    with a component of 2^14 or more in size, have a null code and error and aren't learned from. An empty table gives an
    empty result; other columns are ignored. ``label`` comes back as text.
    """
    spark = vectors.sparkSession
    prepare(spark)
    if not 1 <= entries <= 256:
        raise ValueError("an entry has to fit two hex digits")
    rows = vectors.where(finite(F.col("embedding"))).select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("string").alias("label"), steps(F.col("embedding")).alias("x")
    )
    fits = (F.size("x") > 0) & ~F.exists("x", lambda c: (c >= LARGEST) | (c < -LARGEST))
    least = rows.where(fits).orderBy(F.asc_nulls_last("vec_id"), "x").select(F.size("x").alias("w")).limit(1).collect()
    if not least:
        return rows.select("vec_id", "label", *(F.lit(None).cast(t).alias(n) for n, t in UNCODED))
    width = least[0]["w"]
    same = fits & (F.size("x") == width)
    coder, ready = train(rows.where(same).withColumn("x", F.col("x").cast("array<int>")), width, parts, entries, rounds)
    coded = stored(ready.mapInArrow(_codes(coder), "vec_id long, label string, code string, error long"), "codes")
    odd = rows.where(~same).select("vec_id", "label", *(F.lit(None).cast(t).alias(n) for n, t in UNCODED[:2]))
    every = coded.unionByName(odd)
    by_label = coded.groupBy("label").agg(F.sum("error").alias("label_error"))
    found = spread_join(every, stored(by_label, "label-errors"), "label", F.xxhash64("vec_id", "code"))
    return found.select(
        "vec_id", "label", "code", "error", "label_error", F.lit(books_sha256(coder)).alias("codebooks_sha256")
    )
