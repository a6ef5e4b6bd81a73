"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found with a block-max inverted index.

Every word of an example is a term. A term weighs its logarithmic count, times its inverse document frequency over all
documents, times one plus the G statistic by which it goes with the label among the examples: no term is left out, those that
tell something turn the cosine. The nearest examples vote by distance; votes become probabilities by a logistic curve fitted
on the examples themselves, each of which is scored without itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stored, text_or_empty

#: Labelled rows that are examples, about: above it, rows are chosen by a hash of their id.
MAX_EXAMPLES = 4_000
#: Neighbours that vote, the weight of the label's overall rate among them, and where the weight of distance levels off.
NEIGHBOURS = 15
PRIOR_WEIGHT = 1.0
NEAREST = 0.05
#: Examples in one block of the index; a term of more than this share of them has a weight for each instead of postings.
BLOCK = 64
COMMON = 1 / 8
#: Texts whose common terms are multiplied at once; always as many, so that a sum doesn't depend on a text's neighbours.
GROUP = 64
THRESHOLD = 0.7

_WORD = re.compile(r"\w+")


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _ranges(first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All numbers from each ``first`` up to its ``last``, and which of the ranges each belongs to."""
    sizes = last - first
    owner = np.repeat(np.arange(len(first)), sizes)
    shift = first - np.cumsum(sizes) + sizes
    numbers = shift[owner]
    numbers += np.arange(len(owner))
    return numbers, owner


def association(seen: np.ndarray, labelled: np.ndarray, n: int, n_labelled: int) -> np.ndarray:
    """G statistic of each term, found in ``seen`` of ``n`` examples and ``labelled`` of the ``n_labelled`` ones; 0 where it
    is rarer among those than overall."""

    def part(cell, row, column):
        expected = np.maximum(row * column, 1) / n
        return np.where(cell > 0, cell * np.log(np.maximum(cell, 1) / expected), 0.0)

    a, m = labelled.astype(np.float64), seen.astype(np.float64)
    others = n - n_labelled
    g = part(a, m, n_labelled) + part(m - a, m, others) + part(n_labelled - a, n - m, n_labelled) + part(others - m + a, n - m, others)
    return np.where(a * n > m * n_labelled, np.maximum(2 * g, 0), 0.0)


@dataclass
class Index:
    """Postings stand by term and, inside, by block of examples; of each term and block the largest weight is kept, so that
    a block whose bound is below the worst neighbour so far is never opened."""

    numbers: dict[str, int]
    factors: np.ndarray  # by term
    beyond: float  # factor of a word that no example has
    segments: np.ndarray  # by term: where its segments start
    block: np.ndarray  # by segment, a term's postings in one block
    largest: np.ndarray
    first: np.ndarray  # by segment: where its postings start
    entry: np.ndarray  # by posting
    weight: np.ndarray
    toxic: np.ndarray  # by entry
    example: np.ndarray  # by entry: the document's id
    common: np.ndarray  # by term: its row of the next, or -1
    full: np.ndarray  # weights of common terms by entry, up to the end of the last block
    rate: float

    def vector(self, words: Counter) -> tuple[np.ndarray, np.ndarray]:
        """Terms, ascending, and their weights in the unit vector of all words."""
        ids = np.fromiter(map(self.numbers.get, words, repeat(-1)), dtype=np.int64, count=len(words))
        w = 1 + np.log(np.fromiter(words.values(), dtype=np.float64, count=len(words)))
        order = np.lexsort((w, ids))  # sums don't depend on the order of words
        ids, w = ids[order], w[order]
        known = int(np.searchsorted(ids, 0))
        w[:known] *= self.beyond
        w[known:] *= self.factors[ids[known:]]
        norm = math.sqrt(float(w @ w))
        return ids[known:], w[known:] / norm if norm else w[known:]

    def common_parts(self, vectors: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """What common terms add to the cosines of at most ``GROUP`` vectors with every entry."""
        weights = np.zeros((GROUP, len(self.full)))
        for n, (ids, w) in enumerate(vectors):
            row = self.common[ids]
            weights[n, row[row >= 0]] = w[row >= 0]
        return weights @ self.full

    def nearest(
        self, ids: np.ndarray, w: np.ndarray, base: np.ndarray, k: int, without: int | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Cosines and entries of the ``k`` nearest, nearest first, those of no likeness left out; exact. Equal cosines go by
        the example's id. ``base`` is the vector's row of ``common_parts``, ``without`` an example that doesn't count."""
        n_blocks = self.full.shape[1] // BLOCK
        # What common terms add is known of every entry; only the rest has to be bounded.
        segment, owner = _ranges(self.segments[ids], self.segments[ids + 1])
        x, block = w[owner], self.block[segment]
        bounds = np.bincount(block, x * self.largest[segment], n_blocks) + base.reshape(n_blocks, BLOCK).max(axis=1)
        if without is not None:
            base = base.copy()
            base[: len(self.example)][self.example == without] = -np.inf
        order = np.argsort(-bounds, kind="stable")
        scores, entries = np.empty(0), np.empty(0, dtype=np.int64)
        worst, at, step = 0.0, 0, 1
        while at < n_blocks:
            some = order[at : at + step]
            some = some[bounds[some] > worst - 1e-9]
            if not len(some):
                break
            opened = np.zeros(n_blocks, dtype=bool)
            opened[some] = True
            inside = opened[block]
            s = segment[inside]
            posting, of = _ranges(self.first[s], self.first[s + 1])
            parts = self.weight[posting]
            parts *= x[inside][of]
            cosines = np.bincount(self.entry[posting], parts, n_blocks * BLOCK) + base
            # Cosines that differ in the last bits are equal.
            cosines = np.round(cosines, 9)
            found = np.flatnonzero((cosines > 0) & (cosines >= worst) & np.repeat(opened, BLOCK))
            scores, entries = np.append(scores, cosines[found]), np.append(entries, found)
            best = np.lexsort((entries, self.example[entries], -scores))[:k]
            scores, entries = scores[best], entries[best]
            if len(best) == k:
                worst = float(scores[-1])
            at, step = at + step, step * 8
        return scores, entries

    def votes(self, texts: list[str], without: list[int] | None = None) -> Iterator[tuple[float, list[int]]]:
        """Of each text the label's share among its nearest, by distance, and the examples it rests on most."""
        for at in range(0, len(texts), GROUP):
            vectors = [self.vector(Counter(words_of(t))) for t in texts[at : at + GROUP]]
            parts = self.common_parts(vectors)
            for n, (ids, w) in enumerate(vectors):
                if not len(ids):
                    yield self.rate, []
                    continue
                cosines, entries = self.nearest(ids, w, parts[n], NEIGHBOURS, None if without is None else without[at + n])
                weight = cosines / (NEAREST + np.maximum(0.0, 1 - cosines))
                voted = PRIOR_WEIGHT * self.rate + float(weight @ self.toxic[entries])
                yield voted / (PRIOR_WEIGHT + float(weight.sum())), self.example[entries[:3]].tolist()


def build_index(rows: list, df: np.ndarray, n_docs: int, numbers: dict[str, int]) -> Index:
    """``rows``: words, counts, label, doc_id of each example; ``df``: documents that have a term, of ``n_docs``."""
    rows = sorted((r for r in rows if len(r["words"])), key=lambda r: r["doc_id"])
    ids = [np.array([numbers[w] for w in r["words"]], dtype=np.int64) for r in rows]
    label = np.array([r["label"] for r in rows], dtype=np.float64)
    size = len(numbers)
    seen, labelled = np.zeros(size, dtype=np.int64), np.zeros(size, dtype=np.int64)
    for i, y in zip(ids, label):
        seen[i] += 1
        labelled[i] += int(y)
    told = association(seen, labelled, max(1, len(rows)), int(label.sum()))
    factors = np.log((1 + n_docs) / np.maximum(df, 1)) * (1 + told)
    rate = float(label.mean()) if len(rows) else 0.0
    empty = np.empty(0)
    index = Index(numbers, factors, math.log(1 + n_docs), *[empty] * 6, label, empty, empty, empty, rate)
    vectors = [index.vector(Counter(dict(zip(r["words"], r["counts"])))) for r in rows]
    # Examples with the same heaviest term stand together, which makes the blocks' bounds tight.
    order = sorted(range(len(rows)), key=lambda n: (int(vectors[n][0][np.argmax(vectors[n][1])]), rows[n]["doc_id"], n))
    term = np.concatenate([vectors[n][0] for n in order] or [np.empty(0, dtype=np.int64)])
    weight = np.concatenate([vectors[n][1] for n in order] or [empty])
    entry = np.repeat(np.arange(len(order)), [len(vectors[n][0]) for n in order])
    by_term = np.argsort(term, kind="stable")  # entries stay in order, hence blocks too
    term, weight, entry = term[by_term], weight[by_term], entry[by_term]
    often = seen > COMMON * len(rows)
    index.common = np.where(often, np.cumsum(often) - 1, -1).astype(np.int32)
    index.full = np.zeros((int(often.sum()), -(-len(rows) // BLOCK) * BLOCK))
    dense = often[term]
    index.full[index.common[term[dense]], entry[dense]] = weight[dense]
    term, weight, entry = term[~dense], weight[~dense], entry[~dense]
    block = entry // BLOCK
    begins = np.flatnonzero(np.diff(term, prepend=-1) | np.diff(block, prepend=-1))
    index.segments = np.searchsorted(term[begins], np.arange(size + 1)).astype(np.int32)
    index.block = block[begins].astype(np.int32)
    index.largest = np.maximum.reduceat(weight, begins) if len(begins) else empty
    index.first = np.append(begins, len(term)).astype(np.int32)
    index.entry, index.weight = entry.astype(np.int32), weight
    index.toxic = label[order] if len(order) else empty
    index.example = np.array([rows[n]["doc_id"] for n in order], dtype=np.int64)
    return index


def fitted_curve(shares: np.ndarray, labels: np.ndarray) -> tuple[float, float] | None:
    """Offset and slope of the logistic curve from a vote's log odds to the label; None unless both labels are there and
    it rises. Targets are drawn in by one row of each label, so that separable votes have a curve too."""
    n1 = int(labels.sum())
    n0 = len(labels) - n1
    if not n0 or not n1:
        return None
    x = _log_odds(shares)
    target = np.where(labels > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    design = np.stack([np.ones_like(x), x], axis=1)
    at = np.array([0.0, 1.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ at, -30, 30)))
        bend = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(bend, design.T @ (target - p))
        at = at + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-10:
            break
    return (float(at[0]), float(at[1])) if at[1] > 0 else None


def _log_odds(share):
    inside = np.clip(share, 1e-9, 1 - 1e-9)
    return np.log(inside / (1 - inside))


def calibrated(share: float, curve: tuple[float, float] | None) -> float:
    if curve is None:
        return share
    return float(1 / (1 + math.exp(-max(-700.0, min(700.0, curve[0] + curve[1] * float(_log_odds(share)))))))


_BAG = T.StructType([T.StructField("words", T.ArrayType(T.StringType())), T.StructField("counts", T.ArrayType(T.IntegerType()))])


@F.pandas_udf(_BAG)
def _bags(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for batch in texts:
        bags = [sorted(Counter(words_of(x)).items()) for x in batch]
        yield pd.DataFrame([([w for w, _ in b], [n for _, n in b]) for b in bags], columns=["words", "counts"])


def document_frequencies(docs: DataFrame, numbers: dict[str, int]) -> np.ndarray:
    """In how many rows of ``docs`` each of the words is. A task counts its rows first, so that what is shuffled, and what
    the driver sees, is one number per word."""
    known = docs.sparkSession.sparkContext.broadcast(numbers)

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = known.value
        seen = np.zeros(len(number), dtype=np.int64)
        for b in batches:
            for text in b["text"]:
                seen[[i for i in map(number.get, set(words_of(text))) if i is not None]] += 1
        at = np.flatnonzero(seen)
        yield pd.DataFrame({"term": at, "n": seen[at]})

    found = docs.select(text_or_empty().alias("text")).mapInPandas(count, "term long, n long")
    df = np.zeros(len(numbers), dtype=np.int64)
    for r in found.groupBy("term").agg(F.sum("n").alias("n")).toLocalIterator():
        df[r["term"]] = r["n"]
    known.destroy()
    return df


class Scorer:
    """Learns from ``labels (doc_id, label)`` of ``docs (doc_id, text)``, then scores texts.

    The driver holds the examples' words (``MAX_EXAMPLES`` rows) and one number per word of theirs, and broadcasts their index.
    """

    def __init__(self, docs: DataFrame, labels: DataFrame):
        spark = docs.sparkSession
        prepare(spark)
        wanted = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
        share = MAX_EXAMPLES / max(MAX_EXAMPLES, wanted.count())
        drawn = F.pmod(F.xxhash64(F.lit("example"), "doc_id"), F.lit(1 << 20)) < int(share * (1 << 20))
        wanted = wanted.where(drawn).withColumnRenamed("doc_id", "label_id")
        text = docs.select("doc_id", text_or_empty().alias("text")).join(wanted, F.col("doc_id") == F.col("label_id"))
        # Copies are one example, so that a large group of them doesn't outvote the rest.
        text = text.groupBy(F.xxhash64("text"), F.xxhash64(F.lit(1), "text")).agg(
            F.min("doc_id").alias("doc_id"), F.first("text").alias("text"), F.max("label").cast("long").alias("label")
        )
        examples = stored(text.select("doc_id", "text", "label"), "examples")
        rows = examples.select("doc_id", "label", _bags("text").alias("b")).select("doc_id", "label", "b.*").collect()
        numbers = {w: i for i, w in enumerate(sorted({w for r in rows for w in r["words"]}))}
        n_docs = docs.count()
        self.index = spark.sparkContext.broadcast(build_index(rows, document_frequencies(docs, numbers), n_docs, numbers))
        self.curve = self._curve(examples)

    def _curve(self, examples: DataFrame) -> tuple[float, float] | None:
        known = self.index

        @F.pandas_udf("double")
        def share(text: pd.Series, doc_id: pd.Series) -> pd.Series:
            return pd.Series([v for v, _ in known.value.votes(text.tolist(), doc_id.tolist())], dtype="float64")

        votes = examples.where(F.col("text") != "").select("label", share("text", "doc_id").alias("share")).collect()
        return fitted_curve(np.array([r["share"] for r in votes]), np.array([r["label"] for r in votes], dtype=np.float64))

    def score(self, text: Column) -> Column:
        """``score``, 0 to 1, and ``evidence``, the ids of up to three nearest examples."""
        index, curve = self.index, self.curve

        @F.pandas_udf("score double, evidence array<long>")
        def scores(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            for texts in batches:
                found = [(calibrated(v, curve), e) for v, e in index.value.votes(texts.tolist())]
                yield pd.DataFrame(found, columns=["score", "evidence"])

        return scores(F.coalesce(text, F.lit("")))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, score, evidence`` for every row of ``docs (doc_id, text)``.

    A null or empty text has no neighbours: its vote is the rate of the label among the examples (0 without examples).
    Equal texts have equal scores; labels without a document, null labels and null ids teach nothing; of the labels of
    one id, or of equal texts, the largest counts. Other columns are ignored.
    """
    s = Scorer(docs, labels).score(F.col("text"))
    return docs.select("doc_id", s.alias("s")).select("doc_id", "s.score", "s.evidence")


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, as they came."""
    return docs.where(Scorer(docs, labels).score(F.col("text"))["score"] < threshold)
