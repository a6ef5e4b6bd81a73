"""Scores of matching documents: postings joined with weighted query terms."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions.keys import bucket_of
from ..session import settled
from ..sources.index_store import SearchIndex, union
from .queries import BROADCAST_ROWS, small

K1 = 1.2
B = 0.75
SCORE_DIGITS = 6
"""Scores are rounded before ranking: sums of doubles differ in the last bits with the order of their parts."""

ALL = "_all"
MODELS = ("bm25", "tfidf")
SCOPES = ("shard", "global")


def round_score(score: Column) -> Column:
    """Plain double arithmetic: ``F.round`` goes through decimals, which shows when every hit is rounded."""
    scale = float(10**SCORE_DIGITS)
    return F.rint(score * scale) / scale


KNOWN_WORDS = 256


def known_terms(index: SearchIndex, terms: DataFrame, n_terms: int) -> dict[str, int] | None:
    """The terms of a small batch and their buckets, to be used as literals; None for a larger one.

    Literals reach the Parquet scan, where sorted files let all but a few pages be skipped. A larger batch reads most
    buckets anyway and leaves pruning to the join.
    """
    if n_terms > KNOWN_WORDS:
        return None
    bucket = bucket_of(F.col("term"), index.layout.term_buckets)
    return {r[0]: r[1] for r in terms.select("term", bucket).distinct().collect()}


def narrowed(table: DataFrame, known: dict[str, int] | None) -> DataFrame:
    if known is None:
        return table
    return table.where(F.col("bucket").isin(sorted(set(known.values()))) & F.col("term").isin(sorted(known)))


def join_keys(known: dict[str, int] | None) -> list[str]:
    """The bucket follows from the term, so it is a key only where it has to prune."""
    return ["term"] if known is not None else ["bucket", "term"]


def _field_sum(index: SearchIndex, kind: str, field: str) -> Column:
    names = index.layout.fields if field == ALL else (field,)
    out = F.col(f"{kind}_{names[0]}")
    for name in names[1:]:
        out = out + F.col(f"{kind}_{name}")
    return out


def total_length(index: SearchIndex, field: str) -> int:
    names = index.layout.fields if field == ALL else (field,)
    return sum(index.totals[f"len_{n}"] for n in names)


def term_weights(
    index: SearchIndex,
    terms: DataFrame,
    n_terms: int,
    field: str = ALL,
    model: str = "bm25",
    scope: str = "shard",
    known: dict[str, int] | None = None,
    most: bool = False,
) -> DataFrame:
    """Per query term and shard: the weight of the term and the average length it is measured against; if asked for, also
    ``most``, which no document of the shard can pass with this term alone.

    ``terms`` has ``term``, ``weight``, any key columns, and optionally ``route``, the shards to ask. Statistics are
    those of each shard by itself (``scope="shard"``) or of the whole index. At most ``n_terms * shards`` rows.
    """
    if model not in MODELS or scope not in SCOPES:
        raise ValueError(f"unknown model or scope: {model}, {scope}")
    keys = [c for c in terms.columns if c not in ("term", "weight", "route")]
    on = join_keys(known)
    wanted = terms
    if known is None:
        # The length test is always true; a filter on this side is what lets Spark prune the buckets of the other.
        wanted = terms.withColumn("bucket", bucket_of(F.col("term"), index.layout.term_buckets)).where(F.length("term") > 0)
    df_name, tops = ("df_all", "tops_all") if field == ALL else (f"df_{field}", f"tops_{field}")
    more = [F.col(tops).alias("tops")] if most else []
    # Query terms meet each segment before segments are added up, so no more than their own rows are ever grouped.
    parts = [
        narrowed(df, known).select("bucket", "term", "shard", F.col(df_name).alias("df"), *more)
        for df in index.parts("term_stats")
    ]
    found = union([part.join(small(wanted, n_terms), on) for part in parts])
    if len(parts) > 1:
        names = [c for c in found.columns if c not in ("df", "tops")]
        lists = [F.flatten(F.collect_list("tops")).alias("tops")] if most else []  # a few classes of lengths per segment
        found = found.groupBy(*names).agg(F.sum("df").alias("df"), *lists)
    found = found.where(F.col("df") > 0)
    if scope == "global":
        n, average = F.lit(index.totals["n_docs"]), F.lit(total_length(index, field) / max(index.totals["n_docs"], 1))
        asked = small(wanted.select(*on).distinct(), n_terms)
        by_term = union([part.join(asked, on, "left_semi") for part in parts])
        by_term = by_term.groupBy(*on).agg(F.sum("df").alias("df"))
        found = found.drop("df").join(small(by_term, n_terms), on)
        found = found.withColumn("n_docs", n).withColumn("avgdl", average)
    else:
        shards = index.shard_literals().select(
            "shard", "n_docs", (_field_sum(index, "len", field) / F.col("n_docs")).alias("avgdl")
        )
        found = found.join(F.broadcast(shards), "shard")  # at most 256 rows
    if "route" in terms.columns:
        found = found.where(F.array_contains("route", F.col("shard")))
    if model == "bm25":
        rarity = F.log(1 + (F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    else:
        rarity = 1 + F.log(F.col("n_docs") / (F.col("df") + 1))
    found = found.withColumn("w", F.col("weight") * rarity)
    if most:
        highest = F.array_max(F.transform("tops", lambda t: term_score(t["tf"], t["dl"], F.col("w"), F.col("avgdl"), model)))
        found = found.withColumn("most", F.greatest(highest, F.lit(0.0)))
    return found.select(*keys, "bucket", "term", "shard", "w", "avgdl", *(["most"] if most else []))


def term_score(tf: Column, dl: Column, w: Column, avgdl: Column, model: str) -> Column:
    if model == "bm25":
        return w * (tf * (K1 + 1)) / (tf + K1 * (1 - B + B * dl / avgdl))
    return w * F.sqrt(tf) / F.sqrt(dl)


def matching_postings(
    index: SearchIndex,
    weights: DataFrame,
    n_terms: int,
    field: str = ALL,
    model: str = "bm25",
    places: bool = False,
    known: dict[str, int] | None = None,
) -> list[DataFrame]:
    """Postings of the weighted terms, each with its ``score``: a frame for the base, and one for all deltas if there are
    any. Those of the base lie by ``slice``; whatever is grouped by it and by document needs no shuffle there."""
    keys = [c for c in weights.columns if c not in ("bucket", "term", "shard", "w", "avgdl")]
    on = [*join_keys(known), "shard"]
    side = small(weights if "bucket" in on else weights.drop("bucket"), n_terms * index.layout.shard_count)
    tf, dl = _field_sum(index, "tf", field), _field_sum(index, "dl", field)
    out = []
    for postings in index.parts("postings"):
        slim = narrowed(postings, known).select(
            "bucket", "term", "shard", "slice", "id", "seg", tf.alias("tf"), dl.alias("dl"), *(["places"] if places else [])
        )
        joined = slim.where(F.col("tf") > 0).join(side, on)
        score = term_score(F.col("tf"), F.col("dl"), F.col("w"), F.col("avgdl"), model)
        more = ["term", "places"] if places else []
        out.append(joined.select(*keys, "shard", "slice", "id", "seg", score.alias("score"), *more))
    return out


def summed_per_document(parts: list[DataFrame], *keys: str) -> DataFrame:
    """``keys, shard, id, seg, score``: the sum over a document's postings. A document is in one part only, and in one
    slice of the base, so each part is summed by itself, the base where it is read."""
    place = ["shard", "slice", "id", "seg"]
    return union([p.groupBy(*keys, *place).agg(F.sum("score").alias("score")) for p in parts]).drop("slice")


def score_hits(
    index: SearchIndex,
    terms: DataFrame,
    n_terms: int,
    field: str = ALL,
    model: str = "bm25",
    scope: str = "shard",
) -> DataFrame:
    """``query_id, shard, id, seg, score`` of every document holding any of a query's terms.

    The sum is grouped by query *and* document, so a term found in a third of the corpus still spreads evenly.
    """
    known = known_terms(index, terms, n_terms)
    weights = term_weights(index, terms, n_terms, field, model, scope, known)
    hits = summed_per_document(matching_postings(index, weights, n_terms, field, model, known=known), "query_id")
    return index.drop_replaced(hits.withColumn("score", round_score(F.col("score"))))


# --- the best hits without scoring all ---------------------------------------------------------------------------------

BOUND_SLACK = 1e-6
"""Bounds are sums of doubles in another order than scores, and scores are rounded: a bound this much too low still counts."""
DOCUMENT = ("shard", "slice", "id", "seg")


@dataclass(frozen=True)
class BestHits:
    """Hits that hold at least the best ``depth`` of every group, ``by`` query or by query and shard.

    Two passes over postings that lie by slice. The first scores each group's *lead*, the term that can score most: the
    score at ``depth`` is a threshold that no top hit can be below, since other terms only add. Terms that can't reach the
    threshold by themselves, the least ones together, are *optional*: no document has a chance through them alone. The
    second pass sums up the other terms, keeps documents that can reach the threshold if the optional ones give all they
    can, and looks up the optional terms for those only, by document. What a term can score comes from its stored ``tops``.

    ``depth`` is a table ``query_id, depth`` of ``n_queries`` rows, ``cap`` the largest depth. A replaced document never
    counts for a threshold.
    """

    index: SearchIndex
    terms: DataFrame
    n_terms: int
    depth: DataFrame
    cap: int
    n_queries: int
    by: tuple[str, ...] = ("query_id",)
    field: str = ALL
    model: str = "bm25"
    scope: str = "shard"

    @cached_property
    def known(self) -> dict[str, int] | None:
        return known_terms(self.index, self.terms, self.n_terms)

    def _settled(self, rows: DataFrame, name: str) -> DataFrame:
        """A table no larger than the batch, computed once."""
        local = self.known is not None
        rows = settled(rows, local, name)
        return rows if local or "term" not in rows.columns else rows.where(F.length("term") > 0)  # lets buckets be pruned

    @cached_property
    def weights(self) -> DataFrame:
        """``term_weights`` with ``lead``, which is true for one term of each group."""
        found = term_weights(self.index, self.terms, self.n_terms, self.field, self.model, self.scope, self.known, most=True)
        first = F.max_by("term", F.struct("most", "term")).over(W.partitionBy(*self.by))
        return self._settled(found.withColumn("lead", F.col("term") == first), "weights")

    def _matching(self, weights: DataFrame) -> list[DataFrame]:
        return matching_postings(self.index, weights, self.n_terms, self.field, self.model, known=self.known)

    def lead_postings(self) -> list[DataFrame]:
        return self._matching(self.weights.where("lead").drop("lead", "most"))

    @cached_property
    def thresholds(self) -> DataFrame:
        """``by, floor``: the score at ``depth`` with the lead alone; no row where there are fewer hits."""
        hits = self.index.drop_replaced(union(self.lead_postings()))
        best_first = W.partitionBy(*self.by).orderBy(F.desc("score"))
        ranked = hits.withColumn("_rank", F.row_number().over(best_first)).where(F.col("_rank") <= F.lit(self.cap))
        last = ranked.join(small(self.depth, self.n_queries), "query_id").where(F.col("_rank") == F.col("depth"))
        return last.select(*self.by, F.col("score").alias("floor"))

    @cached_property
    def plan(self) -> DataFrame:
        """The weights with ``floor``, ``optional``, and ``rest``, what a shard's optional terms can add."""
        n_groups = self.n_queries * (self.index.layout.shard_count if "shard" in self.by else 1)
        rows = self.weights.join(small(self.thresholds, n_groups), list(self.by), "left")
        least_first = W.partitionBy("query_id", "shard").orderBy("lead", "most", "term")
        together = F.sum("most").over(least_first.rowsBetween(W.unboundedPreceding, 0))
        optional = ~F.col("lead") & F.coalesce(together + BOUND_SLACK < F.col("floor"), F.lit(False))
        rows = rows.withColumn("optional", optional)
        rest = F.coalesce(F.sum(F.when(F.col("optional"), F.col("most"))).over(W.partitionBy("query_id", "shard")), F.lit(0.0))
        return self._settled(rows.withColumn("rest", rest).drop("most"), "search-plan")

    def essential_postings(self) -> list[DataFrame]:
        return self._matching(self.plan.where("not optional").drop("lead", "optional"))

    def contenders(self) -> list[DataFrame]:
        """Documents that may reach the threshold, with the sum of their essential terms."""
        out = []
        for rows in self.essential_postings():
            sums = rows.groupBy("query_id", *DOCUMENT, "floor", "rest").agg(F.sum("score").alias("score"))
            reach = F.col("score") + F.col("rest") + BOUND_SLACK >= F.col("floor")
            out.append(sums.where(F.coalesce(reach, F.lit(True))).drop("rest"))
        return out

    def looked_up(self) -> list[DataFrame]:
        """Contenders, once for each optional term of their query, with ``more``, what it scores there, if it does."""
        options = self.plan.where("optional").groupBy("query_id", "shard").agg(
            F.collect_list(F.struct("bucket", "term", "w", "avgdl")).alias("options")  # no more than a query has words
        )
        side = small(options, self.n_queries * self.index.layout.shard_count)
        on = join_keys(self.known)
        asked = small(self.plan.where("optional").select("bucket", "term", "shard").distinct(), self.n_terms * self.index.layout.shard_count)
        tf, dl = _field_sum(self.index, "tf", self.field), _field_sum(self.index, "dl", self.field)
        out = []
        for rows, postings in zip(self.contenders(), self.index.parts("postings")):
            wanted = rows.join(side, ["query_id", "shard"], "left").withColumn("option", F.explode_outer("options"))
            wanted = wanted.select("query_id", *DOCUMENT, "floor", "score", "option.term", "option.w", "option.avgdl")
            there = narrowed(postings, self.known).select("bucket", "term", *DOCUMENT, tf.alias("tf"), dl.alias("dl"))
            there = there.where(F.col("tf") > 0).join(asked, [*on, "shard"], "left_semi").drop("bucket")
            met = wanted.join(there, ["term", *DOCUMENT], "left")
            more = term_score(F.col("tf"), F.col("dl"), F.col("w"), F.col("avgdl"), self.model)
            out.append(met.select("query_id", *DOCUMENT, "floor", "score", more.alias("more")))
        return out

    def hits(self) -> DataFrame:
        """``query_id, shard, id, seg, score``, as ``score_hits`` gives them, of all hits that reach the threshold."""
        out = []
        for rows in self.looked_up():
            sums = rows.groupBy("query_id", *DOCUMENT, "floor", "score").agg(F.sum("more").alias("more"))
            out.append(sums.withColumn("score", round_score(F.col("score") + F.coalesce("more", F.lit(0.0)))))
        hits = union(out)
        reach = F.col("score") + BOUND_SLACK >= F.col("floor")
        return self.index.drop_replaced(hits.where(F.coalesce(reach, F.lit(True))).select("query_id", "shard", "id", "seg", "score"))
