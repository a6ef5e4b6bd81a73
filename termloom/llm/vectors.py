"""Near-dedup of embeddings by a robust-pruned flat graph.

Vectors of one label go to their nearest clusters, more than one each, so that shards overlap. A task builds a graph over
its shard, pruned robustly, and searches it from the shard's medoid for each of its members: greedily towards the member,
then on over everything in range. The shards' adjacency lists are united; what a shard couldn't see is found by walking on
from known links over the united lists. All links are checked in double precision, and the recall is audited against brute
force on a bounded sample of vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, stored
from .components import connected_components

LEAST_COSINE = 0.93
#: Vectors that the clusters are fitted on, about; vectors of a shard, about; a larger one is dealt into parts, twice.
SAMPLE = 20_000
SHARD = 1_000
MOST = 2_000
#: Clusters of a vector.
OVERLAP = 2
#: Neighbours kept by pruning; how much farther a neighbour of a neighbour may be; candidates; width of the greedy search.
DEGREE = 16
SPREAD = 1.2
NEAR, RANDOM = 48, 16
BEAM = 24
#: Audited vectors, about; below this recall shards overlap more.
AUDITED = 512
LEAST_RECALL = 0.98
MAX_OVERLAP = 8


def usable(embedding: Column, label: Column) -> Column:
    """Neither null nor zero, with finite components only."""
    bad = F.exists(embedding, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    some = F.exists(embedding, lambda x: x != 0)
    return F.coalesce(label.isNotNull() & ~bad & some, F.lit(False))


def unit_rows(vectors) -> np.ndarray:
    v = np.array([np.asarray(x, dtype=np.float64) for x in vectors])
    v /= np.abs(v).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return v / np.linalg.norm(v, axis=1, keepdims=True)


@dataclass
class Clusters:
    """Centroids of every group (label and width), and the number of its first shard."""

    centroids: dict[tuple, np.ndarray]
    first: dict[tuple, int]

    def nearest(self, group: tuple, vectors: np.ndarray, n: int) -> np.ndarray:
        c = self.centroids[group]
        n = min(n, len(c))
        found = np.argpartition(-(vectors @ c.T), n - 1, axis=1)[:, :n] if n < len(c) else np.tile(np.arange(len(c)), (len(vectors), 1))
        return found + self.first[group]


def fit_clusters(reps: DataFrame, seed: int = 42) -> Clusters:
    """Spherical k-means per group on a sample of about ``SAMPLE`` vectors, chosen by a hash; groups without a sampled
    vector are one shard. One row per group, and the sample, reach the driver."""
    sizes = {(r["label"], r["width"]): r["count"] for r in reps.groupBy("label", "width").count().collect()}
    share = SAMPLE / max(SAMPLE, sum(sizes.values()))
    drawn = reps.where(F.pmod(F.xxhash64(F.lit("clusters"), "id"), F.lit(1 << 20)) < int(share * (1 << 20)))
    by_group: dict[tuple, list] = {}
    for r in drawn.select("label", "width", "embedding").toLocalIterator():
        by_group.setdefault((r["label"], r["width"]), []).append(r["embedding"])
    rng = np.random.default_rng(seed)
    clusters, shard = Clusters({}, {}), 0
    for group in sorted(sizes, key=str):
        v = unit_rows(by_group[group]) if group in by_group else np.zeros((1, group[1]))
        k = min(len(v), -(-sizes[group] // SHARD))
        centroids = v[rng.choice(len(v), k, replace=False)]
        for _ in range(8 if k > 1 else 0):
            owner = np.argmax(v @ centroids.T, axis=1)
            sums = np.zeros_like(centroids)
            np.add.at(sums, owner, v)
            norms = np.linalg.norm(sums, axis=1, keepdims=True)
            centroids = np.where(norms > 0, sums / np.maximum(norms, 1e-12), centroids)
        clusters.centroids[group], clusters.first[group] = centroids, shard
        shard += k
    return clusters


def _assigned(clusters: Clusters, overlap: int):
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def assigned(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for labels, widths, vectors in batches:
            out = pd.Series([None] * len(labels), dtype=object)
            groups = pd.Series(list(zip(labels.tolist(), widths.tolist())))
            for group, at in groups.groupby(groups).groups.items():
                rows = np.asarray(at)
                found = clusters.nearest(group, unit_rows(vectors.iloc[rows]), overlap)
                for i, f in zip(rows, found):
                    out.iloc[i] = f.tolist()
            yield out

    return assigned


def prune(near: np.ndarray, sims: np.ndarray, pair_sims: np.ndarray) -> list[int]:
    """Robust pruning: of candidates by similarity, the nearest is kept and those that are closer to it (by ``SPREAD``)
    than to the node are dropped, until ``DEGREE`` are kept."""
    far = np.sqrt(np.maximum(0.0, 2 - 2 * sims))
    kept, alive = [], np.ones(len(near), dtype=bool)
    for i in range(len(near)):
        if alive[i]:
            kept.append(int(near[i]))
            if len(kept) == DEGREE:
                break
            alive &= SPREAD * np.sqrt(np.maximum(0.0, 2 - 2 * pair_sims[i])) > far
    return kept


def build_graph(v: np.ndarray, seed: int = 0) -> tuple[list[np.ndarray], int]:
    """Neighbours of each of the unit vectors ``v``, and the medoid, from which all can be reached."""
    n = len(v)
    sims = (v @ v.T).astype(np.float32)
    mean = v.mean(axis=0)
    medoid = int(np.argmax(v @ mean))
    rng = np.random.default_rng(seed)
    out: list[set[int]] = [set() for _ in range(n)]
    near_n = min(NEAR, n - 1)
    for i in range(n):
        if not near_n:
            break
        row = sims[i].copy()
        row[i] = -2
        near = np.argpartition(-row, near_n - 1)[:near_n]
        near = np.union1d(near, np.setdiff1d(rng.integers(0, n, RANDOM), [i]))
        near = near[np.argsort(-row[near], kind="stable")]
        for j in prune(near, row[near].astype(np.float64), sims[np.ix_(near, near)]):
            out[i].add(j)
            out[j].add(i)
    for i in range(n):  # links back can make a list too long
        if len(out[i]) > 2 * DEGREE:
            near = np.array(sorted(out[i], key=lambda j: (-sims[i, j], j)))
            out[i] = set(prune(near, sims[i, near].astype(np.float64), sims[np.ix_(near, near)]))
    seen = np.zeros(n, dtype=bool)
    queue = [medoid]
    seen[medoid] = True
    while True:
        while queue:
            for j in out[queue.pop()]:
                if not seen[j]:
                    seen[j] = True
                    queue.append(j)
        lost = np.flatnonzero(~seen)
        if not len(lost):
            break
        reached = np.flatnonzero(seen)
        j = int(lost[0])
        out[int(reached[np.argmax(sims[reached, j])])].add(j)
        seen[j] = True
        queue = [j]
    return [np.array(sorted(x), dtype=np.int64) for x in out], medoid


def range_search(v: np.ndarray, graph: list[np.ndarray], medoid: int, query: np.ndarray, least: float) -> np.ndarray:
    """Nodes with at least ``least`` similarity to ``query``: a greedy search, then all that is in range is opened."""
    sims = np.full(len(v), -2.0)
    sims[medoid] = v[medoid] @ query
    opened = np.zeros(len(v), dtype=bool)
    beam = np.array([medoid])
    while True:
        rest = beam[~opened[beam]]
        if not len(rest):
            break
        best = rest[0]
        opened[best] = True
        new = graph[best]
        new = new[sims[new] == -2.0]
        if len(new):
            sims[new] = v[new] @ query
            beam = np.concatenate([beam, new])
            beam = beam[np.argsort(-sims[beam], kind="stable")[:BEAM]]
    opened[:] = False
    while True:
        frontier = np.flatnonzero((sims >= least) & ~opened)
        if not len(frontier):
            return np.flatnonzero(opened)
        opened[frontier] = True
        new = np.unique(np.concatenate([graph[i] for i in frontier]))
        new = new[sims[new] == -2.0]
        sims[new] = v[new] @ query


_NODE = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("near", T.ArrayType(T.LongType())),
        T.StructField("hits", T.ArrayType(T.LongType())),
    ]
)


def _shard_graph(least: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        rows = sorted(table.to_pylist(), key=lambda r: r["id"])
        ids = np.array([r["id"] for r in rows])
        v = unit_rows([r["embedding"] for r in rows])
        graph, medoid = build_graph(v, seed=key[0].as_py())
        hits = [range_search(v, graph, medoid, v[i], least) for i in range(len(v))]
        return pa.table(
            {
                "id": ids,
                "near": pa.array([ids[g].tolist() for g in graph], pa.list_(pa.int64())),
                "hits": pa.array([ids[h[h != i]].tolist() for i, h in enumerate(hits)], pa.list_(pa.int64())),
            }
        )

    return run


def _cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def _links(reps: DataFrame, clusters: Clusters, overlap: int, least: float) -> DataFrame:
    """Directed links ``(a, b)`` between different vectors of ``reps``, both ways."""
    spark = reps.sparkSession
    assigned = _assigned(clusters, overlap)("label", "width", "embedding")
    placed = stored(reps.select("id", "embedding", assigned.alias("shards")), "placed")
    sizes = placed.select(F.explode("shards").alias("shard")).groupBy("shard").count()
    parts = {r["shard"]: -(-r["count"] // MOST) for r in sizes.where(F.col("count") > MOST).collect()}
    split = spark.createDataFrame([*parts.items(), (-1, 1)], "shard int, parts int")
    one = placed.select("id", "embedding", F.explode("shards").alias("shard")).join(F.broadcast(split), "shard", "left")
    # A large shard's members are dealt as often as shards overlap, by different hashes, so that its parts overlap as well.
    deals = F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(
        F.array_distinct(F.array(*(F.pmod(F.xxhash64(F.lit(d), "id"), "parts").cast("int") for d in range(overlap))))
    )
    members = one.select("id", "embedding", "shard", F.explode(deals).alias("part"))
    members = members.select("id", "embedding", (F.col("shard").cast("long") * (1 << 24) + F.col("part")).alias("cell"))
    graph = stored(members.groupBy("cell").applyInArrow(_shard_graph(least), _NODE), "graph")
    cells = stored(members.groupBy("id").agg(F.sort_array(F.collect_set("cell")).alias("cells")), "cells")

    # United adjacency, each neighbour with its cells: what shares one with the searcher was in reach already.
    edges = graph.select("id", F.explode("near").alias("near")).distinct()
    united = stored(
        edges.join(cells.select(F.col("id").alias("near"), F.col("cells").alias("near_cells")), "near"), "united"
    )
    found = stored(graph.select(F.col("id").alias("a"), F.explode("hits").alias("b")).distinct(), "found")
    frontier, rounds = found, [found]
    while True:
        steps = frontier.join(cells.select(F.col("id").alias("a"), "cells"), "a")
        steps = steps.join(united.withColumnRenamed("id", "b"), "b")
        steps = steps.where((F.col("near") != F.col("a")) & ~F.arrays_overlap("cells", "near_cells"))
        steps = steps.select("a", F.col("near").alias("b")).distinct()
        for seen in rounds:
            steps = steps.join(seen.select("a", "b"), ["a", "b"], "left_anti")
        left = placed.select(F.col("id").alias("a"), F.col("embedding").alias("va"))
        right = placed.select(F.col("id").alias("b"), F.col("embedding").alias("vb"))
        checked = steps.join(left, "a").join(right, "b").where(_cosine(F.col("va"), F.col("vb")) >= least)
        frontier = stored(checked.select("a", "b"), "frontier")
        if frontier.isEmpty():
            break
        rounds.append(frontier)
    all_found = rounds[0]
    for r in rounds[1:]:
        all_found = all_found.unionByName(r)
    both = all_found.unionByName(all_found.select(F.col("b").alias("a"), F.col("a").alias("b")))
    return stored(both.distinct(), "links")


def audit_recall(reps: DataFrame, links: DataFrame, least: float = LEAST_COSINE, n: int = AUDITED) -> float:
    """Share of the true links of about ``n`` vectors, chosen by a hash, that ``links`` has. The chosen vectors, bounded in
    number, are broadcast and held against all rows in blocks; only counts come back to the driver."""
    total = reps.count()
    drawn = reps.where(F.pmod(F.xxhash64(F.lit("audit"), "id"), F.lit(max(1, total // n))) == 0)
    asked = {}
    for r in drawn.select("id", "label", "width", "embedding").toLocalIterator():
        ids, vectors = asked.setdefault((r["label"], r["width"]), ([], []))
        ids.append(r["id"])
        vectors.append(r["embedding"])
    asked = {g: (np.array(ids), unit_rows(v)) for g, (ids, v) in asked.items()}

    def brute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, labels, widths, vectors = [c.to_pylist() for c in batch.columns]
            a, b = [], []
            groups: dict[tuple, list[int]] = {}
            for i, g in enumerate(zip(labels, widths)):
                groups.setdefault(g, []).append(i)
            for g, rows in groups.items():
                if g in asked:
                    known, v = asked[g]
                    q, r = np.nonzero(v @ unit_rows([vectors[i] for i in rows]).T >= least)
                    pairs = [(int(known[x]), ids[rows[y]]) for x, y in zip(q, r) if known[x] != ids[rows[y]]]
                    a += [p[0] for p in pairs]
                    b += [p[1] for p in pairs]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    truth = stored(reps.select("id", "label", "width", "embedding").mapInArrow(brute, "a long, b long"), "truth")
    hit, there = truth.join(links, ["a", "b"], "left_semi").count(), truth.count()
    return hit / there if there else 1.0


def exact_links(reps: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """All directed links ``(a, b)`` of different vectors of ``reps``, by blocks of rows held against each other: exact, and
    of square cost within a label."""
    sizes = reps.groupBy("label", "width").agg(F.ceil(F.count(F.lit(1)) / MOST).cast("int").alias("blocks"))
    sizes = sizes.select(F.col("label").alias("label_"), F.col("width").alias("width_"), "blocks")
    rows = reps.join(sizes, (F.col("label") == F.col("label_")) & (F.col("width") == F.col("width_")))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit("exact"), "id"), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.select(
        "id", "embedding", "label", "width", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block"
    )

    def run(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        ids, blocks = np.array(table.column("id").to_pylist(), dtype=np.int64), np.array(table.column("block").to_pylist())
        v = unit_rows(table.column("embedding").to_pylist())
        x, y = np.flatnonzero(blocks == i), np.flatnonzero(blocks == j)
        p, q = np.nonzero(v[x] @ v[y].T >= least) if len(x) and len(y) else (np.empty(0, int), np.empty(0, int))
        a, b = ids[x[p]], ids[y[q]]
        a, b = a[a != b], b[a != b]
        if i != j:
            a, b = np.concatenate([a, b]), np.concatenate([b, a])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return stored(rows.groupBy("label", "width", "i", "j").applyInArrow(run, "a long, b long"), "exact-links")


def near_vectors(vectors: DataFrame, least: float = LEAST_COSINE) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` for every row of ``vectors (vec_id, embedding, label)``.

    Vectors link when their labels (and widths) are equal and their cosine is at least ``least``. A null, zero or not
    finite vector and a null label link with nothing; equal vectors are one node of the graph and all linked with each
    other. Rows are vectors, also repeated ones; a null id takes part in counts only, with a null component of its own.
    Other columns are ignored. No link is below ``least``; shards overlap more until the audited recall is
    ``LEAST_RECALL``. If it isn't at ``MAX_OVERLAP``, all vectors of a label are compared.
    """
    spark = vectors.sparkSession
    prepare(spark)
    rows = vectors.select("vec_id", "embedding", F.col("label").alias("label"))
    ok = usable(F.col("embedding"), F.col("label"))
    rows = stored(rows.select("vec_id", "label", F.when(ok, F.col("embedding")).alias("embedding")), "vectors")
    copies = rows.where("embedding is not null").groupBy("label", "embedding")
    reps = copies.agg(F.min("vec_id").alias("id"), F.count(F.lit(1)).alias("n")).where("id is not null")
    reps = stored(reps.select("id", "label", F.size("embedding").alias("width"), "embedding", "n"), "reps")
    clusters = fit_clusters(reps)
    overlap = OVERLAP
    while True:
        links = _links(reps, clusters, overlap, least)
        if audit_recall(reps, links, least) >= LEAST_RECALL:
            break
        if overlap >= MAX_OVERLAP:
            links = exact_links(reps, least)
            break
        overlap *= 2
    weights = reps.select(F.col("id").alias("b"), "n")
    degrees = links.join(weights, "b").groupBy("a").agg(F.sum("n").alias("others"))
    comps = connected_components(links).select(F.col("node").alias("a"), "component")
    known = reps.join(degrees, F.col("id") == F.col("a"), "left").drop("a")
    known = known.join(comps, F.col("id") == F.col("a"), "left").select(
        F.col("label").alias("label_"),
        F.col("embedding").alias("embedding_"),
        (F.coalesce("others", F.lit(0)) + F.col("n") - 1).alias("links_"),
        F.coalesce("component", "id").alias("component_"),
    )
    joined = rows.join(known, (F.col("label") == F.col("label_")) & (F.col("embedding") == F.col("embedding_")), "left")
    component = F.coalesce("component_", "vec_id")
    return joined.select(
        "vec_id",
        F.coalesce("links_", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )
