"""What is done when the shards never reach the recall that is asked for."""

import numpy as np

from termloom.llm import vectors

from .test_corpus_operators import brute_vectors


def test_low_recall_ends_in_an_exact_search(spark, monkeypatch):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 16))
    rows = [(n, (centres[n % 40] + rng.normal(size=16) * 0.12).tolist(), n % 2) for n in range(300)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    monkeypatch.setattr(vectors, "MOST", 40)
    none = lambda reps, *_: reps.select(reps.id.alias("a"), reps.id.alias("b")).where("false")
    monkeypatch.setattr(vectors, "_links", none)
    links, comps = brute_vectors([(r.vec_id, r.embedding, r.label) for r in df.collect()])
    got = vectors.near_vectors(df).collect()
    assert sum(links.values()) > 300
    assert all(r.n_links == links[r.vec_id] and r.component_id == comps[r.vec_id] for r in got)
