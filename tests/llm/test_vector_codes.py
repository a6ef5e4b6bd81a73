"""Product codes and whitening beside plain numpy."""

import hashlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from termloom.llm import codes, common, queries, whitening

from ..conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def usable(rows):
    return [r for r in rows if r.embedding is not None and all(c is not None and np.isfinite(c) for c in r.embedding)]


def brute_codes(rows, parts=4, entries=256, rounds=4):
    x = np.array([[int(np.floor(codes.SCALE * float(c))) for c in r.embedding] for r in rows])
    order = np.argsort([r.vec_id for r in rows], kind="stable")[:entries]
    cuts = np.split(x, [i * x.shape[1] // parts for i in range(1, parts)], axis=1)
    books = [c[order].copy() for c in cuts]
    for _ in range(rounds):
        for c, book in zip(cuts, books):
            which = ((c[:, None] - book) ** 2).sum(-1).argmin(1)
            for k in set(which.tolist()):
                book[k] = c[which == k].sum(0) // (which == k).sum()
    d = [((c[:, None] - book) ** 2).sum(-1) for c, book in zip(cuts, books)]
    code = np.stack([e.argmin(1) for e in d], axis=1)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    return [bytes(c.astype(np.uint8)).hex() for c in code], sum(e.min(1) for e in d), digest


@pytest.mark.parametrize("sf", [SF, SF.replace("sf0.001", "sf0.1")])
def test_codes_are_those_of_a_full_search(spark, sf):
    rows = usable(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    code, error, digest = brute_codes(rows)
    by_label = {}
    for r, e in zip(rows, error):
        by_label[r.label] = by_label.get(r.label, 0) + int(e)
    got = {r.vec_id: r for r in queries.op12_vector_codes(spark, sf).collect()}
    assert len(got) == len(rows)
    for r, c, e in zip(rows, code, error):
        assert tuple(got[r.vec_id]) == (r.vec_id, c, int(e), by_label[r.label], digest)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 40), st.integers(1, 300), st.sampled_from([2, 50, 100_000]))
def test_pruned_search_is_exact(seed, width, n_entries, size):
    rng = np.random.default_rng(seed)
    x, book = rng.integers(-size, size, (50, width)), rng.integers(-size, size, (n_entries, width))
    pivots = codes.choose_pivots(rng.integers(-size, size, (60, width)))
    which, best, _ = codes.nearest(x, codes.distances(x, pivots), book, codes.distances(book, pivots))
    d = ((x[:, None] - book) ** 2).sum(-1)
    assert (which == d.argmin(1)).all() and (best == d.min(1)).all()


def test_pivots_save_evaluations():
    rng = np.random.default_rng(3)
    centres = rng.integers(-4000, 4000, (256, 16))
    x = centres[rng.integers(0, 256, 2000)] + rng.integers(-100, 100, (2000, 16))
    pivots = codes.choose_pivots(centres)
    _, _, evaluated = codes.nearest(x, codes.distances(x, pivots), centres, codes.distances(centres, pivots))
    assert evaluated < 0.1 * len(x) * 256


ODD = [
    (1, [0.5] * 8, 1),
    (2, [0.25, -0.5] * 4, None),
    (2, [0.25, -0.5] * 4, None),
    (None, [1.0] * 8, 2),
    (3, None, 1),
    (4, [None] + [0.0] * 7, 1),
    (5, [NAN] * 8, 1),
    (6, [INF] + [0.0] * 7, None),
    (7, [1.0] * 3, 3),
    (8, [], 1),
    (9, [3e38] * 8, 1),
    (10, [0.0] * 8, None),
]


def odd_vectors(spark, extra=False):
    df = spark.createDataFrame(ODD, SCHEMA)
    for name in ("x", "code", "error", "to_pivots", "_key", "_copy", "component", "whitened", "n") if extra else ():
        df = df.selectExpr("*", f"'z' as {name}")
    return df


def test_codes_of_odd_vectors(spark):
    got = codes.vector_codes(odd_vectors(spark, extra=True)).collect()
    assert sorted(str(r.vec_id) for r in got) == sorted(["1", "2", "2", "None", "7", "8", "9", "10"])
    by_id = {r.vec_id: r for r in got}
    assert all(by_id[i].code is None and by_id[i].error is None for i in (7, 8, 9))
    assert {by_id[i].code for i in (1, 2, 10, None)} == {"00000000", "01010101", "03030303", "04040404"}
    assert all(by_id[i].error == 0 for i in (1, 2, 10, None)) and by_id[7].label_error is None and by_id[10].label_error == 0
    assert codes.vector_codes(spark.createDataFrame([], SCHEMA)).collect() == []
    assert codes.vector_codes(odd_vectors(spark).where("vec_id = 5")).collect() == []


@pytest.mark.parametrize("width,parts,entries", [(7, 4, 5), (3, 4, 256), (10, 1, 16)])
def test_codes_of_other_shapes(spark, width, parts, entries):
    rng = np.random.default_rng(width)
    rows = [(i, [float(c) for c in rng.normal(size=width)], i % 3) for i in range(60)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    code, error, digest = brute_codes(df.collect(), parts, entries, 2)
    got = {r.vec_id: r for r in codes.vector_codes(df, parts, entries, 2).collect()}
    assert [(got[i].code, got[i].error, got[i].codebooks_sha256) for i in range(60)] == [(c, e, digest) for c, e in zip(code, error)]


def test_spread_join_is_a_left_join_on_null_safe_keys(spark, monkeypatch):
    rows = spark.createDataFrame([(i, None if i % 4 == 0 else str(i % 3)) for i in range(100)], "i long, k string")
    narrow = spark.createDataFrame([(None, 7), ("0", 1), ("1", 2)], "k string, v long")
    want = sorted(tuple(r) for r in common.spread_join(rows, narrow, "k", rows.i).collect())
    monkeypatch.setattr(common, "BROADCAST_ROWS", 0)
    assert sorted(tuple(r) for r in common.spread_join(rows, narrow, "k", rows.i).collect()) == want
    assert len(want) == 100 and {v for _, k, v in want if k == "2"} == {None} and {v for _, k, v in want if k is None} == {7}


# Whitening


def brute_white(rows, k=4):
    x = np.array([[np.floor(whitening.SCALE * float(c)) for c in r.embedding] for r in rows])
    fit = np.unique(x, axis=0)
    n, total = len(fit), fit.sum(0)
    centred = fit - total / n
    v = centred.T @ centred / n
    e, q = np.linalg.eigh(v)
    e, q = e[::-1][:k], q[:, ::-1][:, :k]
    deviation = [sum(int(n * a - s) ** 2 for a, s in zip(row, total)) for row in x]
    return n, deviation, (x - total / n) @ (q / np.sqrt(e)), e / np.trace(v)


@pytest.mark.parametrize("sf", [SF, SF.replace("sf0.001", "sf0.1")])
def test_whitening_is_that_of_a_full_decomposition(spark, sf):
    rows = usable(spark.read.parquet(f"{sf}/embeddings.parquet").collect())
    n, deviation, white, explained = brute_white(rows)
    got = {(r.vec_id, r.component): r for r in queries.op13_whitening(spark, sf).collect()}
    assert len(got) == 4 * len(rows)
    mine = np.array([[got[r.vec_id, c].whitened for c in (1, 2, 3, 4)] for r in rows])
    mine *= np.sign((mine * white).sum(0))
    assert np.abs(mine - white).max() < 1e-9
    for r, d in zip(rows, deviation):
        one = got[r.vec_id, 1]
        assert (one.n, one.deviation) == (n, d) and abs(one.identity_error) < 1e-9 and one.residual <= whitening.PRECISION
    assert np.allclose([got[rows[0].vec_id, c].explained for c in (1, 2, 3, 4)], explained, rtol=1e-12)


@settings(max_examples=40, deadline=None)
@given(st.integers(0, 10_000), st.integers(1, 90), st.integers(1, 90), st.floats(0, 3))
def test_pairs_are_those_of_a_full_decomposition(seed, width, rank, fall):
    rng = np.random.default_rng(seed)
    g = rng.normal(size=(width, min(rank, width))) * np.exp(-fall * np.arange(min(rank, width)) / 10)
    a = g @ g.T
    want = np.linalg.eigvalsh(a)[::-1][:4]
    pairs = whitening.leading_pairs(lambda v: a @ v, width, 4)
    assert np.allclose(pairs.values, want, rtol=1e-11, atol=1e-11 * want[0])
    assert np.abs(a @ pairs.vectors - pairs.vectors * pairs.values).max() <= 1e-10 * want[0]
    assert np.allclose(pairs.vectors.T @ pairs.vectors, np.eye(len(want)), atol=1e-11)


def test_inner_solver_solves_indefinite_systems():
    rng = np.random.default_rng(1)
    q, _ = np.linalg.qr(rng.normal(size=(30, 30)))
    a = q @ np.diag(np.linspace(-2, 5, 30)) @ q.T
    rhs = rng.normal(size=(30, 3))
    rhs[:, 2] = 0
    x = whitening.minres(lambda v: a @ v, rhs, 60, 1e-13)
    assert np.abs(a @ x - rhs).max() < 1e-9 and (x[:, 2] == 0).all()


def test_whitening_of_odd_vectors(spark):
    got = whitening.whiten(odd_vectors(spark, extra=True)).collect()
    ids = sorted(str(r.vec_id) for r in got if r.component == 1)
    assert ids == sorted(["1", "2", "2", "None", "10"])
    assert {r.component for r in got} == {1, 2} and {r.n for r in got} == {4}  # four vectors in a plane
    by_one = {r.vec_id: r.deviation for r in got}
    assert by_one[1] == sum((4 * 128 - s) ** 2 for s in [128 + 64 + 256, 128 - 128 + 256] * 4)
    assert max(r.identity_error for r in got) < 1e-9
    assert whitening.whiten(spark.createDataFrame([], SCHEMA)).collect() == []
    assert whitening.whiten(odd_vectors(spark).where("vec_id in (2, 5)")).collect() == []  # no variance
    big = spark.createDataFrame([(1, [8e6, 1.0], 1), (2, [-8e6, 0.0], 1)] + [(i, [0.0, float(i)], 1) for i in range(3, 40)], SCHEMA)
    by_id = {r.vec_id: r.deviation for r in whitening.whiten(big).collect()}
    assert by_id[1] is None  # beyond 64 bits
    assert by_id[5] == (39 * 256 * 5 - 256 * (1 + sum(range(3, 40)))) ** 2
