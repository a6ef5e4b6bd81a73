"""Operators over the whole corpus beside brute-force versions."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from termloom.llm import components, lines, passages, queries, simhash, toxicity, vectors

from ..compare import compare
from ..conftest import SF


def table(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


def joined(pairs, nodes):
    """Smallest node that each reaches."""
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark, docs):
    from termloom.llm.common import prepare

    prepare(spark)
    rng = random.Random(3)
    edges = [(i, i + 1) for i in range(100, 160)] + [(500, n) for n in range(501, 600)]
    edges += [(rng.randrange(1000, 1200), rng.randrange(1000, 1200)) for _ in range(120)] + [(7, 7), (9, 8), (8, 9)]
    df = spark.createDataFrame([*edges, (None, 3), (4, None)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(df).collect()}
    edges = [(a, b) for a, b in edges if a != b]
    want = joined(edges, {n for e in edges for n in e})
    assert got == want
    assert components.connected_components(df.limit(0)).collect() == []


# SimHash


def brute_simhash(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def check_simhash(rows, texts):
    """``texts``: pairs of id and text."""
    want = [(i, brute_simhash(t or "")) for i, t in texts]
    assert Counter((r.doc_id, r.fp % (1 << 64)) for r in rows) == Counter(want)
    fps = sorted({f for _, f in want})
    near = [(a, b) for n, a in enumerate(fps) for b in fps[n + 1 :] if (a ^ b).bit_count() <= 2]
    of = joined(near, fps)
    least = {}
    for i, f in want:
        if i is not None:
            least[of[f]] = min(least.get(of[f], i), i)
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter((i, least.get(of[f])) for i, f in want)


def test_simhash_of_the_table(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    check_simhash(simhash.simhash_components(df).collect(), [(r["doc_id"], r["text"]) for r in table("documents")])


def test_simhash_stands_odd_rows(spark, docs, empty_docs, odd):
    check_simhash(simhash.simhash_components(docs(odd, extra=True)).collect(), odd)
    assert simhash.simhash_components(empty_docs).collect() == []
    assert simhash.keep_one_per_component(empty_docs).collect() == []


def test_masks_cover_every_pair():
    masks = simhash.covering_masks()
    for a in range(64):
        for b in range(a, 64):
            assert any(not (m >> a | m >> b) & 1 for m in masks)


def test_links_of_random_fingerprints(spark):
    from termloom.llm.common import prepare

    prepare(spark)
    rng = random.Random(8)
    fps = {0, (1 << 64) - 1}
    for _ in range(20):
        base = rng.getrandbits(64)
        fps.add(base)
        for _ in range(12):  # a dense group and chains
            base ^= 1 << rng.randrange(64)
            fps.add(base)
            fps.add(base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    df = spark.createDataFrame([(simhash.as_signed(f),) for f in fps], "fp long")
    got = {r.fp: r.class_fp for r in simhash.fingerprint_classes(df).collect()}
    signed = sorted(simhash.as_signed(f) for f in fps)
    near = [(a, b) for n, a in enumerate(signed) for b in signed[n + 1 :] if ((a ^ b) % (1 << 64)).bit_count() <= 2]
    assert got == joined(near, signed)


def test_one_of_each_group_stays(spark, docs, odd):
    text = "some words that are said more than once by the same people in the same place"
    rows = odd + [(20, text), (21, text), (20, text), (22, text + " and more"), (None, text)]
    df = docs(rows, extra=True)
    kept = simhash.keep_one_per_component(df)
    assert kept.columns == df.columns
    ids = [r.doc_id for r in kept.collect()]
    found = {(r.doc_id, r.component_id) for r in simhash.simhash_components(df).collect()}
    assert ids.count(20) == 1 and 21 not in ids and ids.count(4) == 1
    assert {i for i in ids if i is not None} == {c for _, c in found if c is not None}


# Lines


def test_line_dedup_matches_sql(spark):
    assert compare(spark, SF, "op6", queries.op6_line_dedup, queries.LINE_DEDUP_SQL) == ""


def test_lines_on_many_sites_stay_once(spark, docs):
    rows = [(i, f"own {i}\n shared \nowner {i % 3}", f"s{i % 12}") for i in range(40)] + [(99, "shared", "s1")]
    got = {r.doc_id: r.text for r in lines.remove_spread_lines(docs(rows), min_sites=10).collect()}
    assert got[0] == "own 0\n shared \nowner 0"
    assert all("shared" not in got[i] for i in range(1, 40)) and got[99] == ""


@pytest.mark.parametrize("sites", [9, 10, 11])
def test_limit_is_exact(spark, docs, sites):
    rows = [(i, f"line\nown {i}", f"s{i % sites}") for i in range(60)]
    got = lines.remove_spread_lines(docs(rows), min_sites=10, counts=("n", "gone")).collect()
    assert sum(r.gone for r in got) == (59 if sites >= 10 else 0)


def test_sketches_are_corrected_by_counts(spark, docs):
    rows = [(i, "hot\nwarm" if i < 990 else "hot", f"s{i}") for i in range(1000)]
    lines_ = lines.line_rows(docs(rows), "source").cache()
    assert lines.spread_lines(lines_, min_sites=1000, lg_k=6).count() == 1
    assert lines.spread_lines(lines_, min_sites=990, lg_k=6).count() == 2


def test_lines_stand_odd_rows(spark, docs, empty_docs, odd):
    df = docs(odd, extra=True)
    out = lines.remove_spread_lines(df, counts=("n_before", "n_gone"))
    assert out.columns == [*df.columns, "n_before", "n_gone"]
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(odd)
    same = docs([(4, "a\nb", f"s{i}") for i in range(20)] + [(None, "a\nc", "s0")])
    assert {r.text for r in lines.remove_spread_lines(same).collect()} == {"a\nb", "c"}
    assert lines.remove_spread_lines(empty_docs).collect() == []


# Passages


def word_runs(n):
    where = defaultdict(set)
    for r in table("documents"):
        words = passages._WORD.findall(r["text"].lower())
        for i in range(len(words) - n + 1):
            where[tuple(words[i : i + n])].add(r["doc_id"])
    return {i for ids in where.values() if len(ids) > 1 for i in ids}


def test_passages_of_the_table(spark):
    texts = {r["doc_id"]: passages._WORD.findall(r["text"].lower()) for r in table("documents")}
    rows = queries.op3_passages(spark, SF).collect()
    found = {r.doc_id for r in rows} | {r.other_id for r in rows}
    assert word_runs(passages.WORDS) <= found
    for r in rows:
        a = texts[r.doc_id][r.start_word : r.start_word + r.n_words]
        b = texts[r.other_id][r.other_start : r.other_start + r.other_words]
        a, b = ({tuple(x[i : i + 5]) for i in range(len(x) - 4)} for x in (a, b))
        assert min(r.n_words, r.other_words) >= passages.WORDS
        assert len(a & b) / len(a | b) >= 0.8 - 1e-9 and r.similarity == pytest.approx(len(a & b) / len(a | b))


def test_compact_windows_are_those_of_brute_force():
    rng = np.random.default_rng(4)
    for n, least, high in ((60, 7, 1000), (40, 5, 6), (9, 9, 50), (8, 9, 50), (30, 1, 9)):
        h = rng.integers(0, high, n).astype(np.uint64)
        want = set()
        for c in range(n):
            a = c
            while a > 0 and h[a - 1] > h[c]:
                a -= 1
            b = c
            while b < n - 1 and h[b + 1] >= h[c]:
                b += 1
            if b - a + 1 >= least:
                want.add((a, c, b))
        assert set(passages.compact_windows(h, least)) == want


def test_edited_passages_are_found(spark, docs):
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("abcdefghijk", k=6))
    text = lambda n: [word() for _ in range(n)]
    core = text(80)
    changed = [*core[:30], word(), *core[31:60], *core[61:]]
    rows = [(1, text(40) + core + text(30)), (2, text(10) + changed), (3, core + text(500)), (4, text(200)), (5, core[:40])]
    rows = [(i, " ".join(w)) for i, w in rows] + [(6, " ".join(core)), (7, " ".join(core))]
    got = passages.near_passages(docs(rows)).collect()
    assert {i for r in got for i in (r.doc_id, r.other_id)} == {1, 2, 3, 6, 7}
    assert [(r.doc_id, r.other_id, r.similarity) for r in got if r.doc_id == 7] == [(7, 6, 1.0)]


def test_passages_stand_odd_rows(spark, docs, empty_docs, odd):
    assert passages.near_passages(docs(odd, extra=True)).collect() == []
    assert passages.near_passages(empty_docs).collect() == []
    many = " ".join(f"w{i}" for i in range(70))
    got = passages.near_passages(docs([(1, many), (1, many), (None, many), (2, many)])).collect()
    assert sorted(str(r.doc_id) for r in got) == ["2", "None"] and {r.other_id for r in got} == {1}


# Vectors


def brute_vectors(rows, least=vectors.LEAST_COSINE):
    links, groups = Counter(), defaultdict(list)
    for i, (vec_id, v, label) in enumerate(rows):
        ok = label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)
        if ok:
            groups[label, len(v)].append((i, vec_id, np.array(v, dtype=np.float64)))
    pairs = []
    for members in groups.values():
        unit = np.array([v / np.linalg.norm(v) for *_, v in members])
        for a, b in zip(*np.nonzero(unit @ unit.T >= least)):
            if a != b:
                links[members[a][0]] += 1
                pairs.append((members[a][1], members[b][1]))
    return links, joined(pairs, {r[0] for r in rows})


def test_vectors_beside_brute_force(spark, monkeypatch):
    monkeypatch.setattr(vectors, "SHARD", 60)
    monkeypatch.setattr(vectors, "MOST", 90)
    rng = np.random.default_rng(6)
    rows, n = [], 0
    for label in (0, 1, 2):
        for size in [150, 30, 5, 2] + [1] * 120:
            centre = rng.normal(size=16)
            for _ in range(size):
                rows.append((n, (centre + rng.normal(size=16) * 0.12).tolist(), label))
                n += 1
    rows += [(n, rows[0][1], 0), (n + 1, rows[0][1], 1), (n + 2, rows[0][1], None), (n + 3, None, 0), (n + 4, [0.0] * 16, 0)]
    rows += [(n + 5, [float("nan")] * 16, 0), (n + 6, [None] * 16, 0), (n + 7, [1.0, 2.0], 0), (n + 8, [], 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("cells", F.lit(1))
    exact = [(r.vec_id, r.embedding, r.label) for r in df.collect()]
    links, comps = brute_vectors(exact)
    got = vectors.near_vectors(df).collect()
    assert len(got) == len(rows)
    found = sum(r.n_links for r in got)
    assert all(r.n_links <= links[r.vec_id] for r in got)
    assert found >= 0.97 * sum(links.values())
    same = sum(r.component_id == comps[r.vec_id] for r in got)
    assert same >= 0.97 * len(got)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)


def test_vectors_stand_odd_tables(spark):
    schema = "vec_id long, embedding array<float>, label int"
    assert vectors.near_vectors(spark.createDataFrame([], schema)).collect() == []
    rows = [(1, [1.0, 0.0], 0), (1, [1.0, 0.0], 0), (None, [1.0, 0.0], 0), (2, None, None), (None, None, 0)]
    got = vectors.near_vectors(spark.createDataFrame(rows, schema)).collect()
    assert Counter((r.vec_id, r.n_links) for r in got) == Counter({(1, 2): 2, (None, 2): 1, (2, 0): 1, (None, 0): 1})


def test_graph_reaches_every_node():
    rng = np.random.default_rng(0)
    v = vectors.unit_rows(np.concatenate([rng.normal(size=(200, 8)), np.ones((50, 8)) + rng.normal(size=(50, 8)) * 1e-3]))
    graph, medoid = vectors.build_graph(v)
    hits = missed = 0
    for i in range(len(v)):
        truth = set(np.flatnonzero(v @ v[i] >= 0.93))
        found = set(vectors.range_search(v, graph, medoid, v[i], 0.93))
        assert found <= truth
        hits, missed = hits + len(found), missed + len(truth - found)
    assert missed <= 0.03 * hits


# Toxicity


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = queries.op10_toxicity(spark, sf).collect()
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    held = [(r.score, labels[r.doc_id]) for r in rows if r.held_out and r.doc_id in labels]
    wrong = sum((s >= 0.7) != (y == 1) for s, y in held)
    assert wrong <= 0.1 * len(held)
    clean = [s for s, y in held if y == 0]
    assert sum(s >= 0.7 for s in clean) <= 0.03 * len(clean)


def example_index(n=700, n_words=200, seed=2):
    rng = np.random.default_rng(seed)
    names = [f"w{i:03}" for i in range(n_words)]
    share = 1 / np.arange(1, n_words + 1)
    rows = []
    for i in range(n):
        words = sorted(rng.choice(names, rng.integers(0, 30), replace=False, p=share / share.sum()).tolist())
        rows.append({"words": words, "counts": rng.integers(1, 5, len(words)).tolist(), "label": int(i % 3 == 0), "doc_id": i})
    numbers = {w: i for i, w in enumerate(names)}
    df = np.array([sum(w in r["words"] for r in rows) for w in names])
    return toxicity.build_index(rows, df, 2 * n, numbers), rows


def test_nearest_is_exact():
    index, rows = example_index()
    known = [r for r in rows if r["words"]]
    assert 0 < len(index.full) < len(index.numbers)  # common and rare terms
    assert sorted(index.example.tolist()) == [r["doc_id"] for r in known]
    full = {}
    for r in known:
        v = np.zeros(len(index.numbers))
        ids, w = index.vector(Counter(dict(zip(r["words"], r["counts"]))))
        v[ids] = w
        assert np.linalg.norm(v) == pytest.approx(1)
        full[r["doc_id"]] = v
    for r in known[:150]:
        asked = Counter(dict(zip(r["words"], r["counts"]))) + Counter({"unknown": r["doc_id"] % 2})
        ids, w = index.vector(asked)
        base = index.common_parts([(ids, w)])[0]
        for without in (None, r["doc_id"]):
            cosines = {i: round(float(v[ids] @ w), 9) for i, v in full.items() if i != without}
            want = sorted((-c, i) for i, c in cosines.items() if c > 0)[: toxicity.NEIGHBOURS]
            found, entries = index.nearest(ids, w, base, toxicity.NEIGHBOURS, without)
            assert found.tolist() == pytest.approx([-c for c, _ in want], abs=2e-9)
            assert sorted(index.example[entries[found > found[-1] + 2e-9]]) == sorted(i for c, i in want if -c > -want[-1][0] + 2e-9)


def test_terms_weigh_by_all_documents_and_labels():
    index, rows = example_index()
    known = [r for r in rows if r["words"]]
    n, toxic = len(known), sum(r["label"] for r in known)
    for word, i in index.numbers.items():
        m = sum(word in r["words"] for r in known)
        a = sum(word in r["words"] for r in known if r["label"])
        cells = [(a, m, toxic), (m - a, m, n - toxic), (toxic - a, n - m, toxic), (n - toxic - m + a, n - m, n - toxic)]
        g = 2 * sum(c * np.log(c * n / (r * t)) for c, r, t in cells if c) if a * n > m * toxic else 0
        df = max(1, sum(word in r["words"] for r in rows))
        assert index.factors[i] == pytest.approx(np.log((1 + 1400) / df) * (1 + g))


def test_toxic_examples_are_their_own_nearest(spark, docs):
    sf = "/root/testdata/sf0.01"
    base = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labels = queries.training_labels(spark, sf)
    toxic = [r.doc_id for r in labels.where("label = 1").collect()]
    copies = base.where(F.col("doc_id").isin(toxic)).select((F.col("doc_id") + 10**9).alias("doc_id"), "text")
    scorer = toxicity.Scorer(base, labels)
    s = scorer.score(F.col("text"))
    got = {r.doc_id: r for r in base.unionByName(copies).select("doc_id", "text", s.alias("s")).collect()}
    index = scorer.index.value
    for i in toxic:
        assert got[i].s == got[i + 10**9].s
        if got[i].text:
            v = index.vector(Counter(toxicity.words_of(got[i].text)))
            cosines, entries = index.nearest(*v, index.common_parts([v])[0], 3)
            assert cosines[0] == 1
            same = {e for c, e in zip(cosines, index.example[entries]) if c == 1}
            assert {" ".join(sorted(toxicity.words_of(got[e].text))) for e in same} == {" ".join(sorted(toxicity.words_of(got[i].text)))}
    # Unlike texts share a score only where no example has a word of theirs.
    by_score = {}
    for r in got.values():
        if r.s.evidence:
            by_score.setdefault(r.s.score, set()).add(tuple(sorted(Counter(toxicity.words_of(r.text)).items())))
    assert max(map(len, by_score.values())) <= 2


def test_curve_is_calibrated():
    rng = np.random.default_rng(0)
    share = rng.uniform(0.01, 0.99, 20_000)
    truth = 1 / (1 + np.exp(-(-1 + 2.5 * np.log(share / (1 - share)))))
    curve = toxicity.fitted_curve(share, (rng.uniform(size=len(share)) < truth).astype(float))
    assert curve == pytest.approx((-1, 2.5), abs=0.15)
    assert toxicity.fitted_curve(share, np.ones(len(share))) is None
    assert toxicity.calibrated(0.0, (0.0, 50.0)) < 1e-9 and toxicity.calibrated(0.3, None) == 0.3


def test_toxicity_stands_odd_rows(spark, docs, empty_docs, odd):
    labels = spark.createDataFrame([(4, 1), (5, 0), (6, None), (None, 1), (777, 1), (4, 0)], "doc_id long, label int")
    got = toxicity.score_documents(docs(odd, extra=True), labels).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in odd)
    assert len({r.score for r in got if r.doc_id in (1, 2, 3)}) == 1
    assert toxicity.score_documents(empty_docs, labels).collect() == []
    none = toxicity.score_documents(docs(odd), labels.limit(0)).collect()
    assert {r.score for r in none} == {0.0}
    df = docs(odd, extra=True)
    assert toxicity.drop_toxic(df, labels).columns == df.columns


# Pipeline


def test_pipeline_stages(spark):
    sf = SF.replace("sf0.001", "sf0.01")  # the smaller table has too few labels
    base = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in base.collect()}
    docs_ = base
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs_.collect()}
        docs_ = stage(spark, docs_, sf).cache()
        after = {r.doc_id: r.text for r in docs_.collect()}
        assert docs_.columns == base.columns and set(after) <= set(before)
        if name == "toxicity":
            labels = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
            gone = set(before) - set(after)
            clean = {i for i, toxic in labels.items() if toxic == 0}  # of unlabelled rows nothing is known here
            assert gone and len(gone & clean) <= 0.02 * len(clean)
        if name == "line_dedup":
            assert set(after) == set(before)
            kept = Counter(x.strip(" ") for t in after.values() for x in t.split("\n"))
            assert all(kept[x.strip(" ")] for t in before.values() for x in t.split("\n"))  # no line leaves the corpus
        if name == "simhash_dedup":
            fps = {i: brute_simhash(t) for i, t in before.items()}
            near = [(a, b) for a in fps for b in fps if a < b and (fps[a] ^ fps[b]).bit_count() <= 2]
            assert set(after) == set(joined(near, fps).values())
        if name == "personal_data":
            assert not any("@" in t and ".org" in t for t in after.values())
    rows = corpus_pipeline.STAGES[-1][1](spark, docs_, sf).collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs_.collect()}


def test_stages_stand_odd_rows(spark, docs, empty_docs, odd):
    for rows in (docs(odd), empty_docs):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, rows, SF)
            out.collect()
            if stage is not corpus_pipeline.STAGES[-1][1]:
                assert out.columns == rows.columns
