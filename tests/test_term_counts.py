"""Statistics of terms with one shuffle, in an upsert too."""

from collections import defaultdict

import numpy as np
import pyarrow as pa

from termloom.operators import indexing
from termloom.sources.index_store import Layout, with_slice
from termloom.sources.tables import local_table


def postings_of(spark, layout, rows):
    docs = local_table(spark, rows, "id string, title string, body string, shard int")
    return indexing.posting_rows(with_slice(docs, layout), layout)


def test_counts_less_what_is_gone_with_one_shuffle(spark, monkeypatch):
    layout = Layout(n_shards=3, term_buckets=2)
    texts = [(f"d{i}", "the title" if i % 3 else None, " ".join(f"w{(i * j) % 17} frequent" for j in range(i % 23)), i % 3) for i in range(150)]
    texts.append(("long", "", "frequent " * 70_000, 1))
    gone = [(f"d{i}", "older title", f"frequent gone{i % 4} w{i}", i % 3) for i in range(40)]
    names = ("id", "title", "body")
    want = defaultdict(lambda: (defaultdict(int), defaultdict(dict)))
    for rows, sign in ((texts, 1), (gone, -1)):
        for r in postings_of(spark, layout, rows).collect():
            sums, tops = want[r.bucket, r.term, r.shard]
            pairs = {f: (r[f"tf_{f}"], r[f"dl_{f}"]) for f in names}
            pairs["all"] = tuple(map(sum, zip(*pairs.values())))
            for f, (tf, dl) in pairs.items():
                sums[f"df_{f}"] += sign * (tf > 0)
                if f != "all":
                    sums[f"ctf_{f}"] += sign * tf
                if tf and sign > 0:
                    k = int(np.floor(indexing.LENGTH_CLASSES * np.log2(pairs["all"][1] + 1.0)))
                    most, least = tops[f].get(k, (0, dl))
                    tops[f][k] = (max(most, tf), min(least, dl))
    monkeypatch.setattr(indexing, "COUNTED_POSTINGS", 50)
    counted = indexing.term_counts(postings_of(spark, layout, texts), layout, gone=postings_of(spark, layout, gone))
    rows = counted.collect()
    assert len(rows) == len(want)
    for r in rows:
        sums, tops = want[r.bucket, r.term, r.shard]
        assert {c: r[c] for c in sums} == sums
        for f in (*names, "all"):
            assert sorted(map(tuple, r[f"tops_{f}"])) == sorted(tops[f].values())
    plan = counted._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("Exchange hashpartitioning") == 1


def test_numbers_as_bytes():
    values = np.array([[0, 1, 255], [256, 0, 3], [65_535, 65_536, 0], [2**32, 5, 2**62], [0, 0, 0]])
    packed = indexing._packed(values)
    assert [len(x.as_py()) for x in packed] == [3, 6, 12, 24, 3]
    assert np.array_equal(indexing._unpacked(packed, 3), values)
    assert np.array_equal(indexing._unpacked(packed.slice(1, 3), 3), values[1:4])
    assert indexing._unpacked(pa.array([], pa.binary()), 3).shape == (0, 3)
