"""Segmentations of the documents."""

import hashlib
from collections import defaultdict

from termloom.llm import queries, segment

from ..conftest import SF
from .test_corpus_operators import table


def test_segmentations_of_all_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in table("documents")}
    assert next(q for q in queries.queries() if q.startswith("op9_")) == "op9_document_segmentations"
    got = defaultdict(list)
    for r in queries.queries()["op9_document_segmentations"](spark, SF).collect():
        got[r.doc_id].append(r.ids_crc32)
        text = texts[r.doc_id] or ""
        if segment.SPACE not in text:  # the model's mark for a space is one
            assert r.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert 0 <= r.inclusion <= 1  # of a long text it can be less than a double holds
    assert set(got) == set(texts)
    assert all(len(set(v)) == len(v) <= segment.SAMPLES for v in got.values())
