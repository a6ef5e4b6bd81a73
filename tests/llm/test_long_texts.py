"""Very long words and runs of white space in packing."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from termloom.llm import packing, queries

N = 2_000_000
LONG = [" " * N, "\n" * N + "end", "a" * N, " \t" * (N // 2) + "b", "é" * 400_000, "?!" * 400_000, "one two " + "7" * 100_000]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.mark.parametrize("text", LONG, ids=[f"{t[-4:]!r}" for t in LONG])
def test_ids_of_long_runs_are_those_of_the_library(library, text):
    assert packing.encode(text, **queries.byte_bpe()) == library.encode(text, add_special_tokens=False).ids


def test_long_runs_are_packed(spark, docs, library):
    rows = list(enumerate([LONG[0], LONG[1], "short"]))
    pieces = packing.pack(docs(rows), keep_ids=True, **queries.byte_bpe()).collect()
    for i, text in rows:
        mine = sorted((p.start, bytes(p.ids)) for p in pieces if p.doc_id == i)
        ids = np.array([*library.encode(text, add_special_tokens=False).ids, packing.END_ID], dtype="<u4").tobytes()
        assert b"".join(b for _, b in mine) == ids
    assert all(zlib.crc32(bytes(p.ids)) == p.ids_crc32 for p in pieces)
