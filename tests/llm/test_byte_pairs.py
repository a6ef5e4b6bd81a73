"""Byte-level BPE beside the ``tokenizers`` library."""

import hashlib
import sys
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from termloom.llm import bpe, queries

from ..conftest import SF
from .conftest import ODD

PATH = public_tokenizers.path("byte_bpe_50k.json")


@lru_cache
def loaded():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def library():
    return loaded()


def library_ids(library, text):
    return np.array(library.encode(text or "", add_special_tokens=False).ids, dtype="<u4").tobytes()


def test_query_gives_the_ids_of_the_library(spark, library):
    rows = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = {r.doc_id: r for r in queries.op11_byte_pairs(spark, SF).collect()}
    assert set(got) == {r.doc_id for r in rows}
    for r in rows:
        ids, g = library_ids(library, r.text), got[r.doc_id]
        assert (g.n_tokens, g.ids_sha256) == (len(ids) // 4, hashlib.sha256(ids).hexdigest())
        assert g.decoded_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from([" ", "  ", "\n", "a", "the", "'ll", "é", "日本", "\U0001f600", "<|endoftext|>", "12", "\x1c", "!?"])))
def test_any_mix_of_words_and_marks(parts):
    text = "".join(parts)
    b = bpe.byte_pairs(PATH)
    ids = b.encode(text)
    assert ids == library_ids(loaded(), text) and b.decode(ids) == text


def test_words_are_cut_alike_at_every_character(library):
    """Whatever Unicode version the pattern library and the tokenizer's know."""
    b, cut = bpe.byte_pairs(PATH), library.pre_tokenizer.pre_tokenize_str
    for low in range(0, sys.maxunicode + 1, 64):
        text = "".join(f"a{c} {c}1{c}.{c} {c}{c}" for c in map(chr, range(low, low + 64)) if not "\ud800" <= c <= "\udfff")
        words, at = b.split(text), 0
        for word, (_, (start, end)) in zip(words, cut(text), strict=True):
            assert (start, end) == (at, at + len(word)), hex(low)
            at = end


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 50_256), max_size=40))
def test_any_ids_decode_as_in_the_library(ids):
    mine = bpe.byte_pairs(PATH).decode(np.array(ids, dtype="<u4").tobytes())
    assert mine == loaded().decode(ids, skip_special_tokens=False)


def test_stale_entries_and_the_order_of_merges():
    """Against merging the best pair by looking through all of them each time."""
    b = bpe.byte_pairs(PATH)
    rng = np.random.default_rng(5)
    for _ in range(200):
        word = bytes(rng.choice(list(b"aaabbet hinresto"), rng.integers(1, 40)))
        symbols = [b.first[x] for x in word]
        while True:
            pairs = [(b.merges[p], i) for i, p in enumerate(zip(symbols, symbols[1:])) if p in b.merges]
            if not pairs:
                break
            (_, new), i = min(pairs, key=lambda p: (p[0][0], p[1]))
            symbols[i : i + 2] = [new]
        assert b.merged(word) == symbols


def test_remembered_words_stay_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    b = bpe.BytePairs(PATH)
    texts = [f"word{i} again" for i in range(100)]
    want = [bpe.byte_pairs(PATH).encode(t) for t in texts]
    assert [b.encode(t) for t in texts] == want and len(b.known) <= 10 and len(b.known.older) <= 10


def test_odd_rows(spark, docs, empty_docs, library):
    rows = ODD + [(9, " " * 1_000_000 + "x"), (10, "\n" * 300_000), (11, "ab" * 150_000), (12, "<|endoftext|>" * 3 + " end")]
    got = bpe.tokenize(docs(rows, extra=True), PATH).collect()
    want = sorted((repr(i), library_ids(library, t), t or "") for i, t in rows)
    assert sorted((repr(r.doc_id), bytes(r.ids), r.decoded) for r in got) == want
    assert all(r.n_tokens * 4 == len(r.ids) for r in got)
    assert bpe.tokenize(empty_docs, PATH).collect() == []


def test_other_kinds_of_tokenizers_are_refused():
    with pytest.raises(ValueError):
        bpe.BytePairs(public_tokenizers.path("word_bpe_49k.json"))
