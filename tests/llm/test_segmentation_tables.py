"""Lattices of all words of a batch in flat tables, and walks through them side by side."""

import random
from bisect import bisect_right

import numpy as np
import public_tokenizers
import pytest
import xxhash

from termloom.llm import segment

TEXTS = [
    "",
    "one  line\nand another, of words",
    "Zürich 日本 \U0001f600 mixed\r\nlines \ud800",
    "▁a▁▁ b \0a",
    "é" * 300,
    "a" * 150 + " " * 40,
] + [f"text number {i} of many " * (1 + i % 7) for i in range(150)]


@pytest.fixture(scope="module")
def pieces():
    return segment.model(public_tokenizers.path("piece_bpe_32k.model"), segment.ALPHA)


def plain_walk(m, text, seed):
    """The first segmentation, from lattices of units in lists."""
    uniform, ids, log_p = random.Random(seed).random, b"", 0.0
    for unit in m.units(text) if text else []:
        lattice, at = m.lattice(unit), 0
        while at < lattice.size:
            cumulative, ends, parts, logs = lattice.nodes[at]
            j = bisect_right(cumulative, uniform()) if len(cumulative) > 1 else 0
            ids, log_p, at = ids + parts[j], log_p + logs[j], ends[j]
    return ids, log_p


def test_walks_side_by_side_are_those_of_plain_lattices(pieces):
    assert len(TEXTS) > segment.WALKS  # both ways of walking
    keys = [(i,) for i in range(len(TEXTS))]
    together = list(segment.samples(TEXTS, keys, pieces, 3))
    for key, text, found in zip(keys, TEXTS, together):
        ids, log_p = plain_walk(pieces, text, xxhash.xxh64_intdigest(repr(key), segment.SEED))
        assert found[0][0] == ids and found[0][1] == pytest.approx(log_p, abs=1e-9)
        assert len({f[0] for f in found}) == len(found)
        assert [f[2] for f in found] == sorted((f[2] for f in found), reverse=True)
    assert [segment.sample(t, k, pieces, 3) for t, k in zip(TEXTS, keys)] == together


def test_new_words_of_a_batch_are_worked_out_at_once(pieces, monkeypatch):
    learned, learn = [], segment.Tables._learn
    monkeypatch.setattr(segment.Tables, "_learn", lambda self, words: (learned.append(words), learn(self, words)))
    pieces.tables._clear()
    first = list(segment.samples(TEXTS, [(0,)] * len(TEXTS), pieces))
    assert len(learned) == 1 and len(set(learned[0])) == len(learned[0])
    assert list(segment.samples(TEXTS, [(0,)] * len(TEXTS), pieces)) == first and len(learned) == 1
    monkeypatch.setattr(segment, "REMEMBERED", 0)
    assert list(segment.samples(TEXTS, [(0,)] * len(TEXTS), pieces)) == first and len(learned) == 2


def test_bytes_beside_pieces_decode_as_alone(pieces):
    byte = {b: i for b, i in pieces.byte_ids.items()}
    word = pieces.edges[segment.SPACE + "the"][0]
    ids = np.concatenate([np.frombuffer(word, "<u4"), [byte[0x80], byte[0xE2], byte[0x96]], np.frombuffer(word, "<u4")])
    assert pieces.decode(ids) == "the" + "�" + "�" + " the"


def test_steps_of_pieces_are_found_by_slot(pieces):
    t, rng = pieces.tables, np.random.default_rng(2)
    keys = t.steps[t.steps >= 0]
    assert len(keys) == len(set(keys.tolist())) and t.probes < 40
    asked = np.concatenate([keys, rng.integers(0, keys.max(), 5000)])
    rng.shuffle(asked)
    states = dict(zip(keys.tolist(), t.to_state[t.steps >= 0].tolist()))
    at, found = t._step(asked)
    want = [(i, states[k]) for i, k in enumerate(asked.tolist()) if k in states]
    assert list(zip(at.tolist(), found.tolist())) == want
    assert t._step(asked[:0])[0].tolist() == []


@pytest.mark.parametrize("side_by_side", [1, 10**9])
def test_walks_count_the_numbers_they_take(pieces, monkeypatch, side_by_side):
    monkeypatch.setattr(segment, "WALKS", side_by_side)
    t = pieces.tables
    places = t.places([pieces.words(x) for x in TEXTS])
    words = [np.array(p[1:], dtype=np.int64) for p in places]
    uniforms = [np.random.default_rng(i).random(len(x) + 1) for i, x in enumerate(TEXTS)]
    walked = t.walks(np.array([p[0] for p in places]), words, uniforms)
    for edges, used in walked:
        assert used == int(t.several[t.place[edges]].sum())
