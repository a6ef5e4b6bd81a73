"""Sampled SentencePiece segmentations: Gumbel top-k without replacement by perturbed A* search over the lattice.

Each segmentation has the perturbed score of its log probability plus Gumbel noise; the k largest are a sample without
replacement. The search never draws them all: a set of segmentations with a common beginning has the largest perturbed
score of its members, a Gumbel number at the log of its mass, so whole sets wait in the queue and only the best is opened.
"""

from __future__ import annotations

import math
import re
from array import array
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from operator import add, length_hint

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_or_empty

SPACE = "▁"
#: Segmentations of a text, and the exponent of piece probabilities: below 1 flattens them.
SAMPLES = 2
ALPHA = 0.5
SEED = 42
#: Characters whose places a worker remembers, and characters of texts that are looked at together.
REMEMBERED = 300_000
TOGETHER = 1_000_000
#: Places up to this far from the end of a unit are worked out side by side, the rest of a long unit one by one.
SIDE_BY_SIDE = 64
#: Walks go side by side as long as there are so many, and are looked through for ended ones after so many steps.
WALKS, STEPS = 16, 32

_SAMPLE = [
    T.StructField("sample", T.IntegerType()),
    T.StructField("ids", T.BinaryType()),
    T.StructField("log_prob", T.DoubleType()),
    T.StructField("perturbed", T.DoubleType()),
    T.StructField("inclusion", T.DoubleType()),
]


class Lattice:
    """All segmentations of a unit. ``nodes[i]``: cumulative probabilities of the pieces that can follow at character
    ``i``, with what they lead to: next place, ids, log of the conditional probability. ``mass``: log of the sum over all."""

    __slots__ = ("nodes", "size", "mass")

    def __init__(self, edges: list[list[tuple[int, bytes, float]]]):
        n = len(edges)
        beta = [0.0] * (n + 1)
        self.nodes: list[tuple] = [()] * n
        self.size = n
        for at in range(n - 1, -1, -1):
            scores = [s + beta[end] for end, _, s in edges[at]]
            top = max(scores)
            weights = [math.exp(s - top) for s in scores]
            total = sum(weights)
            beta[at] = top + math.log(total)
            cumulative, run = [], 0.0
            for w in weights:
                run += w / total
                cumulative.append(run)
            cumulative[-1] = 1.0
            self.nodes[at] = (
                cumulative,
                [e for e, _, _ in edges[at]],
                [i for _, i, _ in edges[at]],
                [min(0.0, s - beta[at]) for s in scores],
            )
        self.mass = beta[0]


class Model:
    """Pieces of a SentencePiece file with log probabilities. A BPE file ranks its pieces; the rank gives a Zipf weight."""

    def __init__(self, path: str, alpha: float):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        plain = [i for i in range(n) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        by_rank = sorted(plain, key=lambda i: (-sp.get_score(i), i))
        total = math.log(sum(1 / (r + 2) for r in range(len(by_rank))))
        self.pieces = [sp.id_to_piece(i) for i in range(n)]
        score = {i: alpha * (-math.log(r + 2) - total) for r, i in enumerate(by_rank)}
        self.edges = {self.pieces[i]: (self._pack([i]), score[i]) for i in plain}
        self.beginnings = {p[:k] for p in self.edges for k in range(1, len(p))}
        self.byte_ids = {int(self.pieces[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
        self.bytes = {i: b for b, i in self.byte_ids.items()}
        self.byte_score = min(score.values(), default=0.0)
        #: Neighbouring characters inside a piece. No piece crosses a place between two others.
        self.joined = {p[i : i + 2] for p in self.edges for i in range(len(p) - 1)}
        self.tables = Tables(self, score)
        #: Words can be looked at singly if no piece goes on after a word with a space.
        alone = "".join(c for c in "\t\n\r" if not any(c in pair for pair in self.joined))
        self.word = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+|[{alone or SPACE}]")
        if any(b == SPACE != a for a, b in self.joined):
            self.word = re.compile(".+", re.DOTALL)
        self.texts = np.array(
            [bytes([self.bytes[i]]) if i in self.bytes else p.encode("utf-8") for i, p in enumerate(self.pieces)], dtype=object
        )

    @staticmethod
    def _pack(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def units(self, text: str) -> list[str]:
        """The parts of a text that no piece crosses."""
        marked, joined = SPACE + text.replace(" ", SPACE), self.joined
        cuts = [i for i, pair in enumerate(map(add, marked, marked[1:]), 1) if pair not in joined]
        return [marked[a:b] for a, b in zip([0, *cuts], [*cuts, len(marked)])]

    def words(self, text: str) -> list[str]:
        """Parts of a text that no piece crosses, of which there are few different ones."""
        if not text:
            return []
        marked = SPACE + text.replace(" ", SPACE)
        return self.word.findall(marked)

    def lattice(self, unit: str) -> Lattice:
        """Of one unit, in plain lists."""
        edges = []
        for at in range(len(unit)):
            here, end = [], at + 1
            while end <= len(unit):
                part = unit[at:end]
                edge = self.edges.get(part)
                if edge:
                    here.append((end, *edge))
                if part not in self.beginnings:
                    break
                end += 1
            if not here or here[0][0] != at + 1:  # the character is no piece: its bytes are
                raw = unit[at].encode("utf-8", "surrogatepass")
                ids = self._pack([self.byte_ids[b] for b in raw])
                here.insert(0, (at + 1, ids, self.byte_score * len(raw)))
            edges.append(here)
        return Lattice(edges)

    def decode(self, ids: np.ndarray) -> str:
        # Bytes that are no UTF-8 become the same replacements beside other pieces as alone: these begin a character.
        text = b"".join(self.texts[ids].tolist()).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text.startswith(" ") else text


class Tables:
    """Lattices of words, as ``Lattice`` defines them, in flat tables: the edges of a place stand side by side from
    ``first`` on. All new words of a batch are worked out together: edges by their length, sums by the distance from the end
    of a unit. Place 0 is the end of a text; its edge leads to itself."""

    def __init__(self, m: Model, score: dict[int, float]):
        self.byte_ids, self.byte_score = m.byte_ids, m.byte_score
        letters = {c: n for n, c in enumerate(sorted({c for p in m.edges for c in p}), 1)}
        self.wide = len(letters) + 1
        self.symbol = np.zeros(0x110000, dtype=np.int64)  # 0: in no piece
        for c, n in letters.items():
            self.symbol[ord(c)] = n
        self.joined = np.zeros(self.wide**2, dtype=bool)
        self.joined[[letters[a] * self.wide + letters[b] for a, b in m.joined]] = True
        # State 0 is before any character; a step's key is state and character.
        states, self.piece_at, found = {"": 0}, [-1], {}
        for p in m.edges:
            for k in range(1, len(p) + 1):
                if p[:k] not in states:
                    states[p[:k]] = len(states)
                    self.piece_at.append(-1)
                    found[states[p[: k - 1]] * self.wide + letters[p[k - 1]]] = states[p[:k]]
            self.piece_at[states[p]] = array("I", m.edges[p][0])[0]
        self.piece_at = np.array(self.piece_at, dtype=np.int64)
        self._hash(np.array([*found], dtype=np.int64), np.array([*found.values()], dtype=np.int64))
        self.begin = np.zeros(self.wide, dtype=np.int64)
        for c, n in letters.items():
            self.begin[n] = states.get(c, 0)
        self.score = np.zeros(len(m.pieces))
        self.score[list(score)] = list(score.values())
        self._clear()

    def _hash(self, keys: np.ndarray, states: np.ndarray) -> None:
        """``steps`` has each key at its slot or, if that is taken, soon after it, and ``to_state`` its state there."""
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift = np.uint64(64 - bits)
        self.steps, self.to_state = np.full((1 << bits) + len(keys) + 1, -1), np.zeros((1 << bits) + len(keys) + 1, dtype=np.int64)
        slot, self.probes = self._slot(keys), 0
        while len(keys):
            free = np.flatnonzero(self.steps[slot] < 0)
            slots, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.steps[slots], self.to_state[slots] = keys[put], states[put]
            left = np.ones(len(keys), dtype=bool)
            left[put] = False
            keys, states, slot = keys[left], states[left], slot[left] + 1
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).view(np.int64)

    def _step(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the keys there are, ascending, and their states."""
        slot = self._slot(keys)
        at, there = np.arange(len(keys)), []
        for _ in range(max(1, self.probes)):
            held = self.steps.take(slot)
            same = held == keys
            there.append((at[same], self.to_state.take(slot[same])))
            on = np.flatnonzero((held >= 0) & ~same)
            if not len(on):
                break
            at, keys, slot = at[on], keys[on], slot[on] + 1
        at, states = (np.concatenate(x) for x in zip(*there))
        order = np.argsort(at, kind="stable") if len(there) > 1 else slice(None)
        return at[order], states[order]

    def _clear(self) -> None:
        self.known: dict[str, int] = {}
        #: Of a place: first edge, how many, whether there is a choice, cumulative probabilities (1 beyond the last).
        self.first, self.count, self.several = (np.array([x]) for x in (0, 1, 0))
        self.cumulative = np.ones((1, 1))
        #: Of an edge: where it leads, whether it ends a word, log of its conditional probability and of that of the others
        #: of its place, id (below 0: a character without one), place.
        self.to, self.piece, self.place = np.array([0]), np.array([0], dtype=np.int32), np.array([0], dtype=np.int32)
        self.last = np.array([False])
        self.log_p, self.rest = np.zeros(1), np.array([-np.inf])

    def places(self, texts: list[list[str]]) -> list[list[int]]:
        """The first places of the words of each text, and 0. Places of earlier calls may no longer hold."""
        if len(self.first) > REMEMBERED:
            self._clear()
        new = list(set().union(*texts).difference(self.known))
        if new:
            self._learn(new)
        return [[*map(self.known.__getitem__, words), 0] for words in texts]

    def _edges(self, symbols: np.ndarray, codes: np.ndarray, places: np.ndarray):
        """``place, to, id, score, rank`` of all edges, shorter ones of a place first."""
        count = np.zeros(len(symbols), dtype=np.int64)
        found = []

        def add(at: np.ndarray, length: int, ids: np.ndarray, scores: np.ndarray) -> None:
            found.append((at, at + length, ids, scores, count[at]))
            count[at] += 1

        at, state, length = places, places, 0
        while len(at):
            if length:
                on, state = self._step(state * self.wide + symbols[at + length])
                at, length = at[on], length + 1
            else:
                state, length = self.begin[symbols[at]], 1
                on = np.flatnonzero(state)
                at, state = at[on], state[on]
            ids = self.piece_at[state]
            ok = ids >= 0
            add(at[ok], length, ids[ok], self.score[ids[ok]])
            if length == 1:  # a character that is no piece: its bytes are
                bare = places[count[places] == 0]
                c = codes[bare].astype(np.int64)
                size = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
                ids = -1 - c
                for x in np.unique(c[size == 1]).tolist():
                    ids[c == x] = self.byte_ids[x]
                add(bare, 1, ids, self.byte_score * size)
        return [np.concatenate(x) for x in zip(*found)], count

    def _learn(self, words: list[str]) -> None:
        base, edge_base = len(self.first), len(self.to)
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(sizes + 1) - 1
        codes = np.frombuffer("\0".join([*words, ""]).encode("utf-32-le", "surrogatepass"), dtype="<u4")
        symbols = self.symbol[codes]
        symbols[ends] = 0
        inner = np.ones(len(symbols), dtype=bool)
        inner[ends] = False
        begins = np.ones(len(symbols), dtype=bool)  # a unit
        begins[1:] = ~self.joined[symbols[:-1] * self.wide + symbols[1:]]
        everywhere = np.arange(len(symbols))
        following = np.minimum.accumulate(np.where(begins, everywhere, len(symbols))[::-1])[::-1]
        places = np.flatnonzero(inner)
        depth = following[places + 1] - places
        (at, to, ids, scores, rank), count = self._edges(symbols, codes, places)

        # Edges stand in order of their place's distance from the end of its unit.
        order = np.argsort(depth.astype(np.uint16) if depth.max() < 1 << 16 else depth, kind="stable")
        places, depth = places[order], depth[order]
        n = count[places]
        start = np.cumsum(n) - n
        first = np.zeros(len(symbols), dtype=np.int64)
        first[places] = start
        where = first[at] + rank
        laid = [np.empty_like(x) for x in (at, to, ids, scores)]
        for x, values in zip(laid, (at, to, ids, scores)):
            x[where] = values
        at, to, ids, scores = laid

        beta = np.zeros(len(symbols))  # 0 where a unit begins: seen from the unit before
        log_p, share = np.empty(len(to)), np.empty(len(to))
        levels = np.searchsorted(depth, np.arange(1, SIDE_BY_SIDE + 2)).tolist()
        for i, j in zip(levels, levels[1:]):
            if i == j:
                continue
            a, b, c = int(start[i]), int(start[j - 1] + n[j - 1]), n[i:j]
            s = scores[a:b] + beta[to[a:b]]
            top = np.maximum.reduceat(s, start[i:j] - a)
            weights = np.exp(s - np.repeat(top, c))
            total = np.add.reduceat(weights, start[i:j] - a)
            here = top + np.log(total)
            share[a:b] = weights / np.repeat(total, c)
            log_p[a:b] = np.minimum(0.0, s - np.repeat(here, c))
            beta[places[i:j]] = np.where(begins[places[i:j]], 0.0, here)
        for i in range(levels[-1], len(places)):
            a, b = int(start[i]), int(start[i] + n[i])
            values = [x + y for x, y in zip(scores[a:b].tolist(), beta[to[a:b]].tolist())]
            top = max(values)
            weights = [math.exp(x - top) for x in values]
            total = sum(weights)
            here = top + math.log(total)
            share[a:b] = [w / total for w in weights]
            log_p[a:b] = [min(0.0, x - here) for x in values]
            if not begins[places[i]]:
                beta[places[i]] = here
        with np.errstate(divide="ignore"):
            rest = np.log1p(-np.minimum(1.0, np.exp(log_p)))
        rest[start[n == 1]] = -np.inf

        run = np.zeros(len(places))
        wide = max(int(n.max()), self.cumulative.shape[1])
        cumulative = np.ones((base + len(symbols), wide))
        cumulative[:base, : self.cumulative.shape[1]] = self.cumulative
        for r in range(wide - 1):
            more = n > r + 1
            run[more] += share[start[more] + r]
            cumulative[base + places[more], r] = run[more]
        self.cumulative = cumulative

        self.first = np.concatenate([self.first, first + edge_base])
        self.count, self.several = np.concatenate([self.count, count]), np.concatenate([self.several, (count > 1).astype(np.int64)])
        self.to, self.place = np.concatenate([self.to, to + base]), np.concatenate([self.place, (at + base).astype(np.int32)])
        self.last = np.concatenate([self.last, ~inner[to]])
        self.log_p, self.rest = np.concatenate([self.log_p, log_p]), np.concatenate([self.rest, rest])
        self.piece = np.concatenate([self.piece, ids.astype(np.int32)])
        self.known.update(zip(words, (ends - sizes + base).tolist()))

    def walks(self, places: np.ndarray, words: list[np.ndarray], uniforms: list[np.ndarray]) -> list[tuple[np.ndarray, int]]:
        """Edges from each place, then from each of its ``words`` on to the end (0), drawn by their conditional probabilities:
        one of ``uniforms`` for each place with a choice. With each walk, how many it took of them."""
        lane = np.arange(len(places))
        word_at = np.cumsum([0, *map(len, words)])[:-1]
        number_at = np.cumsum([0, *map(len, uniforms)])[:-1]
        out_at, done = number_at + STEPS * lane, np.zeros(len(places), dtype=np.int64)
        word_ends, ends = word_at + [len(w) for w in words], number_at + [len(u) for u in uniforms]
        words, numbers = np.concatenate([*words, [0]]), np.concatenate([*uniforms, [0.0]])
        out = np.zeros(len(numbers) + STEPS * len(places), dtype=np.int64)
        first, several, cumulative, to, last = self.first, self.several, self.cumulative, self.to, self.last
        on = np.flatnonzero(places)
        place, word, number = places[on], word_at[on], number_at[on]
        block = np.empty((STEPS, len(on)), dtype=np.int64)
        used = np.zeros(len(places), dtype=np.int64)
        while len(on) >= WALKS:
            for step in range(STEPS):
                edge = (cumulative.take(place, axis=0) > numbers.take(number)[:, None]).argmax(axis=1)
                edge += first.take(place)
                number += several.take(place)
                block[step, : len(on)] = edge
                place = to.take(edge)
                ended = last.take(edge)
                np.copyto(place, words.take(word), where=ended)
                word += ended
            out[(out_at[on] + done[on])[:, None] + np.arange(STEPS)] = block[:, : len(on)].T
            done[on] += STEPS
            used[on] = number - number_at[on]
            left = place != 0
            on, place, word, number = on[left], place[left], word[left], number[left]
        if len(on):
            wide = cumulative.shape[1]
            # Where a place's probabilities begin, below 0 without a choice; where an edge leads to, below 0 at a word's end.
            chances, rows = memoryview(cumulative.reshape(-1)), memoryview(np.where(several > 0, np.arange(len(several)) * wide, -1))
            first, onward = memoryview(first), memoryview(np.where(last, -1, to))
        for i, p, w, x in zip(on.tolist(), place.tolist(), word.tolist(), number.tolist()):
            edges = array("q")
            more = edges.append
            rest = iter(numbers[x : ends[i]].tolist())
            uniform = rest.__next__
            for following in words[w : word_ends[i]].tolist():
                while p >= 0:
                    edge, at = first[p], rows[p]
                    if at >= 0:
                        edge += bisect_right(chances, uniform(), at, at + wide) - at
                    more(edge)
                    p = onward[edge]
                p = following
            at = int(out_at[i] + done[i])
            out[at : at + len(edges)] = edges
            done[i] += len(edges)
            used[i] = ends[i] - length_hint(rest) - number_at[i]
        # What stands after a text's end in its last block is edge 0.
        walked = (out[a : a + n] for a, n in zip(out_at.tolist(), done.tolist()))
        return [(x[x > 0], n) for x, n in zip(walked, used.tolist())]

    def ids(self, edges: np.ndarray) -> bytes:
        ids = self.piece[edges]
        bare = np.flatnonzero(ids < 0)
        if len(bare):
            raw = [chr(-1 - c).encode("utf-8", "surrogatepass") for c in ids[bare].tolist()]
            copies = np.ones(len(ids), dtype=np.int64)
            copies[bare] = [len(r) for r in raw]
            bare = np.repeat(ids < 0, copies)
            ids = np.repeat(ids, copies)
            ids[bare] = [self.byte_ids[b] for r in raw for b in r]
        return ids.astype("<u4").tobytes()


@lru_cache(maxsize=2)
def model(path: str, alpha: float) -> Model:
    return Model(path, alpha)


def _gumbel_below(location, bound: float, exponential):
    """Gumbel numbers at ``location``, given that they are below ``bound``, from standard exponential ones."""
    with np.errstate(over="ignore", divide="ignore"):
        return -np.log(np.exp(-bound) + exponential * np.exp(-location))


class Path:
    """One segmentation: its edges, the log of the probability before each, and for each place what else could be
    (``waiting``: the perturbed score of the set of all segmentations that leave there)."""

    __slots__ = ("edges", "before", "waiting", "taken", "log_prob", "perturbed")


_SOURCE = np.random.RandomState(0)


class Search:
    """``words``: their first places in ``tables``, then 0; ``size``: a bound of the places on a way."""

    def __init__(self, tables: Tables, words: list[int], size: int, seed: int, k: int):
        self.tables, self.words = tables, np.array(words, dtype=np.int64)
        # The numbers of Python's ``random.Random(seed).random()``: as many as ``k`` paths can take.
        _SOURCE.seed([seed & 0xFFFFFFFF, seed >> 32] if seed >> 32 else [seed])
        self.numbers = _SOURCE.random_sample(k * (size + 1))
        self.noise = np.random.Generator(np.random.PCG64(seed))
        self.paths: list[Path] = []
        self.ended = False
        #: What the next path goes on from: perturbed score, edges and steps before, node, what is taken there.
        self.branch: tuple = (-math.log(self.noise.standard_exponential()), np.empty(0, dtype=np.int64), np.empty(0), 0, set())

    def start(self) -> tuple[int, np.ndarray, np.ndarray]:
        """What ``walks`` takes to end the next path."""
        t, edges = self.tables, self.branch[1]
        word = int(t.last[edges].sum())
        if len(edges) and not t.last[edges[-1]]:
            return int(t.to[edges[-1]]), self.words[word + 1 :], self.numbers
        return int(self.words[word]), self.words[word + 1 :], self.numbers

    def add(self, walked: np.ndarray, used: int) -> None:
        """The next path, whose rest has been walked with so many numbers."""
        t = self.tables
        self.numbers = self.numbers[used:]
        perturbed, edges, steps, node, taken = self.branch
        edges, steps = np.concatenate([edges, walked]), np.concatenate([steps, t.log_p[walked]])
        self.paths.append(self._close(edges, steps, perturbed, node, taken))

    def _close(self, edges: np.ndarray, steps: np.ndarray, perturbed: float, first: int, taken: set[int]) -> Path:
        """Sets that leave the way from node ``first`` on; ``taken`` there are used up by earlier paths."""
        p = Path()
        p.edges, p.perturbed = edges, perturbed
        p.before = np.concatenate([[0.0], np.cumsum(steps)])
        p.log_prob = float(p.before[-1])
        p.taken = {first: taken} if taken else {}
        p.waiting = np.full(len(steps), -np.inf)
        if first < len(steps):
            rest = self.tables.rest[edges[first:]]
            if taken:
                rest[0] = self._rest(taken | {int(edges[first])})
            location = p.before[first:-1] + rest
            drawn = _gumbel_below(location, perturbed, self.noise.standard_exponential(len(location)))
            p.waiting[first:] = np.where(np.isneginf(location), -np.inf, drawn)
        return p

    def _others(self, taken: set[int]) -> list[int]:
        """The edges beside these, which are of one place."""
        t = self.tables
        place = t.place[next(iter(taken))]
        first = int(t.first[place])
        return [e for e in range(first, first + int(t.count[place])) if e not in taken]

    def _rest(self, taken: set[int]) -> float:
        left = self.tables.log_p[self._others(taken)].tolist()
        return math.log(sum(map(math.exp, left))) if left and max(left) > -700 else -math.inf

    def best_left(self) -> tuple[float, Path]:
        return max(((float(p.waiting.max(initial=-math.inf)), p) for p in self.paths), key=lambda x: x[0])

    def open(self) -> None:
        """The set of largest perturbed score: its best member has the set's. None is left if all are taken."""
        perturbed, path = self.best_left()
        self.ended = perturbed == -math.inf
        if self.ended:
            return
        t, node = self.tables, int(path.waiting.argmax())
        taken = path.taken.get(node, set()) | {int(path.edges[node])}
        left = self._others(taken)
        weights = [math.exp(x) for x in t.log_p[left].tolist()]
        pick, edge = float(self.numbers[0]) * sum(weights), left[-1]
        self.numbers = self.numbers[1:]
        for candidate, w in zip(left, weights):
            pick -= w
            if pick < 0:
                edge = candidate
                break
        path.waiting[node] = -math.inf
        edges = np.concatenate([path.edges[:node], [edge]])
        steps = np.concatenate([np.diff(path.before[: node + 1]), t.log_p[[edge]]])
        self.branch = perturbed, edges, steps, node, taken


def best(searches: list[Search], k: int) -> None:
    """The ``k`` segmentations of largest perturbed score, of all texts side by side."""
    on = searches
    for n in range(k):
        if n:
            for x in on:
                x.open()
            on = [x for x in on if not x.ended]
        if not on:
            return
        places, words, numbers = zip(*(x.start() for x in on))
        for x, walked in zip(on, on[0].tables.walks(np.array(places), words, numbers)):
            x.add(*walked)


def samples(
    texts: list[str], keys: list[tuple], m: Model, k: int = SAMPLES, seed: int = SEED
) -> Iterator[list[tuple[bytes, float, float, float]]]:
    """For each text ``(ids, log probability, perturbed score, inclusion probability)`` of ``k`` distinct segmentations, or
    of all there are. Inclusion: the chance to exceed the first score left out, 1 if nothing is."""
    done = 0
    while done < len(texts):
        size, some = 0, []
        while done < len(texts) and (not some or size + len(texts[done]) <= TOGETHER):
            size += len(texts[done])
            some.append(done)
            done += 1
        t = m.tables
        places = t.places([m.words(texts[i]) for i in some])
        searches = [
            Search(t, words, len(texts[i]) + 1, xxhash.xxh64_intdigest(repr(keys[i]), seed), k) for i, words in zip(some, places)
        ]
        best(searches, k)
        found = []
        for search in searches:
            next_score, _ = search.best_left()
            out: list[tuple[bytes, float, float, float]] = []
            for p in search.paths:
                # 1 - exp(-exp(log p - limit)), the chance that a Gumbel number at log p exceeds the limit.
                inclusion = 1.0 if next_score == -math.inf else -math.expm1(-math.exp(min(50.0, p.log_prob - next_score)))
                out.append((t.ids(p.edges), p.log_prob, p.perturbed, inclusion))
            found.append(out)
        yield from found


def sample(text: str, key: tuple, m: Model, k: int = SAMPLES, seed: int = SEED) -> list[tuple[bytes, float, float, float]]:
    """Those of one text."""
    return next(samples([text], [key], m, k, seed))


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches put together while their texts are short of ``TOGETHER``."""
    some, size = [], 0
    for batch in batches:
        if some and size + batch.nbytes > TOGETHER:
            yield pa.concat_batches(some)
            some, size = [], 0
        some.append(batch)
        size += batch.nbytes
    if some:
        yield pa.concat_batches(some)


def _sampled(path: str, k: int, alpha: float, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model(path, alpha)
        for batch in _united(batches):
            *keys, texts = [c.to_pylist() for c in batch.columns]
            keys = list(zip(*keys)) or [()] * len(texts)
            rows = [(*key, n, *s) for key, found in zip(keys, samples(texts, keys, m, k, seed)) for n, s in enumerate(found)]
            kinds = [*batch.schema.types[:-1], pa.int32(), pa.binary(), pa.float64(), pa.float64(), pa.float64()]
            columns = list(zip(*rows)) if rows else [[]] * len(kinds)
            names = [*batch.schema.names[:-1], *(f.name for f in _SAMPLE)]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, kinds)], names=names)

    return run


def sample_segmentations(
    df: DataFrame, model_path: str, keys: list[str], k: int = SAMPLES, alpha: float = ALPHA, seed: int = SEED
) -> DataFrame:
    """``*keys, sample, ids, log_prob, perturbed, inclusion``: up to ``k`` distinct segmentations of each ``text``.

    ``ids``: unsigned 32-bit, little-endian. Seeded by the row's keys, so a repeated task, and a repeated row, gives the
    same. A null or empty text has one segmentation, without pieces; texts with fewer than ``k`` give all they have; null
    keys are keys; other columns are ignored. Row by row, without a shuffle; time and memory in proportion to the text.
    """
    prepare(df.sparkSession)
    rows = df.select(*keys, text_or_empty().alias("text"))
    schema = T.StructType([*rows.schema.fields[:-1], *_SAMPLE])
    return rows.mapInArrow(_sampled(model_path, k, alpha, seed), schema)


def decode_column(ids: Column, model_path: str) -> Column:
    """The text of a binary column of ids."""

    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        m = model(model_path, ALPHA)
        for batch in batches:
            yield pd.Series([None if b is None else m.decode(np.frombuffer(b, dtype="<u4")) for b in batch], dtype=object)

    return decoded(ids)
