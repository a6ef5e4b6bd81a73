"""Byte-level BPE: encoding by a queue of merge ranks over a linked list of symbols, decoding by joining vocabulary strings.

A text is cut at special tokens, then into words; a word's bytes are the first symbols. All neighbours that can merge stand
in a priority queue by rank, then place. The best is taken and merged in the linked list, its new neighbours are queued; an
entry whose symbols have changed since it was queued is stale and skipped. A word of n bytes costs n log n, so that one word
of a million characters is as safe as any other.
"""

from __future__ import annotations

import json
import sys
import unicodedata
from collections.abc import Iterator
from functools import cached_property, lru_cache
from heapq import heapify, heappop, heappush
from struct import pack

import numpy as np
import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_or_empty

#: Words whose ids a Python worker remembers in each of two generations, and the longest of them in characters.
REMEMBERED = 1 << 18
REMEMBERED_CHARS = 32

# How byte-level BPE cuts words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def byte_letters() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary: printable Latin-1 bytes for themselves, the others
    by code points from 256 on, ascending."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Words(dict):
    """Remembered words and their ids as little-endian unsigned 32-bit integers. A full generation becomes the older one;
    what is met again comes back from there, the rest is forgotten with it."""

    def __init__(self, bpe: "BytePairs"):
        super().__init__()
        self.bpe = bpe
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            symbols = self.bpe.merged(word.encode("utf-8", "replace"))
            ids = pack(f"<{len(symbols)}I", *symbols)
        if len(word) <= REMEMBERED_CHARS:
            if len(self) >= REMEMBERED:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class BytePairs:
    """Merges and vocabulary of a byte-level BPE from the JSON file of ``tokenizers``."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, pre = spec["model"], spec["pre_tokenizer"]
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix") if model.get(k)]
        odd += [k for k in ("byte_fallback", "ignore_merges", "fuse_unk") if model.get(k)]
        odd += [k for k in ("normalizer", "post_processor") if spec.get(k)]
        byte_level = pre and pre["type"] == "ByteLevel" and pre.get("use_regex", True) and not pre["add_prefix_space"]
        special = spec["added_tokens"]
        if model["type"] != "BPE" or odd or not byte_level or spec["decoder"]["type"] != "ByteLevel":
            raise ValueError(f"not a plain byte-level BPE: {path} {odd}")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in special):
            raise ValueError(f"special tokens of {path} take more than their own text")
        self.path = path
        letters = byte_letters()
        vocab = model["vocab"]
        self.first = [0] * 256
        for letter, byte in letters.items():
            self.first[byte] = vocab[letter]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges[vocab[a], vocab[b]] = (rank, vocab[a + b])
        self.special = {t["content"]: t["id"] for t in special}
        longest_first = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("|".join(regex.escape(s) for s in longest_first)) if special else None
        strings = {i: s for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        # A string with a character that stands for no byte is taken as it is.
        as_bytes = lambda s: bytes(map(letters.__getitem__, s)) if all(c in letters for c in s) else s.encode()
        self.strings = [as_bytes(strings.get(i, "")) for i in range(max(strings, default=-1) + 1)]
        self.words = regex.compile(WORDS)
        self.known = Words(self)

    def merged(self, word: bytes) -> list[int]:
        """The ids of one word."""
        symbols = [self.first[b] for b in word]
        n, merges = len(symbols), self.merges
        if n < 2:
            return symbols
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        queue = []
        for i in range(n - 1):
            found = merges.get((symbols[i], symbols[i + 1]))
            if found:
                queue.append((found[0], i, found[1]))
        heapify(queue)
        while queue:
            rank, i, new = heappop(queue)
            j = after[i]
            # Stale unless the two symbols still stand here: merged ones are -1, which no pair has.
            if j >= n or merges.get((symbols[i], symbols[j])) != (rank, new):
                continue
            symbols[i], symbols[j] = new, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                found = merges.get((new, symbols[k]))
                if found:
                    heappush(queue, (found[0], i, found[1]))
            h = before[i]
            if h >= 0:
                found = merges.get((symbols[h], new))
                if found:
                    heappush(queue, (found[0], h, found[1]))
        return [s for s in symbols if s >= 0]

    @cached_property
    def unsettled(self) -> dict[str, str]:
        """Characters that are letters or digits to ``regex`` but not to ``tokenizers``, which may know an older Unicode.
        Only those can be such that Python's own tables don't have either; the library tells which. They are replaced by
        one of private use, no letter to anyone, while words are cut."""
        from tokenizers import Tokenizer

        cut = Tokenizer.from_file(self.path).pre_tokenizer.pre_tokenize_str
        chars = (chr(c) for c in range(128, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF)
        new = regex.findall(r"[\p{L}\p{N}]", "".join(c for c in chars if unicodedata.category(c) == "Cn"))
        return {c: "\ue000" for c in new if len(cut("a" + c)) > 1 and len(cut("1" + c)) > 1}

    def split(self, text: str) -> list[str]:
        if text.isascii() or self.unsettled.keys().isdisjoint(text):
            return self.words.findall(text)
        spans = (m.span() for m in self.words.finditer(text.translate(str.maketrans(self.unsettled))))
        return [text[a:b] for a, b in spans]

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return b"".join(map(self.known.__getitem__, self.split(text)))
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += map(self.known.__getitem__, self.split(text[at : m.start()]))
            out.append(self.special[m.group()].to_bytes(4, "little"))
            at = m.end()
        return b"".join(out + [self.known[w] for w in self.split(text[at:])])

    def decode(self, ids: bytes) -> str:
        """The text of ids; those out of the vocabulary are skipped, bytes that are no UTF-8 become U+FFFD."""
        n = len(self.strings)
        strings = self.strings
        return b"".join(strings[i] for i in np.frombuffer(ids, dtype="<u4").tolist() if i < n).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def byte_pairs(path: str) -> BytePairs:
    """One per Python worker and file."""
    return BytePairs(path)


def encode_column(text: Column, path: str) -> Column:
    """Token ids of a text, special tokens in it included, as little-endian unsigned 32-bit integers; null for null."""

    @F.pandas_udf(T.BinaryType())
    def encoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = byte_pairs(path).encode
        for batch in batches:
            yield pd.Series([None if t is None else encode(t) for t in batch], dtype=object)

    return encoded(text)


def decode_column(ids: Column, path: str) -> Column:
    """The text of ids as ``encode_column`` gives them; null for null."""

    @F.pandas_udf(T.StringType())
    def decoded(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decode = byte_pairs(path).decode
        for batch in batches:
            yield pd.Series([None if i is None else decode(i) for i in batch], dtype=object)

    return decoded(ids)


def tokenize(docs: DataFrame, path: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every row of ``docs (doc_id, text)``, in the partitions it comes in.

    A null text is read as an empty one and has no tokens. Repeated rows, null ids and ties give a row each; other columns
    are ignored. ``path`` names the JSON file of a byte-level BPE, found at the same place on every executor.
    """
    prepare(docs.sparkSession)
    rows = docs.select("doc_id", encode_column(text_or_empty(), path).alias("ids"))
    n_tokens = F.shiftright(F.octet_length("ids"), 2).cast("long").alias("n_tokens")
    return rows.select("doc_id", n_tokens, "ids", decode_column(F.col("ids"), path).alias("decoded"))
