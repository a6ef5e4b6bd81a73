"""Packing token sequences with bounded space.

Each partition packs its documents on its own: full windows leave at once, the rest of a document goes to the fullest
open window it fits in. When none fits and all windows are open, the fullest is emitted; the document's head fills it
up first. What is open at the end is merged over partitions, tree-wise, until one group is left.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import prepare, stored, text_or_empty, union_all

SEQ_LEN = 2048
END_ID = 1
#: Open windows of a partition.
OPEN = 32
#: No document is cut for the sake of fewer tokens than this; so many are padded instead.
LEAST_CUT = 16
#: Texts with a run of so many characters of one kind go word by word: the fast encoder's pattern matcher overflows on them.
LONG_RUN = re.compile(r"\s{50000}|\w{50000}|[^\s\w]{50000}")
#: Partitions whose leftovers one task merges: at most FAN * OPEN windows.
FAN = 64

PIECE = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, whole boolean, ids binary"
_ARROW = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
        ("whole", pa.bool_()),
        ("ids", pa.binary()),
    ]
)


@lru_cache(maxsize=4)
def encoder(ranks_path: str, pattern: str):
    """A byte-level BPE from a file of ranks; one per Python worker. Its ids are those of the same vocabulary's JSON file
    in ``tokenizers`` (a test compares them), at five times the speed."""
    import tiktoken

    with open(ranks_path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding(ranks_path, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def encode(text: str, ranks_path: str, pattern: str) -> list[int]:
    """Token ids of any text, however long its words or runs of white space are."""
    fast = encoder(ranks_path, pattern)
    if len(text) < 50_000 or not LONG_RUN.search(text):
        return fast.encode_ordinary(text)
    ids: list[int] = []
    for word in regex.finditer(pattern, text):
        ids += fast._encode_single_piece(word.group().encode())
    return ids


class Packer:
    """Open windows of one task. ``done`` collects pieces of emitted windows."""

    def __init__(self, seq_len: int, n_open: int, first_id: int):
        self.seq_len, self.n_open, self.next_id = seq_len, n_open, first_id
        self.fills: list[tuple[int, int]] = []  # (tokens, window), ascending
        self.windows: dict[int, list[tuple]] = {}
        self.done: list[tuple] = []

    def _emit(self, window: int, whole: bool = True) -> None:
        self.done += [(*piece, window, offset, whole, ids) for *piece, offset, ids in self.windows.pop(window)]

    def _put(self, window: int, fill: int, piece: tuple) -> None:
        doc_id, start, doc_tokens, ids = piece
        self.windows[window].append((doc_id, start, len(ids), doc_tokens, fill, ids.tobytes()))
        fill += len(ids)
        if fill == self.seq_len:
            self._emit(window)
        else:
            insort(self.fills, (fill, window))

    def _open(self) -> int:
        self.windows[self.next_id] = []
        self.next_id += 1
        return self.next_id - 1

    def add(self, doc_id: int | None, start: int, doc_tokens: int, ids: np.ndarray) -> None:
        """``ids``: the tokens of the document from ``start`` on."""
        size = self.seq_len
        while len(ids) >= size:
            self._put(self._open(), 0, (doc_id, start, doc_tokens, ids[:size]))
            start, ids = start + size, ids[size:]
        while len(ids):
            at = bisect_left(self.fills, (size - len(ids) + 1, -1)) - 1  # the fullest with room for all
            if at >= 0:
                fill, window = self.fills.pop(at)
                return self._put(window, fill, (doc_id, start, doc_tokens, ids))
            if len(self.fills) < self.n_open:
                return self._put(self._open(), 0, (doc_id, start, doc_tokens, ids))
            fill, window = self.fills.pop()
            room = size - fill
            if room < LEAST_CUT or len(ids) - room < LEAST_CUT:
                self._emit(window)
                continue
            self._put(window, fill, (doc_id, start, doc_tokens, ids[:room]))
            start, ids = start + room, ids[room:]

    def left(self) -> None:
        for _, window in self.fills:
            self._emit(window, whole=False)
        self.fills.clear()

    def take(self) -> pa.RecordBatch:
        rows, self.done = self.done, []
        columns = list(zip(*rows)) if rows else [[]] * len(_ARROW)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _ARROW)], schema=_ARROW)


def _pack_texts(ranks_path: str, pattern: str, seq_len: int, n_open: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(seq_len, n_open, TaskContext.get().partitionId() << 28)
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text, ranks_path, pattern)
                ids.append(end_id)
                packer.add(doc_id, 0, len(ids), np.array(ids, dtype="<u4"))
                if len(packer.done) >= 256:
                    yield packer.take()
            yield packer.take()
        packer.left()
        yield packer.take()

    return run


def _merge(seq_len: int, n_open: int, level: int, last: bool):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        packer = Packer(seq_len, 1 if last else n_open, (level << 56) | (key[0].as_py() << 28))
        # Longest first leaves the short ones to fill gaps; the order is total, so a repeated task gives the same.
        rows = sorted(table.to_pylist(), key=lambda r: (-r["length"], r["sequence_id"], r["offset"]))
        for r in rows:
            packer.add(r["doc_id"], r["start"], r["doc_tokens"], np.frombuffer(r["ids"], dtype="<u4"))
        packer.left()
        if last:
            packer.done = [(*row[:6], True, row[7]) for row in packer.done]
        return pa.Table.from_batches([packer.take()])

    return run


def pack(
    docs: DataFrame,
    ranks_path: str,
    pattern: str,
    seq_len: int = SEQ_LEN,
    n_open: int = OPEN,
    end_id: int = END_ID,
    keep_ids: bool = False,
) -> DataFrame:
    """Pieces of all ``docs (doc_id, text)`` in sequences of at most ``seq_len`` tokens.

    Columns: ``doc_id``, ``start`` (tokens of the document before the piece), ``length``, ``ids_crc32``, ``doc_tokens``
    (with the end token), ``sequence_id``, ``offset`` (in the sequence, without gaps) and, if ``keep_ids``, ``ids``
    (unsigned 32-bit, little-endian). A null or empty text is the end token alone; repeated rows and ids are packed
    each on their own; a null id stays null; other columns are ignored.

    A task holds ``n_open`` windows, a merging task the leftovers of ``FAN`` others: bounded whatever the input.
    """
    spark = docs.sparkSession
    prepare(spark)
    crc = F.crc32("ids").alias("ids_crc32")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]

    def kept(pieces: DataFrame, name: str) -> DataFrame:
        ids = F.col("ids") if keep_ids else F.when(~F.col("whole"), F.col("ids"))
        plain = [c for c in pieces.columns if c != "ids"]
        return stored(pieces.select(*plain, crc, ids.alias("ids")), name)

    source = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    packed = source.mapInArrow(_pack_texts(ranks_path, pattern, seq_len, n_open, end_id), PIECE)
    step = kept(packed, "packed")
    out = [step.where("whole")]
    groups = (step.where("not whole").agg(F.max(F.shiftright("sequence_id", 28)).alias("g")).first()["g"] or 0) + 1
    group, level = F.shiftright(F.col("sequence_id"), 28), 1
    while True:
        groups = -(-groups // FAN)
        last = groups == 1
        # The id of a window begins with the task that opened it.
        task = group.bitwiseAND(F.lit((1 << 28) - 1))
        keyed = step.where("not whole").withColumn("task", F.floor(task / F.lit(FAN)).cast("long"))
        merged = keyed.groupBy("task").applyInArrow(_merge(seq_len, n_open, level, last), PIECE)
        if last:
            out.append(merged.withColumn("ids_crc32", F.crc32("ids")))
            break
        step, level = kept(merged, f"packed-{level}"), level + 1
        out.append(step.where("whole"))
    return union_all([o.select(*columns, *(["ids"] if keep_ids else [])) for o in out])
