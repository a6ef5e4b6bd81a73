"""Chat formatting: records of many layouts become canonical turns, turns become marked text with a loss mask.

The field paths of a record are hashed; the hash selects a declarative mapping, worked out once per hash.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare


@dataclass(frozen=True)
class Layout:
    """Where a record's turns are. ``each``: the list of turns, of which ``role`` and ``text`` are fields; else ``parts``
    names a role and the fields whose texts, joined by a line break, are its turn; else the record is a turn itself, of
    the conversation and at the place that ``conversation`` and ``place`` name."""

    name: str
    each: str = ""
    role: str = ""
    text: str = ""
    parts: tuple[tuple[str, tuple[str, ...]], ...] = ()
    optional: tuple[str, ...] = ()
    conversation: str = ""
    place: str = ""
    roles: dict[str, str] = field(default_factory=dict)

    def paths(self) -> set[str]:
        """Paths that a record of this layout has."""
        if self.each:
            return {f"{self.each}[].{self.role}", f"{self.each}[].{self.text}"}
        if self.parts:
            return {p for _, fields in self.parts for p in fields} - set(self.optional)
        return {self.conversation, self.place, self.role, self.text}


_SPEAKERS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}

#: The first whose paths a record has is taken.
LAYOUTS = (
    Layout("turn rows", conversation="conv_id", place="turn", role="role", text="text"),
    Layout("messages", each="messages", role="role", text="content"),
    Layout("conversations", each="conversations", role="from", text="value", roles=_SPEAKERS),
    Layout(
        "instruction",
        parts=(("system", ("system",)), ("user", ("instruction", "input")), ("assistant", ("output",))),
        optional=("system", "input"),
    ),
    Layout(
        "prompt and response",
        parts=(("system", ("system",)), ("user", ("prompt",)), ("assistant", ("response",))),
        optional=("system",),
    ),
    Layout("prompt and completion", parts=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Layout("question and answer", parts=(("user", ("context", "question")), ("assistant", ("answer",))), optional=("context",)),
    Layout("nested request", parts=(("user", ("request.prompt",)), ("assistant", ("reply.text",)))),
)


def field_paths(value, prefix: str = "") -> set[str]:
    """Paths of all leaves: ``a.b`` for a field, ``a[]`` for the elements of a list. An empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        return {p for k, v in value.items() for p in field_paths(v, f"{prefix}.{k}" if prefix else k)}
    if isinstance(value, list) and value:
        return {p for v in value for p in field_paths(v, f"{prefix}[]")}
    return {prefix}


def path_hash(paths: set[str]) -> int:
    return xxhash.xxh64_intdigest("\n".join(sorted(paths)), 42) - (1 << 63)


def select_layout(paths: set[str], layouts: tuple[Layout, ...] = LAYOUTS) -> Layout | None:
    return next((x for x in layouts if x.paths() <= paths), None)


def _get(record: dict, path: str):
    for part in path.split("."):
        record = record.get(part) if isinstance(record, dict) else None
    return record


def _text(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)


def turns_of(record: dict, layout: Layout) -> list[tuple[str, str]]:
    """``(role, text)`` of a record in order; null is empty, an absent optional part has no turn."""
    if layout.each:
        items = [x if isinstance(x, dict) else {} for x in _get(record, layout.each)]
        found = [(_text(x.get(layout.role)), _text(x.get(layout.text))) for x in items]
    elif layout.parts:
        found = []
        for role, fields in layout.parts:
            texts = [_text(_get(record, f)) for f in fields if f not in layout.optional or _get(record, f) not in (None, "")]
            if texts:
                found.append((role, "\n".join(texts)))
    else:
        found = [(_text(record[layout.role]), _text(record[layout.text]))]
    return [(layout.roles.get(r, r), t) for r, t in found]


_TURN = T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())])
_MAPPED = T.StructType(
    [
        T.StructField("paths_hash", T.LongType()),
        T.StructField("layout", T.StringType()),
        T.StructField("conversation", T.LongType()),
        T.StructField("place", T.LongType()),
        T.StructField("turns", T.ArrayType(_TURN)),
    ]
)


@F.pandas_udf(_MAPPED)
def _mapped(records: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    chosen: dict[int, Layout | None] = {}
    for batch in records:
        rows = []
        for raw in batch:
            try:
                record = json.loads(raw) if raw is not None else None
            except ValueError:
                record = None
            paths = field_paths(record) if isinstance(record, dict) else set()
            key = path_hash(paths)
            if key not in chosen:
                chosen[key] = select_layout(paths) if paths else None
            layout = chosen[key]
            if layout is None:
                rows.append((key, None, None, None, []))
                continue
            turns = [{"role": r, "text": t} for r, t in turns_of(record, layout)]
            places = [_get(record, p) if p else None for p in (layout.conversation, layout.place)]
            rows.append((key, layout.name, *places, turns))
        out = pd.DataFrame(rows, columns=_MAPPED.names)
        for c in ("conversation", "place"):
            out[c] = pd.array(out[c].tolist(), dtype="Int64")
        yield out


def map_records(df: DataFrame, record: Column) -> DataFrame:
    """``df`` with ``paths_hash, layout, conversation, place, turns`` of the JSON object in ``record`` (replaced if there).

    Fields beyond those of a layout do no harm. A record of no known layout, a null and what isn't a JSON object have a
    null layout and no turns; group by ``paths_hash`` to see what mappings are missing.
    """
    prepare(df.sparkSession)
    keep = [c for c in df.columns if c not in _MAPPED.names]
    return df.select(*keep, _mapped(record).alias("_mapped")).select(*keep, "_mapped.*")


def canonical_turns(df: DataFrame, record: Column, conversation: str | None = None) -> DataFrame:
    """``conv_id, turn, role, text`` of all records of known layout.

    Records that are turns name their conversation; the turns of others are numbered from 0 in the one that the column
    ``conversation`` names.
    """
    mapped = map_records(df, record)
    own = F.col("layout") == LAYOUTS[0].name
    given = F.col(conversation).cast("long") if conversation else F.lit(None).cast("long")
    return mapped.select(
        F.when(own, F.col("conversation")).otherwise(given).alias("conv_id"),
        F.when(own, F.col("place")).alias("place"),
        F.posexplode("turns").alias("n", "t"),
    ).select("conv_id", F.coalesce("place", F.col("n").cast("long")).alias("turn"), "t.role", "t.text")


BEGIN, END = "<|im_start|>", "<|im_end|>"
TRAINED_ROLE = "assistant"
# Strings that mark turns in this template and in others that readers of the output may know.
CONTROL = (BEGIN, END, "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_ESCAPE = re.compile("|".join(rf"{re.escape(c[0])}(?=(?:\\)*{re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(rf"{re.escape(c[0])}\\(?=(?:\\)*{re.escape(c[1:])})" for c in CONTROL))


def escape(text: str) -> str:
    r"""A backslash behind the first character of every control string, also of those that have some there already."""
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][:-1], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """A turn's segment, and where in it the loss is taken (an empty range for roles that aren't trained)."""
    name = escape(role.replace("\\", "\\\\").replace("\n", "\\n"))
    head = f"{BEGIN}{name}\n"
    body = escape(text)
    end = len(head) + len(body) if role == TRAINED_ROLE else len(head)
    return f"{head}{body}{END}\n", len(head), end


_PIECE = re.compile(rf"{re.escape(BEGIN)}([^\n]*)\n(.*?){re.escape(END)}\n", re.DOTALL)
_ROLE = re.compile(r"\\(\\|n)")


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted text."""
    return [
        (_ROLE.sub(lambda x: "\n" if x[1] == "n" else "\\", unescape(m[1])), unescape(m[2]))
        for m in _PIECE.finditer(formatted)
    ]


_SEGMENT = T.StructType(
    [T.StructField("segment", T.StringType()), T.StructField("loss_start", T.IntegerType()), T.StructField("loss_end", T.IntegerType())]
)


@F.pandas_udf(_SEGMENT)
def _segments(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for roles, texts in batches:
        rows = [format_turn(r or "", t or "") for r, t in zip(roles, texts)]
        yield pd.DataFrame(rows, columns=_SEGMENT.names)


def format_turns(turns: DataFrame) -> DataFrame:
    """``conv_id, turn, segment, loss_start, loss_end`` for every row of ``turns (conv_id, turn, role, text)``.

    The segments of a conversation by turn (null first, equal ones by segment) are its formatted text; the loss range is
    of code points in the segment. Null roles and texts are empty. Row by row, so a conversation of any length is fine.
    """
    prepare(turns.sparkSession)
    done = turns.select("conv_id", "turn", _segments("role", "text").alias("s"))
    return done.select("conv_id", "turn", "s.*")


SUMMARY = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_SUMMARY = pa.schema(
    [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
     ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
)


class _Reader:
    """Reads one conversation's segments back, keeping digests only."""

    def __init__(self, conv_id: int | None):
        self.conv_id, self.n, self.loss_chars, self.chars = conv_id, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, segment: str, loss_start: int, loss_end: int) -> None:
        for role, text in parse(segment):
            self.turns.update(f"{role}\n{text}\n".encode())
            self.n += 1
        trained = unescape(segment[loss_start:loss_end])
        self.loss.update(trained.encode())
        self.loss_chars += len(trained)
        self.chars += len(segment)

    def row(self) -> tuple:
        return self.conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _summaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader = None
    for batch in batches:
        done = []
        for conv_id, *segment in zip(*(c.to_pylist() for c in batch.columns)):
            if reader is None or reader.conv_id != conv_id:
                if reader:
                    done.append(reader.row())
                reader = _Reader(conv_id)
            reader.add(*segment)
        yield _rows(done)
    if reader:
        yield _rows([reader.row()])


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[]] * len(_SUMMARY)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, _SUMMARY)], schema=_SUMMARY)


def read_back(segments: DataFrame) -> DataFrame:
    """One row per conversation, from the output of ``format_turns``: turns, their digest, the text under the loss mask
    (characters, digest), characters of the formatted text. Segments stream through sorted, so a conversation of any
    length needs no more memory than a batch."""
    n = int(segments.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = segments.repartition(n, "conv_id").sortWithinPartitions("conv_id", "turn", "segment")
    return ordered.select("conv_id", "segment", "loss_start", "loss_end").mapInArrow(_summaries, SUMMARY)
