"""The encoder interface: any function from a list of texts to a list of vectors, run as an Arrow UDF."""

from __future__ import annotations

import hashlib
import math
import re
import sys
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Encode = Callable[[list[str]], list[list[float]]]
Encoder = Callable[[], Encode]
"""Called once per task, so that a model is loaded once and not per batch."""


OK, REFUSED, LOST, NOT_TRIED = "ok", "refused", "lost", "not tried"
"""What became of a text: a vector, none for its content, none as the encoder was out of reach, or not even asked for."""


def _encode_each(encode: Encode, texts: list[str]) -> tuple[list[list[float] | None], list[str]]:
    """Vectors and outcomes, a batch at a time; when a batch fails, text by text, so that one bad text costs only its own
    vector. What the encoder refuses for its content is no outage."""
    try:
        vectors = encode(texts)
        if len(vectors) == len(texts) and all(len(v) > 0 for v in vectors):
            return [list(v) for v in vectors], [OK] * len(texts)
    except Exception:
        pass
    out: list[list[float] | None] = []
    outcomes: list[str] = []
    for text in texts:
        try:
            vector = list(encode([text])[0]) or None
            outcome = OK if vector else REFUSED
        except OUTAGES:
            vector, outcome = None, LOST
        except Exception:
            vector, outcome = None, REFUSED
        out.append(vector)
        outcomes.append(outcome)
    return out, outcomes


def _encode_all(encode: Encode, texts: list[str]) -> list[list[float]]:
    vectors = [list(v) for v in encode(texts)]
    if len(vectors) != len(texts):
        raise ValueError("the encoder returned another number of vectors than texts")
    if any(not v for v in vectors):
        raise ValueError("empty embedding returned")
    return vectors


#: Batches in a row that meet an outage in every text, after which a task takes the encoder for unreachable.
GIVE_UP = 3
#: What an encoder raises when it can't be reached, not when it refuses a text. ``OSError`` has connections and time-outs.
OUTAGES = (OSError, EOFError)


def embed(text: Column, encoder: Encoder, on_error: str = "null") -> Column:
    """Vectors for a text column. ``on_error="null"`` keeps failed rows without vector, ``"fail"`` fails the job.

    With ``"null"`` an encoder that can't be loaded, or stops answering (``OUTAGES``), leaves all further rows of its task
    without vector, so a build goes on for keywords only; the task's log has the number of rows that were not tried. Texts
    that the encoder refuses, however many in a row, stop nothing.
    """
    if on_error not in ("null", "fail"):
        raise ValueError(f"unknown on_error: {on_error}")
    if on_error == "null":
        return embed_outcome(text, encoder)["vector"]

    @F.pandas_udf("array<double>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = encoder()
        for batch in batches:
            yield pd.Series(_encode_all(encode, batch.fillna("").tolist()), index=batch.index, dtype="object")

    return vectors(text)


def embed_outcome(text: Column, encoder: Encoder) -> Column:
    """``vector`` as of ``embed``, and its ``outcome``: ok, refused, lost or not tried."""

    @F.pandas_udf("vector array<double>, outcome string")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encode, failed, skipped = None, 0, 0
        try:
            encode = encoder()
        except Exception:
            pass
        try:
            for batch in batches:
                texts = batch.fillna("").tolist()
                if encode is None or failed >= GIVE_UP:
                    found, outcomes = [None] * len(texts), [NOT_TRIED] * len(texts)
                    skipped += len(texts)
                else:
                    found, outcomes = _encode_each(encode, texts)
                    failed = failed + 1 if texts and all(o == LOST for o in outcomes) else 0
                yield pd.DataFrame({"vector": pd.Series(found, dtype="object"), "outcome": pd.Series(outcomes, dtype="object")})
        finally:
            if skipped:
                print(f"encoder out of reach: {skipped} rows without vector, not tried", file=sys.stderr, flush=True)

    return vectors(text)


def embed_queries(queries: DataFrame, encoder: Encoder, column: str = "q") -> DataFrame:
    """Adds ``query_vector``; NULL where the encoder failed, which makes hybrid search fall back to keywords."""
    return queries.withColumn("query_vector", embed(F.col(column), encoder))


def hashed_bag_encoder(dim: int = 64) -> Encoder:
    """A deterministic stand-in for a model: signed hashed word counts, scaled to length 1."""

    def load() -> Encode:
        word = re.compile(r"\w+")

        def encode(texts: list[str]) -> list[list[float]]:
            out = []
            for text in texts:
                found = word.findall(text.lower())
                hashes = [int.from_bytes(hashlib.md5(w.encode("utf-8")).digest()[:4], "big") for w in found]
                if not hashes:
                    raise ValueError("nothing to embed")
                vector = [0.0] * dim
                for h in hashes:
                    vector[h % dim] += 1.0 if h & 0x80000000 else -1.0
                if not any(vector):  # all words cancel out
                    for h in hashes:
                        vector[h % dim] += 1.0
                size = math.sqrt(sum(x * x for x in vector))
                out.append([x / size for x in vector])
            return out

        return encode

    return load
