"""Personal data: patterns propose spans, checksums confirm them, words nearby move the score."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import prepare, text_or_empty

#: Kinds whose spans are always kept, in the order of the output; the others must reach ``LEAST_SCORE``.
BASE_KINDS = ("email", "ip", "card", "phone")
MORE_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + MORE_KINDS
LEAST_SCORE = 0.5
#: Score of a span by its form alone, with a passed checksum where there is one.
FORM_SCORE = {"email": 0.9, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.9, "ssn": 0.3}
#: Code points on either side in which words count, and what they add or take.
NEARBY = 48
WORD_WEIGHT = 0.3
# Words that speak for a kind, and words that speak against personal data.
CONTEXT = {
    "email": r"e-?mail|contact|write to|correo|courriel",
    "ip": r"\bip\b|address|host|server|login",
    "card": r"card|credit|debit|visa|payment|tarjeta|carte|karte",
    "phone": r"phone|\btel|call|mobile|fax|telefon|tel[eé]fono|t[eé]l[eé]phone",
    "iban": r"iban|bank|account|konto|cuenta|compte",
    "ssn": r"\bssn\b|social security|tax id",
}
AGAINST = r"order|version|isbn|part no|serial|invoice|example"
# The length of an IBAN by country.
IBAN_LENGTH = {
    "AD": 24, "AE": 23, "AT": 20, "BE": 16, "BG": 22, "CH": 21, "CY": 28, "CZ": 24, "DE": 22, "DK": 18, "EE": 20,
    "ES": 24, "FI": 18, "FR": 27, "GB": 22, "GR": 27, "HR": 21, "HU": 28, "IE": 22, "IS": 26, "IT": 27, "LI": 21,
    "LT": 20, "LU": 20, "LV": 21, "MC": 27, "MT": 31, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "RO": 24, "SA": 24,
    "SE": 24, "SI": 19, "SK": 24, "SM": 27, "TR": 26,
}

# Each of these takes time in proportion to the text: runs are taken whole and never tried again from their middle.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[\x20]?[A-Z0-9])")
_SSN = re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]")
_CONTEXT = {k: re.compile(v, re.IGNORECASE) for k, v in CONTEXT.items()}
_AGAINST = re.compile(AGAINST, re.IGNORECASE)


def luhn(digits: str) -> bool:
    doubled = (int(d) * 2 for d in digits[-2::-2])
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 if d > 9 else d for d in doubled)) % 10 == 0


def mod97(iban: str) -> bool:
    """Of an IBAN without spaces."""
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1


def _emails(text: str) -> Iterator[tuple[int, int]]:
    floor = 0
    at = text.find("@")
    while at >= 0:
        start = at
        while start > floor and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            floor = domain.end()
            yield start, floor
        else:
            floor = at + 1
        at = text.find("@", floor)


def _ips(text: str) -> Iterator[tuple[int, int]]:
    for m in _IP.finditer(text):
        # A part of more digits than 255 has can only be small by leading zeros.
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            yield m.span()


def _cards(text: str) -> Iterator[tuple[int, int]]:
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def _phones(text: str) -> Iterator[tuple[int, int]]:
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGIT.findall(m[0])) <= 15:
            yield m.span()


def _ibans(text: str) -> Iterator[tuple[int, int]]:
    for m in _IBAN.finditer(text):
        left = IBAN_LENGTH.get(m[0][:2], 0) - 4
        if left <= 0:
            continue
        rest = re.compile(rf"(?:\x20?[A-Z0-9]){{{left}}}(?![A-Za-z0-9])").match(text, m.end())
        if rest and mod97((m[0] + rest[0]).replace(" ", "")):
            yield m.start(), rest.end()


def _ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in _SSN.finditer(text):
        area, group, serial = m[0].split("-")
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


_FINDERS = {"email": _emails, "ip": _ips, "card": _cards, "phone": _phones, "iban": _ibans, "ssn": _ssns}


def find_spans(text: str) -> list[tuple[str, int, int, float]]:
    """``(kind, start, end, score)`` by kind, then start; code points, end exclusive."""
    found = []
    digits = _DIGIT.search(text) is not None
    for kind in KINDS:
        if not (digits if kind != "email" else "@" in text):
            continue
        for start, end in _FINDERS[kind](text):
            around = f"{text[max(0, start - NEARBY) : start]} {text[end : end + NEARBY]}"
            score = FORM_SCORE[kind]
            score += WORD_WEIGHT * ((_CONTEXT[kind].search(around) is not None) - (_AGAINST.search(around) is not None))
            score = round(min(1.0, max(0.0, score)), 2)
            if kind in BASE_KINDS or score >= LEAST_SCORE:
                found.append((kind, start, end, score))
    return found


def redact(text: str, spans: list[tuple[str, int, int, float]]) -> str:
    """Each run of overlapping spans becomes the name of the longest of them in brackets."""
    out, at = [], 0
    runs: list[list] = []
    for kind, start, end, _ in sorted(spans, key=lambda s: (s[1], -s[2], KINDS.index(s[0]))):
        if runs and start < runs[-1][1]:
            run = runs[-1]
            run[1] = max(run[1], end)
            if end - start > run[3]:
                run[2], run[3] = kind, end - start
        else:
            runs.append([start, end, kind, end - start])
    for start, end, kind, _ in runs:
        out += [text[at:start], f"[{kind.upper()}]"]
        at = end
    return "".join(out) + text[at:]


_SPAN = [("kind", T.StringType()), ("start", T.IntegerType()), ("end", T.IntegerType()), ("score", T.DoubleType())]
SPANS = T.ArrayType(T.StructType([T.StructField(*f) for f in _SPAN]))


@F.pandas_udf(SPANS)
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    names = [n for n, _ in _SPAN]
    for batch in texts:
        yield pd.Series([[dict(zip(names, s)) for s in find_spans(t)] for t in batch])


@F.pandas_udf(T.StringType())
def _redacted(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for batch in texts:
        yield pd.Series([None if t is None else redact(t, find_spans(t)) for t in batch], dtype=object)


def spans_column(text: Column) -> Column:
    return _spans(text)


def spans_text(spans: Column) -> Column:
    """``kind:start:end`` of each span, joined by commas."""
    one = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    return F.concat_ws(",", F.transform(spans, one))


def personal_data(docs: DataFrame) -> DataFrame:
    """``doc_id, spans`` for every row of ``docs (doc_id, text)``; a null text is empty and has none.

    ``spans``: kind, start, end (code points, end exclusive), score, by kind (``KINDS``), then start. Spans of one kind
    don't overlap, those of two kinds can. Repeated rows give repeated rows; other columns are ignored. Reads each text
    once, in time in proportion to its length, without any shuffle.
    """
    prepare(docs.sparkSession)
    return docs.select("doc_id", spans_column(text_or_empty()).alias("spans"))


def redact_documents(docs: DataFrame) -> DataFrame:
    """``docs`` with each span in ``text`` replaced by its kind, such as ``[EMAIL]``; a null text stays null."""
    prepare(docs.sparkSession)
    return docs.select(*(_redacted("text").alias(c) if c == "text" else F.col(c) for c in docs.columns))
