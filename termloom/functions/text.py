"""Column functions on text: markup cleaning, cutting, analysis, highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_BODY = 2000
MIN_BODY_BYTES = 50
TITLE_FALLBACK = 100

# The markup tokens that are removed, first match wins.
MARKUP = r"'''|''|\[\[|\]\]|\{\{|\}\}|\[|\]"

# The characters Unicode calls white space.
WHITE_SPACE = (
    " \t\n\x0b\f\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# The public Snowball list of English stop words.
STOP_WORDS = tuple(
    """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers
    herself it its itself they them their theirs themselves what which who whom this that these those am is are
    was were be been being have has had having do does did doing would should could ought i'm you're he's she's
    it's we're they're i've you've we've they've i'd you'd he'd she'd we'd they'd i'll you'll he'll she'll we'll
    they'll isn't aren't wasn't weren't hasn't haven't hadn't doesn't don't didn't won't wouldn't shan't
    shouldn't can't cannot couldn't mustn't let's that's who's what's here's there's when's where's why's how's
    a an the and but if or because as until while of at by for with about against between into through during
    before after above below to from up down in out on off over under again further then once here there when
    where why how all any both each few more most other some such no nor not only own same so than too very
    """.split()
)

# A word is a run of letters, marks, digits and underscores; an apostrophe or dot between two runs joins them.
# Han and Hiragana characters are words of their own. The group is possessive, which Java's matcher repeats without recursion.
# Frequent characters and plain ranges come first in each class, since property look-ups are what matching costs.
_IDEOGRAPH = r"\u2e80-\ufaff\x{20000}-\x{3ffff}&&[\p{IsHan}\p{IsHiragana}]"
_RUN = rf"[a-z0-9_[\p{{L}}\p{{M}}\p{{N}}&&[^{_IDEOGRAPH}]]]+"
WORD = rf"{_RUN}(?:['’.]{_RUN})*+|[{_IDEOGRAPH}]"


def truncate(text: Column, n: int, unit: str = "chars") -> Column:
    """The first ``n`` characters, or bytes; a character cut in half turns into U+FFFD."""
    if unit == "chars":
        return F.substring(text, 1, n)
    if unit == "bytes":
        cut = F.substring(F.encode(text, "UTF-8"), 1, n).cast("string")
        return F.when(F.octet_length(text) <= n, text).otherwise(F.make_valid_utf8(cut))
    raise ValueError(f"unknown unit: {unit}")


def trim_space(text: Column) -> Column:
    return F.trim(text, F.lit(WHITE_SPACE))


def clean_markup(text: Column, max_len: int | None = None, unit: str = "chars") -> Column:
    """Drop markup, fold runs of spaces, tabs and newlines, cut to ``max_len`` if that is given, then trim."""
    flat = F.regexp_replace(F.regexp_replace(text, MARKUP, ""), r"[ \n\t]+", " ")
    return trim_space(flat if max_len is None else truncate(flat, max_len, unit))


def long_enough(body: Column, min_bytes: int = MIN_BODY_BYTES) -> Column:
    return F.octet_length(body) >= min_bytes


def embedding_text(title: Column, body: Column) -> Column:
    """What the encoder reads: the title, or the start of the body when there is no title."""
    return F.when(title != "", title).otherwise(F.coalesce(truncate(body, TITLE_FALLBACK), F.lit("")))


def string_or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def words(text: Column) -> Column:
    """Lower-cased words in order, stop words included, so that indexes in the array are positions."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def is_stop_word(term: Column) -> Column:
    return term.isin(*STOP_WORDS)


def analyzed(text: Column, first: int = 0) -> Column:
    """``array<struct<term, pos>>`` without stop words; positions count from ``first`` and keep the stop words' gaps."""
    placed = F.transform(
        words(string_or_empty(text)),
        lambda w, i: F.struct(w.alias("term"), (i + F.lit(first) if first else i).alias("pos")),
    )
    return F.filter(placed, lambda t: ~is_stop_word(t["term"]))


def fragment(text: Column, terms: Column, width: int = 200) -> Column:
    """A window of about ``width`` characters round the first of ``terms``, every hit of them in ``<mark>``.

    ``terms`` is an array of analysed terms. NULL when none of them occurs.
    """
    boundary_l, boundary_r = r"(?<![\p{L}\p{M}\p{N}_])", r"(?![\p{L}\p{M}\p{N}_])"
    quoted = F.transform(terms, lambda t: F.concat(F.lit(r"\Q"), t, F.lit(r"\E")))
    pattern = F.concat(F.lit(f"(?iu){boundary_l}(?:"), F.array_join(quoted, "|"), F.lit(f"){boundary_r}"))
    found = F.regexp_instr(text, pattern)
    start = F.greatest(F.lit(1), found - F.lit(width // 4))
    window = F.substring(text, start, F.lit(width))
    return F.when(
        (F.size(terms) > 0) & (found > 0),
        F.regexp_replace(window, pattern, F.lit("<mark>$0</mark>")),
    )
