"""Hand-written rows for the column functions."""

import pytest
from pyspark.sql import functions as F

from termloom.functions import (
    analyzed,
    clean_markup,
    cosine,
    embedding_text,
    fragment,
    int_list,
    long_enough,
    path_parts,
    shard_of,
    truncate,
    vector_from_json,
    words,
)
from termloom.operators.queries import hybrid_defaults, keyword_defaults, rejected
from termloom.sources.tables import local_table


def column(spark, rows, expression, schema="t string"):
    df = local_table(spark, [r if isinstance(r, tuple) else (r,) for r in rows], schema)
    return [r[0] for r in df.select(expression).collect()]


def test_clean_markup(spark):
    raw = ["''''x''''", "[[[a]]] {{{b}}}", "a\n\tb", "x" * 1999 + " y", "　 a  b \x85", "a '' b", "{a}"]
    want = ["'x'", "a {b}", "a b", "x" * 1999, "a b", "a b", "{a}"]
    assert column(spark, raw, clean_markup(F.col("t"), 2000)) == want


def test_clean_markup_keeps_whole_texts(spark):
    assert column(spark, ["x" * 5000], F.length(clean_markup(F.col("t"), None))) == [5000]


def test_truncate_units(spark):
    assert column(spark, ["éé"], truncate(F.col("t"), 1)) == ["é"]
    assert column(spark, ["éé", "ab"], truncate(F.col("t"), 3, "bytes")) == ["é�", "ab"]
    with pytest.raises(ValueError):
        truncate(F.lit("x"), 1, "words")


def test_minimum_length_counts_bytes(spark):
    assert column(spark, ["x" * 49, "x" * 50, "é" * 25], long_enough(F.col("t"))) == [False, True, True]


def test_words(spark):
    text = "Don't stop: 3.14, wiki_12 e.g. x@mail.com 漢字ab ひ é's ..."
    want = ["don't", "stop", "3.14", "wiki_12", "e.g", "x", "mail.com", "漢", "字", "ab", "ひ", "é's"]
    assert column(spark, [text], words(F.col("t"))) == [want]


def test_analysis_keeps_gaps(spark):
    got = column(spark, ["The cat and the hat", None], analyzed(F.col("t")))
    assert [(t.term, t.pos) for t in got[0]] == [("cat", 1), ("hat", 4)]
    assert got[1] == []


def test_long_joined_words_do_not_overflow(spark):
    got = column(spark, ["a." * 50_000 + " b", "x'y." * 50_000], words(F.col("t")))
    assert got == [["a." * 49_999 + "a", "b"], ["x'y." * 49_999 + "x'y"]]


def test_embedding_text(spark):
    rows = [("", "b" * 150), ("t", "b"), (None, "b"), ("", None)]
    got = column(spark, rows, embedding_text(F.col("t"), F.col("b")), "t string, b string")
    assert got == ["b" * 100, "t", "b", ""]


def test_cosine(spark):
    rows = [([1.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [-1.0, 0.0]), ([1.0, 0.0], [0.0, 0.0]), ([1.0], [1.0, 0.0]), ([], []), (None, [1.0])]
    got = column(spark, rows, cosine(F.col("a"), F.col("b")), "a array<double>, b array<double>")
    assert got == [1.0, -1.0, 0.0, 0.0, 0.0, 0.0]


def test_vector_from_json(spark):
    raw = ["[1,2.5]", '[1,"2.5",null]', "7", "{", "[]", "[1e3,true,[1]]", None]
    want = [[1.0, 2.5], [1.0, 0.0, 0.0], None, None, [], [1000.0, 0.0, 0.0], None]
    assert column(spark, raw, vector_from_json(F.col("t"))) == want


def test_int_list(spark):
    assert column(spark, ["0, 1,x,", "", "1.0,-2", "+3"], int_list(F.col("t"))) == [[0, 1], [], [-2], [3]]


def test_path_parts(spark):
    assert column(spark, ["/hot_terms/a/b/shards"], path_parts(F.col("t"), "/hot_terms/")) == [["a", "b", "shards"]]


def test_shard_of(spark):
    # md5("wiki_1") starts with the byte read here by the standard library.
    import hashlib

    ids = [f"wiki_{i}" for i in range(50)]
    want = [hashlib.md5(i.encode()).digest()[0] % 7 for i in ids]
    assert column(spark, ids, shard_of(F.col("t"), 7)) == want
    assert column(spark, ids[:1], shard_of(F.col("t"), 0)) == [0]
    with pytest.raises(ValueError):
        shard_of(F.lit("x"), 257)


def test_fragment(spark):
    rows = [("The quick Ertion fox ertions ertion.", ["ertion"]), ("x", ["y"]), ("x", []), ("a+b", ["a"])]
    got = column(spark, rows, fragment(F.col("a"), F.col("b")), "a string, b array<string>")
    assert got == ["The quick <mark>Ertion</mark> fox ertions <mark>ertion</mark>.", None, None, "<mark>a</mark>+b"]


def test_fragment_window(spark):
    got = column(spark, [("x " * 500 + "hit " + "y " * 500, ["hit"])], fragment(F.col("a"), F.col("b")), "a string, b array<string>")
    assert "<mark>hit</mark>" in got[0] and len(got[0]) <= 200 + len("<mark></mark>")


def test_query_defaults(spark):
    rows = [(1, "a", "0"), (2, "a", "-1"), (3, "a", "abc"), (4, "a", "7"), (5, "", "3"), (6, None, "3"), (7, "a", None)]
    raw = local_table(spark, rows, "query_id int, q string, limit string")
    assert {r.query_id: r.limit for r in keyword_defaults(raw).collect()} == {1: 20, 2: 20, 3: 20, 4: 7, 7: 20}
    assert {r.query_id: r.limit for r in hybrid_defaults(raw).collect()} == {1: 10, 2: 10, 3: 10, 4: 7, 7: 10}
    assert {r.query_id for r in rejected(raw).collect()} == {5, 6}


def test_alpha_and_fusion_defaults(spark):
    rows = [(1, "a", 0.0, None), (2, "a", None, ""), (3, "a", 1.5, "other")]
    raw = local_table(spark, rows, "query_id int, q string, alpha double, fusion string")
    got = {r.query_id: (r.alpha, r.fusion) for r in hybrid_defaults(raw).collect()}
    assert got == {1: (0.7, "rrf"), 2: (0.7, "rrf"), 3: (1.5, "other")}
