"""Patterns and fuzzy words beside a look at every term."""

import random
import re

import pytest
from pyspark.sql import functions as F

from termloom import registry
from termloom.operators.indexing import build_index, upsert_index
from termloom.operators.lexicon import deletions, fixed_parts, pattern_grams
from termloom.operators.matching import expand_fuzzy, expand_patterns, match_clauses
from termloom.session import work_path
from termloom.sources.index_store import Layout
from termloom.sources.tables import local_table

from .test_plans import plan, scans
from .test_search import brute_distance

WORDS = ["attion", "nation", "nations", "national", "ration", "ox", "q", "letter", "litter", "écoute", "l'eau", "3.14", "日", "x_1"]
PATTERNS = [
    ("prefix", "nat*"), ("prefix", "n"), ("prefix", "NATION"), ("wildcard", "*ation"), ("wildcard", "l?tter"), ("wildcard", "*"),
    ("wildcard", "?"), ("wildcard", "n*n*l"), ("wildcard", "3.1?"), ("regexp", "[ln]ation"), ("regexp", "nations?"),
    ("regexp", "l[ei]t+er"), ("regexp", "(na|ra)tion"), ("regexp", ".*tion.*"), ("regexp", "nat.*|litter"), ("regexp", "x_\\d"),
    ("regexp", "let{2}er"), ("regexp", "nationa?l?"), ("regexp", "[[a-m]n]ation"), ("regexp", "n[^x]tion+"), ("regexp", "lz*it{1,3}er"),
    ("regexp", "rat?ion"), ("regexp", "(?i)NATION"), ("regexp", "3\\.14"), ("regexp", ""),
]


def brute(kind, value, term):
    if kind == "prefix":
        return term.startswith(value.lower().rstrip("*"))
    if kind == "wildcard":
        value = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in value.lower())
    if value == "[[a-m]n]ation":  # nested classes are Java's
        value = "[a-n]ation"
    return re.fullmatch(value, term) is not None


@pytest.fixture(scope="module", params=[True, False], ids=["stored", "made on the way"])
def words_index(spark, request):
    docs = local_table(spark, [(f"d{i}", "t", w) for i, w in enumerate(WORDS)], "id string, title string, body string")
    base = build_index(docs.where("id <> 'd3'"), work_path(spark, "words"), Layout(2, 3, lexicon=request.param, fields=("title", "body")))
    return upsert_index(base, docs.where("id = 'd3'"))


def clause_table(spark, clauses):
    return local_table(spark, [(i, 1, "should", k, "_all", v, 1.0) for i, (k, v) in enumerate(clauses)], registry.CLAUSE_SCHEMA)


def test_patterns_find_the_terms_of_brute_force(spark, words_index):
    found = expand_patterns(words_index, clause_table(spark, PATTERNS), len(PATTERNS), 1000)
    got = {(r.query_id, r.term) for r in found.collect()}
    want = {(i, t) for i, (k, v) in enumerate(PATTERNS) for t in [*WORDS, "t"] if brute(k, v, t)}
    assert got == want


def test_random_regular_expressions(spark, words_index):
    rng = random.Random(11)
    clauses = []
    while len(clauses) < 150:
        word = rng.choice([w for w in WORDS if w.isalpha()])
        parts = [rng.choice([c, c, c, ".", f"[{c}x]", c + "?", c + "*", c + "+", f"{c}{{1,2}}", ""]) for c in word]
        clauses.append(("regexp", "".join(parts)))
    got = {(r.query_id, r.term) for r in expand_patterns(words_index, clause_table(spark, clauses), 150, 9000).collect()}
    assert got == {(i, t) for i, (k, v) in enumerate(clauses) for t in [*WORDS, "t"] if brute(k, v, t)}


def test_grams_come_from_what_must_be_there(spark):
    df = local_table(spark, [(k, v) for k, v in PATTERNS], "k string, v string")
    got = {(r.k, r.v): set(r.g) for r in df.select("k", "v", pattern_grams(F.col("k"), F.col("v")).alias("g")).collect()}
    assert got["wildcard", "*ation"] == {"ati", "tio", "ion", "on\u0003"}
    assert got["prefix", "nat*"] == {"\u0002na", "nat"}
    assert got["regexp", "nations?"] == {"\u0002na", "nat", "ati", "tio", "ion"}
    assert got["regexp", "(na|ra)tion"] == set() and got["regexp", "[ln]ation"] == {"ati", "tio", "ion", "on\u0003"}
    assert df.select(fixed_parts(F.col("k"), F.col("v"))).count() == len(PATTERNS)


@pytest.mark.parametrize("most", [1, 2, 3])
def test_fuzzy_words_find_the_terms_of_brute_force(spark, words_index, most):
    rng = random.Random(most)
    asked = []
    for _ in range(60):
        w = list(rng.choice(WORDS))
        for _ in range(rng.randint(0, most)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "e", "zz"])
        asked.append(("fuzzy", f"{''.join(w) or 'a'}~{rng.randint(0, most)}"))
    got = {(r.query_id, r.term) for r in expand_fuzzy(words_index, clause_table(spark, asked), 60, "_all", most).collect()}
    within = lambda v, t: brute_distance(t, v.split("~")[0]) <= int(v.split("~")[1])
    assert got == {(i, t) for i, (_, v) in enumerate(asked) for t in [*WORDS, "t"] if within(v, t)}


def test_words_within_n_edits_share_a_deletion(spark):
    """Also where edits lie at and beyond the end of the first characters."""
    rng = random.Random(4)
    pairs = []
    for _ in range(1500):
        a = [rng.choice("abc") for _ in range(rng.randint(1, 12))]
        b = list(a)
        for _ in range(rng.randint(0, 2)):
            at = rng.randrange(len(b) + 1)
            b[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b"])
        if b and brute_distance(a, b) <= 2:
            pairs.append(("".join(a), "".join(b)))
    df = local_table(spark, pairs, "a string, b string")
    met = F.arrays_overlap(deletions(F.col("a"), 2), deletions(F.col("b"), 2))
    assert df.where(~met).isEmpty()


def test_postings_are_not_shuffled_for_patterns(spark, index):
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        for name in ("wildcard_match", "fuzzy_match"):
            clauses = local_table(spark, registry.CLAUSES[name], registry.CLAUSE_SCHEMA)
            text = spark._jvm.PythonSQLUtils.explainString(match_clauses(index, clauses)._jdf.queryExecution(), "simple")
            lines = text.split("\n")
            at = next(i for i, line in enumerate(lines) if "FileScan" in line and "termloom_postings" in line)
            column = re.search(r"[:+*]?- ?FileScan|FileScan", lines[at]).start()
            # Up the tree from the scan to the first sum: the lines that begin left of it, nearest first.
            for line in reversed(lines[:at]):
                start = re.search(r"[A-Z]", line).start() if re.search(r"[A-Z]", line) else 0
                if start < column:
                    column = start
                    assert "Exchange" not in line and "SortMergeJoin" not in line
                    if "HashAggregate(keys=[query_id" in line:
                        break
            else:
                raise AssertionError("no sum above the scan")
            assert scans(plan(match_clauses(index, clauses)), "postings")
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
