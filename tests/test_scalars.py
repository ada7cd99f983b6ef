"""Normalisation and keys."""

from __future__ import annotations

import unicodedata

import pytest
from citeweft.functions import scalars as S
from citeweft.functions.udfs import fold, jaro_winkler
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F


def apply(spark, values, f, ddl="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {ddl}")
    return [r.y for r in df.select("i", f(F.col("x")).alias("y")).orderBy("i").collect()]


def test_doi(spark):
    raw = ["10.1000/ABC", "https://doi.org/10.1000/abc", "http://dx.doi.org/10.1000/abc", "doi:10.1000/abc", "  10.1000/abc. ", "\t10.1000/abc;\n", "not-a-doi", None, "", "10.1/abc", "<10.1000/abc>"]
    assert apply(spark, raw, S.normalize_doi) == ["10.1000/abc"] * 6 + [None] * 4 + ["10.1000/abc"]


def test_member_doi_is_looser(spark):
    assert apply(spark, ["10.1/AbC", "DOI:10.1/abc.", "x", None, "https://doi.org/10.5/q.."], S.normalize_member_doi) == ["10.1/abc", "10.1/abc", None, None, "10.5/q"]


def test_title(spark):
    raw = ["Étude: of  Things!", "etude of things", "Erratum: Étude of things", "ERRATUM TO: x", "Straße", None, "標題", "Corrigendum to: Äb"]
    assert apply(spark, raw, S.normalize_title) == ["etude of things", "etude of things", "etude of things", "x", "strasse", "", "", "ab"]


def test_correction_prefix(spark):
    got = apply(spark, [" Erratum: A b", "A b"], S.strip_correction_prefix)
    assert [tuple(x) for x in got] == [("A b", True), ("A b", False)]


def test_year(spark):
    assert apply(spark, ["2020", "2020-05-01", "n/a", None, "1999 reprint 2010", "0999"], S.normalize_year) == [2020, 2020, None, None, 1999, None]


def test_tokens(spark):
    assert apply(spark, ["The a study of X systems", None, "Go go"], S.tokenize) == [["study", "systems"], [], ["go", "go"]]


def test_source_ids(spark):
    assert apply(spark, ["https://openalex.org/w12", "x", None], lambda c: S.normalize_source_id("openalex", c)) == ["W12", None, None]
    assert apply(spark, ["a/b/cc ", ""], lambda c: S.normalize_source_id("s2", c)) == ["cc", None]
    assert apply(spark, ["PMID: 1 2", "none"], lambda c: S.normalize_source_id("pmid", c)) == ["12", None]


def test_identifiers(spark):
    raw = ["10.1000/X", "doi:10.1000/x", "W99", "https://openalex.org/W5", "pmid:77", "123", "s2:abc", "CorpusID:9", "abcdef"]
    want = [("doi", "10.1000/x"), ("doi", "10.1000/x"), ("openalex", "W99"), ("openalex", "W5"), ("pmid", "77"), ("pmid", "123"), ("s2", "abc"), ("s2", "9"), ("s2", "abcdef")]
    assert [tuple(x) for x in apply(spark, raw, S.parse_identifier)] == want


def test_key_precedence(spark):
    df = spark.createDataFrame([("10.1000/a", "W1", "s", "T", 2000, "B"), (None, "W1", "s", "T", 2000, "B"), (None, None, "s", "T", 2000, "B"), (None, None, None, "T", 2000, "B"), (None, None, None, "t.", 2000, "b-")], "d string, o string, s string, t string, y int, n string")
    keys = [r[0] for r in df.select(S.canonical_key(*map(F.col, "dosty"), F.col("n"))).collect()]
    assert keys[:3] == ["doi:10.1000/a", "openalex:W1", "s2:s"] and keys[3] == keys[4] and keys[3].startswith("sig:") and len(keys[3]) == 20


def test_blocks_meet_across_bucket_borders(spark):
    df = spark.createDataFrame([("t", 1995), ("t", 1996), ("t", 1998), ("t", None)], "t string, y int")
    a, b, c, d = (set(r[0]) for r in df.select(S.blocking_keys(F.col("t"), F.col("y"))).collect())
    assert a & b and not a & c and d == {"t|noyear"} and len(b) == 1


def test_same_first_author(spark):
    pairs = [("cook", "amcook"), ("berg", "vandenberg"), ("li", "ali"), ("", ""), ("cook", "cook"), (None, "cook")]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r[0] for r in df.select(S.same_first_author(F.col("a"), F.col("b"))).collect()] == [True, False, False, False, True, False]


def test_inverted_abstract(spark):
    df = spark.createDataFrame([({"b": [1], "a": [0, 2]},), ({},)], "m map<string,array<int>>")
    assert [r[0] for r in df.select(S.inverted_abstract(F.col("m"))).collect()] == ["a b a", None]


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611111), ("dwayne", "duane", 0.84), ("dixon", "dicksonx", 0.8133333), ("", "x", 0.0), ("same", "same", 1.0)])
def test_jaro_winkler(a, b, want):
    assert abs(jaro_winkler(a, b) - want) < 1e-6


def test_fold_and_titles_are_idempotent(spark):
    @given(st.lists(st.text(max_size=20), min_size=30, max_size=60))
    @settings(max_examples=3, deadline=None)
    def run(values):
        once = apply(spark, values, S.normalize_title)
        folded = apply(spark, values, fold)
        assert apply(spark, folded, fold) == [apply_fold(x) for x in folded]
        assert all(set(x) <= set("abcdefghijklmnopqrstuvwxyz0123456789 ") for x in once)

    def apply_fold(x):
        return "".join(c for c in unicodedata.normalize("NFKD", x) if not unicodedata.combining(c)).casefold()

    run()
