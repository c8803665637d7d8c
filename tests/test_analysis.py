"""Analysis functions on text that the tables don't hold."""

import pytest
from pyspark.sql import functions as F

from textloom.functions import analysis as A
from textloom.operators import index as I


@pytest.mark.parametrize(
    "text, plain",
    [
        ("Ćma Říp Świat Ștefan Șı Việt Ếch", "Cma Rip Swiat Stefan Si Viet Ech"),
        ("Ðæð ©Þþ §ß Œœ", "Daed (c)THth Sectionss OEoe"),
        ("Ǣǽ Ǡ Ǿ", "Ææ Ȧ Ø"),
        ("crème brûlée ÿ", "creme brulee y"),
    ],
)
def test_accents_go_as_in_the_whole_table(spark, text, plain):
    assert spark.range(1).select(A.without_accents(F.lit(text))).first()[0] == plain


def test_the_table_of_accents_has_all_entries():
    assert len(A._ACCENTS) + len(A._SPELT) == 543


def test_pairs_keep_an_odd_last_token(spark):
    for tokens, want in (("a b c", ["a/b", "c/c"]), ("a b", ["a/b"]), ("a", ["a/a"])):
        assert spark.range(1).select(A.pairs_as_ranges(F.split(F.lit(tokens), " "))).first()[0] == want
    assert spark.range(1).select(A.pairs_as_ranges(F.array().cast("array<string>"))).first()[0] == []


def test_similar_rows_are_searched_by_all_terms(spark):
    docs = spark.createDataFrame([(1, " ".join(f"t{i}" for i in range(1500)))], "doc_id bigint, text string")
    terms = spark.createDataFrame([(f"t{i}",) for i in range(1500)], "term string")
    assert [(r["doc_id"], r["n_terms"]) for r in I.similar_to(docs, terms, 5).collect()] == [(1, 1500)]
