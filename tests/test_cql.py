import re

import pytest

from textloom.cql.parser import Clause, CQLError, Triple, parse
from textloom.operators.search import Index, mask_pattern, search


def test_chains_group_from_the_left():
    tree = parse("a or b and c").tree
    assert isinstance(tree, Triple) and tree.boolean.name == "and"
    assert isinstance(tree.left, Triple) and tree.left.boolean.name == "or"


def test_round_trip():
    text = '(cql.anywhere all/cql.stem/rel.algorithm=okapi "spam" and cql.anywhere all "eggs")'
    assert parse(text).to_cql() == text
    assert parse(parse(text).to_cql()).tree == parse(text).tree


def test_bare_terms_and_sort_keys():
    query = parse('"fish and chips" sortBy title/sort.descending date')
    assert query.tree == Clause("cql.serverchoice", query.tree.relation, "fish and chips")
    assert [k.index for k in query.sort] == ["title", "date"]


@pytest.mark.parametrize("text", ["", "(a", "a and", "text any", "a ) b"])
def test_bad_queries(text):
    with pytest.raises(CQLError):
        parse(text)


def test_masks():
    assert re.match(mask_pattern("t?e*n"), "then")
    assert not re.match(mask_pattern("a.b"), "axb")
    assert re.match(mask_pattern("a\\*"), "a*") and not re.match(mask_pattern("a\\*"), "ab")


def test_nulls_and_unsupported_relations(spark):
    docs = spark.createDataFrame([(1, "The egg"), (2, None), (3, "")], "doc_id bigint, text string")
    indexes = {"text": Index("text")}
    assert [r[0] for r in search(docs, 'text any "egg"', indexes, "text").collect()] == [1]
    assert sorted(r[0] for r in search(docs, 'text any "the" or text any "none"', indexes, "text").collect()) == [1]
    with pytest.raises(CQLError):
        search(docs, 'text encloses "a"', indexes, "text")
    with pytest.raises(CQLError):
        search(docs, 'nowhere any "a"', indexes, "text")
