"""The query language over rows and over the stored index: both give the same, as known values and the contract say."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.cql import parser as P
from textloom.cql.parser import CQLError, parse
from textloom.database import Database, Registry, Workflow, harvest, join_through, scan_through
from textloom.operators import search as S
from textloom.operators.search import Index, search
from textloom.operators.stored import write_index
from textloom.operators.stores import ResultSetStore

ROWS = [
    (1, "The egg and the spam", "en", 5.0, "2000-01-01", "2000-12-31", 1),
    (2, "spam spam spam egg", "en", 40.0, "2001-01-01", "2001-06-30", 2),
    (3, "eine Wurst and nurses nursing", "de", 7.0, "1999-01-01", "2002-01-01", 3),
    (4, None, None, None, None, None, 4),
    (5, "", "fr", 0.0, None, None, 5),
    (6, "Éclair nurse égg", "fr", 12.0, "2000-06-01", "2000-07-01", 6),
]
INDEXES = {
    "text": Index("text", variants={"stem": "stemmed"}),
    "stemmed": Index("text", stem=True),
    "flat": Index("text", proximity=False),
    "lang": Index("lang", "exact"),
    "size": Index("size", "number"),
    "years": Index("low", "range", high="high"),
}


@pytest.fixture(scope="module")
def docs(spark):
    # columns whose names the search uses itself do no harm
    return spark.createDataFrame(ROWS, "doc_id bigint, text string, lang string, size double, low string, high string, tokens__text bigint").repartition(3)


@pytest.fixture(scope="module")
def stored(docs, tmp_path_factory):
    return write_index(docs, str(tmp_path_factory.mktemp("index")), INDEXES)


QUERIES = {
    'text any "egg spam"': {1, 2},
    'text all "egg spam"': {1, 2},
    'text all "and the"': {1},
    'text = "the spam"': {1},
    'text = "spam spam spam"': {2},
    'text = "egg the"': set(),
    'flat = "spam the"': {1},
    'text any "sp*"': {1, 2},
    'text any "?gg"': {1, 2, 6},
    'text any "*"': {1, 2, 3, 6},
    'text any/stem "nurse"': {3, 6},
    'stemmed all "nursing"': {3, 6},
    "text any nurse": {6},
    'text < "b"': {1, 3},
    'text within "s t"': {1, 2},
    'lang = "en" or lang = "de"': {1, 2, 3},
    'lang any "*r"': {5, 6},
    "size >= 7 and size < 40": {3, 6},
    'size within "4 8"': {1, 3},
    'size <> 5 not lang = "fr"': {2, 3},
    'years encloses "2000-02-01/2000-03-01"': {1, 3},
    'years within "1999-12-31 2001-01-01"': {1, 6},
    'years >=< "2000-06-15 2001-01-01"': {1, 3, 6},
    'years overlaps "2000-06-15 2001-01-01"': {1, 3, 6},
    'years < "2000-05-01 2001-01-01"': {1},
    'years >= "1990-01-01 2000-06-01"': {2, 6},
    "text = egg prox text = and": {1},
    "text = and prox text = egg": set(),
    "text = and prox/distance<=1/unordered text = egg": {1},
    "text = spam prox/distance>2/ordered text = egg": {2},
    "text = spam prox/unit=element/distance=0 text = egg": {1, 2},
    'text window/distance<=2 "egg spam"': {2},
    'text any "egg" not text any "wurst" and lang exact "en"': {1, 2},
    "egg": {1, 2},
}


@pytest.mark.parametrize("query", QUERIES)
def test_rows_of_both_accesses(docs, stored, query):
    assert {r.doc_id for r in stored.search(query).collect()} == QUERIES[query]
    assert {r.doc_id for r in search(docs, query, INDEXES, "text").collect()} == QUERIES[query]


RANKED = ['text any/rel.algorithm=tfidf "egg spam"', 'text all/relevant "egg spam"', 'text any/rel.algorithm=okapi/rel.const0=0.5 "spam spam egg"', 'text any/rel.algorithm=lr "egg spam"', "text any/relevant egg or/rel.combine=sum lang = fr", "text any/relevant egg and/rel.combine=norm text any spam", 'text any/rel.combine=cmbz/relevant "egg spam"', "text any/relevant egg not text any wurst"]


@pytest.mark.parametrize("query", RANKED)
def test_weights_of_both_accesses(docs, stored, query):
    a = {r.doc_id: round(r.weight, 9) for r in stored.search(query).collect()}
    assert a and a == {r.doc_id: round(r.weight, 9) for r in search(docs, query, INDEXES, "text").collect()}


def test_an_empty_operand_of_a_union_leaves_the_other_as_it_is(docs, stored):
    alone = {r.doc_id: r.weight for r in stored.search('text all/rel.algorithm=tfidf "egg"').collect()}
    for query in ('text all/rel.algorithm=tfidf "egg" or text any "zzz"', 'text any/rel.algorithm=tfidf "egg zzz"'):
        for found in (stored.search(query), search(docs, query, INDEXES, "text")):
            assert {r.doc_id: r.weight for r in found.collect()} == pytest.approx(alone)
    half = {r.doc_id: r.weight for r in stored.search('text all/rel.algorithm=tfidf "egg" or lang = "fr"').collect()}
    assert half == pytest.approx({1: alone[1] / 2, 2: alone[2] / 2, 5: 0.25, 6: 0.25})


def test_repeated_terms_are_one_operand(stored):
    once, twice = (stored.search(f'text any/rel.algorithm=okapi "{q}"').collect() for q in ("egg", "egg egg"))
    factor = 2.5 * 2 / (1.5 + 2)
    assert {r.doc_id: r.weight for r in twice} == pytest.approx({r.doc_id: r.weight * factor for r in once})


@pytest.mark.parametrize(
    "query, code",
    [
        ("nowhere any a", 16), ("text encloses a", 24), ("text within a", 24), ('text < "a b"', 24), ("size = big", 36), ("years = 2000", 24), ("text any/nothing a", 20),
        ("text = a prox/unit=sentence text = b", 42), ("text = a prox/distance=abc text = b", 41), ("text = a prox/distance==1 text = b", 40), ("lang = a prox text = b", 39),
        ("text any a and/nothing text any b", 46), ("text any/rel.algorithm=none a", 21), ("text any/rel.combine=none/relevant a", 21), ("text any a sortBy lang/sort.locale=de", 84), ("cql.resultSetId = x", 50),
    ],
)
def test_what_cannot_be_answered_is_named(docs, stored, query, code):
    for ask in (stored.search, lambda q: search(docs, q, INDEXES, "text")):
        with pytest.raises(CQLError) as e:
            ask(query).collect()
        assert e.value.code == code


def test_algorithms_without_a_formula(stored):
    with pytest.raises(NotImplementedError):
        stored.search("text any/rel.algorithm=trec2 a")


SORTED = {
    "size >= 0 sortBy size": [5, 1, 3, 6, 2],
    "size >= 0 sortBy size/sort.descending": [2, 6, 3, 1, 5],
    'text any "egg spam wurst nurse" sortBy years': [3, 1, 6, 2],
    'text any "egg spam wurst nurse" sortBy lang/sort.descending size': [6, 1, 2, 3],
    "size >= 0 sortBy years/sort.missingLow": [5, 3, 1, 6, 2],
    "size >= 0 sortBy years/sort.missingOmit": [3, 1, 6, 2],
    "size >= 0 sortBy years/sort.descending": [3, 2, 1, 6, 5],
    "size >= 0 sortBy years/sort.missingValue=2000-03-01": [3, 1, 5, 6, 2],
    "size >= 5 sortBy text/sort.ignoreAccents": [1, 3, 2, 6],
}


@pytest.mark.parametrize("query", SORTED)
def test_sorting(docs, stored, query):
    assert [r.doc_id for r in stored.search(query).collect()] == SORTED[query] == [r.doc_id for r in search(docs, query, INDEXES, "text").collect()]


def test_missing_values_can_fail(stored):
    with pytest.raises(Exception, match="no value to sort by"):
        stored.search("size >= 0 sortBy years/sort.missingFail").collect()


def test_plans_read_pruned_postings(stored):
    for query in ('text all "egg spam" and lang = en', "size >= 7", 'text any/rel.algorithm=okapi "egg"'):
        plan = stored.search(query)._jdf.queryExecution().toString()
        assert "regexp_extract_all" not in plan
        assert "PushedFilters: []" not in plan.split("== Physical Plan ==")[1] and "PartitionFilters: [" in plan


def test_lookups(stored):
    assert [(r.doc_id, r.occs, r.positions) for r in stored.fetch_term("text", "spam").orderBy("doc_id").collect()] == [(1, 1, [4]), (2, 3, [0, 1, 2])]
    ids = [r.term_id for r in stored.table("terms").orderBy("index_id", "term").collect()]
    assert ids == list(range(len(ids)))
    first = stored.terms("text").orderBy("term").first()
    assert stored.fetch_term_by_id(first.term_id).first().term == first.term == "and"
    assert {(r.term, r.occs) for r in stored.fetch_vector("text", [1]).collect()} == {("the", 2), ("egg", 1), ("and", 1), ("spam", 1)}
    assert {r.term for r in stored.fetch_vector("text", [1], least=2).collect()} == {"the"}
    assert [x.term for x in stored.fetch_prox_vector("text", [1]).first().words] == ["the", "egg", "and", "the", "spam"]
    assert {r.doc_id: r["value__"] for r in stored.fetch_sort_value("text").collect()}[2] == "egg" and {r.doc_id: r["value__"] for r in stored.fetch_sort_value("text", False).collect()}[2] == "spam"
    assert [(r.term, r.rank) for r in stored.frequencies("text", n=2).orderBy("rank").collect()] == [("spam", 1), ("and", 2)]
    assert [r.term for r in stored.frequencies("text", start=1, n=2).orderBy("rank").collect()] == ["and", "egg"]
    assert [(r.term, r.marker) for r in stored.scan("text", "a", ">=", 2).collect()] == [("and", "first"), ("egg", None)]
    assert [(r.term, r.marker) for r in stored.scan("text", "éh", "<=", 2).collect()] == [("égg", "last"), ("éclair", None)]
    assert [r.term for r in stored.scan("text", "nur", "=").collect()] == ["nurse", "nurses", "nursing"]
    facets = stored.facets("text", stored.search("text any spam")).collect()
    assert [(r.term, r.n_recs, r.n_occs) for r in facets] == [("egg", 2, 2), ("spam", 2, 4), ("and", 1, 1), ("the", 1, 2)]
    row = stored.metadata("text").first()
    assert (row.n_terms, row.n_postings, row.n_occurrences) == (11, 14, 17)


def test_feedback_and_similarity(spark, stored):
    pairs = spark.createDataFrame([(1, 2), (1, 3), (2, 2)], "a bigint, b bigint")
    got = {(r.a, r.b): r.similarity for r in stored.similarity("text", pairs).collect()}
    assert got[1, 2] == pytest.approx(4 / (math.sqrt(7) * math.sqrt(10))) and got[2, 2] == pytest.approx(1)
    hits = {r.doc_id: r.weight for r in stored.feedback("text any/rel.algorithm=tfidf wurst").collect()}
    assert {3} <= set(hits) and hits[3] == max(hits.values())
    assert {r.doc_id for r in stored.by_examples("text", [2]).collect()} == {1, 2}


def test_leaving_documents_out_is_indexing_without_them(spark, docs, stored, tmp_path):
    left = stored.without(spark.createDataFrame([(2,), (99,)], "doc_id bigint"), str(tmp_path / "a"))
    fresh = write_index(docs.where("doc_id <> 2"), str(tmp_path / "b"), INDEXES)
    key = lambda i, t: sorted(map(str, i.table(t).select(sorted(i.table(t).columns)).collect()))
    for table in ("postings", "terms", "vectors", "sort_values"):
        assert key(left, table) == key(fresh, table), table
    assert left.stats == fresh.stats


def test_support(docs, tmp_path):
    often = write_index(docs, str(tmp_path), {"text": Index("text")}, min_support=2)
    assert [r.term for r in often.terms("text").orderBy("term_id").collect()] == ["and", "egg", "spam"] and often.search("text any wurst").count() == 0


def test_an_index_of_nothing(spark, docs, tmp_path):
    none = write_index(docs.limit(0), str(tmp_path), INDEXES)
    assert none.search("text any/relevant egg").count() == 0 and none.scan("text", "a").count() == 0


def test_saved_sets_take_part_in_queries(spark, docs, stored, tmp_path):
    sets = ResultSetStore(spark, str(tmp_path))
    sets.save("s1", stored.search("text any spam"))
    for found in (stored.search("cql.resultSetId = s1 and size > 10", sets=sets), search(docs, 'cql.resultSetId = "x/s1" and size > 10', INDEXES, "text", sets=sets)):
        assert [r.doc_id for r in found.collect()] == [2]
    assert stored.search("cql.resultSetId = unknown", sets=sets).count() == 0


def test_masks():
    assert S.first_mask("This is * search term?") == 8 and S.first_mask("This is * search term?", 9) == 21 and S.first_mask("a\\*") == -1
    assert S.mask_pattern("t?e*n") == "^t.e.*n$"


def test_query_builders():
    form = {"fieldcont1": 'spam "eggs and bacon"', "fieldidx1": "cql.anywhere||dc.description"}
    text = P.from_form(form)
    assert text.count("prox") == 7 and parse(text).tree.boolean.name == "or"
    two = parse(P.from_form({"fieldcont1": "a", "fieldcont2": "b c", "fieldrel2": "exact", "fieldbool1": "not"})).tree
    assert two.boolean.name == "not" and two.right.term == "b c"
    assert P.from_attributes({1: 4, 2: 3, 4: 6}) == ("dc.title", "all") and P.from_attributes({1: 31, 2: 4}) == ("dc.date", ">=")
    with pytest.raises(CQLError):
        P.from_attributes({1: 9999})
    xml = P.to_xcql(parse('a any/relevant "x < y" and b = c').tree)
    assert "<term>x &lt; y</term>" in xml and xml.startswith("<triple><boolean><value>and</value></boolean><leftOperand>")
    assert P.result_set_id(parse("cql.resultSetId = s1").tree) == "s1" and P.result_set_id(parse("a and b").tree) == ""


def test_a_database_serves_pages(spark, docs, tmp_path):
    db = Database(spark, str(tmp_path), INDEXES, "text")
    db.add(docs)
    db.commit()
    answer = db.search_retrieve('text any/relevant "egg spam"', 1, 1)
    assert answer["numberOfRecords"] == 2 and answer["nextRecordPosition"] == 2 and answer["records"].count() == 1
    rest = db.search_retrieve(f'cql.resultSetId = "{answer["resultSetId"]}"', 2, 5)
    assert rest["nextRecordPosition"] is None and [r.place for r in rest["records"].collect()] == [2]
    with pytest.raises(CQLError):
        db.search_retrieve("egg", 9)
    assert {round(r.scaled_weight, 6) for r in db.search('text any/rel.algorithm=tfidf "egg spam"').collect()} == {0.0, 1.0}
    assert [r.term for r in db.scan_around("text = spam", 3, 2).collect()] == ["nursing", "spam", "the"]
    assert [r.term for r in db.scan_around("text = spam", 2, 2).collect()] == ["nursing", "spam"] and [r.term for r in db.scan_around("text = spam", 1, 0).collect()] == ["the"]
    assert [r.term for r in db.scan_around("text = spam", 1, 2).collect()] == ["nursing"]
    assert {r.index_id: r.kind for r in db.explain().collect()}["size"] == "number"
    assert {(r.index_id, r.term) for r in db.facets("egg", ["lang"]).collect()} == {("lang", "en")}
    assert db.dereferenced(db.search("lang = de")).first().text.startswith("eine")
    db.remove(spark.createDataFrame([(1,)], "doc_id bigint"))
    assert [r.doc_id for r in db.search("egg").collect()] == [2] and db.records.count() == 5
    db.add(docs.where("doc_id = 1"))
    db.commit()
    assert db.search("egg").count() == 2


def test_searching_through_another_index(spark, stored, tmp_path):
    people = spark.createDataFrame([(10, "Ann Lee", "en"), (11, "Bob", "fr"), (12, "Cy", None)], "doc_id bigint, name string, speaks string")
    remote = write_index(people, str(tmp_path), {"name": Index("name"), "speaks": Index("speaks", "exact")})
    hits = remote.search("name any ann").join(people, "doc_id")
    assert {r.doc_id for r in join_through(stored, "lang", hits, F.col("speaks")).collect()} == {1, 2}
    got = {r.term: r.n_recs for r in scan_through(stored, "lang", remote, "name", people.select("doc_id", "speaks")).collect()}
    assert got == {"ann": 2, "lee": 2, "bob": 2}


def test_workflows_and_registries(spark):
    flow = Workflow("w").step("double", lambda d: d.withColumn("id", F.col("id") * 2)).step("some", lambda d: d.where("id > 2"))
    assert [r.id for r in flow.process(spark.range(3)).collect()] == [4]
    bad = Workflow("b", otherwise=lambda rows, e: rows.limit(1)).step("fails", lambda d: d.select("nothing"))
    assert bad.process(spark.range(3)).count() == 1 and len(flow.fork(spark.range(3), bad)) == 2
    with pytest.raises(Exception):
        Workflow("c").step("fails", lambda d: d.select("nothing")).process(spark.range(1))
    parent = Registry()
    parent.register("a", lambda: object())
    child = Registry(parent)
    child.register("b", dict)
    assert child.get("a") is child.get("a") and child.names() == ["a", "b"]
    with pytest.raises(KeyError):
        child.get("c")
