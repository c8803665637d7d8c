"""Stores, set algebra, graphs and mining."""

import math
import time

import pytest
from pyspark.sql import functions as F

from textloom.operators import graph as G
from textloom.operators import mining as M
from textloom.operators import stores as S
from textloom.database import harvest
from textloom.storage import placed


def test_records_are_stored_fetched_and_deleted(spark, tmp_path):
    store = S.Store(spark, str(tmp_path))
    assert store.current().count() == 0 and store.summary().first().total_items == 0
    rows = spark.createDataFrame([("a", "one two"), ("b", "three"), ("c", None)], "id string, data string")
    assert store.store(rows).count() == 3
    with pytest.raises(S.DuplicateError):
        store.store(spark.createDataFrame([("d", "three")], "id string, data string"))
    assert store.store(spark.createDataFrame([("d", "three"), ("e", "new")], "id string, data string"), "skip").count() == 1
    row = store.fetch(spark.createDataFrame([("a",), ("zz",)], "id string")).orderBy("id").collect()
    assert (row[0].word_count, row[0].byte_count, row[0].deleted_at, row[1].data) == (2, 7, None, None) and len(row[0].digest) == 40
    summary = store.summary().first()
    assert (summary.total_items, summary.total_words, summary.min_words, summary.max_words, summary.mean_words) == (4, 4, 1, 2, 1)
    store.delete(spark.createDataFrame([("b",)], "id string"))
    gone = store.fetch(spark.createDataFrame([("b",)], "id string")).first()
    assert gone.data is None and gone.deleted_at is not None and store.current().count() == 3
    store.clean()
    assert store.data.count() == 3 and store.store(spark.createDataFrame([("b", "three")], "id string, data string")).count() == 1
    assert store.current().count() == 4
    assert store.chunks(2).select("chunk").distinct().count() <= 2 and store.chunks(1000, "bytes").count() == 4
    page = harvest(store, size=2).collect()
    assert [r.id for r in page] == ["a", "b"] and [r.id for r in harvest(store, after="b").collect()] == ["c", "e"]
    assert harvest(store, since="2999-01-01").count() == 0
    store.delete(spark.createDataFrame([("e",)], "id string"))
    assert [(r.id, r.deleted) for r in harvest(store, after="c").collect()] == [("e", True)]
    assert store.metadata(spark.createDataFrame([("a",)], "id string"), "word_count").first().word_count == 2


def test_ids_and_expiry(spark, tmp_path):
    dense = S.Store(spark, str(tmp_path / "dense"))
    dense.store(spark.createDataFrame([("y",), ("x",)], "data string"), dense_ids=True)
    dense.store(spark.createDataFrame([("z",)], "data string"), dense_ids=True)
    assert sorted((r.id, r.data) for r in dense.current().collect()) == [("0", "x"), ("1", "y"), ("2", "z")]
    dense.store(spark.createDataFrame([("w",)], "data string"))
    brief = S.Store(spark, str(tmp_path / "brief"), ttl="1 second")
    brief.store(spark.createDataFrame([("1", "x")], "id string, data string"))
    time.sleep(1.2)
    assert brief.current().count() == 0
    brief.clean()
    assert brief.data.count() == 0


def test_pointers_into_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("spam and eggs")
    store = S.Store(spark, str(tmp_path / "s"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "f.txt")).select("path", "content")
    path = files.first().path
    store.store(spark.createDataFrame([("p", f'{{"path": "{path}", "offset": 9, "length": 4}}')], "id string, data string"))
    assert store.pointers(files).first().data == "eggs"


def test_settings_and_queries(spark, tmp_path):
    queries = S.QueryStore(spark, str(tmp_path))
    queries.save("q", "a or b", "s1")
    queries.save("q", "a and b", "s2")
    assert queries.fetch("q") == {"query": '(cql.serverchoice = "a" and cql.serverchoice = "b")', "result_set": "s2"} and queries.fetch("none") is None


def test_result_sets(spark, tmp_path):
    sets = S.ResultSetStore(spark, str(tmp_path))
    hits = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.5)], "doc_id bigint, weight double")
    sets.save("a", hits)
    assert [(r.place, r.doc_id) for r in sets.fetch("a").orderBy("place").collect()] == [(1, 2), (2, 3), (3, 1)]
    assert [r.doc_id for r in sets.page("a", 2, 1).collect()] == [3] and sets.fetch("nothing").count() == 0
    sets.save("b", hits.drop("weight"), ttl_seconds=1)
    assert {r.weight for r in sets.fetch("b").collect()} == {0.5}
    time.sleep(1.2)
    assert sets.fetch("b").count() == 0
    with pytest.raises(Exception):
        sets.save("a", hits, overwrite=False)
    sets.delete("a")
    assert sets.fetch("a").count() == 0
    items = S.serialized(hits.withColumn("occs", F.lit(2)))
    back = S.deserialized(items).orderBy("doc_id").collect()
    assert [(r.doc_id, r.weight, r.occs, r.record_store) for r in back] == [(1, 0.5, 2, "recordStore"), (2, 0.9, 2, "recordStore"), (3, 0.5, 2, "recordStore")]


def test_set_algebra(spark):
    # r1 and r2 are one item, in two sets; r4 lies in another store
    schema = "id bigint, store string, occs bigint, weight double"
    n, df = 100, 2
    tfidf = lambda occs: occs * math.log(n / df)
    a = spark.createDataFrame([(0, "recordStore", 5, tfidf(5)), (1, "recordStore", 1, tfidf(1))], schema)
    b = spark.createDataFrame([(0, "recordStore", 3, tfidf(3)), (0, "recordStore2", 2, tfidf(2))], schema)
    keys = ["id", "store"]
    assert tfidf(5) == pytest.approx(19.560115) and tfidf(3) == pytest.approx(11.736069)
    both = S.combined([a, b], "all", keys).collect()
    assert [(r.id, r.store) for r in both] == [(0, "recordStore")] and both[0].weight == pytest.approx(15.648092)
    assert S.combined([a, b], "and", keys, "sum").first().weight == pytest.approx(31.296184)
    assert S.combined([a, b], "any", keys).count() == 3 and S.combined([a, b], "any", keys, "cmbz").agg(F.max("weight")).first()[0] == pytest.approx(62.592368)
    assert [(r.id, r.store, r.weight) for r in S.combined([a, b], "not", keys).collect()] == [(1, "recordStore", pytest.approx(tfidf(1) / 2))]
    alone = S.combined([a, b.limit(0)], "or", keys).collect()
    assert {r.id: r.weight for r in alone} == pytest.approx({0: tfidf(5), 1: tfidf(1)})
    assert S.combined([a, b.limit(0)], "all", keys).count() == 0
    top = {(r.id, r.store): r.weight for r in S.favoured(a, b, keys, top=1).collect()}
    assert top[0, "recordStore"] == pytest.approx(tfidf(5)) and top[1, "recordStore"] == pytest.approx(tfidf(1) / 2)
    parts = spark.createDataFrame([("c", "p", 1.0, 0.5), ("d", None, 1.0, None)], "component string, parent string, weight double, parent_weight double")
    assert [r.weight for r in S.with_parents(parts).collect()] == [0.75, 0.5]


def test_weights_of_single_terms(spark):
    from textloom.operators.search import bm25, cori

    one = lambda w, tf: spark.range(1).select(w(F.lit(tf), F.lit(2), F.lit(100), length=F.lit(100), mean=F.lit(100))).first()[0]
    assert [one(cori, tf) for tf in (5, 1, 3, 2)] == pytest.approx([0.412421, 0.402534, 0.407526, 0.405042], abs=1e-6)
    assert [one(bm25, tf) for tf in (5, 1, 3, 2)] == pytest.approx([7.523121, 3.912023, 6.520038, 5.588604], abs=1e-6)


def test_postings_merge(spark):
    schema = "term string, doc_id bigint, occs bigint"
    now, new = spark.createDataFrame([("a", 1, 2), ("b", 1, 1)], schema), spark.createDataFrame([("a", 1, 3), ("a", 2, 1)], schema)
    got = lambda how: sorted(tuple(r) for r in S.merge_postings(now, new, how, ["term", "doc_id"]).collect())
    assert got("add") == [("a", 1, 5), ("a", 2, 1), ("b", 1, 1)] and got("replace") == [("a", 1, 3), ("a", 2, 1), ("b", 1, 1)] and got("delete") == [("b", 1, 1)]


def test_bitmaps(spark):
    rows = spark.createDataFrame([("a", i) for i in (0, 5, 40_000)] + [("b", i) for i in (5, 7)], "term string, id bigint")
    maps = S.bitmaps(rows, "term", "id")
    assert {r.term: r.n for r in S.bitmap_counts(maps).collect()} == {"a": 3, "b": 2}
    count = lambda m: m.agg(F.sum(F.bitmap_count("bits"))).first()[0]
    assert count(S.bitmap_union(maps, ["a", "b"])) == 4 and count(S.bitmap_intersection(maps, ["a", "b"])) == 1


def test_places(spark):
    rows = spark.range(1000).withColumn("x", F.col("id") % 7).repartition(6)
    got = placed(rows, "x", F.desc("id")).collect()
    assert [r.place for r in sorted(got, key=lambda r: (r.x, -r.id))] == list(range(1, 1001))


def test_graphs(spark):
    lines = spark.createDataFrame([('<a> <knows> <b> .',), ('<b> <knows> <c> . # so',), ('<c> <name> "Cy \\"q\\""@en .',), ('_:x <knows> _:y .',), ('<z> <name> "Z"^^<t> .',), ("# nothing",), (None,)], "value string")
    graph = G.triples(lines)
    assert graph.count() == 5
    found = G.matches(graph, [("?p", "<knows>", "?q"), ("?q", "<knows>", "?r"), ("?r", "<name>", "?n")], ["p", "n"]).withColumn("n", G.literal("n"))
    assert [(r.p, r.n) for r in found.collect()] == [("<a>", 'Cy \\"q\\"')]
    with pytest.raises(ValueError):
        G.matches(graph, [("?p", "<knows>", "?q"), ("?r", "<name>", "?n")], ["p"])
    parts = {r.node: r.component for r in G.components(graph).collect()}
    assert parts == {"<a>": "<a>", "<b>": "<a>", "<c>": "<a>", "_:x": "_:x", "_:y": "_:x", "<z>": "<z>"}
    assert G.triples(G.lines(graph).withColumnRenamed("line", "value")).exceptAll(graph).count() == 0
    assert "knows" in {r.s: r.record for r in G.subjects(graph).collect()}["<a>"]


def test_baskets(spark):
    words = spark.createDataFrame([(1, i, w) for i, w in enumerate("a b x c d x a".split())], "doc_id int, word int, term string")
    assert sorted((r.basket, r["items"]) for r in M.split_baskets(words, "doc_id", ["x"]).collect()) == [(0, ["a", "b"]), (1, ["c", "d"]), (2, ["a"])]
    got = {r.basket: r["items"] for r in M.window_baskets(words, "doc_id", 3, 2).collect()}
    assert got == {0: ["a", "b", "x"], 1: ["c", "d", "x"], 2: ["a", "d", "x"], 3: ["a"]}
    assert set(r.basket for r in M.window_baskets(words, "doc_id", 3, 2, around=["c"]).collect()) == {1}


def test_rankings_of_itemsets(spark):
    sets = spark.createDataFrame([(["a", "b"], 30), (["a", "c"], 2)], "items array<string>, support bigint")
    items = spark.createDataFrame([("a", 50), ("b", 40), ("c", 10)], "item string, n bigint")
    got = {tuple(r["items"]): r for r in M.itemset_rankings(sets, items, 100).collect()}
    r = got["a", "b"]
    expected, mean = 20.0, 25.0
    assert r.log_likelihood == pytest.approx(2 * (expected * math.log10(expected / mean) + 30 * math.log10(30 / mean)))
    assert r.surprise == pytest.approx(100 / 20 * 30) and r.entropy == pytest.approx(-0.5 * math.log2(0.5) - 0.4 * math.log2(0.4)) and r.gini == pytest.approx(1 - 0.25 - 0.16)
    assert (r.length, r.total_freq) == (2, 90) and got["a", "c"].log_likelihood < 0


def test_itemsets_of_any_size_and_their_support(spark):
    rows = spark.createDataFrame([(b, i) for b in range(10) for i in (["a", "b", "c"] if b < 6 else ["a"])], "b int, i string")
    sets, rules = M.frequent_itemsets(rows, "b", "i", 0.5, 0.9)
    assert {tuple(sorted(r["items"])): r.freq for r in sets.collect()} == {("a",): 10, ("b",): 6, ("c",): 6, ("a", "b"): 6, ("a", "c"): 6, ("b", "c"): 6, ("a", "b", "c"): 6}
    assert rules.where("size(antecedent) = 1").count() >= 2
    support, sets, _ = M.supports_for(rows, "b", "i", 4)
    assert 0.55 < support <= 0.6 and sets.where("size(items) > 1").count() == 4


def test_vectors_for_learners(spark):
    vectors = spark.createDataFrame([(1, "a", 2), (1, "c", 1), (2, "c", 5), (2, "d", 1)], "doc_id bigint, term string, occs bigint")
    terms = spark.createDataFrame([("a", 1, 2), ("c", 2, 6), ("d", 1, 1)], "term string, n_recs bigint, n_occs bigint")
    assert M.limited_vectors(vectors, "doc_id", terms, recs=(2, None)).count() == 2 and M.limited_vectors(vectors, "doc_id", terms, local=(None, 1)).count() == 2
    assert sorted(r.term for r in M.limited_vectors(vectors, "doc_id", terms, top=1).collect()) == ["a", "c"]
    numbered, table = M.renumbered(vectors, "term")
    assert {r.term: r.number for r in table.collect()} == {"a": 1, "c": 2, "d": 3}
    labels = spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, label int")
    assert sorted(r.line for r in M.libsvm_lines(numbered, "doc_id", labels).collect()) == ["0 1:2 2:1", "1 2:5 3:1"]
    assert sorted(r.line for r in M.transactions(numbered, "doc_id").collect()) == ["1 2", "2 3"]
    assert numbered.drop("term").join(table, "number").select("doc_id", "term", "occs").exceptAll(vectors).count() == 0


@pytest.mark.parametrize("method", ["bayes", "svm", "perceptron", "network"])
def test_classifiers_learn(spark, method):
    docs = spark.createDataFrame([(i, ("good fine nice " if i % 2 else "bad poor awful ") + f"w{i % 5}") for i in range(60)], "doc_id bigint, text string")
    labels = docs.where("doc_id < 40").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("y"))
    got = {r.doc_id: r.prediction for r in M.classified(docs, labels, "y", method, n_features=64).collect()}
    assert sum(got[i] == i % 2 for i in range(40, 60)) >= 19
