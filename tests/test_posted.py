"""Postings and vectors that are made where the documents lie: against brute force, and what building an index shuffles."""

import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from textloom.functions import analysis as A
from textloom.functions import posted
from textloom.operators import index as I
from textloom.operators import stored as S
from textloom.operators.search import Index

TEXTS = [(1, "The egg  and THE spam"), (1, "egg egg\n"), (2, None), (3, ""), (4, "ǅ² İstanbul ét 𝔸𝕓 ½x٣ ⅷ_a ß­z 你好 \U00016e40\U00010d40"), (None, "a b"), (None, "b"), (5, "... -- "), (6, "egg")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(TEXTS, "doc_id bigint, text string").repartition(3)


def expected(docs):
    """{(key, term): places} by the tokens that scans see."""
    found = {}
    for r in docs.select("doc_id", F.coalesce(A.words("text"), F.array().cast("array<string>")).alias("t")).collect():
        for i, t in enumerate(r.t):
            found.setdefault((r.doc_id, t), []).append(i)
    return {k: sorted(v) for k, v in found.items()}


def test_postings_of_odd_texts_and_repeated_keys(docs):
    assert {(r.doc_id, r.term): r.positions for r in I.postings(docs).collect()} == expected(docs)
    rows = I.postings(docs).collect()
    assert len({(r.doc_id, r.term) for r in rows}) == len(rows) and all(r.occs == len(r.positions) for r in rows)


def test_long_and_many_texts_are_cut_into_slices(docs, monkeypatch):
    monkeypatch.setattr(posted, "SLICE_BYTES", 8)
    batches = [b for r in docs.where("text is not null").repartition(1).select("doc_id", F.lower("text").alias("x")).toArrow().to_batches() for b in posted._slices(r)]
    assert len(batches) > 3 and sum(b.num_rows for b in batches) == 8


def test_postings_shuffle_nothing(docs):
    plan = I.postings(docs.where("doc_id > 1"))._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(term" not in plan and "Aggregate" not in plan


class Shuffled:
    """Bytes that a session has shuffled since."""

    def __init__(self, spark):
        self.sc = spark.sparkContext._jsc.sc()
        self.start = self.now()

    def now(self) -> int:
        self.sc.listenerBus().waitUntilEmpty()
        return sum(self.sc.statusStore().executorList(False).apply(i).totalShuffleWrite() for i in range(self.sc.statusStore().executorList(False).size()))

    def since(self) -> int:
        return self.now() - self.start


@pytest.fixture(scope="module")
def many(spark, tmp_path_factory):
    """Documents of words that each stand in one or two of them, in a table of files."""
    rng = random.Random(5)
    rows = [(i, " ".join(f"{rng.randrange(10**6):06d}" for _ in range(400)), "en") for i in range(600)]
    path = str(tmp_path_factory.mktemp("many"))
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(4).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


INDEXES = {"text": Index("text"), "lang": Index("lang", "exact")}


@pytest.fixture(scope="module")
def built(spark, many, tmp_path_factory):
    segments, S.SEGMENT_BYTES = S.SEGMENT_BYTES, 400_000
    count = Shuffled(spark)
    index = S.write_index(many, str(tmp_path_factory.mktemp("built")), INDEXES)
    S.SEGMENT_BYTES = segments
    return index, count.since()


def test_building_shuffles_texts_not_postings(many, built):
    """Twice the texts, and the terms, of which there are as many as words here."""
    text = many.agg(F.sum(F.octet_length("text"))).first()[0]
    assert built[1] < 5 * text


def test_segments_hold_whole_documents_in_order_of_terms(many, built):
    rows = built[0].postings("text").select("doc_id", "term", "positions", F.input_file_name().alias("file")).collect()
    files = {}
    for r in rows:
        files.setdefault(r.doc_id, set()).add(r.file)
    assert len({f for x in files.values() for f in x}) > 3 and all(len(x) == 1 for x in files.values())
    assert {(r.doc_id, r.term): r.positions for r in rows} == expected(many)


def test_repeated_and_null_keys_in_a_stored_index(spark, docs, tmp_path):
    index = S.write_index(docs, str(tmp_path), {"text": Index("text")})
    want = {k: v for k, v in expected(docs).items() if k[0] is not None}
    assert {(r.doc_id, r.term): r.positions for r in index.postings("text").collect()} == want
    assert {(r.doc_id, r.term): r.occs for r in index.table("vectors").collect()} == {k: len(v) for k, v in want.items()}
    assert index.stats == {"n_docs": 7, "words text": sum(map(len, want.values()))}


def test_cosines_of_repeated_pairs_and_no_join_by_term(spark, many, built):
    bags = {r.doc_id: Counter(re.findall(r"\d+", r.text)) for r in many.collect()}
    pairs = [(a, b) for a in range(0, 600, 60) for b in (a, a + 1, 599 - a)] * 2
    cosine = lambda x, y: sum(n * y[t] for t, n in x.items()) / math.sqrt(sum(n * n for n in x.values())) / math.sqrt(sum(n * n for n in y.values()))
    rows = built[0].similarity("text", spark.createDataFrame(pairs, "a bigint, b bigint")).collect()
    assert len(rows) == len(set(pairs))
    assert {(r.a, r.b): r.similarity for r in rows} == pytest.approx({(a, b): cosine(bags[a], bags[b]) for a, b in pairs})


def test_leaving_out_rewrites_files_without_a_shuffle_of_postings(spark, many, built, tmp_path):
    text = many.agg(F.sum(F.octet_length("text"))).first()[0]
    count = Shuffled(spark)
    left = built[0].without(many.where("doc_id % 10 = 3").select("doc_id"), str(tmp_path))
    assert count.since() < 3.5 * text
    assert {(r.doc_id, r.term): r.positions for r in left.postings("text").collect()} == {k: v for k, v in expected(many).items() if k[0] % 10 != 3}
