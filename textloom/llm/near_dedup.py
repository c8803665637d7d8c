"""MinHash near-duplicate search with tensored banding.

The tables of a locality-sensitive index are keyed by pairs out of two smaller
collections of partial keys: ``side`` left halves and ``side`` right halves of
``half`` minhashes each give ``side**2`` tables of ``2*half`` minhashes, for
``2*side*half`` minhashes computed instead of ``2*half*side**2``. Two documents
of similarity s share a table with probability ``(1-(1-s**half)**side)**2``.

Every pair that decides anything is verified by the exact Jaccard similarity
of the documents' word shingles. Documents whose sets of shingles are equal are
one document from the start, so that thousands of copies cost one signature.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from textloom.llm.common import components, only, settle, small, without
from textloom.llm.text import chunks, distinct, list_array, mix, shingles_of, words_of

#: Members that one task compares with their leader; more are spread over several tasks.
LEADER_SHARE = 4096


def _signer(n: int, side: int, half: int, seed: int):
    count = 2 * side * half
    rng = np.random.default_rng(seed)
    salts = rng.integers(1, 1 << 63, count, dtype=np.uint64)
    odds = rng.integers(1, 1 << 63, count, dtype=np.uint64) | np.uint64(1)
    fold = rng.integers(1, 1 << 63, half, dtype=np.uint64) | np.uint64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                values, offsets = distinct(*shingles_of(words_of(part.column("text")), n))
                full = np.flatnonzero(np.diff(offsets))
                if not len(full):
                    continue
                at = offsets[:-1][full]
                least = np.stack([np.minimum.reduceat((values ^ s) * m, at) for s, m in zip(salts, odds)], 1)
                halves = mix((mix(least).reshape(len(full), 2 * side, half) * fold).sum(2))
                same = mix(np.add.reduceat(mix(values), at))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(full)), pa.array(same.view(np.int64)), list_array(pa.array(halves.ravel().view(np.int64)), np.arange(len(full) + 1) * 2 * side)],
                    names=["doc_id", "same", "halves"],
                )

    return sign


def signatures(docs: DataFrame, n: int, side: int, half: int, seed: int = 1) -> DataFrame:
    """(doc_id, same, halves): a hash of the document's set of shingles, and its ``2*side`` partial keys."""
    return docs.where("doc_id is not null").mapInArrow(_signer(n, side, half, seed), "doc_id bigint, same bigint, halves array<bigint>")


def _verifier(n: int, threshold: float):
    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, own = None, np.zeros(0, np.uint64)
        for batch in batches:
            out: list[tuple[int, int]] = []
            for part in chunks(batch, "text"):
                values, offsets = distinct(*shingles_of(words_of(part.column("text")), n))
                for k, (a, b, salt) in enumerate(zip(*(part.column(c).to_pylist() for c in ("lead", "doc_id", "salt")))):
                    mine = values[offsets[k] : offsets[k + 1]]
                    if a == b:
                        lead, own = (a, salt), mine
                        continue
                    assert lead == (a, salt), "a leader comes before its members"
                    most, least = max(len(own), len(mine)), min(len(own), len(mine))
                    if not least or least < threshold * most:
                        continue
                    at = np.searchsorted(own, mine)
                    at[at == len(own)] = 0
                    both = int((own[at] == mine).sum())
                    if both >= threshold * (len(own) + len(mine) - both):
                        out.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in (0, 1)], names=["a", "b"])

    return verify


def verified(docs: DataFrame, pairs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts' shingles have at least the Jaccard similarity ``threshold``. pairs: settled and distinct.

    Each text travels once for each leader (a) it is compared with; tasks stream
    through the members of a leader and hold one set of shingles.
    """
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / LEADER_SHARE).alias("shares"))
    salted = pairs.join(shares, "a").select("a", "b", F.pmod(F.hash("b"), F.col("shares")).alias("salt"))
    roles = settle(salted.select(F.col("b").alias("doc_id"), F.col("a").alias("lead"), "salt").unionByName(salted.select(F.col("a").alias("doc_id"), F.col("a").alias("lead"), "salt").distinct()))
    texts = docs.join(small(roles), "doc_id")
    rows = texts.select("lead", "salt", "doc_id", "text", (F.col("lead") != F.col("doc_id")).alias("member"))
    sorted_ = rows.repartition("lead", "salt").sortWithinPartitions("lead", "salt", "member")
    return sorted_.select("lead", "salt", "doc_id", "text").mapInArrow(_verifier(n, threshold), "a bigint, b bigint")


def docs_repeat(docs: DataFrame) -> bool:
    """Whether any doc_id stands in more than one row."""
    return bool(docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").limit(1).count())


def near_duplicates(docs: DataFrame, n: int = 3, threshold: float = 0.5, side: int = 12, half: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, duplicate_of): each document that is a near copy, with the least doc_id of its group.

    Groups are the connected components of the verified pairs. In each table,
    all pairs of documents that aren't known to be connected are verified, so
    no bucket is cut short.

    Null or empty texts, and texts without a word, are nobody's copies. Very
    long texts are compared whole. Rows
    with a null doc_id are left out. Rows that share a doc_id are one document,
    whose least text counts. A text of fewer than n words has one shingle.
    Ties don't arise: ids are ordered. An empty table gives an empty result.
    Other columns are ignored, whatever their names.
    """
    docs = only(docs, doc_id=id_column, text=text_column)
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    spark = docs.sparkSession
    source = docs
    if docs_repeat(docs):
        source = docs = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("text").alias("text"))
    signed = settle(signatures(source, n, side, half))
    # smaller sides that a hot group's rows are joined with are pre-aggregated; the group itself is never gathered
    equal = settle(signed.groupBy("same").agg(F.min("doc_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n"))
    copies = settle(signed.select("doc_id", "same").join(small(equal), "same").where("doc_id <> first").select(F.col("first").alias("a"), F.col("doc_id").alias("b")))
    one = signed.join(small(copies.select(F.col("b").alias("doc_id"))), "doc_id", "left_anti")
    left, right = F.slice("halves", 1, side), F.slice("halves", side + 1, side)
    keys = F.flatten(F.transform(left, lambda x, i: F.transform(right, lambda y, j: F.xxhash64(x, y, i * side + j))))
    rows = one.select("doc_id", F.explode(keys).alias("key"))
    met = settle(rows.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").drop("high"))
    members = settle(rows.join(small(met), "key"))
    # first each document with the least of all that it meets, which connects most of what belongs together
    tested = settle(members.groupBy(F.col("doc_id").alias("b")).agg(F.min("low").alias("a")).where("a < b").select("a", "b"))
    links, roots = settle(verified(docs, tested, n, threshold)), None
    for every in (False, True):
        # then, in each bucket, one of each component with the bucket's least; at last all that are still apart
        roots = components(links) if roots is None else roots
        at = members.join(roots, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", F.coalesce("root", "doc_id").alias("root"))
        mixed = settle(at.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").drop("high"))
        apart = settle(at.join(small(mixed), "key"))
        if every:
            # members meet only where a bucket has several components
            other = apart.select("key", F.col("doc_id").alias("doc2"), F.col("root").alias("root2"))
            pairs = apart.join(other, "key").where("doc_id < doc2 and root <> root2").select(F.col("doc_id").alias("a"), F.col("doc2").alias("b"))
        else:
            each = apart.groupBy("key", "root", "low").agg(F.min("doc_id").alias("doc_id"))
            heads = each.where("root = low").select("key", F.col("doc_id").alias("head"))
            pairs = each.where("root <> low").join(heads, "key").select(F.least("doc_id", "head").alias("a"), F.greatest("doc_id", "head").alias("b"))
        fresh = settle(pairs.distinct().join(tested, ["a", "b"], "left_anti"))
        if fresh.isEmpty():
            continue
        # what is connected already goes on as its stars
        stars = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
        links, roots = settle(stars.unionByName(verified(docs, fresh, n, threshold))), None
        tested = tested.unionByName(fresh)
    if roots is not None:
        links = roots.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b"))
    roots = components(links.unionByName(copies))
    return roots.where("node <> root").select(F.col("node").alias(id_column), F.col("root").alias("duplicate_of"))


def drop_near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """docs with one document of each group of near copies, the one with the least doc_id. Rows with a null doc_id stay; of rows that share a doc_id the one with the least text stays."""
    gone = settle(near_duplicates(docs, id_column=id_column, text_column=text_column, **options).select(id_column))
    kept = without(docs, gone, id_column)
    again = settle(docs.where(F.col(id_column).isNotNull()).groupBy(id_column).agg(F.count("*").alias("n")).where("n > 1").select(id_column))
    if again.isEmpty():
        return kept
    order = Window.partitionBy(id_column).orderBy(F.col(text_column).asc_nulls_last(), *(F.col(f"`{c}`").cast("string") for c in docs.columns if c not in (id_column, text_column)))
    mark = "row_of_id"
    while mark in docs.columns:
        mark += "_"
    single = kept.join(small(again), id_column, "left_semi").withColumn(mark, F.row_number().over(order)).where(F.col(mark) == 1).drop(mark)
    return without(kept, again, id_column).unionByName(single)
