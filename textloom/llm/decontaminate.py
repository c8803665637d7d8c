"""Benchmark decontamination: containment search by size-partitioned MinHash.

Containment |Q ∩ X| / |Q| of a short item Q in a long document X leaves a
Jaccard similarity near zero, which a MinHash of fixed length can't see. So
documents are partitioned by size, in powers of two, and each partition has
its own number of minhashes: one-permutation MinHash with so many bins that a
bin holds at most ``load`` of the document's shingles. The probability that a
common shingle is the minimum of its bin on both sides then is about
(1-exp(-load))/load whatever the document's length, and the largest load is
taken for which a pair at the threshold shares ``hits`` minima on average, as
far as the smallest item allows it. An item has one sketch for each partition.
One shared minimum makes a candidate; candidates are verified by exact
containment of the word shingles. Items of too few shingles for that many
shared minima are searched by every shingle instead, without a miss.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_BYTES, only, settle, small, without
from textloom.llm.text import Words, chunks, distinct, mix, shingles_of, words_of

_U = np.uint64
_WHOLE = _U(0x5851F42D4C957F2D)
#: Partitions by size: documents of [2**c, 2**(c+1)) distinct shingles.
CLASSES = 40


def _load(least: int, threshold: float, hits: float) -> float:
    load = 2.0
    while load > 0.25 and threshold * least * (1 - math.exp(-load)) / load < hits:
        load /= 2
    return load


def few(threshold: float, hits: float) -> int:
    """Items of fewer shingles can't have so many shared minima, however many bins there are; they are searched by all their shingles."""
    return math.ceil(hits / (threshold * (1 - math.exp(-0.25)) / 0.25))


def _minima(values: np.ndarray, offsets: np.ndarray, classes: np.ndarray, load: float) -> tuple[np.ndarray, np.ndarray]:
    """One-permutation MinHash: for each range of distinct values, keys out of its partition, bin and least value there; and each key's range."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    bins = np.maximum(np.ceil((2.0 ** (classes + 1)) / load), 1).astype(_U)[owner]
    high = mix(values)
    place = ((high >> _U(32)) * bins) >> _U(32) if len(high) else high
    # values are sorted within a range, so the first of a bin after a stable sort is its least
    order = np.lexsort((place, owner))
    owner, place, values = owner[order], place[order], values[order]
    first = np.ones(len(values), bool)
    first[1:] = (owner[1:] != owner[:-1]) | (place[1:] != place[:-1])
    owner, place, values = owner[first], place[first], values[first]
    key = mix(values ^ mix(place + (classes[owner].astype(_U) << _U(48)) + _U(1)))
    return key, owner


def _short(words: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of all runs of ``length`` words, for items of just so many words; and each key's document."""
    values, offsets = shingles_of(words, length)
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    full = np.diff(words.offsets)[owner] >= length
    return mix(values[full] + _U(length)), owner[full]


def _sizes(counts: np.ndarray) -> np.ndarray:
    return np.maximum(np.log2(np.maximum(counts, 1)).astype(np.int64), 0)


def _keys(ids: pa.Array, keys: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([ids.take(pa.array(owner)), pa.array(keys.view(np.int64))], names=["id", "key"])


def _every(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A key of each distinct shingle, and each key's range."""
    return mix(values ^ _WHOLE), np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def _item_sketcher(n: int, load: float, least: int):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                words, ids = words_of(part.column("text")), part.column("id")
                count = np.diff(words.offsets)
                for length in set(count[(count > 0) & (count < n)].tolist()):
                    keys, owner = _short(words, length)
                    same = count[owner] == length
                    yield _keys(ids, keys[same], owner[same])
                values, offsets = distinct(*shingles_of(words, n))
                distinct_n = np.diff(offsets)
                rare = np.flatnonzero((count >= n) & (distinct_n < least))
                if len(rare):
                    keys, owner = _every(values, offsets)
                    some = np.isin(owner, rare)
                    yield _keys(ids, keys[some], owner[some])
                full = np.flatnonzero((count >= n) & (distinct_n >= least))
                own = np.concatenate([np.arange(offsets[k], offsets[k + 1]) for k in full]) if len(full) else np.zeros(0, np.int64)
                ranges = np.concatenate([[0], np.cumsum(np.diff(offsets)[full])])
                for c in range(CLASSES):
                    keys, owner = _minima(values[own], ranges, np.full(len(full), c), load)
                    yield _keys(ids, keys, full[owner])

    return sketch


def _document_sketcher(n: int, load: float, lengths: list[int], every: bool, wanted):
    def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        look = wanted.value if wanted is not None else None

        def known(ids: pa.Array, keys: np.ndarray, owner: np.ndarray) -> pa.RecordBatch:
            if look is not None:
                keep = look[np.minimum(np.searchsorted(look, keys), len(look) - 1)] == keys
                keys, owner = keys[keep], owner[keep]
            return _keys(ids, keys, owner)

        for batch in batches:
            for part in chunks(batch, "text"):
                words, ids = words_of(part.column("text")), part.column("id")
                for length in lengths:
                    yield known(ids, *_short(words, length))
                values, offsets = distinct(*shingles_of(words, n))
                if every:
                    yield known(ids, *_every(values, offsets))
                yield known(ids, *_minima(values, offsets, _sizes(np.diff(offsets)), load))

    return sketch


def _container(n: int, threshold: float):
    def contain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in chunks(batch, "text"):
                docs, items = words_of(part.column("text")), words_of(part.column("item_text"))
                length = np.diff(items.offsets)
                share = np.zeros(len(length))
                for size in set(np.minimum(length, n).tolist()) - {0}:
                    (dv, do), (iv, io) = distinct(*shingles_of(docs, size)), distinct(*shingles_of(items, size))
                    for k in np.flatnonzero(np.minimum(length, n) == size):
                        own = dv[do[k] : do[k + 1]]
                        if docs.offsets[k + 1] - docs.offsets[k] >= size:
                            share[k] = np.isin(iv[io[k] : io[k + 1]], own, assume_unique=True).mean()
                hit = pa.array(np.flatnonzero(share >= threshold))
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(hit), part.column("item_id").take(hit), pa.array(share).take(hit)], names=["doc_id", "item_id", "containment"])

    return contain


def contained_items(docs: DataFrame, items: DataFrame, n: int = 5, threshold: float = 0.5, hits: float = 9.0, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(doc_id, item_id, containment): documents that hold at least ``threshold`` of an item's distinct shingles of n words.

    docs needs doc_id and text, items item_id and text. An item of fewer than
    n words counts as one shingle, all its words in a row. Null or empty texts
    and texts without a word neither hold nor are held; rows with null ids are
    left out. Where several rows share an id, the highest containment counts.
    Pairs exactly at the threshold count. Very long texts are compared whole.
    Items of fewer shingles than ``few(threshold, hits)`` are found without a
    miss; a larger one at the threshold shares ``hits`` minima on average, and is missed with a
    chance of about exp(-hits). Empty tables give an empty
    result. Other columns are ignored, whatever their names.

    ``limit``: bytes of item keys up to which the scan of the documents drops
    keys of no item at once; beyond it all keys are joined in a shuffle.
    """
    spark = docs.sparkSession
    docs = only(docs, id="doc_id", text="text").withColumn("id", F.col("id").cast("bigint")).where("id is not null")
    items = settle(only(items, id="item_id", text="text").withColumn("id", F.col("id").cast("bigint")).where("id is not null and text is not null").distinct())
    least = few(threshold, hits)
    rare = F.col("shingles") < least
    # a row for each short length, one for items of few shingles, and one for all others
    sizes = items.mapInArrow(_item_sizes(n), "words bigint, shingles bigint").groupBy(F.when(F.col("words") < n, F.col("words")).alias("words"), rare.alias("rare")).agg(F.min("shingles").alias("least")).collect()
    lengths = sorted(r["words"] for r in sizes if r["words"])
    every = any(r["rare"] for r in sizes if r["words"] is None)
    load = _load(min((r["least"] for r in sizes if r["words"] is None and not r["rare"]), default=least), threshold, hits)
    keys = settle(items.mapInArrow(_item_sketcher(n, load, least), "id bigint, key bigint").distinct())
    count = keys.count()
    wanted = None
    if count * 8 <= limit:
        near = np.unique(np.array(keys.select("key").distinct().toPandas()["key"], np.int64).view(_U))
        wanted = spark.sparkContext.broadcast(near if len(near) else np.zeros(1, _U))
    sketches = docs.mapInArrow(_document_sketcher(n, load, lengths, every, wanted), "id bigint, key bigint")
    met = sketches.withColumnRenamed("id", "doc_id").join(small(keys.withColumnRenamed("id", "item_id"), limit), "key")
    pairs = settle(met.select("doc_id", "item_id").distinct())
    named = settle(pairs.join(small(items.select(F.col("id").alias("item_id"), F.col("text").alias("item_text")), limit), "item_id"))
    rows = docs.withColumnRenamed("id", "doc_id").join(small(named, limit), "doc_id")
    held = rows.select("doc_id", "item_id", "text", "item_text").mapInArrow(_container(n, threshold), "doc_id bigint, item_id bigint, containment double")
    return held.groupBy("doc_id", "item_id").agg(F.round(F.max("containment"), 6).alias("containment"))


def _item_sizes(n: int):
    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = words_of(batch.column("text"))
            offsets = distinct(*shingles_of(words, n))[1]
            yield pa.RecordBatch.from_arrays([pa.array(np.diff(words.offsets)), pa.array(np.diff(offsets))], names=["words", "shingles"])

    return sizes


def drop_contaminated(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """docs without the documents that hold an item. Rows with a null doc_id stay."""
    gone = settle(contained_items(docs, items, **options).select("doc_id").distinct())
    return without(docs, gone, "doc_id")
