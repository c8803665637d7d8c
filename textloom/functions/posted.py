"""Postings and vectors of documents, made in the workers a few megabytes of text at a time.

Each document's words are counted and placed where it lies, so that no shuffle
of words or postings is needed; only rows whose key stands more than once are
brought together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.functions import analysis as A
from textloom.storage import small

#: Text that a worker takes at once.
SLICE_BYTES = 4 << 20
_gaps: dict[str, str] = {}


def gaps(spark: SparkSession) -> str:
    """A pattern of what stands between words, which names every character, so that it is that of A.WORD whichever Unicode the reader knows."""
    at = spark.sparkContext.applicationId
    if at not in _gaps:
        step = 0x1000
        rows = [(start, "".join(chr(c) for c in range(start, start + step) if not 0xD800 <= c < 0xE000)) for start in range(0, 0x110000, step)]
        found = spark.createDataFrame(rows, "start int, chars string").select(F.array_join(F.regexp_extract_all("chars", F.lit(A.WORD), F.lit(0)), "").alias("w")).collect()
        ends: list[list[int]] = []
        for c in sorted(ord(x) for r in found for x in r["w"]):
            if ends and ends[-1][1] == c - 1:
                ends[-1][1] = c
            else:
                ends.append([c, c])
        _gaps[at] = "[^" + "".join(f"\\x{{{low:x}}}-\\x{{{high:x}}}" for low, high in ends) + "]+"
    return _gaps[at]


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """The batch cut where its second column comes to so many bytes; a longer row is one of its own."""
    sizes = batch.column(1)
    sizes = pc.binary_length(sizes) if pa.types.is_string(sizes.type) else pc.multiply(pc.list_value_length(sizes), 8)
    cut = np.cumsum(pc.fill_null(sizes, 0).to_numpy(zero_copy_only=False).astype(np.int64)) // SLICE_BYTES
    ends = [*(np.flatnonzero(cut[1:] != cut[:-1]) + 1), batch.num_rows]
    start = 0
    for end in ends:
        if end > start:
            yield batch.slice(start, end - start)
        start = end


def _counts(text: pa.Array, between: str):
    """(row, term, occs, positions, words): of a column's rows the distinct terms in order, and each row's number of words."""
    lists = pc.split_pattern_regex(text, pattern=between) if pa.types.is_string(text.type) else text
    row, words = pc.list_parent_indices(lists).to_numpy(), pc.list_flatten(lists)
    if pa.types.is_string(text.type):
        real = pc.not_equal(words, "")
        row, words = row[real.to_numpy(zero_copy_only=False)], words.filter(real)
    coded = words.dictionary_encode()
    ordered = pc.sort_indices(coded.dictionary).to_numpy()
    n = max(len(ordered), 1)
    rank = np.empty(n, np.int64)
    rank[ordered] = np.arange(len(ordered))
    code = row.astype(np.int64) * n + rank[coded.indices.to_numpy()]
    order = np.argsort(code, kind="stable")
    code = code[order]
    begins = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.zeros(0, np.int64)
    ends = np.append(begins, len(code)).astype(np.int32)
    places = (np.arange(len(row)) - np.searchsorted(row, np.arange(len(text)))[row])[order].astype(np.int32)
    terms = coded.dictionary.take(pa.array(ordered[code[begins] % n]))
    return code[begins] // n, terms, np.diff(ends), pa.ListArray.from_arrays(pa.array(ends), pa.array(places)), np.bincount(row, minlength=len(text)).astype(np.int32)


def _posted(docs: DataFrame, key: str, words: Column, columns: str, make) -> DataFrame:
    """(key, columns): make of each slice's keys and counts. words: the lower-cased text, or its tokens."""
    between = gaps(docs.sparkSession)

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in it:
            for batch in _slices(whole):
                found = make(batch.column(0), *_counts(batch.column(1), between))
                yield pa.RecordBatch.from_arrays(found, names=names)

    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T.StructType.fromDDL(columns)])
    names = schema.names
    return docs.select(F.col(f"`{key}`").alias(key), words.alias("words__")).mapInArrow(batches, schema)


def _as_rows(keys, row, terms, occs, places, n_words):
    return [keys.take(pa.array(row)), terms, pa.array(occs), places, pa.array(n_words[row])]


def _as_vectors(keys, row, terms, occs, places, n_words):
    held = np.flatnonzero(n_words)
    ends = pa.array(np.append(np.searchsorted(row, held), len(row)).astype(np.int32))
    return [keys.take(pa.array(held)), pa.ListArray.from_arrays(ends, terms), pa.ListArray.from_arrays(ends, pa.array(occs)), pa.array(n_words[held])]


def repeated(docs: DataFrame, key: str) -> DataFrame | None:
    """(key__): the keys of more than one row; None if there are none. Only keys are shuffled."""
    keys = docs.groupBy(key).agg(F.count("*").alias("n__")).where("n__ > 1").select(F.col(key).alias("key__"))
    return None if keys.isEmpty() else small(keys)


def _parted(docs: DataFrame, key: str, keys: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """(rows whose key stands once, rows of repeated keys or None)."""
    if keys is None:
        return docs, None
    same = F.col(key).eqNullSafe(F.col("key__"))
    return docs.join(keys, same, "left_anti"), docs.join(keys, same, "left_semi")


def posted_rows(docs: DataFrame, key: str, words: Column, keys: DataFrame | None) -> DataFrame:
    """(key, term, occs, positions, length), a row for each term of a key; rows of a repeated key are added up. keys: what :func:`repeated` finds."""
    once, more = (None if x is None else _posted(x, key, words, "term string, occs int, positions array<int>, length int", _as_rows) for x in _parted(docs, key, keys))
    if more is None:
        return once
    return once.unionByName(more.groupBy(key, "term").agg(F.sum("occs").cast("int").alias("occs"), F.array_sort(F.flatten(F.collect_list("positions"))).alias("positions"), F.max("length").alias("length")))


def posted_vectors(docs: DataFrame, key: str, words: Column, keys: DataFrame | None) -> DataFrame:
    """(key, terms, occs, words): of each key that has a word its distinct terms in order, how often each stands, and the number of its words."""
    once, more = _parted(docs, key, keys)
    once = _posted(once, key, words, "terms array<string>, occs array<int>, words int", _as_vectors)
    if more is None:
        return once
    each = _posted(more, key, words, "term string, occs int, positions array<int>, length int", _as_rows).groupBy(key, "term").agg(F.sum("occs").cast("int").alias("occs"))
    return once.unionByName(vectors_of(each, key))


def vectors_of(rows: DataFrame, key: str) -> DataFrame:
    """(key, terms, occs, words) out of (key, term, occs), brought together by key."""
    lists = rows.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("term", "occs"))).alias("x"), F.sum("occs").cast("int").alias("words"))
    return lists.select(key, F.col("x.term").alias("terms"), F.col("x.occs").alias("occs"), "words")


def _dots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b, cosine) of (a, b, terms and occs of a, terms and occs of b)."""
    for batch in batches:
        a, b, terms_a, occs_a, terms_b, occs_b = batch.columns
        row = np.concatenate([pc.list_parent_indices(x).to_numpy() for x in (terms_a, terms_b)])
        x, y = (pc.list_flatten(o).to_numpy().astype(np.float64) for o in (occs_a, occs_b))
        coded = pa.concat_arrays([pc.list_flatten(t) for t in (terms_a, terms_b)]).dictionary_encode()
        code = row.astype(np.int64) * max(len(coded.dictionary), 1) + coded.indices.to_numpy()
        order = np.argsort(code, kind="stable")
        code, occs = code[order], np.concatenate([x, y])[order]
        both = np.flatnonzero(code[1:] == code[:-1])
        sums = lambda at, values: np.bincount(at, values, len(a))
        dot = sums(row[order][both], occs[both] * occs[both + 1])
        sizes = np.sqrt(sums(row[: len(x)], x * x)) * np.sqrt(sums(row[len(x) :], y * y))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(dot / sizes)], names=["a", "b", "similarity"])


def cosines(pairs: DataFrame, vectors: DataFrame, key: str) -> DataFrame:
    """(a, b, similarity): the cosine of the vectors (key, terms, occs) of each pair of keys; of a pair that stands repeatedly one row. Whole vectors go to the pairs, once for each end."""
    v = vectors.select(key, "terms", "occs")
    ends = [v.toDF(x, f"terms_{x}", f"occs_{x}") for x in ("a", "b")]
    both = pairs.select("a", "b").distinct().join(ends[0], "a").join(ends[1], "b").select("a", "b", "terms_a", "occs_a", "terms_b", "occs_b")
    schema = T.StructType([*both.select("a", "b").schema, T.StructField("similarity", T.DoubleType())])
    return both.mapInArrow(_dots, schema)
