"""The stored index: postings, terms, vectors and sort values as Parquet, and search that reads only what a query names.

Postings lie in a folder for each index, in segments of some megabytes of
text. A segment has whole documents and is ordered by term, so that a term's
rows are found by the files' own statistics; each carries its document's
length, so that ranking needs no join. Building shuffles the texts, never the
postings. A document's vector is one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.cql.parser import CQLError, Query, parse
from textloom.functions import analysis as A
from textloom.functions.posted import cosines, posted_rows, posted_vectors, repeated, vectors_of
from textloom.operators.search import Index, is_masked, mask_test, run, sorted_by, tokens_of
from textloom.storage import fits, placed, shared_dir

#: Bytes of text, and rows of other columns, that a segment of postings is made of.
SEGMENT_BYTES, SEGMENT_ROWS = 16 << 20, 1 << 20


def _words(index: Index) -> Column:
    """A words index's lower-cased text, or its tokens where they are stems."""
    return tokens_of(index) if index.stem else F.lower(F.col(f"`{index.column}`"))


def _folder(path: str, table: str, name: str) -> str:
    """The folder of an index in a table, named as Spark names partitions."""
    return f"{path}/{table}/index_id=" + re.sub(r"[\x00-\x1f\x7f\"#%'*/:=?\\{\[\]^]", lambda m: f"%{ord(m[0]):02X}", name)


def _postings(docs: DataFrame, index: Index, key: str, keys: DataFrame | None) -> DataFrame:
    """(term, number, high, key, occs, positions, length) of one index."""
    none = F.lit(None)
    if index.kind == "words":
        found = posted_rows(docs, key, _words(index), keys)
        return found.select("term", none.cast("double").alias("number"), none.cast("string").alias("high"), key, "occs", "positions", "length")
    value = F.col(f"`{index.column}`")
    found = docs.where(value.isNotNull())
    term = none.cast("string") if index.kind == "number" else value.cast("string")
    number = value.cast("double") if index.kind == "number" else none.cast("double")
    high = F.col(f"`{index.high}`").cast("string") if index.kind == "range" else none.cast("string")
    places = F.array(F.lit(0))
    return found.select(term.alias("term"), number.alias("number"), high.alias("high"), F.col(f"`{key}`").alias(key), F.lit(1).alias("occs"), places.alias("positions"), F.lit(1).alias("length"))


def _sort_values(rows: DataFrame, key: str) -> DataFrame:
    """(key, low, high, number): the ends of each key's values."""
    return rows.groupBy(key).agg(F.min("term").alias("low"), F.max(F.coalesce("high", "term")).alias("high"), F.min("number").alias("number"))


def _counted(rows: DataFrame) -> DataFrame:
    """(index_id, term, n_recs, n_occs) of (index_id, term, occs)."""
    return rows.where("term is not null").groupBy("index_id", "term").agg(F.count("*").alias("n_recs"), F.sum("occs").alias("n_occs"))


def _write_terms(terms: DataFrame, path: str) -> None:
    """Terms, numbered in order of index and term."""
    placed(terms, "index_id", "term", name="term_id").withColumn("term_id", F.col("term_id") - 1).sortWithinPartitions("index_id", "term").write.mode("overwrite").parquet(f"{path}/terms")


def write_index(docs: DataFrame, path: str, indexes: dict[str, Index], key: str = "doc_id", min_support: int = 1) -> StoredIndex:
    """Index docs into the tables under path and open them.

    Rows with a null key aren't indexed. ``min_support``: terms of words indexes
    in fewer documents are left out, and get no term_id.
    """
    docs = docs.where(F.col(f"`{key}`").isNotNull())
    opened = lambda: StoredIndex(docs.sparkSession, path, indexes, key, dict(docs.dtypes)[key])  # noqa: E731; its tables list the files that there are
    columns = {x.column for x in indexes.values() if x.kind == "words"}
    bytes_of = [F.coalesce(F.sum(F.octet_length(F.col(f"`{c}`").cast("string")).cast("bigint")), F.lit(0)).alias(f"bytes {c}") for c in columns]
    counted = [F.count(F.col(f"`{x.column}`")).alias(f"words {n}") for n, x in indexes.items() if x.kind != "words"]
    sizes = docs.agg(F.count("*").alias("n_docs"), *bytes_of, *counted).first().asDict()
    keys = repeated(docs, key)
    for name, x in indexes.items():
        words = x.kind == "words"
        n = 1 + (sizes[f"bytes {x.column}"] // SEGMENT_BYTES if words else sizes["n_docs"] // SEGMENT_ROWS)
        own = docs.select(*(F.col(f"`{c}`") for c in dict.fromkeys((key, x.column, x.high)) if c)).repartition(n, F.col(f"`{key}`"))
        rows = _postings(own, x, key, keys)
        if min_support > 1:
            often = rows.groupBy("term").agg(F.count("*").alias("n")).where(F.col("n") >= min_support).drop("n")
            rows = rows.join(often, "term", "left_semi").unionByName(rows.where("term is null")).select(rows.columns)
        rows.sortWithinPartitions("term", "number", key).write.mode("overwrite").parquet(_folder(path, "postings", name))
        if words:
            vectors = posted_vectors(own, key, _words(x), keys) if min_support <= 1 else vectors_of(opened().postings(name), key)
            vectors.sortWithinPartitions(key).write.mode("overwrite").parquet(_folder(path, "vectors", name))
            vectors = opened().vectors(name)
            values = vectors.select(key, F.element_at("terms", 1).alias("low"), F.element_at("terms", -1).alias("high"), F.lit(None).cast("double").alias("number"))
            counts = vectors.agg(F.sum("words")) if min_support <= 1 else own.agg(F.sum(F.size(tokens_of(x)).cast("bigint")))
            sizes[f"words {name}"] = counts.first()[0] or 0
        else:
            values = _sort_values(rows, key)
        values.sortWithinPartitions(key).write.mode("overwrite").parquet(_folder(path, "sort_values", name))
    index = opened()
    _write_terms(_counted(index.table("postings")), path)
    index._write_stats({"n_docs": sizes["n_docs"]} | {f"words {n}": sizes[f"words {n}"] for n in indexes})
    return index


@dataclass
class StoredIndex:
    """The tables of an index: postings, terms (with dense term_id in order of index and term), stats, sort_values and vectors (a row for each document)."""

    spark: SparkSession
    path: str
    indexes: dict[str, Index]
    key: str = "doc_id"
    kind: str = "bigint"

    def __post_init__(self):
        self._tables: dict[str, DataFrame] = {}
        self._stats: dict[str, int] | None = None

    def table(self, name: str) -> DataFrame:
        if name not in self._tables:
            schema = {
                "postings": f"term string, number double, high string, {self.key} {self.kind}, occs int, positions array<int>, length int, index_id string",
                "terms": "index_id string, term string, n_recs bigint, n_occs bigint, term_id bigint",
                "sort_values": f"{self.key} {self.kind}, low string, high string, number double, index_id string",
                "vectors": f"{self.key} {self.kind}, terms array<string>, occs array<int>, words int, index_id string",
                "stats": "n_docs bigint, " + ", ".join(f"`words {n}` bigint" for n in self.indexes),
            }[name]  # tables without a row have no file that tells it
            if name == "vectors" and not any(x.kind == "words" for x in self.indexes.values()):
                rows = self.spark.createDataFrame([], schema)
            else:
                rows = self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
            if name == "vectors":  # a row for each term
                self._vectors = rows
                rows = rows.select("index_id", self.key, F.inline(F.arrays_zip(F.col("terms").alias("term"), "occs")).alias("term", "occs"))
            self._tables[name] = rows
        return self._tables[name]

    def _write_stats(self, row: dict[str, int]) -> None:
        self.spark.createDataFrame([tuple(row.values())], ", ".join(f"`{c}` bigint" for c in row)).write.mode("overwrite").parquet(f"{self.path}/stats")

    @property
    def stats(self) -> dict[str, int]:
        """n_docs, and the words of each index: one row."""
        if self._stats is None:
            self._stats = self.table("stats").first().asDict()
        return self._stats

    def postings(self, name: str) -> DataFrame:
        return self.table("postings").where(F.col("index_id") == name)

    def vectors(self, name: str) -> DataFrame:
        """(key, terms, occs, words): each document's distinct terms in order, and its number of words."""
        self.table("vectors")
        return self._vectors.where(F.col("index_id") == name).drop("index_id")

    def terms(self, name: str) -> DataFrame:
        return self.table("terms").where(F.col("index_id") == name)

    # lookups

    def fetch_term(self, name: str, term: str) -> DataFrame:
        return self.postings(name).where(F.col("term") == term).select("term", self.key, "occs", "positions")

    def fetch_term_by_id(self, term_id: int) -> DataFrame:
        return self.table("terms").where(F.col("term_id") == term_id)

    def fetch_vector(self, name: str, ids: list, least: int = 0, most: int | None = None) -> DataFrame:
        """(key, term_id, term, occs) of some documents, in order of term_id; least, most: bounds of a term's occurrences in the document."""
        rows = self.table("vectors").where((F.col("index_id") == name) & F.col(self.key).isin(ids) & (F.col("occs") >= least))
        rows = rows if most is None else rows.where(F.col("occs") <= most)
        return rows.join(self.terms(name).select("term", "term_id"), "term").select(self.key, "term_id", "term", "occs").orderBy("term_id", self.key)

    def fetch_prox_vector(self, name: str, ids: list) -> DataFrame:
        """(key, words): the terms of each document by place."""
        rows = self.postings(name).where(F.col(self.key).isin(ids)).select(self.key, "term", F.explode("positions").alias("word"))
        return rows.groupBy(self.key).agg(F.array_sort(F.collect_list(F.struct("word", "term"))).alias("words"))

    def fetch_sort_value(self, name: str, lowest: bool = True) -> DataFrame:
        number = self.indexes[name].kind == "number"
        column = "number" if number else "low" if lowest else "high"
        return self.table("sort_values").where(F.col("index_id") == name).select(self.key, F.col(column).alias("value__"))

    def metadata(self, name: str) -> DataFrame:
        return self.terms(name).agg(F.count("*").alias("n_terms"), F.sum("n_recs").alias("n_postings"), F.sum("n_occs").alias("n_occurrences"), F.max("n_recs").alias("max_recs"), F.max("n_occs").alias("max_occs"), F.sum(F.length("term")).alias("total_chars"))

    def frequencies(self, name: str, by: str = "n_occs", start: int = 0, n: int = 100) -> DataFrame:
        """(term, n_recs, n_occs, rank): terms by falling frequency, a slice from rank ``start`` on."""
        top = self.terms(name).select("term", "n_recs", "n_occs").orderBy(F.desc(by), "term").limit(start + n)
        return placed(top, F.desc(by), "term", name="rank").where(F.col("rank") > start)

    def scan(self, name: str, term: str, direction: str = ">=", n: int = 25) -> DataFrame:
        """(term, term_id, n_recs, n_occs, marker): terms in order from a point on; = those that begin with it. The first and last terms of the index are marked."""
        tests = {">=": F.col("term") >= term, ">": F.col("term") > term, "<=": F.col("term") <= term, "<": F.col("term") < term, "=": F.col("term").startswith(term)}
        if direction not in tests:
            raise CQLError(24, f"relation {direction} in a scan")
        rows = self.terms(name)
        ends = rows.agg(F.min("term").alias("first__"), F.max("term").alias("last__"))
        order = F.desc("term") if direction in ("<", "<=") else F.asc("term")
        marker = F.when((F.col("term") == F.col("first__")) & (F.col("term") == F.col("last__")), "only").when(F.col("term") == F.col("first__"), "first").when(F.col("term") == F.col("last__"), "last")
        return rows.where(tests[direction]).orderBy(order).limit(n).crossJoin(F.broadcast(ends)).select("term", "term_id", "n_recs", "n_occs", marker.alias("marker"))

    def facets(self, name: str, hits: DataFrame, n: int = 0) -> DataFrame:
        """(term, term_id, n_recs, n_occs) of a set of documents, by falling n_recs and then term_id."""
        if self.indexes[name].kind == "words":
            held = self.vectors(name).join(hits.select(self.key), self.key, "left_semi")
            rows = held.select(F.inline(F.arrays_zip(F.col("terms").alias("term"), "occs")).alias("term", "occs"))
        else:
            rows = self.postings(name).join(hits.select(self.key), self.key, "left_semi")
        found = rows.groupBy("term").agg(F.count("*").alias("n_recs"), F.sum("occs").alias("n_occs"))
        found = found.join(self.terms(name).select("term", "term_id"), "term")
        ordered = found.select("term", "term_id", "n_recs", "n_occs").orderBy(F.desc("n_recs"), "term_id")
        return ordered.limit(n) if n else ordered

    # search

    def search(self, query: str | Query, default: str = "text", sets=None) -> DataFrame:
        """(key, and weight if the query is ranked): the documents that satisfy a query, in the order that it asks for."""
        query = parse(query) if isinstance(query, str) else query
        access = Stored(self)
        found = run(access, query.tree, self.indexes, default, self.key, sets)
        return sorted_by(found, query, access, self.indexes, default, self.key)

    def feedback(self, query: str, default: str = "text", n_terms: int = 20, n_docs: int = 0) -> DataFrame:
        """(key, weight): the hits of a ranked query and of the terms that tell its best hits apart, their weights added. The best: max(sqrt(hits), 5) documents."""
        first = self.search(query, default)
        if "weight" not in first.columns:
            raise CQLError(24, "feedback needs a ranked query")
        best = first.orderBy(F.desc("weight"), F.desc(self.key)).limit(n_docs or max(int(first.count() ** 0.5), 5))
        words = [r["term"] for r in self.telling_terms(default, best, n_terms).collect()]  # n_terms rows
        if not words:
            return first
        return self.search(f'({query}) or/rel.combine=sum {default} any/rel.algorithm=tfidf "{" ".join(words)}"', default)

    def telling_terms(self, name: str, hits: DataFrame, n: int = 20) -> DataFrame:
        """(term, weight): terms by occurrences in the hits and rarity in the index."""
        own = self.facets(name, hits).select("term", F.col("n_occs").alias("here"))
        weight = F.col("here") * F.log(F.lit(self.stats["n_docs"]) / F.col("n_recs"))
        return own.join(self.terms(name).select("term", "n_recs"), "term").select("term", F.round(weight, 6).alias("weight")).orderBy(F.desc("weight"), "term").limit(n)

    def by_examples(self, name: str, ids: list, n_terms: int = 20) -> DataFrame:
        """(key, weight): documents that share terms with the examples, most alike first in weight."""
        hits = self.spark.createDataFrame([(i,) for i in ids], f"{self.key} {self.kind}")
        words = [r["term"] for r in self.facets(name, hits, n_terms).collect()]  # n_terms rows
        return self.search(f'{name} any/rel.algorithm=tfidf "{" ".join(words)}"', name) if words else self.postings(name).where("false").select(self.key, F.lit(0.0).alias("weight"))

    def similarity(self, name: str, pairs: DataFrame) -> DataFrame:
        """(a, b, similarity): the cosine of two documents' term vectors, for pairs of keys."""
        return cosines(pairs, self.vectors(name), self.key)

    # change

    def without(self, ids: DataFrame, path: str) -> StoredIndex:
        """A new index under path without some documents (a column named as the key)."""
        gone = ids.select(self.key).distinct()
        in_place = fits(gone)  # then what is left stays in its order
        gone = F.broadcast(gone) if in_place else gone
        left = StoredIndex(self.spark, path, self.indexes, self.key, self.kind)
        orders = {"postings": ["term", "number", self.key], "sort_values": [self.key], "vectors": [self.key]}
        for name, x in self.indexes.items():
            own = {"postings": self.postings(name), "sort_values": self.table("sort_values").where(F.col("index_id") == name)}
            own |= {"vectors": self.vectors(name)} if x.kind == "words" else {}
            for table, rows in own.items():
                rows = rows.drop("index_id").join(gone, self.key, "left_anti")
                rows = rows if in_place else rows.sortWithinPartitions(*orders[table])
                rows.write.mode("overwrite").parquet(_folder(path, table, name))
        # what goes is counted and taken off, so that what stays isn't read again
        words = [n for n, x in self.indexes.items() if x.kind == "words"]
        values = self.table("postings").where(~F.col("index_id").isin(words)).select("index_id", "term", "occs", self.key)
        self.table("vectors")
        vectors = self._vectors.join(gone, self.key, "left_semi").select("index_id", F.inline(F.arrays_zip(F.col("terms").alias("term"), "occs")).alias("term", "occs"))
        lost = vectors.unionByName(values.join(gone, self.key, "left_semi").drop(self.key))
        less = _counted(lost).select("index_id", "term", (-F.col("n_recs")).alias("n_recs"), (-F.col("n_occs")).alias("n_occs"))
        terms = self.table("terms").drop("term_id").unionByName(less).groupBy("index_id", "term").agg(F.sum("n_recs").alias("n_recs"), F.sum("n_occs").alias("n_occs"))
        _write_terms(terms.where("n_recs > 0"), path)
        lengths = lost.groupBy("index_id").agg(F.sum("occs").alias("n")).collect()  # a row for each index
        fewer = {r["index_id"]: r["n"] for r in lengths}
        # documents without any word count too
        gone_docs = self.table("sort_values").join(gone, self.key, "left_semi").select(self.key).distinct().count()
        left._write_stats({"n_docs": self.stats["n_docs"] - gone_docs} | {f"words {n}": self.stats[f"words {n}"] - fewer.get(n, 0) for n in self.indexes})
        return left


class Stored:
    """Clauses over a stored index: what a query asks for becomes rows of postings, and one aggregation by document."""

    def __init__(self, index: StoredIndex):
        self.index, self.key = index, index.key
        self.tests: list[Column] = []
        self.asked: dict[str, Column] = {}
        self.sets: list[tuple[str, DataFrame]] = []
        self.words: set[str] = set()

    def _leaf(self, name: str, test: Column, label: str, make: Callable[[Column], Column]) -> Column:
        if label not in self.asked:
            own = (F.col("index_id") == name) & test
            self.tests.append(own)
            self.asked[label] = make(own)
        return F.col(f"`{label}`")

    def _term(self, term: str) -> Column:
        return mask_test(F.col("term"), term) if is_masked(term) else F.col("term") == term

    def count(self, name: str, index: Index, term: str) -> Column:
        return self._leaf(name, self._term(term), f"count {name} {term}", lambda own: F.coalesce(F.sum(F.when(own, F.col("occs"))), F.lit(0)))

    def places(self, name: str, index: Index, term: str) -> Column:
        return self._leaf(name, self._term(term), f"places {name} {term}", lambda own: F.array_sort(F.flatten(F.collect_list(F.when(own, F.col("positions"))))))

    def length(self, name: str, index: Index) -> Column:
        self.asked.setdefault(f"length {name}", F.max(F.when(F.col("index_id") == name, F.col("length"))))
        return F.col(f"`length {name}`")

    def _holds(self, name: str, test: Column) -> Column:
        label = f"holds {len(self.asked)}"
        return F.coalesce(self._leaf(name, test, label, lambda own: F.bool_or(own)), F.lit(False))

    def holds(self, name: str, index: Index, test: Callable[[Column], Column]) -> Column:
        return self._holds(name, test(F.col("term")))

    def value(self, name: str, index: Index, test: Callable[[Column, Column], Column]) -> Column:
        column = F.col("number" if index.kind == "number" else "term")
        return self._holds(name, test(column, F.col("high") if index.kind == "range" else column))

    def whole(self, name: str, index: Index, text: str) -> Column:
        raise CQLError(24, "whole values of words aren't stored; give the column an index of kind exact")

    def member(self, found: DataFrame) -> Column:
        flag = f"set {len(self.sets)}"
        self.sets.append((flag, found.select(self.key).distinct()))
        return F.coalesce(F.col(f"`{flag}`"), F.lit(False))

    def collection(self, name: str, index: Index) -> dict[str, Column]:
        self.words.add(name)
        return {"n_docs": F.lit(0), f"n_words {name}": F.lit(0)}

    def constants(self) -> dict[str, int]:
        return {"n_docs": self.index.stats["n_docs"]} | {f"n_words {n}": self.index.stats[f"words {n}"] for n in self.words}

    def rows(self) -> DataFrame:
        rows = self.index.table("postings")
        if self.tests:
            every = self.tests[0]
            for test in self.tests[1:]:
                every = every | test
            rows = rows.where(every)
        else:
            rows = rows.where("false")
        sets = [flag for flag, _ in self.sets]
        if sets:
            rows = rows.select("*", *(F.lit(None).cast("boolean").alias(f) for f in sets))
            for flag, found in self.sets:
                rows = rows.unionByName(found.withColumn(flag, F.lit(True)), allowMissingColumns=True)
        columns = [c.alias(label) for label, c in self.asked.items()] + [F.coalesce(F.bool_or(f"`{f}`"), F.lit(False)).alias(f) for f in sets]
        return rows.groupBy(self.key).agg(*columns) if columns else rows.select(self.key)

    def sort_values(self, name: str, index: Index, low: bool) -> DataFrame:
        return self.index.fetch_sort_value(name, low)


_open: dict[tuple, StoredIndex] = {}


def stored_index(spark: SparkSession, docs: DataFrame, indexes: dict[str, Index], name: str, key: str = "doc_id") -> StoredIndex:
    """The stored index of a table, written under the shared folder the first time a session asks for it. name: says which table it is."""
    at = (spark.sparkContext.applicationId, name)
    if at not in _open:
        path = f"{shared_dir(spark)}/index-{hashlib.md5(repr(at).encode()).hexdigest()}"
        _open[at] = write_index(docs, path, indexes, key)
    return _open[at]
