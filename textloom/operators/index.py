"""Index building, browsing, facets, vectors and feedback over documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from textloom.functions import analysis as A
from textloom.functions.posted import posted_rows, repeated


def tokens_of(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    return docs.select(key, F.coalesce(A.words(text), F.array().cast("array<string>")).alias("tokens"))


def postings(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, key, occs, positions): the inverted index."""
    rows = posted_rows(docs, key, F.lower(text), repeated(docs, key))
    return rows.select("term", key, F.col("occs").cast("bigint").alias("occs"), "positions")


def term_stats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(term, n_recs, n_occs), with one shuffle of partial counts."""
    flags = tokens_of(docs, text, key).select(F.explode(A.counted(F.col("tokens"))).alias("f"))
    return flags.groupBy(F.col("f.term").alias("term")).agg(F.sum("f.rec").alias("n_recs"), F.sum("f.occ").alias("n_occs"))


def index_metadata(stats: DataFrame) -> DataFrame:
    return stats.agg(F.count("*").alias("n_terms"), F.sum("n_recs").alias("n_postings"), F.sum("n_occs").alias("n_occurrences"))


def collection_stats(docs: DataFrame, text: str = "text") -> DataFrame:
    n = F.size(F.coalesce(A.words(text), F.array().cast("array<string>"))).cast("bigint")
    rows = docs.select(n.alias("words"), F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint").alias("bytes"))
    return rows.agg(
        F.count("*").alias("total_items"),
        F.sum("words").alias("total_words"),
        F.min("words").alias("min_words"),
        F.max("words").alias("max_words"),
        F.floor(F.sum("words") / F.count("*")).alias("mean_words"),
        F.sum("bytes").alias("total_bytes"),
        F.min("bytes").alias("min_bytes"),
        F.max("bytes").alias("max_bytes"),
    )


def scan(stats: DataFrame, term: str, direction: str, limit: int) -> DataFrame:
    """Terms of an index from a term on: >= and > upwards, <= and < downwards, = those that begin with it."""
    test: dict[str, Column] = {">=": F.col("term") >= term, ">": F.col("term") > term, "<=": F.col("term") <= term, "<": F.col("term") < term, "=": F.col("term").startswith(term)}
    order = F.desc("term") if direction.startswith("<") else F.asc("term")
    return stats.where(test[direction]).orderBy(order).limit(limit)


def facets(docs: DataFrame, hits: DataFrame, by: str, key: str = "doc_id") -> DataFrame:
    """(facet, n_recs) of the found rows by a column's value."""
    return docs.join(hits.select(key), key, "left_semi").groupBy(F.col(by).alias("facet")).agg(F.count("*").alias("n_recs"))


def similar_to(docs: DataFrame, terms: DataFrame, limit: int, key: str = "doc_id") -> DataFrame:
    """Rows that hold the terms, by how many of them."""
    held = postings(docs, key).join(terms, "term")
    return held.groupBy(key).agg(F.count("*").alias("n_terms"), F.sum("occs").alias("n_occs")).orderBy(F.desc("n_terms"), F.desc("n_occs"), key).limit(limit)


def frequency_list(stats: DataFrame, limit: int) -> DataFrame:
    """The most frequent terms with their rank."""
    top = stats.orderBy(F.desc("n_occs"), F.asc("term")).limit(limit)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("n_occs"), F.asc("term"))).cast("bigint"))


def feedback_terms(docs: DataFrame, hits: DataFrame, n_terms: int = 20, key: str = "doc_id") -> DataFrame:
    """The terms of most weight in the given rows: occurrences in them times the log of how rare they are in all."""
    n = docs.agg(F.count("*").alias("n__"))
    here = term_stats(docs.join(hits.select(key), key, "left_semi"), key).withColumnRenamed("n_occs", "occs_here").select("term", "occs_here")
    both = here.join(term_stats(docs, key), "term").crossJoin(F.broadcast(n))
    return both.select("term", F.round(F.col("occs_here") * F.log(F.col("n__") / F.col("n_recs")), 6).alias("weight")).orderBy(F.desc("weight"), F.asc("term")).limit(n_terms)
