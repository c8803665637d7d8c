"""The registered queries of the corpus operators, with production parameters over whole tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from textloom.llm.bpe import encode
from textloom.llm.common import shared_dir, table
from textloom.llm.decontaminate import contained_items
from textloom.llm.embedding_dedup import near_vectors
from textloom.llm.html_extract import extract
from textloom.llm.license_scan import scan_licenses
from textloom.llm.lm_score import score_documents
from textloom.llm.near_dedup import near_duplicates
from textloom.llm.suffix_dedup import repeated_passages
from textloom.llm.toxicity import score_toxicity
from textloom.llm.warc import archived


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(table(spark, sf_dir, "documents")).drop("whole")


def op6_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"))


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archived(spark, table(spark, sf_dir, "pages"), f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}")


def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_toxicity,
        op2_benchmark_decontamination,
        op3_minhash_near_dedup,
        op4_license_scan,
        op5_suffix_array_dedup,
        op6_byte_level_bpe,
        op7_embedding_near_dedup,
        op8_warc,
        op9_lm_scoring,
        op10_html_extraction,
    )
}

ORACLE: dict[str, str] = {
    "op8_warc": "SELECT page_id, url, html FROM pages",
    "op2_benchmark_decontamination": r"""
        WITH doc_words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
             item_words AS (SELECT item_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM benchmark),
             doc_grams AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM doc_words),
             item_grams AS (SELECT DISTINCT item_id, unnest(list_transform(range(1, greatest(len(w) - 3, 1)), lambda i: array_to_string(w[i:i + 4], ' '))) AS g FROM item_words),
             sizes AS (SELECT item_id, count(*) AS n FROM item_grams GROUP BY item_id)
        SELECT doc_id, item_id, round(count(*) / n, 6) AS containment
        FROM doc_grams JOIN item_grams USING (g) JOIN sizes USING (item_id)
        GROUP BY doc_id, item_id, n HAVING count(*) >= 0.5 * n""",
    "op5_suffix_array_dedup": r"""
        WITH words AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM documents),
             places AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM words WHERE len(w) >= 50),
             runs AS (SELECT doc_id, i - 1 AS pos, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM places),
             named AS (SELECT doc_id, pos, first_value(doc_id) OVER o AS at_doc, first_value(pos) OVER o AS at_pos FROM runs WINDOW o AS (PARTITION BY k ORDER BY doc_id, pos)),
             again AS (SELECT * FROM named WHERE doc_id <> at_doc OR pos - at_pos >= 50),
             gaps AS (SELECT *, CASE WHEN pos - lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) <= 50 THEN 0 ELSE 1 END AS gap FROM again),
             islands AS (SELECT *, sum(gap) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS island FROM gaps)
        SELECT doc_id, min(pos) AS first_word, max(pos) + 50 - min(pos) AS n_words, min(at_doc) AS first_doc FROM islands GROUP BY doc_id, island""",
}
