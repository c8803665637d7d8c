"""The corpus pipeline: five stages applied one after the other to the documents table.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last
return the columns of documents; the last returns the kept documents' tokens.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.bpe import encode
from textloom.llm.common import shared_dir, table
from textloom.llm.decontaminate import drop_contaminated
from textloom.llm.near_dedup import drop_near_duplicates
from textloom.llm.suffix_dedup import drop_repeats
from textloom.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents found toxic go."""
    return drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return drop_near_duplicates(docs)


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat an earlier one are cut, and n_chars counts what remains; documents of which nothing remains go."""
    return drop_repeats(docs).withColumn("n_chars", F.length("text").cast("bigint"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def tokenisation(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents' tokens."""
    return encode(docs)


STAGES = [("toxicity", toxicity), ("minhash_near_dedup", near_dedup), ("suffix_array_dedup", suffix_array_dedup), ("benchmark_decontamination", decontamination), ("byte_level_bpe", tokenisation)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, their results written under the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can't express the stages that learn, hash or tokenise; a brute-force version stands in the tests.
ORACLE_SQL = None
