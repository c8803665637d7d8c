"""What the operators of this subpackage share: tables, checkpoints, size-checked joins and connected components."""

from __future__ import annotations

import tempfile
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it has at most so many bytes, counted first.
BROADCAST_BYTES = 64 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not named:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Compute df now and cut its lineage, on storage that survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is measured to fit into the limit; else as it is, for a shuffled join. df should be settled."""
    width = F.lit(24 + 16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
    size = df.agg(F.sum(width.cast("bigint"))).first()[0] or 0
    return F.broadcast(df) if size <= limit else df


def without(docs: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of docs whose key isn't in ids (settled, one column named like key). Rows with a null key stay."""
    return docs.join(small(ids), key, "left_anti")


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the least node that each node of the undirected edges (a, b) is connected with.

    Alternates large-star and small-star steps, each a few shuffles of the edge
    list, until the list is a set of stars around the least nodes.
    """
    pairs = settle(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        linked = large.join(least, "u")
        pairs = settle(linked.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        state = pairs.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if state == before:
            break
        before = state
    roots = pairs.select("v").distinct()
    return pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))


def only(df: DataFrame, **columns: str | Column) -> DataFrame:
    """The columns needed, under our own names; whatever else df carries can't clash."""
    return df.select(*(((df[f"`{c}`"] if isinstance(c, str) else c).alias(name)) for name, c in columns.items()))
