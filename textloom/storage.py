"""Where tables of our own lie, cutting of lineage, and joins whose broadcast side is measured first."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: A side of a join is broadcast only if it is measured to have at most so many bytes.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none and runs on one machine."""
    context = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="textloom-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(named)
    return named


def settle(df: DataFrame) -> DataFrame:
    """Compute df now and cut its lineage, on storage that survives the loss of executors."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def fits(df: DataFrame, limit: int = BROADCAST_BYTES) -> bool:
    """Whether df is measured to have at most so many bytes."""
    width = F.lit(24 + 16 * len(df.columns))
    for name, kind in df.dtypes:
        if kind in ("string", "binary"):
            width = width + F.coalesce(F.octet_length(f"`{name}`"), F.lit(0))
    return (df.agg(F.sum(width.cast("bigint"))).first()[0] or 0) <= limit


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if it is measured to fit into the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if fits(df, limit) else df


def placed(df: DataFrame, *order: Column | str, name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the order: sorted in ranges by all tasks, never in one."""
    rows = settle(df.orderBy(*order).withColumn("part__", F.spark_partition_id()).withColumn("row__", F.monotonically_increasing_id()))
    sizes = rows.groupBy("part__").agg(F.count("*").alias("n__"), F.min("row__").alias("first__"))
    before = Window.orderBy("part__").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition
    sizes = sizes.withColumn("ahead__", F.coalesce(F.sum("n__").over(before), F.lit(0))).drop("n__")
    return rows.join(F.broadcast(sizes), "part__").withColumn(name, F.col("row__") - F.col("first__") + F.col("ahead__") + 1).drop("part__", "row__", "first__", "ahead__")
