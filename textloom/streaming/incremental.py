"""An index that grows with a stream: each batch replaces its records' postings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.index import postings


def index_stream(docs: DataFrame, path: str, checkpoint: str, key: str = "doc_id", text: str = "text"):
    """Append each batch's postings under its batch number; a batch that is tried again overwrites only itself."""

    def write(batch: DataFrame, number: int) -> None:
        postings(batch, key, text).withColumn("version", F.lit(number).cast("bigint")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, key: str = "doc_id") -> DataFrame:
    """The index as it stands: of each record the postings of its latest batch."""
    rows = spark.read.parquet(path)
    latest = rows.groupBy(key).agg(F.max("version").alias("version"))
    return rows.join(latest, [key, "version"]).drop("batch", "version")


def windowed_counts(events: DataFrame, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events by type and window; also for streams, where the watermark ends a window."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), "event_type", "n")
