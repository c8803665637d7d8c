"""Stores as tables: records and documents, result sets, queries and settings, each an append of Parquet under one folder.

A write adds a batch; deletions are rows of their own, with the time they were
made, so that nothing is rewritten until :meth:`Store.clean`.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from textloom.functions.documents import checksum, word_count
from textloom.storage import placed, settle, small


class DuplicateError(ValueError):
    """Data that the store has already was to be stored."""


def _read(spark: SparkSession, path: str, schema: str) -> DataFrame:
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:  # nothing was written yet
        return spark.createDataFrame([], schema)


class Store:
    """Data by id: (id, data, byte_count, word_count, digest, created, expires, parent).

    Null data is stored as such, without counts or digest. ``ttl``: after which
    time data expires, as an interval ("1 hour").
    """

    SCHEMA = "id string, data string, byte_count bigint, word_count bigint, digest string, created timestamp, expires timestamp, parent string, batch string"

    def __init__(self, spark: SparkSession, path: str, digest: str = "sha1", ttl: str | None = None):
        self.spark, self.path, self.digest, self.ttl = spark, path, digest, ttl

    @property
    def data(self) -> DataFrame:
        return _read(self.spark, f"{self.path}/data", self.SCHEMA).drop("batch")

    @property
    def deleted(self) -> DataFrame:
        """(id, deleted_at), the latest for each id."""
        return _read(self.spark, f"{self.path}/deleted", "id string, deleted_at timestamp").groupBy("id").agg(F.max("deleted_at").alias("deleted_at"))

    def current(self) -> DataFrame:
        """What is neither deleted since it was stored nor expired; of several rows of an id the last one stored."""
        latest = self.data.groupBy("id").agg(F.max_by(F.struct("data", "byte_count", "word_count", "digest", "created", "expires", "parent"), "created").alias("x")).select("id", "x.*")
        gone = latest.join(self.deleted, "id").where("deleted_at >= created").select("id")
        return latest.where("expires is null or expires > current_timestamp()").join(gone, "id", "left_anti")

    def store(self, rows: DataFrame, duplicates: str = "fail", dense_ids: bool = False) -> DataFrame:
        """Store rows (id or none, data, and parent if they have one) and return what was stored.

        ``duplicates``: data whose digest the store has, or that comes twice,
        fails or is left out ("skip"), or is stored again ("keep"). Rows without
        an id get a new one: a random one, or with ``dense_ids`` the next
        numbers in order of the data.
        """
        data = F.col("data").cast("string")
        rows = rows.withColumns({"data": data, "parent": F.col("parent").cast("string") if "parent" in rows.columns else F.lit(None).cast("string")})
        rows = rows.withColumns({"byte_count": F.octet_length("data").cast("bigint"), "word_count": word_count("data").cast("bigint"), "digest": checksum("data", self.digest)})
        if duplicates != "keep":
            fresh = rows.join(self.current().where("digest is not null").select("digest"), "digest", "left_anti")
            once = fresh.where("digest is not null").dropDuplicates(["digest"]).unionByName(fresh.where("digest is null"))
            if duplicates == "fail" and settle(rows).count() != once.count():
                raise DuplicateError("some of the data is in the store already, or comes twice")
            rows = once
        if "id" not in rows.columns:
            if dense_ids:
                last = self.data.agg(F.max(F.expr("try_cast(id as bigint)"))).first()[0]
                rows = placed(rows, "data", name="id").withColumn("id", (F.col("id") + (last if last is not None else -1)).cast("string"))
            else:
                rows = rows.withColumn("id", F.expr("uuid()"))
        rows = rows.withColumn("id", F.col("id").cast("string")).withColumn("created", F.current_timestamp())
        rows = rows.withColumn("expires", F.expr(f"created + interval {self.ttl}") if self.ttl else F.lit(None).cast("timestamp"))
        batch = uuid.uuid4().hex
        rows.select("id", "data", "byte_count", "word_count", "digest", "created", "expires", "parent").withColumn("batch", F.lit(batch)).write.mode("append").parquet(f"{self.path}/data")
        return _read(self.spark, f"{self.path}/data", self.SCHEMA).where(F.col("batch") == batch).drop("batch")

    def fetch(self, ids: DataFrame) -> DataFrame:
        """(id, data, ..., deleted_at) for a column of ids: what is stored now, or when it was deleted; unknown ids have neither."""
        wanted = ids.select(F.col("id").cast("string")).distinct()
        return wanted.join(self.current(), "id", "left").join(self.deleted, "id", "left").withColumn("deleted_at", F.when(F.col("created").isNull(), F.col("deleted_at")))

    def delete(self, ids: DataFrame) -> None:
        ids.select(F.col("id").cast("string")).distinct().withColumn("deleted_at", F.current_timestamp()).write.mode("append").parquet(f"{self.path}/deleted")

    def metadata(self, ids: DataFrame, *names: str) -> DataFrame:
        return self.fetch(ids).select("id", *names)

    def summary(self) -> DataFrame:
        """One row: items, and total, least, most and mean words and bytes; means are whole numbers."""
        counts = []
        for c in ("word", "byte"):
            counts += [F.sum(f"{c}_count").alias(f"total_{c}s"), F.min(f"{c}_count").alias(f"min_{c}s"), F.max(f"{c}_count").alias(f"max_{c}s"), F.floor(F.sum(f"{c}_count") / F.count(f"{c}_count")).alias(f"mean_{c}s")]
        return self.current().agg(F.count("*").alias("total_items"), *counts, F.max("created").alias("last_modified"))

    def clean(self) -> None:
        """Rewrite the store with what is current, under a new folder, which then counts; deletions stay known."""
        kept = settle(self.current().withColumn("batch", F.lit("kept")))
        kept.write.mode("overwrite").parquet(f"{self.path}/data")

    def chunks(self, size: int, by: str = "items") -> DataFrame:
        """(id, chunk): the store's ids dealt into chunks of about so many items, words or bytes."""
        weight = {"items": F.lit(1), "words": F.col("word_count"), "bytes": F.col("byte_count")}[by]
        total = self.current().agg(F.sum(weight)).first()[0] or 0
        return self.current().select("id", F.pmod(F.xxhash64("id"), F.lit(max(1, -(-int(total) // size)))).alias("chunk"))

    def pointers(self, files: DataFrame) -> DataFrame:
        """(id, data) of parts of files that the store's data points to as JSON {path, offset, length}. files: (path, content)."""
        at = self.current().select("id", F.from_json("data", "path string, offset int, length int").alias("p"))
        return at.join(files, at["p.path"] == files["path"]).select("id", F.decode(F.substring("content", F.col("p.offset") + 1, F.col("p.length")), "UTF-8").alias("data"))


class ResultSetStore:
    """Named sets of (key, weight, occs), each a folder; sets expire, and a name that isn't known is an empty set."""

    def __init__(self, spark: SparkSession, path: str, key: str = "doc_id", kind: str = "bigint"):
        self.spark, self.path, self.key, self.kind = spark, path, key, kind

    @property
    def _schema(self) -> str:
        return f"place bigint, {self.key} {self.kind}, weight double, occs bigint"

    def _folder(self, name: str) -> str:
        return f"{self.path}/set={name.replace('/', '%2F')}"

    def save(self, name: str, hits: DataFrame, order: list[Column] | None = None, ttl_seconds: int | None = None, overwrite: bool = True) -> None:
        """Save hits in an order, by default that of weights and keys, both falling, if they have weights; else by key."""
        weight = F.col("weight") if "weight" in hits.columns else F.lit(0.5)
        occs = F.col("occs").cast("bigint") if "occs" in hits.columns else F.lit(1).cast("bigint")
        rows = hits.select(F.col(self.key), weight.alias("weight"), occs.alias("occs"))
        order = order or ([F.desc("weight"), F.desc(self.key)] if "weight" in hits.columns else [F.asc(self.key)])
        placed(rows, *order).select("place", self.key, "weight", "occs").sortWithinPartitions("place").write.mode("overwrite" if overwrite else "error").parquet(self._folder(name))
        expires = F.current_timestamp() + F.make_dt_interval(secs=F.lit(ttl_seconds)) if ttl_seconds is not None else F.lit(None).cast("timestamp")
        about = self.spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("created"), expires.alias("expires"))
        about.write.mode("append").parquet(f"{self.path}/about")

    def about(self) -> DataFrame:
        """(name, created, expires) of each set, as last saved."""
        rows = _read(self.spark, f"{self.path}/about", "name string, created timestamp, expires timestamp")
        return rows.groupBy("name").agg(F.max("created").alias("created"), F.max_by("expires", "created").alias("expires"))

    def fetch(self, name: str) -> DataFrame:
        name = name.rpartition("/")[2]  # store/name
        live = self.about().where((F.col("name") == name) & (F.col("expires").isNull() | (F.col("expires") > F.current_timestamp())))
        if live.isEmpty():
            return self.spark.createDataFrame([], self._schema)
        return _read(self.spark, self._folder(name), self._schema)

    def page(self, name: str, start: int = 1, maximum: int = 10) -> DataFrame:
        """The items from a place (from 1) on, so many of them; found by the files' statistics."""
        return self.fetch(name).where((F.col("place") >= start) & (F.col("place") < start + maximum))

    def delete(self, name: str) -> None:
        expired = self.spark.range(1).select(F.lit(name).alias("name"), F.current_timestamp().alias("created"), F.current_timestamp().alias("expires"))
        expired.write.mode("append").parquet(f"{self.path}/about")


def serialized(hits: DataFrame, key: str = "doc_id", store: str = "recordStore") -> DataFrame:
    """(key, item): each item of a set as an element."""
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    weight = number("weight") if "weight" in hits.columns else F.lit("0.5")
    occs = number("occs") if "occs" in hits.columns else F.lit("1")
    return hits.select(key, F.concat(F.lit('<item recordStore="'), F.lit(store), F.lit('" id="'), number(key), F.lit('" weight="'), weight, F.lit('" occurences="'), occs, F.lit('"/>')).alias("item"))


def deserialized(items: DataFrame, kind: str = "bigint", key: str = "doc_id") -> DataFrame:
    """(record_store, key, weight, occs) of items as elements."""
    read = lambda name: F.xpath_string("item", F.lit(f"/item/@{name}"))
    return items.select(read("recordStore").alias("record_store"), read("id").cast(kind).alias(key), read("weight").cast("double").alias("weight"), read("occurences").cast("bigint").alias("occs"))


def combined(sets: list[DataFrame], how: str, keys: list[str], weights: str = "mean") -> DataFrame:
    """(keys, occs, weight): sets of (keys, occs, weight) put together, an item being known by its keys.

    ``how``: all, and, = for what every set has; any, or for what some has; not
    for what only the first has. Occurrences are those of the first set that has
    the item. ``weights``: sum, mean (over the sets, as many as they are), norm
    (over those that have it), cmbz (the sum times those that have it). A set that is empty
    leaves the weights of a union of two as they are.
    """
    n = len(sets)
    every = sets[0].withColumn("set__", F.lit(0))
    for k, other in enumerate(sets[1:], 1):
        every = every.unionByName(other.withColumn("set__", F.lit(k)))
    merged = every.groupBy(*keys).agg(F.min_by("occs", "set__").alias("occs"), F.sum("weight").alias("total__"), F.count_distinct("set__").alias("n__"), F.min("set__").alias("first__"))
    if how in ("all", "and", "="):
        merged = merged.where(F.col("n__") == n)
    elif how == "not":
        merged = merged.where("first__ = 0 and n__ = 1")
    elif how not in ("any", "or"):
        raise ValueError(f"no way to combine sets called {how}")
    divisor = F.lit(n)
    if how in ("any", "or") and n == 2:
        some = every.agg(F.greatest(F.count_distinct("set__"), F.lit(1)).alias("some__"))
        merged, divisor = merged.crossJoin(F.broadcast(some)), F.col("some__")
    weight = {"sum": F.col("total__"), "mean": F.col("total__") / divisor, "norm": F.col("total__") / F.col("n__"), "cmbz": F.col("total__") * F.col("n__")}[weights]
    return merged.select(*keys, "occs", weight.alias("weight"))


def favoured(first: DataFrame, other: DataFrame, keys: list[str], top: int = 15) -> DataFrame:
    """(keys, weight): of two ranked sets, the larger weight of an item among the first ``top`` of either, else the mean of both."""
    ranks = []
    for k, hits in enumerate((first, other)):
        least = hits.orderBy(F.desc("weight")).limit(top).agg(F.min("weight").alias("least__"))
        ranks.append(hits.crossJoin(F.broadcast(least)).select(*keys, F.col("weight").alias(f"w{k}"), (F.col("weight") >= F.col("least__")).alias(f"t{k}")))
    both = ranks[0].join(ranks[1], keys, "full")
    favour = F.coalesce("t0", F.lit(False)) | F.coalesce("t1", F.lit(False))
    none = F.lit(0.0)
    return both.select(*keys, F.when(favour, F.greatest(F.coalesce("w0", none), F.coalesce("w1", none))).otherwise((F.coalesce("w0", none) + F.coalesce("w1", none)) / 2).alias("weight"))


def with_parents(components: DataFrame, weight: float = 0.5) -> DataFrame:
    """(component, parent, weight): a component's weight drawn towards that of its parent. components: (component, parent, weight, parent_weight)."""
    return components.select("component", "parent", (F.lit(weight) * F.coalesce("parent_weight", F.lit(0.0)) + F.lit(1 - weight) * F.col("weight")).alias("weight"))


class SettingStore:
    """Settings of named objects as JSON: the last one stored counts."""

    def __init__(self, spark: SparkSession, path: str):
        self.store = Store(spark, path)

    def save(self, name: str, settings: dict) -> None:
        self.store.store(self.store.spark.createDataFrame([(name, json.dumps(settings, sort_keys=True))], "id string, data string"), duplicates="keep")

    def fetch(self, name: str) -> dict | None:
        row = self.store.current().where(F.col("id") == name).select("data").first()
        return json.loads(row[0]) if row else None


class QueryStore:
    """Queries by name with the name of their result set."""

    def __init__(self, spark: SparkSession, path: str):
        self.settings = SettingStore(spark, path)

    def save(self, name: str, query: str, result_set: str = "") -> None:
        from textloom.cql.parser import parse

        self.settings.save(name, {"query": parse(query).to_cql(), "result_set": result_set})

    def fetch(self, name: str) -> dict | None:
        return self.settings.fetch(name)


def merge_postings(current: DataFrame, new: DataFrame, how: str, keys: list[str]) -> DataFrame:
    """Postings with new ones added (occurrences of an item add up), replaced, or deleted."""
    if how == "delete":
        return current.join(small(new.select(*keys).distinct()), keys, "left_anti")
    if how == "replace":
        return current.join(small(new.select(*keys).distinct()), keys, "left_anti").unionByName(new)
    if how == "add":
        return current.unionByName(new).groupBy(*keys).agg(F.sum("occs").alias("occs"))
    raise ValueError(f"no way to merge called {how}")


def bitmaps(rows: DataFrame, term: str, key: str) -> DataFrame:
    """(term, bucket, bits): each term's set of ids as bitmaps, one for each bucket of 32,768 ids, so that none grows without bound."""
    return rows.groupBy(F.col(term).alias("term"), F.bitmap_bucket_number(key).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(key)).alias("bits"))


def bitmap_counts(maps: DataFrame) -> DataFrame:
    """(term, n): how many ids each term has."""
    return maps.groupBy("term").agg(F.sum(F.bitmap_count("bits")).alias("n"))


def bitmap_union(maps: DataFrame, terms: list[str]) -> DataFrame:
    """(bucket, bits): the ids that any of the terms has."""
    return maps.where(F.col("term").isin(terms)).groupBy("bucket").agg(F.bitmap_or_agg("bits").alias("bits"))


def bitmap_intersection(maps: DataFrame, terms: list[str]) -> DataFrame:
    """(bucket, bits): the ids that all of the terms have."""
    own = maps.where(F.col("term").isin(terms)).groupBy("bucket").agg(F.bitmap_and_agg("bits").alias("bits"), F.count("*").alias("n"))
    return own.where(F.col("n") == len(set(terms))).drop("n")
