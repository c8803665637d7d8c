"""A database of records: one object that stores, indexes, searches, browses, and serves them page by page."""

from __future__ import annotations

import logging
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.cql.parser import Clause, CQLError, parse
from textloom.operators.search import Index, scaled
from textloom.operators.stored import StoredIndex, write_index
from textloom.operators.stores import ResultSetStore, Store

log = logging.getLogger("textloom")


@dataclass
class Workflow:
    """Named steps, each from a DataFrame to a DataFrame; forks go to other workflows, and ``otherwise`` takes over from a step that fails."""

    name: str
    steps: list[tuple[str, Callable[[DataFrame], DataFrame]]] = field(default_factory=list)
    otherwise: Callable[[DataFrame, Exception], DataFrame] | None = None

    def step(self, name: str, f: Callable[[DataFrame], DataFrame]) -> Workflow:
        return Workflow(self.name, [*self.steps, (name, f)], self.otherwise)

    def process(self, rows: DataFrame) -> DataFrame:
        for name, f in self.steps:
            log.info("%s: %s", self.name, name)
            try:
                rows = f(rows)
            except Exception as e:
                if self.otherwise is None:
                    raise
                rows = self.otherwise(rows, e)
        return rows

    def fork(self, rows: DataFrame, *others: Workflow) -> list[DataFrame]:
        """What this and each other workflow makes of the same rows."""
        return [w.process(rows) for w in (self, *others)]


class Registry:
    """Objects by name, made when first asked for; a name that isn't here is looked for in the parent."""

    def __init__(self, parent: Registry | None = None):
        self.parent, self.makers, self.made = parent, {}, {}

    def register(self, name: str, maker: Callable[[], object]) -> None:
        self.makers[name] = maker
        self.made.pop(name, None)

    def get(self, name: str):
        if name in self.makers:
            if name not in self.made:
                self.made[name] = self.makers[name]()
            return self.made[name]
        if self.parent is not None:
            return self.parent.get(name)
        raise KeyError(name)

    def names(self) -> list[str]:
        return sorted(set(self.makers) | set(self.parent.names() if self.parent else ()))


class Database:
    """Records (key and the columns of the indexes) under a folder, with their index and result sets.

    Records come and go by :meth:`add` and :meth:`remove`; :meth:`commit`
    writes the index anew under a new folder, which searches use from then on.
    """

    def __init__(self, spark: SparkSession, path: str, indexes: dict[str, Index], default: str, key: str = "doc_id"):
        self.spark, self.path, self.indexes, self.default, self.key = spark, path, indexes, default, key
        self.sets = ResultSetStore(spark, f"{path}/sets", key)
        self.index: StoredIndex | None = None
        self.records: DataFrame | None = None

    def add(self, records: DataFrame) -> None:
        """Add records; those with a key that is known replace the older ones."""
        older = None if self.records is None else self.records.join(records.select(self.key), self.key, "left_anti")
        self._keep(records if older is None else older.unionByName(records))

    def remove(self, ids: DataFrame) -> None:
        """Remove records and take them out of the index."""
        if self.records is not None:
            self._keep(self.records.join(ids.select(self.key), self.key, "left_anti"))
        self.unindex(ids)

    def _keep(self, records: DataFrame) -> None:
        folder = f"{self.path}/records-{uuid.uuid4().hex}"
        records.write.parquet(folder)
        self.records = self.spark.read.parquet(folder)

    def unindex(self, ids: DataFrame) -> None:
        """Take records out of the index only."""
        if self.index is not None:
            self.index = self.index.without(ids, f"{self.path}/index-{uuid.uuid4().hex}")

    def commit(self, min_support: int = 1) -> StoredIndex:
        self.index = write_index(self.records, f"{self.path}/index-{uuid.uuid4().hex}", self.indexes, self.key, min_support)
        return self.index

    def search(self, query: str) -> DataFrame:
        """The hits of a query; ranked ones with their weights as they are and scaled to 0..1."""
        hits = self.index.search(query, self.default, self.sets)
        return scaled(hits) if "weight" in hits.columns else hits

    def scan(self, clause: str, n: int = 25, direction: str = ">=") -> DataFrame:
        tree = parse(clause).tree
        if not isinstance(tree, Clause):
            raise CQLError(10, "a scan takes one clause")
        name = self.default if tree.index.startswith("cql.") else tree.index
        return self.index.scan(name, tree.term, direction, n)

    def dereferenced(self, hits: DataFrame) -> DataFrame:
        """hits with the columns of their records."""
        return hits.join(self.records, self.key)

    # what a server answers

    def search_retrieve(self, query: str, start: int = 1, maximum: int = 10, ttl_seconds: int = 300) -> dict:
        """numberOfRecords, the page of records from ``start`` (from 1) on, nextRecordPosition, and the name under which the whole set is kept."""
        if start < 1 or maximum < 0:
            raise CQLError(6, "positions count from 1")
        name = uuid.uuid4().hex
        hits = self.index.search(query, self.default, self.sets)
        self.sets.save(name, hits, ttl_seconds=ttl_seconds)
        total = self.sets.fetch(name).count()
        if total and start > total:
            raise CQLError(61, "the first record is beyond the last")
        after = start + maximum
        page = self.sets.page(name, start, maximum).join(self.records, self.key).orderBy("place")
        return {"numberOfRecords": total, "records": page, "nextRecordPosition": after if after <= total else None, "resultSetId": name}

    def scan_around(self, clause: str, maximum: int = 20, position: int = 1) -> DataFrame:
        """Terms around one, which stands at a position (from 1) of the answer: 1 begins with it, 0 right after it, ``maximum`` ends with it."""
        if position == 1:
            return self.scan(clause, maximum, ">=")
        if position == 0:
            return self.scan(clause, maximum, ">")
        if position >= maximum:
            return self.scan(clause, maximum, "<=" if position == maximum else "<").orderBy("term")
        return self.scan(clause, position - 1, "<").unionByName(self.scan(clause, maximum - position + 1, ">=")).orderBy("term")

    def explain(self) -> DataFrame:
        """(index, kind, column, proximity, variants, n_terms): what can be searched."""
        rows = [(n, x.kind, x.column, x.proximity, ",".join(sorted(x.variants))) for n, x in self.indexes.items()]
        described = self.spark.createDataFrame(rows, "index_id string, kind string, column string, proximity boolean, variants string")
        return described.join(F.broadcast(self.index.table("terms").groupBy("index_id").agg(F.count("*").alias("n_terms"))), "index_id", "left")

    def facets(self, query: str, names: list[str], n: int = 10) -> DataFrame:
        """(index_id, term, term_id, n_recs, n_occs): the facets of a query's hits in several indexes."""
        hits = self.index.search(query, self.default, self.sets)
        out = None
        for name in names:
            own = self.index.facets(name, hits, n).withColumn("index_id", F.lit(name))
            out = own if out is None else out.unionByName(own)
        return out


def harvest(store: Store, since: str | None = None, until: str | None = None, after: str = "", size: int = 10) -> DataFrame:
    """(id, datestamp, deleted, data): a page of what was stored or deleted in a time, in order of ids, after one. Deleted records have no data."""
    live = store.current().select("id", F.col("created").alias("datestamp"), F.lit(False).alias("deleted"), "data")
    gone = store.deleted.join(live.select("id"), "id", "left_anti").select("id", F.col("deleted_at").alias("datestamp"), F.lit(True).alias("deleted"), F.lit(None).cast("string").alias("data"))
    rows = live.unionByName(gone).where(F.col("id") > after)
    rows = rows if since is None else rows.where(F.col("datestamp") >= F.lit(since).cast("timestamp"))
    rows = rows if until is None else rows.where(F.col("datestamp") <= F.lit(until).cast("timestamp"))
    return rows.orderBy("id").limit(size)


def join_through(local: StoredIndex, name: str, remote_hits: DataFrame, value: Column, default: str | None = None) -> DataFrame:
    """The local documents whose index has a value of remote hits: a semi-join through the postings, whatever the number of values."""
    wanted = remote_hits.select(value.cast("string").alias("term")).where("term is not null").distinct()
    return local.postings(name).join(wanted, "term", "left_semi").select(local.key).distinct()


def scan_through(local: StoredIndex, name: str, remote: StoredIndex, remote_name: str, value: DataFrame) -> DataFrame:
    """(term, n_recs): the remote index's terms with the local documents that each leads to. value: (remote key, term of the local index)."""
    led = remote.postings(remote_name).select("term", remote.key).join(value.select(F.col(value.columns[0]).alias(remote.key), F.col(value.columns[1]).alias("local__")), remote.key)
    own = local.postings(name).select(F.col("term").alias("local__"), F.col(local.key).alias("here__"))
    return led.join(own, "local__").groupBy("term").agg(F.count_distinct("here__").alias("n_recs"))
