"""Records from files, archives, columns, databases and web services."""

from __future__ import annotations

import io
import tarfile
import zipfile
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.documents import escaped
from textloom.functions.marc import marc_records


def xml_records(spark: SparkSession, path: str, row_tag: str, **options: str) -> DataFrame:
    """One row for each element of that name, in files of any size; files are split between tasks."""
    return spark.read.options(rowTag=row_tag, **options).xml(path)


def xml_documents(spark: SparkSession, path: str, tag: str) -> DataFrame:
    """(path, part, record): the text of each element of a name, with what is inside; other elements and text around them are skipped."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    found = F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?(?:/>|>.*?</{tag}\s*>)"), F.lit(0))
    return files.select("path", F.posexplode(found).alias("part", "record"))


def line_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, line): a document a line."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("line"))


def file_documents(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """(path, content, length): a document a file, directories taken as a whole."""
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path).select("path", "content", "length")


def _members(kind: str) -> Callable[[bytes], list[dict]]:
    def tar(raw: bytes) -> list[dict]:
        with tarfile.open(fileobj=io.BytesIO(raw)) as t:
            return [{"member": m.name, "content": t.extractfile(m).read()} for m in t if m.isfile()]

    def zipped(raw: bytes) -> list[dict]:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return [{"member": m.filename, "content": z.read(m)} for m in z.infolist() if not m.is_dir()]

    return {"tar": tar, "zip": zipped}[kind]


def archive_documents(spark: SparkSession, path: str, kind: str, pattern: str = "*") -> DataFrame:
    """(path, member, content): the files inside tar archives (also compressed ones) or zip archives. What can't be read has none."""
    read = _members(kind)

    @F.pandas_udf("array<struct<member:string,content:binary>>")
    def unpack(raws: pd.Series) -> pd.Series:
        def one(raw):
            try:
                return read(bytes(raw))
            except (tarfile.TarError, zipfile.BadZipFile, EOFError, OSError):
                return []

        return raws.map(one)

    files = file_documents(spark, path, pattern)
    return files.select("path", F.explode(unpack("content")).alias("x")).select("path", "x.member", "x.content")


def table_documents(spark: SparkSession, url: str, query: str, **options: str) -> DataFrame:
    """Rows of a query of a database, read through JDBC; partitionColumn and bounds among the options spread it over tasks."""
    return spark.read.format("jdbc").options(url=url, query=query, **options).load()


def feed_items(spark: SparkSession, path: str, kind: str = "rss") -> DataFrame:
    """Items of RSS or entries of Atom feeds."""
    return xml_records(spark, path, "item" if kind == "rss" else "entry")


def consumed_documents(spark: SparkSession, path: str, schema: str = "value string", form: str = "text", archive: str | None = None):
    """A stream of files that are deleted (or moved to an archive folder) once they were read."""
    reader = spark.readStream.format(form).schema(schema).option("cleanSource", "archive" if archive else "delete")
    return (reader.option("sourceArchiveDir", archive) if archive else reader).load(path)


# streams out of rows

_FORMATS: dict[str, Callable[..., DataFrame]] = {
    "file": file_documents,
    "dir": file_documents,
    "lines": line_documents,
    "xml": xml_documents,
    "tar": lambda spark, path, **o: archive_documents(spark, path, "tar", **o),
    "zip": lambda spark, path, **o: archive_documents(spark, path, "zip", **o),
    "rss": feed_items,
    "marc": marc_records,
}


def register_format(name: str, reader: Callable[..., DataFrame]) -> None:
    """Make load(..., form=name) call reader(spark, path, **options)."""
    _FORMATS[name] = reader


_ENDS = {".xml": "xml", ".tar": "tar", ".tar.gz": "tar", ".tgz": "tar", ".tar.bz2": "tar", ".zip": "zip", ".marc": "marc", ".mrc": "marc", ".txt": "lines", ".rss": "rss"}


def load(spark: SparkSession, path: str, form: str | None = None, **options) -> DataFrame:
    """Documents of a path, in a form that is given or told by the name's end; without either, a document a file."""
    if form is None:
        form = next((f for end, f in sorted(_ENDS.items(), key=lambda x: -len(x[0])) if path.lower().endswith(end)), "dir")
    if form not in _FORMATS:
        raise ValueError(f"no form called {form}")
    return _FORMATS[form](spark, path, **options)


def term_documents(rows: DataFrame, key: str, terms: str) -> DataFrame:
    """(key, document): each term of a row's list as a document."""
    return rows.select(key, F.explode(terms).alias("document"))


def clusters(rows: DataFrame, key: Column, **fields: Column) -> DataFrame:
    """(key, cluster): for each key an element that holds each field's distinct values of all its rows, in order."""
    each = rows.select(key.alias("key"), F.explode(F.array(*(F.struct(F.lit(n).alias("field"), c.cast("string").alias("value")) for n, c in fields.items()))).alias("x")).where("key is not null and x.value is not null")
    values = each.select("key", "x.*").distinct()
    parts = values.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("field", "value"))).alias("x"))
    inner = F.array_join(F.transform("x", lambda x: F.concat(F.lit("<"), x["field"], F.lit(">"), escaped(x["value"]), F.lit("</"), x["field"], F.lit(">"))), "")
    return parts.select("key", F.concat(F.lit("<cluster><key>"), escaped(F.col("key").cast("string")), F.lit("</key>"), inner, F.lit("</cluster>")).alias("cluster"))


def accumulated(rows: DataFrame, group: str, order: str, text: str, sep: str = "\n") -> DataFrame:
    """(group, document): the texts of each group's rows in order as one document."""
    lists = rows.groupBy(group).agg(F.array_sort(F.collect_list(F.struct(order, F.col(text).alias("t")))).alias("x"))
    return lists.select(group, F.array_join(F.transform("x", lambda x: x["t"]), sep).alias("document"))


def to_xml(tag: str, **columns: Column) -> Column:
    """An element that holds the columns as elements, with reserved characters escaped."""
    inner = [x for name, c in columns.items() for x in (F.lit(f"<{name}>"), F.coalesce(escaped(c.cast("string")), F.lit("")), F.lit(f"</{name}>"))]
    return F.concat(F.lit(f"<{tag}>"), *inner, F.lit(f"</{tag}>"))
