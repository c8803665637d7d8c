"""WARC archives whose records are compressed one by one with a dictionary.

Each file begins with a skippable frame that holds a Zstandard dictionary built
from the file's own records; every record after it is a frame of its own, so
that any record can be read from its offset with the dictionary alone.
"""

from __future__ import annotations

import hashlib
import os
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.common import only

#: The magic number of the frame with the dictionary.
DICTIONARY_FRAME = 0x184D2A5D
_SPACE = uuid.UUID("8f3a1c52-6f0e-5d4b-9a77-2c1e90b7d3aa")


def record_bytes(page_id: int | None, url: str | None, html: str | None, date: str) -> bytes:
    """One WARC record. A null page_id or url has no header line, and a null html is marked by one."""
    body = b"" if html is None else html.encode("utf-8", "surrogatepass")
    name = uuid.uuid5(_SPACE, f"{page_id}\0{url}\0{hashlib.sha256(body).hexdigest()}")
    lines = ["WARC/1.1", "WARC-Type: resource", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}", "Content-Type: text/html"]
    if url is not None:
        # header values stand on one line
        if "\r" in url or "\n" in url:
            url = url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A")
            lines.append("X-Escaped-URI: 1")
        lines.append(f"WARC-Target-URI: {url}")
    if page_id is not None:
        lines.append(f"X-Page-Id: {page_id}")
    if html is None:
        lines.append("X-Null-Payload: 1")
    lines += [f"WARC-Block-Digest: sha1:{hashlib.sha1(body).hexdigest()}", f"Content-Length: {len(body)}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode("utf-8", "surrogatepass") + body + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[int | None, str | None, str | None]:
    """(page_id, url, html) of one record; its block must fit the digest."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "surrogatepass").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    body = rest[: int(fields["Content-Length"])]
    if "sha1:" + hashlib.sha1(body).hexdigest() != fields["WARC-Block-Digest"]:
        raise ValueError("a record's block doesn't fit its digest")
    url = fields.get("WARC-Target-URI")
    if url is not None and "X-Escaped-URI" in fields:
        url = url.replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")
    page_id = fields.get("X-Page-Id")
    return None if page_id is None else int(page_id), url, None if "X-Null-Payload" in fields else body.decode("utf-8", "surrogatepass")


def build_dictionary(records: list[bytes], size: int) -> bytes:
    """A dictionary from all the records. Where they are too few or too small to train one, or nothing in them repeats, the end of their bytes is one as it is."""
    total = sum(map(len, records))
    for samples in (records, records * 8):
        try:
            return zstandard.train_dictionary(min(size, max(256, total // 10)), samples, k=256, d=8).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(records)[-size:]


def pack(records: list[bytes], dictionary_bytes: int, level: int) -> tuple[bytes, list[tuple[int, int]]]:
    """A whole file, and each record's offset and length in it."""
    own = build_dictionary(records, dictionary_bytes)
    packed = zstandard.ZstdCompressor(level=19).compress(own)
    parts = [struct.pack("<II", DICTIONARY_FRAME, len(packed)) + packed]
    press = zstandard.ZstdCompressor(level=level, dict_data=zstandard.ZstdCompressionDict(own), write_checksum=True)
    at, places = len(parts[0]), []
    for record in records:
        frame = press.compress(record)
        places.append((at, len(frame)))
        parts.append(frame)
        at += len(frame)
    return b"".join(parts), places


def unpack(data: bytes) -> Iterator[bytes]:
    """The records of a file, one after the other."""
    magic, length = struct.unpack_from("<II", data)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame leads the file")
    own = zstandard.ZstdDecompressor().decompress(data[8 : 8 + length])
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(own))
    rest = memoryview(data)[8 + length :]
    while len(rest):
        one = open_.decompressobj()
        parts, at = [], 0
        while not one.eof:
            if at >= len(rest):
                raise ValueError("the last record is cut short")
            step = rest[at : at + (1 << 16)]
            parts.append(one.decompress(step))
            at += len(step)
        yield b"".join(parts)
        rest = rest[at - len(one.unused_data) :]


def _writer(path: str, file_bytes: int, dictionary_bytes: int, level: int, date: str):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        fs.create_dir(folder, recursive=True)
        held: list[tuple] = []
        size = count = 0

        def flush() -> pa.RecordBatch:
            nonlocal held, size, count
            data, places = pack([r for _, _, r in held], dictionary_bytes, level)
            name = f"part-{task.partitionId():06d}-{count:04d}.warc.zst"
            # a task that is tried again gives the same bytes; a whole file takes the name at once
            scratch = f"{folder}/.{name}.{task.taskAttemptId()}-{os.getpid()}"
            with fs.open_output_stream(scratch) as f:
                f.write(data)
            fs.move(scratch, f"{folder}/{name}")
            out = pa.RecordBatch.from_arrays(
                [pa.array([h[0] for h in held], pa.int64()), pa.array([h[1] for h in held], pa.string()), pa.array([name] * len(held)), pa.array([p[0] for p in places], pa.int64()), pa.array([p[1] for p in places], pa.int64())],
                names=["page_id", "url", "file", "offset", "length"],
            )
            held, size, count = [], 0, count + 1
            return out

        for batch in batches:
            for page_id, url, html in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html"))):
                record = record_bytes(page_id, url, html, date)
                held.append((page_id, url, record))
                size += len(record)
                if size >= file_bytes:
                    yield flush()
        if held:
            yield flush()

    return write


def write_warc(pages: DataFrame, path: str, file_bytes: int = 16 << 20, dictionary_bytes: int = 112_640, level: int = 6, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write pages (page_id, url, html) as .warc.zst files under path, which all executors must reach, and return the index (page_id, url, file, offset, length).

    The files are written when the index is computed, once for each task that
    succeeds; a repeated task writes the same bytes under the same name. Every
    row is a record, with nulls in any column too, so a row of nulls comes back
    as one. Repeated rows are repeated records. Very long pages make a record
    each and a file of their own size. An empty table writes nothing. Other
    columns are ignored, whatever their names.
    """
    rows = only(pages, page_id="page_id", url="url", html="html").withColumn("page_id", F.col("page_id").cast("bigint"))
    return rows.mapInArrow(_writer(path, file_bytes, dictionary_bytes, level, date), "page_id bigint, url string, file string, offset bigint, length bigint")


def _reader(path: str):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, folder = pyarrow.fs.FileSystem.from_uri(path)
        for batch in batches:
            for name in batch.column("file").to_pylist():
                with fs.open_input_file(f"{folder}/{name}") as f:
                    data = f.read()
                out, size = [], 0
                for record in unpack(data):
                    out.append(parse_record(record))
                    size += len(record)
                    if size > 4 << 20:
                        yield _pages(out)
                        out, size = [], 0
                yield _pages(out)

    return read


def _pages(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.string()))], names=["page_id", "url", "html"])


def read_warc(files: DataFrame, path: str) -> DataFrame:
    """(page_id, url, html) of all records in the files of path that files names in its column file, each file read once."""
    names = files.select("file").distinct()
    # a task for each file: their names are so few bytes that they would be put together into one
    return names.repartition(max(1, names.count())).mapInArrow(_reader(path), "page_id bigint, url string, html string")


def as_uri(path: str) -> str:
    return path if "://" in path or path.startswith("file:") else f"file://{os.path.abspath(path)}"


def archived(spark: SparkSession, pages: DataFrame, path: str, **options) -> DataFrame:
    """Write pages as an archive under path and read them back from it."""
    uri = as_uri(path)
    index = f"{path}-index"
    write_warc(pages, uri, **options).write.parquet(index)
    return read_warc(spark.read.parquet(index), uri)
