"""Records of web services, read page by page by as many tasks as there are pages: SRU searches and OAI-PMH harvests."""

from __future__ import annotations

import urllib.parse
import urllib.request
import xml.etree.ElementTree as ET

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def _get(url: str, timeout: int = 60) -> bytes:
    if not url.startswith(("http://", "https://")):
        raise ValueError("only http and https addresses are read")
    with urllib.request.urlopen(url, timeout=timeout) as answer:
        return answer.read()


def _local(x: ET.Element) -> str:
    return x.tag.rpartition("}")[2]


def _found(root: ET.Element, name: str) -> list[ET.Element]:
    return [x for x in root.iter() if _local(x) == name]


class _Page(InputPartition):
    def __init__(self, url: str):
        self.value = url


class SruSource(DataSource):
    """Format "sru": (position, record) of a search. Options: url, query, size (records a page, 25)."""

    @classmethod
    def name(cls) -> str:
        return "sru"

    def schema(self) -> str:
        return "position bigint, record string"

    def reader(self, schema) -> DataSourceReader:
        return _SruReader(self.options)


class _SruReader(DataSourceReader):
    def __init__(self, options):
        self.url, self.query, self.size = options["url"], options["query"], int(options.get("size", 25))

    def _address(self, start: int, maximum: int) -> str:
        return self.url + "?" + urllib.parse.urlencode({"operation": "searchRetrieve", "version": "1.1", "query": self.query, "startRecord": start, "maximumRecords": maximum})

    def partitions(self):
        numbers = _found(ET.fromstring(_get(self._address(1, 1))), "numberOfRecords")
        total = int(numbers[0].text) if numbers else 0
        return [_Page(self._address(at, self.size)) for at in range(1, total + 1, self.size)]

    def read(self, partition):
        start = int(urllib.parse.parse_qs(urllib.parse.urlsplit(partition.value).query)["startRecord"][0])
        for k, data in enumerate(_found(ET.fromstring(_get(partition.value)), "recordData")):
            inner = list(data)
            yield start + k, ET.tostring(inner[0], encoding="unicode").strip() if inner else data.text


class OaiSource(DataSource):
    """Format "oai": (identifier, datestamp, deleted, record) of a harvest. Options: url, prefix (oai_dc), from, until. A list's pages follow from each other, so it is one task."""

    @classmethod
    def name(cls) -> str:
        return "oai"

    def schema(self) -> str:
        return "identifier string, datestamp string, deleted boolean, record string"

    def reader(self, schema) -> DataSourceReader:
        return _OaiReader(self.options)


class _OaiReader(DataSourceReader):
    def __init__(self, options):
        asked = {"verb": "ListRecords", "metadataPrefix": options.get("prefix", "oai_dc")} | {k: options[k] for k in ("from", "until") if options.get(k)}
        self.base, self.first = options["url"], options["url"] + "?" + urllib.parse.urlencode(asked)

    def partitions(self):
        return [_Page(self.first)]

    def read(self, partition):
        url = partition.value
        while url:
            root = ET.fromstring(_get(url))
            for record in _found(root, "record"):
                header = _found(record, "header")[0]
                text = {_local(x): x.text for x in header}
                held = [list(x)[0] for x in _found(record, "metadata") if len(x)]
                yield text.get("identifier"), text.get("datestamp"), header.get("status") == "deleted", ET.tostring(held[0], encoding="unicode") if held else None
            token = next((x.text for x in _found(root, "resumptionToken") if x.text), None)
            url = self.base + "?" + urllib.parse.urlencode({"verb": "ListRecords", "resumptionToken": token}) if token else None


def register(spark) -> None:
    """Make spark.read.format("sru") and ("oai") known to a session."""
    spark.dataSource.register(SruSource)
    spark.dataSource.register(OaiSource)
