"""MARC 21 records: binary to fields, to XML and SGML, and back."""

from __future__ import annotations

import xml.etree.ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.functions.documents import mapped

FIELD_END, RECORD_END, SUBFIELD = b"\x1e", b"\x1d", b"\x1f"
FIELDS = "struct<leader:string,fields:array<struct<tag:string,ind:string,data:string,subfields:array<struct<code:string,value:string>>>>>"


def read_fields(raw: bytes) -> dict:
    """Leader and fields of one binary record. Control fields have data, the others indicators and subfields."""
    raw = raw.rstrip(RECORD_END)
    if len(raw) < 25 or not raw[12:17].isdigit():
        raise ValueError("not a MARC record")
    base = int(raw[12:17])
    codec = "utf-8" if raw[9:10] == b"a" else "latin-1"
    directory, fields = raw[24 : base - 1], []
    for k in range(0, len(directory) - 11, 12):
        tag, length, start = directory[k : k + 3].decode(), int(directory[k + 3 : k + 7]), int(directory[k + 7 : k + 12])
        body = raw[base + start : base + start + length].rstrip(FIELD_END)
        if tag < "010":
            fields.append({"tag": tag, "ind": None, "data": body.decode(codec, "replace"), "subfields": []})
        else:
            parts = body.split(SUBFIELD)
            fields.append({"tag": tag, "ind": parts[0].decode(codec, "replace"), "data": None, "subfields": [{"code": p[:1].decode(codec, "replace"), "value": p[1:].decode(codec, "replace")} for p in parts[1:] if p]})
    return {"leader": raw[:24].decode("latin-1"), "fields": fields}


def write_fields(record: dict) -> bytes:
    """One binary record in UTF-8 of a leader and fields."""
    directory, body = b"", b""
    for f in record["fields"]:
        if f["tag"] < "010":
            data = (f["data"] or "").encode()
        else:
            data = (f["ind"] or "  ").encode() + b"".join(SUBFIELD + (s["code"] + s["value"]).encode() for s in f["subfields"])
        data += FIELD_END
        directory += f["tag"].encode() + b"%04d%05d" % (len(data), len(body))
        body += data
    base = 24 + len(directory) + 1
    leader = record["leader"].encode("latin-1").ljust(24)
    leader = b"%05d" % (base + len(body) + 1) + leader[5:9] + b"a" + leader[10:12] + b"%05d" % base + leader[17:24]
    return leader + directory + FIELD_END + body + RECORD_END


def _xml(record: dict) -> str:
    out = [f'<record xmlns="http://www.loc.gov/MARC21/slim"><leader>{escape(record["leader"])}</leader>']
    for f in record["fields"]:
        if f["tag"] < "010":
            out.append(f'<controlfield tag="{f["tag"]}">{escape(f["data"])}</controlfield>')
        else:
            ind = (f["ind"] or "").ljust(2)
            inner = "".join(f"<subfield code={quoteattr(s['code'])}>{escape(s['value'])}</subfield>" for s in f["subfields"])
            out.append(f'<datafield tag="{f["tag"]}" ind1={quoteattr(ind[0])} ind2={quoteattr(ind[1])}>{inner}</datafield>')
    return "".join([*out, "</record>"])


def _sgml(record: dict) -> str:
    def inner(f: dict) -> str:
        return escape(f["data"]) if f["tag"] < "010" else "".join(f"<{s['code']}>{escape(s['value'])}" for s in f["subfields"])

    return "<usmarc><leader>" + escape(record["leader"]) + "</leader>" + "".join(f"<fld{f['tag']}>{inner(f)}</fld{f['tag']}>" for f in record["fields"]) + "</usmarc>"


def _from_xml(text: str) -> bytes:
    root = ET.fromstring(text)
    local = lambda x: x.tag.rpartition("}")[2]
    record: dict = {"leader": "", "fields": []}
    for x in root.iter():
        if local(x) == "leader":
            record["leader"] = x.text or ""
        elif local(x) == "controlfield":
            record["fields"].append({"tag": x.get("tag"), "data": x.text or "", "ind": None, "subfields": []})
        elif local(x) == "datafield":
            record["fields"].append({"tag": x.get("tag"), "data": None, "ind": (x.get("ind1") or " ") + (x.get("ind2") or " "), "subfields": [{"code": s.get("code"), "value": s.text or ""} for s in x]})
    return write_fields(record)


def fields(raw: Column | str) -> Column:
    """leader and fields (tag, ind, data, subfields) of a binary record; null if it can't be read."""
    return F.get(mapped(raw, lambda x: [read_fields(bytes(x))], f"array<{FIELDS}>"), 0)


def to_xml(raw: Column | str) -> Column:
    return mapped(raw, lambda x: _xml(read_fields(bytes(x))))


def to_sgml(raw: Column | str) -> Column:
    return mapped(raw, lambda x: _sgml(read_fields(bytes(x))))


def from_xml(text: Column | str) -> Column:
    return mapped(text, _from_xml, "binary")


def values(record: Column, tag: str, code: str) -> Column:
    """The values of a subfield in all fields of a tag."""
    held = F.filter(record["fields"], lambda f: f["tag"] == tag)
    return F.flatten(F.transform(held, lambda f: F.transform(F.filter(f["subfields"], lambda s: s["code"] == code), lambda s: s["value"])))


def marc_records(spark: SparkSession, path: str) -> DataFrame:
    """(path, part, raw): the records of files of MARC, in order."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    cut = mapped("content", lambda x: [p + RECORD_END for p in bytes(x).split(RECORD_END) if p.strip()], "array<binary>")
    return files.select("path", F.posexplode(cut).alias("part", "raw"))
