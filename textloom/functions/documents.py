"""Documents to documents: repairs, encodings, compression, checksums, and wrapping of raw data."""

from __future__ import annotations

import bz2
import email
import gzip
import html.entities
import io
import re
import zipfile
from collections.abc import Callable
from html.parser import HTMLParser
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from textloom.functions import analysis as A


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mapped(c: Column | str, f: Callable, kind: str = "string") -> Column:
    """f of every value that isn't null, in Arrow batches; what f can't read is null."""

    @F.pandas_udf(kind)
    def each(values: pd.Series) -> pd.Series:
        def one(x):
            if x is None:
                return None
            try:
                return f(x)
            except (ValueError, OSError, EOFError, zipfile.BadZipFile, SyntaxError):
                return None

        return values.map(one)

    return each(_col(c))


# encodings and compression


def decoded(raw: Column | str, codec: str = "UTF-8") -> Column:
    return F.decode(_col(raw), codec)


def gzipped(raw: Column | str) -> Column:
    return mapped(raw, lambda x: gzip.compress(x.encode() if isinstance(x, str) else bytes(x), mtime=0), "binary")


def gunzipped(raw: Column | str) -> Column:
    return mapped(raw, lambda x: gzip.decompress(bytes(x)), "binary")


def bzipped(raw: Column | str) -> Column:
    return mapped(raw, lambda x: bz2.compress(x.encode() if isinstance(x, str) else bytes(x)), "binary")


def bunzipped(raw: Column | str) -> Column:
    return mapped(raw, lambda x: bz2.decompress(bytes(x)), "binary")


def to_base64(raw: Column | str) -> Column:
    return F.base64(_col(raw).cast("binary"))


def from_base64(text: Column | str) -> Column:
    return F.unbase64(_col(text))


def checksum(raw: Column | str, kind: str = "md5") -> Column:
    """A digest in hexadecimal: md5, sha1, sha224, sha256, sha384 or sha512."""
    data = _col(raw).cast("binary")
    if kind == "md5":
        return F.md5(data)
    if kind == "sha1":
        return F.sha1(data)
    return F.sha2(data, int(kind.removeprefix("sha")))


def word_count(text: Column | str) -> Column:
    """Words between white space; 0 of an empty text."""
    trimmed = F.trim(F.regexp_replace(_col(text), r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


# kinds of documents

_MAGIC = [("%PDF", "application/pdf"), ("PK\x03\x04", "application/zip"), ("\x1f\x8b", "application/gzip"), ("BZh", "application/x-bzip2"), ("\x89PNG", "image/png"), ("\xff\xd8\xff", "image/jpeg"), ("GIF8", "image/gif")]


def mime_type(raw: Column | str) -> Column:
    """The kind of some raw data, by how it begins."""
    data = _col(raw).cast("binary")
    head = F.hex(F.substring(data, 1, 8))
    start = F.lower(F.trim(F.substring(F.decode(data, "ISO-8859-1"), 1, 256)))
    test = F.when(data.isNull(), None)
    for magic, kind in _MAGIC:
        test = test.when(head.startswith(magic.encode("latin-1").hex().upper()), kind)
    test = test.when(start.startswith("<?xml"), "text/xml").when(start.startswith("<!doctype html") | start.startswith("<html"), "text/html").when(start.startswith("<"), "text/xml")
    return test.when(head.rlike("^(?:..)*0[0-8]"), "application/octet-stream").otherwise("text/plain")


def redirected(mime: Column | str, raw: Column | str, by: dict[str, Callable[[Column], Column]]) -> Column:
    """Of each row what the function for its kind makes of it; * stands for any other kind, which without it stays."""
    out = None
    for kind, f in by.items():
        if kind != "*":
            out = (F if out is None else out).when(_col(mime) == kind, f(_col(raw)))
    rest = by["*"](_col(raw)) if "*" in by else _col(raw)
    return rest if out is None else out.otherwise(rest)


# markup


def lone_ampersands(text: Column | str) -> Column:
    """Ampersands that begin no reference, escaped."""
    return F.regexp_replace(_col(text), r"&(?!(?:[A-Za-z][A-Za-z0-9]*|#[0-9]+|#x[0-9A-Fa-f]+);)", "&amp;")


def escaped(text: Column | str) -> Column:
    out = _col(text)
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def text_to_xml(text: Column | str, tag: str = "data") -> Column:
    return F.concat(F.lit(f"<{tag}>"), escaped(text), F.lit(f"</{tag}>"))


def _sgml(text: str, empty: list[str]) -> str:
    text = re.sub(r"&#(9|1[0-3]);|[\r\n]", " ", text)
    text = re.sub(r"<!DOCTYPE[^>\[]*(?:\[[^\]]*\])?\s*>", "", text, flags=re.I)
    text = re.sub(r"<\?.*?\?>", "", text, flags=re.S)

    def tag(m: re.Match) -> str:
        close, name, rest = m[1], m[2].lower(), m[3]
        attributes = "".join(f" {a.lower()}={quoteattr(v1 or v2 or v3)}" for a, v1, v2, v3 in re.findall(r"""([\w:.-]+)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>/]+))""", rest))
        return f"<{close}{name}{attributes}{'/' if not close and (name in empty or rest.rstrip().endswith('/')) else ''}>"

    parts = re.split(r"(<[^>]*>)", text)
    out = [re.sub(r"^<(/?)([A-Za-z][\w.-]*)(.*)>$", tag, p, flags=re.S) if p.startswith("<") else re.sub(r"&(?![#\w]+;)", "&amp;", p) for p in parts]
    return "".join(out)


def sgml_to_xml(text: Column | str, empty: list[str] | None = None) -> Column:
    """SGML with small names, quoted attributes, closed empty elements, and without its document type and instructions."""
    names = [x.lower() for x in empty or []]
    return mapped(text, lambda x: _sgml(x, names))


_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
_CLOSES = {"li": {"li"}, "p": {"p"}, "td": {"td", "th"}, "th": {"td", "th"}, "tr": {"tr", "td", "th"}, "option": {"option"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}}


class _Fixer(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out: list[str] = []
        self.open: list[str] = []

    def handle_starttag(self, tag, attrs):
        while self.open and self.open[-1] in _CLOSES.get(tag, ()):
            self.out.append(f"</{self.open.pop()}>")
        seen = {a: v for a, v in attrs if re.fullmatch(r"[A-Za-z_][\w.-]*", a)}
        written = "".join(f" {a}={quoteattr(v if v is not None else a)}" for a, v in seen.items())
        self.out.append(f"<{tag}{written}{'/' if tag in _VOID else ''}>")
        if tag not in _VOID:
            self.open.append(tag)

    def handle_endtag(self, tag):
        if tag in self.open:
            while True:
                top = self.open.pop()
                self.out.append(f"</{top}>")
                if top == tag:
                    break

    def handle_data(self, data):
        self.out.append(escape(re.sub("[\x00-\x08\x0b\x0c\x0e-\x1f]", " ", data)))


def _fixed_html(text: str) -> str:
    fixer = _Fixer()
    fixer.feed(text)
    fixer.close()
    body = "".join(fixer.out) + "".join(f"</{x}>" for x in reversed(fixer.open))
    return body if body.lstrip().startswith("<html") else f"<html>{body}</html>"


def html_to_xml(text: Column | str) -> Column:
    """Well-formed markup out of any HTML: open elements closed, attributes quoted, references resolved, comments gone."""
    return mapped(text, _fixed_html)


def printable(text: Column | str, strip: bool = False) -> Column:
    """Control characters as spaces; braces, the bar, the tilde and Latin-1 signs as numeric references, or stripped."""
    from textloom.functions.tokens import numeric_entities

    out = F.regexp_replace(_col(text), "[\x00-\x08\x0b\x0c\x0e-\x1f]", " ")
    for a, b in (("“", "&quot;"), ("”", "&quot;"), ("„", "&quot;"), ("–", "-"), ("‘", "'"), ("’", "'"), ("‚", ","), ("\xa0", " ")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.regexp_replace(out, "[\x7b-\xff]", "") if strip else numeric_entities(out, "[\x7b-\xff]")


def _entities(text: str) -> str:
    def named(m: re.Match) -> str:
        name = m[1]
        frac = re.fullmatch(r"frac(\d)(\d)", name)
        if name in html.entities.name2codepoint:
            return f"&#{html.entities.name2codepoint[name]};"
        return f"{frac[1]}&#8260;{frac[2]}" if frac else m[0]

    text = re.sub(r"&(\d+);", r"&#\1;", text)
    text = re.sub(r"&([A-Za-z]\w*);", named, text)
    return re.sub(r"&#(?:\d|[0-2]\d|3[01]);", "", text)


def numeric_references(text: Column | str) -> Column:
    """Named and broken character references as numeric ones; those of control characters go."""
    return mapped(text, _entities)


def _mail(raw: str) -> str:
    def headers(part) -> str:
        return "<headers>" + "".join(f"<{k}>{escape(str(v))}</{k}>" for k, v in part.items()) + "</headers>"

    def payload(part) -> str:
        if part.is_multipart():
            return "<multipart>" + "".join(f"<part>{headers(p)}{payload(p)}</part>" for p in part.get_payload()) + "</multipart>"
        body = part.get_payload(decode=True) or b""
        return f"<body mime-type={quoteattr(part.get_content_type())}>{escape(body.decode(part.get_content_charset() or 'utf-8', 'replace'))}</body>"

    message = email.message_from_string(raw)
    return f"<email>{headers(message)}{payload(message)}</email>"


def email_to_xml(raw: Column | str) -> Column:
    """A mail's headers, and its body or parts, as elements."""
    return mapped(raw, _mail)


def mets_wrapped(raw: Column | str, name: Column | str, mime: str = "text/plain") -> Column:
    """Raw data in Base64 inside a METS envelope."""
    head = '<mets:mets xmlns:mets="http://www.loc.gov/METS/" OBJID="'
    section = f'"><mets:fileSec><mets:fileGrp><mets:file ID="F0" MIMETYPE="{mime}" CHECKSUMTYPE="MD5" CHECKSUM="'
    return F.concat(F.lit(head), escaped(name), F.lit(section), F.md5(_col(raw).cast("binary")), F.lit('"><mets:FContent><mets:binData>'), to_base64(raw), F.lit("</mets:binData></mets:FContent></mets:file></mets:fileGrp></mets:fileSec></mets:mets>"))


def _zip_mets(data: bytes) -> str:
    import base64

    out = ['<mets:mets xmlns:mets="http://www.loc.gov/METS/"><mets:fileSec><mets:fileGrp>']
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for k, member in enumerate(x for x in z.infolist() if not x.is_dir()):
            out.append(f"<mets:file ID=\"F{k}\" OWNERID={quoteattr(member.filename)}><mets:FContent><mets:binData>{base64.b64encode(z.read(member)).decode()}</mets:binData></mets:FContent></mets:file>")
    return "".join([*out, "</mets:fileGrp></mets:fileSec></mets:mets>"])


def zip_to_mets(raw: Column | str) -> Column:
    return mapped(raw, lambda x: _zip_mets(bytes(x)))


def regexp_smashed(text: Column | str, pattern: str, by: str = "", keep: bool = False) -> Column:
    """What a pattern (of any number of lines) matches, replaced; or keep: only that."""
    pattern = f"(?s){pattern}"
    return A.keep_pattern(text, pattern) if keep else A.strip_pattern(text, pattern, by)


def piped(rows, column: str, command: list[str]):
    """rows with a text column sent through a program, one process for each row; a program that fails gives null. Only for trusted commands, which every executor must have."""
    import subprocess

    def run(text: str):
        done = subprocess.run(command, input=text.encode(), capture_output=True, timeout=600, check=False)
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None

    return rows.withColumn(column, mapped(column, run))
