"""Records: elements of XML text selected by paths, their whole text, spans, components and rules of TEI."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE = "array<struct<path:string,elem:int,text:string>>"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse(record: str) -> ET.Element | None:
    """The root of a record, or null if it isn't well-formed."""
    try:
        return ET.fromstring(record)
    except ET.ParseError:
        return None


def _path(path: str, names: dict[str, str]) -> tuple[str, str | None]:
    """The path as ElementTree takes it, and the attribute at its end. Relative paths are looked for anywhere."""
    attribute = None
    m = re.search(r"/?@([\w:.-]+)$", path)
    if m:
        attribute, path = m[1], path[: m.start()]
        if ":" in attribute:
            prefix, local = attribute.split(":")
            attribute = f"{{{names.get(prefix, prefix)}}}{local}"
    path = re.sub(r"/?text\(\)$", "", path)
    return path, attribute


def nodes(root: ET.Element, path: str, names: dict[str, str]) -> list[tuple[ET.Element, str | None]]:
    """The elements that a path selects in document order, and the attribute that it asks for."""
    path, attribute = _path(path, names)
    holder = ET.Element("root-of-all")
    holder.append(root)
    if path.startswith("//") or not path.startswith("/"):
        found = holder.findall(f".//{path.lstrip('/')}" if path.strip("/") else ".//*", names)
    else:
        found = holder.findall(f".{path}", names)
    return [(x, attribute) for x in found if attribute is None or attribute in x.attrib]


def flat_text(element: ET.Element, spaced: tuple[str, ...] = ()) -> str:
    """All text below an element; elements named in ``spaced`` stand apart."""
    out: list[str] = []

    def walk(x: ET.Element) -> None:
        apart = x.tag in spaced
        if apart:
            out.append(" ")
        out.append(x.text or "")
        for child in x:
            walk(child)
            out.append(child.tail or "")
        if apart:
            out.append(" ")

    walk(element)
    return "".join(out)


def _order(root: ET.Element) -> dict[ET.Element, int]:
    return {x: k for k, x in enumerate(root.iter())}


def selected(record: Column | str, paths: list[str] | str, namespaces: dict[str, str] | None = None, spaced: tuple[str, ...] = (), strip: bool = True) -> Column:
    """(path, elem, text) of every element or attribute that the paths select: its place in the document, and its text with that of all elements below, line ends as spaces. A record that isn't well-formed has none."""
    names, listed = namespaces or {}, [paths] if isinstance(paths, str) else list(paths)

    @F.pandas_udf(NODE)
    def select(records: pd.Series) -> pd.Series:
        def one(record):
            root = parse(record) if record is not None else None
            if root is None:
                return [] if record is not None else None
            order, out = _order(root), []
            for path in listed:
                for x, attribute in nodes(root, path, names):
                    text = x.attrib[attribute] if attribute else flat_text(x, spaced)
                    text = re.sub(r"[\r\n]", " ", text)
                    out.append({"path": path, "elem": order[x], "text": text.strip() if strip else text})
            return out

        return records.map(one)

    return select(_col(record))


def texts(record: Column | str, paths: list[str] | str, **options) -> Column:
    """The texts alone."""
    return F.transform(selected(record, paths, **options), lambda x: x["text"])


def extracted_terms(rows: DataFrame, key: str, record: str, paths: list[str] | str, **options) -> DataFrame:
    """(key, text, occs, elems): the texts that the paths select in each record, equal ones as one, with the places of their elements."""
    each = rows.select(key, F.explode(selected(record, paths, **options)).alias("x"))
    return each.groupBy(key, F.col("x.text").alias("text")).agg(F.count("*").alias("occs"), F.array_sort(F.collect_list("x.elem")).alias("elems"))


def well_formed(record: Column | str) -> Column:
    @F.pandas_udf("boolean")
    def test(records: pd.Series) -> pd.Series:
        return records.map(lambda x: None if x is None else parse(x) is not None)

    return test(_col(record))


# spans


def _events(root: ET.Element) -> Iterator[tuple[str, ET.Element]]:
    yield "start", root
    for child in root:
        yield from _events(child)
        yield "tail", child
    yield "end", root


def _span_texts(root: ET.Element, start: str, end: str, names: dict[str, str]) -> list[str]:
    starts = {x for x, _ in nodes(root, start, names)}
    ends = {x for x, _ in nodes(root, end, names)}
    same = start == end
    out: list[str] = []
    current: list[str] | None = None
    for kind, x in _events(root):
        if kind == "start":
            if x in ends and current is not None:
                out.append("".join(current))
                current = None
            if x in starts and current is None:
                current = []
            if current is not None:
                current.append(x.text or "")
        elif kind == "tail" and current is not None:
            current.append(x.tail or "")
    if current is not None and same and "".join(current).strip():
        out.append("".join(current))
    return [re.sub(r"\s+", " ", x).strip() for x in out]


def span_texts(record: Column | str, start: str, end: str, namespaces: dict[str, str] | None = None) -> Column:
    """The text from each start to the nearest end after it. Where both paths are the same, its elements are the breaks, and the last span goes to the end of the record."""
    names = namespaces or {}

    @F.pandas_udf("array<string>")
    def cut(records: pd.Series) -> pd.Series:
        def one(record):
            root = parse(record) if record is not None else None
            return None if record is None else [] if root is None else _span_texts(root, start, end, names)

        return records.map(one)

    return cut(_col(record))


# components


def components(rows: DataFrame, key: str, record: str, paths: list[str] | str, namespaces: dict[str, str] | None = None) -> DataFrame:
    """(key, part, path, component): each selected element of a record as a document of its own, nested ones too, with its record's key."""
    names, listed = namespaces or {}, [paths] if isinstance(paths, str) else list(paths)

    @F.pandas_udf("array<struct<path:string,component:string>>")
    def split(records: pd.Series) -> pd.Series:
        def one(record):
            root = parse(record) if record is not None else None
            if root is None:
                return []
            out = []
            for path in listed:
                for x, _ in nodes(root, path, names):
                    tail, x.tail = x.tail, None
                    out.append({"path": path, "component": ET.tostring(x, encoding="unicode")})
                    x.tail = tail
            return out

        return records.map(one)

    each = rows.select(key, F.posexplode(split(_col(record))).alias("part", "x"))
    return each.select(key, "part", F.col("x.path").alias("path"), F.col("x.component").alias("component"))


# TEI


def _tei(element: ET.Element) -> str:
    out: list[str] = []

    def walk(x: ET.Element, case) -> None:
        tag = x.tag.rpartition("}")[2] if isinstance(x.tag, str) else ""
        if tag in ("sic", "abbr"):
            out.append(x.attrib.get("corr" if tag == "sic" else "expan", ""))
        elif tag.lower() != "figdesc":
            own = {"uc": str.upper, "lc": str.lower}.get(tag, case)
            if tag == "p":
                out.append(" ")
            out.append(own(x.text or ""))
            for child in x:
                walk(child, own)
                out.append(own(child.tail or ""))

    walk(element, lambda s: s)
    return re.sub(r"\s+", " ", "".join(out)).replace("- ", "").strip()


def tei_text(record: Column | str) -> Column:
    """The text of a TEI record: uc and lc change the case, sic and abbr give way to their correction and expansion, paragraphs stand apart, descriptions of figures go, words cut at line ends are joined."""

    @F.pandas_udf("string")
    def read(records: pd.Series) -> pd.Series:
        def one(record):
            root = parse(record) if record is not None else None
            return None if root is None else _tei(root)

        return records.map(one)

    return read(_col(record))


# tagged corpora


def tagged_terms(record: Column | str, within: str = "toks") -> Column:
    """(token, pos, stem, offset) of the words <w p= s= o=> of a tagged record."""

    @F.pandas_udf("array<struct<token:string,pos:string,stem:string,offset:int>>")
    def read(records: pd.Series) -> pd.Series:
        def one(record):
            root = parse(record) if record is not None else None
            if root is None:
                return None
            found = [w for t in ([root] if root.tag == within else root.iter(within)) for w in t.iter("w")]
            return [{"token": flat_text(w), "pos": w.get("p"), "stem": w.get("s"), "offset": int(w.get("o", -1))} for w in found]

        return records.map(one)

    return read(_col(record))


def corpus_markup(text: Column | str, eid: Column | str) -> Column:
    """Sentence and word markup of a text: <toks> with <w o=offset> for each word, under an element id."""
    from textloom.functions.documents import escaped
    from textloom.functions.tokens import found_with_offsets

    words = F.transform(found_with_offsets(text, r"\w+"), lambda x: F.concat(F.lit('<w o="'), x["offset"].cast("string"), F.lit('">'), x["token"], F.lit("</w>")))
    return F.concat(F.lit('<s eid="'), _col(eid).cast("string"), F.lit('"><txt>'), escaped(text), F.lit("</txt><toks>"), F.array_join(words, ""), F.lit("</toks></s>"))


# presentation


def templated(template: str, **columns: Column) -> Column:
    """The template with {name} replaced by columns; null counts as empty."""
    parts = []
    for piece in re.split(r"(\{\w+\})", template):
        m = re.fullmatch(r"\{(\w+)\}", piece)
        parts.append(F.coalesce(columns[m[1]].cast("string"), F.lit("")) if m else F.lit(piece))
    return F.concat(*parts)


def highlighted(text: Column | str, terms: list[str], tag: str = "em") -> Column:
    """The text with whole words that are among the terms, in any case, inside an element."""
    if not terms:
        return _col(text)
    listed = "|".join(re.escape(t) for t in sorted(terms, key=len, reverse=True))
    return F.regexp_replace(_col(text), rf"(?i)(?<![\p{{L}}\p{{N}}])({listed})(?![\p{{L}}\p{{N}}])", f"<{tag}>$1</{tag}>")


def highlighted_at(text: Column | str, offsets: Column, tag: str = "em") -> Column:
    """The text with the words that begin at some offsets (in characters) inside an element; elements of the text stay whole."""

    @F.pandas_udf("string")
    def mark(texts: pd.Series, places: pd.Series) -> pd.Series:
        out = []
        for text, at in zip(texts, places):
            if text is not None and at is not None:
                for k in sorted({int(x) for x in at}, reverse=True):
                    m = re.compile(r"[^\W_]+").match(text, k)
                    if m:
                        text = f"{text[:k]}<{tag}>{m.group()}</{tag}>{text[m.end():]}"
            out.append(text)
        return pd.Series(out, dtype=object)

    return mark(_col(text), offsets)


def in_context(text: Column | str, term: str, width: int = 40) -> Column:
    """(left, hit, right) of each place of a word, with so many characters around it."""
    found = F.regexp_extract_all(_col(text), F.lit(rf"(?is)(.{{0,{width}}})(?<![\p{{L}}\p{{N}}])({re.escape(term)})(?![\p{{L}}\p{{N}}])(?=(.{{0,{width}}}))"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_replace(x, rf"(?is){re.escape(term)}$", "").alias("left"), F.regexp_extract(x, rf"(?is)({re.escape(term)})$", 1).alias("hit")))
