"""HTML extraction with site style trees.

The DOMs of all pages of a host are merged into one tree, in which an element
node has a style node for each sequence of children's presentations that occurs
below it. A node that is presented in many ways, or whose contents differ from
page to page, is important; one that looks and reads the same everywhere isn't.
Importance is entropy: of the styles below an element, and of each content
feature over the pages; inner nodes combine both from the leaves upwards.
Branches in which every node is of low importance are removed from each page.

Children of equal presentation in a row count as one child, so that lists and
articles of different lengths share a style. Contents are whole runs of text,
link targets and image sources.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import BROADCAST_BYTES, only, settle

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template)\b.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*+>",
    re.S | re.I,
)
_ATTRIBUTE = re.compile(r"\b(class|width|height|bgcolor|align|href|src)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_VOID = frozenset("area base br col embed hr input link meta param source track wbr".split())
#: An open element of the value's kind ends where the key begins.
_ENDS = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
_BLOCKS = {"p", "div", "ul", "ol", "li", "dl", "table", "tr", "td", "th", "h1", "h2", "h3", "h4", "h5", "h6", "article", "section", "nav", "footer", "header", "aside", "main", "form", "pre", "blockquote", "body", "title", "head"}
_ENTITY = re.compile(r"&(?:#\d{1,7}|#[xX][0-9a-fA-F]{1,6}|\w{2,31});?")
_BLANKS = re.compile(r"\s+")


class Node:
    __slots__ = ("label", "children", "text", "features")

    def __init__(self, label: str, text: str | None = None):
        self.label, self.children, self.text, self.features = label, [], text, ()


def _unescape(text: str) -> str:
    from html import unescape

    return _ENTITY.sub(lambda m: unescape(m[0]), text) if "&" in text else text


def parse(html: str) -> Node:
    """The DOM of a page: elements with their presentation as label, and leaves #text and #link. Ill-formed pages give some tree too."""
    root = Node("#page")
    stack = [root]
    at = 0
    for m in _TOKEN.finditer(html):
        if m.start() > at:
            _add_text(stack[-1], html[at : m.start()])
        at = m.end()
        name = m[3]
        if not name:
            continue
        name = name.lower()
        if m[2]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].label.partition(".")[0] == name:
                    del stack[k:]
                    break
            continue
        if name == "br":
            _add_text(stack[-1], "\n")
            continue
        ends = _ENDS.get(name)
        if ends and len(stack) > 1 and stack[-1].label.partition(".")[0] in ends:
            kind = stack.pop().label.partition(".")[0]
            if name == "tr" and kind in ("td", "th") and stack[-1].label.partition(".")[0] == "tr":
                stack.pop()
        look, links = [], []
        if m[4]:
            for a in _ATTRIBUTE.finditer(m[4]):
                value = a[2] or a[3] or a[4] or ""
                key = a[1].lower()
                (links if key in ("href", "src") else look).append(value if key in ("href", "src") else f"{key}={value}")
        node = Node(".".join([name, *sorted(look)]))
        if name not in _VOID or links and name not in ("link", "base"):
            for link in links:
                leaf = Node("#link")
                leaf.features = (link,)
                node.children.append(leaf)
            stack[-1].children.append(node)
            if name not in _VOID and name != "img" and not m[4].endswith("/"):
                stack.append(node)
    if at < len(html):
        _add_text(stack[-1], html[at:])
    return root


def _add_text(parent: Node, text: str) -> None:
    if parent.children and parent.children[-1].label == "#text":
        leaf = parent.children[-1]
        leaf.text += text
    elif text.strip():
        leaf = Node("#text", text)
        parent.children.append(leaf)
    else:
        return
    leaf.features = (leaf.text,)


def _runs(node: Node) -> tuple[str, list[list[Node]]]:
    """The style below a node, and its children by runs of equal labels."""
    runs: list[list[Node]] = []
    for child in node.children:
        if runs and runs[-1][0].label == child.label:
            runs[-1].append(child)
        else:
            runs.append([child])
    return ">".join(r[0].label for r in runs), runs


def _id(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


def _host_of(url: Column) -> Column:
    """A hash that names the url's host."""
    return F.xxhash64(F.coalesce(F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.\-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit("")))


def _surveyor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each page says about its host's tree, added up over the batch: how many pages have a node, how many present it so, how often a leaf has a content."""
    for batch in batches:
        total: dict[tuple, list] = {}
        for key, html in zip(batch.column("host").to_pylist(), batch.column("html").to_pylist()):
            if not html:
                continue
            todo = [(parse(html), _id(f"{key}"), 0, 0)]
            seen: set = set()
            contents: dict[tuple, int] = {}
            while todo:
                node, name, above, depth = todo.pop()
                place = (key, name, above, depth)
                if node.features:
                    seen.add((*place, True, None, False))
                    for feature in node.features:
                        k = (*place, True, _id(_BLANKS.sub(" ", feature).strip()), False)
                        contents[k] = contents.get(k, 0) + 1
                    continue
                style, runs = _runs(node)
                below = _id(f"{name}|{style}")
                seen.add((*place, False, None, False))
                seen.add((*place, False, below, bool(runs)))
                for i, run in enumerate(runs):
                    child = _id(f"{below}|{i}")
                    todo += [(x, child, below, depth + 1) for x in run]
            for k in seen:
                entry = total.setdefault(k, [0, 0.0])
                entry[0] += 1
            for k, n in contents.items():
                entry = total.setdefault(k, [0, 0.0])
                entry[0] += n
                entry[1] += n * math.log(n)
        if total:
            names = ["host", "node", "above", "depth", "leaf", "item", "kids"]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.bool_()]
            rows = list(total)
            values = list(total.values())
            yield pa.RecordBatch.from_arrays([*(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)), pa.array([v[0] for v in values], pa.int64()), pa.array([v[1] for v in values])], names=[*names, "n", "q"])


_SURVEY = "host bigint, node bigint, above bigint, depth int, leaf boolean, item bigint, kids boolean, n bigint, q double"


def composite(gamma: float, styles: list[tuple[int, int]], once: int, hollow: int, m: int, below: dict[int, list]) -> float:
    """The importance of an element on m pages with so many pages of each style, ``once`` styles of one page each with children, and ``hollow`` ones without. below: of each style, the sum and number of its children's importances; what stands on one page has all importance."""
    if m <= 1:
        return 1.0
    total = sum(n for _, n in styles) + once + hollow
    spread = -sum(n / total * math.log(n / total) for _, n in styles) + (once + hollow) / total * math.log(total)
    inner = once / total
    for style, n in styles:
        s, k = below.get(style, (0.0, 0))[:2]
        inner += n / total * (s / k if k else 0.0)
    fade = gamma ** (len(styles) + once + hollow)
    return (1 - fade) * min(1.0, spread / math.log(m)) + fade * inner


def _weigher(gamma: float):
    """Importances from the leaves upwards; rows come by host, deepest first."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, current, below = None, {}, {}  # below: by style node, of the level under the current one
        for batch in batches:
            out = []
            cols = [batch.column(c).to_pylist() for c in ("host", "node", "above", "depth", "leaf", "m", "entropy", "styles", "once", "hollow")]
            for host, node, above, depth, leaf, m, entropy, styles, once, hollow in zip(*cols):
                if at != (host, depth):
                    below = current if at and at == (host, depth + 1) else {}
                    at, current = (host, depth), {}
                if leaf:
                    value = 1.0 if m <= 1 else max(0.0, 1 - entropy / math.log(m))
                    best = value
                else:
                    value = composite(gamma, [(s["item"], s["n"]) for s in styles], once, hollow, m, below)
                    best = max([value, float(once > 0), *(below[s["item"]][2] for s in styles if s["item"] in below)])
                entry = current.setdefault(above, [0.0, 0, 0.0])
                entry[0] += value
                entry[1] += 1
                entry[2] = max(entry[2], best)
                out.append((host, node, m, value, best))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64()))], names=["host", "node", "pages", "importance", "best"])

    return weigh


def importances(pages: DataFrame, gamma: float = 0.9) -> DataFrame:
    """(host, node, pages, importance, best) of the nodes of every host's style tree that stand on two pages at least, best being the highest importance of the node and all below it; hosts and nodes are named by hashes.

    What stands on one page only has all importance, and is counted where it
    hangs, so that a host's tree is as large as what repeats on it, however
    many pages it has.
    """
    rows = pages.select(_host_of(F.col("url")).alias("host"), F.col("html").alias("html"))
    key = ["host", "node", "above", "depth", "leaf"]
    items = rows.mapInArrow(_surveyor, _SURVEY).groupBy(*key, "item", "kids").agg(F.sum("n").alias("n"), F.sum("q").alias("q"))
    shown = F.col("item").isNotNull()
    nodes = items.groupBy(*key).agg(
        F.max(F.when(~shown, F.col("n"))).alias("m"),
        F.avg(F.when(shown & F.col("leaf"), F.log("n") - F.col("q") / F.col("n"))).alias("entropy"),
        F.collect_list(F.when(shown & ~F.col("leaf") & (F.col("n") > 1), F.struct("item", "n"))).alias("styles"),
        F.count_if(shown & ~F.col("leaf") & (F.col("n") == 1) & F.col("kids")).cast("int").alias("once"),
        F.count_if(shown & ~F.col("leaf") & (F.col("n") == 1) & ~F.col("kids")).cast("int").alias("hollow"),
    ).where("m > 1")
    ordered = nodes.repartition("host").sortWithinPartitions("host", F.desc("depth"))
    return ordered.mapInArrow(_weigher(gamma), "host bigint, node bigint, pages bigint, importance double, best double")


def render(root: Node, host: int, gone) -> tuple[str, int]:
    """The text of what remains of a page, a line for each block, and how many branches were removed. gone: names of removed nodes."""
    parts: list[str] = []
    removed = 0
    todo: list = [(root, _id(f"{host}"))]
    while todo:
        node, name = todo.pop()
        if name is None:
            parts.append(node)
            continue
        if name in gone:
            removed += 1
            continue
        if node.text is not None:
            parts.append(_unescape(node.text))
            continue
        style, runs = _runs(node)
        below = _id(f"{name}|{style}")
        block = node.label.partition(".")[0] in _BLOCKS
        inner: list = [("\n", None)] if block else []
        for i, run in enumerate(runs):
            child = _id(f"{below}|{i}")
            inner += [(x, child) for x in run]
        if block:
            inner.append(("\n", None))
        todo += reversed(inner)
    lines = (_BLANKS.sub(" ", x).strip() for x in "".join(parts).split("\n"))
    return "\n".join(x for x in lines if x), removed


def _extractor(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known: dict = {}
    for batch in batches:
        gone = batch.column("gone")
        texts, removed = [], []
        for k, (host, html) in enumerate(zip(batch.column("host").to_pylist(), batch.column("html").to_pylist())):
            if html is None:
                texts.append(None)
                removed.append(None)
                continue
            if host not in known:
                if len(known) >= 1000:
                    known.clear()
                known[host] = frozenset(gone[k].as_py() or ())
            text, n = render(parse(html), host, known[host])
            texts.append(text)
            removed.append(n)
        yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(removed, pa.int64())], names=["page_id", "url", "text", "n_removed"])


def extract(pages: DataFrame, threshold: float = 0.2, gamma: float = 0.9) -> DataFrame:
    """(page_id, url, text, n_removed) for every row of pages: the text that remains when branches are removed in which no node has an importance of ``threshold``, and how many were.

    A host known from one page only keeps everything, as nothing there can be
    seen to repeat. Pages with a null url, or one without a host, share a tree.
    A null html has a null text and count, an empty one an empty text. Repeated
    rows are pages of their own, and very long pages are read whole. Scripts, styles and comments are never text.
    An empty table gives an empty result. Other columns are ignored, whatever
    their names.
    """
    pages = only(pages, page_id="page_id", url="url", html="html").withColumn("page_id", F.col("page_id").cast("bigint"))
    low = importances(pages, gamma).where(F.col("best") < threshold)
    gone = settle(low.groupBy("host").agg(F.collect_list("node").alias("gone")))
    size = gone.agg(F.sum(F.lit(32) + 8 * F.size("gone"))).first()[0] or 0
    given = F.broadcast(gone) if size <= BROADCAST_BYTES else gone
    rows = pages.withColumn("host", _host_of(F.col("url")))
    return rows.join(given, "host", "left").select("page_id", "url", "host", "html", "gone").mapInArrow(_extractor, "page_id bigint, url string, text string, n_removed bigint")
