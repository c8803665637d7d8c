"""Operators and the pipeline against slow versions written without them."""

import math
import random
import re
from collections import defaultdict
from html.parser import HTMLParser

import pytest

import corpus_pipeline
from textloom.llm import bpe, html_extract, license_scan
from textloom.llm.common import table

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def common_length(a, b):
    """The length of a longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        last = 0
        for k, y in enumerate(b):
            last, row[k + 1] = row[k + 1], last + 1 if x == y else max(row[k + 1], row[k])
    return row[-1]


def test_coverage_of_edited_licenses(spark):
    """Coverage is never above what any alignment could give, and templates with few edits are found where they stand."""
    rng = random.Random(3)
    docs, planted = [], {}
    for i in range(60):
        name = rng.choice(["mit", "apache-2.0", "isc", "gpl-3.0", "cc-by-4.0"])
        own = words(license_scan.TEMPLATES[name])
        for _ in range(len(own) // 20):
            k = rng.randrange(len(own))
            own[k : k + 1] = rng.choice([[], ["changed"], [own[k], "put", "in"]])
        before = [f"b{rng.randrange(500)}" for _ in range(rng.randrange(80))]
        docs.append((i, " ".join(before + own + [f"a{rng.randrange(500)}" for _ in range(40)])))
        planted[i] = name, len(before), len(own)
    rows = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], SCHEMA)
    texts = dict(docs)
    found = license_scan.scan_licenses(rows).collect()
    for r in found:
        template = words(license_scan.TEMPLATES[r.license])
        stretch = words(texts[r.doc_id])[r.first_word : r.first_word + r.n_words]
        assert 0.8 <= r.coverage <= common_length(stretch, template) / len(template) + 1e-6
    hits = {(r.doc_id, r.license): r for r in found}
    for i, (name, first, length) in planted.items():
        r = hits[i, name]
        assert abs(r.first_word - first) <= 3 and abs(r.first_word + r.n_words - first - length) <= 3


class _Tree(HTMLParser):
    """Elements as [label, children], texts as strings, links as ("link", target)."""

    def __init__(self):
        super().__init__()
        self.stack = [["#page", []]]

    def handle_starttag(self, tag, attrs):
        look = sorted(f"{k}={v}" for k, v in attrs if k == "class")
        node = [".".join([tag, *look]), [("link", v) for k, v in attrs if k == "href"]]
        self.stack[-1][1].append(node)
        self.stack.append(node)

    def handle_endtag(self, tag):
        self.stack.pop()

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][1].append(data)


def _label(x):
    return "#text" if isinstance(x, str) else "#link" if isinstance(x, tuple) else x[0]


def _grouped(node):
    runs = []
    for x in node[1]:
        if runs and _label(runs[-1][0]) == _label(x):
            runs[-1].append(x)
        else:
            runs.append([x])
    return runs


def _importance(pages, gamma):
    """(importance, best) of the node that stands on some pages (lists of its copies, one for each page), and of every node below, by path."""
    out = {}

    def of(path, pages):
        m = len(pages)
        if _label(pages[0][0]) in ("#text", "#link"):
            counts = defaultdict(lambda: defaultdict(int))
            for p, own in enumerate(pages):
                for x in own:
                    counts[re.sub(r"\s+", " ", x if isinstance(x, str) else x[1]).strip()][p] += 1
            entropies = []
            for per in counts.values():
                n = sum(per.values())
                entropies.append(-sum(c / n * math.log(c / n) for c in per.values()))
            value = best = 1.0 if m <= 1 else max(0.0, 1 - sum(entropies) / len(entropies) / math.log(m))
        else:
            styles = defaultdict(list)
            for own in pages:
                for style in {">".join(_label(r[0]) for r in _grouped(x)) for x in own}:
                    styles[style].append([x for x in own if ">".join(_label(r[0]) for r in _grouped(x)) == style])
            total = sum(map(len, styles.values()))
            inner, tops = 0.0, []
            for style, copies in styles.items():
                values = []
                for k in range(len(_grouped(copies[0][0]))):
                    below = of((*path, style, k), [[y for x in own for y in _grouped(x)[k]] for own in copies])
                    values.append(below[0])
                    tops.append(below[1])
                inner += len(copies) / total * (sum(values) / len(values) if values else 0.0)
            if m <= 1:
                value = 1.0
            else:
                spread = min(1.0, -sum(len(c) / total * math.log(len(c) / total) for c in styles.values()) / math.log(m))
                value = (1 - gamma ** len(styles)) * spread + gamma ** len(styles) * inner
            best = max([value, *tops])
        out[path] = (value, best, m)
        return value, best

    of((), [[p] for p in pages])
    return out


def test_importances_against_plain_loops(spark):
    rng = random.Random(5)
    htmls = []
    for i in range(14):
        items = "".join(f"<li><a href='/{rng.randrange(3)}'>go {rng.randrange(3)}</a></li>" for _ in range(rng.randrange(1, 4)))
        extra = "<div class='ad'>buy now</div>" if i % 3 else ""
        body = "".join(f"<p>{rng.randrange(10**6)} {'<b>x</b>' if rng.random() < 0.3 else ''}</p>" for _ in range(2))
        once = "<table><tr><td>only here</td></tr></table>" if i == 4 else ""
        htmls.append(f"<html><body><ul>{items}</ul>{extra}<div class='main'>{body}{once}</div><div class='foot'>All the same</div></body></html>")
    pages = spark.createDataFrame([(i, f"http://h.example/{i}", h) for i, h in enumerate(htmls)], "page_id bigint, url string, html string")
    roots = []
    for h in htmls:
        tree = _Tree()
        tree.feed(h)
        roots.append(tree.stack[0])
    want = sorted((m, round(v, 9), round(b, 9)) for v, b, m in _importance(roots, 0.9).values() if m > 1)
    got = sorted((r.pages, round(r.importance, 9), round(r.best, 9)) for r in html_extract.importances(pages).collect())
    assert got == want


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(f"w{rng.randrange(5000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """Tables of toxic documents, copies, a shared passage, benchmark items and odd rows; every text and id is told apart by itself."""
    path = tmp_path_factory.mktemp("corpus")
    docs = [(i, prose(i, 90)) for i in range(120)]
    docs = [(i, t + " vile nasty awful vile nasty awful" * 4 if i % 6 == 0 else t) for i, t in docs]
    docs += [(200 + i, docs[i][1]) for i in (1, 2, 3)]  # exact copies
    docs += [(210 + i, " ".join(docs[i][1].split()[:-3] + ["x", "y", "z"])) for i in (4, 5)]  # near copies
    passage = prose(777, 60)
    docs += [(220 + i, f"{prose(300 + i, 60)} u{i} {passage} v{i} {prose(400 + i, 60)}") for i in range(4)]
    items = [(i, prose(900 + i, 8 + 10 * i)) for i in range(3)]
    docs += [(230 + i, f"{prose(500 + i, 80)} {items[i][1]} {prose(600 + i, 80)}") for i in range(3)]
    docs += [(240, ""), (241, None), (None, prose(700, 80))]
    rows = [(i, t, "en", "s", None if t is None else len(t)) for i, t in docs]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(items, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    labels = [(i, 1, int(i % 6 == 0)) for i in range(0, 120, 2)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path), rows, items, {i: y for i, _, y in labels}


def _slow_toxic(rows, labels):
    """Ids of toxic documents: cosines of all pairs, votes of all examples, and chances from pooled neighbours."""
    bags = [(i, {w: words(t).count(w) for w in words(t)}) for i, t, *_ in rows]
    examples = [i for i, b in bags if i in labels and b]
    known = {w for i, b in bags if i in labels for w in b}
    df = defaultdict(int)
    for _, b in bags:
        for w in b:
            df[w] += 1

    def vector(b):
        v = {w: (1 + math.log(c)) * math.log((1 + len(bags)) / df[w]) for w, c in b.items() if w in known}
        size = math.sqrt(sum(x * x for x in v.values()))
        return {w: x / size for w, x in v.items()}

    own = {i: vector(b) for i, b in bags if i in examples}

    def vote(v, below):
        near = [(sum(x * own[j].get(w, 0) for w, x in v.items()), labels[j]) for j in examples]
        near = [(s, y) for s, y in near if 0 < s < below]
        weights = [1 / (1.0005 - min(s, 1)) for s, _ in near]
        return round(sum(w * y for w, (_, y) in zip(weights, near)) / sum(weights), 9) if near else None

    rate = (sum(labels[j] for j in examples) + 0.5) / (len(examples) + 1)
    pools = []
    for value, y in sorted((vote(own[j], 0.8), labels[j]) for j in examples):
        pools.append([value, y, 1])
        while len(pools) > 1 and (pools[-2][0] == pools[-1][0] or pools[-2][1] / pools[-2][2] >= pools[-1][1] / pools[-1][2]):
            _, y1, n1 = pools.pop()
            pools[-1] = [pools[-1][0], pools[-1][1] + y1, pools[-1][2] + n1]
    out = set()
    for i, b in bags:
        v = vote(vector(b), math.inf) if any(w in known for w in b) else None
        chance = rate if v is None else next(((y + rate) / (n + 1) for x, y, n in reversed(pools) if x <= v), (pools[0][1] + rate) / (pools[0][2] + 1))
        if round(chance, 6) >= 0.5 and i is not None:
            out.add(i)
    return out


def _slow_pipeline(rows, items, labels):
    """What the stages leave."""
    toxic = _slow_toxic(rows, labels)
    kept = [r for r in rows if r[0] not in toxic]
    # one of each group of near copies
    sets = {r[0]: {tuple(words(r[1])[i : i + 3]) for i in range(len(words(r[1])) - 2)} for r in kept if r[0] is not None}
    top = {i: i for i in sets}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b]):
                p, q = find(a), find(b)
                top[max(p, q)] = min(p, q)
    kept = [r for r in kept if r[0] is None or find(r[0]) == r[0]]
    # passages of 50 words that an earlier document has
    seen, cut = {}, []
    for r in sorted((r for r in kept if r[0] is not None), key=lambda r: r[0]):
        w = words(r[1])
        gone = set()
        for i in range(len(w) - 49):
            run = tuple(w[i : i + 50])
            if seen.setdefault(run, (r[0], i))[0] != r[0]:
                gone |= set(range(i, i + 50))
        cut.append(r if not gone else (r[0], " ".join(x for i, x in enumerate(w) if i not in gone), *r[2:]))
    kept = cut + [r for r in kept if r[0] is None]

    # documents that hold half of an item
    def held(text, item):
        grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        own = grams(words(item))
        return len(own & grams(words(text))) >= 0.5 * len(own)

    return [r for r in kept if r[0] is None or not any(held(r[1], t) for _, t in items)]


def test_the_pipeline_against_a_slow_one(spark, folder):
    tokenizers = pytest.importorskip("tokenizers")
    path, rows, items, labels = folder
    coder = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    got = {r.doc_id: (r.token_ids, r.n_tokens, r.round_trip) for r in corpus_pipeline.run(spark, path).collect()}
    want = {}
    for i, text, *_ in _slow_pipeline(rows, items, labels):
        ids = None if text is None else coder.encode(text, add_special_tokens=False).ids
        want[i] = (ids, None if ids is None else len(ids), None if ids is None else True)
    assert got == want
    assert {0, 6}.isdisjoint(got) and 1 in got and 201 not in got and 230 not in got and {240, 241, None} <= set(got)


def test_stages_keep_the_columns_of_documents(spark, folder):
    path = folder[0]
    docs = table(spark, path, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        assert stage(spark, docs.limit(0), path).count() == 0, name
        docs = out
