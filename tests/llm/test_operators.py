"""The corpus operators against brute force, exact round trips and odd rows."""

import itertools
import math
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from textloom.llm import bpe, embedding_dedup, html_extract, license_scan, lm_score, toxicity, warc
from textloom.llm import queries as Q
from textloom.llm.decontaminate import contained_items, drop_contaminated
from textloom.llm.near_dedup import drop_near_duplicates, near_duplicates
from textloom.llm.suffix_dedup import drop_repeats, repeated_passages
from textloom.llm.text import word_hash
from textloom.llm.toxicity import drop_toxic, score_toxicity

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def make(spark, texts):
    return spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in texts], SCHEMA)


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def shingles(text, n):
    w = words(text)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def prose(seed, n):
    rng = np.random.default_rng(seed)
    return " ".join(f"w{x}" for x in rng.integers(0, 5000, n))


@pytest.fixture
def odd(spark):
    """Nulls, empties, repeated rows, ties, and columns whose names the operators use themselves."""
    rows = [(1, prose(1, 200)), (1, prose(1, 200)), (None, prose(2, 200)), (3, None), (4, ""), (5, "!!!"), (6, prose(3, 60000)), (7, "one")]
    frame = make(spark, rows)
    ours = "root key label rest pos __id __spans spans emptied n gone halves same low head first id terms c0 c1 text_ evidence".split()
    return frame.selectExpr("*", "'x' as node", "7 as `a.b`", *(f"{i} as {c}" for i, c in enumerate(ours)))


def test_near_duplicates_against_all_pairs(spark):
    base = [prose(i, 120) for i in range(30)]
    texts = list(enumerate(base))
    for i in range(10):
        w = base[i].split()
        w[7 * i % 100] = "changed"
        texts.append((100 + i, " ".join(w)))
    texts += [(200, base[0]), (201, base[0])]
    docs = make(spark, texts)
    sets = {i: shingles(t, 3) for i, t in texts}
    pairs = {(a, b) for a, b in itertools.combinations(sets, 2) if len(sets[a] & sets[b]) >= 0.5 * len(sets[a] | sets[b])}
    found = {r["doc_id"]: r["duplicate_of"] for r in near_duplicates(docs).collect()}
    assert {b for _, b in pairs} == set(found)
    assert all(found[b] == min(a for a, c in pairs if c == b) for b in found)
    assert drop_near_duplicates(docs).count() == 30


def test_contained_items_against_brute_force(spark):
    items = [(i, prose(900 + i, 40)) for i in range(8)] + [(50, "three short words")]
    docs = [(i, prose(i, 300)) for i in range(20)] + [(30, prose(31, 5000) + " " + items[0][1] + " " + prose(32, 5000)), (31, items[1][1]), (32, "before three short words after")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    found = {(r["doc_id"], r["item_id"]) for r in contained_items(make(spark, docs), bench).collect()}
    want = {(d, i) for d, t in docs for i, q in items if len(words(q)) >= 5 and len(shingles(t, 5) & shingles(q, 5)) >= 0.5 * len(shingles(q, 5))} | {(32, 50)}
    assert found == want
    assert {r["doc_id"] for r in drop_contaminated(make(spark, docs), bench).collect()} == set(range(20))


def test_repeats_are_cut(spark):
    passage = prose(77, 80)
    docs = make(spark, [(1, prose(1, 50) + " " + passage), (2, prose(2, 30) + " " + passage + " " + prose(3, 30)), (3, prose(4, 100)), (4, prose(4, 100))])
    found = {(r["doc_id"], r["first_word"], r["n_words"], r["first_doc"]) for r in repeated_passages(docs).collect()}
    assert found == {(2, 30, 80, 1), (4, 0, 100, 3)}
    kept = {r["doc_id"]: r["text"] for r in drop_repeats(docs).collect()}
    assert set(kept) == {1, 2, 3} and kept[2] == prose(2, 30) + " " + prose(3, 30)


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    rng = np.random.default_rng(5)
    bad = rng.random(400) < 0.2
    docs = [(i, prose(i, 80) + (" vile nasty awful" if bad[i] else "")) for i in range(400)]
    labels = spark.createDataFrame([(i, 1, int(bad[i])) for i in range(0, 400, 2)], "doc_id bigint, quality int, toxic int")
    scored = {r["doc_id"]: r["toxic"] for r in score_toxicity(make(spark, docs), labels).collect()}
    held = range(1, 400, 2)
    assert sum(scored[i] == bool(bad[i]) for i in held) >= 0.98 * len(held)
    assert drop_toxic(make(spark, docs), labels).count() == sum(not scored[i] for i in scored)


def test_a_toxic_edit_of_a_clean_example_stays_an_example(spark):
    rng = np.random.default_rng(5)
    bad = rng.random(400) < 0.2
    docs = [(i, prose(i, 80) + (" vile nasty awful" if bad[i] else "")) for i in range(400)]
    docs += [(-3, prose(1000, 80)), (-2, prose(1000, 80) + " vile nasty awful"), (-1, prose(1000, 80) + " vile nasty awful")]
    labels = spark.createDataFrame([(i, 1, int(bad[i])) for i in range(0, 400, 2)] + [(-3, 1, 0), (-2, 1, 1), (-1, 1, 1)], "doc_id bigint, quality int, toxic int")
    scored = {r["doc_id"]: r for r in score_toxicity(make(spark, docs), labels).collect()}
    held = next(i for i in range(1, 400, 2) if bad[i])
    # by the cosine of all terms, the edits are nearest to each other and then to the text they come from
    assert scored[held]["toxic"] and [(e["doc_id"], e["toxic"]) for e in scored[-2]["evidence"]][:3] == [(-2, 1), (-1, 1), (-3, 0)]
    assert scored[-2]["toxic"] and not scored[-3]["toxic"]


def test_one_toxic_word_in_a_long_text_is_enough(spark):
    rng = np.random.default_rng(6)
    bad = rng.random(500) < 0.25
    docs = [(i, prose(i, 300) + (f" {('vile', 'nasty', 'awful')[i % 3]} " if bad[i] else " ") + prose(1000 + i, 300)) for i in range(500)]
    # copies of one toxic text: their other words tell nothing of a clean text that holds them
    docs += [(2000 + i, f"vile {prose(3000, 300)} copy{i}") for i in range(60)] + [(2100, prose(3000, 150))]
    labels = [(i, 1, int(bad[i])) for i in range(0, 500, 2)] + [(2000 + i, 1, 1) for i in range(60)]
    scored = {r["doc_id"]: r["toxic"] for r in score_toxicity(make(spark, docs), spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()}
    held = range(1, 500, 2)
    assert sum(scored[i] for i in held if bad[i]) >= 0.98 * sum(bad[i] for i in held)
    assert sum(scored[i] for i in held if not bad[i]) <= 0.01 * len(held)
    assert not scored[2100] and all(scored[2000 + i] for i in range(60))


def test_terms_that_tell_against_a_recount():
    rng = np.random.default_rng(3)
    n, m = 90, 40
    held = rng.random((n, m)) < 0.4
    y = (rng.random(n) < 0.3).astype(np.int32)
    held[:, 0], held[:, 1], held[:, 2] = y == 1, y == 0, True
    held[5, 0] = not held[5, 0]
    group = np.arange(n)
    for a in (10, 20):  # five copies each, of one label
        held[a : a + 5], y[a : a + 5], group[a : a + 5] = held[a], y[a], a
    sizes = np.array([np.sum(group == g) for g in group], float)
    owner, terms = np.nonzero(held)
    examples = toxicity.Examples(np.arange(m), None, np.searchsorted(owner, np.arange(n + 1)), terms, np.ones(len(terms)), np.arange(n), y)
    odds, own = toxicity._tell(examples, sizes)
    heads = np.unique(group)
    rate = (y[heads].sum() + 0.5) / (len(heads) + 1)

    def by_hand(some, t):
        a, b = int((held[some, t] & (y[some] == 1)).sum()), int((held[some, t] & (y[some] == 0)).sum())
        chance = sum(c * math.log(c / (a + b) / r) for c, r in ((a, rate), (b, 1 - rate)) if c)
        return math.log((a + rate) / (b + 1 - rate) * (1 - rate) / rate) if chance > math.log(m / toxicity.CHANCE) else 0.0

    assert np.allclose(odds, [by_hand(heads, t) for t in range(m)]) and odds[0] > 1 and odds[1] < 0 and not odds[2:].any()
    assert np.allclose(own, [sum(by_hand(heads[heads != group[i]], t) for t in np.flatnonzero(held[i])) for i in range(n)])


def test_bpe_equals_a_known_encoder(spark):
    tokenizers = pytest.importorskip("tokenizers")
    coder = tokenizers.Tokenizer.from_file(bpe.VOCABULARY)
    coder.encode_special_tokens = True
    texts = ["", "Hello  world's   end\n\n x", "ünïcödé 漢字 123abc", "a" * 3000, "don't we'll I've", "<|endoftext|>\t tail "]
    docs = make(spark, list(enumerate(texts)))
    coded = bpe.encode(docs)
    got = {r["doc_id"]: r["token_ids"] for r in coded.collect()}
    for i, t in enumerate(texts):
        assert got[i] == coder.encode(t, add_special_tokens=False).ids
    assert {r["doc_id"]: r["text"] for r in bpe.decode(coded).collect()} == dict(enumerate(texts))


def test_alignment_is_in_order_and_licenses_are_found(spark):
    assert license_scan.align(list("abcxdef"), list("abcydef")) == [(0, 0), (1, 1), (2, 2), (4, 4), (5, 5), (6, 6)]
    assert license_scan._rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 4)]) == [(1, 1), (2, 2), (4, 4)]
    mit = license_scan.TEMPLATES["mit"].split()
    del mit[10], mit[40]
    docs = make(spark, [(1, prose(1, 400) + " " + " ".join(mit) + " " + prose(2, 300)), (2, prose(3, 500)), (3, "All rights reserved. x All rights reserved."), (4, None)])
    found = [(r["doc_id"], r["license"], r["first_word"]) for r in license_scan.scan_licenses(docs).collect()]
    assert sorted(found) == [(1, "mit", 400), (3, "all-rights-reserved", 0), (3, "all-rights-reserved", 4)]


def test_copies_of_a_template_next_to_each_other_are_each_found():
    for name in ("all-rights-reserved", "mit-notice", "cc-by-4.0", "isc", "gpl-3.0"):
        template = words(license_scan.TEMPLATES[name])
        for before, gap, after, copies in itertools.product((0, 1, 2, 8, 10, 40), (0, 1, 2, 5, 9), (0, 1, 2, 8, 10, 40), (2, 3)):
            text = [f"b{i}" for i in range(before)]
            want = []
            for c in range(copies):
                text += [f"g{c}{i}" for i in range(gap if c else 0)]
                want.append((len(text), len(template), 1.0))
                text += template
            text += [f"a{i}" for i in range(after)]
            seeds = [(p, q) for p in range(len(text) - 2) for q in range(len(template) - 2) if text[p : p + 3] == template[q : q + 3]]
            assert license_scan.scan_words(text, seeds, template, 0.8) == want, (name, before, gap, after, copies)


def test_licenses_of_the_table_against_plain_search(spark):
    got = {(r["doc_id"], r["license"]) for r in Q.op4_license_scan(spark, SF).collect() if r["coverage"] == 1 and r["license"] != "mit"}
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        plain = " " + " ".join(words(r["text"])) + " "
        for name, template in license_scan.TEMPLATES.items():
            assert ((r["doc_id"], name) in got) == (" " + " ".join(words(template)) + " " in plain)


def test_near_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(0)
    v = rng.standard_normal((3000, 32))
    v[2000:2600] = v[:600] + 0.05 * rng.standard_normal((600, 32))
    v[2600:2605] = v[0]
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(3000, dtype=bool)
    want = {int(i) for i in range(3000) if near[i, :i].any()}
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(9001, None), (9002, []), (9003, [0.0] * 32), (None, v[0].tolist()), (9004, [1.0, None])]
    table = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {r["vec_id"] for r in embedding_dedup.near_vectors(table, cell=512).collect()}
    assert got <= want and len(got) >= 0.95 * len(want)
    assert embedding_dedup.near_vectors(table.limit(0)).count() == 0


def test_window_pairs_against_brute_force():
    rng = np.random.default_rng(3)
    places = rng.standard_normal((60, 7))
    marks, group, side = embedding_dedup.sketch(places), rng.integers(0, 3, 60), np.zeros(60, np.int64)
    reach = embedding_dedup.reach_of(0.4)
    for side in (np.zeros(60, np.int64), rng.integers(1, 3, 60)):
        found = set()
        for p, q in embedding_dedup.window_pairs(group, marks, side, reach, 3):
            found |= {(min(x), max(x)) for x in zip(p.tolist(), q.tolist())}
        want, sure = set(), set()
        for i, j in itertools.combinations(range(60), 2):
            if group[i] == group[j] and (side[i] != side[j] or side[i] == 0):
                apart = np.abs(marks[i].astype(int) - marks[j])
                if apart[0] <= reach and (apart <= reach).sum() >= 3:
                    want.add((i, j))
                near = np.abs(places[i] - places[j]) <= 0.4
                if near[0] and near.sum() >= 3:
                    sure.add((i, j))
        assert found == want and sure <= found


def test_hot_cells_of_vectors_lose_no_link(spark):
    rng = np.random.default_rng(1)
    w = rng.standard_normal((1500, 32))
    w[500:1000] = w[0] + 0.15 * rng.standard_normal((500, 32))
    w[1250:1300] = w[1200] + 0.15 * rng.standard_normal((50, 32))
    unit = w / np.linalg.norm(w, axis=1, keepdims=True)
    near = (unit @ unit.T >= 0.9) & ~np.eye(1500, dtype=bool)
    want = {int(i) for i in range(1500) if near[i, :i].any()}
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(w)] + [(i, x.tolist()) for i, x in enumerate(w[:3])], "vec_id bigint, embedding array<double>").selectExpr("*", "1 as v", "2 as root", "3 as cell", "4 as dim", "5 as x")
    got = {r["vec_id"]: r["duplicate_of"] for r in embedding_dedup.near_vectors(table, most=64).collect()}
    assert set(got) <= want and len(got) >= 0.98 * len(want)
    assert all(got[i] == 0 for i in range(500, 1000) if i in got)


def test_vectors_at_the_threshold_lose_no_link(spark):
    rng = np.random.default_rng(5)
    v = rng.standard_normal((3000, 32))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    # pairs just above and just below the threshold, in one cell and in many
    for i in range(1000):
        side = v[1000 + i] - (v[1000 + i] @ v[i]) * v[i]
        cosine = 0.9 + (0.002 if i % 4 else -0.002)
        v[1000 + i] = (cosine * v[i] + math.sqrt(1 - cosine**2) * side / np.linalg.norm(side)) * (1 + i % 3)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    near = unit @ unit.T >= 0.9
    want = {}
    for i in range(3000):
        least = int(np.flatnonzero(near[i])[0])
        if least < i:
            want[i] = want.get(least, least)
    assert len(want) >= 750
    table = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(9000 + i, x[:16].tolist()) for i, x in enumerate(v[:2])], "vec_id bigint, embedding array<double>")
    for cell in (64, 8192):
        assert {r["vec_id"]: r["duplicate_of"] for r in embedding_dedup.near_vectors(table, cell=cell).collect()} == want


def test_blocks_of_vectors_against_brute_force():
    for g in range(1, 12):
        met = [frozenset((i, k % g)) for i in range(g) for k in embedding_dedup.partners(i, g)]
        assert len(met) == len(set(met)) == g * (g + 1) // 2
    rng = np.random.default_rng(6)
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in rng.standard_normal((2, 400, 6)))
    merged = embedding_dedup._Merged()
    embedding_dedup.link_blocks(x, np.arange(400), y, np.arange(400, 800), 0.9, merged)
    want = list(range(800))
    for p, q in np.argwhere(x @ y.T >= 0.9).tolist():
        a, b = sorted((want[p], want[400 + q]))
        want = [a if w == b else w for w in want]
    assert merged.labels(np.arange(800)).tolist() == want and len(merged.links) == 800 - len(set(want))


def test_replay_holds_few_bytes_for_each_byte_of_words():
    letters = np.frombuffer(b"etaoinshrdlu", np.uint8)
    rng = np.random.default_rng(8)
    distinct = pa.array([b" " + letters[rng.integers(0, 12, k)].tobytes() for k in rng.integers(3, 15, 60000).tolist()], pa.large_binary())
    replay = bpe.Replay(bpe.load_vocabulary())
    tracemalloc.start()
    tokens, ranges = replay.tokens(distinct)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    pieces = replay.v.pieces
    assert [b"".join(pieces[t] for t in tokens[a:b].tolist()) for a, b in zip(ranges[:200], ranges[1:201])] == distinct[:200].to_pylist()
    assert peak <= 45 * sum(map(len, distinct.to_pylist()))  # 77 when every place took 8 bytes


def test_parts_of_a_shard_share_their_words():
    replay = bpe.Replay(bpe.load_vocabulary())
    for texts in ([["a b a"], [None, ""], ["b c", "a"]], [[""], ["c b a a"]], [[None], [""]], [["b"]]):
        shard = [pa.RecordBatch.from_arrays([pa.array(t, pa.string())], names=["text"]) for t in texts]
        index, within, tokens, ranges = bpe._coded(shard, replay)
        assert len(index) == len(within) == len(shard)
        for own, places, t in zip(index, within, texts):
            ids, begins = bpe._gather(tokens, ranges, own)
            bounds = begins[places]
            got = [b"".join(replay.v.pieces[k] for k in ids[a:b].tolist()).decode() for a, b in zip(bounds, bounds[1:])]
            assert got == [x or "" for x in t]


def test_nearest_examples_against_brute_force():
    rng = np.random.default_rng(2)
    n, m = 700, 900
    dense = np.where(rng.random((n, m)) < 0.03, rng.random((n, m)), 0)
    dense[:, :5] = rng.random((n, 5))
    dense[5] = dense[9] = dense[3]  # ties
    dense[7] = 0
    rows, terms = np.nonzero(dense)
    index = toxicity.BlockMaxIndex(rows, terms, dense[rows, terms], n, m)
    asked = np.where(rng.random((200, m)) < 0.03, rng.random((200, m)), 0)
    asked[3], asked[11] = dense[3], 0
    owner, asked_terms = np.nonzero(asked)
    offsets = np.searchsorted(owner, np.arange(201))
    scores = asked @ dense.T
    for k, below in ((1, np.inf), (15, np.inf), (100, 1.5), (n, np.inf)):
        for q, (found, near) in enumerate(index.nearest(offsets, asked_terms, asked[owner, asked_terms], k, below)):
            fit = [r for r in np.lexsort((np.arange(n), -np.round(scores[q], 9))) if 0 < scores[q, r] < below][:k]
            assert found.tolist() == fit and np.allclose(near, scores[q, fit])


def test_a_query_reads_each_posting_once(monkeypatch):
    rng = np.random.default_rng(4)
    n, m = 1500, 3000
    held = rng.random((n, m)) < 1 / np.sqrt(np.arange(1, m + 1))
    rows, terms = np.nonzero(held)
    index = toxicity.BlockMaxIndex(rows, terms, np.ones(len(rows)), n, m)
    postings = np.where(index.column < 0, held.sum(0), 0)
    owner, asked = np.nonzero(held[:100])
    read, ranges = [], toxicity._ranges
    monkeypatch.setattr(toxicity, "_ranges", lambda begins, ends: read.append(int((ends - begins).sum())) or ranges(begins, ends))
    assert all(len(found) == 200 for found, _ in index.nearest(np.searchsorted(owner, np.arange(101)), asked, np.ones(len(asked)), 200))
    assert 0 < sum(read) <= postings[asked].sum()  # 1.4 times as many when blocks had bounds


def test_places_of_terms_against_a_recount():
    rng = np.random.default_rng(5)
    vocabulary = np.unique(np.concatenate([rng.integers(0, 1 << 64, 500, np.uint64), np.arange(40, dtype=np.uint64), np.uint64((1 << 64) - 1) - np.arange(3, dtype=np.uint64)]))
    sought = np.concatenate([rng.permutation(vocabulary), rng.integers(0, 1 << 64, 500, np.uint64), np.arange(35, 50, dtype=np.uint64)])
    at = {int(v): i for i, v in enumerate(vocabulary)}
    assert toxicity.Places(vocabulary).of(sought).tolist() == [at.get(int(v), -1) for v in sought]
    assert toxicity.Places(vocabulary[:0]).of(sought[:3]).tolist() == [-1] * 3
    texts = ["b a b c b", None, "", "zz", "a a É é", "b"]
    known = np.sort(np.array([word_hash(w) for w in ("a", "b", "é")], np.uint64))
    offsets, terms, counts = toxicity._known(pa.array(texts), toxicity.Places(known))
    got = [{int(known[t]): int(c) for t, c in zip(terms[x:y], counts[x:y])} for x, y in zip(offsets, offsets[1:])]
    assert got == [{word_hash(w): c for w, c in bag} for bag in ([("a", 1), ("b", 3)], [], [], [], [("a", 2), ("é", 2)], [("b", 1)])]


def test_evidence_is_the_nearest_of_all_labelled_documents(spark):
    docs = [(i, prose(i, 60)) for i in range(120)] + [(200, None), (201, "")]
    labels = spark.createDataFrame([(i, 1, i % 3 == 0) for i in range(0, 120, 2)], "doc_id bigint, quality int, toxic boolean")
    got = {r["doc_id"]: r["evidence"] for r in score_toxicity(make(spark, docs), labels, shown=5).collect()}
    bags = {i: {w: words(t).count(w) for w in set(words(t))} for i, t in docs}
    df = {w: sum(w in b for b in bags.values()) for b in bags.values() for w in b}
    held = {w for i in range(0, 120, 2) for w in bags[i]}
    vectors = {i: {w: (1 + math.log(c)) * math.log((1 + len(bags)) / df[w]) for w, c in b.items() if w in held} for i, b in bags.items()}
    size = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vectors.items()}
    for i in (1, 2, 77):
        near = {j: sum(x * vectors[j].get(w, 0) for w, x in vectors[i].items()) / size[i] / size[j] for j in range(0, 120, 2)}
        want = sorted((j for j in near if near[j] > 0), key=lambda j: (-round(near[j], 9), j))[:5]
        assert [e["doc_id"] for e in got[i]] == want
        assert all(e["similarity"] == pytest.approx(near[e["doc_id"]], abs=2e-6) for e in got[i])
    assert got[200] == got[201] == []


def test_short_items_are_found_without_a_miss(spark):
    items = [(i, prose(900 + i, 5 + i % 12)) for i in range(60)]
    docs = [(i, prose(i, 500) + " " + items[i][1] + " " + prose(300 + i, 400)) for i in range(60)]
    found = {(r["doc_id"], r["item_id"]) for r in contained_items(make(spark, docs), spark.createDataFrame(items, "item_id bigint, text string")).collect()}
    assert {(i, i) for i in range(60)} <= found
    assert all(len(shingles(docs[d][1], 5) & shingles(items[i][1], 5)) >= 0.5 * len(shingles(items[i][1], 5)) for d, i in found)


def test_a_passage_in_many_documents_is_cut_from_all_but_the_first(spark):
    passage = prose(77, 60)
    docs = make(spark, [(i, prose(i, 29) + f" u{i} " + passage + f" v{i} " + prose(500 + i, 29)) for i in range(40)])
    found = {(r["doc_id"], r["first_word"], r["n_words"], r["first_doc"]) for r in repeated_passages(docs, sampled=1).collect()}
    assert found == {(i, 30, 60, 0) for i in range(1, 40)} == {(r["doc_id"], r["first_word"], r["n_words"], r["first_doc"]) for r in repeated_passages(docs).collect()}


def test_small_archives_have_a_dictionary_too():
    for records in ([b"x" * 150], [b"WARC/1.1 " + bytes([i]) * 40 for i in range(3)]):
        data, places = warc.pack(records, 4096, 6)
        assert int.from_bytes(data[4:8], "little") > 0 and list(warc.unpack(data)) == records and len(places) == len(records)


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x</p>"), (2, None, "y"), (None, "http://b/", None), (None, None, None), (5, "http://c/\r\n%0D", ""), (6, "u", "long" * 100_000), (6, "u", "long" * 100_000)] + [(10 + i, f"http://h/{i}", f"<html><body>same frame {i}</body></html>" * 5) for i in range(200)]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as file")
    back = warc.archived(spark, pages, str(tmp_path / "w"), file_bytes=100_000)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, back.collect()), key=key) == sorted(rows, key=key)
    index = spark.read.parquet(str(tmp_path / "w-index")).where("page_id = 20").first()
    data = (tmp_path / "w" / index["file"]).read_bytes()
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    one = list(warc.unpack(data[: 8 + int.from_bytes(data[4:8], "little")] + data[index["offset"] : index["offset"] + index["length"]]))
    assert warc.parse_record(one[0])[0] == 20
    assert warc.archived(spark, pages.limit(0), str(tmp_path / "none")).count() == 0


def brute_likelihood(word, v, scores):
    table = {"".join(map(chr, c)): s for c, s in zip(v.codes, scores) if len(c)}
    single = {p for p in table if len(p) == 1}

    def total(i):
        if i == len(word):
            return 1.0
        out = sum(math.exp(table[word[i:j]]) * total(j) for j in range(i + 1, len(word) + 1) if word[i:j] in table)
        if word[i] not in single:
            out += math.exp(sum(scores[v.byte_piece[b]] for b in word[i].encode())) * total(i + 1)
        return out

    return math.log(total(0))


def test_likelihood_sums_all_segmentations(spark):
    v = lm_score.load_vocabulary()
    text = "hello  the 漢a"
    docs = make(spark, [(1, text), (2, None), (3, ""), (4, "x" * 2000)])
    got = {r["doc_id"]: r for r in lm_score.score_documents(docs, scores=v.scores).collect()}
    want = sum(brute_likelihood(w, v, v.scores) for w in ("▁hello", "▁▁the", "▁漢a"))
    assert got[1]["log_prob"] == pytest.approx(want, abs=1e-5) and got[1]["n_words"] == 3
    assert got[2]["log_prob"] is None and got[3]["log_prob"] == 0 and got[3]["bits_per_byte"] is None
    lattice = lm_score.Lattice(v, v.scores)
    code = np.array([ord(c) for c in "▁" + "ab" * 150], np.uint32)
    short, e1 = lattice.words(code, np.array([0, len(code)]), np.ones(1))
    pieces, spelt = lattice.edges(code, np.full(len(code), len(code)))
    e2 = np.zeros_like(e1)
    assert lattice._long(code, pieces, spelt, np.array([0]), len(code), np.ones(1), e2) == pytest.approx(short)
    assert np.allclose(e1, e2)


def test_fitted_scores_raise_the_likelihood(spark):
    docs = make(spark, [(i, "the cat sat on the mat " * 50) for i in range(5)])
    before = lm_score.score_documents(docs, scores=lm_score.load_vocabulary().scores).first()["log_prob"]
    assert lm_score.score_documents(docs).first()["log_prob"] > before


def test_branches_that_repeat_on_a_host_go(spark):
    page = '<html><body><div class="menu"><a href="/home">Home</a><a href="/about">About</a></div><div class="main"><p>{}</p><p>{}</p></div><div class="foot">All the same</div></body></html>'
    rows = [(i, f"http://site.example/{i}", page.format(prose(i, 20), prose(100 + i, 20))) for i in range(12)] + [(50, "http://other.example/", page.format("alone", "here")), (51, None, None), (52, "http://site.example/e", "")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").selectExpr("*", "1 as host", "2 as gone")
    got = {r["page_id"]: r for r in html_extract.extract(pages).collect()}
    assert got[3]["text"] == prose(3, 20) + "\n" + prose(103, 20) and got[3]["n_removed"] > 0
    assert "Home" in got[50]["text"] and got[51]["text"] is None and got[52]["text"] == ""
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_odd_rows(spark, odd):
    bench = spark.createDataFrame([(1, prose(9, 30)), (None, "x"), (2, None), (3, "")], "item_id bigint, text string")
    labels = spark.createDataFrame([(1, 1, 0), (None, 1, 1), (7, None, None)], "doc_id bigint, quality int, toxic int")
    stages = {
        "toxic": lambda d: drop_toxic(d, labels),
        "near": drop_near_duplicates,
        "repeats": drop_repeats,
        "leaks": lambda d: drop_contaminated(d, bench),
    }
    for name, stage in stages.items():
        out = stage(odd)
        assert out.columns == odd.columns, name
        assert out.where("text is null").count() == 1 and out.where("text = ''").count() == 1, name
        assert stage(odd.limit(0)).count() == 0, name
    for each in (bpe.encode, license_scan.scan_licenses, lm_score.score_documents):
        each(odd).collect()
        assert each(odd.limit(0)).count() == 0
    assert bpe.encode(odd).count() == odd.count()
