"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, and by the terms that tell.

The examples are a bounded sample of the labelled documents. Every term of
every example counts, and document frequencies are counted over all documents.
The inverted index over the examples keeps the few terms that most examples
share as dense columns, since their postings would be nearly full lists. A
query adds up its similarity to every example, from a product with the columns
and from the postings of its other terms, and takes the exact nearest ones.
(Bounds by blocks of examples left out no posting for 300 documents of the
0.10 GB check input, as many have to vote.) Their votes are weighted by
nearness.

A text of many words can hold one word that makes it toxic, which hardly moves
its cosines. So the terms that go with either label, beyond what chance gives
to any of all terms, add up their log odds beside the vote. Either is mapped to
probabilities by isotonic regression over the examples, each judged without
itself and its near copies. The vote gives the score, unless the terms of a
text speak for toxic and give a higher one.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import only, settle, small, without
from textloom.llm.text import chunks, list_array, words_of

_U = np.uint64
#: Terms of most postings, which are kept as dense columns.
DENSE = 256
#: Queries that are looked up together.
TOGETHER = 64
#: Characters of text that are counted together, so that what is made of them stays in the processor's cache.
CHARS = 1 << 17


def _count(values: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, value) in order, and how often each occurs."""
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    first = np.ones(len(values), bool)
    first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(first)
    return owner[at], values[at], np.diff(np.append(at, len(values)))


def _ranges(begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """All places of the ranges, one after the other."""
    length = ends - begins
    total = np.cumsum(length)
    return np.arange(total[-1] if len(total) else 0) + np.repeat(begins - (total - length), length)


class ExampleIndex:
    """An exact nearest-neighbour index over sparse vectors of length 1; ids are their positions."""

    def __init__(self, rows: np.ndarray, terms: np.ndarray, weights: np.ndarray, n_rows: int, n_terms: int):
        self.n_rows = n_rows
        held = np.bincount(terms, minlength=n_terms)
        common = np.sort(np.lexsort((np.arange(n_terms), -held))[:DENSE])
        self.column = np.full(n_terms, -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.dense = np.zeros((n_rows, len(common)))
        full = self.column[terms] >= 0
        self.dense[rows[full], self.column[terms[full]]] = weights[full]
        rows, terms, weights = rows[~full], terms[~full], weights[~full]
        order = np.lexsort((rows, terms))
        self.rows, self.weights = rows[order].astype(np.intp), weights[order]
        self.begins = np.searchsorted(terms[order], np.arange(n_terms + 1))

    def nearest(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, k: int, below: float = np.inf) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For each query, a range of terms and weights, the k rows of largest inner product above zero, and it; of equal ones the lower row first. Rows of ``below`` and more are left out."""
        for score in self.scores(offsets, terms, weights):
            yield _best(score, k, below)

    def scores(self, offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray) -> Iterator[np.ndarray]:
        """For each query, a range of terms and weights, its inner products with all rows."""
        for low in range(0, len(offsets) - 1, TOGETHER):
            some = offsets[low : low + TOGETHER + 1]
            part = slice(some[0], some[-1])
            column = self.column[terms[part]]
            owner = np.repeat(np.arange(len(some) - 1), np.diff(some))
            full, rare = np.flatnonzero(column >= 0), np.flatnonzero(column < 0)
            asked = np.zeros((len(some) - 1, self.dense.shape[1]))
            asked[owner[full], column[full]] = weights[part][full]
            bounds = np.searchsorted(owner[rare], np.arange(len(some)))
            begins, ends, weight = self.begins[terms[part][rare]], self.begins[terms[part][rare] + 1], weights[part][rare]
            for score, a, b in zip(asked @ self.dense.T, bounds[:-1], bounds[1:]):
                places = _ranges(begins[a:b], ends[a:b])
                products = np.repeat(weight[a:b], ends[a:b] - begins[a:b])
                products *= self.weights[places]
                score += np.bincount(self.rows[places], products, self.n_rows)
                yield score


def _best(score: np.ndarray, k: int, below: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
    """The k rows of largest score above zero, and it, as :meth:`ExampleIndex.nearest` has them."""
    if below < np.inf:
        score = np.where(score < below, score, 0.0)
    least = np.partition(score, -k)[-k] if len(score) > k else 0.0
    best = np.flatnonzero((score > 0) & (score >= least - 1e-9))
    best = best[np.lexsort((best, -np.round(score[best], 9)))][:k]
    return best, score[best]


#: The name it had when it bounded blocks.
BlockMaxIndex = ExampleIndex


class Places:
    """Where a hash stands in a sorted vocabulary of them, found by its highest bits."""

    def __init__(self, vocabulary: np.ndarray):
        bits = len(vocabulary).bit_length() + 1
        self.vocabulary, self.shift = vocabulary, _U(64 - bits)
        held = np.bincount((vocabulary >> self.shift).astype(np.intp), minlength=1 << bits)
        self.begins = np.append(0, np.cumsum(held)).astype(np.int32)

    def of(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if the vocabulary doesn't have it."""
        high = (hashes >> self.shift).astype(np.intp)
        at, ends = self.begins[high], self.begins[high + 1]
        found = np.full(len(hashes), -1, np.int32)
        left = np.flatnonzero(at < ends)
        at, ends, sought = at[left], ends[left], hashes[left]
        while len(left):
            hit = self.vocabulary[at] == sought
            found[left[hit]] = at[hit]
            more = np.flatnonzero(~hit & (at + 1 < ends))
            left, at, ends, sought = left[more], at[more] + 1, ends[more], sought[more]
        return found


class Examples:
    """The labelled examples, of a size that the parameters of a fit bound. vocabulary: sorted hashes of terms; terms, counts: those of each example, a range of offsets.

    Only this travels; the index is built from it once in each process that asks for it.
    """

    def __init__(self, vocabulary, idf, offsets, terms, counts, ids, labels):
        self.vocabulary, self.idf, self.offsets, self.terms, self.counts, self.ids, self.labels = vocabulary, idf, offsets, terms, counts, ids, labels
        self._index = self._places = None

    def __getstate__(self):
        return self.__dict__ | {"_index": None, "_places": None}

    @property
    def places(self) -> Places:
        if self._places is None:
            self._places = Places(self.vocabulary)
        return self._places

    @property
    def index(self) -> ExampleIndex:
        if self._index is None:
            rows = np.repeat(np.arange(len(self.ids)), np.diff(self.offsets))
            self._index = ExampleIndex(rows, self.terms, _weigh(self.offsets, self.terms, self.counts, self.idf), len(self.ids), len(self.vocabulary))
        return self._index


class Rising(NamedTuple):
    """A rising step function: from each of steps on, a chance."""

    steps: np.ndarray
    chances: np.ndarray

    def __call__(self, x):
        return self.chances[np.maximum(0, np.searchsorted(self.steps, x, side="right") - 1)]


class Model(NamedTuple):
    """shared: the examples, broadcast; telling: places of terms and their log odds, broadcast; vote, odds: the chances by either; otherwise: the chance without a neighbour."""

    shared: object
    telling: object
    vote: Rising
    odds: Rising
    otherwise: float
    k: int


def _isotonic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, prior: float, middle: bool = False) -> Rising:
    """The chance of y as it rises with x. Each pool counts one more example at the prior, and begins with its first x, or in the middle between that and the last one of the pool before."""
    order = np.argsort(x, kind="stable")
    pools: list[list[float]] = []
    for value, label, w in zip(x[order].tolist(), y[order].tolist(), weight[order].tolist()):
        if pools and pools[-1][0] == value:
            pools[-1][1] += label * w
            pools[-1][2] += w
        else:
            pools.append([value, label * w, w, value])
        while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
            _, s, n, last = pools.pop()
            pools[-1][1] += s
            pools[-1][2] += n
            pools[-1][3] = last
    first, last = np.array([p[0] for p in pools]), np.array([p[3] for p in pools])
    return Rising(np.append(first[:1], (first[1:] + last[:-1]) / 2) if middle else first, np.array([(p[1] + prior) / (p[2] + 1) for p in pools]))


def _vote(labels: np.ndarray, scores: np.ndarray) -> float:
    if not len(scores):
        return 0.0
    # nearly flat among texts that share some words, and decisive for the same text
    weight = 1 / (1.0005 - np.minimum(scores, 1))
    return round(float((weight * labels).sum() / weight.sum()), 9)


def _weigh(offsets: np.ndarray, terms: np.ndarray, counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Weights of the terms of several texts, scaled to length 1 each."""
    weight = (1 + np.log(counts)) * idf[terms]
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    length = np.sqrt(np.bincount(owner, weight**2, len(offsets) - 1))
    return weight / np.maximum(length, 1e-300)[owner]


def _log_odds(toxic: np.ndarray, clean: np.ndarray, rate: float) -> np.ndarray:
    """Of each term, held by so many toxic and clean examples, by how much it raises the log odds of toxic; 0 if chance gives such counts to one of all terms more often than CHANCE (Chernoff's bound)."""
    share = toxic / np.maximum(toxic + clean, 1e-300)
    tiny = 1e-300  # times a count of 0
    sure = toxic * np.log(np.maximum(share, tiny) / rate) + clean * np.log(np.maximum(1 - share, tiny) / (1 - rate))
    odds = np.log((toxic + rate) / (clean + 1 - rate)) - np.log(rate / (1 - rate))
    return np.where(sure > np.log(max(1, len(toxic)) / CHANCE), odds, 0.0)


def _tell(m: Examples, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The log odds of each term, where the examples of a group of copies count as one; and the sum over each example's terms, had its group not been counted."""
    toxic, clean = np.zeros(len(m.vocabulary)), np.zeros(len(m.vocabulary))
    pieces = [slice(low, low + 512) for low in range(0, len(m.ids), 512)]
    for some in pieces:
        length = np.diff(m.offsets[some.start : some.stop + 1])
        terms = m.terms[m.offsets[some.start] : m.offsets[some.start] + length.sum()]
        for count, label in ((toxic, 1), (clean, 0)):
            count += np.bincount(terms, np.repeat((m.labels[some] == label) / sizes[some], length), len(count))
    toxic, clean = np.round(toxic, 9), np.round(clean, 9)
    rate = float(((m.labels / sizes).sum() + 0.5) / ((1 / sizes).sum() + 1))
    without = [_log_odds(toxic, np.maximum(clean - 1, 0), rate), _log_odds(np.maximum(toxic - 1, 0), clean, rate)]
    own = np.zeros(len(m.ids))
    for some in pieces:
        length = np.diff(m.offsets[some.start : some.stop + 1])
        terms = m.terms[m.offsets[some.start] : m.offsets[some.start] + length.sum()]
        owner = np.repeat(np.arange(len(length)), length)
        sums = [np.bincount(owner, odds[terms], len(length)) for odds in without]
        own[some] = np.where(m.labels[some] == 1, sums[1], sums[0])
    return _log_odds(toxic, clean, rate), np.round(own, 9)


def _example_reader(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in chunks(batch, "text"):
            words = words_of(part.column("text"))
            owner, terms, counts = _count(words.hashes, np.repeat(np.arange(part.num_rows), np.diff(words.offsets)))
            offsets = np.searchsorted(owner, np.arange(part.num_rows + 1))
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), part.column("toxic"), pa.array(np.diff(offsets)), list_array(pa.array(terms.view(np.int64)), offsets), list_array(pa.array(counts, pa.int32()), offsets)],
                names=["doc_id", "toxic", "n", "terms", "counts"],
            )


def _known(texts: pa.Array, places: Places) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The range of each text, and in it the places of its distinct terms that the vocabulary has, with their counts."""
    words = words_of(texts)
    at = places.of(words.hashes)
    hit = np.flatnonzero(at >= 0)
    owner = np.repeat(np.arange(len(texts)), np.diff(words.offsets))[hit]
    both = np.sort(owner << 32 | at[hit])  # one key sorts faster than two
    first = np.flatnonzero(np.diff(both, prepend=-1))
    both, counts = both[first], np.diff(np.append(first, len(both)))
    return np.searchsorted(both >> 32, np.arange(len(texts) + 1)), both & 0xFFFFFFFF, counts


def _frequencies(shared):
    """Of each partition, in how many of its documents a term occurs; a row with term -1 counts the documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shared.value)
        total, n = np.zeros(len(shared.value), np.int64), 0
        for batch in batches:
            n += batch.num_rows
            for part in chunks(batch, "text", CHARS):
                np.add.at(total, _known(part.column("text"), places)[1], 1)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(some, -1), pa.int32()), pa.array(np.append(total[some], n), pa.int64())], names=["term", "n"])

    return count


def _voter(shared, k: int):
    """Votes on examples, without themselves and their near copies; and the number of examples in their group. Rows: places of examples, which are kept."""

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Examples = shared.value
        for batch in batches:
            for part in np.array_split(np.asarray(batch.column("id")), max(1, batch.num_rows // 256)):
                offsets = np.concatenate([[0], np.cumsum(m.offsets[part + 1] - m.offsets[part])])
                places = _ranges(m.offsets[part], m.offsets[part + 1])
                terms = m.terms[places]
                weights = _weigh(offsets, terms, m.counts[places], m.idf)
                votes, sizes = [], []
                for score in m.index.scores(offsets, terms, weights):
                    rows, near = _best(score, k, COPY)
                    votes.append(_vote(m.labels[rows], near) if len(rows) else None)
                    sizes.append(max(1, int((score >= COPY).sum())))
                yield pa.RecordBatch.from_arrays([pa.array(part, pa.int64()), pa.array(votes, pa.float64()), pa.array(sizes, pa.int64())], names=["id", "vote", "size"])

    return vote


#: Examples of this similarity are copies of one text: they don't vote on each other, and count as one in the calibration and for the terms that tell.
COPY = 0.8
#: How often chance may make any of all terms tell.
CHANCE = 0.01


def _scorer(model: Model, shown: int):
    shared, telling, by_vote, by_odds, otherwise, k = model

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Examples = shared.value
        odds = np.zeros(len(m.vocabulary))
        odds[telling.value[0]] = telling.value[1]
        for batch in batches:
            for part in chunks(batch, "text", CHARS):
                offsets, terms, counts = _known(part.column("text"), m.places)
                told = np.round(np.bincount(np.repeat(np.arange(part.num_rows), np.diff(offsets)), odds[terms], part.num_rows), 9)
                told = np.where(told > 0, by_odds(told), 0.0)
                scores, evidence, similarity, ends = [], [], [], [0]
                for (rows, near), own in zip(m.index.nearest(offsets, terms, _weigh(offsets, terms, counts, m.idf), k), told):
                    chance = otherwise
                    if len(rows):
                        chance = float(max(by_vote(_vote(m.labels[rows], near)), own))
                    scores.append(round(chance, 6))
                    evidence.append(rows[:shown])
                    similarity += [round(x, 6) for x in near[:shown].tolist()]
                    ends.append(len(similarity))
                rows = np.concatenate(evidence)
                shows = pa.StructArray.from_arrays([pa.array(m.ids[rows], pa.int64()), pa.array(similarity, pa.float64()), pa.array(m.labels[rows], pa.int32())], names=["doc_id", "similarity", "toxic"])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores, pa.float64()), pa.array([x >= 0.5 for x in scores], pa.bool_()), list_array(shows, np.array(ends))], names=["doc_id", "score", "toxic", "evidence"])

    return score


def _texts(docs: DataFrame) -> DataFrame:
    return only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))


def fit(docs: DataFrame, labels: DataFrame, k: int = 200, max_examples: int = 8192, max_terms: int = 4_000_000) -> Model:
    """The model of the labelled documents.

    ``max_examples`` and ``max_terms`` bound the labelled documents it learns
    from, taken in order of their hashed ids: so many documents, and so many
    distinct terms of theirs, each counted in every document. They bound what
    is broadcast; all documents count for the document frequencies. ``k`` of
    of them vote on a document. A text holds many rare words beside the few that
    tell, so the nearest ones alone are a poor guide: many have to vote, and the
    terms that tell are counted beside the vote.
    """
    docs = _texts(docs)
    context = docs.sparkSession.sparkContext
    marks = only(labels, doc_id="doc_id", toxic="toxic").where("doc_id is not null and toxic is not null").groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    sample = settle(marks.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_examples))
    texts = docs.join(small(sample), "doc_id").groupBy("doc_id", "toxic").agg(F.min("text").alias("text"))
    read = texts.select("doc_id", "toxic", "text").mapInArrow(_example_reader, "doc_id bigint, toxic int, n bigint, terms array<bigint>, counts array<int>")
    examples = settle(read.where("n > 0"))
    sizes = examples.select("doc_id", "n").orderBy(F.xxhash64("doc_id"), "doc_id").toPandas()
    fitting = sizes["doc_id"][sizes["n"].cumsum() <= max_terms].to_numpy(np.int64)
    kept = examples
    if len(fitting) < len(sizes):
        kept = examples.join(small(settle(docs.sparkSession.createDataFrame(pa.table({"doc_id": fitting})))), "doc_id")
    table = kept.select("doc_id", "toxic", "terms", "counts").toArrow().sort_by("doc_id").combine_chunks()
    ids, y = np.asarray(table["doc_id"]).astype(np.int64), np.asarray(table["toxic"]).astype(np.int32)
    flat = lambda c, kind: np.asarray(table[c].combine_chunks().flatten() if len(ids) else [], kind)
    hashes, counts = flat("terms", np.int64).view(_U), flat("counts", np.int32)
    offsets = np.concatenate([[0], np.cumsum(np.asarray(table["terms"].combine_chunks().value_lengths()) if len(ids) else np.zeros(0, np.int64))]).astype(np.int64)
    vocabulary, terms = np.unique(hashes, return_inverse=True)
    seen = docs.select("text").mapInArrow(_frequencies(context.broadcast(vocabulary)), "term int, n bigint").groupBy("term").agg(F.sum("n").alias("n")).toArrow()
    at, n = np.asarray(seen["term"]), np.asarray(seen["n"])
    df = np.ones(len(vocabulary))
    df[at[at >= 0]] = n[at >= 0]
    idf = np.log((1 + n[at < 0].sum()) / df)
    kind = np.uint16 if len(counts) and counts.max() < 1 << 16 else np.uint32
    learned = Examples(vocabulary, idf, offsets, terms.astype(np.int32), counts.astype(kind), ids, y)
    shared = context.broadcast(learned)
    rate = (float(y.sum()) + 0.5) / (len(y) + 1)
    spread = docs.sparkSession.range(0, len(ids), 1, min(max(1, len(ids) // 256), context.defaultParallelism))
    voted = spread.mapInArrow(_voter(shared, k), "id bigint, vote double, size bigint").toArrow().sort_by("id")
    sizes = np.asarray(voted["size"]).astype(float)
    odds, own = _tell(learned, sizes)
    telling = np.flatnonzero(odds)
    flat = Rising(np.zeros(1), np.full(1, rate))
    model = Model(shared, context.broadcast((telling, odds[telling])), flat, flat, rate if len(y) else 0.0, k)
    votes = np.asarray(voted["vote"].to_pandas(), float)
    some = ~np.isnan(votes)
    if some.any():
        y, weight = y[some].astype(float), 1 / sizes[some]
        model = model._replace(vote=_isotonic(votes[some], y, weight, rate), odds=_isotonic(own[some], y, weight, rate, middle=True))
    return model


def score_toxicity(docs: DataFrame, labels: DataFrame, shown: int = 10, **options) -> DataFrame:
    """(doc_id, score, toxic, evidence) for every row of docs: the calibrated chance that it is toxic, whether that is at least one half, and the nearest ``shown`` of the ``k`` labelled examples that vote on it, with their similarity and label. Where terms that tell speak for toxic and give a higher chance, that is the score; they aren't shown.

    A document that shares no word with an example, as one that is null, empty
    or without words, has the share of toxic examples as its score, and no
    evidence. Very long texts are one vector of all their words. Null
    labels don't count; of several labels of a document the highest does. Of
    equally near examples, those of lower doc_id are taken. Null and repeated
    doc_ids are scored row by row; of labelled rows that share one, the least text
    is the example. Without labels every score is 0; an empty
    table gives an empty result. Other columns are ignored, whatever their names.
    """
    return _texts(docs).mapInArrow(_scorer(fit(docs, labels, **options), shown), "doc_id bigint, score double, toxic boolean, evidence array<struct<doc_id: bigint, similarity: double, toxic: int>>")


def drop_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs without the documents found toxic. Rows with a null doc_id stay; rows that share a doc_id go together."""
    gone = settle(score_toxicity(docs, labels, shown=0, **options).where("toxic and doc_id is not null").select("doc_id").distinct())
    return without(docs, gone, "doc_id")
