"""Document likelihood over the lattice of all subword segmentations.

The probability of a text is the sum, over all ways to cut it into pieces of a
vocabulary, of the product of the pieces' probabilities; a forward recursion in
log space gives it without listing the ways. Pieces never reach over the space
that ends a word, so a text's probability is the product of its words'.

The vocabulary comes with scores that say how pieces rank. Probabilities fall
with the rank as in Zipf's law; expected counts of the pieces over all
segmentations of all words of the corpus (one forward-backward pass) then turn
them into those of this corpus. The vocabulary itself is taken as it is.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import only
from textloom.llm.text import _flat, chunks, mix

#: Where the vocabulary lies by default; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of text that are split into words together.
SHARD_BYTES = 4 << 20
#: Distinct words whose probabilities a task keeps for its next texts, before it begins anew.
KEPT_WORDS = 4 << 20
#: Characters of distinct words whose lattices are held at a time.
BLOCK_CHARS = 1 << 18
#: Words of more characters go through the recursion one by one.
LONG_WORD = 512

_U = np.uint64
_SPACE = 0x2581
_BASE = _U(0x9E3779B97F4A7C15)
_BITS = 22


class Vocabulary(NamedTuple):
    """Pieces as code points; byte_piece: the piece of each byte; scores: log probabilities before any corpus is seen."""

    codes: list[np.ndarray]
    byte_piece: np.ndarray
    scores: np.ndarray


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    codes, byte_piece, order = [], np.full(256, -1), []
    for i in range(model.vocab_size()):
        piece = model.id_to_piece(i)
        if model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
            continue
        if model.is_byte(i):
            byte_piece[int(piece[3:5], 16)] = len(codes)
            codes.append(np.zeros(0, np.uint32))
        else:
            codes.append(np.array([ord(c) for c in piece], np.uint32))
        order.append(model.get_score(i) if not model.is_byte(i) else -np.inf)
    rank = np.empty(len(order))
    rank[np.argsort(-np.array(order), kind="stable")] = np.arange(len(order))
    weight = 1 / (rank + 2.7)
    return Vocabulary(codes, byte_piece, np.log(weight / weight.sum()))


def _hash(code: np.ndarray) -> np.ndarray:
    return mix(code.astype(_U) + _U(1))


class Lattice:
    """Looks up all pieces in words and sums over segmentations."""

    def __init__(self, vocabulary: Vocabulary, scores: np.ndarray):
        self.v, self.scores = vocabulary, np.append(scores, -np.inf)
        self.longest = max(map(len, vocabulary.codes))
        powers = np.ones(self.longest + 1, _U)
        powers[1:] = _BASE
        self.powers = np.cumprod(powers, dtype=_U)
        named = [i for i, c in enumerate(vocabulary.codes) if len(c)]
        keys = np.array([int(mix((_hash(vocabulary.codes[i]) * self.powers[: len(vocabulary.codes[i])]).sum(keepdims=True, dtype=_U))[0]) for i in named], _U)
        named = np.array(named)
        # a table addressed by the hash's leading bits; keys that share a place are searched for instead
        place = (keys >> _U(64 - _BITS)).astype(np.int64)
        self.table = np.full(1 << _BITS, -1, np.int32)
        times = np.bincount(place, minlength=1 << _BITS)
        alone = times[place] == 1
        self.table[place[alone]] = named[alone]
        self.table[place[~alone]] = -2
        self.key_of = np.zeros(len(vocabulary.codes), _U)
        self.key_of[named] = keys
        order = np.argsort(keys[~alone])
        self.crowded, self.crowded_ids = np.append(keys[~alone][order], _U(2**64 - 1)), np.append(named[~alone][order], -1)
        self.single = {int(c[0]) for c in vocabulary.codes if len(c) == 1}
        known = np.zeros(0x110000, bool)
        known[list(self.single)] = True
        self.known = known

    def _find(self, keys: np.ndarray) -> np.ndarray:
        ids = self.table[(keys >> _U(64 - _BITS)).astype(np.int64)]
        ids = np.where((ids >= 0) & (self.key_of[ids] != keys), -1, ids)
        crowd = np.flatnonzero(ids == -2)
        if len(crowd):
            at = np.searchsorted(self.crowded, keys[crowd])
            ids[crowd] = np.where(self.crowded[at] == keys[crowd], self.crowded_ids[at], -1)
        return ids

    def edges(self, code: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By length and position: the piece there, or -1; and the score of spelling out each position's character, -inf if that is a piece. ends: where each position's word ends."""
        n = len(code)
        value = _hash(code)
        pieces = np.full((self.longest + 1, n), -1, np.int32)
        room = ends - np.arange(n)
        sums = np.zeros(n, _U)
        for length in range(1, self.longest + 1):
            sums[: n - length + 1] += value[length - 1 :] * self.powers[length - 1]
            fits = np.flatnonzero(room >= length)
            if not len(fits):
                break
            pieces[length, fits] = self._find(mix(sums[fits]))
        spelt = np.full(n, -np.inf)
        for i in np.flatnonzero(~self.known[code]):
            spelt[i] = sum(self.scores[self.v.byte_piece[b]] for b in chr(code[i]).encode("utf-8", "surrogatepass"))
        return pieces, spelt

    def words(self, code: np.ndarray, bounds: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The log probability of each word; and, given how often each occurs, the expected counts of all pieces."""
        count = len(bounds) - 1
        out, expected = np.zeros(count), np.zeros(len(self.v.codes))
        first = 0
        while first < count:
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + BLOCK_CHARS, side="right")) - 1)
            part, own = code[bounds[first] : bounds[last]], bounds[first : last + 1] - bounds[first]
            length = np.diff(own)
            pieces, spelt = self.edges(part, np.repeat(own[1:], length))
            for n in np.unique(length):
                if n == 0:
                    continue
                rows = np.flatnonzero(length == n)
                for some in np.array_split(rows, max(1, len(rows) * n // (1 << 16))):
                    at = own[some]
                    w = None if weights is None else weights[first + some]
                    out[first + some] = self._long(part, pieces, spelt, at, n, w, expected) if n > LONG_WORD else self._equal(part, pieces, spelt, at, n, w, expected)
            first = last
        return out, expected

    def _equal(self, code, pieces, spelt, at, n, weights, expected) -> np.ndarray:
        """Words of n characters each, together: sums in log space along the lattice, for all words at once."""
        places = at[:, None] + np.arange(n)
        most = min(self.longest, n)
        ids = pieces[1 : most + 1][:, places]  # length, word, position
        score = self.scores[ids]
        score[0] = np.where(ids[0] >= 0, score[0], spelt[places])
        ahead = np.full((n + 1, len(at)), -np.inf)
        ahead[0] = 0
        for j in range(1, n + 1):
            reach = min(most, j)
            ways = np.stack([ahead[j - k] + score[k - 1, :, j - k] for k in range(1, reach + 1)])
            ahead[j] = _logsum(ways)
        if weights is not None:
            back = np.full((n + 1, len(at)), -np.inf)
            back[n] = 0
            for i in range(n - 1, -1, -1):
                reach = min(most, n - i)
                back[i] = _logsum(np.stack([back[i + k] + score[k - 1, :, i] for k in range(1, reach + 1)]))
            for k in range(1, most + 1):
                share = np.exp(ahead[: n - k + 1].T + score[k - 1, :, : n - k + 1] + back[k:].T - ahead[n][:, None]) * weights[:, None]
                mine = ids[k - 1, :, : n - k + 1]
                used = mine >= 0
                expected += np.bincount(mine[used], share[used], minlength=len(expected))
                if k == 1:
                    for r, c in zip(*np.nonzero(~used & (share > 0))):
                        for b in chr(code[at[r] + c]).encode("utf-8", "surrogatepass"):
                            expected[self.v.byte_piece[b]] += share[r, c]
        return ahead[n]

    def _long(self, code, pieces, spelt, at, n, weights, expected) -> np.ndarray:
        out = np.zeros(len(at))
        for r, start in enumerate(at.tolist()):
            mine = pieces[:, start : start + n]
            ks, places = np.nonzero(mine >= 0)
            order = np.argsort(places, kind="stable")
            ks, places = ks[order].tolist(), places[order]
            cuts = np.searchsorted(places, np.arange(n + 1)).tolist()
            ids = mine[ks, places]
            scores, places = self.scores[ids].tolist(), places.tolist()
            plain = spelt[start : start + n].tolist()
            ahead = [-math.inf] * (n + 1)
            ahead[0] = 0.0
            for i in range(n):
                base = ahead[i]
                if plain[i] > -math.inf:
                    ahead[i + 1] = _add(ahead[i + 1], base + plain[i])
                for e in range(cuts[i], cuts[i + 1]):
                    ahead[i + ks[e]] = _add(ahead[i + ks[e]], base + scores[e])
            out[r] = ahead[n]
            if weights is not None:
                back = [-math.inf] * (n + 1)
                back[n] = 0.0
                for i in range(n - 1, -1, -1):
                    total = plain[i] + back[i + 1]
                    if plain[i] > -math.inf:
                        share = math.exp(ahead[i] + total - ahead[n]) * weights[r]
                        for b in chr(code[start + i]).encode("utf-8", "surrogatepass"):
                            expected[self.v.byte_piece[b]] += share
                    for e in range(cuts[i], cuts[i + 1]):
                        way = scores[e] + back[i + ks[e]]
                        expected[ids[e]] += math.exp(ahead[i] + way - ahead[n]) * weights[r]
                        total = _add(total, way)
                    back[i] = total
        return out


def _logsum(ways: np.ndarray) -> np.ndarray:
    top = ways.max(0)
    safe = np.where(np.isfinite(top), top, 0)
    with np.errstate(divide="ignore"):
        return safe + np.log(np.exp(ways - safe).sum(0))


def _add(a: float, b: float) -> float:
    if a < b:
        a, b = b, a
    return a if b == -math.inf else a + math.log1p(math.exp(b - a))


def _split(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of all texts, a space before each that isn't empty; where their words begin, and the end; each text's range of words."""
    flat, offs = _flat(texts)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    full = np.flatnonzero(np.diff(offs))
    code = np.insert(code, offs[:-1][full], 32)
    begins = offs + np.concatenate([[0], np.cumsum(np.diff(offs) > 0)])
    blank = code == 32
    start = blank.copy()
    start[1:] &= ~blank[:-1]
    start[begins[:-1][full]] = True
    words = np.flatnonzero(start)
    code = np.where(blank, np.uint32(_SPACE), code)
    return code, np.append(words, len(code)), np.searchsorted(words, begins)


class Distinct(NamedTuple):
    key: np.ndarray
    code: np.ndarray
    bounds: np.ndarray
    which: np.ndarray
    times: np.ndarray


def _distinct(code: np.ndarray, bounds: np.ndarray) -> Distinct:
    """The distinct words, which one each word is, and how often each occurs."""
    length = np.diff(bounds)
    if not len(length):
        return Distinct(np.zeros(0, _U), code, np.zeros(1, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))
    # a hash along each word: powers begin anew in every word
    place = np.arange(len(code)) - np.repeat(bounds[:-1], length)
    value = _hash(code) * mix(place.astype(_U) + _U(77))
    key = mix(np.add.reduceat(value, bounds[:-1]) + length.astype(_U))
    del value, place
    key, first, which, times = np.unique(key, return_index=True, return_inverse=True, return_counts=True)
    size = length[first]
    own = np.concatenate([[0], np.cumsum(size)])
    take = np.repeat(bounds[:-1][first] - own[:-1], size) + np.arange(own[-1])
    return Distinct(key, code[take], own, which, times)


class _Known:
    """Probabilities of the words that a task has met, by the hash of the word."""

    def __init__(self):
        self.keys, self.values = np.zeros(0, _U), np.zeros(0)

    def of(self, words: Distinct, lattice: Lattice) -> np.ndarray:
        at = np.searchsorted(self.keys, words.key)
        met = at < len(self.keys)
        met[met] = self.keys[at[met]] == words.key[met]
        out = np.empty(len(words.key))
        out[met] = self.values[at[met]]
        new = np.flatnonzero(~met)
        if len(new):
            size = np.diff(words.bounds)[new]
            own = np.concatenate([[0], np.cumsum(size)])
            take = np.repeat(words.bounds[:-1][new] - own[:-1], size) + np.arange(own[-1])
            out[new], _ = lattice.words(words.code[take], own)
            if len(self.keys) > KEPT_WORDS:
                self.keys, self.values = words.key, out
            else:
                self.keys, self.values = np.insert(self.keys, at[new], words.key[new]), np.insert(self.values, at[new], out[new])
        return out


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    held, parts = 0, []
    for batch in batches:
        for part in chunks(batch, "text", 1 << 20):
            parts.append(part)
            held += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held >= size:
                yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
                held, parts = 0, []
    if parts and sum(p.num_rows for p in parts):
        yield pa.Table.from_batches(parts).combine_chunks().to_batches()[0]


def _counter(shard_bytes: int):
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, shard_bytes):
            code, bounds, _ = _split(shard.column("text"))
            own = _distinct(code, bounds)
            flat = own.code.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
            width = 1 + (own.code >= 0x80).astype(np.int64) + (own.code >= 0x800) + (own.code >= 0x10000)
            ends = np.concatenate([[0], np.cumsum(width)])[own.bounds]
            words = pa.LargeStringArray.from_buffers(len(own.times), pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(flat))
            for i in range(0, len(words), 100_000):
                yield pa.RecordBatch.from_arrays([words.slice(i, 100_000).cast(pa.string()), pa.array(own.times[i : i + 100_000], pa.int64())], names=["word", "n"])

    return count


def _expecter(vocabulary):
    def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v: Vocabulary = vocabulary.value
        lattice, total = Lattice(v, v.scores), np.zeros(len(v.codes))
        for batch in batches:
            flat, offs = _flat(batch.column("word"))
            code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
            total += lattice.words(code, offs, np.asarray(batch.column("n"), dtype=float))[1]
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used, pa.int32()), pa.array(total[used])], names=["piece", "expected"])

    return expect


def fit_scores(docs: DataFrame, vocabulary: str = VOCABULARY, prior: float = 1000.0, shard_bytes: int = SHARD_BYTES) -> np.ndarray:
    """Log probabilities of the vocabulary's pieces in the corpus: expected counts over all segmentations of all words, and ``prior`` more spread by rank. Their number is that of the pieces, whatever the corpus."""
    v = load_vocabulary(vocabulary)
    shared = docs.sparkSession.sparkContext.broadcast(v)
    words = only(docs, text="text").where("text is not null").mapInArrow(_counter(shard_bytes), "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    found = words.mapInArrow(_expecter(shared), "piece int, expected double").groupBy("piece").agg(F.sum("expected").alias("expected")).toPandas()
    weight = prior * np.exp(v.scores)
    weight[found["piece"].to_numpy(np.int64)] += found["expected"].to_numpy(float)
    return np.log(weight / weight.sum())


def _scorer(vocabulary, scores, shard_bytes: int):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, known = Lattice(vocabulary.value, scores.value), _Known()
        for shard in _shards(batches, shard_bytes):
            text = shard.column("text")
            code, bounds, ranges = _split(text)
            own = _distinct(code, bounds)
            each = known.of(own, lattice)
            owner = np.repeat(np.arange(len(text)), np.diff(ranges))
            total = np.bincount(owner, each[own.which], minlength=len(text)) if len(owner) else np.zeros(len(text))
            size = np.asarray(pc.binary_length(text).fill_null(0), dtype=float)
            null = np.asarray(text.is_null())
            bits = np.divide(-total, size * math.log(2), out=np.zeros(len(text)), where=size > 0)
            yield pa.RecordBatch.from_arrays(
                [shard.column("doc_id"), pa.array(np.diff(ranges), pa.int64(), mask=null), pa.array(np.round(total, 6), mask=null), pa.array(np.round(bits, 6), mask=null | (size == 0))],
                names=["doc_id", "n_words", "log_prob", "bits_per_byte"],
            )

    return score


def score_documents(docs: DataFrame, vocabulary: str = VOCABULARY, scores: np.ndarray | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, n_words, log_prob, bits_per_byte) for every row of docs: the log of its text's probability, summed over all segmentations, with the scores given or else those of docs itself.

    Characters that no piece has are spelt in bytes. A null text has nulls; an
    empty one no words, the log probability 0 and no bits per byte. Null and
    repeated doc_ids are scored row by row. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    sc = docs.sparkSession.sparkContext
    if scores is None:
        scores = fit_scores(docs, vocabulary, shard_bytes=shard_bytes)
    rows = only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(_scorer(sc.broadcast(load_vocabulary(vocabulary)), sc.broadcast(scores), shard_bytes), "doc_id bigint, n_words bigint, log_prob double, bits_per_byte double")
