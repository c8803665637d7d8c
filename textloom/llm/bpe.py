"""Byte-level BPE by merge replay.

The texts of a scan partition are cut into words, and each distinct word of
the shard enters one flat list of symbols. An inverted index from token pair
to the positions where it stands then takes every merge of the vocabulary in
rank order: the pair's positions are merged together in a few array
operations, and only the neighbours of merged symbols are looked up again and
entered into the index. A merge never makes a pair of lower rank than its own
and never crosses a word, so replaying each shard's words gives what replaying
all words of the corpus would, with no shuffle and no table of the corpus's
words on any machine.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.text import CHUNK_CHARS, chunks, forget, give_back

#: Where the vocabulary lies by default; a parameter everywhere.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
#: Bytes of text whose distinct words are replayed together.
SHARD_BYTES = 8 << 20
#: Positions whose pairs are looked up at once.
LOOKUP = 1 << 17

LETTER, NUMBER, SPACE, OTHER = range(4)
_classes: list[np.ndarray] = []


class Vocabulary(NamedTuple):
    """left, right, merged: token ids by rank; first: the token of each byte; pieces: the bytes of each token."""

    left: np.ndarray
    right: np.ndarray
    merged: np.ndarray
    first: np.ndarray
    pieces: list[bytes]


def load_vocabulary(path: str = VOCABULARY) -> Vocabulary:
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte_of = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(shown))}
    vocab = model["vocab"]
    pieces = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        pieces[i] = bytes(byte_of[c] for c in token) if all(c in byte_of for c in token) else token.encode()
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
    first = np.zeros(256, np.int64)
    for c, b in byte_of.items():
        first[b] = vocab[c]
    return Vocabulary(ids[:, 0], ids[:, 1], ids[:, 2], first, pieces)


def _char_classes() -> np.ndarray:
    if not _classes:
        import regex

        code = np.concatenate([np.arange(0xD800), np.arange(0xE000, 0x110000)]).astype(np.uint32)
        every = code.tobytes().decode("utf-32-le")
        table = np.full(0x110000, OTHER, np.int8)
        for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
            for m in regex.finditer(pattern, every):
                table[code[m.start() : m.end()]] = kind
        _classes.append(table)
    return _classes[0]


def _word_starts(code: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Where words begin, as a mask over the characters of several texts, which begin at ``edges``.

    The words are those of the vocabulary's splitting pattern: contractions,
    runs of letters, of numbers and of other characters, each with one space
    before it, and runs of white space.
    """
    n = len(code)
    kind = _char_classes()[code]
    new_text = np.zeros(n + 1, bool)
    new_text[edges] = True
    new_text[n] = True
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | new_text[1:n]
    begins = np.flatnonzero(start)
    last = np.append(begins[1:], n) - 1
    # white space before something else in the same text leaves its last character to that, or alone
    blank = (kind[begins] == SPACE) & ~new_text[last + 1]
    tail = last[blank]
    joined = code[tail] == 32
    start[tail] = True
    start[tail[joined] + 1] = False
    # contractions: an apostrophe that begins a word, and certain letters
    mark = np.flatnonzero((code == 39) & start)
    mark = mark[mark + 1 < n]
    mark = mark[~new_text[mark + 1]]
    one = code[mark + 1]
    length = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
    more = (mark + 2 < n) & ~new_text[np.minimum(mark + 2, n)]
    two = code[np.minimum(mark + 2, n - 1)]
    for a, b in ("re", "ve", "ll"):
        length[(one == ord(a)) & more & (two == ord(b))] = 2
    mark, length = mark[length > 0], length[length > 0]
    start[mark + 1] = False
    after = mark + 1 + length
    within = after < n
    after = after[within]
    start[after[(kind[after] == LETTER) & ~new_text[after]]] = True
    return start


def split_words(texts: pa.Array) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """All words of the texts in order, which tile them, and the range of words of each text."""
    texts = texts.fill_null("").cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    if data is None or offsets[-1] == offsets[0]:
        return pa.array([], pa.large_binary()), np.zeros(len(texts) + 1, np.int64)
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    code = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    heads = np.flatnonzero((raw & 0xC0) != 0x80) if len(code) < len(raw) else np.arange(len(raw))
    edges = np.searchsorted(heads, offsets[:-1])
    start = heads[_word_starts(code, edges[edges < len(code)])]
    bounds = np.append(start, len(raw))
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(raw)])
    return words, np.searchsorted(bounds, offsets)


class Replay:
    """Applies all merges to lists of distinct words."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        pair = vocabulary.left << 32 | vocabulary.right
        order = np.argsort(pair, kind="stable")
        # of equal pairs the first rank counts
        keep = np.ones(len(order), bool)
        keep[1:] = pair[order][1:] != pair[order][:-1]
        self.pairs, self.rank_of = np.append(pair[order][keep], np.int64(2**62)), np.append(order[keep], -1)

    def _ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.pairs, key)
        return np.where(self.pairs[at] == key, self.rank_of[at], -1)

    def _enter(self, pending: list, positions: np.ndarray, ranks: np.ndarray) -> None:
        keep = ranks >= 0
        positions, ranks = positions[keep], ranks[keep]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        positions, ranks = positions[order], ranks[order]
        cuts = np.flatnonzero(np.diff(ranks)) + 1
        for r, part in zip(ranks[np.append(0, cuts)].tolist(), np.split(positions, cuts) if len(cuts) else [positions]):
            if pending[r] is None:
                pending[r] = [part]
            else:
                pending[r].append(part)

    def tokens(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words in a row, and the range of each word."""
        words = words.cast(pa.large_binary())
        bounds = np.frombuffer(words.buffers()[1], np.int64)[words.offset : words.offset + len(words) + 1]
        if not len(words) or bounds[-1] == bounds[0]:
            return np.zeros(0, np.int32), np.zeros(len(words) + 1, np.int64)
        raw = np.frombuffer(words.buffers()[2], np.uint8)[bounds[0] : bounds[-1]]
        bounds = bounds - bounds[0]
        n = len(raw)
        # two workers and a JVM share an executor's memory, so places are as narrow as they can be
        place = np.int32 if n < 2**31 - 2 else np.int64
        symbol = np.full(n + 1, -1, np.int32)  # at n stands what follows the last symbol of a word
        symbol[:n] = self.v.first.astype(np.int32)[raw]
        following, previous = np.arange(1, n + 2, dtype=place), np.arange(-1, n, dtype=place)
        following[bounds[1:] - 1] = n
        previous[bounds[:-1]] = n
        following[n] = previous[n] = n
        pending: list = [None] * len(self.v.left)
        for begin in range(0, n, LOOKUP):
            inner = (begin + np.flatnonzero(following[begin : min(n, begin + LOOKUP)] < n)).astype(place)
            self._enter(pending, inner, self._ranks(symbol[inner], symbol[inner + 1]))
        left, right, merged = self.v.left.tolist(), self.v.right.tolist(), self.v.merged.tolist()
        for r in range(len(pending)):
            if pending[r] is None:
                continue
            at, pending[r] = pending[r], None
            at = at[0] if len(at) == 1 else np.unique(np.concatenate(at))
            a, b = left[r], right[r]
            at = at[(symbol[at] == a) & (symbol[following[at]] == b)]
            if not len(at):
                continue
            if a == b and len(at) > 1:  # of a run of equal symbols, every second from its start
                run = np.ones(len(at), bool)
                run[1:] = following[at[:-1]] != at[1:]
                i = np.arange(len(at))
                at = at[(i - np.maximum.accumulate(np.where(run, i, 0))) % 2 == 0]
            gone = following[at]
            then = following[gone]
            symbol[at], symbol[gone] = merged[r], -1
            following[at] = then
            previous[then] = at
            before = previous[at]
            previous[n] = n
            before, onward = before[before < n], at[then < n]
            touched = np.unique(np.concatenate([before, onward]))
            if len(touched):
                self._enter(pending, touched, self._ranks(symbol[touched], symbol[following[touched]]))
        del pending, following, previous
        alive = np.flatnonzero(symbol[:n] >= 0)
        return symbol[alive], np.searchsorted(alive, bounds)


def _gather(values: np.ndarray, ranges: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The values of the ranges that index names, in a row, and where each begins."""
    length = np.diff(ranges)[index]
    ends = np.cumsum(length)
    begins = np.concatenate([[0], ends])
    return values[np.repeat(ranges[:-1][index] - begins[:-1], length) + np.arange(begins[-1])], begins


def _shards(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[list[pa.RecordBatch]]:
    shard, held = [], 0
    for batch in batches:
        for part in chunks(batch, "text", CHUNK_CHARS):
            shard.append(part)
            held += pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held >= size:
                yield shard
                shard, held = [], 0
    if shard:
        yield shard


def _pieces(vocabulary: Vocabulary) -> pa.Array:
    return pa.array(vocabulary.pieces, pa.large_binary())


def joined(pieces: pa.Array, tokens: np.ndarray, ranges: np.ndarray) -> pa.LargeBinaryArray:
    """The bytes of each range of tokens."""
    parts = pieces.take(pa.array(tokens))
    if not len(tokens):
        return pa.array([b""] * (len(ranges) - 1), pa.large_binary())
    bounds = np.frombuffer(parts.buffers()[1], np.int64)[parts.offset : parts.offset + len(parts) + 1]
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ranges) - 1, [None, pa.py_buffer(bounds[ranges]), parts.buffers()[2]])


def _coded(shard: list[pa.RecordBatch], replay: Replay) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray, np.ndarray]:
    """By part of the shard, which distinct word each word is and the range of words of each text; and the distinct words' tokens and ranges."""
    words, texts = zip(*(split_words(part.column("text")) for part in shard))
    # the chunks get one dictionary; the words themselves are gone before the replay
    coded = pa.chunked_array(words, pa.large_binary()).dictionary_encode()
    flat = np.concatenate([np.asarray(c.indices) for c in coded.chunks] or [np.zeros(0, np.int32)])
    index = np.split(flat, np.cumsum([len(w) for w in words])[:-1])
    distinct = coded.chunk(0).dictionary if coded.num_chunks else pa.array([], pa.large_binary())
    del words, coded
    return index, texts, *replay.tokens(distinct)


def _encoder(vocabulary, shard_bytes: int):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        replay = Replay(vocabulary.value)
        pieces = _pieces(vocabulary.value)
        for shard in _shards(batches, shard_bytes):
            index, texts, tokens, ranges = _coded(shard, replay)
            give_back()
            for part, own, within in zip(shard, index, texts):
                ids, begins = _gather(tokens, ranges, own)
                bounds = begins[within]
                text = part.column("text")
                back = joined(pieces, ids, bounds)
                same = pc.equal(back, text.cast(pa.large_binary()))
                lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids), mask=text.is_null())
                count = pa.array(np.diff(bounds), mask=np.asarray(text.is_null()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists, count, same], names=["doc_id", "token_ids", "n_tokens", "round_trip"])

    return encode


def encode(docs: DataFrame, vocabulary: str = VOCABULARY, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, token_ids, n_tokens, round_trip) for every row of docs: its text's tokens, and whether decoding them gives the text again.

    A null text has null tokens, count and round_trip; an empty one no tokens.
    Null and repeated ids are kept as they are. Texts are encoded whole. Other
    columns are ignored, whatever their names.
    """
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    return rows.mapInArrow(_encoder(shared, shard_bytes), "doc_id bigint, token_ids array<int>, n_tokens bigint, round_trip boolean")


def _decoder(vocabulary):
    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _pieces(vocabulary.value)
        for batch in batches:
            lists = batch.column("token_ids")
            flat = np.asarray(lists.flatten())
            ranges = np.concatenate([[0], np.cumsum(np.asarray(pc.list_value_length(lists).fill_null(0)))])
            texts = joined(pieces, flat, ranges)
            known = pa.array([b.decode(errors="replace") if ok else None for b, ok in zip(texts.to_pylist(), lists.is_valid().to_pylist())], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), known], names=["doc_id", "text"])

    return decode


def decode(encoded: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, text) from (doc_id, token_ids). Null lists give null; tokens that aren't UTF-8 together give replacement characters."""
    shared = encoded.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    return encoded.select("doc_id", F.col("token_ids").cast("array<int>").alias("token_ids")).mapInArrow(_decoder(shared), "doc_id bigint, text string")
