"""Vectorised word hashing over Arrow string columns.

A *word* is a maximal run of Unicode letters and numbers of the lower-cased
text, the same definition as the regular expression ``[\\p{L}\\p{N}]+``.
Whole batches are hashed with numpy: no Python loop runs per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute

_U = np.uint64
_BASE = _U(0x9E3779B97F4A7C15)
_GRAM = _U(0xD6E8FEB86659FD93)
#: Characters that one numpy pass handles; a longer document is a pass of its own.
CHUNK_CHARS = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of SplitMix, which is a bijection."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x *= _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, _U(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 20)
            one = np.ones(size, _U)
            one[1:] = self.base
            self.up = np.cumprod(one, dtype=_U)
            one[1:] = self.inverse
            self.down = np.cumprod(one, dtype=_U)
        return self.up, self.down


_char_powers, _gram_powers = _Powers(_BASE), _Powers(_GRAM)
_tables: list[np.ndarray] = []


def _char_tables() -> tuple[np.ndarray, np.ndarray]:
    """By code point: the hash value of its lower case, and whether it belongs to a word."""
    if not _tables:
        chars = np.arange(0x32400, dtype=np.uint32).view("U1")  # no letter or number lies beyond
        word = np.zeros(0x110000, bool)
        word[: len(chars)] = np.char.isalpha(chars) | np.char.isnumeric(chars)
        lower = np.arange(0x110000, dtype=_U)
        cased = chars[:0x1F000]
        lower[: len(cased)] = np.char.lower(cased).astype("U1").view(np.uint32)
        lower[0x130] = ord("i")  # the only one with a lower case of two characters
        _tables.extend([mix(lower + _U(1)), word])
    return _tables[0], _tables[1]


class Words(NamedTuple):
    """The words of consecutive documents: 64-bit hashes, the word range of each document (``offsets``, one more than documents), and each word's character range within its document's text."""

    hashes: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray


def _flat(texts: pa.Array) -> tuple[str, np.ndarray]:
    """All texts as one string, and where each begins in it, in characters. Null counts as empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    try:
        flat = raw.tobytes().decode()
    except UnicodeDecodeError:
        parts = [raw[a - offsets[0] : b - offsets[0]].tobytes().decode(errors="replace") for a, b in zip(offsets[:-1], offsets[1:])]
        return "".join(parts), np.cumsum([0, *map(len, parts)])
    if len(flat) == len(raw):
        return flat, offsets - offsets[0]
    begins = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return flat, begins[offsets - offsets[0]]


def words_of(texts: pa.Array) -> Words:
    """Hash all words of a string array at once."""
    flat, offs = _flat(texts)
    n = len(flat)
    if not n:
        none = np.zeros(0, np.int64)
        return Words(none.astype(_U), np.zeros(len(offs), np.int64), none, none)
    code = np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), np.uint32)
    value, word = _char_tables()
    inside = word[code]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    up, down = _char_powers.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(value[code] * up[:n], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * down[starts])
    first = np.searchsorted(starts, offs)
    base = np.repeat(offs[:-1], np.diff(first))
    return Words(hashes, first, starts - base, ends - base)


def word_hash(word: str) -> int:
    """The hash that :func:`words_of` gives to one word."""
    return int(words_of(pa.array([word])).hashes[0])


def spans_hash(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray | int) -> np.ndarray:
    """Hashes of runs of consecutive words, given by first word and number of words."""
    n = len(hashes)
    up, down = _gram_powers.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(hashes * up[:n], out=sums[1:])
    return mix((sums[starts + lengths] - sums[starts]) * down[starts])


def shingles_of(words: Words, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words in each document, and the range of each document.

    A document of fewer than n words, but at least one, has one shingle: all its words.
    """
    count = np.diff(words.offsets)
    per = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    offsets = np.concatenate([[0], np.cumsum(per)])
    starts = np.arange(offsets[-1]) + np.repeat(words.offsets[:-1] - offsets[:-1], per)
    return spans_hash(words.hashes, starts, np.repeat(np.minimum(count, n), per)), offsets


def distinct(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values of each range."""
    owner = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    keep = np.ones(len(values), bool)
    keep[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[keep], np.searchsorted(owner[keep], np.arange(len(offsets)))


_libc: list = []


def give_back() -> None:
    """Return freed memory to the system, as far as its allocator can; workers are reused by later stages, and share a machine's memory with the JVM."""
    if not _libc:
        libc = ctypes.CDLL(None)
        pa.set_memory_pool(pa.system_memory_pool())
        if hasattr(libc, "mallopt"):
            libc.mallopt(-3, 1 << 20)  # arrays of 1 MB and more are mapped, and unmapped when freed
        _libc.append(getattr(libc, "malloc_trim", None))
    if _libc[0]:
        _libc[0](0)


def forget() -> None:
    """Drop the tables for hashing words, which grow again on demand; a worker that earlier stages used may not need them any more."""
    _tables.clear()
    for powers in (_char_powers, _gram_powers):
        powers.up = powers.down = np.ones(1, _U)
    give_back()


def chunks(batch: pa.RecordBatch, column: str, size: int = CHUNK_CHARS) -> Iterator[pa.RecordBatch]:
    """Consecutive slices of a batch with about ``size`` bytes of text each, one row at least."""
    texts = batch.column(column)
    lengths = np.asarray(pa.compute.binary_length(texts).fill_null(0), dtype=np.int64)
    if not len(lengths):
        return
    give_back()
    group = np.cumsum(lengths) // size
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1), len(lengths)]
    for a, b in zip(cuts[:-1], cuts[1:]):
        yield batch.slice(a, b - a)
    give_back()


def list_array(values: pa.Array, offsets: np.ndarray) -> pa.Array:
    """A list column from flat values and ranges."""
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)
