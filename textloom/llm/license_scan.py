"""License scans by patience alignment.

A template and a stretch of text are anchored on the words that are unique to
both; the longest increasing subsequence of the anchors is kept, and each gap
between two anchors is aligned again by itself, where more words are unique.
Runs of equal words at the ends of a gap are matched directly. Coverage is the
share of the template's words that are matched in order.

Only stretches around a run of ``seed`` words common to text and template are
aligned. Texts are looked through whole; templates are few and fixed by a
parameter, so each scan partition works alone and nothing is shuffled.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.common import only
from textloom.llm.text import chunks, spans_hash, words_of

#: Names and the words by which each license is stated.
TEMPLATES: dict[str, str] = {
    "mit-notice": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
    ),
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
        "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, "
        "or (at your option) any later version."
    ),
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "all-rights-reserved": "All rights reserved.",
}


def align(a: list, b: list) -> list[tuple[int, int]]:
    """Matched positions (in a, in b), rising in both."""
    found: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            found.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m = j - 1, m - 1
            found.append((j, m))
        if i == j or k == m:
            continue
        here, there = Counter(a[i:j]), Counter(b[k:m])
        place = {w: p for p, w in enumerate(b[k:m], k) if there[w] == 1}
        both = [(p, place[w]) for p, w in enumerate(a[i:j], i) if here[w] == 1 and w in place]
        anchors = _rising(both)
        if not anchors:
            continue
        found += anchors
        at = (i, k)
        for p, q in [*anchors, (j, m)]:
            todo.append((at[0], p, at[1], q))
            at = p + 1, q + 1
    return sorted(found)


def _rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest subsequence whose second members rise, by patience sorting."""
    tops: list[int] = []
    last: list[int] = []
    before: list[int] = []
    for n, (_, q) in enumerate(pairs):
        pile = bisect_left(tops, q)
        before.append(last[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(q)
            last.append(n)
        else:
            tops[pile], last[pile] = q, n
    out = []
    n = last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def scan_words(words: list, seeds: list[tuple[int, int]], template: list, threshold: float) -> list[tuple[int, int, float]]:
    """(first word, number of words, coverage) of the stretches of a text that hold the template. seeds: (place in the text, place in the template) of common runs."""
    size = len(template)
    # seeds whose stretches would meet are looked at together
    stretches: list[list[int]] = []
    for p, q in sorted(seeds):
        low, high = p - 2 * q - 8, p + 2 * (size - q) + 8
        if stretches and low < stretches[-1][1]:
            stretches[-1][1] = max(stretches[-1][1], high)
        else:
            stretches.append([low, high])
    out = []
    todo = [(max(0, low), min(len(words), high)) for low, high in stretches]
    while todo:
        low, high = todo.pop()
        if high - low < threshold * size:
            continue
        matched = align(words[low:high], template)
        coverage = len(matched) / size
        if coverage >= threshold:
            first, last = low + matched[0][0], low + matched[-1][0] + 1
            if last - first <= 2 * size + 8:
                out.append((first, last - first, coverage))
                todo += [(low, first), (last, high)]
                continue
        # the template may stand several times, so that its words aren't unique: each seed by itself
        at = low
        for p, q in sorted(seeds):
            if at <= p < high:
                matched = _around(words, template, p, q, at, high)
                if len(matched) >= threshold * size:
                    first, last = matched[0][0], matched[-1][0] + 1
                    out.append((first, last - first, len(matched) / size))
                    at = last
    return sorted(out)


def _around(words: list, template: list, p: int, q: int, low: int, high: int) -> list[tuple[int, int]]:
    """Of the alignments around a seed at p in the text and q in the template, the one that matches most words on a stretch that isn't too long; of equal ones the shorter."""
    size = len(template)
    tried = []
    for start, end in ((p - 2 * q - 8, p + 2 * (size - q) + 8), (p - q - 2, p - q + size + 2)):
        start, end = max(low, start), min(high, end)
        # with the seed as a fixed point, what stands next to the copy can't make its words less unique
        tried.append([(start + i, k) for i, k in align(words[start:p], template[:q])] + [(p + i, q + k) for i, k in align(words[p:end], template[q:])])
    tried.append([(start + i, k) for i, k in align(words[start:end], template)])
    fit = [x for x in tried if x and x[-1][0] + 1 - x[0][0] <= 2 * size + 8]
    return max(fit, key=lambda x: (len(x), x[0][0] - x[-1][0]), default=[])


def best_of(found: list[tuple[int, int, int, float]], sizes: list[int]) -> list[tuple[int, int, int, float]]:
    """Of stretches (template, first word, number of words, coverage) that overlap, the one with the most matched words; of equal ones the shorter, then the earlier."""
    kept: list[tuple[int, int, int, float]] = []
    for x in sorted(found, key=lambda x: (-round(x[3] * sizes[x[0]]), x[2], x[1], x[0])):
        if all(x[1] >= y[1] + y[2] or y[1] >= x[1] + x[2] for y in kept):
            kept.append(x)
    return kept


def _scanner(templates: dict[str, str], threshold: float, seed: int):
    names = list(templates)
    cut = words_of(pa.array([templates[x] for x in names], pa.string()))
    own = [cut.hashes[a:b] for a, b in zip(cut.offsets[:-1], cut.offsets[1:])]
    keys, which, where = [], [], []
    for t, words in enumerate(own):
        if len(words) < seed:
            raise ValueError(f"template {names[t]} has fewer than {seed} words")
        runs = spans_hash(words, np.arange(len(words) - seed + 1), seed)
        keys.append(runs)
        which.append(np.full(len(runs), t))
        where.append(np.arange(len(runs)))
    key, which, where = np.concatenate(keys), np.concatenate(which), np.concatenate(where)
    order = np.argsort(key, kind="stable")
    key, which, where = key[order], which[order], where[order]
    templates_ = [w.tolist() for w in own]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for part in chunks(batch, "text"):
                words = words_of(part.column("text"))
                if len(words.hashes) < seed:
                    continue
                runs = spans_hash(words.hashes, np.arange(len(words.hashes) - seed + 1), seed)
                low, high = np.searchsorted(key, runs), np.searchsorted(key, runs, side="right")
                hit = np.flatnonzero(high > low)
                owner = np.searchsorted(words.offsets, hit, side="right") - 1
                inside = hit + seed <= words.offsets[owner + 1]
                seeds: dict[tuple[int, int], list[tuple[int, int]]] = {}
                for p, d in zip(hit[inside].tolist(), owner[inside].tolist()):
                    for k in range(low[p], high[p]):
                        seeds.setdefault((d, int(which[k])), []).append((p - int(words.offsets[d]), int(where[k])))
                ids = part.column("doc_id")
                met: dict[int, list[tuple]] = {}
                for (d, t), found in seeds.items():
                    mine = words.hashes[words.offsets[d] : words.offsets[d + 1]].tolist()
                    met.setdefault(d, []).extend((t, *x) for x in scan_words(mine, found, templates_[t], threshold))
                for d, found in met.items():
                    out += [(ids[d].as_py(), names[t], first, length, round(coverage, 6)) for t, first, length, coverage in best_of(found, [len(w) for w in templates_])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([x[i] for x in out], kind) for i, kind in enumerate((pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))],
                names=["doc_id", "license", "first_word", "n_words", "coverage"],
            )

    return scan


def scan_licenses(docs: DataFrame, templates: dict[str, str] = TEMPLATES, threshold: float = 0.8, seed: int = 3) -> DataFrame:
    """(doc_id, license, first_word, n_words, coverage): the stretches of each text that hold at least ``threshold`` of a template's words in order.

    Words are compared without case and punctuation. A template that stands
    several times in a text is found each time; of stretches that overlap, the
    one with the most matched words counts, of equal ones the shortest. A stretch is at most twice as long as
    its template, and eight words. Null or empty texts hold no license. Null
    and repeated doc_ids are scanned row by row. An empty table gives an empty
    result. Other columns are ignored, whatever their names.
    """
    rows = only(docs, doc_id="doc_id", text="text").withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(_scanner(templates, threshold, seed), "doc_id bigint, license string, first_word bigint, n_words bigint, coverage double")
