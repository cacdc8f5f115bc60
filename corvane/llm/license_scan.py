"""License scans by patience alignment.

Words (runs of letters and digits, lower case) that stand once in the text and once in a template anchor the alignment; the
longest increasing subsequence of the anchors is kept, and the gaps between them are aligned alike, after equal words at
their ends. A gap without an anchor, a few words by then, takes the longest common subsequence. Coverage is the share of the
template's words that are aligned.

A stretch of a text holds a license if LEAST of the template's words, and DENSITY of its own words, can be aligned. No such
stretch is longer than the template's words by DENSITY, so from each word of the template a window of that length decides, and
nothing is missed: words are counted first, then the most that any alignment could give is computed for all ends of the window
at once, in bits. The stretch with most aligned words, and of these the shortest, is aligned by patience; where that falls short of what
can be aligned and of LEAST, by the longest common subsequence. The scan goes on behind the stretch.

One map over the documents; the templates are part of the code. Defined results: null and empty texts hold no license; null
ids are returned as null; repeated rows give rows each; texts of any length are scanned whole; an empty table gives an empty
result; extra columns play no part, whatever their names.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import Words, bounded_batches, chunks, table, texts_of
from .toxicity import _FOLD, _NOT_WORD

LEAST, DENSITY = 0.8, 0.4
# Wording of public licence notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0-line": "Licensed under CC BY-SA 4.0.",
    "gpl-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-line": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _increasing(values: list[int]) -> list[int]:
    """Indices of a longest increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    before = [-1] * len(values)
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        before[i] = piles[k - 1] if k else -1
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out = []
    i = piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = before[i]
    return out[::-1]


def _common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """A longest common subsequence, for gaps without an anchor."""
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(len(a) - 1, -1, -1):
        for j in range(len(b) - 1, -1, -1):
            size[i][j] = size[i + 1][j + 1] + 1 if a[i] == b[j] else max(size[i + 1][j], size[i][j + 1])
    i = j = 0
    out = []
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif size[i + 1][j] >= size[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def align(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of aligned places of a and b, both increasing."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, n = todo.pop()
        while i < j and k < n and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        while i < j and k < n and a[j - 1] == b[n - 1]:
            j, n = j - 1, n - 1
            out.append((j, n))
        if i >= j or k >= n:
            continue
        once_a, once_b = Counter(a[i:j]), Counter(b[k:n])
        where = {w: x for x, w in enumerate(b[k:n], k) if once_b[w] == 1}
        anchors = [(x, where[w]) for x, w in enumerate(a[i:j], i) if once_a[w] == 1 and w in where]
        if not anchors:
            out += [(i + x, k + y) for x, y in _common(a[i:j], b[k:n])]
            continue
        edge = (i, k)
        for x in _increasing([y for _, y in anchors]):
            p, q = anchors[x]
            out.append((p, q))
            todo.append((edge[0], p, edge[1], q))
            edge = (p + 1, q + 1)
        todo.append((edge[0], j, edge[1], n))
    return sorted(out)


class Template:
    """A template's words, and for each the places it stands at as bits, from the left and from the right."""

    def __init__(self, words: list[int], least: float = LEAST, density: float = DENSITY):
        self.words, self.size = words, len(words)
        self.need, self.density = max(1, math.ceil(least * len(words) - 1e-9)), density
        self.reach = int(len(words) / density + 1e-9)
        self.count = Counter(words)
        self.forward: dict[int, int] = {}
        self.backward: dict[int, int] = {}
        for i, w in enumerate(words):
            self.forward[w] = self.forward.get(w, 0) | 1 << i
            self.backward[w] = self.backward.get(w, 0) | 1 << (len(words) - 1 - i)

    def most(self, ids: list[int], at: list[int], k: int) -> tuple[int, int]:
        """(aligned, end): the most words that a stretch from at[k] on can have aligned if it is dense enough, and the least end."""
        full = open_ = (1 << self.size) - 1
        first, best, end = at[k], 0, 0
        while k < len(at) and at[k] < first + self.reach and best < self.size:
            step = open_ & self.forward[ids[at[k]]]
            if step:
                open_ = ((open_ + step) | (open_ - step)) & full
                aligned = self.size - open_.bit_count()
                if aligned > best and aligned >= self.need and aligned >= self.density * (at[k] + 1 - first):
                    best, end = aligned, at[k] + 1
            k += 1
        return best, end

    def last_start(self, ids: list[int], at: list[int], end: int, aligned: int) -> int:
        """The start of the shortest stretch up to end with so many words aligned."""
        full = open_ = (1 << self.size) - 1
        k = bisect_left(at, end) - 1
        while True:
            step = open_ & self.backward[ids[at[k]]]
            open_ = ((open_ + step) | (open_ - step)) & full
            if self.size - open_.bit_count() >= aligned:
                return at[k]
            k -= 1

    def stretches(self, ids: list[int]) -> list[tuple[int, int, int]]:
        """(start, end, aligned) of the stretches of a text, none inside another. ids: of its words, -1 for those of no template."""
        at = [i for i, w in enumerate(ids) if w in self.count]
        out = []
        held: Counter = Counter()
        good = k = hi = 0
        while k < len(at):
            while hi < len(at) and at[hi] < at[k] + self.reach:
                w = ids[at[hi]]
                good += held[w] < self.count[w]
                held[w] += 1
                hi += 1
            after = 0
            if good >= self.need:
                aligned, end = self.most(ids, at, k)
                if aligned:
                    start = self.last_start(ids, at, end, aligned)
                    pairs = align(ids[start:end], self.words)
                    if len(pairs) < self.need or len(pairs) < self.density * (pairs[-1][0] + 1 - pairs[0][0]):
                        pairs = _common(ids[start:end], self.words)
                    out.append((start + pairs[0][0], start + pairs[-1][0] + 1, len(pairs)))
                    after = out[-1][1]
            while True:
                w = ids[at[k]]
                held[w] -= 1
                good -= held[w] < self.count[w]
                k += 1
                if k >= len(at) or at[k] >= after:
                    break
                if k >= hi:
                    hi, held, good = k + 1, Counter((ids[at[k]],)), 1
        return out


class Scanner:
    def __init__(self, templates: dict[str, str] = TEMPLATES):
        self.names = list(templates)
        w = Words([t.encode() for t in templates.values()], _NOT_WORD)
        hashes = w.hashes(_FOLD)
        self.vocabulary = np.unique(hashes)
        ids = np.searchsorted(self.vocabulary, hashes)
        self.templates = [Template(ids[w.of[i] : w.of[i + 1]].tolist()) for i in range(len(templates))]
        self.counts = np.stack([np.bincount(t.words, minlength=len(self.vocabulary)) for t in self.templates])

    def scan(self, texts: list[bytes]) -> list[tuple[int, str, int, int, int, float]]:
        """(text, license, first word, words, aligned words, coverage), each stretch of a text once a template; one that
        overlaps a stretch of larger coverage gives way if that contains it or has more aligned words."""
        w = Words(texts, _NOT_WORD)
        h, doc = w.hashes(_FOLD), w.docs()
        i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        known = self.vocabulary[i] == h
        ids = np.where(known, i, -1)
        width = len(self.vocabulary)
        counts = np.bincount(doc[known] * width + i[known], minlength=len(texts) * width).reshape(len(texts), width)
        out = []
        for t, (name, template) in enumerate(zip(self.names, self.templates, strict=True)):
            possible = np.minimum(counts, self.counts[t]).sum(axis=1) >= template.need
            for d in np.flatnonzero(possible).tolist():
                for start, end, aligned in template.stretches(ids[w.of[d] : w.of[d + 1]].tolist()):
                    out.append((d, name, start, end - start, aligned, round(aligned / template.size, 6)))
        best: dict[int, list] = {}
        for x in sorted(out, key=lambda x: (-x[5], -x[4], x)):
            mine = best.setdefault(x[0], [])
            over = (y for y in mine if x[2] < y[2] + y[3] and y[2] < x[2] + x[3] and y[5] > x[5])
            if not any(y[4] > x[4] or (y[2] <= x[2] and x[2] + x[3] <= y[2] + y[3]) for y in over):
                mine.append(x)
        return sorted(x for mine in best.values() for x in mine)


def licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, start, n_words (of the stretch, in words of the text), aligned, coverage."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        scanner = Scanner(templates)
        for batch in batches:
            texts = texts_of(batch.column(1))
            got = [(a + x[0], *x[1:]) for a, b in chunks(texts) for x in scanner.scan(texts[a:b])]
            row, *rest = zip(*got, strict=True) if got else ([],) * 6
            kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row, pa.int64())), *(pa.array(x, k) for x, k in zip(rest, kinds, strict=True))], ["doc_id", "license", "start", "n_words", "aligned", "coverage"])

    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, license string, start long, n_words long, aligned long, coverage double")


def op6_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses(table(spark, sf_dir, "documents"))
