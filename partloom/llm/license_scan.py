"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment of stretches verifies them.

Texts and templates are words without case and outer punctuation, taken five
at a time. Templates fall into classes by size: one of n shingles is looked for
in windows of L shingles, the power of two from 2n on, laid at every L/4-th
shingle. A notice that spans up to L - L/4 + 1 >= 1.5n shingles, words inserted
into it included, lies whole in one of them. Window and template are compared by
``bands`` bands of one minimum each; a window that holds containment c of the
template has a Jaccard similarity of at least J = c*n / (L + (1-c)*n), and the
template is missed with probability (1-J)**bands (``Library.plan`` states n, L,
stride, bands and this probability for each template; 1.3e-6 at worst at the
defaults, where n > 2). Tiny templates, in windows at every shingle, get as many bands
as a probability of 1e-6 takes.

Windows only retrieve: a retrieved template's shingles are looked up in the
whole text, and every stretch from one of them to another is a candidate,
however long it is. Its containment is counted on words, not on hashes. A
notice that is torn apart by a longer insertion is retrieved by the windows over
its pieces, with the probability that their share gives.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from partloom.llm.runtime import utf8
from partloom.llm.words import U, WindowHasher, hash_words, mix, word_table

#: Public licence notices, as they are commonly written.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at',
    "mit": "Released under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "no-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED',
    "mit-text": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "isc-text": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "bsd-2-clause-text": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "zlib-text": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense-text": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
}
OUTER = b".,;:!?()[]{}\"'`*"


@dataclass(frozen=True)
class LicenseScan:
    """containment: least share of a template's shingles. bands: minima compared of a window. miss: what tiny templates are missed with."""

    shingle: int = 5
    containment: float = 0.8
    bands: int = 64
    miss: float = 1e-6


def normal_words(text: bytes) -> list[bytes]:
    return [w for x in text.lower().split() if (w := x.strip(OUTER))]


def shingles(words: list[bytes], p: LicenseScan, table) -> np.ndarray:
    """Hashed shingles in order; a text with fewer words than a shingle is one shingle, one without words none."""
    if not words:
        return np.zeros(0, dtype=U)
    w = hash_words(words, table)
    start = np.arange(max(1, len(w) - p.shingle + 1))
    return WindowHasher(w)(start, np.minimum(start + p.shingle, len(w)))


def stretches(at: list[int], which: list[int], least: int, n: int) -> list[tuple[int, int, int]]:
    """(first, last, distinct) of the best disjoint stretches with ``least`` distinct shingles of n or more.

    at[i] is the place of shingle which[i]. Best is the largest sum of distinct
    shingles, where a gap of g places costs g/n of a shingle and one at most (a
    stretch keeps some worth whatever its gaps), then the fewest places. So
    copies that follow each other stay apart, and a stray shingle far from a
    copy doesn't extend it.
    """
    recent, gaps, best, ends = {}, [0], [(0, 0)], [None]
    for i, (place, shingle) in enumerate(zip(at, which, strict=True)):
        if i:
            gaps.append(gaps[-1] + min(place - at[i - 1] - 1, n))
        recent.pop(shingle, None)
        recent[shingle] = i  # in order of the last occurrence
        top, end = best[i], None
        if len(recent) >= least:
            starts = list(recent.values())
            for d in range(least, len(starts) + 1):
                s = starts[-d]
                worth = (best[s][0] + max(1, n * d - gaps[i] + gaps[s]), best[s][1] - (place - at[s] + 1))
                if worth > top:
                    top, end = worth, (s, d)
        best.append(top)
        ends.append(end)
    out, i = [], len(at)
    while i:
        if ends[i]:
            s, d = ends[i]
            out.append((at[s], at[i - 1], d))
            i = s
        else:
            i -= 1
    return out[::-1]


def word_shingles(words: list[bytes], k: int) -> list[tuple[bytes, ...]]:
    return [tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []


@dataclass
class SizeClass:
    """Templates looked for in windows of one size. holders: which templates have a value as the minimum of a band."""

    length: int
    bands: int
    members: list[int]
    holders: dict[int, list[int]]
    values: np.ndarray
    marks: np.ndarray

    @property
    def stride(self) -> int:
        return max(1, self.length // 4)


#: Bits of a value by which most are told apart from templates' minima.
MARK = U(46)


class Library:
    """Templates as shingle sets, and their MinHash bands by size of window."""

    def __init__(self, templates: dict[str, str], p: LicenseScan, table):
        self.p, self.names = p, list(templates)
        words = [normal_words(t.encode()) for t in templates.values()]
        self.sets = [np.unique(shingles(w, p, table)) for w in words]
        self.words = [set(word_shingles(w, p.shingle)) for w in words]
        by_length: dict[int, list[int]] = {}
        for k, own in enumerate(self.sets):
            if len(own):
                by_length.setdefault(1 << (2 * len(own) - 1).bit_length(), []).append(k)
        self.classes = [self._class(length, members) for length, members in sorted(by_length.items())]

    def least(self, n: int) -> int:
        """The fewest of n shingles that make the containment."""
        return next(d for d in range(1, n + 2) if d / n >= self.p.containment)

    def similarity(self, n: int, length: int) -> float:
        """The least Jaccard similarity of a template and a window that holds enough of it."""
        return self.least(n) / (length + n - self.least(n))

    def _class(self, length: int, members: list[int]) -> SizeClass:
        low = min(self.similarity(len(self.sets[k]), length) for k in members)
        bands = self.p.bands if length > 4 else min(self.p.bands, math.ceil(math.log(self.p.miss) / math.log(1 - low)))
        holders: dict[int, list[int]] = {}
        for k in members:
            for salt in salts(bands):
                holders.setdefault(int(mix(self.sets[k] ^ salt).min()), []).append(k)
        values = np.array(sorted(holders), dtype=U)
        marks = np.zeros(1 << (64 - int(MARK)), dtype=bool)
        marks[values >> MARK] = True
        return SizeClass(length, bands, members, holders, values, marks)

    def plan(self) -> list[tuple[str, int, int, int, int, float]]:
        """(template, shingles, window, stride, bands of one row, probability of a miss within one window) of each template."""
        rows = []
        for c in self.classes:
            rows += [(self.names[k], len(self.sets[k]), c.length, c.stride, c.bands, (1 - self.similarity(len(self.sets[k]), c.length)) ** c.bands) for k in c.members]
        return sorted(rows)

    def retrieved(self, x: np.ndarray, counts: list[int]) -> list[set[int]]:
        """x: the shingles of several texts, end to end, so many of each -> the templates that share a band with one of a text's windows.

        Windows are laid over all of x. One that reaches into the next text
        counts for both: that retrieves more at times, and loses nothing.
        """
        out: list[set[int]] = [set() for _ in counts]
        if not len(x) or not self.classes:
            return out
        ends = np.cumsum(counts)
        whole = 4 * max(c.stride for c in self.classes)
        size = -(-len(x) // whole) * whole + whole
        for k, salt in enumerate(salts(max(c.bands for c in self.classes))):
            low = np.full(size, NOTHING)
            low[: len(x)] = mix(x ^ salt)
            stride = 1
            while stride <= whole // 4:
                pairs = np.minimum(low[:-1], low[1:])
                for c in self.classes:
                    if c.stride == stride and k < c.bands:
                        windows = pairs if c.length < 4 else np.minimum(pairs[:-2], pairs[2:])
                        for i in np.flatnonzero(c.marks[windows >> MARK]).tolist():
                            if found := c.holders.get(int(windows[i])):
                                for text in range(*np.searchsorted(ends, [i * stride, i * stride + c.length - 1], side="right") + [0, 1]):
                                    if text < len(out):
                                        out[text].update(found)
                low, stride = pairs[::2], 2 * stride
        return out

    def matches(self, found: np.ndarray, words: list[bytes], retrieved: set[int]) -> list[tuple[int, int, int, float]]:
        """(template, first shingle, shingles spanned, containment) of each match; those of one template don't overlap."""
        out = []
        for k in sorted(retrieved):
            own, n = self.sets[k], len(self.sets[k])
            at = np.flatnonzero(np.isin(found, own))
            for first, last, _ in stretches(at.tolist(), np.searchsorted(own, found[at]).tolist(), self.least(n), n):
                span = word_shingles(words[first : last + self.p.shingle], self.p.shingle)
                share = len(self.words[k].intersection(span)) / len(self.words[k])
                if share >= self.p.containment:
                    out.append((k, first, last - first + 1, share))
        return sorted(out, key=lambda m: (m[1], m[0]))


def salts(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=U))


#: What no minimum is above.
NOTHING = U(0xFFFFFFFFFFFFFFFF)


def _scanner(templates: dict[str, str], p: LicenseScan):
    def run(batches):
        table = word_table()
        library = Library(templates, p, table)
        for batch in batches:
            rows, held, size = [], [], 0
            docs, texts = batch.column(0).to_pylist(), batch.column(1)

            def flush():
                x = np.concatenate([f for _, _, f in held])
                for (doc, words, found), near in zip(held, library.retrieved(x, [len(f) for _, _, f in held]), strict=True):
                    for k, first, span, share in library.matches(found, words, near):
                        rows.append((doc, library.names[k], first, min(span + p.shingle - 1, len(words)), share))
                held.clear()

            for doc, text in zip(docs, texts, strict=True):
                words = normal_words(text.as_py() or b"")
                if words:
                    held.append((doc, words, shingles(words, p, table)))
                    size += len(words)
                if size >= STEP:
                    flush()
                    size = 0
            if held:
                flush()
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], type=kind) for i, kind in enumerate(kinds)], names=["doc_id", "license", "start_word", "n_words", "containment"])

    return run


#: Words whose windows are compared in one vectorised step; a text is never cut.
STEP = 1 << 15
#: Templates of a table: a library of licences, which goes along with the plan.
MOST_TEMPLATES = 20_000


def scan_licenses(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None, params: LicenseScan = LicenseScan()) -> DataFrame:
    """docs (doc_id, text, ...) -> doc_id, license, start_word, n_words, containment: a row per match.

    templates: texts by name, or a table (name, text) of at most ``MOST_TEMPLATES``
    rows, which raises an error beyond; of repeated names the last text by order
    counts, rows without name or text are left out. Without any, ``TEMPLATES``.

    Words are counted after normalisation. Matches of one template share no
    shingle and are chosen by ``stretches``, a match for each copy; different
    templates may overlap. Null and empty texts have no match, a template
    without words matches nothing, and without templates nothing matches.
    Repeated rows give repeated matches, a null doc_id stays null, texts of any
    length are scanned whole, and other columns are ignored.
    """
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), utf8("text").alias("text"))
    if isinstance(templates, DataFrame):
        rows = templates.where("name is not null and text is not null").select("name", "text").limit(MOST_TEMPLATES + 1).collect()
        if len(rows) > MOST_TEMPLATES:
            raise ValueError(f"more than {MOST_TEMPLATES} templates")
        templates = dict(sorted(map(tuple, rows)))
    return slim.mapInArrow(_scanner(TEMPLATES if templates is None else templates, params), "doc_id long, license string, start_word long, n_words long, containment double")
