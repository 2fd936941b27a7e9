"""License scan: fingerprints pick candidates, banded alignment decides.

Words are runs of ASCII letters and digits or of bytes above 127, lower-cased.
The hashes of all word ``GRAM``-grams of a template are its fingerprints, and an
inverted index holds template and place of each; templates of fewer than
``FEW`` words have pairs of words instead.  Where at most a fifth of a template's
words are changed, a run of that many is left, so that no such match is missed.
Every gram of a document is looked up in the index.  Hits of a
template on one diagonal make a group; groups that follow each
other in both texts, as where foreign words or a line of another text stand in
between, are chained into one candidate window.  A window with fewer different
grams of the template than a fifth of changed words leaves is dropped.  Template
and window are aligned by a local alignment in a band that holds the window's
diagonals (a match +2, anything else -1), a row of the band at a time, which gives
the matched words, the coverage (of the template's words) and the span.

The index has the templates' size, not the corpus'; documents are read one by one
and nothing is shuffled.

Defined cases.  Null and empty texts have no matches.  Of overlapping spans in a
document, the one with more matched words stays, then the higher coverage, then
the earlier, then the template's name.  Offsets count characters, the end
excluded.  Repeated rows give repeated matches; a null id stays null; further
columns are ignored; an empty table gives an empty one.
"""

from __future__ import annotations

import bisect
import math
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import lowered, mix, text_slices, word_hashes

_U = np.uint64
GRAM, FEW = 3, 6
NEAR = 64  # groups of hits in document order among which a chain is sought
GAP = 8  # words without a hit that end a group
_STEP = [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9]

# Public licence notices, as their publishers word them.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-notice", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("bsd-conditions", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("cc-by-4.0-line", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa-4.0-line", "Licensed under CC BY-SA 4.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3.0-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mit-line", "Released under the MIT License."),
    ("mit-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("mit-full", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("isc-full", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("bsd-3-full", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("mpl-2.0-notice", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
)

_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and the first word of each row."""
    n = len(data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    word = _WORD[data]
    head, tail = word.copy(), word.copy()
    head[1:] &= ~word[:-1]
    tail[:-1] &= ~word[1:]
    row_heads = offsets[:-1][offsets[:-1] < n]
    head[row_heads] = word[row_heads]
    row_tails = offsets[1:][offsets[1:] > 0] - 1
    tail[row_tails] = word[row_tails]
    starts = np.flatnonzero(head)
    return starts, np.flatnonzero(tail) + 1, np.searchsorted(starts, offsets)


def grams_of(w: np.ndarray, size: int) -> np.ndarray:
    count = max(0, len(w) - size + 1)
    out = np.zeros(count, _U)
    for j in range(size):
        out += w[j : j + count] * _U(_STEP[j])
    return mix(out)


class Index:
    """The templates' words and the inverted indices of their grams, by size."""

    def __init__(self, templates: Sequence[tuple[str, str]]) -> None:
        self.names = [n for n, _ in templates]
        self.words: list[np.ndarray] = []
        postings: dict[int, dict[int, list[tuple[int, int]]]] = defaultdict(lambda: defaultdict(list))
        for t, (name, text) in enumerate(templates):
            data = lowered(np.frombuffer(text.encode(), np.uint8))
            starts, ends, _ = word_spans(data, np.array([0, len(data)]))
            w = word_hashes(data, starts, ends)
            if len(w) < GRAM:
                raise ValueError(f"a template of fewer than {GRAM} words: {name}")
            self.words.append(w)
            size = GRAM if len(w) >= FEW else GRAM - 1
            for at, gram in enumerate(grams_of(w, size).tolist()):
                postings[size][gram].append((t, at))
        self.keys = {size: np.array(sorted(by), _U) for size, by in postings.items()}
        self.postings = {size: [by[k] for k in sorted(by)] for size, by in postings.items()}

    def hits(self, grams: np.ndarray, size: int) -> np.ndarray:
        """Places among ``grams`` that are in the index."""
        keys = self.keys[size]
        at = np.searchsorted(keys, grams)
        at[at == len(keys)] = 0
        return np.flatnonzero(keys[at] == grams)


def align(t: np.ndarray, d: np.ndarray, shift: int, band: int) -> tuple[int, int, int]:
    """The best local alignment of template words ``t`` with document words
    ``d`` within ``band`` of the diagonal d = t + shift: (matched words, first
    and last document word + 1).  A row of scores is made at once: a step along
    the document costs 1, so it is the running maximum of score plus place."""
    n = len(d)
    score, matched, start = (np.zeros(n + 1, np.int64) for _ in range(3))  # at j: behind document word j - 1
    best = (0, 0, 0, 0)  # score, matched, start, end
    for i, word in enumerate(t):
        lo, hi = max(0, i + shift - band), min(n, i + shift + band + 1)
        new, new_matched, new_start = (np.zeros(n + 1, np.int64) for _ in range(3))
        if lo < hi:
            here, before = slice(lo + 1, hi + 1), slice(lo, hi)
            place = np.arange(lo, hi)
            same = d[lo:hi] == word
            along, down = score[before] + np.where(same, 2, -1), score[here] - 1
            pick = along >= down
            top = np.maximum(np.maximum(along, down), 0)
            came = np.where(pick, np.where(score[before] > 0, start[before], place), start[here])
            held = np.where(pick, np.where(score[before] > 0, matched[before], 0) + same, matched[here])
            reach = np.maximum.accumulate(top + place)
            origin = np.maximum.accumulate(np.where(top + place == reach, np.arange(hi - lo), 0))
            value = reach - place
            new[here] = value
            new_matched[here], new_start[here] = held[origin], came[origin]
            at = int(value.argmax())
            if value[at] > best[0]:
                best = (int(value[at]), int(new_matched[lo + 1 + at]), int(new_start[lo + 1 + at]), lo + at + 1)
        score, matched, start = new, new_matched, new_start
    return best[1], best[2], best[3]


def windows(hits: list[tuple[int, int]], words: int) -> Iterator[tuple[int, int, int]]:
    """Lowest and highest diagonal of the chained groups of one template's
    (document place, template place) hits, and how many places of the template
    they hit.  Hits of one diagonal, ``GAP`` words apart at most, are a group.  The fullest group takes those of its ``NEAR`` neighbours, the fullest
    first, that stand before or behind it in both texts, at most the template's
    length away in the document; then the fullest of what is left does."""
    groups: list[list[tuple[int, int]]] = []
    for hit in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        last = groups[-1][-1] if groups else None
        if last and hit[0] - hit[1] == last[0] - last[1] and hit[0] - last[0] <= GAP:
            groups[-1].append(hit)
        else:
            groups.append([hit])
    spans = sorted((min(g)[0], max(g)[0], min(a for _, a in g), max(a for _, a in g), i) for i, g in enumerate(groups))
    free = [True] * len(spans)
    for seed in sorted(range(len(spans)), key=lambda k: (-len(groups[spans[k][4]]), k)):
        if not free[seed]:
            continue
        chain = [spans[seed]]
        free[seed] = False
        near = [k for k in range(max(0, seed - NEAR), min(len(spans), seed + NEAR + 1)) if free[k]]
        for k in sorted(near, key=lambda k: (-len(groups[spans[k][4]]), k)):
            first, last, low, high, _ = spans[k]
            at = bisect.bisect_left(chain, spans[k])
            behind = at == 0 or (chain[at - 1][1] < first <= chain[at - 1][1] + words and chain[at - 1][2] < low and chain[at - 1][3] < high)
            before = at == len(chain) or (last < chain[at][0] <= last + words and low < chain[at][2] and high < chain[at][3])
            if behind and before:
                chain.insert(at, spans[k])
                free[k] = False
        hit = [h for c in chain for h in groups[c[4]]]
        diagonals = [p - a for p, a in hit]
        yield min(diagonals), max(diagonals), len({a for _, a in hit})


def matches(index: Index, w: np.ndarray, grams: dict[int, np.ndarray], least: float) -> list[tuple[int, int, float, int, int]]:
    """(template, matched, coverage, first and last word + 1) of a document."""
    by: dict[int, list[tuple[int, int]]] = defaultdict(list)
    for size, own in grams.items():
        for place in index.hits(own, size).tolist():
            for t, at in index.postings[size][int(np.searchsorted(index.keys[size], own[place]))]:
                by[t].append((place, at))
    found = []
    for t, hits in by.items():
        words = index.words[t]
        n, size = len(words), GRAM if len(words) >= FEW else GRAM - 1
        need = max(1, n - size + 1 - size * (n - math.ceil(least * n)))
        if len({at for _, at in hits}) < need:
            continue
        band = max(3, n // 10)
        for lo, hi, places in windows(hits, n):
            if places < need:
                continue
            start, end = max(0, lo - band), min(len(w), hi + n + band)
            matched, a, b = align(words, w[start:end], (lo + hi) // 2 - start, band + (hi - lo + 1) // 2)
            if matched >= least * n:
                found.append((t, matched, matched / n, start + a, start + b))
    found.sort(key=lambda m: (-m[1], -m[2], m[3], index.names[m[0]]))
    taken: list[tuple[int, int, float, int, int]] = []
    spans: list[tuple[int, int]] = []  # disjoint, sorted
    for m in found:
        at = bisect.bisect_left(spans, (m[4], 0))
        if at and spans[at - 1][1] > m[3]:
            continue
        bisect.insort(spans, (m[3], m[4]))
        taken.append(m)
    return sorted(taken, key=lambda m: (m[3], m[4]))


def scan(docs: DataFrame, templates: Sequence[tuple[str, str]] = TEMPLATES, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """doc_id, license, matched_words, coverage, start, end of every match of
    at least ``least`` of a template."""
    templates = tuple(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(templates)
        for batch in batches:
            for lo, _, data, offsets in text_slices(batch.column(1)):
                starts, ends, first = word_spans(data, offsets)
                w = word_hashes(lowered(data), starts, ends)
                grams = {size: grams_of(w, size) for size in index.keys}
                hits = np.concatenate([np.zeros(0, np.int64), *(index.hits(g, size) for size, g in grams.items())])
                rows = np.unique(np.searchsorted(first, hits, side="right") - 1)
                out: list[tuple] = []
                for r in rows.tolist():
                    a, b = first[r], first[r + 1]
                    own = {size: g[a : max(a, b - size + 1)] for size, g in grams.items()}
                    for t, matched, coverage, x, y in matches(index, w[a:b], own, least):
                        begin = offsets[r]
                        # Characters are the bytes that do not continue one.
                        chars = lambda end: int(((data[begin:end] & 0xC0) != 0x80).sum())  # noqa: B023, E731
                        out.append((lo + r, index.names[t], matched, coverage, chars(starts[a + x]), chars(ends[a + y - 1])))
                cols = list(zip(*out, strict=True)) if out else [[]] * 6
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.float64()), pa.array(cols[4], pa.int64()), pa.array(cols[5], pa.int64())],
                    names=["doc_id", "license", "matched_words", "coverage", "start", "end"],
                )

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInArrow(run, f"doc_id {kind}, license string, matched_words long, coverage double, start long, end long")
