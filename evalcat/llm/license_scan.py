"""License texts in documents: winnowed fingerprints, then banded alignment.

Each template's hashes of GRAM consecutive words are winnowed: of every WINDOW
consecutive ones the smallest stays (the rightmost of equal ones). Of templates
of fewer than WHOLE words every hash stays, and their grams are so short that
some gram is left when any words but the asked coverage are taken out or
replaced. An inverted index maps the hashes to (template, place). All gram
hashes of a document are looked up, so any run of WINDOW + GRAM - 1 words shared
with a template yields a hit.

Hits of one template on nearby diagonals are one candidate region. Unless the
words both have, in any order, are too few for the coverage asked for, it is
aligned with the template by words (local alignment, match 2, mismatch and gap
-1, of equal ones that with more matches) within a band around the hits'
diagonals. What a reported span leaves before and after it is aligned again, so
copies in a row are each found. Reported are matched template words, coverage
(their share), and the span in the document.

Templates are a parameter and configuration: at most MAX_WORDS words in all are
taken to the tasks at once, more are scanned in further passes (``best`` then
compares the templates of a pass).

Spans count the characters of the text in lower case, which has the same length
but for a few letters such as a capital dotted I.

Edge cases: a null text is empty and matches nothing; a template shorter than
its grams has one hash, of all its words; repeated rows and templates are each
reported; a null doc_id stays null; no templates or documents give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalcat.llm.common import text_rows
from evalcat.llm.license_texts import TEXTS

GRAM, WINDOW, WHOLE, BAND, MAX_WORDS, UNIT = 3, 4, 64, 12, 2_000_000, 1024

_GNU = [("GPL", "General Public", "2.0"), ("GPL", "General Public", "3.0"), ("LGPL", "Lesser General Public", "2.1"), ("LGPL", "Lesser General Public", "3.0"), ("AGPL", "Affero General Public", "3.0")]
_GNU_NOTICE = "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {title} License as published by the Free Software Foundation, either version {number} of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} License for more details. You should have received a copy of the GNU {title} License along with this program. If not, see <https://www.gnu.org/licenses/>."
_CC = [("CC-BY", "Attribution"), ("CC-BY-SA", "Attribution-ShareAlike"), ("CC-BY-ND", "Attribution-NoDerivatives"), ("CC-BY-NC", "Attribution-NonCommercial"), ("CC-BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("CC-BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")]
# Whole license texts, the notices by which files refer to them, and short forms.
TEMPLATES = {
    **TEXTS,
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "MIT-line": "Released under the MIT License.",
    "BSD-2-Clause-line": "Licensed under the BSD 2-Clause License.",
    "BSD-3-Clause-line": "Licensed under the BSD 3-Clause License.",
    "ISC-line": "This software is licensed under the ISC License.",
    "MPL-2.0-line": "Licensed under the Mozilla Public License, Version 2.0.",
    "MPL-2.0-notice": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "CC0-1.0-line": "Released under the CC0 1.0 Universal Public Domain Dedication.",
    **{f"{name}-{number}-line": f"This work is licensed under the GNU {title} License, version {number.removesuffix('.0')}." for name, title, number in _GNU},
    **{f"{name}-{number}-notice": _GNU_NOTICE.format(title=title, number=number.removesuffix(".0")) for name, title, number in _GNU},
    **{f"{name}-4.0-line": f"Licensed under {name.replace('-', ' ', 1)} 4.0." for name, _ in _CC},
    **{f"{name}-4.0-notice": f"This work is licensed under a Creative Commons {title} 4.0 International License." for name, title in _CC},
}


def winnowed(hashes: np.ndarray, window: int = WINDOW) -> list[int]:
    """Places of the hashes that stay."""
    if len(hashes) <= window:
        return [len(hashes) - 1 - int(np.argmin(hashes[::-1]))] if len(hashes) else []
    views = np.lib.stride_tricks.sliding_window_view(hashes, window)
    return sorted(set((np.arange(len(views)) + window - 1 - np.argmin(views[:, ::-1], axis=1)).tolist()))


def gram_size(size: int, least: float) -> int:
    """Words of a gram, GRAM or fewer: a run so long is left however the words
    that coverage ``least`` may lack are spread over a template."""
    lost = int((1 - least) * size + 1e-9)
    return max(1, min(GRAM, -(-(size - lost) // (lost + 1))))


class Index:
    def __init__(self, templates: list[tuple[str, str]], least: float):
        from evalcat.llm.textcache import shingle_hashes, word_hashes

        words, lens = word_hashes([t for _, t in templates])
        ends = np.cumsum(lens)
        self.names = [n for n, _ in templates]
        self.words = [words[e - n : e] for e, n in zip(ends.tolist(), lens.tolist())]
        self.vocabulary = np.unique(words) if len(words) else np.zeros(0, np.uint64)
        self.bags = [np.unique(np.searchsorted(self.vocabulary, own), return_counts=True) for own in self.words]
        found = []
        for k, own in enumerate(self.words):
            wide = gram_size(len(own), least)
            grams, _ = shingle_hashes(own, np.array([len(own)]), wide)
            found += [(int(grams[i]), k, i) for i in (range(len(grams)) if len(own) < WHOLE else winnowed(grams))]
        self.widths = sorted({gram_size(len(own), least) for own in self.words if len(own)})
        found.sort()
        self.hashes = np.array([f[0] for f in found], np.uint64)
        self.places = [f[1:] for f in found]
        self.known = np.unique(self.hashes)

    def numbers(self, words: np.ndarray) -> np.ndarray:
        """Places of words in the templates' vocabulary, its size for others."""
        n = len(self.vocabulary)
        at = np.minimum(np.searchsorted(self.vocabulary, words), n - 1)
        return np.where(self.vocabulary[at] == words, at, n)

    def most(self, k: int, numbers: np.ndarray) -> int:
        """No alignment of template k with these words matches more: the words
        both have, whatever their order."""
        own, count = self.bags[k]
        return int(np.minimum(np.bincount(numbers, minlength=len(self.vocabulary) + 1)[own], count).sum())

    def hits(self, grams: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.flatnonzero(self.known[at] == grams)


def aligned(template: np.ndarray, doc: np.ndarray, low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with doc place - template place in [low, high]:
    (matched words, first doc word, last doc word + 1). A match counts 2 * UNIT
    + 1, so that of equal scores the one with more matched words stays."""
    width, n = high - low + 1, len(doc)
    column = np.arange(width, dtype=np.int32)
    score = np.zeros((len(template) + 1, width + 1), np.int32)
    for i, word in enumerate(template):
        at = i + low + column
        inside = (at >= 0) & (at < n)
        same = np.zeros(width, bool)
        same[inside] = doc[at[inside]] == word
        before = score[i]
        reach = np.maximum(0, np.maximum(before[:width] + np.where(same, np.int32(2 * UNIT + 1), np.int32(-UNIT)), before[1:] - UNIT))
        reach = np.where(inside, reach, 0)
        row = np.maximum.accumulate(reach + UNIT * column) - UNIT * column
        score[i + 1, :width] = np.where(inside, row, 0)
    i, c = np.unravel_index(int(score[:, :width].argmax()), (len(template) + 1, width))
    matched, end, begin = 0, i - 1 + low + c + 1, i + low + c
    while i > 0 and score[i, c] > 0:
        at = i - 1 + low + c
        same = 0 <= at < n and doc[at] == template[i - 1]
        if score[i, c] == score[i - 1, c] + (2 * UNIT + 1 if same else -UNIT):
            matched, begin, i = matched + same, at, i - 1
        elif score[i, c] == score[i - 1, c + 1] - UNIT:
            i, c = i - 1, c + 1
        else:
            c -= 1
            begin = at
    return matched, max(0, begin), end


def matches(words: np.ndarray, index: Index, least: float) -> list[tuple]:
    """(template number, matched, coverage, first word, last word + 1)."""
    from evalcat.llm.textcache import shingle_hashes

    hits: dict[int, list] = {}
    for wide in index.widths:
        grams, _ = shingle_hashes(words, np.array([len(words)]), wide)
        for p in index.hits(grams).tolist():
            a, b = np.searchsorted(index.hashes, grams[p], "left"), np.searchsorted(index.hashes, grams[p], "right")
            for k, q in index.places[a:b]:
                hits.setdefault(k, []).append(p - q)
    out = []
    numbers = index.numbers(words) if hits else None
    for k, found in sorted(hits.items()):
        size = len(index.words[k])
        if index.most(k, numbers) < least * size:
            continue
        band, regions = BAND + size // 8, []
        for d in sorted(found):
            if regions and d - regions[-1][0] <= band:
                regions[-1][1:] = d, regions[-1][2] + 1
            else:
                regions.append([d, d, 1])
        spans: list[tuple[int, int]] = []
        for low, high, _ in sorted(regions, key=lambda r: -r[2]):  # stable
            # what no reported span covers; a span found leaves what is before and after it
            edges = [max(0, low - band), *sum(sorted(spans), ()), max(0, high + band + size)]
            todo = [(max(x, edges[0]), min(y, edges[-1])) for x, y in zip(edges[::2], edges[1::2])]
            while todo:
                x, y = todo.pop()
                if x >= y or index.most(k, numbers[x:y]) < least * size:
                    continue
                matched, begin, end = aligned(index.words[k], words[x:y], low - band - x, high + band - x)
                if matched / size >= least:
                    spans.append((x + begin, x + end))
                    out.append((k, matched, matched / size, x + begin, x + end))
                    todo += [(x, x + begin), (x + end, y)]
    return out


def best_of(found: list[tuple], index: Index) -> list[bool]:
    """Which matches name their part of a document: going down by 2 a matched
    word less 1 for any other word of template or span, those that share no
    more than half of the shorter span with a better one."""
    sizes = [len(index.words[f[0]]) for f in found]
    score = [4 * m - n - (e - b) for (_, m, _, b, e), n in zip(found, sizes)]
    taken: list[int] = []
    for i in sorted(range(len(found)), key=lambda i: -score[i]):
        b, e = found[i][3:]
        if all(2 * (min(e, found[j][4]) - max(b, found[j][3])) <= min(e - b, found[j][4] - found[j][3]) or score[i] == score[j] for j in taken):
            taken.append(i)
    return [i in taken for i in range(len(found))]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, max_words: int = MAX_WORDS) -> DataFrame:
    """(doc_id, template, matched_words, coverage, first_word, last_word,
    start_char, end_char, best): a row per aligned region of at least ``least``
    coverage, and whether no other template accounts better for that part of
    the document (texts of BSD-2-Clause also hold most of BSD-3-Clause)."""
    todo, passes, size = list((TEMPLATES if templates is None else templates).items()), [[]], 0
    for name, text in todo:
        if passes[-1] and size + len(text.split()) > max_words:
            passes.append([])
            size = 0
        passes[-1].append((name, text))
        size += len(text.split())
    schema = "doc_id long, template string, matched_words int, coverage double, first_word int, last_word int, start_char int, end_char int, best boolean"
    types = [pa.int64(), pa.string(), pa.int32(), pa.float64(), *[pa.int32()] * 4, pa.bool_()]
    names = [f.split()[0] for f in schema.split(", ")]

    def job(own):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from evalcat.llm.textcache import Buffer, in_slices, shingle_hashes, word_hashes

            index = Index(own, least)
            for batch in batches:
                ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                rows = []
                for a, b in in_slices(texts):
                    words, lens = word_hashes(texts[a:b])
                    hit = np.zeros(b - a, bool)
                    for wide in index.widths:
                        grams, n = shingle_hashes(words, lens, wide)
                        hit[np.repeat(np.arange(b - a), n)[index.hits(grams)]] = True
                    ends = np.cumsum(lens)
                    for i in np.flatnonzero(hit).tolist():
                        found = matches(words[ends[i] - lens[i] : ends[i]], index, least)
                        if found:
                            begins, stops, _ = Buffer([texts[a + i].lower()]).words()
                            rows += [(ids[a + i], index.names[k], m, c, f, e - 1, int(begins[f]), int(stops[e - 1]), own_best) for (k, m, c, f, e), own_best in zip(found, best_of(found, index))]
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(types)], names=names)

        return run

    rows, out = text_rows(docs), None
    for own in passes:
        part = rows.mapInArrow(job(own), schema)
        out = part if out is None else out.unionByName(part)
    return out
