"""License scans by patience alignment.

A license template counts as found where enough of its words are matched in order.
Anchors are the words that occur once in the stretch of text and once in the
template; of these the longest increasing subsequence stands, and the gaps between
neighbouring anchors are aligned in the same way, where more words are unique. Equal
words at a gap's ends are matched first.

Templates are public license notices, given as text. A document is aligned only if
it holds one of a template's marker words; these are so many of its longest words
that nothing below the least coverage is missed.

Null and empty texts have no rows, nor has an empty table. Texts are scanned whole,
and a license that stands in a text several times has a row for each place. Repeated
rows are repeated; only the named columns are read.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from ordermart.llm.common import id_and_text, map_slices, texts

WORD = re.compile(r"\w+(?:[.'-]\w+)*")

#: Public license notices by SPDX name; those with a slash are other notices of the
#: same license. Fixed values.
TEMPLATES = {
    "MIT/released": "Released under the MIT License.",
    "MIT/licensed": "This project is licensed under the terms of the MIT License.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal in the
Software without restriction, including without limitation the rights to use, copy,
modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and
to permit persons to whom the Software is furnished to do so, subject to the following
conditions: The above copyright notice and this permission notice shall be included in
all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS",
WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN
NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR
IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "Apache-2.0/licensed": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may
not use this file except in compliance with the License. You may obtain a copy of the
License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law
or agreed to in writing, software distributed under the License is distributed on an
"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under
the License.""",
    "GPL-3.0/licensed": (
        "This work is licensed under the GNU General Public License, version 3."
    ),
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or
modify it under the terms of the GNU General Public License as published by the Free
Software Foundation, either version 3 of the License, or (at your option) any later
version. This program is distributed in the hope that it will be useful, but WITHOUT ANY
WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A
PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    "GPL-2.0-or-later": """This program is free software; you can redistribute it and/or
modify it under the terms of the GNU General Public License as published by the Free
Software Foundation; either version 2 of the License, or (at your option) any later
version.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain
one at http://mozilla.org/MPL/2.0/.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above copyright notice
and this permission notice appear in all copies.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce
the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution. Neither the name of
the copyright holder nor the names of its contributors may be used to endorse or promote
products derived from this software without specific prior written permission.""",
    "BSD-2-Clause": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. Redistributions in binary form must reproduce
the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software,
either in source code form or as a compiled binary, for any purpose, commercial or
non-commercial, and by any means.""",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": """This work is licensed under a Creative Commons Attribution 4.0
International License.""",
    "CC-BY-SA-4.0": """This work is licensed under a Creative Commons Attribution-ShareAlike
4.0 International License.""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and
related or neighboring rights to this work.""",
}


def split_words(text: str) -> tuple[list[str], list[tuple[int, int]]]:
    """Words in lower case, and their places."""
    words, places = [], []
    for m in WORD.finditer(text):
        words.append(m[0].lower())
        places.append(m.span())
    return words, places


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs, ordered by the first, in which the second grows too:
    patience sorting into piles, with back-pointers to the pile before."""
    tops: list[int] = []
    top_at: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        if pile == len(tops):
            tops.append(y)
            top_at.append(i)
        else:
            tops[pile], top_at[pile] = y, i
        back[i] = top_at[pile - 1] if pile else -1
    found = []
    at = top_at[-1] if top_at else -1
    while at >= 0:
        found.append(pairs[at])
        at = back[at]
    return found[::-1]


def align(text: list[str], template: list[str]) -> list[tuple[int, int]]:
    """Matched (text, template) positions, growing in both."""
    matched = []
    todo = [(0, len(text), 0, len(template))]
    while todo:
        a, b, c, d = todo.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        here, there = Counter(text[a:b]), Counter(template[c:d])
        once = {w for w, n in there.items() if n == 1 and here.get(w) == 1}
        if not once:
            continue
        place = {w: j for j, w in enumerate(template[c:d], c) if w in once}
        anchors = increasing([(i, place[w]) for i, w in enumerate(text[a:b], a) if w in once])
        matched += anchors
        for (i, j), (k, m) in zip([(a - 1, c - 1), *anchors], [*anchors, (b, d)]):
            todo.append((i + 1, k, j + 1, m))
    return sorted(matched)


@dataclass(frozen=True)
class Template:
    name: str
    words: tuple[str, ...]
    markers: frozenset[str]

    @classmethod
    def of(cls, name: str, text: str, least: float) -> Template:
        words = split_words(text)[0]
        # a text without any of these holds fewer than `least` of the words
        missing, markers = 0, set()
        counts = Counter(words)
        for w in sorted(counts, key=lambda w: (-len(w), w)):
            if missing > (1 - least) * len(words):
                break
            markers.add(w)
            missing += counts[w]
        return cls(name, tuple(words), frozenset(markers))


class Scanner:
    def __init__(self, templates: tuple[tuple[str, str], ...], least: float):
        self.least = least
        self.templates = [Template.of(n, t, least) for n, t in templates]
        self.auto = ahocorasick.Automaton()
        for w in sorted({w for t in self.templates for w in t.markers}):
            self.auto.add_word(w, w)
        self.auto.make_automaton()

    def stretches(self, places: list[int], length: int, n: int) -> Iterator[tuple[int, int]]:
        """Stretches of the text around a template's words: neighbours not further
        apart than the template is long, and as much before and after."""
        start = prev = None
        for p in places:
            if start is None:
                start = p
            elif p - prev > length:
                yield max(0, start - length), min(n, prev + length + 1)
                start = p
            prev = p
        if start is not None:
            yield max(0, start - length), min(n, prev + length + 1)

    def in_stretch(
        self, words: list[str], marks: list[int], t: Template, start: int, end: int
    ) -> Iterator[tuple[int, int, int]]:
        """(first, last, matched) for each place of the template in a stretch. Copies
        would hide each other's anchors, so the alignment moves on from window to
        window, each beginning at a marker word with one template's length before it. The
        window reaches a little over one template's length, so that a copy behind stays out;
        where that doesn't hold the whole template, as foreign words lie between, it
        reaches as far as a place may, and the better alignment counts."""
        n, at = len(t.words), start
        while at < end:
            i = bisect_left(marks, at)
            if i == len(marks) or marks[i] >= end:
                return
            low, best = max(at, marks[i] - n), None
            for reach in (n + n // 4 + 1, 2 * n + 8):
                high = min(end, marks[i] + reach)
                found = tighten(align(words[low:high], list(t.words)), n, self.least)
                if found is not None and (best is None or found[2] > best[2]):
                    best = found
                if best is not None and best[2] == n:
                    break
            if best is None:
                at = marks[i] + 1
                continue
            first, last, matched = best
            yield low + first, low + last, matched
            at = low + last + 1

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, matched words, start, end) by start; of overlapping
        ones the one with the most matched words."""
        low = text.lower()
        seen = {w for _, w in self.auto.iter(low)}
        if not seen:
            return []
        near = [t for t in self.templates if t.markers & seen]
        words, places = split_words(text)
        found = []
        for t in near:
            marks = [i for i, w in enumerate(words) if w in t.markers]
            for start, end in self.stretches(marks, len(t.words), len(words)):
                for first, last, matched in self.in_stretch(words, marks, t, start, end):
                    found.append((matched, matched / len(t.words), first, last, t.name))
        found.sort(key=lambda f: (-f[0], -f[1], f[2], f[4]))
        taken: list[tuple[int, int]] = []
        out = []
        for matched, coverage, first, last, name in found:
            i = bisect_right(taken, (first, len(words)))
            if (i and taken[i - 1][1] >= first) or (i < len(taken) and taken[i][0] <= last):
                continue
            taken.insert(i, (first, last))
            out.append((name, coverage, matched, places[first][0], places[last][1]))
        return sorted(out, key=lambda f: f[3])


def tighten(
    found: list[tuple[int, int]], n: int, least: float
) -> tuple[int, int, int] | None:
    """First and last matched word and their number, without stray matches far off the
    rest: words before a gap longer than the template go if the others suffice."""
    need = least * n
    if len(found) < need:
        return None
    while True:
        gap, i = max(
            ((found[i + 1][0] - found[i][0], i) for i in range(len(found) - 1)),
            default=(0, 0),
        )
        if gap <= max(3, n // 4):
            break
        left, right = found[: i + 1], found[i + 1 :]
        part = max(left, right, key=len)
        if len(part) < need:
            break
        found = part
    if found[-1][0] - found[0][0] > 2 * n + 8:
        return None
    return found[0][0], found[-1][0], len(found)


@cache
def scanner(templates: tuple[tuple[str, str], ...], least: float) -> Scanner:
    return Scanner(templates, least)


def scan(
    docs: DataFrame, templates: dict[str, str] = TEMPLATES, least_coverage: float = 0.8
) -> DataFrame:
    """A row for each place of a license: doc_id, license, coverage (share of the
    template's words), matched_words, start and end (code points, end exclusive)."""
    given = tuple(sorted(templates.items()))

    def run(batch: pa.RecordBatch) -> dict:
        s = scanner(given, least_coverage)
        rows = [
            (doc, *found)
            for doc, t in zip(batch.column("doc_id").to_pylist(), texts(batch))
            for found in s.scan(t)
        ]
        names = ["doc_id", "license", "coverage", "matched_words", "start", "end"]
        return dict(zip(names, zip(*rows))) if rows else {n: [] for n in names}

    return map_slices(
        id_and_text(docs),
        run,
        "doc_id long, license string, coverage double, matched_words long, start long, end long",
    )
