"""License scans by patience alignment.

Words are runs of ASCII letters and digits, in lower case. A template is aligned with a stretch of a text like
this: words that are unique in both are anchors; the longest run of anchors that ascends in both stays; between
neighbours of these the same is done again, after equal words at either end are taken off. The share of a
template's words that are aligned is its coverage.

Stretches come from key words: the longest words of a template, more of them than its coverage may lack, so that
every passage with enough coverage holds one. A stretch reaches a template's length to both sides of one, and
stretches that overlap are one.

Defined results: nulls and texts without license words give no rows; texts are scanned whole; passages of one
text don't overlap, and of several templates the one with most aligned words holds a passage, of equally long ones the
one that begins first, then the first by name. Rows that repeat are scanned each; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left

from pyspark.sql import DataFrame

from undertow.llm.arrow import map_chunks

#: Notices of public licenses.
TEMPLATES = {
    "MIT-line": "Released under the MIT License.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "GPL-3.0-or-later": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}

WORD = re.compile(r"[A-Za-z0-9]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def align(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Pairs of places of aligned words, ascending in both."""
    out, todo = [], [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        places: dict[str, list] = {}
        for side, words, first, end in ((0, a, a0, a1), (1, b, b0, b1)):
            for k in range(first, end):
                entry = places.setdefault(words[k], [0, 0, 0, 0])
                entry[side] += 1
                entry[2 + side] = k
        anchors = sorted((p[2], p[3]) for p in places.values() if p[0] == p[1] == 1)
        chain = ascending(anchors)
        if not chain:
            continue
        edges = [(a0 - 1, b0 - 1), *chain, (a1, b1)]
        out += chain
        todo += [(x + 1, u, y + 1, v) for (x, y), (u, v) in zip(edges, edges[1:])]
    return sorted(out)


def ascending(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest subsequence whose second places ascend, by patience piles."""
    tops: list[int] = []
    cards: list[int] = []
    before: list[int | None] = []
    for k, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        before.append(cards[pile - 1] if pile else None)
        if pile == len(tops):
            tops.append(y)
            cards.append(k)
        else:
            tops[pile], cards[pile] = y, k
    out, k = [], cards[-1] if cards else None
    while k is not None:
        out.append(pairs[k])
        k = before[k]
    return out[::-1]


class Scanner:
    """Templates with their key words, and an automaton that finds these."""

    def __init__(self, templates: dict[str, str], coverage: float, density: float):
        import ahocorasick

        self.coverage, self.density = coverage, density
        self.words = {name: [w.lower() for w in WORD.findall(text)] for name, text in templates.items()}
        self.of: dict[str, list[str]] = {}
        self.automaton = ahocorasick.Automaton()
        for name, words in self.words.items():
            may_lack = int((1 - coverage) * len(words) + 1e-9)
            places = sorted(range(len(words)), key=lambda k: (-len(words[k]), words[k]))[: may_lack + 1]
            for w in {words[k] for k in places}:
                self.of.setdefault(w, []).append(name)
                self.automaton.add_word(w, len(w))
        self.automaton.make_automaton()

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, int]]:
        """(license, coverage, aligned words, start, end) of every passage, in order; code points, end exclusive."""
        if not text:
            return []
        low = text.translate(LOWER)
        if not any(not self.inside(low, end - size) and not self.inside(low, end + 1) for end, size in self.automaton.iter(low)):
            return []
        spans = [m.span() for m in WORD.finditer(low)]
        words = [low[a:b] for a, b in spans]
        near: dict[str, list[list[int]]] = {}
        for k, w in enumerate(words):
            for name in self.of.get(w, ()):
                n = len(self.words[name])
                runs = near.setdefault(name, [])
                if runs and k - n <= runs[-1][1]:
                    runs[-1][1] = k + n
                else:
                    runs.append([k - n, k + n])
        found = []
        for name, runs in near.items():
            template = self.words[name]
            for first, last in runs:
                first = max(0, first)
                found += self.passages(name, template, words[first : last + 1], first)
        found.sort(key=lambda f: (-f[2], f[3], f[0]))
        taken: list[tuple[int, int]] = []
        out = []
        for name, share, n, first, last in found:
            if all(last < a or b < first for a, b in taken):
                taken.append((first, last))
                out.append((name, share, n, spans[first][0], spans[last][1]))
        return sorted(out, key=lambda f: f[3])

    @staticmethod
    def inside(text: str, at: int) -> bool:
        """Whether the character there belongs to a word."""
        return 0 <= at < len(text) and text[at].isascii() and text[at].isalnum()

    def passages(self, name: str, template: list[str], words: list[str], first: int) -> list[tuple]:
        """Passages of one stretch; what lies before and after a passage is looked at again."""
        out, todo = [], [(0, len(words))]
        rare = {w for w, names in self.of.items() if name in names}
        while todo:
            a, b = todo.pop()
            keys = [k for k in range(a, b) if words[k] in rare]
            if not keys or b - a < self.coverage * len(template):
                continue
            pairs = best = align(words[a:b], template)
            if len(keys) > 1 and (not pairs or len(pairs) < self.coverage * len(template) or len(pairs) < self.density * (pairs[-1][0] - pairs[0][0] + 1)):
                # Words of several copies, or strays: each key word with a template's length around it on its own.
                best = max(([(x + shift, y) for x, y in p] for p, shift in self.around(words, template, keys, a, b)), key=lambda p: (len(p) / (p[-1][0] - p[0][0] + 1) >= self.density, len(p)) if p else (False, 0))
            if best and len(best) >= self.coverage * len(template) and len(best) >= self.density * (best[-1][0] - best[0][0] + 1):
                start, end = a + best[0][0], a + best[-1][0]
                out.append((name, len(best) / len(template), len(best), first + start, first + end))
                todo += [(a, start), (end + 1, b)]
        return out

    def around(self, words, template, keys, a, b):
        reach = len(template)
        for k in keys:
            lo, hi = max(a, k - reach), min(b, k + reach + 1)
            yield align(words[lo:hi], template), lo - a


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, density: float = 0.6) -> DataFrame:
    """One row per passage: doc_id, license, coverage, aligned_words, start, end. A passage needs that coverage
    of a template, and aligned words as that share of its own."""
    chosen = templates or TEMPLATES

    def make():
        find = Scanner(chosen, coverage, density).scan
        return lambda ids, texts: [(i, *f) for i, text in zip(ids, texts) for f in find(text)]

    return map_chunks(docs.select("doc_id", "text"), "doc_id long, license string, coverage double, aligned_words long, start long, end long", make)
