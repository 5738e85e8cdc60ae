"""Operator 5: licence scans by the Dice coefficient over word bigrams of normalised text."""

from __future__ import annotations

import bisect
import heapq
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded, doc_columns, texts
from .license_texts import TEXTS

# Notices and texts of public licences, as far as scans need them.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    ],
    "MIT": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    ],
    "ISC": [
        'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    ],
    "BSD-3-Clause": [
        "Released under the BSD 3-Clause License.",
        'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.',
    ],
    "GPL-3.0": [
        "Licensed under the GNU General Public License, Version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "Unlicense": ["This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}

DISCLAIMER = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_three = TEMPLATES["BSD-3-Clause"][1]
_two = _three[: _three.index(" 3. Neither")]
TEMPLATES["BSD-3-Clause"].append(f"{_three} {DISCLAIMER}")
TEMPLATES["BSD-2-Clause"] = ["Released under the BSD 2-Clause License.", _two, f"{_two} {DISCLAIMER}"]
_gpl = TEMPLATES["GPL-3.0"][1]
TEMPLATES["AGPL-3.0"] = [_gpl.replace("GNU General", "GNU Affero General")]
TEMPLATES["LGPL-3.0"] = [_gpl.replace("GNU General", "GNU Lesser General")]
TEMPLATES["GPL-2.0"] = [_gpl.replace("version 3", "version 2").replace("program is free software: you", "program is free software; you")]
for _name, _text in TEXTS.items():
    TEMPLATES.setdefault(_name, []).append(_text)

WORD = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
LINE, PARAGRAPH = re.compile(r"[^\r\n]+"), re.compile(r"(?:[^\r\n]*\S[^\r\n]*(?:\r?\n|\r|$))+")


# what windows are made of: sentences, cut at line ends
SEGMENT = re.compile(r"[^\r\n]+?(?:[.:;!?](?=\s)|(?=[\r\n]|\Z))")


def normalise(text: str) -> list[str]:
    """Lower-case words; points stay inside numbers and names only."""
    return WORD.findall(text.lower())


def bigrams(words: list[str]) -> Counter:
    return Counter(zip(words, words[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    whole = a.total() + b.total()
    return 2 * sum(min(n, b[k]) for k, n in a.items() if k in b) / whole if whole else 0.0


class Spans:
    """Spans that lie apart, in order, so that what one meets is found by bisection."""

    def __init__(self, spans: list[tuple[int, int]] | None = None):
        self.starts, self.ends = [s for s, _ in spans or []], [e for _, e in spans or []]

    def add(self, s: int, e: int) -> None:
        at = bisect.bisect_left(self.starts, s)
        self.starts.insert(at, s)
        self.ends.insert(at, e)

    def around(self, s: int, e: int) -> bool:
        """Whether one of them holds this span."""
        at = bisect.bisect_right(self.starts, s) - 1
        return at >= 0 and e <= self.ends[at]

    def meets(self, s: int, e: int) -> bool:
        at = bisect.bisect_left(self.starts, e) - 1
        return at >= 0 and s < self.ends[at]

    def within(self, s: int, e: int) -> tuple[int, int]:
        """The places of those that this span holds."""
        return bisect.bisect_left(self.starts, s), bisect.bisect_right(self.ends, e)


class Scanner:
    """Templates by number of bigrams. A unit of n bigrams can reach a coefficient d only with templates of n d/(2-d) to n (2-d)/d bigrams."""

    def __init__(self, templates: dict[str, list[str]], least: float):
        self.least, self.slack = least, (2 - least) / least
        self.known = sorted(((name, bigrams(normalise(t))) for name, ts in templates.items() for t in ts), key=lambda x: (x[1].total(), x[0]))
        self.sizes = [g.total() for _, g in self.known]
        self.index: dict[tuple[str, str], list[tuple[int, int]]] = {}
        for t, (_, grams) in enumerate(self.known):
            for k, m in grams.items():
                self.index.setdefault(k, []).append((t, m))
        self.few, self.most = min(self.sizes) / self.slack, max(self.sizes) * self.slack

    def best(self, unit: str) -> tuple[str, float] | None:
        # a word has a letter or digit at least and something between it and the next: cheap bounds first
        if len(unit) < 2 * self.few:
            return None
        words = normalise(unit)
        n = len(words) - 1
        if not self.few <= n <= self.most:
            return None
        own, found = bigrams(words), None
        for (name, grams), size in zip(self.known, self.sizes, strict=True):
            if size > n * self.slack:
                break
            if size * self.slack >= n and (d := dice(own, grams)) >= self.least and (found is None or d > found[1]):
                found = name, d
        return found

    def possible(self, words: list[str]) -> list[int]:
        """Templates that some run of the words might match: a coefficient d takes d/(2-d) of a template's bigrams at least."""
        few = len(words) - 1
        last = np.searchsorted(self.sizes, few * self.slack, "right")
        common = [0] * last
        for k, n in Counter(k for k in zip(words, words[1:], strict=False) if k in self.index).items():
            for t, m in self.index[k]:
                if t >= last:
                    break
                common[t] += min(n, m)
        return [t for t in range(last) if common[t] * self.slack >= self.sizes[t] - 1e-9]

    def windows(self, text: str, chosen: list[int]) -> list[tuple[int, float, int, int, int]]:
        """(template, coefficient, bigrams in common, start, end) of the likest run of segments from each segment on."""
        spans, words, ends = [], [], []
        for m in SEGMENT.finditer(text):
            if w := normalise(m.group()):
                words += w
                spans.append(m.span())
                ends.append(len(words))
        starts, ends = np.r_[0, ends[:-1]].astype(int), np.array(ends, int)
        pairs, out = list(zip(words, words[1:], strict=False)), []
        for t in chosen:
            name, grams = self.known[t]
            size = self.sizes[t]
            is_hit = np.fromiter((k in grams for k in pairs), bool, len(pairs))
            hits = np.r_[0, np.cumsum(is_hit)]
            for i, s in enumerate(starts):
                # the likest run neither begins nor ends with words that have nothing in common with the template
                far = np.searchsorted(ends, s + 1 + size * self.slack, "right")
                n = ends[i:far] - s - 1
                bound = 2 * (hits[s + n.clip(0)] - hits[s]) >= self.least * (n + size) - 1e-9
                if not bound.any() or not is_hit[s : ends[i]].any():
                    continue
                left, common, best, at = grams.copy(), 0, None, s
                for j in range(i, i + int(np.flatnonzero(bound)[-1]) + 1):
                    for k in pairs[at : ends[j] - 1]:
                        if left.get(k, 0) > 0:
                            left[k] -= 1
                            common += 1
                    at = ends[j] - 1
                    d = 2 * common / (ends[j] - s - 1 + size)
                    if d >= self.least and (best is None or d > best[1]):
                        best = t, d, common, spans[i][0], spans[j][1]
                if best:
                    out.append(best)
        return out

    def scan(self, text: str) -> list[tuple[str, float, str, int, int]]:
        """(licence, coefficient, kind of unit, start, end) of each unit that matches: the text, its paragraphs, its lines, then runs of sentences and lines.

        A place counts once, as the largest unit; a run takes the place of what it holds if its template is longer, or liker.
        """
        if len(text) < 2 * self.few or not (chosen := self.possible(normalise(text))):
            return []
        out: list[tuple] = []
        held = Spans()
        for kind, spans in (("text", [(0, len(text))]), ("paragraph", (m.span() for m in PARAGRAPH.finditer(text))), ("line", (m.span() for m in LINE.finditer(text)))):
            # units of one kind come in order and lie apart; those of a kind lie within those of the kinds before, or apart from them
            new = [(*hit, kind, s, e) for s, e in spans if not held.around(s, e) and (hit := self.best(text[s:e]))]
            out = list(heapq.merge(out, new, key=lambda x: x[3]))
            held = Spans([x[3:] for x in out])
        if out and out[0][2] == "text":
            return out
        placed, gone, found = Spans(), set(), []
        for t, d, _, s, e in sorted(self.windows(text, chosen), key=lambda x: (-x[2], -x[1], x[0], x[3])):
            name, size = self.known[t][0], self.sizes[t]
            if placed.meets(s, e) or held.around(s, e):
                continue
            inside = [i for i in range(*held.within(s, e)) if i not in gone]
            # a hit of a coefficient x has size/slack words at least: one much shorter than the run is of a shorter template
            if any(out[i][1] >= d and (len(normalise(text[out[i][3] : out[i][4]])) - 1) * self.slack >= size for i in inside):
                continue
            gone.update(inside)
            found.append((name, d, "window", s, e))
            placed.add(s, e)
        return sorted(found + [x for i, x in enumerate(out) if i not in gone], key=lambda x: (x[3], x[4]))


def scan(docs: DataFrame, least: float = 0.8, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Licence notices in every whole text: doc_id, matches array<(license, dice, unit, start, end)>.

    Null and empty texts have none. Very long texts are searched whole, in time that grows with their length. Repeated rows
    each give a row, other columns are ignored; an empty table gives no rows. Of templates with equal
    coefficients the one of fewer bigrams, then the name that sorts first, is given.
    """
    chosen = templates or TEMPLATES
    kind = pa.list_(pa.struct([("license", pa.string()), ("dice", pa.float64()), ("unit", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(batches):
        scanner = Scanner(chosen, least)
        for b in bounded(batches):
            found = [[dict(zip(("license", "dice", "unit", "start", "end"), m, strict=True)) for m in scanner.scan(t)] for t in texts(b)]
            yield pa.RecordBatch.from_pydict({"doc_id": b.column("doc_id"), "matches": pa.array(found, kind)})

    return doc_columns(docs).mapInArrow(run, "doc_id long, matches array<struct<license string, dice double, unit string, start int, end int>>")
