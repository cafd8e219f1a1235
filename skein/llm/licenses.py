"""Licence scan: Dice coefficient over word bigrams against licence templates."""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from importlib import resources

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

#: Public licence texts and the notices that stand for them, by SPDX identifier.
#: Long texts are files of this folder, named likewise.
TEXTS = "license_texts"
NOTICES: tuple[tuple[str, str], ...] = (
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/."""),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("EPL-2.0", """This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor."""),
    ("MPL-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
)

#: Over this many bigrams, stretches are looked for from where runs of a template's bigrams begin,
#: with gaps of up to this many words.
LONG, GAP = 300, 8


@functools.cache
def templates() -> tuple[tuple[str, str], ...]:
    """All templates: the notices and short texts, then the long texts."""
    files = sorted(resources.files(__package__).joinpath(TEXTS).iterdir(), key=lambda f: f.name)
    return NOTICES + tuple((f.name.removesuffix(".txt"), f.read_text(encoding="utf-8")) for f in files if f.name.endswith(".txt"))


_WORD = re.compile(r"[^\W_]+")
_BLANK = re.compile(r"\n[ \t\r]*\n")


def words(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def _bigrams(w: list[str]) -> list[tuple[str, str]]:
    return list(zip(w, w[1:], strict=False))


def dice(a: Counter, b: Counter) -> float:
    """Twice the common bigrams over all, repeated ones counted as often as they stand."""
    both = a.total() + b.total()
    return 2 * (a & b).total() / both if both else 0.0


class Scanner:
    def __init__(self, given: tuple[tuple[str, str], ...] | None = None, least: float = 0.8):
        given = templates() if given is None else given
        self.least = least
        self.names = [name for name, _ in given]
        self.bags = [Counter(_bigrams(words(text))) for _, text in given]
        self.every = frozenset().union(*self.bags)
        # a text with a coefficient of `least` has at least this share of the template's bigrams, and
        # a size between this share and its inverse
        self.share = least / (2 - least)

    def open_templates(self, found: set[tuple[str, str]]) -> list[int]:
        """Templates of which enough different bigrams are anywhere in the text for some part of it to match."""
        out = []
        for i, bag in enumerate(self.bags):
            most = sum(n for gram, n in bag.items() if gram in found)
            if most >= self.share * bag.total():
                out.append(i)
        return out

    def windows(self, text: str, template: int, units: list[tuple[int, int]]) -> list[tuple[float, int, int]]:
        """``coefficient, start, end`` of stretches of words from one of the template's bigrams to another.

        For each first bigram (in templates of over ``LONG``, each that begins a run
        of them) the best last one within the size bounds; a stretch
        shorter than the template is compared with words around it up to its size.
        Stretches within ``units``, which match as a whole, are left to them.
        """
        bag = self.bags[template]
        total = bag.total()
        least, most = self.share * total, int(total / self.share)
        at = [m.span() for m in _WORD.finditer(text)]
        w = [text[s:e].lower() for s, e in at]
        hits = [(j, g) for j, g in enumerate(zip(w, w[1:], strict=False)) if g in bag]
        starts = sorted(s for s, _ in units)
        reach = list(itertools.accumulate((e for _, e in sorted(units)), max))
        out, last = [], 0
        for i, (j, _) in enumerate(hits):
            last = max(last, i)
            while last < len(hits) and hits[last][0] < j + most:
                last += 1
            if last - i < least or (total > LONG and i and j - hits[i - 1][0] <= GAP):
                continue
            seen: Counter = Counter()
            both, best = 0, None
            for k, g in hits[i:last]:
                seen[g] += 1
                both += seen[g] <= bag[g]
                score = 2 * both / (max(k - j + 1, total) + total)
                if score >= self.least and (best is None or score > best[0]):
                    best = score, at[j][0], at[k + 1][1]
            if best:
                before = bisect.bisect_right(starts, best[1])
                if not before or reach[before - 1] < best[2]:
                    out.append(best)
        return out

    def scan(self, text: str) -> list[tuple[str, int, int, float]]:
        """``licence, start, end, coefficient`` of the parts that match best, none overlapping.

        Parts are lines, paragraphs, the whole text, runs of consecutive lines
        that are mostly made of one template's bigrams, and stretches of words in
        longer lines and paragraphs, wherever they start and end.
        """
        w = words(text)
        found = self.every.intersection(zip(w, w[1:], strict=False))
        if not found or not (open_ones := self.open_templates(found)):
            return []
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, at + len(line)))
            at += len(line) + 1
        units = set(lines) | {(0, len(text))}
        at = 0
        for m in [*_BLANK.finditer(text), None]:
            units.add((at, m.start() if m else len(text)))
            at = m.end() if m else at
        grams = [_bigrams(words(text[s:e])) for s, e in lines]
        for i in open_ones:
            bag, first, last = self.bags[i], None, None
            for (s, e), g in zip([*lines, (0, 0)], [*grams, None], strict=True):
                good = g is not None and (not g or 2 * sum(x in bag for x in g) >= len(g))
                if good and g:
                    first, last = (s if first is None else first), e
                elif not good and first is not None:
                    units.add((first, last))
                    first = last = None
        hits = []
        size_of = [bag.total() for bag in self.bags]
        for s, e in units:
            bag = Counter(_bigrams(words(text[s:e])))
            size = bag.total()
            for i in open_ones:
                if self.share * self.bags[i].total() <= size <= self.bags[i].total() / self.share:
                    score = dice(bag, self.bags[i])
                    if score >= self.least:
                        hits.append((-score, s, -size_of[i], e, self.names[i]))
        matched = [(s, e) for _, s, _, e, _ in hits]
        for i in open_ones:
            hits += [(-score, s, -size_of[i], e, self.names[i]) for score, s, e in self.windows(text, i, matched)]
        taken: list[tuple[str, int, int, float]] = []
        begun: list[int] = []
        for score, s, _, e, name in sorted(hits):  # of equal ones, that of the longer template
            while s < e and text[s].isspace():
                s += 1
            while e > s and text[e - 1].isspace():
                e -= 1
            at = bisect.bisect_left(begun, s)  # those taken don't overlap: the neighbours decide
            if (not at or taken[at - 1][2] <= s) and (at == len(taken) or e <= taken[at][1]):
                begun.insert(at, s)
                taken.insert(at, (name, s, e, -score))
        return taken


@functools.lru_cache(maxsize=2)
def _scanner(given: tuple[tuple[str, str], ...], least: float) -> Scanner:
    return Scanner(given, least)


def scan_licenses(
    docs: DataFrame,
    text: str = "text",
    doc_id: str = "doc_id",
    given: tuple[tuple[str, str], ...] | None = None,
    least: float = 0.8,
) -> DataFrame:
    """Licences in every whole text, one row per input row: ``doc_id, n_licenses, license, score, spans``.

    ``license`` and ``score`` are of the best match (null without one), ``spans``
    all as ``licence:start:end`` in code points.  Text is compared in lower case,
    by words of letters and digits.  Null texts count as empty; texts, lines and
    templates of fewer than two words have no bigrams and match nothing.  The
    templates are a parameter (:func:`templates` without) and go out with the code.
    """
    given = templates() if given is None else given
    rows = docs.select(docs[doc_id].alias("doc_id"), text_of(docs, text).alias("text"))

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scanner = _scanner(given, least)
        for pdf in batches:
            found = [scanner.scan(t) for t in pdf["text"]]
            best = [max(f, key=lambda x: x[3]) if f else (None, 0, 0, None) for f in found]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"].array,
                    "n_licenses": [len(f) for f in found],
                    "license": pd.Series([b[0] for b in best], dtype=object),
                    "score": pd.Series([b[3] for b in best], dtype="float64"),
                    "spans": [",".join(f"{n}:{s}:{e}" for n, s, e, _ in f) for f in found],
                }
            )

    out = rows.mapInPandas(scan, f"doc_id {dict(rows.dtypes)['doc_id']}, n_licenses long, license string, score double, spans string")
    return out.withColumn("score", F.nanvl("score", F.lit(None)))
