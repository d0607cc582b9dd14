"""Licence scans by Dice coefficient over word bigrams.

Words are runs of A-Z (lower-cased), 0-9 and bytes beyond ASCII.  The whole text, each paragraph (parted by empty
lines) and each line are compared with licence templates: twice the common distinct bigrams over the sum of both
numbers of distinct bigrams.  Only templates whose size can reach the threshold with the unit's are compared.
Runs of adjoining lines, over paragraphs too, are compared where no text or paragraph matches, and must score more than
any matching line in them: the best ones that do not overlap count as units of the kind ``run``.

Cases: null, empty and one-word texts match nothing; a text that is one line is compared once, as a text; a text that
matches nothing gives a row with null licence and score 0; ties go to the template, then the unit kind, that sorts
first; repeated rows are scanned each; an empty table gives an empty table; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import rowbatch, wordhash

#: As a fraction of whole numbers, so that scores at the threshold are told exactly.
THRESHOLD = (4, 5)
FOUND = "doc_id long, license string, score double, unit string, n_matches long"
KINDS = ("line", "paragraph", "text", "run")
#: Notices and texts of public licences.
TEMPLATES = {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.",
    "AGPL-3.0-notice": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0-notice": "Licensed under CC BY 4.0.",
    "CC-BY-4.0-work": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-work": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0-header": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/.",
    "GPL-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "GPL-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.",
    "MIT": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MIT-notice": "Released under the MIT License.",
    "MPL-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Unlicense-full": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}
_INSIDE = np.zeros(256, bool)
_INSIDE[48:58] = _INSIDE[65:91] = _INSIDE[97:123] = True
_INSIDE[128:] = True


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the bigrams of texts, and their words' places: first word's start, second's end, text."""
    starts, ends, text = wordhash.words(data, offsets, _INSIDE)
    h, at = wordhash.grams(wordhash.ranges(data, starts, ends, fold=True), text, 2)
    return h, starts[at], ends[np.minimum(at + 1, max(len(ends) - 1, 0))] if len(ends) else ends, text[at]


class Scanner:
    def __init__(self, templates: dict[str, str], threshold: tuple[int, int]) -> None:
        self.names, self.threshold = sorted(templates), threshold
        raw = [templates[n].encode("utf-8") for n in self.names]
        h, _, _, which = bigrams(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
        pairs = np.unique(np.rec.fromarrays([h, which]))
        self.keys, self.which = pairs.f0.copy(), pairs.f1.copy()
        self.size = np.bincount(self.which, minlength=len(raw))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.keys & np.uint64(len(self.bits) - 1)] = True

    def scan(self, data: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, float, int, int]]:
        """(text, template, score, kind, number of units that match) of texts with a match."""
        h, begin, end, text = bigrams(data, offsets)
        near = np.flatnonzero(self.bits[h & np.uint64(len(self.bits) - 1)])
        lo, hi = np.searchsorted(self.keys, h[near]), np.searchsorted(self.keys, h[near], "right")
        hit = np.zeros(len(h), bool)
        hit[near[hi > lo]] = True
        if not hit.any():
            return []
        breaks = np.flatnonzero(data == 10)
        line = np.searchsorted(breaks, begin)
        blank = np.append(False, np.diff(breaks) == 1)
        paragraph = np.append(0, np.cumsum(blank))[line]
        one_line = np.searchsorted(breaks, begin) == np.searchsorted(breaks, end)
        found = []
        for kind, unit, ok in ((0, line, one_line), (1, paragraph, np.append(0, np.cumsum(blank))[np.searchsorted(breaks, end)] == paragraph), (2, np.zeros_like(line), np.ones(len(h), bool))):
            touched = np.unique(np.rec.fromarrays([text[hit & ok], unit[hit & ok]]))
            mine = np.flatnonzero(ok & np.isin(text, touched.f0))
            key = np.rec.fromarrays([text[mine], unit[mine]])
            mine = mine[np.isin(key, touched)] if len(touched) else mine[:0]
            order = mine[np.lexsort((h[mine], unit[mine], text[mine]))]
            new = np.ones(len(order), bool)
            t, u, g = text[order], unit[order], h[order]
            new[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1]) | (g[1:] != g[:-1])
            t, u, g, hits = t[new], u[new], g[new], hit[order][new]
            heads = np.ones(len(t), bool)
            heads[1:] = (t[1:] != t[:-1]) | (u[1:] != u[:-1])
            number = np.cumsum(heads) - 1
            sizes = np.bincount(number)
            at = np.flatnonzero(hits)
            low, high = np.searchsorted(self.keys, g[at]), np.searchsorted(self.keys, g[at], "right")
            m = high - low
            which = self.which[np.repeat(low - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
            mine = np.repeat(number[at], m)
            within = self._may_reach(sizes[mine], which)  # templates of other sizes are not counted
            pair, common = np.unique(mine[within] * len(self.names) + which[within], return_counts=True)
            unit_of, template = pair // len(self.names), pair % len(self.names)
            a, b = sizes[unit_of], self.size[template]
            top, base = self.threshold
            score = 2.0 * common / (a + b)
            first = np.flatnonzero(heads)
            for k in np.flatnonzero(2 * base * common >= top * (a + b)).tolist():
                found.append((int(t[first[unit_of[k]]]), -float(score[k]), int(template[k]), kind, int(u[first[unit_of[k]]])))
        found += self._runs(h, text, line, np.searchsorted(breaks, end), paragraph, hit, found)
        lines = np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1) if len(breaks) else np.zeros(len(offsets) - 1, np.int64)
        out: dict[int, tuple] = {}
        units: dict[int, set] = {}
        for text_no, score, template, kind, unit in sorted(found):
            if kind < 2 and lines[text_no] == 0:
                continue  # the only line is the text
            out.setdefault(text_no, (template, -score, kind))
            units.setdefault(text_no, set()).add((kind, unit))
        return [(k, v[0], v[1], v[2], len(units[k])) for k, v in sorted(out.items())]

    def _may_reach(self, a: np.ndarray, template: np.ndarray) -> np.ndarray:
        """Whether a unit of ``a`` bigrams can reach the threshold with a template: if the smaller holds enough of both."""
        top, base = self.threshold
        b = self.size[template]
        return (a * (2 * base - top) >= top * b) & (b * (2 * base - top) >= top * a)

    def _runs(self, h: np.ndarray, text: np.ndarray, line: np.ndarray, last: np.ndarray, paragraph: np.ndarray, hit: np.ndarray, found: list[tuple]) -> list[tuple]:
        """Matches of runs of two adjoining lines or more, outside matching texts and paragraphs."""
        top, base = self.threshold
        at = np.flatnonzero(hit)
        low, high = np.searchsorted(self.keys, h[at]), np.searchsorted(self.keys, h[at], "right")
        m = high - low
        which = self.which[np.repeat(low - (np.cumsum(m) - m), m) + np.arange(int(m.sum()))]
        pairs = np.unique(np.rec.fromarrays([np.repeat(text[at], m), which, np.repeat(h[at], m)]))
        held, common = np.unique(np.rec.fromarrays([pairs.f0, pairs.f1]), return_counts=True)
        enough = common * (2 * base - top) >= top * self.size[held.f1]
        matched: dict[int, list[tuple[int, int]]] = {}
        bars: dict[tuple[int, int], float] = {}
        for text_no, score, _, kind, unit in found:
            if kind:
                matched.setdefault(text_no, []).append((kind, unit))
            else:
                bars[text_no, unit] = max(bars.get((text_no, unit), 0.0), -score)
        runs: dict[int, list[tuple[float, int, int, int]]] = {}
        for text_no, template in zip(held.f0[enough].tolist(), held.f1[enough].tolist()):
            a, b = np.searchsorted(text, text_no), np.searchsorted(text, text_no, "right")
            taken = np.zeros(b - a, bool)
            for kind, unit in matched.get(text_no, []):
                taken |= (kind == 2) | (paragraph[a:b] == unit)
            if taken.all() or line[a] == last[b - 1]:
                continue
            known = set(self.keys[self.which == template].tolist())
            grams, begins, ends, size = h[a:b].tolist(), line[a:b].tolist(), last[a:b].tolist(), len(known)
            # A run may not touch a taken line, whether it begins or ends there.
            shut = set(line[a:b][taken].tolist())
            first: dict[int, int] = {}
            mine = {begins[i] for i in range(b - a) if grams[i] in known}
            for i, x in enumerate(begins):
                if x in mine:
                    first.setdefault(x, i)
            for start, i in first.items():
                seen: set[int] = set()
                n, best, bar = 0, None, 0.0
                while i < len(grams) and begins[i] not in shut and ends[i] not in shut:
                    if grams[i] not in seen:
                        seen.add(grams[i])
                        n += grams[i] in known
                        if len(seen) * top > (2 * base - top) * size:
                            break
                    bar = max(bar, bars.get((text_no, begins[i]), 0.0), bars.get((text_no, ends[i]), 0.0))
                    whole = i + 1 == len(grams) or ends[i + 1] > ends[i]
                    if whole and ends[i] > start and 2 * base * n >= top * (len(seen) + size):
                        score = 2.0 * n / (len(seen) + size)
                        if score > bar:
                            best = max(best or (0.0, 0), (score, -ends[i]))
                    if whole and n == size:
                        break
                    i += 1
                if best:
                    runs.setdefault(text_no, []).append((-best[0], template, start, -best[1]))
        out = []
        for text_no, some in runs.items():
            kept: list[tuple[int, int]] = []
            for score, template, start, end in sorted(some):
                if all(end < s or start > e for s, e in kept):
                    kept.append((start, end))
                    out.append((text_no, score, template, 3, start))
        return out


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: tuple[int, int] = THRESHOLD) -> DataFrame:
    """A row a document: the best licence, its score and kind of unit, and the number of units with a match."""
    known = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known, threshold)
        for batch in rowbatch.small(batches, "text"):
            n = batch.num_rows
            name, score, unit, count = [None] * n, np.zeros(n), [None] * n, np.zeros(n, np.int64)
            for i, template, s, kind, units in scanner.scan(*rowbatch.text_bytes(batch.column("text"))):
                name[i], score[i], unit[i], count[i] = scanner.names[template], s, KINDS[kind], units
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(name, pa.string()), pa.array(score), pa.array(unit, pa.string()), pa.array(count)], names=[f.split()[0] for f in FOUND.split(", ")])

    return docs.select("doc_id", "text").mapInArrow(run, FOUND)
