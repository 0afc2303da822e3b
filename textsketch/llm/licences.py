"""Licence notices by Dice coefficient over word bigrams.

Each line, each paragraph of several lines and each whole text is normalised (lower case, words, numbers
as #) and compared to the templates that share a bigram with it and whose size is within the
bounds that the threshold leaves: 2 min(a, b) / (a + b) is the most that sizes a and b allow. So is each window of as
many words as a template has, wherever enough of the template's bigrams lie within that many words: a
notice inside a long line, or wrapped within a longer paragraph, is found too.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, pick

THRESHOLD = 0.8
TEMPLATES = {
    "AGPL": ["This work is licensed under the GNU Affero General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "Apache": ["Licensed under the Apache License, Version 2.0.", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'],
    "BSD": ["Released under the BSD License.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC0": ["Released into the public domain under CC0 1.0.", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
    "GPL": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "ISC": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "LGPL": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "MIT": ["Released under the MIT License.", 'Permission is hereby granted, free of charge, '
            'to any person obtaining a copy of '
            'this software and associated documentation files (the '
            '"Software"), to deal in the Software without '
            'restriction, including without limitation the rights to '
            'use, copy, modify, merge, publish, distribute, sublicense, '
            'and/or sell copies of the Software, and '
            'to permit persons to whom the Software '
            'is furnished to do so, subject to '
            'the following conditions:'],
    "MPL": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
}
#: The rest of these notices, and those of further licences.
_MORE = {
    "MIT": [
        'SPDX-License-Identifier: MIT',
        (
            'The above copyright notice and this permission notice shall '
            'be included in all copies or substantial portions of '
            'the Software.'
        ),
        (
            'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF '
            'ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED '
            'TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR '
            'PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS '
            'OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES '
            'OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, '
            'TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN '
            'CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER '
            'DEALINGS IN THE SOFTWARE.'
        ),
    ],
    "ISC": [
        'SPDX-License-Identifier: ISC',
        (
            'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR '
            'DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING '
            'ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO '
            'EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, '
            'DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
            'RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER '
            'IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS '
            'ACTION, ARISING OUT OF OR IN CONNECTION WITH THE '
            'USE OR PERFORMANCE OF THIS SOFTWARE.'
        ),
    ],
    "Apache": [
        'SPDX-License-Identifier: Apache-2.0',
        (
            'Unless required by applicable law or agreed to in '
            'writing, software distributed under the License is distributed on '
            'an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF '
            'ANY KIND, either express or implied. See the License '
            'for the specific language governing permissions and limitations under '
            'the License.'
        ),
    ],
    "BSD": [
        'SPDX-License-Identifier: BSD-3-Clause',
        'SPDX-License-Identifier: BSD-2-Clause',
        (
            'Redistributions of source code must retain the above copyright '
            'notice, this list of conditions and the following disclaimer.'
        ),
        (
            'Redistributions in binary form must reproduce the above copyright '
            'notice, this list of conditions and the following disclaimer '
            'in the documentation and/or other materials provided with the '
            'distribution.'
        ),
        (
            'Neither the name of the copyright holder nor the '
            'names of its contributors may be used to endorse '
            'or promote products derived from this software without specific '
            'prior written permission.'
        ),
        (
            'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND '
            'CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, '
            'INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
            'MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
            'IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS '
            'BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, '
            'OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT '
            'OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, '
            'OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON '
            'ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, '
            'OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY '
            'WAY OUT OF THE USE OF THIS SOFTWARE, EVEN '
            'IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
        ),
    ],
    "GPL": [
        'SPDX-License-Identifier: GPL-3.0-or-later',
        'SPDX-License-Identifier: GPL-2.0-only',
        (
            'This program is distributed in the hope that it '
            'will be useful, but WITHOUT ANY WARRANTY; without even '
            'the implied warranty of MERCHANTABILITY or FITNESS FOR A '
            'PARTICULAR PURPOSE. See the GNU General Public License for '
            'more details.'
        ),
        (
            'You should have received a copy of the GNU '
            'General Public License along with this program. If not, '
            'see <https://www.gnu.org/licenses/>.'
        ),
        'This work is licensed under the GNU General Public License, version 2.',
    ],
    "AGPL": [
        'SPDX-License-Identifier: AGPL-3.0-or-later',
        (
            'You should have received a copy of the GNU '
            'Affero General Public License along with this program. If '
            'not, see <https://www.gnu.org/licenses/>.'
        ),
    ],
    "LGPL": [
        'SPDX-License-Identifier: LGPL-2.1-or-later',
        (
            'This library is free software; you can redistribute it '
            'and/or modify it under the terms of the GNU '
            'Lesser General Public License as published by the Free '
            'Software Foundation; either version 2.1 of the License, or '
            '(at your option) any later version.'
        ),
        (
            'This library is distributed in the hope that it '
            'will be useful, but WITHOUT ANY WARRANTY; without even '
            'the implied warranty of MERCHANTABILITY or FITNESS FOR A '
            'PARTICULAR PURPOSE. See the GNU Lesser General Public License '
            'for more details.'
        ),
    ],
    "MPL": [
        'SPDX-License-Identifier: MPL-2.0',
        (
            'If a copy of the MPL was not distributed '
            'with this file, You can obtain one at https://mozilla.org/MPL/2.0/.'
        ),
    ],
    "CC-BY": [
        'SPDX-License-Identifier: CC-BY-4.0',
        (
            'This work is licensed under the Creative Commons Attribution '
            '4.0 International License. To view a copy of this '
            'license, visit http://creativecommons.org/licenses/by/4.0/.'
        ),
    ],
    "CC-BY-SA": [
        'SPDX-License-Identifier: CC-BY-SA-4.0',
        (
            'This work is licensed under the Creative Commons Attribution-ShareAlike '
            '4.0 International License. To view a copy of this '
            'license, visit http://creativecommons.org/licenses/by-sa/4.0/.'
        ),
    ],
    "CC-BY-NC": [
        'SPDX-License-Identifier: CC-BY-NC-4.0',
    ],
    "CC0": [
        'SPDX-License-Identifier: CC0-1.0',
    ],
    "Unlicense": [
        'SPDX-License-Identifier: Unlicense',
        'This is free and unencumbered software released into the public domain.',
        (
            'Anyone is free to copy, modify, publish, use, compile, '
            'sell, or distribute this software, either in source code '
            'form or as a compiled binary, for any purpose, '
            'commercial or non-commercial, and by any means.'
        ),
        (
            'In jurisdictions that recognize copyright laws, the author or '
            'authors of this software dedicate any and all copyright '
            'interest in the software to the public domain.'
        ),
    ],
    "Zlib": [
        'SPDX-License-Identifier: Zlib',
        (
            "This software is provided 'as-is', without any express or "
            'implied warranty. In no event will the authors be '
            'held liable for any damages arising from the use '
            'of this software.'
        ),
        (
            'Permission is granted to anyone to use this software '
            'for any purpose, including commercial applications, and to alter '
            'it and redistribute it freely, subject to the following '
            'restrictions:'
        ),
        (
            'The origin of this software must not be misrepresented; '
            'you must not claim that you wrote the original '
            'software.'
        ),
        (
            'Altered source versions must be plainly marked as such, '
            'and must not be misrepresented as being the original '
            'software.'
        ),
    ],
    "BSL": [
        'SPDX-License-Identifier: BSL-1.0',
        'Distributed under the Boost Software License, Version 1.0.',
    ],
    "EPL": [
        'SPDX-License-Identifier: EPL-2.0',
        (
            'This program and the accompanying materials are made available '
            'under the terms of the Eclipse Public License 2.0.'
        ),
    ],
    "WTFPL": [
        'SPDX-License-Identifier: WTFPL',
        (
            'Everyone is permitted to copy and distribute verbatim or '
            'modified copies of this license document, and changing it '
            'is allowed as long as the name is changed.'
        ),
    ],
}
TEMPLATES = {name: TEMPLATES.get(name, []) + _MORE.get(name, []) for name in sorted({*TEMPLATES, *_MORE})}
_word = re.compile(r"\w+").findall


def load(folder: str) -> dict[str, list[str]]:
    """Templates from a folder: one for each file, named by what its name has before the first _ or dot."""
    out: dict[str, list[str]] = defaultdict(list)
    for file in sorted(Path(folder).iterdir()):
        out[re.split(r"[_.]", file.name)[0]].append(file.read_text(encoding="utf-8"))
    return dict(out)


def normalised(text: str) -> list[str]:
    return ["#" if "0" <= w[0] <= "9" and w.isascii() and w.isdigit() else w for w in _word(text.lower())]


def units(of: list[str]) -> Iterator[tuple[int, int]]:
    """(first line, last line) of each line, each paragraph of more lines, and the whole if that is more."""
    start = None
    for k, line in enumerate([*of, ""]):
        if k < len(of):
            yield k, k
        blank = not line.strip(" \t\r")
        if blank and start is not None:
            if k - 1 > start and (start > 0 or k < len(of)):
                yield start, k - 1
            start = None
        elif not blank and start is None:
            start = k
    if len(of) > 1:
        yield 0, len(of) - 1


class Templates:
    def __init__(self, templates: dict[str, list[str]], threshold: float):
        self.threshold = threshold
        of = [(name, w) for name, texts in sorted(templates.items()) for t in texts if len(w := normalised(t)) > 1]
        self.names, self.words = [n for n, _ in of], [len(w) for _, w in of]
        self.grams = [set(zip(w, w[1:])) for _, w in of]  # noqa: B905
        self.need = [math.ceil(threshold * len(g) / (2 - threshold) - 1e-9) for g in self.grams]  # in common at least
        self.most = max(map(len, self.grams), default=0) * (2 - threshold) / threshold + 1e-9
        self.vocabulary = {w: k + 1 for k, w in enumerate(sorted({w for _, x in of for w in x}))}
        self.index: dict[tuple[str, str], list[int]] = defaultdict(list)
        for k, grams in enumerate(self.grams):
            for g in sorted(grams):
                self.index[g].append(k)
        size = len(self.vocabulary) + 1
        self.codes = np.array(sorted(self.vocabulary[a] * size + self.vocabulary[b] for a, b in self.index), dtype=np.int64)

    def places(self, words: list[str]) -> np.ndarray:
        """Where a bigram of some template begins."""
        ids = np.array(list(map(self.vocabulary.get, words, repeat(0))), dtype=np.int64)
        code = ids[:-1] * (len(self.vocabulary) + 1) + ids[1:]
        if not len(self.codes) or not len(code):
            return np.zeros(0, dtype=np.int64)
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.nonzero(self.codes[at] == code)[0]

    def best(self, own: set[tuple[str, str]]) -> tuple[float, str] | None:
        """(-dice, licence) of a unit's bigrams, the first by name at a tie; None below the threshold."""
        if not own or len(own) > self.most:
            return None
        shared: Counter = Counter(k for g in own for k in self.index.get(g, ()))
        found = []
        for k, n in shared.items():
            size = len(own) + len(self.grams[k])
            if 2 * min(len(own), len(self.grams[k])) >= self.threshold * size - 1e-9 and 2 * n / size >= self.threshold:
                found.append((-2 * n / size, self.names[k]))
        return min(found, default=None)

    def windows(self, words: list[str], places: np.ndarray) -> Iterator[tuple[int, int, float, str]]:
        """(first word, end, -dice, licence): of windows as long as a template that reach the threshold and begin within its length of one another, the best."""
        pairs = list(zip(words, words[1:]))  # noqa: B905
        hits: dict[int, list[int]] = defaultdict(list)
        for p in places.tolist():
            for k in self.index[pairs[p]]:
                hits[k].append(p)
        for k, at in hits.items():
            n, need, grams = self.words[k], self.need[k], self.grams[k]
            if len(at) < need or len(words) < n:
                continue
            own = np.array(at)
            low = np.maximum(0, own[need - 1 :] - (n - 2))
            high = np.minimum(own[: len(own) - need + 1], len(words) - n)
            some = np.nonzero(low <= high)[0]
            last, run = -1, None  # the last start seen; the best of this run
            reached = None  # the last start that reached the threshold
            counts: Counter = Counter()
            for i in some.tolist():
                for start in range(max(int(low[i]), last + 1), int(high[i]) + 1):
                    if start != last + 1 or not counts:
                        counts = Counter(pairs[start : start + n - 1])
                    else:
                        gone = pairs[start - 1]
                        counts[gone] -= 1
                        if not counts[gone]:
                            del counts[gone]
                        counts[pairs[start + n - 2]] += 1
                    last = start
                    common = len(counts.keys() & grams) if len(counts) > len(grams) else sum(g in grams for g in counts)
                    dice = 2 * common / (len(counts) + len(grams))
                    if dice >= self.threshold:
                        if run and start - reached > n:
                            yield run
                            run = None
                        if run is None or -dice < run[2]:
                            run = (start, start + n, -dice, self.names[k])
                        reached = start
            if run:
                yield run

    def find(self, text: str) -> list[tuple[int, int, str, float]]:
        """(first line, last line, licence, dice) of all units and windows, of each place's the best."""
        words = normalised(text)
        places = self.places(words)
        if not len(places):
            return []
        lines = text.split("\n")
        ends = np.cumsum([len(_word(line.lower())) for line in lines])
        begins = np.concatenate([[0], ends[:-1]])
        known = np.zeros(len(words) + 1, dtype=np.int64)
        known[places + 1] = 1
        known = np.cumsum(known)  # of bigrams that begin before each word
        found: dict[tuple[int, int], tuple[float, str]] = {}
        least = min(self.need)
        for a, b in units(lines):
            i, j = int(begins[a]), int(ends[b])
            if j - i > 1 and known[j - 1] - known[i] >= least and (got := self.best(set(zip(words[i : j - 1], words[i + 1 : j])))):  # noqa: B905
                found[a, b] = min(got, found.get((a, b), got))
        for i, j, dice, name in self.windows(words, places):
            at = tuple(np.searchsorted(ends, [i, j - 1], "right").tolist())
            found[at] = min((dice, name), found.get(at, (dice, name)))
        return [(*at, name, -dice) for at, (dice, name) in sorted(found.items())]


def scan(docs: DataFrame, templates: dict[str, list[str]] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, first_line, last_line, licence, dice): each unit or window of a text that is a licence notice, the best of each place.

    Lines are counted from 0. Null and empty texts have none; units of fewer than two words match
    nothing; a tie goes to the first licence by name; repeated rows are returned again; an empty
    table gives no rows; columns other than doc_id and text are ignored, whatever they are called. Texts are read whole.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES, threshold))
    schema = "doc_id bigint, first_line int, last_line int, licence string, dice double"
    types = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                rows += [(doc_id, *x) for x in shared.value.find(text or "")]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], type=t) for k, t in enumerate(types)], names=[x.split()[0] for x in schema.split(", ")])

    docs = pick(docs, doc_id="bigint", text="string")
    return docs.mapInArrow(run, schema)
