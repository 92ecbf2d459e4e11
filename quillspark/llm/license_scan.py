"""Operator 10, license scans: Dice coefficient over word bigrams against licence templates.

Texts are normalised (lower case; words of letters and digits, with inner dots and hyphens; lines that only name a
copyright holder go from templates and from texts, up to the end of their sentence and never with words of a template). Compared with a template of m bigrams is every contiguous part of the
text, of any length. The Dice coefficient of sizes a and b is at most 2 min(a, b) / (a + b), so only parts of m t / (2 - t) to
m (2 - t) / t bigrams can reach the threshold t, and most templates fall to too few common bigrams in the text or in reach. A
part without a common bigram at an end gains when that end is cut, so parts from common bigram to common bigram suffice. The
number of common bigrams in a part bounds its coefficient; beginnings are tried in the order of that bound, each with exact
counts over all its ends, until no other can be nearer.

Defined results: null and empty texts match nothing; a text may match several licences, each once, at its best part (the
first if parts tie); where matches overlap only the nearest licence counts, and another one at its best part that overlaps none; rows that repeat each get their matches; an empty table gives an empty result; further columns are
not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Container, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.llm.simhash import texts_of

THRESHOLD = 0.8
WORDS = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
#: A holder's line up to its sentence's end: the word, a sign or a year, and the name.
HOLDER = re.compile(r"^\W*copyright\s*(?:\(c\)|©|\d{4}\b|by\b|:)[^\n]*?(?:\.(?=\s)|$)", re.M)

#: Published notices and licence texts, by name. A name may have several; pass further ones as templates.
BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. """
BSD_ENDORSEMENT = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("BSD-2-Clause", BSD_CONDITIONS + BSD_DISCLAIMER),
    ("BSD-3-Clause", BSD_CONDITIONS + BSD_ENDORSEMENT + BSD_DISCLAIMER),
    ("BSD-3-Clause", BSD_ENDORSEMENT),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE. For more information, please refer to http://unlicense.org/"""),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
]


def normal(text: str, known: Container = frozenset()) -> list[str]:
    """The words that count. A holder's line goes up to its sentence's end, unless it holds a known bigram of a template."""
    lowered = text.lower()

    def told(m: re.Match) -> str:
        return m[0] if any(b in known for b in bigrams(WORDS.findall(m[0]))) else "\n"

    return WORDS.findall(HOLDER.sub(told, lowered) if "copyright" in lowered else lowered)


def bigrams(words: list[str]) -> list[tuple[str, str]]:
    return list(zip(words, words[1:]))


def dice(a: Counter, b: Counter) -> float:
    """2 |a and b| / (|a| + |b|) of multisets; 0 of two empty ones."""
    total = a.total() + b.total()
    return 2 * (a & b).total() / total if total else 0.0


class Scanner:
    def __init__(self, templates=TEMPLATES, threshold: float = THRESHOLD) -> None:
        self.t = threshold
        self.templates = [(name, len(b), Counter(b)) for name, text in templates if (b := bigrams(normal(text)))]
        self.places = defaultdict(list)
        for k, (_, _, counts) in enumerate(self.templates):
            for b in counts:
                self.places[b].append(k)
        self.firsts = {b[0] for b in self.places}

    def nearest(self, pairs: list, where: np.ndarray, k: int) -> tuple[float, int, int] | None:
        """(dice, first bigram, number of bigrams) of the part nearest to template k; the first, then the shortest of equal ones."""
        _, m, template = self.templates[k]
        most, least = int(m * (2 - self.t) / self.t + 1e-9), m * self.t / (2 - self.t) - 1e-9
        ends = np.searchsorted(where, where + most)  # parts from common bigram i end before ends[i]
        best, bounds = (0.0, 0, 0), np.zeros(len(where))
        for i in np.flatnonzero(ends - np.arange(len(where)) >= least).tolist():
            counts = np.arange(1, ends[i] - i + 1)
            bounds[i] = (2 * np.minimum(counts, m) / (where[i : ends[i]] - where[i] + 1 + m)).max()
        for i in np.argsort(-bounds, kind="stable").tolist():
            if bounds[i] < max(self.t, best[0]):
                break
            left, common, first = dict(template), 0, int(where[i])
            for at in where[i : ends[i]].tolist():
                b = pairs[at]
                if left[b]:
                    left[b] -= 1
                    common += 1
                    d = 2 * common / (at - first + 1 + m)
                    if d > best[0] or d == best[0] and first < best[1]:
                        best = (d, first, at - first + 1)
        return best if best[0] >= self.t else None

    def scan(self, text: str) -> list[tuple[str, float, int, int]]:
        """(licence, dice, first word, number of words) of each licence found."""
        words = normal(text, self.places)
        if self.firsts.isdisjoint(words):
            return []
        pairs, hits = bigrams(words), defaultdict(list)
        for at, b in enumerate(pairs):
            for k in self.places.get(b, ()):
                hits[k].append(at)
        hits = {k: np.array(found, np.int64) for k, found in hits.items()}
        best = {name: x for name in {self.templates[k][0] for k in hits} if (x := self.best(name, pairs, hits, [(0, len(pairs))]))}
        kept, free = [], [(0, len(pairs))]
        while best:
            name = min(best, key=lambda n: (-best[n][0], best[n][1], n))
            d, a, size = best.pop(name)
            kept.append((name, d, a, size + 1))
            free = [(x, y) for s, e in free for x, y in ((s, min(e, a - 1)), (max(s, a + size + 1), e)) if x < y]  # a part takes a word more than its bigrams
            for other, (_, b, n) in list(best.items()):
                if b <= a + size and a <= b + n:  # of licences at one place the nearest; another part of this one may be near too
                    again = self.best(other, pairs, hits, free)
                    best.pop(other) if again is None else best.update({other: again})
        return sorted(kept)

    def best(self, name: str, pairs: list, hits: dict[int, np.ndarray], free: list[tuple[int, int]]) -> tuple[float, int, int] | None:
        """(dice, first bigram, bigrams) of the part nearest to a template of this name, inside one of the free stretches of bigrams."""
        found = []
        for k, where in hits.items():
            own, m, _ = self.templates[k]
            if own != name:
                continue
            for s, e in free:
                inside = where[np.searchsorted(where, s) : np.searchsorted(where, e)]
                if len(inside) >= self.t * m / (2 - self.t) - 1e-9 and (near := self.nearest(pairs, inside, k)):  # what the smallest part that fits must hold
                    found.append(near)
        return min(found, key=lambda x: (-x[0], x[1], x[2])) if found else None


def _scan(templates, threshold):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(templates, threshold)
        for batch in batches:
            rows = [(doc_id, *x) for doc_id, text in zip(batch.column(0).to_pylist(), texts_of(batch.column(1))) if text for x in scanner.scan(text.decode("utf-8", "replace"))]
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.string(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "license", "dice", "first_word", "n_words"])

    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, license, dice, first_word, n_words: one row per document and licence found."""
    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(_scan(templates, threshold), "doc_id long, license string, dice double, first_word long, n_words long")


def query(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))

