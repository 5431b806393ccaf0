"""Licence scans: matching statistics against a generalised suffix automaton, chained into covered template spans."""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.shared import sliced

#: The phrases and labels of the operator's contract.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Texts and notices of common licences.
TEMPLATES = {
    "mit": [
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        "Released under the MIT License",
        "Licensed under the MIT License",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
        "Licensed under the Apache License, Version 2.0",
    ],
    "gpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "licensed under the GNU General Public License, version 3",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this library; if not, write to the Free Software Foundation, Inc.",
        "licensed under the GNU Lesser General Public License, version 3",
    ],
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see https://www.gnu.org/licenses/.",
        "licensed under the GNU Affero General Public License, version 3",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution.",
    ],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work", "Licensed under CC0 1.0 Universal"],
    "isc": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    ],
    "cc-by": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License", "Licensed under CC BY-SA 4.0"],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution NonCommercial 4.0 International License", "Licensed under CC BY-NC 4.0"],
}
#: Words of a match that counts for a template (or all of the template's), words between two matches of a chain, and
#: the share of a template's words that gives its label.
MIN_MATCH, MAX_GAP, LEAST_SHARE = 6, 12, 0.6
PHRASE_SCORE = 0.5
_ARROW = pa.schema(
    [
        ("id", pa.int64()),
        ("n_words", pa.int64()),
        ("places", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())]))),
        ("spans", pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()), ("end", pa.int64()), ("share", pa.float64())]))),
    ]
)
_LETTERS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, letters and characters beyond ASCII, A-Z lowered."""
    return (text or "").encode().translate(_LETTERS).split()


class Automaton:
    """A generalised suffix automaton over the words of all templates, and of the phrases.

    Each state knows, by template, all places where its string ends, and which phrases are suffixes of its string.
    """

    def __init__(self, phrases: dict[str, str], templates: dict[str, list[str]]):
        self.phrases = [(words_of(p), label) for p, label in phrases.items()]
        self.templates = [(words_of(t), label) for label, texts in templates.items() for t in texts]
        self.ids: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, set[int]]] = [{}]
        every = [w for w, _ in self.templates + self.phrases]
        self.least = min(2, *map(len, every), 2)  # matches of fewer words say nothing
        for k, found in enumerate(every):
            state = 0
            for at, w in enumerate(found):
                state = self._extend(state, self.ids.setdefault(w, len(self.ids)))
                if k < len(self.templates):
                    self.ends[state].setdefault(k, set()).add(at)
        self.outputs: list[list[int]] = [[] for _ in self.next]  # the lengths of phrases
        for k, (found, _) in enumerate(self.phrases):
            state = 0
            for w in found:
                state = self.next[state][self.ids[w]]
            self.outputs[state].append(k)
        by_length = sorted(range(1, len(self.next)), key=self.length.__getitem__)
        for s in reversed(by_length):
            for k, at in self.ends[s].items():
                self.ends[self.link[s]].setdefault(k, set()).update(at)
        for s in by_length:
            self.outputs[s] = self.outputs[s] + self.outputs[self.link[s]]
        self.places: list[dict[int, list[int]]] = [{k: sorted(at) for k, at in own.items()} for own in self.ends[1:]]
        self.places.insert(0, {})  # the empty string ends everywhere

    def _new(self, length: int, follow: dict[int, int], link: int) -> int:
        self.next.append(follow)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: int, q: int) -> int:
        """A state of its own for the strings of q that end behind p."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, w: int) -> int:
        q = self.next[last].get(w)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._split(last, w, q)
        state, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = state
            p = self.link[p]
        if p >= 0:
            q = self.next[p][w]
            self.link[state] = q if self.length[q] == self.length[p] + 1 else self._split(p, w, q)
        return state

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int]]]:
        """Places (phrase, first word) and right-maximal matches (first word, words, state) of a text.

        Only runs of known words as long as the shortest match that counts are stepped through.
        """
        get = self.ids.get
        ids = np.array([get(w, -1) for w in found], np.int32)
        known = np.concatenate(([False], ids >= 0, [False]))
        edges = np.flatnonzero(known[1:] != known[:-1])
        places, matches = [], []
        for begin, end in edges.reshape(-1, 2).tolist():
            if end - begin < self.least:
                continue
            state = size = 0
            for at, w in enumerate(ids[begin:end].tolist(), begin):
                grown = self.next[state].get(w)
                if grown is None:
                    if size >= self.least:
                        matches.append((at - size, size, state))
                    while grown is None:
                        state = self.link[state]
                        if state < 0:
                            break
                        size = self.length[state]
                        grown = self.next[state].get(w)
                    if grown is None:
                        state = size = 0
                        continue
                state, size = grown, size + 1
                for k in self.outputs[state]:
                    if len(self.phrases[k][0]) <= size:
                        places.append((k, at + 1 - len(self.phrases[k][0])))
            if size >= self.least:
                matches.append((end - size, size, state))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[int, int, int, int]]:
        """(words covered, template, first word, end) of every chain of every template, in no order.

        A chain goes on where the match also ends further on in the template, at the first such place; else it closes,
        and the match begins the next one.
        """
        done: list[tuple[int, int, int, int]] = []
        under_way: dict[int, tuple[int, int, int, int]] = {}  # first word, end, words covered, place in the template
        for begin, size, state in matches:
            for k, ends in self.places[state].items():
                if size < min(MIN_MATCH, len(self.templates[k][0])):
                    continue
                first, end, covered, place = under_way.get(k, (begin, begin, 0, -1))
                later = bisect.bisect_right(ends, place)
                if begin - end > MAX_GAP or later == len(ends):
                    done.append((covered, k, first, end))
                    first, end, covered, later = begin, begin, 0, 0
                under_way[k] = first, begin + size, covered + begin + size - max(begin, end), ends[later]
        return done + [(covered, k, first, end) for k, (first, end, covered, _) in under_way.items()]

    def spans(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, int, int, float]]:
        """(label, first word, end, share of the template) of the chains, by label and place.

        Of chains of different labels, one that shares more than half of its words with one that covers more goes: one
        notice often differs from another by a few words. So a text that has a notice several times has as many spans.
        """
        kept: list[tuple[str, int, int, float]] = []
        starts: list[tuple[int, int, str]] = []  # what is kept, by first word
        longest = 0
        for covered, k, first, end in sorted(self.chains(matches), key=lambda x: (-min(x[0], len(self.templates[x[1]][0])), x[1], x[2])):
            label, whole = self.templates[k][1], len(self.templates[k][0])
            around = starts[bisect.bisect_left(starts, (first - longest,)) : bisect.bisect_left(starts, (end,))]
            if all(x == label or 2 * (min(end, b) - max(first, a)) <= end - first for a, b, x in around):
                kept.append((label, first, end, min(1.0, covered / whole)))
                bisect.insort(starts, (first, end, label))
                longest = max(longest, end - first)
        return sorted(kept)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", phrases: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """(id, n_words, places, spans) for every row of docs.

    places: phrase label and first word wherever a phrase's words stand one behind the other, by place; spans: label,
    first word, end and the covered share of a template, once for each time that a template was met. A null or empty
    text has no words; invalid UTF-8 counts as U+FFFD. Null ids and repeated rows stay; an empty table gives an empty one.
    """
    given = (PHRASES if phrases is None else phrases, TEMPLATES if templates is None else templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(*given)
        for batch in sliced(batches):
            rows = []
            for i, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                found = words_of(text)
                places, matches = automaton.scan(found)
                at = sorted((at, automaton.phrases[k][1]) for k, at in places)
                spans = [{"label": a, "first": b, "end": c, "share": d} for a, b, c, d in automaton.spans(matches)]
                rows.append({"id": i, "n_words": len(found), "places": [{"label": label, "first": first} for first, label in at], "spans": spans})
            yield pa.RecordBatch.from_pylist(rows, schema=_ARROW)

    schema = "id long, n_words long, places array<struct<label:string,first:long>>, spans array<struct<label:string,first:long,end:long,share:double>>"
    return docs.select(F.col(id_col).cast("long").alias("id"), F.make_valid_utf8(F.col(text_col)).alias("text")).mapInArrow(run, schema)


def summary(scanned: DataFrame) -> DataFrame:
    """Counts, labels and a score of each scanned row.

    labels: those of phrases, and of templates of which LEAST_SHARE is covered. score: the largest share of any
    template, and PHRASE_SCORE at least where a phrase stands.
    """
    at = F.transform("places", lambda p: p["first"])
    base = F.transform("places", lambda p: p["label"])
    more = F.transform(F.filter("spans", lambda s: s["share"] >= LEAST_SHARE), lambda s: s["label"])
    joined = lambda labels: F.array_join(F.array_sort(F.array_distinct(labels)), ",")
    share = F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0))
    return scanned.select(
        "id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min(at).alias("first_word"),
        F.array_max(at).alias("last_word"),
        joined(base).alias("base_labels"),
        joined(F.concat(base, more)).alias("labels"),
        F.when(F.size("places") > 0, F.greatest(share, F.lit(PHRASE_SCORE))).otherwise(share).alias("score"),
    )
