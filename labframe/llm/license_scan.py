"""License scans: normalised text compared with licence templates by the Dice coefficient over word bigrams.

Text and templates are lower-cased (A-Z) and cut into words of ASCII letters and digits; what remains is the set of
neighbouring word pairs. A Dice coefficient of at least t needs sizes within a factor (2 - t) / t of each other, and
at least t / (2 - t) of a template's pairs: a text that has fewer of them is done with after one look at its pairs.

Compared are every line, the whole text, and runs of lines: those that begin on a line with the first pair of a
template and go on for two lines or more, to any line after which the run's distinct pairs are no more than a match
can have. So notices, full licences and headers wrapped over lines of a longer text are found, however often their
words repeat. Whole texts and runs leave out lines that begin with a copyright, as these name holders; lines without
words count for nothing in a run.

Batches of Arrow memory: words are coded, a pair is a number, and pairs of templates are looked up. A run's distinct
pairs are counted by where each pair was seen last before, so a start costs one pass over what follows it, and only
texts with enough pairs of a template have any.

Defined results: null and empty texts match nothing; repeated rows are scanned each; texts of one word have no pairs
and match nothing; lines and texts of any number of words are compared, as words may repeat; columns other than key
and text are ignored; an empty table gives an empty table.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labframe.llm.common import by_bytes, guarded

#: Least Dice coefficient of a match.
DICE = 0.9
#: Public licence notices and texts, by SPDX name.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("BSD-2-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("BSD-3-Clause", 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Proprietary", "All rights reserved."),
]
#: Fixed value: what separates words after lower-casing.
BREAKS = "[^a-z0-9]+"


#: Bytes of text that are looked at together.
BATCH_BYTES = 4_000_000
_CLASS = np.zeros(256, np.uint8)
for _b in (*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B)):  # what a word is of, A-Z lower-cased
    _CLASS[_b] = _b + 32 if 0x41 <= _b < 0x5B else _b


def plain_words(text: str) -> list[str]:
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return [w for w in re.split(BREAKS, text.translate(str.maketrans(upper, upper.lower()))) if w]


def word_pairs(text: str) -> list[str]:
    words = plain_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:], strict=False)})


def bounds(size: int, dice: float) -> tuple[int, int]:
    """Sizes that a set can have and reach this coefficient with one of `size`; the least is also what they share at least."""
    return math.ceil(size * dice / (2 - dice) - 1e-9), math.floor(size * (2 - dice) / dice + 1e-9)


class Templates:
    """The templates' pairs as numbers: of a pair, the templates that have it."""

    def __init__(self, templates: list[tuple[str, str]], dice: float):
        self.dice = dice
        self.names = [name for name, _ in templates]
        pairs = [word_pairs(text) for _, text in templates]
        self.sizes = np.array([len(p) for p in pairs], np.int64)
        self.bounds = [bounds(len(p), dice) for p in pairs]
        self.known = {p: i for i, p in enumerate(sorted({p for x in pairs for p in x}))}
        self.words = sorted({w for p in self.known for w in p.split(" ")})
        self.of = [(self.known[p], t) for t, x in enumerate(pairs) for p in x]
        starts = (plain_words(text)[:2] for _, text in templates)
        self.first = sorted({self.known[f"{w[0]} {w[1]}"] for w in starts if len(w) > 1})
        # pairs by their words' places, in order, and the templates of each
        place = {w: i for i, w in enumerate(self.words)}
        keys = np.array([place[p.split(" ")[0]] * len(self.words) + place[p.split(" ")[1]] for p in self.known], np.int64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.has = np.zeros((len(templates), len(self.known) + 1), bool)  # the last pair is none
        for p, t in self.of:
            self.has[t, p] = True

    def pairs_of(self, words: np.ndarray) -> np.ndarray:
        """The known pair that each word begins with the next one, or the number that stands for none; words by place, -1 if unknown."""
        none = len(self.known)
        out = np.full(max(len(words) - 1, 0), none, np.int64)
        if len(out) and none:
            both = (words[:-1] >= 0) & (words[1:] >= 0)
            key = words[:-1] * len(self.words) + words[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = both & (self.keys[at] == key)
            out[hit] = self.order[at[hit]]
        return out


def cut_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """(code, row and line of each word of all texts in turn, the distinct words, lines of each text)."""
    raw = texts.fill_null("").cast(pa.large_binary())
    ends = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    source = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    data = _CLASS[source]
    inside = data != 0
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    first = ends[:-1][ends[:-1] < len(data)]
    begins[first] = inside[first]
    starts = np.flatnonzero(begins)
    letters = np.concatenate([[0], np.cumsum(inside)])
    offsets = np.append(letters[starts], letters[-1]).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data[inside]))])
    coded = words.dictionary_encode()
    row = np.searchsorted(ends, starts, "right") - 1
    breaks = np.flatnonzero(source == 10)
    before = np.searchsorted(breaks, ends)
    line = np.searchsorted(breaks, starts) - before[row]
    return coded.indices.to_numpy().astype(np.int64), row, line, coded.dictionary, np.diff(before) + 1


def named(code: np.ndarray, unit: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Whether each word is of a line (`unit`) that begins with a copyright: that word, or a c in front of it or of a number."""
    if not len(code):
        return np.zeros(0, bool)
    is_name, is_c = (np.array([w == x for w in words]) for x in (b"copyright", b"c"))
    is_number = np.array([w.isdigit() for w in words])
    first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
    n = np.diff(np.append(first, len(unit)))
    second = code[np.minimum(first + 1, len(code) - 1)]
    begins = is_name[code[first]] | (is_c[code[first]] & (n > 1) & (is_name[second] | is_number[second]))
    return np.repeat(begins, n)


def distinct_hits(unit: np.ndarray, pair: np.ndarray, t: Templates) -> list[tuple[int, int]]:
    """(unit, template) where a unit has enough distinct pairs of a template; unit and pair of the places of known pairs."""
    if not len(unit):
        return []
    seen = np.unique(unit * (len(t.known) + 1) + pair)
    unit, pair = seen // (len(t.known) + 1), seen % (len(t.known) + 1)
    ids, at = np.unique(unit, return_inverse=True)
    out = []
    for k in range(len(t.names)):
        count = np.bincount(at, t.has[k][pair], len(ids))
        out += [(int(u), k) for u in ids[count >= max(1, t.bounds[k][0])]]
    return out


def best_of_runs(keys: np.ndarray, mine: np.ndarray, lines: np.ndarray, starts: np.ndarray, size: int, low: int, top: int) -> list[tuple[int, float]]:
    """(line, best coefficient) of the runs that begin on each of some lines of one text, two lines or more.

    keys: the pair that each word but the last begins; mine: the pair is one of the template, of `size` pairs; lines:
    the line of each word. A pair counts where it was not seen since the start; runs of `low` to `top` distinct pairs
    can match, and once one has more, no longer one can.
    """
    order = np.argsort(keys, kind="stable")
    last = np.full(len(keys), -1, np.int64)
    again = keys[order][1:] == keys[order][:-1]
    last[order[1:][again]] = order[:-1][again]
    ends = np.append(lines[1:] != lines[:-1], True)[1:]  # pairs whose second word ends a line
    out = []
    for line in starts.tolist():
        at = int(np.searchsorted(lines, line))
        width = 4 * top + 64
        while True:
            new = last[at : at + width] < at
            if at + width >= len(keys) or new.sum() > top:
                break
            width *= 2
        total, common = np.cumsum(new), np.cumsum(new & mine[at : at + width])
        stop = np.flatnonzero(ends[at : at + width] & (total >= low) & (total <= top) & (lines[1:][at : at + width] > line))
        if len(stop):
            out.append((line, float((2 * common[stop] / (total[stop] + size)).max())))
    return out


def scanned(texts: pa.Array, t: Templates) -> list[tuple[int, int, int, float]]:
    """(row, line, template, coefficient) of all matches: lines, runs by their first line, whole texts as line -1."""
    code, row, line, known, n_lines = cut_words(texts)
    words = known.to_pylist()
    place = {w.encode(): i for i, w in enumerate(t.words)}
    of = np.array([place.get(w, -1) for w in words], np.int64)
    width = max(int(n_lines.max()) if len(n_lines) else 1, 1)
    found: list[tuple[int, int, int, float]] = []

    def score(keys: np.ndarray, pair: np.ndarray, k: int) -> float:
        n, (low, top) = len(np.unique(keys)), t.bounds[k]
        return 2 * len(np.unique(keys[t.has[k][pair]])) / (n + int(t.sizes[k])) if low <= n <= top else 0.0

    # lines
    unit = row * width + line
    same = unit[1:] == unit[:-1]
    pair = np.where(same, t.pairs_of(of[code]), len(t.known)) if len(code) else np.zeros(0, np.int64)
    hit = np.flatnonzero(pair < len(t.known))
    for u, k in distinct_hits(unit[hit], pair[hit], t):
        a, b = np.searchsorted(unit, [u, u + 1])
        got = score(code[a : b - 1] * len(words) + code[a + 1 : b], pair[a : b - 1], k)
        if got >= t.dice:
            found.append((u // width, u % width, k, got))
    # whole texts and runs, without lines that name a holder
    begins = np.isin(pair, t.first)
    rest = ~named(code, unit, words)
    starts = np.unique(unit[:-1][begins & rest[:-1]]) if len(code) else unit
    code, row, line = code[rest], row[rest], line[rest]
    pair = np.where(row[1:] == row[:-1], t.pairs_of(of[code]), len(t.known)) if len(code) else np.zeros(0, np.int64)
    hit = np.flatnonzero(pair < len(t.known))
    for r, k in distinct_hits(row[hit], pair[hit], t):
        if n_lines[r] < 2:
            continue
        a, b = np.searchsorted(row, [r, r + 1])
        keys, mine = code[a : b - 1] * len(words) + code[a + 1 : b], pair[a : b - 1]
        got = score(keys, mine, k)
        if got >= t.dice:
            found.append((r, -1, k, got))
        lo, hi = np.searchsorted(starts, [r * width, (r + 1) * width])
        runs = best_of_runs(keys, t.has[k][mine], line[a:b], starts[lo:hi] - r * width, int(t.sizes[k]), *t.bounds[k])
        found += [(r, at, k, got) for at, got in runs if got >= t.dice]
    best: dict[tuple[int, int, int], float] = {}
    for *at, got in found:  # a line and a run that begins on it
        best[tuple(at)] = max(got, best.get(tuple(at), 0.0))
    return [(*at, got) for at, got in best.items()]


def matches(df: DataFrame, id_column: str = "doc_id", text: str = "text", dice: float = DICE, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, row, line, license, template, dice): lines, runs by their first line, or -1 for the whole text, that match a template; `row` tells rows of one key apart."""
    guarded(df.columns, [id_column, text], "license_scan")
    known, kind = Templates(templates or TEMPLATES, dice), df.schema[id_column].dataType.simpleString()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            rows = scanned(batch.column("text"), known)
            row, line, template, score = zip(*rows, strict=True) if rows else ((), (), (), ())
            at = pa.array(row, pa.int64())
            columns = [batch.column("id").take(at), batch.column("row").take(at), pa.array(line, pa.int32()), pa.array([known.names[k] for k in template], pa.string()), pa.array(template, pa.int32()), pa.array(score, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["id", "row", "line", "license", "template", "dice"])

    rows = df.select(F.col(id_column).alias("id"), F.monotonically_increasing_id().alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(scan, f"id {kind}, row bigint, line int, license string, template int, dice double")


def licenses(df: DataFrame, id_column: str = "doc_id", text: str = "text", dice: float = DICE, templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """(id, n_matches, licenses, lines, best) for each row of df that matches some template: how many templates match on how many lines, names and lines, comma-joined."""
    found = matches(df, id_column, text, dice, templates)
    out = found.groupBy("row", "id").agg(F.count_distinct("line", "template").alias("n_matches"), F.array_join(F.array_sort(F.collect_set("license")), ",").alias("licenses"), F.array_join(F.array_sort(F.collect_set("line")).cast("array<string>"), ",").alias("lines"), F.max("dice").alias("best"))
    return out.select(F.col("id").alias(id_column), "n_matches", "licenses", "lines", "best")
