"""Licence scan: matching statistics against a suffix automaton of licence texts.

One automaton holds every run of words of every template. A text streams
through it; after each word it gives the longest run that ends there and stands
in some template, and its suffix links give the longest run of every other
template too, so that a template which stands within a longer run isn't lost.
Long runs that can't be extended are chained, for each template by itself: the
chain that covers most of its words, in order, with small gaps in the text, is
a span; then the best chain beside it is, and so on. Fixed phrases are found by
the same walk: a phrase ends where the automaton's state lies below the
phrase's, in the tree of suffixes.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewright.llm.common import without

#: Phrases that count wherever their words stand consecutively, with their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))

#: Labels and texts: short public licences whole, section by section, and the notices by which longer ones are applied or referred to. The bodies of GPL, LGPL, Apache, MPL and Creative Commons licences aren't here; `scan` takes other templates.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"),
    ("mit", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"),
    ("mit", "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"),
    ("bsd-3-clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", "THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"),
    ("gpl-notice", "This work is licensed under the GNU General Public License"),
    ("gpl-notice", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("gpl-notice", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details"),
    ("lgpl", "under the terms of the GNU Lesser General Public License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("unlicense", "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "Licensed under CC BY-NC"),
    ("cc-by-nd", "Licensed under CC BY-ND"),
    ("cc-by-sa", "Licensed under CC BY-SA"),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
)
#: Words of a run that counts as long, unless the whole template is shorter; words between two runs of a span at most; share of a template that makes its label, and words of a template that must be there in full to make it.
LONG, GAP, COVERED, SHORT = 3, 20, 0.8, 12
ADDED = ("n_words", "phrases", "spans")
RESULT = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("phrases", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType())]))),
    T.StructField("spans", T.ArrayType(T.StructType([T.StructField("label", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("covered", T.DoubleType()), T.StructField("named", T.BooleanType())]))),
])

#: A-Z to lower case; digits, letters and bytes above ASCII stay; all else parts words.
TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    return (text or "").encode().translate(TABLE).split()


class Automaton:
    """The suffix automaton of several word sequences, built one word at a time."""

    def __init__(self, templates: tuple[tuple[str, str], ...], phrases: tuple[tuple[str, str], ...]):
        self.templates = [(label, words(text)) for label, text in templates]
        self.phrases = [(label, words(text)) for text, label in phrases]
        self.number: dict[bytes, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, int]]] = [[]]
        for which, (_, seq) in enumerate([*self.templates, *self.phrases]):
            last = 0
            for at, w in enumerate(seq):
                last = self._add(last, self.number.setdefault(w, len(self.number)))
                ends += [[] for _ in range(len(self.link) - len(ends))]
                if which < len(self.templates):
                    ends[last].append((which, at + 1))
        self.numbers = [[self.number[w] for w in seq] for _, seq in self.templates]
        # Where each state's words end in each template: its own places and those of all states below it.
        self.ends = [dict[int, list[int]]() for _ in self.link]
        for s in sorted(range(1, len(self.link)), key=self.length.__getitem__, reverse=True):
            for which, at in ends[s]:
                self.ends[s].setdefault(which, []).append(at)
            ends[self.link[s]] += ends[s]
        # Phrases that end where a state is reached with this many words at least.
        of: dict[int, list[tuple[int, int]]] = {}
        for i, (_, seq) in enumerate(self.phrases):
            s = 0
            for w in seq:
                s = self.next[s][self.number[w]]
            of.setdefault(s, []).append((i, len(seq)))
        self.found: list[list[tuple[int, int]]] = []
        for s in range(len(self.link)):
            got, up = list(of.get(s, [])), self.link[s]
            while up > 0:
                got += of.get(up, [])
                up = self.link[up]
            self.found.append(got)

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.next.append(nxt)
        self.link.append(link)
        self.length.append(length)
        return len(self.link) - 1

    def _copy(self, p: int, c: int, q: int) -> int:
        """The part of state q that is one word longer than p, as a state of its own."""
        copy = self._new(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def _add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._copy(last, c, q)
        new, p = self._new(self.length[last] + 1, {}, 0), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._copy(p, c, q)
        return new

    def scan(self, seq: list[bytes]) -> tuple[list[dict], list[dict]]:
        """Phrases and spans of a text. Stretches of words that no template has are passed over at once."""
        known = np.fromiter(map(self.number.get, seq, [-1] * len(seq)), np.int32, len(seq))
        inside = np.flatnonzero(known >= 0)
        if not len(inside):
            return [], []
        cuts = np.flatnonzero(np.diff(inside) > 1) + 1
        phrases: list[dict] = []
        runs: dict[int, list[tuple[int, int, int]]] = {}  # by template: first word in the text and in it, words
        shortest = min([LONG, *(len(t) for _, t in self.templates), *(len(t) for _, t in self.phrases)])
        for a, b in zip(np.concatenate([[0], cuts]).tolist(), np.concatenate([cuts, [len(inside)]]).tolist(), strict=True):
            first = int(inside[a])
            if b - a < shortest:
                continue
            state = size = 0
            stretch = known[first : first + b - a].tolist()
            for i, (c, ahead) in enumerate(zip(stretch, [*stretch[1:], -1], strict=True), first):
                if c not in self.next[state]:
                    while state and c not in self.next[state]:
                        state = self.link[state]
                    size = self.length[state]
                state = self.next[state].get(c, 0)
                size = size + 1 if state else 0
                for which, least in self.found[state]:
                    if size >= least:
                        phrases.append({"label": self.phrases[which][0], "start": i + 1 - least})
                if size >= shortest:
                    for which, at, n in self.ending(state, size, ahead):
                        runs.setdefault(which, []).append((i + 1 - n, at - n, n))
        spans = [x for which, some in runs.items() for x in self.spans(which, some)]
        return phrases, sorted(spans, key=lambda x: (x["start"], x["end"], x["label"], x["covered"]))

    def ending(self, state: int, size: int, ahead: int) -> Iterator[tuple[int, int, int]]:
        """(template, one past the last word in it, words) of the long runs that end at a word of the text and can't go on with the next one: the longest for each place of a template."""
        seen: set[tuple[int, int]] = set()
        while state > 0:
            n = min(size, self.length[state])
            for which, places in self.ends[state].items():
                t = self.numbers[which]
                if n >= min(LONG, len(t)):
                    for at in places:
                        if (which, at) not in seen:
                            seen.add((which, at))
                            if at == len(t) or t[at] != ahead:
                                yield which, at, n
            state = self.link[state]

    def spans(self, which: int, runs: list[tuple[int, int, int]]) -> list[dict]:
        label, seq = self.templates[which]
        need = 1.0 if len(seq) <= SHORT else COVERED
        return [{"label": label, "start": a, "end": b, "covered": n / len(seq), "named": n / len(seq) >= need} for a, b, n in chains(runs)]


def chains(runs: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(first, one past last word in the text, words covered): the best chain of runs (first word in the text, in the template, words), then the best one of those beside it, and so on.

    A chain goes on in both orders, with GAP words of the text between two of
    its runs at most; words that two runs share count once. Of chains that
    cover as much, the one that begins first is taken, of these the shortest.
    """
    if len(runs) == 1:
        return [(runs[0][0], runs[0][0] + runs[0][2], runs[0][2])]
    runs = sorted(runs)
    i, j, n = (np.array(x, np.int64) for x in zip(*runs, strict=True))
    e, f = i + n, j + n
    covered, start = n.copy(), i.copy()
    alive = np.ones(len(runs), bool)
    far = GAP + int(n.max())

    def compute(k: int, floor: int) -> None:
        """The best chain that ends with run k and begins at floor or later."""
        covered[k], start[k] = n[k], i[k]
        lo, hi = np.searchsorted(i, max(floor, i[k] - far)), np.searchsorted(i, i[k])
        if lo == hi:
            return
        shared = np.maximum(np.maximum(e[lo:hi] - i[k], f[lo:hi] - j[k]), 0)
        ok = alive[lo:hi] & (j[lo:hi] < j[k]) & (f[lo:hi] < f[k]) & (e[lo:hi] < e[k]) & (i[k] - e[lo:hi] <= GAP) & (shared < n[k])
        if ok.any():
            gain = np.where(ok, covered[lo:hi] - shared, -1)
            best = np.flatnonzero(gain == gain.max())
            covered[k], start[k] = n[k] + gain.max(), start[lo:hi][best].max()

    for k in range(len(runs)):
        compute(k, 0)
    heap = [(-int(covered[k]), int(start[k]), int(e[k]), k) for k in range(len(runs))]
    heapq.heapify(heap)
    out = []
    while heap:
        c, a, b, k = heapq.heappop(heap)
        if not alive[k] or (-c, a) != (covered[k], start[k]):
            continue
        out.append((a, b, -c))
        alive &= (e <= a) | (i >= b)
        # Chains that ran across it begin anew behind it.
        for m in np.flatnonzero(alive & (i >= b) & (start < b)).tolist():
            compute(m, b)
            heapq.heappush(heap, (-int(covered[m]), int(start[m]), int(e[m]), m))
    return out


@lru_cache(maxsize=4)
def automaton(templates: tuple, phrases: tuple) -> Automaton:
    return Automaton(templates, phrases)


def scan(docs: DataFrame, *, text: str = "text", templates: tuple = TEMPLATES, phrases: tuple = PHRASES) -> DataFrame:
    """Adds n_words, phrases (label, start) and spans (label, start, end, covered, named) to every row.

    Starts and ends count words from 0; covered is the share of a template's
    words, named whether it suffices for the label. Null and empty texts have no words and empty lists. Texts of any
    length are scanned whole. A run that stands in several templates counts for
    each. Rows are independent, so repeated rows have equal results and an empty
    table gives an empty one. Input columns named as an added one are replaced.
    """

    @F.pandas_udf(RESULT)
    def of(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        a = automaton(templates, phrases)
        for texts in batches:
            rows = [(len(seq), *a.scan(seq)) for seq in map(words, texts)]
            yield pd.DataFrame(rows, columns=["n_words", "phrases", "spans"])

    found = without(docs, *ADDED).withColumn("__found", of(F.col(text)))
    return found.select("*", *[F.col(f"__found.{c}").alias(c) for c in ADDED]).drop("__found")


def labels_of(*arrays: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.concat(*arrays))), ",")


def summary(scanned: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row of counts and labels for each scanned row; phrases and spans that cover COVERED of a template, or all of one of SHORT words or fewer, give labels, and score is the largest share covered."""
    starts, base = F.col("phrases.start"), F.col("phrases.label")
    own = F.transform(F.filter("spans", lambda s: s["named"]), lambda s: s["label"])
    covered = F.coalesce(F.array_max(F.col("spans.covered")), F.lit(0.0))
    return scanned.select(
        key,
        "n_words",
        F.size("phrases").cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        labels_of(base).alias("base_labels"),
        labels_of(base, own).alias("labels"),
        F.when(F.size("phrases") > 0, 1.0).otherwise(F.least(covered, F.lit(1.0))).alias("score"),
    )
