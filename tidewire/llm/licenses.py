"""License scans: which license texts a document holds, how much of them, and where.

Templates are cut into word grams; of every WINDOW neighbouring grams the one with
the smallest hash stays (winnowing), and an inverted index leads from these
fingerprints to their templates and places. Every gram of a document is looked up.
A hit names a template and a diagonal, document place less template place. Hits of a
template near one diagonal are one candidate; within a band around its diagonals the
template is aligned with the document (local alignment: a match counts 2, a mismatch
or a gap -1). Matches that cover at least `coverage` of a template's words are reported.

The templates are configuration, bounded by MAX_WORDS words in all, which is checked;
their index goes to every task. Documents are read in one narrow pass, to their end.

Defined results: null and empty texts match nothing; repeated rows are reported each;
overlapping matches of different templates are all reported; a template shorter than
a gram is an error; no templates or no documents give no rows; other columns are
ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame

from tidewire.llm.words import ALNUM_WORD, alnum_words

GRAM = 3
WINDOW = 4
BAND = 6
MAX_WORDS = 200_000
_MEMORY = 300_000

# Notices of common licenses; fixed texts.
TEMPLATES = {
    "MIT-notice": "Released under the MIT License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
        and associated documentation files (the "Software"), to deal in the Software without restriction, including
        without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies
        of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following
        conditions: The above copyright notice and this permission notice shall be included in all copies or
        substantial portions of the Software.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted
        provided that the following conditions are met: 1. Redistributions of source code must retain the above
        copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must
        reproduce the above copyright notice, this list of conditions and the following disclaimer in the
        documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright
        holder nor the names of its contributors may be used to endorse or promote products derived from this software
        without specific prior written permission.""",
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except
        in compliance with the License. You may obtain a copy of the License at
        http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software
        distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
        KIND, either express or implied. See the License for the specific language governing permissions and
        limitations under the License.""",
    "GPL-3.0-or-later": """This program is free software: you can redistribute it and/or modify it under the terms of
        the GNU General Public License as published by the Free Software Foundation, either version 3 of the License,
        or (at your option) any later version. This program is distributed in the hope that it will be useful, but
        WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
        PURPOSE. See the GNU General Public License for more details.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
        hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of
        the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
}


@dataclass(frozen=True)
class Match:
    template: str
    matched: int
    words: int
    first: int
    last: int


class _Hashes(dict):
    """Word: its hash. Bounded; nothing is cut."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > _MEMORY:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word, 11)
        return value


def _grams(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of `size` neighbouring words."""
    n = len(words) - size + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(size if n > 0 else 0):
        out = out * np.uint64(0x9E3779B97F4A7C15) + words[k : k + n]
    return out ^ (out >> np.uint64(31))


def winnow(grams: np.ndarray, window: int) -> list[int]:
    """Places of the smallest hash, the last of equals, in every window."""
    kept: list[int] = []
    for at in range(max(1, len(grams) - window + 1)):
        some = grams[at : at + window]
        best = at + len(some) - 1 - int(some[::-1].argmin())
        if not kept or kept[-1] != best:
            kept.append(best)
    return kept


class Index:
    """The winnowed fingerprints of templates, and where in which template they are."""

    def __init__(self, templates: dict[str, str], gram: int = GRAM, window: int = WINDOW):
        self.gram, self.names = gram, sorted(templates)
        self.words = [alnum_words(templates[n]) for n in self.names]
        if sum(map(len, self.words)) > MAX_WORDS:
            raise ValueError(f"templates of over {MAX_WORDS} words; scan with parts of them")
        if short := [n for n, w in zip(self.names, self.words) if len(w) < gram]:
            raise ValueError(f"templates of under {gram} words: {short}")
        hashes = _Hashes()
        places: dict[int, list[tuple[int, int]]] = {}
        for t, words in enumerate(self.words):
            grams = _grams(np.array([hashes[w] for w in words], np.uint64), gram)
            for at in winnow(grams, window):
                places.setdefault(int(grams[at]), []).append((t, at))
        self.keys = np.array(sorted(places), np.uint64)
        self.places = [places[int(k)] for k in self.keys]

    def candidates(self, hashes: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, lowest and highest diagonal) of hits near each other."""
        grams = _grams(hashes, self.gram)
        if not len(grams) or not len(self.keys):
            return []
        at = np.searchsorted(self.keys, grams)
        at[at == len(self.keys)] = 0
        hits = np.flatnonzero(self.keys[at] == grams)
        found = sorted({(t, int(p) - place) for p in hits for t, place in self.places[at[p]]})
        out: list[tuple[int, int, int]] = []
        for t, diagonal in found:
            if out and out[-1][0] == t and diagonal - out[-1][2] <= BAND and diagonal - out[-1][1] <= 4 * BAND:
                out[-1] = (t, out[-1][1], diagonal)
            else:
                out.append((t, diagonal, diagonal))
        return out

    def scan(self, words: list[bytes], hashes: np.ndarray, coverage: float) -> list[Match]:
        """The best of overlapping matches of each template."""
        out: list[Match] = []
        for t, low, high in self.candidates(hashes):
            matched, first, last = align(self.words[t], words, low - BAND, high + BAND)
            if matched >= coverage * len(self.words[t]):
                out.append(Match(self.names[t], matched, len(self.words[t]), first, last))
        kept: list[Match] = []
        taken: dict[str, list[tuple[int, int]]] = {}  # per template the words of its matches so far, ascending and apart
        for m in sorted(out, key=lambda m: (m.template, -m.matched, m.first, m.last)):
            spans = taken.setdefault(m.template, [])
            at = bisect_left(spans, (m.first, m.last))
            free = (at == 0 or spans[at - 1][1] < m.first) and (at == len(spans) or m.last < spans[at][0])
            if free:
                spans.insert(at, (m.first, m.last))
                kept.append(m)
        return sorted(kept, key=lambda m: (m.first, m.last, m.template))


def align(template: list[bytes], words: list[bytes], low: int, high: int) -> tuple[int, int, int]:
    """Best local alignment with document words within the diagonals low to high:
    matched words, first and last word of the document (ties: the earliest)."""
    width = high - low + 1
    empty = (0, 0, 0, -1)  # score, matched, first, last
    above = [empty] * (width + 1)
    best = empty
    for i, word in enumerate(template):
        here = [empty] * (width + 1)
        for k in range(width):
            j = i + low + k
            if not 0 <= j < len(words):
                continue
            score, matched, first, last = above[k]
            if words[j] == word:
                cell = (score + 2, matched + 1, first if score else j, j)
            else:
                cell = (score - 1, matched, first, last)
                for other in (above[k + 1], here[k - 1] if k else empty):
                    if other[0] - 1 > cell[0]:
                        cell = (other[0] - 1, *other[1:])
                if cell[0] <= 0:
                    cell = empty
            here[k] = cell
            if cell[0] > best[0]:
                best = cell
        above = here
    return best[1], best[2], best[3]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8) -> DataFrame:
    """(doc_id, template, matched, words, coverage, start, end) per match; start and
    end are code points of the text, the end exclusive."""
    held = docs.sparkSession.sparkContext.broadcast(Index(TEMPLATES if templates is None else templates))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, known = held.value, _Hashes()
        for batch in batches:
            rows, found, spans = [], [], []
            for r, text in enumerate(batch.column("text").to_pylist()):
                words = alnum_words(text)
                hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                if matches := index.scan(words, hashes, coverage):
                    places = [m.span() for m in ALNUM_WORD.finditer(text)]
                    rows += [r] * len(matches)
                    found += matches
                    spans += [(places[m.first][0], places[m.last][1]) for m in matches]
            yield pa.RecordBatch.from_pydict({
                "doc_id": batch.column("doc_id").take(pa.array(rows, pa.int64())),
                "template": pa.array([m.template for m in found], pa.string()),
                "matched": pa.array([m.matched for m in found], pa.int64()),
                "words": pa.array([m.words for m in found], pa.int64()),
                "coverage": pa.array([m.matched / m.words for m in found], pa.float64()),
                "start": pa.array([s for s, _ in spans], pa.int64()),
                "end": pa.array([e for _, e in spans], pa.int64()),
            })

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, template string, matched long, words long, coverage double, start long, end long")
