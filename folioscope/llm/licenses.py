"""License scans: winnowed template fingerprints in an inverted index, then banded alignment of the candidates.

Templates are cut into k-grams; of each ``w`` neighbours the smallest hash is kept, in an inverted index from hash to
(template, position).  Document windows that select an indexed hash are candidates: each hit names a template and a
diagonal, and hits of one template on near diagonals are one candidate place.  There the template is
aligned with the document's words in a band around the diagonal (matches, substitutions, gaps); the report has the
share of template words matched and the span in the document.  Hashes only find places: the alignment compares the
words themselves.  A place counts from ``coverage`` on.

Any shared run of ``k + w - 1`` words is found.  Templates are a parameter of fixed size, held by every task.

Defined cases: null and wordless texts have no licenses; templates without words are ignored, templates shorter than k
words are indexed whole; of overlapping places of one template the best is reported; repeated rows give repeated
results; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, column, utf8
from .wordops import ALNUM, HashSet, Words, grams, tokenize, window_min

K, W = 3, 2
COVERAGE, SLACK = 0.8, 8

#: Fixed texts: public license notices as commonly written.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "AGPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so",
    "CC0-1.0-line": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "EPL-2.0-notice": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "LGPL-3.0-notice": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "MIT-line": "Released under the MIT License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "reserved": "All rights reserved.",
}


class Templates:
    def __init__(self, texts: dict[str, str], k: int = K, w: int = W):
        self.k, self.w = k, w
        self.names, self.words, self.codes = [], [], []
        self.index: dict[int, list[tuple[int, int]]] = {}
        self.short: dict[int, dict[int, list[tuple[int, int]]]] = {}
        for name, text in sorted(texts.items()):
            t = tokenize([text.encode()], ALNUM)
            h = t.hashes()
            if not len(h):
                continue
            i = len(self.names)
            self.names.append(name)
            codes: dict[bytes, int] = {}
            self.codes.append(codes)
            self.words.append(np.array([codes.setdefault(t.text(p, p + 1), len(codes)) for p in range(len(h))]))
            size = min(k, len(h))
            g = grams(h, size)
            if len(g) < w:
                for p, x in enumerate(g.tolist()):
                    self.short.setdefault(size, {}).setdefault(x, []).append((i, p))
            else:
                least = window_min(g, w)
                for p in sorted({s + int(np.argmin(g[s : s + w])) for s in range(len(least))}):
                    self.index.setdefault(int(g[p]), []).append((i, p))
        self.known = HashSet(np.array(list(self.index), dtype=np.uint64))
        self.known_short = {n: HashSet(np.array(list(x), dtype=np.uint64)) for n, x in self.short.items()}


def align(template: np.ndarray, text: np.ndarray, offset: int, band: int) -> tuple[int, int, int]:
    """(matches, first, last + 1 in text) of the best banded alignment; template word i is near text word i + offset.

    Score: 2 a match, -1 a substitution or gap; text before and after the alignment is free.
    """
    n, width = len(template), 2 * band + 1
    low = -(10**6)
    score, match, begin = np.zeros(width, int), np.zeros(width, int), np.arange(width) + offset - band
    for i in range(n):
        j = i + offset - band + np.arange(width)  # text word of each cell
        inside = (j >= 0) & (j < len(text))
        same = np.zeros(width, dtype=bool)
        same[inside] = text[j[inside]] == template[i]
        new = np.where(inside, score + np.where(same, 2, -1), low)
        new_match, new_begin = match + same, begin.copy()
        skip = np.append(score[1:], low) - 1  # template word without a text word
        better = skip > new
        new = np.where(better, skip, new)
        new_match = np.where(better, np.append(match[1:], 0), new_match)
        new_begin = np.where(better, np.append(begin[1:], 0), new_begin)
        for b in range(1, width):  # text word without a template word
            if new[b - 1] - 1 > new[b] and inside[b]:
                new[b], new_match[b], new_begin[b] = new[b - 1] - 1, new_match[b - 1], new_begin[b - 1]
        score, match, begin = new, new_match, new_begin
    best = int(np.argmax(score))
    return int(match[best]), int(max(begin[best], 0)), int(min(max(n + offset - band + best, 0), len(text)))


def places(words: Words, h: np.ndarray, known: Templates, *, coverage: float = COVERAGE, slack: int = SLACK) -> dict[int, list[tuple[int, int, int, float]]]:
    """{text: [(template, first word, last word + 1, matched share)]} of a chunk."""
    hits: dict[tuple[int, int], set[int]] = {}

    def note(at: int, size: int, owners) -> None:
        d = int(words.doc[at])
        if words.doc[at + size - 1] == d:
            for t, p in owners:
                hits.setdefault((d, t), set()).add(at - int(words.first[d]) - p)

    k, w = known.k, known.w
    g = grams(h, k)
    if len(g):
        for at in known.known.find(g).tolist():
            note(at, k, known.index[int(g[at])])
    for n, member in known.known_short.items():
        g = grams(h, n)
        for at in member.find(g).tolist():
            note(at, n, known.short[n][int(g[at])])
    out: dict[int, list[tuple[int, int, int, float]]] = {}
    for (d, t), diagonals in sorted(hits.items()):
        a, b = int(words.first[d]), int(words.first[d + 1])
        template, found, last = known.words[t], [], None
        band = slack + len(template) // 10 if len(template) > 2 * slack else max(1, len(template) // 3)
        for offset in sorted(diagonals):
            if last is not None and offset - last <= band // 2:
                continue  # the band around the last diagonal covers it
            last = offset
            low, high = max(0, offset - band), max(0, min(b - a, offset + len(template) + band))  # what the band reaches
            region = np.array([known.codes[t].get(words.text(a + p, a + p + 1), -1) for p in range(low, high)], dtype=np.int64)
            m, s, e = align(template, region, offset - low, band)
            s, e = s + low, e + low
            if m >= coverage * len(template):
                found.append((m / len(template), s, e))
        chosen: list[tuple[int, int, int, float]] = []
        end = -1
        for share, s, e in sorted(found, key=lambda x: (x[1], -x[0])):
            if s < end and chosen and share > chosen[-1][3]:
                chosen[-1] = (t, s, e, share)
                end = e
            elif s >= end:
                chosen.append((t, s, e, share))
                end = e
        if chosen:
            out.setdefault(d, []).extend(chosen)
    return out


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, *, coverage: float = COVERAGE) -> DataFrame:
    """Per document: doc_id, n_words, n_matches, licenses (sorted names), matched_words (union of spans), spans (name, start, stop, coverage)."""
    known = docs.sparkSession.sparkContext.broadcast(Templates(templates or TEMPLATES))
    kind = docs.schema["doc_id"].dataType.simpleString()
    span = pa.struct([("name", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("coverage", pa.float64())])

    def run(batches):
        table = known.value
        for batch in batches:
            ids = column(batch, "doc_id")
            for start, texts in chunks(utf8(column(batch, "text"))):
                words = tokenize(texts, ALNUM)
                found = places(words, words.hashes(), table, coverage=coverage)
                every = [sorted(found.get(i, []), key=lambda x: (x[1], x[0])) for i in range(len(texts))]
                covered = [len({p for _, s, e, _ in x for p in range(s, e)}) for x in every]
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(start, len(texts)), pa.array(words.counts(), pa.int64()), pa.array([len(x) for x in every], pa.int64()),
                        pa.array([sorted({table.names[t] for t, *_ in x}) for x in every], pa.list_(pa.string())), pa.array(covered, pa.int64()),
                        pa.array([[{"name": table.names[t], "start": s, "stop": e, "coverage": c} for t, s, e, c in x] for x in every], pa.list_(span)),
                    ],
                    ["doc_id", "n_words", "n_matches", "licenses", "matched_words", "spans"],
                )

    return docs.select("doc_id", "text").mapInArrow(
        run, f"doc_id {kind}, n_words long, n_matches long, licenses array<string>, matched_words long, spans array<struct<name: string, start: long, stop: long, coverage: double>>"
    )
