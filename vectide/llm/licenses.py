"""License scans: MinHash bands over overlapping text windows retrieve templates, exact containment verifies them.

Templates are grouped into tiers by their number of five-word shingles: tier S holds those of S/2 < T <= S. A
document is cut into windows of 2S shingles, one every S, so a template's place lies wholly in one of them. A
window that holds a share of at least ``contained`` of a template's shingles has a Jaccard similarity of at least j with it,
j following from T and S alone; a tier has as many bands of one row as make 1 - (1 - j)^bands at least
``probability``. For a template of one shingle, windows of one shingle and one band make the collision certain. What
a band retrieves is then compared shingle by shingle, as words: runs of a template's shingles in its own order are its copies.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, map_texts, shingles, word_hashes, words

#: Sentences and paragraphs by which public licenses are known.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "MIT": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright "
        "notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE '
        "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
        "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
        "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance '
        "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
        "required by applicable law or agreed to in writing, software distributed under the License is distributed on an "
        '"AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the '
        "specific language governing permissions and limitations under the License.",
    ),
    "GPL-2.0": (
        "licensed under the GNU General Public License, version 2",
        "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any "
        "later version.",
    ),
    "GPL-3.0": (
        "licensed under the GNU General Public License, version 3",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
        "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
        "later version.",
    ),
    "LGPL-3.0": ("licensed under the GNU Lesser General Public License, version 3",),
    "AGPL-3.0": ("licensed under the GNU Affero General Public License, version 3",),
    "BSD": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer.",
    ),
    "BSD-3-Clause": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of "
        "conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
        "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
        "distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or "
        "promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY "
        'THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
        "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE "
        "COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
        "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR "
        "BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT "
        "(INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE "
        "POSSIBILITY OF SUCH DAMAGE.",
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
        "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    "Unlicense": ("This is free and unencumbered software released into the public domain.",),
    "CC-BY-4.0": ("licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0",),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0",),
}

_WORDS = 5
_RESULT = "matches array<struct<license:string,template:int,start:int,end:int,contained:double>>"


def bands_needed(low: float, probability: float) -> int:
    """Bands of one row that make a collision at Jaccard similarity ``low`` at least so probable."""
    return 1 if low >= 1 else max(1, math.ceil(math.log(1 - probability) / math.log(1 - low)))


class _Index:
    def __init__(self, templates: dict[str, tuple[str, ...]], contained: float, probability: float):
        self.items: list[tuple[str, int, dict[bytes, list[int]]]] = []  # license, number, places of each shingle
        tiers: dict[int, list[int]] = defaultdict(list)
        hashed = []
        for name in sorted(templates):
            for k, text in enumerate(templates[name]):
                w = words(text)
                if len(w) < _WORDS:
                    raise ValueError(f"{name}: a template needs {_WORDS} words or more")
                own = defaultdict(list)
                for i in range(len(w) - _WORDS + 1):
                    own[b" ".join(w[i : i + _WORDS])].append(i)
                tiers[1 << (len(own) - 1).bit_length()].append(len(self.items))
                self.items.append((name, k, dict(own)))
                hashed.append(np.unique(shingles(word_hashes(text), _WORDS)).astype(np.uint32))
        self.need = [math.ceil(contained * len(own) - 1e-9) for _, _, own in self.items]
        rng = np.random.default_rng(20240101)
        self.tiers: list[tuple[int, int, list[dict[int, list[int]]], np.ndarray]] = []
        most = 1
        for size, members in sorted(tiers.items()):
            low = min(self.need[i] / (2 * size + len(self.items[i][2]) - self.need[i]) for i in members) if size > 1 else 1.0
            self.tiers.append((size, bands_needed(low, probability), members, None))
            most = max(most, self.tiers[-1][1])
        self.odd = rng.integers(0, 1 << 31, most, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, most, dtype=np.uint32)
        self.contained = contained
        for t, (size, bands, members, _) in enumerate(self.tiers):
            table, known = [defaultdict(list) for _ in range(bands)], np.zeros((bands, 1 << 16), dtype=bool)
            for i in members:
                low = self.hashed(hashed[i], bands).min(axis=1)
                for f in range(bands):
                    table[f][int(low[f])].append(i)
                    known[f, low[f] & 0xFFFF] = True
            self.tiers[t] = (size, bands, [dict(x) for x in table], known)

    def hashed(self, sh: np.ndarray, bands: int) -> np.ndarray:
        return sh[None, :] * self.odd[:bands, None] + self.add[:bands, None]

    def candidates(self, sh: np.ndarray) -> set[tuple[int, int, int]]:
        """(first shingle, end, template) of the windows that some band retrieves a template for."""
        found, n = set(), len(sh)
        for size, bands, table, known in self.tiers:
            if size == 1:
                low = self.hashed(sh, 1)
                width = 1
            else:
                blocks = -(-n // size)
                padded = np.full(blocks * size, sh[-1], dtype=np.uint32)
                padded[:n] = sh
                low = self.hashed(padded, bands).reshape(bands, blocks, size).min(axis=2)
                if blocks > 1:
                    low = np.minimum(low[:, :-1], low[:, 1:])
                width = 2 * size
            hit = known[np.arange(low.shape[0])[:, None], low & np.uint32(0xFFFF)]
            for f, w in zip(*np.nonzero(hit), strict=True):
                for i in table[f].get(int(low[f, w]), ()):
                    found.add((int(w) * size, min(n, int(w) * size + width), i))
        return found


def copies_in(shingles_: list[bytes], own: dict[bytes, list[int]], need: int) -> list[tuple[int, int, int]]:
    """(first, last shingle, distinct ones) of each copy of a template in a window that holds at least ``need`` of its shingles.

    A copy's shingles stand in the template's order, with at most a fifth of it (or five words) inserted at one place. If no such run
    holds enough, all of the window's are taken as one, as its parts may have changed places.
    """
    slack = max(_WORDS, len(own) // 5)
    hits = [(p, own[x]) for p, x in enumerate(shingles_) if x in own]
    runs: list[list[tuple[int, bytes]]] = []
    last, place = 0, 0
    for p, places in hits:
        follow = [t for t in places if t > place and p - last <= t - place + slack] if runs else []
        if follow:
            runs[-1].append((p, shingles_[p]))
            place = follow[0]
        else:
            runs.append([(p, shingles_[p])])
            place = places[0]
        last = p
    found = [(r[0][0], r[-1][0], len({x for _, x in r})) for r in runs]
    found = [f for f in found if f[2] >= need]
    if not found and hits and (n := len({shingles_[p] for p, _ in hits})) >= need:
        found = [(hits[0][0], hits[-1][0], n)]
    return found


def scan_licenses(
    docs: DataFrame,
    *,
    text: str = "text",
    templates: dict[str, tuple[str, ...]] | None = None,
    contained: float = 0.8,
    probability: float = 0.9999,
    keep: list[str] | None = None,
) -> DataFrame:
    """(row, res) per document; res.matches lists license, template number, word span [start, end) and containment.

    Every copy of a template is listed. Of overlapping finds of one template that with most of it stays, of equal ones the first, and a match gives way to an
    overlapping one of another license that is contained to a greater share. Null, empty and shorter texts than five
    words have no matches. Every word of a text lies in some window; long texts are taken in overlapping pieces. Repeated rows are scanned one
    by one, an empty table gives no rows, and columns of any name are kept as they are. The
    templates are a parameter held on the driver, so the index that each task builds is bounded by it.
    """
    templates = TEMPLATES if templates is None else templates
    step = 1 << 16

    def make():
        index = _Index(templates, contained, probability)
        reach = 2 * max([size for size, *_ in index.tiers], default=1)

        def scan(t: str | None) -> list[dict]:
            sh = shingles(word_hashes(t), _WORDS).astype(np.uint32)
            found: set[tuple[int, int, int]] = set()
            for a in range(0, len(sh), step) if index.items else ():
                found |= {(a + s, a + e, i) for s, e, i in index.candidates(sh[a : a + step + reach])}
            if not found:
                return []
            w, copies = words(t), defaultdict(set)
            for s, e, i in found:
                window = [b" ".join(w[p : p + _WORDS]) for p in range(s, e)]
                copies[i].update((n, s + first, s + last + _WORDS) for first, last, n in copies_in(window, index.items[i][2], index.need[i]))
            all_ = []
            for i, mine in copies.items():
                name, k, own = index.items[i]
                taken: list[tuple[int, int]] = []
                for n, start, end in sorted(mine, key=lambda c: (-c[0], c[2] - c[1], c[1])):
                    at = bisect_left(taken, (start, end))
                    if (at == 0 or taken[at - 1][1] <= start) and (at == len(taken) or end <= taken[at][0]):
                        taken.insert(at, (start, end))
                        all_.append({"license": name, "template": k, "start": start, "end": end, "contained": n / len(own)})
            kept: list[dict] = []
            for m in sorted(all_, key=lambda m: (-m["contained"], m["start"] - m["end"], m["license"], m["template"])):
                over = (x for x in kept if x["start"] < m["end"] and m["start"] < x["end"])
                if not any(x["license"] != m["license"] and x["contained"] > m["contained"] for x in over):
                    kept.append(m)
            return sorted(kept, key=lambda m: (m["start"], m["license"], m["template"]))

        return lambda data: [{"matches": scan(t)} for t in data["t"]]

    return map_texts(docs, {"t": col(text).cast("string")}, make, _RESULT, keep=keep)


def license_report(docs: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, comma-joined, empty if none), contained (the largest, null if none)."""
    got = scan_licenses(docs, keep=[doc_id], **options)
    return got.select(
        col("row").getField(doc_id).alias("doc_id"),
        F.size("res.matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct("res.matches.license")), ",").alias("licenses"),
        F.array_max("res.matches.contained").alias("contained"),
    )
