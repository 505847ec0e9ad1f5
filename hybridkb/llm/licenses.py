"""License scans: normalised text against licence templates by the Dice coefficient over word bigrams.

Text is normalised to lower-case words (runs of letters, digits and non-ASCII characters). Each line, each
block of lines between blank lines, and each whole document is compared with the templates by
2 * |A & B| / (|A| + |B|) over bags of word bigrams. A score of t needs |A & B| >= t / (2 - t) * |A| and sizes
within t / (2 - t) and (2 - t) / t of each other, so most texts go after one lookup of their bigrams, and of
the templates only those of a fitting size are scored.

Templates are a small table by nature (at most MAX_TEMPLATES, else an error) and are sent to every worker.
Null text counts as empty, texts of one word have no bigram, and neither matches. Repeated rows are reported
once each. Very long texts are read whole. Empty tables give empty reports; other columns are ignored.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hybridkb.llm.common import ASCII_LOWER, field_hash, separators, shingle_hashes, slices_by_bytes, field_span, text_buffers, word_spans

WORD_SEPARATORS = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))
NEWLINE = separators((0x0A, 0x0A))
SPACE = separators((0x20, 0x20), (0x09, 0x0D))
CHUNK = 2 << 20
MAX_TEMPLATES = 10_000

# Notices and openings of common licences.
TEMPLATES = {
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-notice": "Released under the MIT License.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0-notice": "Licensed under CC BY-SA 4.0.",
    "CC-BY-NC-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "CC0-1.0-notice": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "Unlicense": "This is free and unencumbered software released into the public domain.",
    "All-rights-reserved": "All rights reserved.",
}

# Whole licence texts by paragraph, without their copyright lines.
_MIT = [
    TEMPLATES["MIT"][: TEMPLATES["MIT"].index("The above")].strip(),
    TEMPLATES["MIT"][TEMPLATES["MIT"].index("The above") :],
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
]
_ISC = [
    TEMPLATES["ISC"],
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
]
_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY = TEMPLATES["BSD-2-Clause"].replace(": Redistributions", ":\0Redistributions").replace(". Redistributions", ".\0Redistributions").split("\0")
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
TEMPLATES |= {
    "MIT-text": " ".join(_MIT),
    "MIT-permission": _MIT[0],
    "MIT-condition": _MIT[1],
    "MIT-disclaimer": _MIT[2],
    "ISC-text": " ".join(_ISC),
    "ISC-disclaimer": _ISC[1],
    "BSD-2-Clause-text": " ".join([_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_END]),
    "BSD-3-Clause-text": " ".join([_BSD_HEAD, _BSD_SOURCE, _BSD_BINARY, _BSD_NAMES, _BSD_END]),
    "BSD-conditions": _BSD_HEAD,
    "BSD-source-condition": _BSD_SOURCE,
    "BSD-binary-condition": _BSD_BINARY,
    "BSD-3-Clause-names": _BSD_NAMES,
    "BSD-disclaimer": _BSD_END,
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
}


def _bigrams(data: np.ndarray, offsets: np.ndarray):
    """Places (bytes) of the bigrams' first and second words, and their hashes; none across a text's end."""
    lower = ASCII_LOWER[data]
    s, e, first = word_spans(lower, offsets, WORD_SEPARATORS)
    h = shingle_hashes(field_span(field_hash(lower), s, e), 2)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    same = doc[1:] == doc[:-1] if len(doc) > 1 else np.zeros(0, bool)
    return s[:-1][same], s[1:][same], h[same]


def _units(data: np.ndarray, offsets: np.ndarray) -> list[tuple[str, np.ndarray, np.ndarray]]:
    """('line' | 'block' | 'text', starts, stops) in bytes."""
    s, e, _ = word_spans(data, offsets, NEWLINE)
    w, _, _ = word_spans(data, offsets, SPACE)
    filled = np.searchsorted(w, e) > np.searchsorted(w, s)
    doc = np.searchsorted(offsets, s, side="right")
    # A block begins with the first filled line of a text or after a line without words; lines that are
    # wholly empty are not in s, so a gap of more than one newline ends a block too.
    gap = np.ones(len(s), dtype=bool)
    gap[1:] = (doc[1:] != doc[:-1]) | (s[1:] - e[:-1] > 1) | ~filled[:-1]
    s, e, gap = s[filled], e[filled], gap[filled]
    at = np.flatnonzero(gap)
    stops = e[np.concatenate((at[1:], [len(s)])) - 1] if len(s) else e
    return [("line", s, e), ("block", s[at], stops), ("text", offsets[:-1], offsets[1:])]


def license_matches(documents: DataFrame, templates: DataFrame | dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """doc_id, matches: an array of (license_id, unit, start, dice) for every document; start is the byte
    where the unit begins. The same place is reported for its smallest unit only."""
    if isinstance(templates, DataFrame):
        rows = templates.select("license_id", "text").limit(MAX_TEMPLATES + 1).collect()
        if len(rows) > MAX_TEMPLATES:
            raise ValueError(f"more than {MAX_TEMPLATES} templates")
        templates = {r[0]: r[1] for r in rows if r[0] is not None and r[1]}
    templates = TEMPLATES if templates is None else templates
    bags = []
    for name, text in sorted(templates.items()):
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        bag = Counter(_bigrams(raw, np.array([0, len(raw)]))[2].tolist())
        if bag:
            bags.append((name, sum(bag.values()), bag))
    bags.sort(key=lambda x: x[1])
    known = np.unique(np.array([h for _, _, b in bags for h in b], dtype=np.uint64))
    shared = documents.sparkSession.sparkContext.broadcast((bags, known))
    ratio = threshold / (2 - threshold)

    def scan(batches):
        bags, known = shared.value
        sizes = [n for _, n, _ in bags]
        for whole in batches:
            for at, n in slices_by_bytes(whole.column(1), CHUNK):
                data, offs = text_buffers(whole.column(1).slice(at, n))
                place, second, h = _bigrams(data, offs)
                where = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
                hits = np.concatenate(([0], np.cumsum(known[where] == h))) if len(known) else np.zeros(len(h) + 1, np.int64)
                out: list[list] = [[] for _ in range(n)]
                taken = set()
                for unit, starts, stops in _units(data, offs):
                    a, b = np.searchsorted(place, starts), np.searchsorted(second, stops)
                    size = np.maximum(b - a, 0)
                    for i in np.flatnonzero((size > 0) & (hits[np.maximum(a, b)] - hits[a] >= ratio * size)).tolist():
                        bag, total = Counter(h[a[i] : b[i]].tolist()), int(size[i])
                        lo, hi = np.searchsorted(sizes, [ratio * total - 1e-9, total / ratio + 1e-9])
                        doc = int(np.searchsorted(offs, starts[i], side="right")) - 1
                        for name, m, template in bags[lo:hi]:
                            dice = 2 * sum(min(c, template[g]) for g, c in bag.items() if g in template) / (total + m)
                            begin = int(starts[i] - offs[doc])
                            if dice >= threshold and (name, int(place[a[i]])) not in taken:
                                taken.add((name, int(place[a[i]])))
                                out[doc].append({"license_id": name, "unit": unit, "start": begin, "dice": dice})
                kind = pa.list_(pa.struct([("license_id", pa.string()), ("unit", pa.string()), ("start", pa.int64()), ("dice", pa.float64())]))
                yield pa.RecordBatch.from_arrays([whole.column(0).slice(at, n), pa.array(out, type=kind)], names=["doc_id", "matches"])

    docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    return docs.mapInArrow(scan, "doc_id bigint, matches array<struct<license_id:string,unit:string,start:bigint,dice:double>>")


def scan_licenses(documents: DataFrame, templates: DataFrame | dict[str, str] | None = None, threshold: float = 0.9) -> DataFrame:
    """doc_id, n_matches, licenses (sorted, different), best_license, best_dice for every document."""
    m = license_matches(documents, templates, threshold)
    best = F.array_max(F.transform("matches", lambda x: F.struct(x["dice"].alias("d"), x["license_id"].alias("l"))))
    return m.select(
        "doc_id",
        F.size("matches").alias("n_matches"),
        F.array_sort(F.array_distinct("matches.license_id")).alias("licenses"),
        best["l"].alias("best_license"),
        best["d"].alias("best_dice"),
    )
