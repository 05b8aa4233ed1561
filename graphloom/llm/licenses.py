"""License scans: MinHash bands over overlapping text windows retrieve templates; exact containment verifies.

Templates of like length form a class. Texts are covered by overlapping windows wide enough that any
passage as long as the class's longest template lies whole in one of them. A window is compared with a
template where one of their MinHash bands agrees; as many bands are used as make that probability at
least ``SURE`` for every window that holds ``LEAST`` of a template. What is retrieved is then verified
by counting the template's word shingles in the window, so no match rests on hashes of windows alone.
"""

from __future__ import annotations

import functools
import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import in_arrow
from graphloom.llm.words import groups, shingles, words

#: Words of a shingle. Notices of three words are templates, so shingles are no longer than that.
SHINGLE = 3
#: Part of a template's shingles that a passage must hold, and the probability to retrieve it.
LEAST, SURE = 0.75, 0.9999

_BSD_HEAD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials "
    "provided with the distribution."
)
_BSD_TAIL = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, "
    "EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED "
    "AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED "
    "OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Notices and whole bodies by template: license identifier and text. The licenses' wording.
TEMPLATES = {
    "all-rights-reserved": ("LicenseRef-all-rights-reserved", "All rights reserved"),
    "apache-2.0-notice": ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    "apache-2.0-header": (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. '
        "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ),
    "bsd-conditions": (
        "BSD-3-Clause",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by-nc-4.0-notice": ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    "cc-by-4.0-notice": ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    "cc-by-sa-4.0-notice": ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    "gpl-3.0-notice": ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3"),
    "gpl-3.0-header": (
        "GPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "mit-notice": ("MIT", "Released under the MIT License"),
    "mit-permission": (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "mpl-2.0-notice": ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    "unlicense": ("Unlicense", "This is free and unencumbered software released into the public domain"),
    "lgpl-header": (
        "LGPL-2.1-or-later",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
        "the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    "agpl-3.0-header": (
        "AGPL-3.0-or-later",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
        "the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "cc0-1.0-notice": ("CC0-1.0", "This work is dedicated to the public domain under CC0 1.0 Universal"),
    "cc-by-nc-sa-4.0-notice": ("CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "mit-body": (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
        '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, '
        "distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: "
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, '
        "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
        "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    "isc-body": (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and "
        'this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED '
        "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER "
        "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR "
        "PERFORMANCE OF THIS SOFTWARE.",
    ),
    "bsd-2-clause-body": ("BSD-2-Clause", f"{_BSD_HEAD} {_BSD_TAIL}"),
    "bsd-3-clause-body": (
        "BSD-3-Clause",
        f"{_BSD_HEAD} 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
        f"without specific prior written permission. {_BSD_TAIL}",
    ),
    "zlib-body": (
        "Zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
        "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an "
        "acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as "
        "being the original software. 3. This notice may not be removed or altered from any source distribution.",
    ),
    "unlicense-body": (
        "Unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source "
        "code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this "
        "software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our "
        "heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.",
    ),
}

_SEPARATES = np.ones(256, dtype=bool)
_SEPARATES[128:] = False
_SEPARATES[[*range(48, 58), *range(65, 91), *range(97, 123)]] = False
_words = functools.partial(words, space=_SEPARATES)
_rng = np.random.Generator(np.random.PCG64(31))


def collision(similarity: float, bands: int, rows: int = 1) -> float:
    """Probability that two sets of this Jaccard similarity agree in one of ``bands`` bands of ``rows`` values."""
    return 1 - (1 - similarity**rows) ** bands


@dataclass
class Group:
    """Templates of like length: names, distinct shingles of each, their MinHash values, and window shape."""

    names: list[str]
    sets: list[np.ndarray]
    stride: int  # shingles from one window to the next; a window has three times as many
    multiply: np.ndarray
    least: np.ndarray  # bands x templates


def grouped(templates: dict[str, tuple[str, str]]) -> list[Group]:
    """Templates in classes whose longest is less than twice the shortest."""
    column = pa.array([text for _, text in templates.values()], pa.string())
    sets = []
    for _, data, offsets in groups(pc.utf8_lower(column)):
        hashes, _, _, rows = _words(data, offsets)
        values, whole = shingles(hashes, rows, SHINGLE)
        sets += [(values[a:b][whole[a:b]]) for a, b in zip(rows[:-1], rows[1:], strict=True)]
    classes: dict[int, list[int]] = {}
    for k, s in enumerate(sets):
        if len(s):
            classes.setdefault(int(math.log2(len(s))), []).append(k)
    names, out = list(templates), []
    for own in classes.values():
        longest, shortest = max(len(sets[k]) for k in own), min(len(np.unique(sets[k])) for k in own)
        stride = max(1, -(-longest // 2))
        similarity = LEAST * shortest / (3 * stride + (1 - LEAST) * shortest)
        bands = math.ceil(math.log(1 - SURE) / math.log(1 - similarity))
        multiply = _rng.integers(0, 2**63, bands, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        distinct = [np.unique(sets[k]) for k in own]
        out.append(Group([names[k] for k in own], distinct, stride, multiply, np.stack([[(s * m).min() for s in distinct] for m in multiply])))
    return out


def _candidates(values: np.ndarray, group: Group) -> set[tuple[int, int]]:
    """Windows (by first shingle) and templates that agree in a band."""
    starts = np.arange(0, len(values), group.stride)
    found = set()
    for m, goals in zip(group.multiply, group.least, strict=True):
        block = np.minimum.reduceat(values * m, starts)
        window = block.copy()
        window[:-1] = np.minimum(window[:-1], block[1:])
        window[:-2] = np.minimum(window[:-2], block[2:])
        for at in np.flatnonzero(np.isin(window, goals)).tolist():
            found.update((int(starts[at]), int(k)) for k in np.flatnonzero(goals == window[at]))
    return found


def _held(hits: np.ndarray, values: np.ndarray, least: int, width: int) -> tuple[int, list[list[int]]]:
    """Most distinct ``values`` at ``hits`` in any run of ``width`` positions, and where at least ``least`` are, overlaps merged."""
    most, low, seen, spans = 0, 0, Counter(), []
    at, values = hits.tolist(), values.tolist()
    for k, p in enumerate(at):
        seen[values[k]] += 1
        while at[low] <= p - width:
            seen[values[low]] -= 1
            if not seen[values[low]]:
                del seen[values[low]]
            low += 1
        most = max(most, len(seen))
        if len(seen) >= least:
            if spans and at[low] <= spans[-1][1]:
                spans[-1][1] = p
            else:
                spans.append([at[low], p])
    return most, spans


def _scan(batches: Iterator[pa.RecordBatch], classes: list[Group], licenses: dict[str, str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for first, data, offsets in groups(pc.utf8_lower(pc.fill_null(batch.column("text"), ""))):
            hashes, begin, end, rows = _words(data, offsets)
            values, whole = shingles(hashes, rows, SHINGLE)
            if not len(values):
                continue
            for group in classes:
                # The texts that a retrieved window lies in; a window may run over the end of a text.
                asked = set()
                for at, k in _candidates(values, group):
                    stop = min(len(values), at + 3 * group.stride)
                    asked.update((d, k) for d in range(int(np.searchsorted(rows, at, side="right")) - 1, int(np.searchsorted(rows, stop, side="left"))))
                for d, k in sorted(asked):
                    a, b = int(rows[d]), int(rows[d + 1])
                    hits = a + np.flatnonzero(np.isin(values[a:b], group.sets[k]) & whole[a:b])
                    most, spans = _held(hits, values[hits], math.ceil(LEAST * len(group.sets[k]) - 1e-9), 2 * group.stride)
                    if spans:
                        name = group.names[k]
                        points = [int(np.count_nonzero((data[offsets[d] : p] & 0xC0) != 0x80)) for p in (begin[spans[0][0]], end[spans[0][1] + SHINGLE - 1])]
                        out.append((first + d, licenses[name], name, most / len(group.sets[k]), len(spans), *points))
        if out:
            row, license_id, name, held, many, starts, ends = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(row)), pa.array(license_id), pa.array(name), pa.array(held), pa.array(many, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
                names=["doc_id", "license_id", "template", "containment", "passages", "start", "stop"],
            )


def license_scan(docs: DataFrame, templates: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """License notices in the whole texts of ``docs`` (``doc_id``, ``text``), a row for each document and template.

    Returns ``doc_id``, ``license_id``, ``template``, ``containment`` (the largest part of the template's
    distinct shingles in any run of as many shingles as the longest template of its class has, at least
    ``LEAST``), ``passages`` (separate matches) and ``start``, ``stop`` (code points of the first). A text is
    gone through whole, however long; of templates that match the same place each is reported. Words are runs of ASCII letters, digits and non-ASCII
    characters, lower-cased. Null and empty texts match nothing; rows that repeat each match; rows
    without ``doc_id`` match with a null one; templates of fewer words than a shingle match nothing.
    Other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    classes, licenses = grouped(templates), {name: license_id for name, (license_id, _) in templates.items()}
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return in_arrow(slim, lambda it: _scan(it, classes, licenses), "doc_id long, license_id string, template string, containment double, passages long, start long, stop long")
