"""Licence scans: units of a text compared to licence templates by the Dice coefficient.

A text is scanned in units: the whole text, its paragraphs (between blank lines) and its lines.
Unit and template are normalised to words (runs of letters, digits and anything beyond ASCII; A-Z
lowered) and compared as sets of word bigrams: 2 |A and B| / (|A| + |B|), a match from `DICE` on.
A template is also compared paragraph by paragraph, so that a licence inside a longer document is
found. Sizes prune first: two sets can only reach the coefficient t if the smaller has at least
t / (2 - t) times as many bigrams as the larger, and units of other sizes never meet a template.

Only bigrams that some template has are looked at further, so a scan costs one pass over the words
and one look-up for each. The templates are a list that the caller gives, held in memory.

Defined cases: null and empty texts, and units of fewer than two words, match nothing; a unit that
matches several templates takes the best one, the first in the list among equals; a paragraph or
text of a single line is scanned as that line; other columns pass through under any name.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from moundlens.llm.common import numbered, pick, read_table
from moundlens.llm.words import ALPHANUMERIC, LOWER, texts, window_starts, windows, words

DICE = (9, 10)
LEAST = 5  # bigrams of a template's paragraph that is compared by itself

# Published licence texts and the notices by which they are usually named.
TEMPLATES: list[tuple[str, str]] = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    (
        "MIT",
        """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    ),
    (
        "ISC",
        """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    ),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    (
        "GPL-3.0-or-later",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""",
    ),
    (
        "BSD-2-Clause",
        """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.""",
    ),
]

_MATCH = T.StructType(
    [
        T.StructField("license", T.StringType()),
        T.StructField("unit", T.StringType()),  # text, paragraph or line
        T.StructField("line", T.IntegerType()),  # first line of the unit, from 0
        T.StructField("shared", T.IntegerType()),  # bigrams in both
        T.StructField("size", T.IntegerType()),  # bigrams of the unit and of the template together
    ]
)
FOUND = [T.StructField("matches", T.ArrayType(_MATCH))]


def bigrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(unit, digest) of the distinct word bigrams of every unit."""
    found = words(LOWER[data], offsets, ALPHANUMERIC)
    starts = window_starts(found.first, 2)
    digest = windows(found.digest, 2)[starts]
    unit = np.searchsorted(found.first, starts, side="right") - 1
    order = np.lexsort((digest, unit))
    digest, unit = digest[order], unit[order]
    new = np.r_[True, (digest[1:] != digest[:-1]) | (unit[1:] != unit[:-1])][: len(unit)]
    return unit[new], digest[new]


class Templates:
    """Bigram sets of all templates and their paragraphs, and which of them have each bigram."""

    def __init__(self, listed: Sequence[tuple[str, str]]):
        parts = [(name, text) for name, text in listed]
        for name, text in listed:
            parts += [(name, p) for p in text.split("\n\n")] if "\n\n" in text else []
        self.names = [name for name, _ in parts]
        unit, digest = bigrams(*texts(pa.array([text for _, text in parts], pa.large_string())))
        self.size = np.bincount(unit, minlength=len(parts))
        usable = self.size >= np.where(np.arange(len(parts)) < len(listed), 1, LEAST)
        unit, digest = unit[usable[unit]], digest[usable[unit]]
        order = np.argsort(digest, kind="stable")
        self.digest, self.of = digest[order], unit[order]
        sizes = self.size[usable]
        top, bottom = DICE
        self.least = int(sizes.min()) * top // (2 * bottom - top) if len(sizes) else 1
        self.most = -(-int(sizes.max()) * (2 * bottom - top) // top) if len(sizes) else 0

    def match(self, unit: np.ndarray, digest: np.ndarray, units: int) -> Iterator[tuple[int, int, int]]:
        """(unit, template, shared bigrams) of the best template of every matching unit."""
        size = np.bincount(unit, minlength=units)
        fits = (size >= max(1, self.least)) & (size <= self.most)
        some = fits[unit]
        unit, digest = unit[some], digest[some]
        lo = np.searchsorted(self.digest, digest, side="left")
        n = np.searchsorted(self.digest, digest, side="right") - lo
        unit = np.repeat(unit, n)
        template = self.of[np.arange(len(unit)) + np.repeat(lo - np.cumsum(n) + n, n)]
        top, bottom = DICE
        a, b = size[unit], self.size[template]
        near = (a * top <= b * (2 * bottom - top)) & (b * top <= a * (2 * bottom - top))
        key, shared = np.unique(unit[near] * len(self.names) + template[near], return_counts=True)
        unit, template = key // len(self.names), key % len(self.names)
        both = size[unit] + self.size[template]
        good = 2 * shared * bottom >= top * both
        unit, template, shared, both = (x[good] for x in (unit, template, shared, both))
        order = np.lexsort((template, -shared / both, unit))
        unit, template, shared = unit[order], template[order], shared[order]
        first = np.r_[True, unit[1:] != unit[:-1]][: len(unit)]
        for u, t, s in zip(unit[first].tolist(), template[first].tolist(), shared[first].tolist(), strict=True):
            yield u, t, s


def _units(column: pa.Array) -> Iterator[tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(kind, data, offsets, row, first line) for lines, paragraphs and whole texts."""
    data, offsets = texts(column)
    breaks = np.flatnonzero(data == 10)
    start = np.sort(np.r_[offsets[:-1], breaks + 1])
    first = np.searchsorted(breaks, offsets) + np.arange(len(offsets))  # first line of each row
    row = np.searchsorted(first, np.arange(len(start)), side="right") - 1
    line = np.arange(len(start)) - first[row]
    yield "line", data, np.r_[start, len(data)], row, line
    # a paragraph begins with its row and after an empty line
    end = np.r_[start[1:], len(data)]
    size = end - start - np.r_[row[1:] == row[:-1], False][: len(row)]  # without the line break
    empty = size <= 0
    begins = (line == 0) | np.r_[False, empty[:-1]][: len(empty)]
    at = np.flatnonzero(begins)
    several = np.diff(np.r_[at, len(start)]) > 1
    yield from _chosen("paragraph", data, np.r_[start[at], len(data)], row[at], line[at], several)
    whole = (np.diff(first) > 1) & (np.bincount(row[at], minlength=len(first) - 1) > 1)
    yield from _chosen("text", data, offsets, np.arange(len(first) - 1), np.zeros(len(first) - 1, int), whole)


def _chosen(kind, data, offsets, row, line, keep):
    """The units marked in `keep`; the bytes of the others are left out."""
    if keep.any():
        size = np.diff(offsets)
        inside = np.repeat(keep, size)
        yield kind, data[inside], np.r_[0, np.cumsum(size[keep])], row[keep], line[keep]


def scan(docs: DataFrame, text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """The documents' columns, then the matches by first line (the last column by position)."""
    at, names = docs.columns.index(text_col), [*docs.columns, *(f.name for f in FOUND)]
    docs = numbered(docs)
    schema = T.StructType([*docs.schema.fields, *FOUND])
    arrow = to_arrow_schema(schema)
    known = Templates(templates)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: list[list[dict]] = [[] for _ in range(batch.num_rows)]
            for kind, data, offsets, row, line in _units(batch.column(at)):
                unit, digest = bigrams(data, offsets)
                size = np.bincount(unit, minlength=len(row))
                for u, t, shared in known.match(unit, digest, len(row)):
                    both = int(size[u] + known.size[t])
                    found[row[u]].append({"license": known.names[t], "unit": kind, "line": int(line[u]), "shared": shared, "size": both})
            for rows in found:
                rows.sort(key=lambda m: (m["line"], m["unit"]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, arrow.field(len(arrow) - 1).type)], schema=arrow)

    return docs.mapInArrow(run, schema).toDF(*names)


def op2_licenses(spark, sf_dir: str) -> DataFrame:
    """Matches of every document: how many, the licences, and the places of the lines that match."""
    docs = pick(read_table(spark, sf_dir, "documents"), doc_id="doc_id", text="text")
    found = scan(docs)
    place = F.transform("matches", lambda m: F.concat_ws(":", m["line"].cast("string"), m["unit"], m["license"], m["shared"].cast("string"), m["size"].cast("string")))
    return found.select(
        "doc_id",
        F.size("matches").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["license"]))), ",").alias("licenses"),
        F.array_join(place, ";").alias("places"),
    )
