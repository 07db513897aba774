"""License scans: winnowed template fingerprints, an inverted index, banded alignment.

Templates are lower-cased words. Hashes of every `gram` words are winnowed (the least of each
window) into an inverted index, gram hash -> (template, place), of a size that the templates
bound; it is broadcast. A document's words are matched against the templates' vocabulary
first; only runs of at least `gram` known words can hold a gram, so other text costs one
lookup a word. Grams found in the index pick (template, diagonal) candidates; near hits of one
diagonal band are chained and the stretch is aligned with the template within the band
(match +2, mismatch and gap -1, local); what lies beside a match is aligned again, until no
match is left, as copies of a short notice can share a band. Matches report the template's coverage and the span.

A run of a template shorter than gram + window - 1 words may go unseen (the winnowing
guarantee); templates shorter than that are indexed by all their grams.

A hit joins one of the last four groups of its template if it lies in that group's band, else
it begins a group. The templates are notices and headers, not whole license texts; others are
passed as a parameter.

Defined results: null or empty text has no match; of overlapping matches of one document that
with more matched words stays, then the better covered one, then that of the template listed
first; equal rows get equal matches; an empty table gives an empty frame; further columns are
not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

# Public license notices, as text.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MIT-line": "Released under the MIT License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "GPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "GPL-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-4.0-line": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0-line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0-line": "Licensed under CC BY-SA 4.0.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "GPL-2.0": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "LGPL-2.1": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "AGPL-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}

_WORD = re.compile(r"[A-Za-z0-9]+")
_ANY = re.compile(r"[^\W_]+")


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


class Scanner:
    """Templates as word ids with their index."""

    def __init__(self, templates: dict[str, str], gram: int = 3, window: int = 3, band: int = 8, coverage: float = 0.8):
        self.gram, self.band, self.coverage = gram, band, coverage
        self.names = list(templates)
        self.vocab: dict[str, int] = {}
        self.words = [[self.vocab.setdefault(w, len(self.vocab)) for w in _words(t)] for t in templates.values()]
        self.base = len(self.vocab) + 1
        self.index: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for t, ids in enumerate(self.words):
            grams = self._grams(np.array(ids, np.int64))
            mixed = (grams * np.int64(0x9E3779B97F4A7C1)) & np.int64(0x7FFFFFFFFFFFFFFF)
            wide = window if len(ids) >= gram + window - 1 else 1
            picked = {a + int(np.argmin(mixed[a : a + wide])) for a in range(max(0, len(grams) - wide + 1))}
            if len(ids) < 2 * (gram + window - 1):  # short notices: every gram
                picked = set(range(len(grams)))
            for a in sorted(picked):
                self.index[int(grams[a])].append((t, a))
        self.marks = np.array(sorted(self.index), np.int64)

    def _grams(self, ids: np.ndarray) -> np.ndarray:
        n = len(ids) - self.gram + 1
        if n <= 0:
            return np.empty(0, np.int64)
        out = np.zeros(n, np.int64)
        for k in range(self.gram):
            out = out * self.base + ids[k : k + n]
        return out

    def _align(self, doc: list[int], ids: list[int], shift: int) -> tuple[int, int, int, int, int]:
        """Local alignment of doc and ids around diagonal shift: (matches, doc start, doc end, template start, template end)."""
        best, top = (0, 0, 0, 0, 0), 0
        before: dict[int, tuple] = {}
        for i in range(len(doc)):
            now: dict[int, tuple] = {}
            for j in range(max(0, i - shift - self.band), min(len(ids), i - shift + self.band + 1)):
                same = doc[i] == ids[j]
                cell = (0, 0, i, j)
                for prev, gain in ((before.get(j - 1), 2 if same else -1), (before.get(j), -1), (now.get(j - 1), -1)):
                    if prev and prev[0] + gain > cell[0]:
                        cell = (prev[0] + gain, prev[1] + (same and gain == 2), prev[2], prev[3])
                if same and cell[0] < 2:
                    cell = (2, 1, i, j)
                if cell[0] > 0:
                    now[j] = cell
                    if cell[0] > top:
                        top, best = cell[0], (cell[1], cell[2], i + 1, cell[3], j + 1)
            before = now
        return best

    def scan(self, text: str) -> list[tuple[str, float, int, int, int]]:
        """(template, coverage, matched words, start, end): character spans, end exclusive, by start."""
        found = list(_ANY.finditer(text))
        get = self.vocab.get
        ids = np.array([get(m.group().lower(), -1) for m in found], np.int64)
        if len(ids) < self.gram:
            return []
        bad = np.concatenate([[0], np.cumsum(ids < 0)])
        whole = np.flatnonzero(bad[self.gram :] == bad[: -self.gram])
        if not len(whole):
            return []
        grams = np.zeros(len(whole), np.int64)
        for k in range(self.gram):
            grams = grams * self.base + ids[whole + k]
        at = np.searchsorted(self.marks, grams)
        hit = (at < len(self.marks)) & (self.marks[np.minimum(at, len(self.marks) - 1)] == grams)
        seeds: dict[int, list[tuple[int, int]]] = defaultdict(list)
        for p, g in zip(whole[hit].tolist(), grams[hit].tolist(), strict=True):
            for t, a in self.index[g]:
                seeds[t].append((p, p - a))
        out = []
        for t, held in seeds.items():
            size = len(self.words[t])
            groups: list[list[int]] = []  # [least diagonal, greatest, last place]
            for p, d in sorted(held):
                for g in reversed(groups[-4:]):
                    if abs(d - g[0]) <= self.band and abs(d - g[1]) <= self.band and p - g[2] <= size + self.band:
                        g[0], g[1], g[2] = min(g[0], d), max(g[1], d), p
                        break
                else:
                    groups.append([d, d, p])
            for low, high, _ in groups:
                a, z = max(0, low - self.band), min(len(ids), high + size + self.band)
                rest = [(a, z)]
                while rest:  # what lies beside a match may hold further ones
                    a, z = rest.pop()
                    n, s, e, _, _ = self._align(ids[a:z].tolist(), self.words[t], (low + high) // 2 - a)
                    if n >= self.coverage * size:
                        out.append((n / size, -t, n, found[a + s].start(), found[a + e - 1].end()))
                        rest += [(x, y) for x, y in ((a, a + s), (a + e, z)) if y - x >= self.coverage * size]
        picked: list[tuple] = []
        for m in sorted(out, key=lambda x: (-x[2], -x[0], -x[1], x[3])):
            if all(m[4] <= p[3] or m[3] >= p[4] for p in picked):
                picked.append(m)
        return sorted(((self.names[-t], c, n, s, e) for c, t, n, s, e in picked), key=lambda x: x[3])


def scan(docs: DataFrame, templates: dict[str, str] | None = None, **options) -> DataFrame:
    """doc_id, n_licenses, licenses: array of (template, coverage, words, start, end)."""
    held = templates or TEMPLATES

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s = Scanner(held, **options)
        for b in batches:
            found = [s.scan(t or "") for t in b["text"]]
            yield pd.DataFrame({"doc_id": b["doc_id"], "n_licenses": [len(f) for f in found], "licenses": [[{"template": n, "coverage": c, "words": w, "start": a, "end": z} for n, c, w, a, z in f] for f in found]})

    return map_rows(docs.select("doc_id", "text"), each, "doc_id long, n_licenses int, licenses array<struct<template: string, coverage: double, words: int, start: int, end: int>>")
