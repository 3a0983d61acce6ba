"""License scans: MinHash bands over overlapping windows of a text retrieve templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case, so markup and decoration between words do not matter. Templates are cut into
windows of at most WINDOW words at every offset; a text is read in windows of the same sizes, one every STRIDE_SHARE of a window. Windows
of two equal passages lie at most half a stride apart, so their shingles have a Jaccard similarity of 0.55 at least even where a fifth of
the template is missing, and 24 bands of two values find such a pair with probability 0.9998.

The templates are a fixed list, so their index has a bounded size and goes to every task; texts are read once, where they lie, and never shuffled.
A window without any shingle of any template shares no MinHash value with one, so values are only made for the others.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE_WORDS, MIN_CONTAINMENT = 5, 0.8
WINDOW, STRIDE_SHARE = 24, 8
BANDS, BAND_ROWS, SEED = 24, 2, 29
#: Distinct words whose hashes a task keeps.
KEPT_WORDS = 500_000

#: Notices, headers, grants and conditions of public licenses, by SPDX name and, where a license has several, the kind of text.
TEMPLATES = {
    "0BSD": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "AGPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "BSD-2-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-4.0-short": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0-deed": "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
    "CC-BY-NC-ND-4.0": "Licensed under CC BY-NC-ND 4.0.",
    "CC-BY-NC-SA-4.0": "Licensed under CC BY-NC-SA 4.0.",
    "CC-BY-ND-4.0": "Licensed under CC BY-ND 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC-BY-SA-4.0-deed": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-2.0-or-later-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0-or-later-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "LGPL-2.1-or-later-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "LGPL-3.0-or-later-header": "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "MIT": "Released under the MIT License.",
    "MIT-licensed": "Licensed under the MIT License.",
    "MIT-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "WTFPL": "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.",
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions.",
}

_WORD = re.compile(r"[^\W_]+")


class _Words(dict):
    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), SEED)
        return value


def shingles(words: np.ndarray) -> np.ndarray:
    """Hashes of the runs of SHINGLE_WORDS words; of the whole, if it has fewer words."""
    n = min(SHINGLE_WORDS, words.size)
    if not n:
        return np.zeros(0, np.uint64)
    out = np.zeros(words.size - n + 1, np.uint64)
    for k in range(n):
        out = (out ^ words[k : words.size - n + 1 + k]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


_FACTORS = np.random.default_rng(SEED).integers(1, 1 << 63, BANDS * BAND_ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(window: np.ndarray) -> list[tuple[int, bytes]]:
    """A key for each band of the MinHash values of a window's shingles."""
    mixed = window[:, None] * _FACTORS[None]
    least = (mixed ^ (mixed >> np.uint64(31))).min(0).reshape(BANDS, BAND_ROWS)
    return [(k, row.tobytes()) for k, row in enumerate(least)]


class Index:
    def __init__(self, templates: dict[str, str]) -> None:
        self.words = _Words()
        self.own: dict[str, tuple[set[int], int]] = {}
        self.bands: dict[tuple, set[str]] = defaultdict(set)
        found = {name: self.hashed(text) for name, text in templates.items()}
        for name, words in found.items():
            own, size = shingles(words), min(WINDOW, words.size)
            if size < SHINGLE_WORDS:
                raise ValueError(f"template {name} has fewer than {SHINGLE_WORDS} words")
            self.own[name] = (set(own.tolist()), words.size)
            n = size - SHINGLE_WORDS + 1
            for at in range(own.size - n + 1):
                for key in band_keys(own[at : at + n]):
                    self.bands[(size, *key)].add(name)
        self.sizes = sorted({min(WINDOW, n) for _, n in self.own.values()})
        self.known = np.array(sorted(set().union(*(s for s, _ in self.own.values()))), np.uint64)

    def hashed(self, text: str) -> np.ndarray:
        return np.array([self.words[w] for w in _WORD.findall(text.lower())], np.uint64)

    def scan(self, text: str | None) -> list[tuple[str, float, int, int, str | None]]:
        """(template, containment, first word, word after the last, template that it lies within) of every passage, by template and place."""
        words = self.hashed(text or "")
        if words.size < SHINGLE_WORDS:
            return []
        own = shingles(words)
        hits = np.flatnonzero(np.isin(own, self.known))
        if not hits.size:
            return []
        seeds: dict[str, set[int]] = defaultdict(set)
        for size in self.sizes:
            n, stride = size - SHINGLE_WORDS + 1, max(1, size // STRIDE_SHARE)
            last = max(0, own.size - n)
            starts = {min(last, s) for h in hits.tolist() for s in range(-(-max(0, h - n + 1) // stride) * stride, h + stride, stride) if min(last, s) <= h}
            for at in sorted(starts):
                for key in band_keys(own[at : at + n]):
                    for name in self.bands.get((size, *key), ()):
                        seeds[name].add(at)
        found = {name: p for name, starts in sorted(seeds.items()) if (p := self._passages(name, own, hits, starts))}
        return [(name, *p, self._within(name, p, found)) for name, passages in found.items() for p in passages]

    def _passages(self, name: str, own: np.ndarray, hits: np.ndarray, starts: set[int]) -> list[tuple[float, int, int]]:
        """(containment, first word, word after the last) of all stretches of the template's length, and a quarter, near a seed that contain most of it; those that overlap are one, with the best containment."""
        wanted, length = self.own[name]
        reach = length - SHINGLE_WORDS + 1
        slack = reach // 4
        at = hits[[int(own[h]) in wanted for h in hits.tolist()]]
        seeds = np.array(sorted(starts))
        near = np.searchsorted(seeds, at - reach - WINDOW) < np.searchsorted(seeds, at + reach + WINDOW, "right")
        values, at = own[at].tolist(), at.tolist()
        inside: Counter[int] = Counter()
        found: list[tuple[float, int, int]] = []
        to = 0
        for k, begin in enumerate(at):
            while to < len(at) and at[to] < begin + reach + slack:
                inside[values[to]] += 1
                to += 1
            share, end = len(inside) / len(wanted), at[to - 1] + SHINGLE_WORDS
            if share >= MIN_CONTAINMENT and near[k]:
                if found and begin < found[-1][2]:
                    found[-1] = (max(share, found[-1][0]), found[-1][1], end)
                else:
                    found.append((share, begin, end))
            inside[values[k]] -= 1
            if not inside[values[k]]:
                del inside[values[k]]
        return found

    def _within(self, name: str, passage: tuple[float, int, int], found: dict[str, list[tuple[float, int, int]]]) -> str | None:
        """The template that fits better, or as well and is longer, and whose passage holds this one's middle: BSD-3-Clause for the BSD-2-Clause text in it."""
        middle, best = (passage[1] + passage[2]) // 2, (passage[0], len(self.own[name][0]), "")
        for other, passages in found.items():
            at = bisect_right(passages, middle, key=lambda p: p[1]) - 1
            if other != name and at >= 0 and passages[at][2] > middle:
                best = max(best, (passages[at][0], len(self.own[other][0]), other), key=lambda x: x[:2])
        return best[2] or None


@lru_cache(maxsize=2)
def _index(templates: tuple[tuple[str, str], ...]) -> Index:
    return Index(dict(templates))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and passage of a template in it: id, license, containment, word_start, word_end, within.

    The containment is the share of the template's distinct shingles that a passage of its length holds, at least MIN_CONTAINMENT. Passages of one
    template that overlap are one. within: the license whose passage holds this one and fits better, null if none does. Whole
    texts are read. Null, empty and short texts have no row; rows that repeat have rows of their own; an empty table gives an empty result; other columns
    are not looked at. ``templates`` (name -> text of five words or more) replaces TEMPLATES; it goes to every task, so it must be of a size for that.
    """
    fixed = tuple((templates or TEMPLATES).items())
    names = ("license", "containment", "word_start", "word_end", "within")

    @F.arrow_udf("array<struct<license: string, containment: double, word_start: int, word_end: int, within: string>>")
    def scanned(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        kind = pa.list_(pa.struct(list(zip(names, (pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.string()), strict=True))))
        index = _index(fixed)
        for batch in batches:
            yield pa.array([[dict(zip(names, f, strict=True)) for f in index.scan(x.as_py())] for x in batch], kind)

    return docs.select(F.col(id_col), F.explode(scanned(F.col(text_col))).alias("m")).select(id_col, "m.*")
