"""License scans: MinHash bands over overlapping text windows retrieve templates, shingle containment verifies them.

Windows: templates are classed by length. For class c (templates of up to c word pairs, a power of two) every text is
cut into blocks of c pairs, from its beginning, and two neighbouring blocks are a window, so that any stretch of c pairs
lies whole in one. A block's MinHash is the least of the two blocks of half its size, so all classes share one pass over
the text. A window that holds a share s of a template of T pairs has a Jaccard similarity of at least
s T / (2c + (1 - s) T) with it. Bands of one MinHash each, as many as ``bands_for`` asks at the accepted share, make a
band agree with the wanted probability. Templates that a band retrieves are then compared exactly, with every stretch of
the whole text: the share of the template's pairs in it. What is found depends on the text alone.

Licences word much alike, and their versions almost so. Of stretches that overlap only the one with the largest share
stays; of equals the one with more pairs, then the one that comes first in the list of templates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from leadloom.llm.batches import Memo, ready, slices, texts_of

# Public licences, as their texts or the notices that they ask for word them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TERMS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_APACHE = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
_UNLICENSE = """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law."""
_ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution."""
_LGPL_CODE = """GNU LESSER GENERAL PUBLIC LICENSE
Version 3, 29 June 2007
This version of the GNU Lesser General Public License incorporates the terms and conditions of version 3 of the GNU General Public License, supplemented by the additional permissions listed below."""
_CC0_CODE = """The laws of most jurisdictions throughout the world automatically confer exclusive Copyright and Related Rights (defined below) upon the creator and subsequent owner(s) (each and all, an "owner") of an original work of authorship and/or a database (each, a "Work").
Certain owners wish to permanently relinquish those rights to a Work for the purpose of contributing to a commons of creative, cultural and scientific works ("Commons") that the public can reliably and without fear of later claims of infringement build upon, modify, incorporate in other works, reuse and redistribute as freely as possible in any form whatsoever and for any purposes, including without limitation commercial purposes."""
_MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def _gnu(thing: str, license_: str, version: int) -> str:
    """The notice that a licence of the GNU family asks for."""
    return f"""This {thing} is free software: you can redistribute it and/or modify it under the terms of the GNU {license_} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.
This {thing} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {license_} for more details."""


def _plain(license_: str, version: str) -> str:
    return f"This work is licensed under the {license_}, version {version}."


def _cc(name: str, words: str) -> list[str]:
    """Two notices, and how the legal code begins."""
    code = f"""Creative Commons {words} 4.0 International Public License
By exercising the Licensed Rights (defined below), You accept and agree to be bound by the terms and conditions of this Creative Commons {words} 4.0 International Public License ("Public License"). To the extent this Public License may be interpreted as a contract, You are granted the Licensed Rights in consideration of Your acceptance of these terms and conditions, and the Licensor grants You such rights in consideration of benefits the Licensor receives from making the Licensed Material available under these terms and conditions."""
    return [f"Licensed under CC {name} 4.0.", f"This work is licensed under a Creative Commons {words} 4.0 International License.", code]


TEMPLATES = {
    "MIT": ["Released under the MIT License.", _MIT],
    "ISC": ["Released under the ISC License.", _ISC],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", _BSD_TERMS + _BSD_DISCLAIMER],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", _BSD_TERMS + _BSD_THIRD + _BSD_DISCLAIMER],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", _APACHE],
    "GPL-2.0": [_plain("GNU General Public License", "2"), _gnu("program", "General Public License", 2)],
    "GPL-3.0": [_plain("GNU General Public License", "3"), _gnu("program", "General Public License", 3)],
    "LGPL-2.1": [_plain("GNU Lesser General Public License", "2.1"), _gnu("library", "Lesser General Public License", 2)],
    "LGPL-3.0": [_plain("GNU Lesser General Public License", "3"), _gnu("library", "Lesser General Public License", 3), _LGPL_CODE],
    "AGPL-3.0": [_plain("GNU Affero General Public License", "3"), _gnu("program", "Affero General Public License", 3)],
    "MPL-2.0": [_MPL],
    "Unlicense": [_UNLICENSE],
    "Zlib": [_ZLIB],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication.", _CC0_CODE],
    "CC-BY-4.0": _cc("BY", "Attribution"),
    "CC-BY-SA-4.0": _cc("BY-SA", "Attribution-ShareAlike"),
    "CC-BY-ND-4.0": _cc("BY-ND", "Attribution-NoDerivatives"),
    "CC-BY-NC-4.0": _cc("BY-NC", "Attribution-NonCommercial"),
    "CC-BY-NC-SA-4.0": _cc("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"),
    "CC-BY-NC-ND-4.0": _cc("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
}

_WORD = regex.compile(rb"[0-9a-z\x80-\xff]+(?:[.\-][0-9a-z\x80-\xff]+)*")
_SEEDS = np.random.default_rng(11).integers(1, 1 << 62, 256, np.uint64) * np.uint64(2) + np.uint64(1)
#: Pairs of a block of the shortest class, and pairs of a stretch for each four of a template.
_LEAST, _STRETCH = 8, 5
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)


def words_of(text: str) -> list[bytes]:
    """Words in lower case (A-Z); points and hyphens inside them stay."""
    return _WORD.findall(text.encode("utf-8", "replace").lower())


def bands_for(similarity: float, probability: float = 0.9999) -> int:
    """Bands of one MinHash that agree at least once with ``probability`` at this similarity."""
    return math.ceil(math.log(1 - probability) / math.log(1 - similarity))


class LicenseScanner:
    """Bands of the templates' MinHashes, and the exact comparison."""

    def __init__(self, templates: dict[str, list[str]], containment: float):
        import xxhash

        self.containment = containment
        self.memo = Memo(lambda new: [xxhash.xxh64_intdigest(w) for w in new])
        self.items: list[tuple[str, np.ndarray, int]] = []  # name, distinct pairs, pairs of a stretch
        for name, notices in templates.items():
            for notice in notices:
                pairs = self.pairs(self.codes([words_of(notice)])[0])
                if pairs.size:
                    self.items.append((name, np.unique(pairs), max(pairs.size, pairs.size * _STRETCH // 4)))
        self.classes: dict[int, tuple[list[int], np.ndarray]] = {}
        for c in sorted({self.class_of(i) for i in range(len(self.items))}):
            own = [i for i in range(len(self.items)) if self.class_of(i) == c]
            sizes = [self.items[i][1].size for i in own]
            bands = bands_for(min(containment * t / (2 * c + (1 - containment) * t) for t in sizes))
            self.classes[c] = own, np.array([[self.minhash(self.items[i][1], b).min() for i in own] for b in range(bands)], np.uint64)

    def class_of(self, item: int) -> int:
        return max(_LEAST, 1 << (self.items[item][2] - 1).bit_length())

    def codes(self, words: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
        """Codes of the words of texts, one after the other, and the end of each text."""
        self.memo.learn(set().union(*words))
        stops = np.cumsum([len(w) for w in words], dtype=np.int64)
        return np.fromiter((self.memo[w] for ws in words for w in ws), np.uint64, int(stops[-1]) if stops.size else 0), stops

    @staticmethod
    def pairs(codes: np.ndarray) -> np.ndarray:
        x = codes[:-1] * _SEEDS[254] + codes[1:] * _SEEDS[255]
        return x ^ (x >> np.uint64(31))

    @staticmethod
    def minhash(pairs: np.ndarray, band: int) -> np.ndarray:
        x = pairs * _SEEDS[band]
        x ^= x >> np.uint64(32)
        return x

    def _candidates(self, pairs: np.ndarray, sizes: np.ndarray) -> set[tuple[int, int]]:
        """(text, template) for which a band retrieves the template by a window of the text; texts have ``sizes`` pairs."""
        levels, c, blocks = [], _LEAST, -(-sizes // _LEAST)
        first = np.cumsum(sizes) - sizes
        while c <= max(self.classes):
            # Where the blocks begin in the level below, the text of each, and whether it is its text's last.
            text = np.repeat(np.arange(sizes.size), blocks)
            place = np.arange(text.size) - np.repeat(np.cumsum(blocks) - blocks, blocks)
            begin = first[text] + place * (_LEAST if c == _LEAST else 2)
            levels.append((c, begin, text, place == blocks[text] - 1))
            first, blocks, c = np.cumsum(blocks) - blocks, -(-blocks // 2), 2 * c
        found: set[tuple[int, int]] = set()
        for b in range(max(keys.shape[0] for _, keys in self.classes.values())):
            least = self.minhash(pairs, b)
            for c, begin, text, last in levels:
                least = np.minimum.reduceat(least, begin)
                own, keys = self.classes.get(c, ([], None))
                if not own or b >= keys.shape[0]:
                    continue
                window = np.minimum(least, np.where(last, _NONE, np.append(least[1:], _NONE)))
                for w in np.flatnonzero(np.isin(window, keys[b])).tolist():
                    found.update((int(text[w]), own[k]) for k in np.flatnonzero(keys[b] == window[w]).tolist())
        return found

    def scan(self, texts: list[str]) -> list[list[tuple[str, float, int]]]:
        """For each text its matches (license, share of the best notice's pairs, first word)."""
        codes, stops = self.codes([words_of(t) for t in texts])
        begins = np.concatenate(([0], stops[:-1]))
        sizes = np.maximum(stops - begins - 1, 0)
        held = np.flatnonzero(sizes)
        found: list[list[tuple[float, int, int, int, int]]] = [[] for _ in texts]
        if not held.size or not self.items:
            return [[] for _ in texts]
        # Pairs of texts with two words or more, none over the end of a text.
        own = [self.pairs(codes[begins[d] : stops[d]]) for d in held.tolist()]
        for k, i in self._candidates(np.concatenate(own), sizes[held]):
            _, wanted, span = self.items[i]
            found[held[k]] += [(-share, -wanted.size, i, first, last) for share, first, last in self.stretches(own[k], wanted, span, self.containment)]
        return [self.distinct(x) for x in found]

    def distinct(self, matches: list[tuple[float, int, int, int, int]]) -> list[tuple[str, float, int]]:
        """Of overlapping matches the best; of those each license once, by name."""
        kept: list[tuple[int, int]] = []
        best: dict[str, tuple[float, int]] = {}
        for share, _, i, first, last in sorted(set(matches)):
            if all(last < a or first > z for a, z in kept):
                kept.append((first, last))
                best.setdefault(self.items[i][0], (-share, first))
        return sorted((name, share, first) for name, (share, first) in best.items())

    @staticmethod
    def stretches(pairs: np.ndarray, wanted: np.ndarray, span: int, least: float) -> list[tuple[float, int, int]]:
        """(share of ``wanted``, first place, last place) of all stretches of ``span`` pairs that begin with a wanted one
        and hold a share of ``least`` or more."""
        place = np.minimum(np.searchsorted(wanted, pairs), wanted.size - 1)
        at = np.flatnonzero(wanted[place] == pairs)
        if np.unique(place[at]).size < least * wanted.size:
            return []
        held, code = at.tolist(), place[at].tolist()
        times, n, end, found = [0] * wanted.size, 0, 0, []
        for k, p in enumerate(held):
            while end < len(held) and held[end] < p + span:
                n += not times[code[end]]
                times[code[end]] += 1
                end += 1
            if n / wanted.size >= least:
                found.append((n / wanted.size, p, held[end - 1]))
            times[code[k]] -= 1
            n -= not times[code[k]]
        return found


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None, containment: float = 0.8) -> DataFrame:
    """(doc_id, licenses, shares, first_words, n_licenses) of every document, over its whole text.

    A license matches if a share of ``containment`` or more of one of its notices' word pairs stands close together, and
    no other license's notice fits the same stretch better. Null, empty and one-word texts match none. Equal rows give
    equal results; columns besides doc_id and text are ignored. Templates are a parameter of bounded size that goes with
    the code; no rows are shuffled.
    """
    templates = TEMPLATES if templates is None else templates

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = LicenseScanner(templates, containment)
        for batch in slices(batches, "text"):
            found = scanner.scan(texts_of(batch))
            lists = [pa.array([[m[k] for m in x] for x in found], pa.list_(t)) for k, t in enumerate((pa.string(), pa.float64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *lists, pa.array([len(x) for x in found], pa.int64())], names=["doc_id", "licenses", "shares", "first_words", "n_licenses"])

    ready(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, licenses array<string>, shares array<double>, first_words array<long>, n_licenses long")
