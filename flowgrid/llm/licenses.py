"""License scans: winnowed fingerprints of templates pick candidates, banded alignment measures them.

Templates and texts are word sequences. Hashed word ``GRAM``-grams are winnowed (of every ``WINDOW`` neighbours the
least stays), so any run of GRAM + WINDOW - 1 equal words shares a fingerprint. The templates' fingerprints form an
inverted index; each hit proposes a template at a diagonal, chained hits of near diagonals are one candidate, and a local
alignment in a band around them gives the matched words and their span.
"""

from __future__ import annotations

import re
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.align import align
from flowgrid.llm.langid import KeyTable
from flowgrid.llm.shared import pick
from flowgrid.llm.tokens import in_batches

GRAM, WINDOW, BAND = 3, 2, 8
#: Share of a template's words that must be matched.
COVERAGE = 0.7
OUT = "doc_id long, license string, template string, coverage double, n_matched long, begin long, end long"
WORD = re.compile(r"\w+")

# License notices as their authors word them. template name, license, text.
TEMPLATES = [
    ("apache-2.0-line", "Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'),
    ("mit-line", "MIT", "Released under the MIT License."),
    ("mit-permission", "MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("isc-permission", "ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("bsd-redistribution", "BSD-2-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("bsd-3-endorsement", "BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("gpl-3.0-line", "GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("mpl-2.0-header", "MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("unlicense", "Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by-4.0-line", "CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0-line", "CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-1.0-short", "CC-BY-1.0", "Licensed under CC BY 1.0."),
    ("cc-by-1.0-line", "CC-BY-1.0", "This work is licensed under a Creative Commons Attribution 1.0 Generic License."),
    ("cc-by-sa-1.0-short", "CC-BY-SA-1.0", "Licensed under CC BY-SA 1.0."),
    ("cc-by-sa-1.0-line", "CC-BY-SA-1.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 1.0 Generic License."),
    ("cc-by-nd-1.0-short", "CC-BY-ND-1.0", "Licensed under CC BY-ND 1.0."),
    ("cc-by-nd-1.0-line", "CC-BY-ND-1.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 1.0 Generic License."),
    ("cc-by-nc-1.0-short", "CC-BY-NC-1.0", "Licensed under CC BY-NC 1.0."),
    ("cc-by-nc-1.0-line", "CC-BY-NC-1.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 1.0 Generic License."),
    ("cc-by-nc-sa-1.0-short", "CC-BY-NC-SA-1.0", "Licensed under CC BY-NC-SA 1.0."),
    ("cc-by-nc-sa-1.0-line", "CC-BY-NC-SA-1.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 1.0 Generic License."),
    ("cc-by-nc-nd-1.0-short", "CC-BY-NC-ND-1.0", "Licensed under CC BY-NC-ND 1.0."),
    ("cc-by-nc-nd-1.0-line", "CC-BY-NC-ND-1.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 1.0 Generic License."),
    ("cc-by-2.0-short", "CC-BY-2.0", "Licensed under CC BY 2.0."),
    ("cc-by-2.0-line", "CC-BY-2.0", "This work is licensed under a Creative Commons Attribution 2.0 Generic License."),
    ("cc-by-sa-2.0-short", "CC-BY-SA-2.0", "Licensed under CC BY-SA 2.0."),
    ("cc-by-sa-2.0-line", "CC-BY-SA-2.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 2.0 Generic License."),
    ("cc-by-nd-2.0-short", "CC-BY-ND-2.0", "Licensed under CC BY-ND 2.0."),
    ("cc-by-nd-2.0-line", "CC-BY-ND-2.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 2.0 Generic License."),
    ("cc-by-nc-2.0-short", "CC-BY-NC-2.0", "Licensed under CC BY-NC 2.0."),
    ("cc-by-nc-2.0-line", "CC-BY-NC-2.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 2.0 Generic License."),
    ("cc-by-nc-sa-2.0-short", "CC-BY-NC-SA-2.0", "Licensed under CC BY-NC-SA 2.0."),
    ("cc-by-nc-sa-2.0-line", "CC-BY-NC-SA-2.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 2.0 Generic License."),
    ("cc-by-nc-nd-2.0-short", "CC-BY-NC-ND-2.0", "Licensed under CC BY-NC-ND 2.0."),
    ("cc-by-nc-nd-2.0-line", "CC-BY-NC-ND-2.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 2.0 Generic License."),
    ("cc-by-3.0-short", "CC-BY-3.0", "Licensed under CC BY 3.0."),
    ("cc-by-3.0-line", "CC-BY-3.0", "This work is licensed under a Creative Commons Attribution 3.0 Unported License."),
    ("cc-by-sa-3.0-short", "CC-BY-SA-3.0", "Licensed under CC BY-SA 3.0."),
    ("cc-by-sa-3.0-line", "CC-BY-SA-3.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 3.0 Unported License."),
    ("cc-by-nd-3.0-short", "CC-BY-ND-3.0", "Licensed under CC BY-ND 3.0."),
    ("cc-by-nd-3.0-line", "CC-BY-ND-3.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 3.0 Unported License."),
    ("cc-by-nc-3.0-short", "CC-BY-NC-3.0", "Licensed under CC BY-NC 3.0."),
    ("cc-by-nc-3.0-line", "CC-BY-NC-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 3.0 Unported License."),
    ("cc-by-nc-sa-3.0-short", "CC-BY-NC-SA-3.0", "Licensed under CC BY-NC-SA 3.0."),
    ("cc-by-nc-sa-3.0-line", "CC-BY-NC-SA-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License."),
    ("cc-by-nc-nd-3.0-short", "CC-BY-NC-ND-3.0", "Licensed under CC BY-NC-ND 3.0."),
    ("cc-by-nc-nd-3.0-line", "CC-BY-NC-ND-3.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 3.0 Unported License."),
    ("cc-by-4.0-short", "CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-sa-4.0-short", "CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc-by-sa-4.0-line", "CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nd-4.0-short", "CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("cc-by-nd-4.0-line", "CC-BY-ND-4.0", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."),
    ("cc-by-nc-4.0-long", "CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-nc-sa-4.0-short", "CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("cc-by-nc-sa-4.0-line", "CC-BY-NC-SA-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."),
    ("cc-by-nc-nd-4.0-short", "CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("cc-by-nc-nd-4.0-line", "CC-BY-NC-ND-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."),
    ("cc0-1.0-line", "CC0-1.0", "This work is licensed under CC0 1.0 Universal."),
    ("gpl-2.0-line", "GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("lgpl-2-line", "LGPL-2.0", "This work is licensed under the GNU Library General Public License, version 2."),
    ("agpl-3.0-line", "AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("lgpl-3-line", "LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("lgpl-2.1-line", "LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("gpl-2.0-header", "GPL-2.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."),
    ("lgpl-2.1-header", "LGPL-2.1-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 2.1 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("lgpl-3.0-header", "LGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."),
    ("agpl-3.0-header", "AGPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."),
    ("epl-1.0-line", "EPL-1.0", "This work is licensed under the Eclipse Public License, version 1.0."),
    ("epl-2.0-line", "EPL-2.0", "This work is licensed under the Eclipse Public License, version 2.0."),
    ("bsl-1.0-header", "BSL-1.0", "Distributed under the Boost Software License, Version 1.0."),
    ("zlib-permission", "Zlib", "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("mit-disclaimer", "MIT", 'The software is provided "as is", without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software.'),
    ("isc-disclaimer", "ISC", 'The software is provided "as is" and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software.'),
    ("bsd-disclaimer", "BSD", 'This software is provided by the copyright holders and contributors "as is" and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages (including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage.'),
    ("bsl-1.0-permission", "BSL-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following'),
    ("zlib-disclaimer", "Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software."),
    ("zlib-notice", "Zlib", "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. This notice may not be removed or altered from any source distribution."),
]


def _grams(hashes: np.ndarray) -> np.ndarray:
    """The hash of each word GRAM-gram."""
    out = np.zeros(max(0, len(hashes) - GRAM + 1), np.uint64)
    for k in range(GRAM):
        out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)
        out ^= out >> np.uint64(29)
    return out


def _winnow(grams: np.ndarray, of: np.ndarray) -> np.ndarray:
    """Places of the grams that are the least of some WINDOW neighbours in one text (``of``: each gram's text); all of a text that has fewer."""
    kept = np.zeros(len(grams), bool)
    if len(grams) >= WINDOW:
        least = np.lib.stride_tricks.sliding_window_view(grams, WINDOW).min(1)
        inside = of[: len(least)] == of[WINDOW - 1 :]
        for k in range(WINDOW):
            kept[k : k + len(least)] |= inside & (grams[k : k + len(least)] == least)
    texts, n = np.unique(of, return_counts=True)
    return np.flatnonzero(kept | np.isin(of, texts[n < WINDOW]))


def _hash(words: np.ndarray) -> np.ndarray:
    return pd.util.hash_array(words, categorize=False) if len(words) else np.zeros(0, np.uint64)


def chains(diagonals: list[int], most: int):
    """Runs (first, last) of ascending diagonals with steps of BAND at most, none wider than ``most``: one candidate each."""
    first = last = None
    for d in diagonals:
        if last is not None and (d - last > BAND or d - first > most):
            yield first, last
            first = None
        first, last = d if first is None else first, d
    if last is not None:
        yield first, last


class Index:
    """The inverted index of the templates' fingerprints."""

    def __init__(self, templates=TEMPLATES):
        self.templates = templates
        self.words = [WORD.findall(text.lower()) for _, _, text in templates]
        postings: dict[int, list[tuple[int, int]]] = {}
        for t, w in enumerate(self.words):
            g = _grams(_hash(np.array(w, object)))
            for at in _winnow(g, np.zeros(len(g), int)).tolist():
                postings.setdefault(int(g[at]), []).append((t, at))
        self.postings = list(postings.values())
        self.table = KeyTable(np.array(list(postings), np.uint64))

    def scan(self, texts: list[str]) -> list[list[tuple]]:
        """For each text its matches: (template number, coverage, matched words, begin, end) with places in code points."""
        split = [WORD.findall(t) for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        at, seen = pd.factorize(np.array(list(chain.from_iterable(split)), object))
        out: list[list[tuple]] = [[] for _ in texts]
        if not len(at):
            return out
        grams = _grams(_hash(np.array([w.lower() for w in seen], object))[at])
        ends = np.cumsum(count)
        of = np.searchsorted(ends, np.arange(len(grams)), "right")
        whole = np.flatnonzero(np.arange(len(grams)) + GRAM <= ends[of])  # not across the limits of texts
        chosen = whole[_winnow(grams[whole], of[whole])]
        row = self.table.find(grams[chosen])
        hits: dict[int, dict] = {}
        first = ends - count
        for place, r in zip(chosen[row >= 0].tolist(), row[row >= 0].tolist()):
            doc = int(of[place])
            for t, k in self.postings[r]:
                hits.setdefault(doc, {}).setdefault(t, []).append(place - int(first[doc]) - k)
        for doc, by_template in hits.items():
            spans, b, found = None, [w.lower() for w in split[doc]], {}
            for t, diagonals in by_template.items():
                a = self.words[t]
                for low, high in chains(sorted(set(diagonals)), len(a)):
                    lo = max(0, low - BAND)
                    score, m, _, _, p, q = align(a, b[lo : high + len(a) + BAND], low - BAND - lo, high + BAND - lo)
                    if m >= COVERAGE * len(a):
                        spans = spans or [x.span() for x in WORD.finditer(texts[doc])]
                        place = (t, spans[lo + p][0], spans[lo + q - 1][1])
                        found[place] = max(m, found.get(place, 0))
            out[doc] = self.best([(t, m / len(self.words[t]), m, begin, end) for (t, begin, end), m in found.items()])
        return out

    def best(self, found: list[tuple]) -> list[tuple]:
        """Without places that another license explains better.

        Better: more of the template's words matched than missed, then the greater coverage. Places are one if they share
        half of the shorter; places of the same license all stay, as do equally good ones.
        """
        rank = lambda x: (2 * x[2] - len(self.words[x[0]]), x[1])
        order, kept = sorted(found, key=rank, reverse=True), []
        for x in order:
            same = (y for y in kept if 2 * (min(x[4], y[4]) - max(x[3], y[3])) >= min(x[4] - x[3], y[4] - y[3]))
            if all(self.templates[y[0]][1] == self.templates[x[0]][1] or rank(y) == rank(x) for y in same):
                kept.append(x)
        return [x for x in found if x in kept]


def scan(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """doc_id, license, template, coverage, n_matched, begin, end: every place of every whole text that matches a template.

    Of overlapping places of different licenses only the best explained is given (see Index.best).

    A place matches if at least COVERAGE of the template's words are aligned there; begin and end are code points of
    the text. Texts with none, null and empty texts give no row. Repeated rows give repeated matches; null doc_ids
    are kept; other columns are ignored.
    """

    def run(batches):
        index = Index(templates)
        for pdf in batches:
            texts = pdf.text.fillna("").tolist()
            for lo, hi in in_batches(texts):
                rows = [(i, *m) for i, found in enumerate(index.scan(texts[lo:hi]), lo) for m in found]
                ids = pdf.doc_id.astype("Int64").array[[r[0] for r in rows]]
                t = [templates[r[1]] for r in rows]
                yield pd.DataFrame({"doc_id": ids, "license": pd.Series([x[1] for x in t], dtype=object), "template": pd.Series([x[0] for x in t], dtype=object), "coverage": np.round([float(r[2]) for r in rows], 9), "n_matched": [r[3] for r in rows], "begin": [r[4] for r in rows], "end": [r[5] for r in rows]})

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, OUT)
