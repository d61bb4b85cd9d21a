"""License scan: MinHash bands over overlapping text windows retrieve templates, exact shingle containment verifies them.

For each template length n, windows a quarter longer step over a text's five-word shingles from its first one on, so that
some window holds every stretch of n shingles whole. Windows end with their text: a result is a function of the text
alone, whatever else is in its batch. If a stretch holds CONTAINED of the template's shingles, that window's similarity to
the template is over 0.75 / 1.5 = 0.5, and BANDS bands of ROWS minima miss it with probability (1 - 0.5 ** ROWS) **
BANDS at most, about 1 in 100 million. Windows without any of the template's shingles can't match, and their minima are
not computed. Matches need CONTAINED of the template's shingles inside one window and half a window around it; a copy
with so many words put in that no stretch of n shingles holds CONTAINED of them may be found, without that bound.

Of windows with equal containment the first gives first_word, the place of the stretch that was looked at.

Defined cases: a null or empty text, and one with fewer than five words, has no windows and no rows; texts of any length
are scanned whole; a null identifier stays null; repeated rows give repeated results; an empty table gives an empty
result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sameword.llm.arrow import as_bytes, ragged, small_batches

WORDS, BANDS, ROWS, CONTAINED = 5, 64, 2, 0.75
KEPT_WORDS = 400_000
# Shingles of windows whose minima are computed at once.
AT_ONCE = 1 << 16
# License statements, notices and whole public license texts.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "cc-by-nc-line": "Licensed under CC BY-NC 4.0.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    "bsd-2": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.""",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "unlicense": """This is free and unencumbered software released into the public domain.
Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.
In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.""",
    "gpl-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.""",
    "gpl-3.0-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
}
NOT_WORD = re.compile(rb"[^a-z0-9\x80-\xff]+")
MIX = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
SEEDS = np.array([2 * xxhash.xxh64_intdigest(b"order%d" % i) + 1 & (1 << 64) - 1 for i in range(BANDS * ROWS)], np.uint64)


class Words(dict):
    def __missing__(self, word: bytes) -> int:
        found = self[word] = xxhash.xxh64_intdigest(word)
        return found


def shingles(text: bytes, known: Words) -> np.ndarray:
    """A hash for each five words in a row, lower case, punctuation apart."""
    words = NOT_WORD.sub(b" ", text.lower()).split()
    n = len(words) - WORDS + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
    s = sum((h[j : n + j] * MIX[j] for j in range(WORDS)), np.zeros(n, np.uint64))
    return (s ^ (s >> np.uint64(29))) * MIX[1]


def order(s: np.ndarray, k: int) -> np.ndarray:
    h = s * SEEDS[k]
    return h ^ (h >> np.uint64(31))


class Scanner:
    def __init__(self, templates: dict[str, str]):
        self.known, self.scales = Words(), {}
        for name, text in templates.items():
            s = np.unique(shingles(text.encode(), self.known))
            if not len(s):
                raise ValueError(f"the template {name} has fewer than {WORDS} words")
            bands = [sum((order(s, b * ROWS + r).min() * MIX[r] for r in range(ROWS)), np.uint64(0)) for b in range(BANDS)]
            self.scales.setdefault(len(s), []).append((name, s, np.array(bands)))
        #: For each length, which low 16 bits some template's shingles have.
        self.low = {n: np.zeros(1 << 16, bool) for n in self.scales}
        for n, given in self.scales.items():
            for _, s, _ in given:
                self.low[n][s & np.uint64(0xFFFF)] = True

    def retrieve(self, s: np.ndarray, sizes: np.ndarray, n: int, width: int, step: int) -> Iterator[tuple[np.ndarray, np.ndarray, list[np.ndarray]]]:
        """Text and start of windows that hold a shingle of some template of length n, and which of them share a band with
        each. Windows of a text start at its first shingle and every step after it."""
        own = np.flatnonzero(self.low[n][s & np.uint64(0xFFFF)])
        own = own[np.isin(s[own], np.concatenate([t for _, t, _ in self.scales[n]]))]
        ends = np.cumsum(sizes)
        counts = -(-sizes // step)
        doc = np.repeat(np.arange(len(sizes)), counts)
        at = (ends - sizes)[doc] + ragged(np.zeros(len(sizes), np.int64), counts) * step
        some = np.searchsorted(own, np.minimum(at + width, ends[doc])) > np.searchsorted(own, at)
        doc, at = doc[some], at[some]
        each = max(1, AT_ONCE // width)
        for i in range(0, len(at), each):
            part, of = at[i : i + each], doc[i : i + each]
            # a window that reaches past its text's last shingle has that one more than once, which leaves its minima as they are
            held = s[np.minimum(part + np.arange(width)[:, None], ends[of] - 1)]
            hit = [np.zeros(len(part), bool) for _ in self.scales[n]]
            for b in range(BANDS):
                key = sum((order(held, b * ROWS + r).min(0) * MIX[r] for r in range(ROWS)), np.uint64(0))
                for h, (_, _, bands) in zip(hit, self.scales[n], strict=True):
                    h |= key == bands[b]
            yield of, part, hit

    def scan(self, texts: list[bytes]) -> Iterator[tuple[int, str, float, int, int]]:
        """(text, template, containment, first shingle of the best window, windows that match)."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        parts = [shingles(t, self.known) for t in texts]
        s, sizes = np.concatenate([*parts, np.zeros(0, np.uint64)]), np.array([len(p) for p in parts], np.int64)
        ends = np.cumsum(sizes)
        for n, templates in self.scales.items():
            step = max(1, n // 4)
            width = n + step - 1
            near = step * 2
            best: list[dict[int, list]] = [{} for _ in templates]
            for of, at, hit in self.retrieve(s, sizes, n, width, step):
                for h, (_, t, _), found in zip(hit, templates, best, strict=True):
                    for doc, start in zip(of[h].tolist(), at[h].tolist(), strict=True):
                        low, high = int(ends[doc] - sizes[doc]), int(ends[doc])
                        a, z = max(low, start - near), min(high, start + width + near)
                        share = len(np.intersect1d(t, s[a:z])) / n
                        if share >= CONTAINED:
                            now = found.setdefault(doc, [share, a - low, 0])
                            now[2] += 1
                            if share > now[0]:
                                now[0], now[1] = share, a - low
            for (name, _, _), found in zip(templates, best, strict=True):
                for doc, (share, first, count) in found.items():
                    yield doc, name, share, first, count


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, license, containment, first_word, windows: a row for each text and template that it holds."""
    small_batches(docs.sparkSession, 4)
    kind, given = docs.schema[id_col].dataType.simpleString(), templates or TEMPLATES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with np.errstate(over="ignore"):
            scanner = Scanner(given)
            for batch in batches:
                rows = sorted(scanner.scan(as_bytes(batch.column(1))))
                ids = batch.column(0).take(pa.array([r[0] for r in rows], pa.int64()))
                yield pa.RecordBatch.from_arrays([ids, pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.float64()), pa.array([r[3] for r in rows], pa.int64()), pa.array([r[4] for r in rows], pa.int64())], ["id", "license", "containment", "first_word", "windows"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {kind}, license string, containment double, first_word long, windows long")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(F.col("id").alias("doc_id"), "license", "containment", "first_word")
