"""Licence scan: texts, their paragraphs, lines and word windows against licence templates, by Dice coefficient of word bigrams."""

from __future__ import annotations

import math
import os
import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .shared import LOWER, WORD, Words, blocks, bounded, buffers

LEAST = 0.8

#: Short notices, file headers and whole texts of licences, as their publishers word them; of the long licences the notice that stands in files.
TEMPLATES = {
    "0BSD": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "AGPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details. You should have received a copy of the GNU Affero General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    "Apache-2.0": 'Licensed under the Apache License, Version 2.0.',
    "Apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "BSD-2-Clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.',
    "BSD-2-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSD-3-Clause": 'Licensed under the BSD 3-Clause License.',
    "BSD-3-Clause-text": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "BSL-1.0": 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "CC-BY-4.0": 'Licensed under CC BY 4.0.',
    "CC-BY-4.0-notice": 'This work is licensed under a Creative Commons Attribution 4.0 International License.',
    "CC-BY-NC-4.0": 'Licensed under CC BY-NC 4.0.',
    "CC-BY-NC-4.0-notice": 'This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.',
    "CC-BY-SA-4.0": 'Licensed under CC BY-SA 4.0.',
    "CC-BY-SA-4.0-notice": 'This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.',
    "CC0-1.0": 'To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.',
    "GPL-2.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    "GPL-3.0": 'This work is licensed under the GNU General Public License, version 3.',
    "GPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    "ISC": 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.',
    "LGPL-3.0-header": 'This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details. You should have received a copy of the GNU Lesser General Public License along with this program. If not, see <https://www.gnu.org/licenses/>.',
    "MIT": 'Released under the MIT License.',
    "MIT-text": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "MPL-2.0": 'This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.',
    "Unlicense": 'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "WTFPL": 'DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO.',
    "Zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
}

#: A folder with whole texts of long licences, a file each, as Debian systems have it. Without it there are only TEMPLATES.
FOLDER = "/usr/share/common-licenses"
#: The most bytes of such a folder; its index is broadcast.
MOST_BYTES = 8 << 20


def whole_texts(folder: str = FOLDER) -> dict[str, str]:
    """Licence texts of a folder by the names of their files, with "-text" behind them.

    The files are read by the driver, which broadcasts them; more than MOST_BYTES in all is an error. Of equal texts one stays,
    under the longest of their names. No folder, or one without files, gives no texts; bytes that are no UTF-8 are replaced.
    """
    if not os.path.isdir(folder):
        return {}
    paths = [os.path.join(folder, x) for x in sorted(os.listdir(folder), key=lambda x: (-len(x), x))]
    paths = [x for x in paths if os.path.isfile(x)]
    if sum(map(os.path.getsize, paths)) > MOST_BYTES:
        raise ValueError(f"{folder} holds more than {MOST_BYTES} bytes of licence texts")
    names: dict[str, str] = {}
    for path in paths:
        with open(path, encoding="utf-8", errors="replace") as file:
            names.setdefault(file.read().replace("\x00", " "), os.path.basename(path) + "-text")
    return {name: text for text, name in sorted(names.items(), key=lambda x: x[1])}


_BREAK = re.compile(rb"\n[ \t\r]*\n")
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def _bigrams(raw: bytes) -> frozenset[tuple[bytes, bytes]]:
    words = _WORD.findall(raw)
    return frozenset(zip(words, words[1:]))


def _lowered(text: str) -> bytes:
    return LOWER[np.frombuffer(text.encode(), np.uint8)].tobytes()


class _Index:
    def __init__(self, templates: dict[str, str], least: float):
        self.least = least
        self.names = sorted(templates)
        self.grams = [_bigrams(_lowered(templates[x])) for x in self.names]
        data, at = buffers(pa.array([templates[x] for x in self.names], pa.string()))
        words = Words(data, at, WORD)
        begin, hashes = words.windows(2)
        owner = np.searchsorted(words.first, begin, "right") - 1
        self.known = np.unique(hashes)
        pairs = np.unique(np.stack([np.searchsorted(self.known, hashes), owner]), axis=1)
        self.first = np.searchsorted(pairs[0], np.arange(len(self.known) + 1))
        self.owner = pairs[1]
        # A unit of a bigrams that shares o of a template's b has 2 o / (a + b) >= least only if o >= least b / (2 - least), as a >= o.
        self.needed = np.array([math.ceil(least * len(g) / (2 - least) - 1e-9) for g in self.grams])

    def candidates(self, data: np.ndarray, at: np.ndarray) -> dict[int, list[int]]:
        """The templates of which each text holds enough bigrams, wherever they stand."""
        n, m = len(at) - 1, len(self.names)
        words = Words(data, at, WORD)
        begin, hashes = words.windows(2)
        if not len(begin) or not len(self.known):
            return {}
        where = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        hit = np.flatnonzero(self.known[where] == hashes)
        text = np.searchsorted(words.first, begin[hit], "right") - 1
        grams = np.unique(text * len(self.known) + where[hit])
        text, gram = grams // len(self.known), grams % len(self.known)
        times = self.first[gram + 1] - self.first[gram]
        ends = np.cumsum(times)
        owners = self.owner[np.repeat(self.first[gram] + times - ends, times) + np.arange(times.sum())]
        counts = np.bincount(np.repeat(text, times) * m + owners, minlength=n * m).reshape(n, m)
        found: dict[int, list[int]] = {}
        for d, k in zip(*np.nonzero(counts >= self.needed)):
            found.setdefault(int(d), []).append(int(k))
        return found

    def windows(self, grams: list[int], template: int, known: dict[tuple[bytes, bytes], int], reached: np.ndarray) -> list[tuple[float, int, int]]:
        """(Dice, first, last bigram) of the best run of bigrams from each place on that can be one's best start.

        A run that starts or ends with a bigram which the template lacks, or which the run holds again, is no better
        than the run without it. So the runs that pass any one place start with different bigrams of the template.
        reached: the best Dice that is reported for each word. A run has to pass that of its first two words, so a
        place behind which too few bigrams of the template are left starts none.
        """
        both = self.grams[template]
        wanted = {known[g] for g in both if g in known}
        n = len(both)
        left, later = [0] * len(grams), set()
        for i in range(len(grams) - 1, -1, -1):
            if grams[i] in wanted:
                later.add(grams[i])
            left[i] = len(later)
        bars = np.maximum(np.maximum(reached[:-1], reached[1:]), self.least)
        # As for `needed`: what a run must share, and how many bigrams it may have.
        needed, mosts = (bars * n / (2 - bars) - 1e-9).tolist(), (n * (2 - bars) / bars + 1e-9).tolist()
        out = []
        for i, start in enumerate(grams):
            if start not in wanted or left[i] < needed[i]:
                continue
            most, seen, shared, best, last = mosts[i], {start}, 1, 2 / (1 + n), i
            for j in range(i + 1, len(grams)):
                g = grams[j]
                if g == start:
                    break
                if g in seen:
                    continue
                seen.add(g)
                if len(seen) > most:
                    break
                if g in wanted:
                    shared += 1
                    dice = 2 * shared / (len(seen) + n)
                    if dice > best:
                        best, last = dice, j
            if best >= bars[i]:
                out.append((best, i, last))
        return out

    def matches(self, raw: bytes, templates: list[int]) -> list[tuple[int, int, int, float]]:
        """(start byte, end byte, template, Dice) of units and better windows of one lower-cased text."""
        units = {(0, len(raw))}
        for mark in (_BREAK, re.compile(rb"\n")):
            low = 0
            for gap in [*mark.finditer(raw), None]:
                units.add((low, gap.start() if gap else len(raw)))
                low = gap.end() if gap else low
        out = []
        for low, high in sorted(units):
            own = _bigrams(raw[low:high])
            for k in templates:
                both = self.grams[k]
                # Size bounds: Dice cannot be reached if one side is so much larger.
                if not own or not self.least / (2 - self.least) <= len(own) / len(both) <= (2 - self.least) / self.least:
                    continue
                dice = 2 * len(own & both) / (len(own) + len(both))
                if dice >= self.least:
                    out.append((low, high, k, dice))
        words = [x.span() for x in _WORD.finditer(raw)]
        known: dict[tuple[bytes, bytes], int] = {}
        grams = [known.setdefault((raw[a:b], raw[c:d]), len(known)) for (a, b), (c, d) in zip(words, words[1:])]
        begins = [a for a, _ in words]
        units = list(out)
        for k in templates:
            # The best Dice that is reported for each word.
            best = np.zeros(len(words))
            for low, high, of, dice in units:
                if of == k:
                    part = slice(bisect_left(begins, low), bisect_left(begins, high))
                    best[part] = np.maximum(best[part], dice)
            for dice, i, j in sorted(self.windows(grams, k, known, best), key=lambda x: (-x[0], x[1])):
                if best[i : j + 2].max() < dice:
                    best[i : j + 2] = dice
                    out.append((words[i][0], words[j + 1][1], k, dice))
        return sorted(out)


_MATCHES = T.ArrayType(T.StructType([T.StructField("license", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("dice", T.DoubleType())]))
_ARROW = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("dice", pa.float64())]))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = LEAST) -> DataFrame:
    """Adds license_matches: (license, start, end, dice) of units that come close to a licence template.

    Units are the whole text, its paragraphs (between blank lines) and its lines; places are code points. A run of
    words that is no unit is reported too if no unit or other run that overlaps it comes as close to the template. Words
    are runs of letters, digits and code points over 127, A-Z lowered; a unit's bigrams are a set. Every unit
    with a Dice coefficient of `least` or more is reported with every template that it reaches, by place and
    name. Null and empty texts and texts of one word match nothing; equal rows get equal results; a column that
    is called license_matches is replaced. Templates without two words match nothing.
    """
    docs = bounded(docs).drop("license_matches")
    given = TEMPLATES if templates is None else templates
    index = docs.sparkSession.sparkContext.broadcast(_Index({k: v for k, v in given.items() if _bigrams(_lowered(v))}, least))

    def run(batches):
        for rows, data, at in blocks(batches):
            known = index.value
            found: list[list[dict]] = [[] for _ in range(rows.num_rows)]
            for d, some in known.candidates(data, at).items():
                own = LOWER[data[at[d] : at[d + 1]]]
                got = known.matches(own.tobytes(), some)
                if got:
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    found[d] = [{"license": known.names[k], "start": int(points[a]), "end": int(points[b]), "dice": x} for a, b, k, x in got]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(found, _ARROW)], names=[*rows.schema.names, "license_matches"])

    return docs.mapInArrow(run, T.StructType(docs.schema.fields + [T.StructField("license_matches", _MATCHES)]))


def all_templates() -> dict[str, str]:
    """TEMPLATES and the whole texts of FOLDER, which has to hold some: long licences would go unfound without a word otherwise."""
    given = whole_texts()
    if not given:
        raise FileNotFoundError(f"{FOLDER} holds no licence texts on the driver, so long licences could not be found")
    return TEMPLATES | given


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), all_templates())
    return found.select(
        "doc_id",
        F.size("license_matches").cast("long").alias("n_matches"),
        F.array_join(F.sort_array(F.array_distinct("license_matches.license")), ",").alias("licenses"),
        F.round(F.coalesce(F.array_max("license_matches.dice"), F.lit(0.0)), 6).alias("best_dice"),
    )


def _sql() -> str:
    values = ",\n".join("('" + k + "', '" + v.replace("'", "''") + "')" for k, v in (TEMPLATES | whole_texts()).items())
    words = lambda c: f"regexp_extract_all(translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    grams = "list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))"
    return f"""
WITH t(license, body) AS (VALUES {values}),
tw AS (SELECT license, {words('body')} AS w FROM t),
tg AS (SELECT license, {grams} AS g FROM tw),
d AS (SELECT doc_id, row_number() OVER () AS rid, coalesce(text, '') AS text FROM documents),
-- Lines and paragraphs with their numbers; one that is its whole text is the whole text.
lines AS (SELECT rid, string_split(text, chr(10)) AS u, text FROM d),
paragraphs AS (SELECT rid, string_split_regex(text, '\\n[ \\t\\r]*\\n') AS u, text FROM d),
units AS (
  SELECT rid, text AS unit FROM d
  UNION ALL SELECT rid, unnest(u) FROM lines WHERE len(u) > 1
  UNION ALL SELECT rid, unnest(u) FROM paragraphs WHERE len(u) > 1
),
uw AS (SELECT rid, {words('unit')} AS w FROM units),
ug AS (SELECT rid, {grams} AS g FROM uw WHERE len(w) > 1),
s AS (SELECT rid, license, len(list_intersect(ug.g, tg.g)) AS o, len(ug.g) AS a, len(tg.g) AS b
      FROM ug JOIN tg ON len(ug.g) * 1.2 >= len(tg.g) * 0.8 AND len(tg.g) * 1.2 >= len(ug.g) * 0.8),
m AS (SELECT rid, license, 2.0 * o / (a + b) AS dice FROM s WHERE 20 * o >= 8 * (a + b)),
r AS (SELECT rid, count(*) AS n, string_agg(DISTINCT license, ',' ORDER BY license) AS l, max(dice) AS dice FROM m GROUP BY rid)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_matches, coalesce(l, '') AS licenses, round(CAST(coalesce(dice, 0) AS DOUBLE), 6) AS best_dice
FROM d LEFT JOIN r USING (rid)
"""


SQL = _sql()
