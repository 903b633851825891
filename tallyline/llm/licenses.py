"""License scans: normalised text against licence templates by Dice coefficient over word bigrams."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from importlib import resources

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textspans as ts

# Public notices and short licence texts that the scan compares with.
NOTICES: tuple[tuple[str, str], ...] = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("CC-BY-4.0", "This work is licensed under the Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."""),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("AGPL-3.0", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Affero General Public License for more details."""),
    ("BSD-2-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("BSL-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details. You should have received a copy of the GNU General Public License along with this program; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-2.1", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version. This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU Lesser General Public License for more details."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("WTFPL", "Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed. DO WHAT THE FUCK YOU WANT TO PUBLIC LICENSE TERMS AND CONDITIONS FOR COPYING, DISTRIBUTION AND MODIFICATION 0. You just DO WHAT THE FUCK YOU WANT TO."),
    ("Zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""),
)
#: Least Dice coefficient.
THRESHOLD = Fraction(4, 5)
_WORD = np.isin(np.arange(256), [*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)])


def full_texts() -> tuple[tuple[str, str], ...]:
    """The whole licences of licence_texts/, named by their files."""
    found = (f for f in resources.files(__package__).joinpath("licence_texts").iterdir() if f.name.endswith(".txt"))
    return tuple((f.name.removesuffix(".txt"), f.read_text("utf-8")) for f in sorted(found, key=lambda f: f.name))


def _bigrams(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bigram hashes of normalised text (A-Z as a-z, only letters, digits and characters beyond ASCII count as word
    parts), the bytes at which each begins and ends, and the offsets of the texts into them."""
    s, e, wo = ts.runs(_WORD[buf], offs)
    h, at = ts.windows(ts.span_hashes(buf, s, e, lower=True), wo, 2)
    return h, s[at], e[at + 1] if len(at) else e[:0], np.searchsorted(at, wo)


def best_run(hits: np.ndarray, gain: int, loss: int, longest: int) -> tuple[int, int]:
    """The run i..j (end exclusive) of at most `longest` places that maximises gain * hits - loss * places: the first end of
    equals, then the latest start."""
    n = len(hits)
    sums = np.concatenate([[0], np.cumsum(hits * gain - loss)])
    size = min(longest, n)
    pad = -(n + 1) % size
    low = np.concatenate([sums, np.full(pad, np.iinfo(np.int64).max)]).reshape(-1, size)
    ahead, behind = np.minimum.accumulate(low, 1).ravel(), np.minimum.accumulate(low[:, ::-1], 1)[:, ::-1].ravel()
    begin = np.maximum(np.arange(n) - size + 1, 0)
    least = np.minimum(behind[begin], ahead[np.arange(n)])  # of sums[begin..j]: a window meets two blocks at most
    if size > 1:
        short = np.arange(n) < size - 1
        least[short] = ahead[np.arange(n)[short]]
    j = int((sums[1:] - least).argmax())
    window = sums[begin[j] : j + 1]
    return int(begin[j] + len(window) - 1 - window[::-1].argmin()), j + 1


class _Templates:
    def __init__(self, templates: tuple[tuple[str, str], ...]):
        self.names, self.sets, self.longest = [n for n, _ in templates], [], []
        for _, text in templates:
            raw = np.frombuffer(text.encode(), np.uint8)
            h = _bigrams(raw, np.array([0, len(raw)]))[0]
            self.sets.append(np.unique(h))
            self.longest.append(len(h))
        self.all = np.unique(np.concatenate(self.sets))
        self.holds = np.stack([np.isin(self.all, s) for s in self.sets])

    def scan(self, buf: np.ndarray, offs: np.ndarray, threshold: Fraction) -> list[tuple[int, int, int, int, int, int]]:
        """(document, byte start, byte end, template, shared bigrams, sum of set sizes) of each unit that reaches the
        threshold with a template."""
        num, den = threshold.numerator, threshold.denominator
        h, begin, end, cuts = _bigrams(buf, offs)
        at = np.minimum(np.searchsorted(self.all, h), len(self.all) - 1)
        known = np.flatnonzero(self.all[at] == h)
        out = []
        for t, own in enumerate(self.sets):
            # size bound: 2 shared >= threshold * (unit + template) and unit >= shared
            need = -(-num * len(own) // (2 * den - num))
            mine = known[self.holds[t][at[known]]]
            first = np.searchsorted(mine, cuts)
            for d in np.flatnonzero(np.diff(first) >= max(need, 1)).tolist():
                low, high = int(cuts[d]), int(cuts[d + 1])
                hits = np.zeros(high - low, np.int64)
                hits[mine[first[d] : first[d + 1]] - low] = 1
                longest = max(int(self.longest[t] * (2 * den - num) / num), 1)
                units, todo = {(0, high - low)}, [(0, high - low)]
                while todo:
                    a, b = todo.pop()
                    if hits[a:b].sum() < max(need, 1):
                        continue
                    i, j = best_run(hits[a:b], 2 * den, num, longest)
                    units.add((a + i, a + j))
                    todo += [(a, a + i), (a + j, b)]
                for i, j in units:
                    found = np.unique(h[low + i : low + j])
                    both = len(found) + len(own)
                    if 2 * min(len(found), len(own)) * den < num * both:
                        continue
                    shared = len(np.intersect1d(found, own, assume_unique=True))
                    if 2 * shared * den >= num * both:
                        out.append((d, int(begin[low + i] - offs[d]), int(end[low + j - 1] - offs[d]), t, shared, both))
        return out


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] | None = None, threshold: Fraction = THRESHOLD) -> DataFrame:
    """One row per document and licence found: id, license, n_units, best_dice (six decimals), byte_start, byte_end of
    the best unit (the first of equals).

    For each template, units are the whole text and runs of words: the run that maximises the bigrams it shares less
    threshold / 2 of all its bigrams, among those short enough to reach the threshold, then the best ones left and
    right of it, and so on. So a notice is found inside a line, and a licence among other paragraphs or behind comment
    marks, whatever the line ends. A text that holds fewer bigrams of a template than the set sizes
    demand is not compared with it. Templates (default: NOTICES and full_texts()) are a list of bounded size and travel with the task.

    Defined cases: null, empty and wordless texts match nothing; null ids and repeated rows are scanned per row; ties
    between templates of one licence count once; an empty table gives an empty result; other columns are ignored.
    """

    templates = templates or NOTICES + full_texts()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Templates(templates)
        for batch in batches:
            ids = batch.column(0)
            for lo, _, buf, offs in ts.text_chunks(batch.column(1)):
                best: dict[tuple[int, str], list] = {}
                units: dict[tuple[int, str], set] = {}
                for doc, a, b, t, shared, both in known.scan(buf, offs, threshold):
                    key, new = (doc, known.names[t]), [2 * shared / both, a, b]
                    units.setdefault(key, set()).add((a, b))
                    if key not in best or (-new[0], a, b) < (-best[key][0], *best[key][1:]):
                        best[key] = new
                keys = sorted(best)
                at = pa.array([lo + d for d, _ in keys], pa.int64())
                cols = [[best[k][0] for k in keys], [best[k][1] for k in keys], [best[k][2] for k in keys]]
                yield pa.RecordBatch.from_arrays([ids.take(at), pa.array([k[1] for k in keys], pa.string()), pa.array([len(units[k]) for k in keys], pa.int64()), pa.array([round(x, 6) for x in cols[0]], pa.float64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], ["id", "license", "n_units", "best_dice", "byte_start", "byte_end"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "id long, license string, n_units long, best_dice double, byte_start long, byte_end long").withColumnRenamed("id", id_col)
