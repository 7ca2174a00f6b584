"""Licence scans: TF-IDF cosine of lines and files to templates, then inheritance by directories.

Every line of a file, runs of lines and the file as a whole are compared with licence templates
(notices, headers wrapped over lines, and whole texts of short licences): sparse vectors of their
words, weighted by inverse document frequencies over all files, and the cosine. Long licences are
recognised by the notice that their text holds. An SPDX tag names its licence outright. A licence
file gives its licence to the files below its directory that name none; the nearest ancestor counts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from math import log, sqrt

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from histospark.llm.common import written

#: Parts that licence texts share, as they are commonly written.
BSD_START = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."""
BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."""
BSD_END = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
MIT_GRANT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
#: Licence notices, headers and texts as they are commonly written, by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    (
        "Apache-2.0",
        """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0
Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.""",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", MIT_GRANT),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    (
        "GPL-3.0",
        """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.
You should have received a copy of the GNU General Public License along with this program. If not, see https://www.gnu.org/licenses/.""",
    ),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-NC-4.0", "Creative Commons Attribution-NonCommercial 4.0 International Public License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Creative Commons Attribution 4.0 International Public License"),
    ("BSD-3-Clause", "\n".join((BSD_START, BSD_THIRD, BSD_END))),
    ("BSD-2-Clause", "\n".join((BSD_START, BSD_END))),
    ("ISC", ISC_TEXT),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
)
#: A tag that names the licence of its file.
TAG = re.compile(r"SPDX-License-Identifier:[ \t]*\(?([A-Za-z0-9.+-]+)")
#: Runs of lines have at most and at least so many times a template's words.
LONGEST, SHORTEST = 1.7, 0.5
#: Least cosine of a line or file to a template.
ALIKE = 0.8
#: File names that hold a directory's licence.
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)(\..*)?$"
TERM = re.compile(r"[a-z0-9]+(?:[.+-][a-z0-9]+)*")


def terms(text: str) -> list[str]:
    return TERM.findall(text.lower())


VOCABULARY = sorted({t for _, text in TEMPLATES for t in terms(text)})
#: The most frequent words, whose document frequencies every task gets; those of rarer words are joined.
COMMON = 20_000
#: Distinct words that a task holds before it passes their counts on.
HELD = 100_000


def document_frequencies(files: DataFrame) -> DataFrame:
    """term and n: how many files hold a word, of all words of at least two files; and of "", how many files there are."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter = Counter()
        for batch in batches:
            found[""] += len(batch)
            for text in batch["text"]:
                found.update(set(terms(text)) if text else ())
            if len(found) > HELD:
                yield pd.DataFrame(list(found.items()), columns=["term", "n"], dtype=object)
                found.clear()
        yield pd.DataFrame(list(found.items()), columns=["term", "n"], dtype=object)

    counts = files.select("text").mapInPandas(count, "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))
    return written(counts.where("n > 1 or term = ''"), "frequencies")


class Matcher:
    """Compares texts with the templates under given document frequencies; a word without one is in at most ``most`` files."""

    def __init__(self, files: int, counts: dict[str, int], alike: float = ALIKE, most: int = 0):
        self.alike = alike
        self.least = log((files + 1.0) / (most + 1)) + 1
        self.idf = {t: log((files + 1.0) / (n + 1)) + 1 for t, n in (dict.fromkeys(VOCABULARY, 0) | counts).items()}
        self.templates = [(name, v, sqrt(sum(x * x for x in v.values()))) for name, v in ((name, self.vector(terms(text))) for name, text in TEMPLATES)]
        self.along: dict[str, list[tuple[int, float]]] = {}
        for k, (_, v, norm) in enumerate(self.templates):
            for t, x in v.items():
                self.along.setdefault(t, []).append((k, x / norm))
        # a text that shares none of a template's anchors can't reach the least cosine with it
        own = [set(self.rarest(v, norm)) for _, v, norm in self.templates]
        self.anchors = set().union(*own)
        #: anchors, words, and each word's share of the squared length, of each template
        self.shapes = [(a, len(terms(text)), {t: (x / norm) ** 2 for t, x in v.items()}) for a, (_, text), (_, v, norm) in zip(own, TEMPLATES, self.templates, strict=True)]

    def vector(self, words: list[str]) -> dict[str, float]:
        return {t: n * self.idf.get(t, self.least) for t, n in Counter(words).items()}

    def rarest(self, v: dict[str, float], norm: float) -> list[str]:
        """The rarest terms without which the rest of the template is shorter than alike * norm."""
        left, out = norm * norm, []
        for t, x in sorted(v.items(), key=lambda p: (-self.idf[p[0]], p[0])):
            if left < (self.alike * norm) ** 2 * (1 - 1e-9):
                break
            out.append(t)
            left -= x * x
        return out

    def compare(self, found: Counter, only: int | None = None) -> tuple[str, float, float, list[tuple[str, int]]] | None:
        """Licence of the nearest template (or of one alone), the vector's length along it, the squared length of the
        words with a document frequency, and the other words; None if the cosine is surely too low."""
        if self.anchors.isdisjoint(found):
            return None
        dots, known, rest = [0.0] * len(self.templates), 0.0, []
        for t in sorted(found):  # so that equal texts get equal sums
            if t not in self.idf:
                rest.append((t, found[t]))
                continue
            x = found[t] * self.idf[t]
            known += x * x
            for k, y in self.along.get(t, ()):
                dots[k] += x * y
        length, name = max((dot, name) for k, (dot, (name, _, _)) in enumerate(zip(dots, self.templates, strict=True)) if only in (None, k))
        at_least = sqrt(known + sum((n * self.least) ** 2 for _, n in rest))
        return (name, length, known, rest) if length >= self.alike * at_least * (1 - 1e-9) else None

    def may_reach(self, k: int, held: Counter | set[str]) -> bool:
        """Whether the words of template k among these are long enough for the least cosine."""
        anchors, _, shares = self.shapes[k]
        return not anchors.isdisjoint(held) and sum(x for t, x in shares.items() if t in held) >= self.alike**2 * (1 - 1e-9)

    def runs(self, lines: list[Counter]) -> Iterator[tuple[int, tuple]]:
        """First line and comparison of runs of two lines or more that may reach a template."""
        every = set().union(*lines)
        sizes = [c.total() for c in lines]
        for k, (_, words, shares) in enumerate(self.shapes):
            if not self.may_reach(k, every):
                continue
            hit = [not shares.keys().isdisjoint(c) for c in lines]
            for start in range(len(lines)):
                if not hit[start]:
                    continue
                run, size = Counter(lines[start]), sizes[start]
                for end in range(start + 1, len(lines)):
                    size += sizes[end]
                    if size > LONGEST * words:
                        break
                    run.update(lines[end])
                    if size >= SHORTEST * words and hit[end] and self.may_reach(k, run) and (c := self.compare(run, k)):
                        yield start, c

    def candidates(self, text: str | None) -> list[tuple[int, str, float, float, list[tuple[str, int]]]]:
        """Line (from 0; -1: the file as a whole) and comparison of what may reach the least cosine."""
        lines = [Counter(terms(line)) for line in (text or "").split("\n")]
        units = [(-1, sum_of(lines)), *enumerate(lines)]
        found = [(k, *c) for k, found in units if (c := self.compare(found))]
        return found + ([(k, *c) for k, c in self.runs(lines)] if len(lines) > 1 and not self.anchors.isdisjoint(units[0][1]) else [])

    def best(self, text: str) -> tuple[float, str | None]:
        """Cosine and licence of the nearest template, words without a document frequency being as frequent as they may be."""
        v = self.vector(terms(text))
        norm = sqrt(sum(x * x for x in v.values()))
        found = [(sum(x * t.get(k, 0.0) for k, x in v.items()) / (norm * size), name) for name, t, size in self.templates] if norm else []
        return max(found, key=lambda f: (f[0], f[1]), default=(0.0, None))

    def scan(self, text: str | None) -> tuple[str | None, float, int, bool]:
        """Licence, cosine, line (from 0; -1: the file as a whole) of the best match, and whether the whole file is a licence."""
        found = [(length / sqrt(known + sum((n * self.least) ** 2 for _, n in rest)), -k, name) for k, name, length, known, rest in self.candidates(text)]
        found = [f for f in found if f[0] >= self.alike]
        score, k, name = max(found, default=(0.0, 1, None))
        return name, min(score, 1.0), -k, any(f[1] == 1 for f in found)


def tag_of(text: str | None) -> str | None:
    """The licence that the first SPDX tag of a text names."""
    found = TAG.search(text) if text and "SPDX" in text else None
    return found[1] if found else None


def sum_of(counters: list[Counter]) -> Counter:
    out: Counter = Counter()
    for c in counters:
        out.update(c)
    return out


def scan_licenses(files: DataFrame, alike: float = ALIKE, common: int = COMMON) -> DataFrame:
    """file_id, path, license_id, score, line, inherited_from, spdx_tag, for files(file_id, path, text).

    A file's own licence is that of its best line or run of lines (``line`` is its first), or of the
    file as a whole (-1), at a cosine of at least ``alike``; a run has at most LONGEST times the words
    of the template that it is compared with. ``spdx_tag`` is what the file's first SPDX tag names; it
    has no part in the cosines and the inheritance. Licence files are those of such a name with an own licence, and those that are a
    licence as a whole. A file without an own licence gets that of the nearest directory above it
    with a licence file (of several there, the one with the best score, then the least path), and
    ``inherited_from`` names that directory. Null or empty texts have no own licence; a null path is
    in no directory; repeated rows are files each.
    """
    frequencies = document_frequencies(files)
    n = sum(r["n"] for r in frequencies.where("term = ''").collect())
    words = frequencies.where("term <> ''")
    often = words.orderBy(F.desc("n"), "term").limit(common).collect()
    counts = {r["term"]: r["n"] for r in often} | {r["term"]: r["n"] for r in words.where(F.col("term").isin(VOCABULARY)).collect()}
    # a template's word that isn't among them is in one file at most; if no file holds it, it doesn't matter how rare it is
    matcher = Matcher(n, dict.fromkeys(VOCABULARY, 1) | counts, alike, most=often[-1]["n"] if len(often) == common else 1)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row = TaskContext.get().partitionId() << 33
        for batch in batches:
            units = [[{"line": k, "name": name, "along": length, "known": known, "rest": [{"term": t, "times": m} for t, m in rest]} for k, name, length, known, rest in matcher.candidates(text)] for text in batch["text"]]
            yield pd.DataFrame({"row": range(row, row + len(batch)), "file_id": batch["file_id"], "path": batch["path"], "spdx_tag": pd.Series([tag_of(t) for t in batch["text"]], dtype=object, index=batch.index), "units": units})
            row += len(batch)

    kind = files.schema["file_id"].dataType.simpleString()
    unit = "struct<line: long, name: string, along: double, known: double, rest: array<struct<term: string, times: long>>>"
    rows = written(files.select("file_id", "path", "text").mapInPandas(scan, f"row long, file_id {kind}, path string, spdx_tag string, units array<{unit}>"), "candidates")
    units = rows.select("row", F.posexplode("units").alias("unit", "u")).select("row", "unit", "u.*")
    # what isn't among the frequencies is in one file
    idf = F.log((n + 1.0) / (F.coalesce("n", F.lit(1)) + 1)) + 1
    rest = units.select("row", "unit", F.inline("rest")).join(words, "term", "left").groupBy("row", "unit").agg(F.sort_array(F.collect_list(F.struct("term", F.pow(F.col("times") * idf, 2).alias("x")))).alias("rest"))
    square = F.coalesce(F.aggregate("rest", F.lit(0.0), lambda a, w: a + w["x"]), F.lit(0.0)) + F.col("known")
    scored = units.drop("rest").join(rest, ["row", "unit"], "left").withColumn("score", F.col("along") / F.sqrt(square)).where(F.col("score") >= alike)
    top = scored.groupBy("row").agg(F.max(F.struct("score", (-F.col("line")).alias("before"), "name")).alias("top"), F.max(F.col("line") == -1).alias("whole"))
    best = top.select("row", "whole", F.col("top.name").alias("license_id"), F.least(F.col("top.score"), F.lit(1.0)).alias("score"), (-F.col("top.before")).alias("line"))
    scanned = rows.drop("units").join(best, "row", "left").drop("row").fillna({"whole": False, "score": 0.0, "line": -1})
    scanned = written(scanned.withColumn("dir", F.regexp_replace("path", r"/?[^/]*$", "")), "licences")
    named = F.col("whole") | F.regexp_replace("path", r"^.*/", "").rlike(LICENCE_FILE)
    declared = scanned.where(F.col("license_id").isNotNull() & F.col("path").isNotNull() & named).groupBy("dir").agg(F.min(F.struct(-F.col("score"), "path", "license_id"))["license_id"].alias("dir_license"))
    # ancestors are joined once for each directory, not for each file
    places = scanned.where("dir is not null").select("dir").distinct()
    labels = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(labels)), lambda k: F.array_join(F.slice(labels, 1, k), "/"))
    up = places.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "ancestor"))
    nearest = up.join(declared.withColumnRenamed("dir", "ancestor"), "ancestor").groupBy("dir").agg(F.max(F.struct("depth", "ancestor", "dir_license")).alias("near"))
    joined = scanned.join(nearest, "dir", "left")
    own = F.col("license_id").isNotNull()
    return joined.select("file_id", "path", F.coalesce("license_id", F.col("near.dir_license")).alias("license_id"), "score", "line", F.when(~own, F.col("near.ancestor")).alias("inherited_from"), "spdx_tag")
