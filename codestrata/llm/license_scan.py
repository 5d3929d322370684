"""License scans: TF-IDF cosine to templates, then inheritance from the nearest directory with a licence file."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut
from .common import lookup

_AS_IS = "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (
    _BSD + " 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    ' THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.'
    " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS;"
    " OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"


def _gnu(name: str, version: str, what: str = "program") -> str:
    """The notice by which a GNU licence is applied, as its text words it."""
    start = f"This {what} is free software{':' if version[0] == '3' else ';'} you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."
    middle = f" This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {name} for more details."
    return start + middle + f" You should have received a copy of the GNU {name} along with this {what}. If not, see <https://www.gnu.org/licenses/>."


# Public notices by which licences are declared, by their SPDX identifiers, in short and as published.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'
        ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'
        " See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("BSD-2-Clause", _BSD_2 + _BSD_END),
    ("BSD-3-Clause", _BSD_2 + _BSD_3 + _BSD_END),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
        ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.'
        " IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,"
        " WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    (
        "MIT",
        _GRANT + ' (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,'
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        + _AS_IS
        + " IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
)
_TERM = re.compile(r"[a-z0-9]+(?:[.-][a-z0-9]+)*")
_TERM_OR_BREAK = re.compile(rf"{_TERM.pattern}|\n")
#: Distinct terms that a task counts before it hands them on.
_HELD = 500_000


def terms(text: str) -> list[str]:
    return _TERM.findall(text.lower())


_COUNTS = tuple(Counter(terms(text)) for _, text in TEMPLATES)
_SIZES = tuple(c.total() for c in _COUNTS)
VOCABULARY = tuple(sorted({t for c in _COUNTS for t in c}))


def _local_df(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def flush():
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["term", "df"])

    seen: Counter = Counter()
    for batch in batches:
        for text in batch.column("text"):
            seen.update({"", *terms(text.as_py() or "")})
            if len(seen) > _HELD:
                yield flush()
                seen.clear()
    yield flush()


def document_frequencies(docs: DataFrame) -> DataFrame:
    """term, df of all terms of all documents; "" counts the documents."""
    return cut(docs.select("text").mapInArrow(_local_df, "term string, df long").groupBy("term").agg(F.sum("df").alias("df")))


def _idf(n: int, df: int) -> float:
    return math.log((1 + n) / (1 + df)) + 1


class Finder:
    """Spans of a text that may reach a cosine: every line, every window as long as a template, the whole of a licence file.

    The bounds hold whatever the weights of terms outside the templates are, as none is below 1.
    """

    def __init__(self, idf: dict[str, float], least: float):
        self.place = {t: i + 1 for i, t in enumerate(VOCABULARY)} | {"\n": -1}
        w = np.array([1.0, *(idf[t] for t in VOCABULARY)])
        tf = np.array([[0, *(c[t] for t in VOCABULARY)] for c in _COUNTS], float)
        unit = tf * w / np.sqrt(((tf * w) ** 2).sum(axis=1, keepdims=True))
        self.dot, self.share, self.square, self.least = unit * w, unit**2, w**2, least - 1e-9

    def find(self, text: str, whole: bool) -> tuple[list[str], list[tuple[int, int, int, int]]]:
        """Terms of the spans in order, and runs (template, first and last start, length) of spans among them."""
        found = _TERM_OR_BREAK.findall(text.lower())
        ids = np.fromiter((self.place.get(t, 0) for t in found), np.int64, len(found))
        is_term = ids >= 0
        n = int(is_term.sum())
        present = np.bincount(ids[is_term], minlength=len(self.square))[: len(self.square)] > 0
        present[0] = False
        # no span has a higher cosine than the part of the template that the text has at all
        fits = np.flatnonzero(np.sqrt(self.share @ present) >= self.least)
        if not len(fits):
            return [], []
        ends = np.unique(np.concatenate([[0], np.cumsum(is_term)[~is_term], [n]]))
        ids = ids[is_term]
        norm = np.concatenate([[0.0], np.cumsum(self.square[ids])])
        runs: list[tuple[int, int, int, int]] = []
        for no in fits.tolist():
            dot = np.concatenate([[0.0], np.cumsum(self.dot[no][ids])])
            m = min(_SIZES[no], n)
            at = np.flatnonzero(dot[m:] - dot[:-m] + 1e-6 >= self.least * np.sqrt(norm[m:] - norm[:-m]))
            for run in np.split(at, np.flatnonzero(np.diff(at) > 1) + 1) if len(at) else ():
                runs.append((no, int(run[0]), int(run[-1]), m))
            lines = dot[ends[1:]] - dot[ends[:-1]] + 1e-6 >= self.least * np.sqrt(norm[ends[1:]] - norm[ends[:-1]])
            runs += [(no, a, a, b - a) for a, b in zip(ends[:-1][lines].tolist(), ends[1:][lines].tolist(), strict=True)]
            if whole and dot[n] + 1e-6 >= self.least * math.sqrt(norm[n]):
                runs.append((no, 0, 0, n))
        edge = np.zeros(n + 1, np.int64)
        for _, a, b, m in runs:
            edge[a] += 1
            edge[b + m] -= 1
        kept = np.cumsum(edge)[:n] > 0
        to = np.cumsum(kept) - 1
        words = [t for t in found if t != "\n"]
        return [words[i] for i in np.flatnonzero(kept).tolist()], [(no, int(to[a]), int(to[b]), m) for no, a, b, m in runs]


def best(words: list[str], runs: list[tuple[int, int, int, int]], idf: dict[str, float], least: float) -> tuple[str | None, float]:
    """Best span as (licence, cosine); ties go to the longer, then the earlier template."""
    w = [idf[t] for t in words]
    top: tuple[float, int, int] | None = None
    for no, first, last, m in runs:
        tf = _COUNTS[no]
        size = math.sqrt(sum((c * idf[t]) ** 2 for t, c in tf.items()))
        seen: Counter = Counter()
        norm = dot = 0.0
        for i in range(first, last + m):
            t = words[i]
            norm += w[i] ** 2 * (2 * seen[t] + 1)
            dot += w[i] ** 2 * tf[t]
            seen[t] += 1
            if i - first >= m:
                t = words[i - m]
                seen[t] -= 1
                norm -= w[i - m] ** 2 * (2 * seen[t] + 1)
                dot -= w[i - m] ** 2 * tf[t]
            if i - first >= m - 1:
                cosine = round(dot / (math.sqrt(norm) * size), 9)
                if cosine >= least and (top is None or (cosine, _SIZES[no], -no) > top):
                    top = cosine, _SIZES[no], -no
    return (None, 0.0) if top is None else (TEMPLATES[-top[2]][0], top[0])


_RUN = pa.struct([(c, pa.int32()) for c in ("no", "first", "last", "size")])


def _spans(idf: dict[str, float], least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(idf, least)
        for batch in batches:
            words, outside, runs = [], [], []
            for text, whole in zip(batch.column("text"), batch.column("is_file"), strict=True):
                w, r = finder.find(text.as_py() or "", bool(whole.as_py()))
                words.append(w)
                outside.append(sorted({t for t in w if t not in finder.place}))
                runs.append([dict(zip(("no", "first", "last", "size"), x, strict=True)) for x in r])
            listed = pa.list_(pa.string())
            columns = [c for c in batch.schema.names if c not in ("text", "is_file")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array(words, listed), pa.array(outside, listed), pa.array(runs, pa.list_(_RUN))], [*columns, "words", "outside", "runs"]
            )

    return run


def _score(idf: dict[str, float], n: int, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for words, runs, seen in zip(batch.column("words").to_pylist(), batch.column("runs").to_pylist(), batch.column("seen").to_pylist(), strict=True):
                known = idf | {x["term"]: _idf(n, x["df"]) for x in seen or ()}
                found.append(best(words, [(x["no"], x["first"], x["last"], x["size"]) for x in runs], known, least) if runs else (None, 0.0))
            columns = [c for c in batch.schema.names if c not in ("words", "runs", "seen")]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in columns), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], [*columns, "own", "cosine"]
            )

    return run


_IS_FILE = r"(?i)^(?:licen[sc]e|copying)(?:[.-].*)?$"


def own_licenses(rows: DataFrame, least: float) -> DataFrame:
    """doc_id, path, own licence, cosine. Terms outside the templates are weighed by a join with their document frequencies."""
    types = dict(rows.dtypes)
    df = document_frequencies(rows)
    listed = df.where(F.col("term").isin("", *VOCABULARY)).toArrow()
    of = dict(zip(listed["term"].to_pylist(), listed["df"].to_pylist(), strict=True))
    n = of.pop("", 0)
    idf = {t: _idf(n, of.get(t, 0)) for t in VOCABULARY}
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(_IS_FILE)
    schema = f"doc_id {types['doc_id']}, path string, words array<string>, outside array<string>, runs array<struct<no:int,first:int,last:int,size:int>>"
    found = cut(rows.withColumn("is_file", is_file).mapInArrow(_spans(idf, least), schema).withColumn("rid", F.monotonically_increasing_id()))
    pairs = found.select("rid", F.explode("outside").alias("term"))
    needed = cut(df.join(pairs.select("term").distinct(), "term", "left_semi"))
    seen = pairs.join(lookup(needed, needed.count()), "term").groupBy("rid").agg(F.collect_list(F.struct("term", "df")).alias("seen"))
    open_ = found.where(F.size("runs") > 0).select("doc_id", "path", "words", "runs", "rid").join(seen, "rid", "left").drop("rid")
    schema = f"doc_id {types['doc_id']}, path string, own string, cosine double"
    none = found.where(F.size("runs") == 0).select("doc_id", "path", F.lit(None).cast("string").alias("own"), F.lit(0.0).alias("cosine"))
    return cut(open_.mapInArrow(_score(idf, n, least), schema).unionByName(none))


def licenses(files: DataFrame, least: float = 0.6) -> DataFrame:
    """One row per file: doc_id, path, license, how (header, inherited or null), cosine (of its own best span), from_dir.

    ``files``: doc_id, path, text.  Every line of every whole text, every window of words as long as a template (line breaks
    do not count) and the whole of a licence file are compared with the templates; a file's own licence is that of the
    best span with a cosine of at least ``least``.  A file called LICENSE, LICENCE or COPYING (with any suffix) with a licence of its
    own gives it to its directory, and a file without one takes that of its nearest ancestor directory that has one. Of several
    licence files in a directory the one with the highest cosine, then the first name counts.

    Directories meet by an equi-join on the path of each ancestor; files are first reduced to their distinct
    directories. Null texts have no licence of their own, null paths inherit nothing, files in the top directory look
    at the top only, repeated rows get equal rows, an empty table gives an empty table.
    """
    own = own_licenses(files.select("doc_id", "path", "text"), least)
    own = own.withColumn("dir", F.regexp_replace("path", r"(?:^|/)[^/]*$", ""))
    is_file = F.regexp_extract("path", r"([^/]*)$", 1).rlike(_IS_FILE)
    given = own.where(is_file & F.col("own").isNotNull()).groupBy("dir").agg(F.max(F.struct("cosine", F.col("path").isNotNull(), "own")).getField("own").alias("given"))
    given = given.select(F.col("dir").alias("at"), "given")
    dirs = own.where(F.col("own").isNull() & F.col("path").isNotNull()).select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(steps)), lambda n: F.array_join(F.slice(steps, F.lit(1), n), "/")))
    nearest = (
        dirs.select("dir", F.explode(F.array_distinct(above)).alias("at"))
        .join(given, "at")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("at").alias("depth"), F.col("at"), F.col("given"))).alias("x"))
        .select(F.col("dir").alias("_dir"), F.col("x.at").alias("at"), F.col("x.given").alias("given"))
    )
    joined = own.join(nearest, F.col("own").isNull() & (F.col("dir") == F.col("_dir")), "left")
    return joined.select(
        "doc_id",
        "path",
        F.coalesce("own", "given").alias("license"),
        F.when(F.col("own").isNotNull(), "header").when(F.col("given").isNotNull(), "inherited").alias("how"),
        "cosine",
        F.when(F.col("own").isNull(), F.col("at")).alias("from_dir"),
    )


def file_paths(docs: DataFrame) -> DataFrame:
    """Paths for a table that has none: source / language / hundred of the id; every twentieth document is a LICENSE file.

    A third of the licence files lie in each of the three depths.
    """
    k = F.coalesce(F.col("doc_id"), F.lit(0))
    is_file = k % 20 == 0
    deep = F.when(is_file, F.floor(k / 20) % 3).otherwise(2)
    parts: list[Column] = [
        F.coalesce("source", F.lit("none")),
        F.when(deep >= 1, F.coalesce("lang", F.lit("und"))),
        F.when(deep >= 2, F.concat(F.lit("d"), F.floor(k / 100))),
        F.when(is_file, F.concat(F.lit("LICENSE-"), k)).otherwise(F.concat(k, F.lit(".txt"))),
    ]
    return docs.select("doc_id", F.concat_ws("/", *parts).alias("path"), "text")
