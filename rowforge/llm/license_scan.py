"""Licence scans: TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

A file's headers are the passages around words that speak of licences, wherever they stand in
the whole text: the sentence, the line and the paragraph, however long. Each is a sparse TF-IDF vector of words and word pairs;
document frequencies are counted over the passages of all files. A file declares the licence of the
template with the highest cosine, if it reaches `threshold`.

A file with such words is also compared as a whole with the full texts of licences (folder `licences`): if the highest cosine
reaches `threshold` and at least `file_share` of its words stand in word pairs of that full text, the file declares that licence.

A licence file is one named so, or one of whose words at least `file_share` are licence text: in word pairs of the full text it
matches, or in the union of the passages that reach `threshold` for the declared licence. The
best licence file of a directory speaks for it; a file that declares nothing takes the licence of
its nearest ancestor directory that has one, found by joining directories with their ancestors (each directory once, not each file).

Defined cases: null and empty texts declare nothing; a null path has no directory and inherits nothing; in op6 a null source or language is a folder of its own and a null id a file of its name; equal
cosines go to the template that stands first, equal licence files of a directory to the smaller path;
repeated rows get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common as C

THRESHOLD, FILE_SHARE, BINS = 0.5, 0.5, 1 << 15
LICENCE_FILE = r"(?i)(^|/)(licen[cs]e|copying|notice|unlicense|copyright)([.-][^/]*)?$"
CUE = r"licen[cs]e|copyright|spdx|warrant|all rights reserved|public domain|creative commons|redistribut"

#: Short texts of licences, as headers and notices state them.
TEMPLATES = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License. See LICENSE in the project root for license information."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", "SPDX-License-Identifier: LGPL-3.0-or-later"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "SPDX-License-Identifier: AGPL-3.0-or-later"),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", "SPDX-License-Identifier: BSD-2-Clause"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("ISC", "Licensed under the ISC License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal, a Creative Commons license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Proprietary", "Copyright. All rights reserved. Confidential and proprietary. Unauthorized copying of this file is strictly prohibited."),
]

_CUE = re.compile(CUE.encode(), re.I)
_BREAK = re.compile(rb"\n[\x20\t\r]*\n")
_STOP = re.compile(rb"[.!?][\x20\t\r\n]+(?=[A-Z])")
TABLE = C.byte_table("nonword", lower=True)


def features(passage: bytes) -> tuple[np.ndarray, int]:
    """Bins of a passage's words and word pairs, and its number of words."""
    data = np.frombuffer(passage, np.uint8)
    w = C.words(C.Texts(data, np.array([0, len(data)]), 0, 1), TABLE)
    return np.concatenate([w.hash, C.grams(w.hash, 2)]) >> np.uint64(64 - BINS.bit_length() + 1), len(w.hash)


def _words(text: bytes) -> C.Words:
    data = np.frombuffer(text, np.uint8)
    return C.words(C.Texts(data, np.array([0, len(data)]), 0, 1), TABLE)


@cache
def full_texts() -> list[tuple[str, bytes]]:
    """Licences and their full texts, by name; read by the driver only. AGPL-3.0's is that of GPL-3.0 under its own name."""
    found = {p.stem: p.read_bytes() for p in Path(__file__).with_name("licences").glob("*.txt")}
    found["AGPL-3.0"] = found["GPL-3.0"].replace(b"GNU General Public License", b"GNU Affero General Public License").replace(b"GNU GENERAL PUBLIC LICENSE", b"GNU AFFERO GENERAL PUBLIC LICENSE")
    return sorted(found.items())


def passages(text: bytes) -> list[tuple[int, int]]:
    """Byte spans of the sentences, lines and paragraphs that hold a cue, each once, in order."""
    spans = lambda p: ([m.start() for m in p.finditer(text)], [m.end() for m in p.finditer(text)])
    ends = np.flatnonzero(np.frombuffer(text, np.uint8) == 10).tolist()
    (break_lo, break_hi), (stop_lo, stop_hi) = spans(_BREAK), spans(_STOP)
    found = {}
    for m in _CUE.finditer(text):
        i, j = bisect_left(ends, m.start()), bisect_left(ends, m.end())
        line = (ends[i - 1] + 1 if i else 0, ends[j] if j < len(ends) else len(text))
        i, j = bisect_right(break_hi, m.start()), bisect_left(break_lo, m.end())
        para = (break_hi[i - 1] if i else 0, break_lo[j] if j < len(break_lo) else len(text))
        i, j = bisect_left(stop_hi, m.start()), bisect_left(stop_lo, m.end())
        sentence = (stop_hi[i - 1] if i and stop_lo[i - 1] >= line[0] else line[0], stop_lo[j] + 1 if j < len(stop_lo) and stop_hi[j] < line[1] else line[1])
        for s in (sentence, line, para):
            found[s] = None
    return sorted(found)


class Model:
    """Unit TF-IDF vectors of the templates and of the full texts, these with their word pairs."""

    def __init__(self, df: np.ndarray, n: int):
        self.idf = np.log((n + 1) / (df + 1)) + 1
        self.vectors = [self.vector(features(t.encode())[0]) for _, t in TEMPLATES]
        self.full = [(name, *self.vector(features(t)[0]), np.unique(C.grams(_words(t).hash, 2))) for name, t in full_texts()]

    def vector(self, bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        b, n = np.unique(bins, return_counts=True)
        v = n * self.idf[b]
        return b, v / (np.sqrt((v * v).sum()) or 1.0)

    def best(self, bins: np.ndarray) -> tuple[int, float]:
        b, v = self.vector(bins)
        dense = dict(zip(b.tolist(), v.tolist(), strict=True))
        cos = [sum(x * dense.get(k, 0.0) for k, x in zip(tb.tolist(), tv.tolist(), strict=True)) for tb, tv in self.vectors]
        i = int(np.argmax(np.round(cos, 9)))
        return i, cos[i]


    def whole(self, w: C.Words) -> tuple[str, float, int, int, float]:
        """Of a whole text's words: the licence of the nearest full text, cosine, span of the words in its word pairs, and their share."""
        pairs, dense = C.grams(w.hash, 2), np.zeros(BINS)
        b, v = self.vector(np.concatenate([w.hash, pairs]) >> np.uint64(64 - BINS.bit_length() + 1))
        dense[b] = v
        cos = [float((tv * dense[tb]).sum()) for _, tb, tv, _ in self.full]
        i = int(np.argmax(np.round(cos, 9)))
        hit = np.isin(pairs, self.full[i][3])
        inside = np.flatnonzero(np.append(hit, False) | np.append(False, hit)) if len(pairs) else np.zeros(0, int)
        if not len(inside):
            return self.full[i][0], cos[i], 0, 0, 0.0
        return self.full[i][0], cos[i], int(w.start[inside[0]]), int(w.end[inside[-1]]), len(inside) / len(w.hash)


def _with_cue(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, bytes]]:
    """Rows of a batch whose text holds a cue."""
    text = batch.column(column)
    hit = pc.fill_null(pc.match_substring_regex(text.cast(pa.binary()), CUE, ignore_case=True), False)
    for i in np.flatnonzero(hit.to_numpy(zero_copy_only=False)):
        yield int(i), text[int(i)].as_buffer().to_pybytes()


def count_passages(files: DataFrame, text_col: str = "text") -> tuple[np.ndarray, int]:
    """Over all passages of all files: in how many each bin occurs, and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, n = np.zeros(BINS, np.int64), 0
        for b in batches:
            for _, text in _with_cue(b, 0):
                for lo, hi in passages(text):
                    df[np.unique(features(text[lo:hi])[0])] += 1
                    n += 1
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(df[at], n))], names=["bin", "n"])

    rows = files.select(F.col(text_col).alias("text")).mapInArrow(run, "bin long, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # BINS + 1 rows at most
    df, n = np.zeros(BINS), 0
    for r in rows:
        if r["bin"] < 0:
            n = r["n"]
        else:
            df[r["bin"]] = r["n"]
    return df, n


FIELDS = [
    T.StructField("declared", T.StringType()),
    T.StructField("cosine", T.DoubleType()),
    T.StructField("span", T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])),
    T.StructField("share", T.DoubleType()),
]


def declare(files: DataFrame, text_col: str = "text", threshold: float = THRESHOLD, keep: list[str] | None = None, file_share: float = FILE_SHARE) -> DataFrame:
    """files with declared (null if nothing reaches the threshold), cosine, span (bytes) and share (of the file's words that are licence text)."""
    shared = files.sparkSession.sparkContext.broadcast(Model(*count_passages(files, text_col)))
    new = [f.name for f in FIELDS]
    kept = [c for c in (files.columns if keep is None else keep) if c not in new]
    src = files.select(*[F.col(f"`{c}`") for c in kept], F.col(text_col).alias("__text"))
    span = pa.struct([("start", pa.int64()), ("end", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [(None, None, None, None)] * b.num_rows
            for i, text in _with_cue(b, len(kept)):
                w = _words(text)
                name, cos, lo, hi, share = shared.value.whole(w)
                if cos >= threshold and share >= file_share:
                    out[i] = (name, cos, {"start": lo, "end": hi}, share)
                    continue
                top, good = (-1.0, 0, 0, 0), []
                for lo, hi in passages(text):
                    k, cos = shared.value.best(features(text[lo:hi])[0])
                    if cos >= threshold:
                        good.append((TEMPLATES[k][0], lo, hi))
                    if cos > top[0] + 1e-9:
                        top = (cos, k, lo, hi)
                if top[0] >= threshold:
                    name = TEMPLATES[top[1]][0]
                    inside = np.zeros(len(w.hash) + 1, int)  # +1 where a passage's words begin, -1 where they end
                    for n, lo, hi in good:
                        if n == name:
                            inside[np.searchsorted(w.start, lo)] += 1
                            inside[np.searchsorted(w.start, hi)] -= 1
                    out[i] = (name, float(top[0]), {"start": top[2], "end": top[3]}, int((np.cumsum(inside) > 0).sum()) / max(len(w.hash), 1))
            cols = list(zip(*out, strict=True)) if out else [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(len(kept))], pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], span), pa.array(cols[3], pa.float64())], names=[*kept, *new])

    return src.mapInArrow(run, T.StructType([*[src.schema[c] for c in kept], *FIELDS]))


def inherit(declared: DataFrame, path_col: str = "path", file_share: float = FILE_SHARE) -> DataFrame:
    """declared with licence (its own or its nearest ancestor directory's) and from_dir (null for its own)."""
    path = F.col(path_col)
    df = declared.withColumn("__dir", F.when(path.isNull(), None).when(path.contains("/"), F.regexp_replace(path, "/[^/]*$", "")).otherwise(""))
    speaks = df.where(F.col("declared").isNotNull() & F.col("__dir").isNotNull() & (path.rlike(LICENCE_FILE) | (F.col("share") >= file_share)))
    best = F.min(F.struct((-F.round("cosine", 9)).alias("c"), path.alias("p"), F.col("declared").alias("licence")))
    owners = C.cut(speaks.groupBy("__dir").agg(best.alias("b")).select(F.col("__dir").alias("up"), F.col("b.licence").alias("licence")), "licence-dirs")
    dirs = df.where("__dir is not null").select("__dir").distinct()
    part = F.split("__dir", "/")
    ups = dirs.select("__dir", F.explode(F.when(F.col("__dir") == "", F.array(F.lit(""))).otherwise(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(part)), lambda n: F.array_join(F.slice(part, 1, n), "/"))))).alias("up"))
    nearest = ups.join(owners, "up").withColumn("__r", F.row_number().over(Window.partitionBy("__dir").orderBy(F.length("up").desc()))).where("__r = 1").select("__dir", F.col("up").alias("__up"), F.col("licence").alias("__licence"))
    out = df.join(C.cut(nearest, "licence-nearest"), "__dir", "left")
    own = F.col("declared").isNotNull()
    return out.withColumn("licence", F.coalesce("declared", "__licence")).withColumn("from_dir", F.when(~own, F.col("__up"))).drop("__dir", "__up", "__licence")


def path_of(*parts: Column) -> Column:
    """Values as a path of one folder each. `%` and `/` in a value are written %25 and %2F, a null is %00 and an empty value %, so no two paths are equal but of equal values."""
    name = lambda c: F.when(c.isNull(), "%00").when(c == "", "%").otherwise(F.replace(F.replace(c, F.lit("%"), F.lit("%25")), F.lit("/"), F.lit("%2F")))
    return F.concat_ws("/", *[name(c.cast("string")) for c in parts])


def op6(spark, sf_dir: str) -> DataFrame:
    """Documents as files <source>/<lang>/<doc_id>; a null source or language is a folder of its own, a null id a file of that folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", path_of(F.col("source"), F.col("lang"), F.col("doc_id")).alias("path"), "text")
    found = C.cut(declare(docs, keep=["doc_id", "path"]), "licence-declared")
    return inherit(found).select("doc_id", "path", "declared", "cosine", F.col("span.start").alias("span_start"), F.col("span.end").alias("span_end"), "licence", "from_dir")
