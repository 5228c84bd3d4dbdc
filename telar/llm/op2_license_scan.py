"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest ancestor directory.

The units of a text are the whole file, its blocks (runs of lines that aren't blank, such as a header in
comment marks), its paragraphs (runs of lines with words) and its lines. A unit's vector has, for every word of the templates, its count times
log((1 + units) / (1 + units with the word)) + 1, by counts over all units of the corpus; a word that no
template has weighs as one that no other unit has, so it lengthens the vector and nothing else. Every
unit is multiplied with every template. Of the templates at `least` cosine or more whose name words the
unit holds, the longest says what the file's own licence is, as it is the most evidence (ties: the better
cosine, then the name that sorts first). Statements, titles and SPDX lines count only in units without a
negation, so "not released under the MIT License" grants nothing; nor does a line that holds a statement and
a negation of something else, while a negation on another line than the name isn't seen. An SPDX line that
names several licences gives one of them. Texts are read twice,
for the counts and for the products; only counts of the templates' words and results leave the tasks.

Files named LICENSE, LICENCE, COPYING or NOTICE (any extension) speak for their directory (several: the
best cosine, then the least name); a file without a licence of its own takes that of the nearest
directory above it that has one. Directories are resolved once each, and only ids and paths take part in
the path joins.

Null or empty text: no licence of its own. Null path: no directory. Every row gives a row. Columns
other than id, path and text are left out, so they cannot clash.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from telar.llm.common import Scratch, field, map_texts, read

# Public licence texts, their headers and the statements that grant them, with words a unit must hold to be one.
AS_IS = """THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY
CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE
SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish,
distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the
following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

"""
BSD_2 = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the
documentation and/or other materials provided with the distribution.

"""
BSD_NAMES = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission.

"""
BSD_AS_IS = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED
TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR
CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO,
PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF
LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS
SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the
above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES
WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF
OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE_HEADER = """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may
obtain a copy of the License at

http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT
WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
limitations under the License."""
APACHE_GRANT = """Grant of Copyright License. Subject to the terms and conditions of this License, each Contributor hereby grants to You a perpetual,
worldwide, non-exclusive, no-charge, royalty-free, irrevocable copyright license to reproduce, prepare Derivative Works of, publicly display,
publicly perform, sublicense, and distribute the Work and such Derivative Works in Source or Object form."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:

1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in
a product, an acknowledgment in the product documentation would be appreciated but is not required.

2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.

3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary,
for any purpose, commercial or non-commercial, and by any means."""
BOOST = """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation
covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative
works of the Software, and to permit third-parties to whom the Software is furnished to do so"""
MPL_HEADER = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at http://mozilla.org/MPL/2.0/."""
CC0 = "To the extent possible under law the author has waived all copyright and related or neighboring rights to this work and dedicated it to the public domain."
# of each licence of the GNU family: identifier, its name in notices, version, date of the version, words that tell it from the others
GNU = [
    ("AGPL-3.0", "GNU Affero General Public License", "3", "19 November 2007", ["affero"]), ("GPL-2.0", "GNU General Public License", "2", "June 1991", ["general", "2"]),
    ("GPL-3.0", "GNU General Public License", "3", "29 June 2007", ["general", "3"]), ("LGPL-2.1", "GNU Lesser General Public License", "2.1", "February 1999", ["lesser", "2.1"]),
    ("LGPL-3.0", "GNU Lesser General Public License", "3", "29 June 2007", ["lesser", "3"]),
]
# of each Creative Commons licence: identifier, its name
COMMONS = [("CC-BY-4.0", "Attribution"), ("CC-BY-NC-4.0", "Attribution-NonCommercial"), ("CC-BY-SA-4.0", "Attribution-ShareAlike"), ("CC-BY-NC-SA-4.0", "Attribution-NonCommercial-ShareAlike")]
NAMED = [("MIT", "MIT License", ["mit"]), ("Apache-2.0", "Apache License, Version 2.0", ["apache"]), ("MPL-2.0", "Mozilla Public License, version 2.0", ["mozilla"])]
# titles that stand alone above a licence's text or in its place
TITLES = [
    ("MIT", "MIT License"), ("MIT", "The MIT License (MIT)"), ("Apache-2.0", "Apache License, Version 2.0"), ("Apache-2.0", "Apache License Version 2.0, January 2004"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"), ("BSD-2-Clause", "BSD 2-Clause License"), ("BSD-3-Clause", "BSD 3-Clause License"), ("ISC", "ISC License"),
    ("MPL-2.0", "Mozilla Public License Version 2.0"), ("BSL-1.0", "Boost Software License - Version 1.0"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"), ("Zlib", "zlib License"),
    ("Unlicense", "The Unlicense"), ("CC0-1.0", "CC0 1.0 Universal"), ("CC0-1.0", "Creative Commons CC0 1.0 Universal")]
# words by which a statement is denied
DENIALS = ["not", "never", "neither", "nor", "cannot", "isn", "wasn", "aren", "weren"]
STATEMENTS = ["Licensed under the {}.", "Released under the {}.", "This work is licensed under the {}.", "This program is licensed under the {}.", "Distributed under the terms of the {}."]


def templates() -> list[tuple[str, list[str], str, list[str]]]:
    """(licence, words the unit must hold, text, words it mustn't hold): whole texts, their paragraphs and headers; titles, SPDX lines and statements by rule."""
    whole = [
        ("MIT", [], MIT + AS_IS), ("BSD-2-Clause", [], BSD_2 + BSD_AS_IS), ("BSD-3-Clause", ["endorse"], BSD_2 + BSD_NAMES + BSD_AS_IS), ("ISC", ["fee"], ISC), ("Apache-2.0", ["apache"], APACHE_HEADER),
        ("Apache-2.0", [], APACHE_GRANT), ("Zlib", [], ZLIB), ("Unlicense", [], UNLICENSE), ("BSL-1.0", [], BOOST), ("MPL-2.0", [], MPL_HEADER), ("CC0-1.0", ["waived"], CC0), ("Proprietary", ["all", "rights", "reserved"], "All rights reserved.")]
    parts = [
        ("MIT", [], MIT.split("\n\n")[0]), ("BSD-3-Clause", [], BSD_2.split("\n\n")[0]), ("ISC", ["fee"], ISC.split("\n\n")[0]), ("Zlib", [], ZLIB.split("\n\n")[1]), ("Unlicense", [], UNLICENSE.split("\n\n")[0]),
        ("Apache-2.0", ["apache"], APACHE_HEADER.split("\n\n")[0])]
    out, said = whole + parts, []
    for name, full, version, date, need in GNU:
        notice = (
            f"This program is free software: you can redistribute it and/or modify it under the terms of the {full} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
        warranty = f"This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the {full} for more details."
        title = f"{full} Version {version}, {date} Copyright (C) Free Software Foundation, Inc. Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
        out += [(name, need, notice), (name, need, f"{notice}\n\n{warranty}"), (name, need, title)]
        said += [(name, need, s.format(f"{full}, version {version}")) for s in STATEMENTS] + [(name, need, f"{full} Version {version}, {date}")]
        said += [(name, ["spdx", *words(name)], f"SPDX-License-Identifier: {name}{end}") for end in ("-only", "-or-later")]
    for name, kind in COMMONS:
        short = name.replace("CC-", "CC ", 1).replace("-4.0", " 4.0")
        need = [w for w in words(name) if w != "cc"]
        said += [(name, words(kind), s.format(f"Creative Commons {kind} 4.0 International License")) for s in STATEMENTS] + [(name, need, s.format(short).replace("the ", "")) for s in STATEMENTS]
    said += [(name, need, s.format(full)) for name, full, need in NAMED for s in STATEMENTS] + [(name, words(title), title) for name, title in TITLES]
    said += [(name, ["spdx", *words(name)], f"SPDX-License-Identifier: {name}") for name in sorted({name for name, *_ in out + said} - {"Proprietary"})]
    return [(*t, []) for t in out] + [(*t, DENIALS) for t in said]


#: Lower case for A-Z, a space for whatever stands in no word; dots stand within words only.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 or c in b".\n" else 32 for c in range(256))
FILE = r"(?i)(^|/)(licen[sc]e|copying|notice)(\.[^/]*)?$"


def words(text: str) -> list[str]:
    return [w for w in (x.strip(b".").decode() for x in text.encode().translate(FOLD).split()) if w]


class Units:
    """Which words of the templates the units of texts hold, as flat arrays."""

    def __init__(self, vocabulary: dict[bytes, int]):
        self.get = vocabulary.get

    def __call__(self, texts: list) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(unit, word, count) of every unit's words that are in the vocabulary; how many words are not; the text of every unit.

        A text's first unit is the whole file; then come its lines, and its paragraphs and blocks of more than one line.
        """
        own, word, other, texts_of = [], [], [], []
        for d, text in enumerate(texts):
            data = (text or "").encode()
            lines = [[self.get(x, -1) for w in line.split() if (x := w.strip(b"."))] for line in data.translate(FOLD).split(b"\n")]
            units, held, block = [list(chain.from_iterable(lines))], [], []
            for ids, blank in zip([*lines, []], [*(not x.strip() for x in data.split(b"\n")), True]):
                if ids:
                    held.append(ids)
                    units.append(ids)
                elif held:
                    units += [list(chain.from_iterable(held))] if len(held) > 1 else []
                    block.append(held)
                    held = []
                if blank:
                    units += [list(chain.from_iterable(chain.from_iterable(block)))] if len(block) > 1 else []
                    block = []
            for ids in units[:1] if len(units) == 2 else units:
                known = [i for i in ids if i >= 0]
                if known:
                    own += [len(other)] * len(known)
                    word += known
                    other.append(len(ids) - len(known))
                    texts_of.append(d)
        pair, count = np.unique(np.array(own, np.int64) << 32 | np.array(word, np.int64), return_counts=True)
        return pair >> 32, pair & 0xFFFFFFFF, count, np.array(other, np.int64), np.array(texts_of, np.int64)


class Matcher:
    """Best template of each text, with idf weights by `df` of `n` units."""

    def __init__(self, vocabulary: dict[bytes, int], df: np.ndarray, n: int):
        self.units, self.most = Units(vocabulary), np.log(1.0 + n) + 1.0
        self.idf = np.log((1.0 + n) / (1.0 + df)) + 1.0
        every = sorted(templates())
        self.names, self.length = [name for name, *_ in every], np.array([len(words(text)) for _, _, text, _ in every])
        self.table = np.zeros((len(vocabulary), len(every)), np.float32)
        self.need = np.zeros((len(vocabulary), len(every)), np.float32)
        self.bar = np.zeros((len(vocabulary), len(every)), bool)
        for k, (_, need, text, bar) in enumerate(every):
            for w in words(text):
                self.table[vocabulary[w.encode()], k] += 1
            for w in need:
                self.need[vocabulary[w.encode()], k] = 1
            for w in bar:
                self.bar[vocabulary[w.encode()], k] = True
        self.table *= self.idf[:, None].astype(np.float32)
        self.table /= np.linalg.norm(self.table, axis=0)

    def __call__(self, texts: list, least: float) -> list[tuple[str | None, float | None]]:
        unit, word, count, other, texts_of = self.units(texts)
        out: list[tuple] = [(None, None)] * len(texts)
        if not len(unit):
            return out
        first = np.flatnonzero(np.concatenate([[True], unit[1:] != unit[:-1]]))
        weight = count * self.idf[word]
        norm = np.sqrt(np.add.reduceat(weight**2, first) + other * self.most**2)
        cosine = np.empty((len(first), len(self.names)), np.float32)
        for a in range(0, len(first), 4096):  # so that memory stays bounded
            z = min(a + 4096, len(first))
            i, j = first[a], first[z] if z < len(first) else len(unit)
            rows = weight[i:j, None].astype(np.float32) * self.table[word[i:j]]
            cosine[a:z] = np.add.reduceat(rows, first[a:z] - i, axis=0)
        cosine = np.round(cosine / norm[:, None], 5)
        need = self.need.sum(axis=0)
        edges, best = [*first.tolist(), len(unit)], {}
        for u in np.flatnonzero(cosine.max(axis=1) >= least).tolist():
            held = word[edges[u] : edges[u + 1]]
            fits = np.flatnonzero((cosine[u] >= least) & (self.need[held].sum(axis=0) >= need) & ~self.bar[held].any(axis=0))
            for k in fits.tolist():
                best[texts_of[u]] = min(best.get(texts_of[u], (0,)), (-int(self.length[k]), -float(cosine[u, k]), self.names[k]))
        for d, (_, x, name) in best.items():
            out[d] = (name, round(-x, 5))
        return out


def matcher(texts: DataFrame) -> Matcher:
    """Counts of the templates' words over all units of the corpus; texts: text. As many rows reach the driver as there are such words."""
    vocabulary = {w: k for k, w in enumerate(sorted({w.encode() for _, need, text, bar in templates() for w in [*need, *words(text), *bar]}))}

    def run(batches):
        import pyarrow as pa

        from telar.llm.common import sliced

        units, df, n = Units(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for batch in batches:
            for part in sliced(batch, 0):
                _, word, _, other, _ = units(part.column(0).to_pylist())
                df += np.bincount(word, minlength=len(df))
                n += len(other)
        yield pa.RecordBatch.from_arrays([pa.array([*range(len(df)), -1]), pa.array([*df.tolist(), n])], names=["word", "n"])

    counts = {r["word"]: r["n"] for r in texts.select("text").mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()}
    return Matcher(vocabulary, np.array([counts.get(k, 0) for k in range(len(vocabulary))]), counts.get(-1, 0))


def scan_licences(files: DataFrame, scratch: Scratch, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text", least: float = 0.7) -> DataFrame:
    """A row per input row: id, path, own_licence, cosine, licence, origin (own, inherited or none)."""
    src = files.select(F.col(id_col).alias("id"), F.col(path_col).alias("path"), F.col(text_col).alias("text"))
    src = src.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", r"/[^/]*$", "")).when(F.col("path").isNotNull(), ""))
    shared = files.sparkSession.sparkContext.broadcast(matcher(src))  # words of the templates x templates
    find = lambda: lambda texts: list(map(list, zip(*shared.value(texts, least))))
    known = map_texts(src, "text", ["id", "path", "dir"], [field("licence", "string"), field("cosine", "double")], find)
    known = scratch.write(known, "known")

    speaks = known.filter(F.col("path").rlike(FILE) & F.col("licence").isNotNull())
    speaks = speaks.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "licence")).alias("m")).select(F.col("dir").alias("above"), F.col("m.licence").alias("granted"))
    parts = F.split("dir", "/")
    above = F.when(F.col("dir") == "", F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above")))).otherwise(F.concat(
        F.array(F.struct(F.lit(0).alias("depth"), F.lit("").alias("above"))),
        F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.struct(k.alias("depth"), F.array_join(F.slice(parts, 1, k), "/").alias("above")))))
    dirs = known.filter(F.col("dir").isNotNull()).select("dir").distinct().select("dir", F.inline(above))
    nearest = dirs.join(speaks, "above").groupBy("dir").agg(F.max(F.struct("depth", "granted")).alias("m")).select("dir", "m.granted")
    out = known.join(nearest, "dir", "left")
    return out.select(
        F.col("id").alias(id_col), "path", F.col("licence").alias("own_licence"), "cosine", F.coalesce("licence", "granted").alias("licence"),
        F.when(F.col("licence").isNotNull(), "own").when(F.col("granted").isNotNull(), "inherited").otherwise("none").alias("origin"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files: source/by 2000 ids/by 200 ids/id.txt. One whose first or last line is a short one on rights or a
    licence is a LICENSE file, of its folder or of one or two folders above, by its id."""
    docs = read(spark, sf_dir, "documents")
    text = F.trim(F.coalesce("text", F.lit("")))
    short = lambda line: line.rlike(r"(?i)licen[sc]e|rights reserved") & (F.length(line) < 120)
    top = short(F.substring_index(text, "\n", 1)) | short(F.substring_index(text, "\n", -1))
    level = F.when(top, F.col("doc_id") % 3).otherwise(2)
    parts = F.array(F.coalesce("source", F.lit("none")), F.expr("doc_id div 2000").cast("string"), F.expr("doc_id div 200").cast("string"))
    name = F.when(top, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    path = F.concat_ws("/", F.slice(parts, F.lit(1), level.cast("int") + 1), name)
    return scan_licences(docs.select("doc_id", "text", path.alias("path")), Scratch(spark))


QUERIES = {"op2_license_scan": op2_license_scan}
ORACLES: dict[str, str] = {}
