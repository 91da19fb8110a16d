"""License scans: TF-IDF cosine of licence lines to templates, then inheritance along directories.

The lines of a text that speak of licences are its header. Each is compared with the templates by the cosine
of sparse TF-IDF vectors, whose inverse document frequencies are those of the templates (a word that no
template has counts as rarest). A file's licence is that of its best line, if the cosine reaches
``LEAST``. Where no line does, wider parts of the file are held against the licences' texts in ``TEXTS``: its
header (all cue lines with ``NEAR`` lines around each), its first lines and its whole text. Their terms are pairs
of neighbouring words, split at hyphens and across line ends, each counted once; pairs that no text has are left out,
so that other words nearby don't weigh, and ``PAIRS`` pairs at least must agree. A directory takes the licence of the licence file in it, the first by path; a file without one of
its own takes that of its nearest directory upwards that has one. All of it is joins and sums over DataFrames.

Null and empty texts have no licence of their own, and may inherit one. A null path counts as empty: such a
file lies in no directory. Ties go to the first licence by name. Repeated rows each give a row; rows that
share a path and differ in text are told apart by the text's hash. Texts and lines of any length are read
whole. Other columns pass through; a column with the name of an output column is replaced. An empty table
gives an empty result.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

LEAST = 0.5
CUE_WORDS = ("license", "licence", "copyright", "rights reserved", "released under", "spdx", "public domain")
CUES = "licen[sc]e|copyright|rights reserved|released under|spdx|public domain"
TERM = "[a-z0-9]+(?:[.+-][a-z0-9]+)*"

# Licence names and the words by which their headers are known.
TEMPLATES = {
    "AGPL-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "BSD-2-Clause": "Licensed under the 2-clause BSD license, the simplified BSD license.",
    "BSD-3-Clause": "Licensed under the 3-clause BSD license, the new BSD license.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "Released under CC0 1.0, dedicated to the public domain.",
    "EPL-2.0": "Licensed under the Eclipse Public License, version 2.0.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "LGPL-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "MIT": "Released under the MIT License.",
    "MPL-2.0": "Licensed under the Mozilla Public License, version 2.0.",
    "Proprietary": "All rights reserved.",
    "Unlicense": "Released into the public domain under the Unlicense.",
}

# Fixed values of the wider comparison: lines around a cue line, first lines, word pairs that must agree.
NEAR, FIRST, PAIRS = 3, 5, 2
WORD = r"[a-z0-9]+(?:\.[0-9]+)*"

_GRANT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."
_AS_IS = "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."


def _gnu(name: str, version: str, what: str = "program") -> str:
    return f"This {what} is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, either version {version} of the License, or (at your option) any later version."


# Whole texts of the short licences; of the long ones the title and the notice that they ask to put into each file.
TEXTS = {
    "AGPL-3.0": ["GNU Affero General Public License Version 3, 19 November 2007", _gnu("GNU Affero General Public License", "3")],
    "Apache-2.0": ["Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'],
    "BSD-2-Clause": ["BSD 2-Clause License", "the simplified BSD license", _BSD + _BSD_END],
    "BSD-3-Clause": ["BSD 3-Clause License", "the new BSD license", _BSD + _BSD_3 + _BSD_END],
    "CC-BY-4.0": ["Creative Commons Attribution 4.0 International Public License", "the Creative Commons Attribution 4.0 International License"],
    "CC-BY-NC-4.0": ["Creative Commons Attribution-NonCommercial 4.0 International Public License", "the Creative Commons Attribution-NonCommercial 4.0 International License"],
    "CC-BY-SA-4.0": ["Creative Commons Attribution-ShareAlike 4.0 International Public License", "the Creative Commons Attribution-ShareAlike 4.0 International License"],
    "CC0-1.0": ["Creative Commons Legal Code CC0 1.0 Universal"],
    "EPL-2.0": ["Eclipse Public License - v 2.0", "made available under the terms of the Eclipse Public License 2.0 which is available at"],
    "GPL-2.0": ["GNU General Public License Version 2, June 1991", _gnu("GNU General Public License", "2")],
    "GPL-3.0": ["GNU General Public License Version 3, 29 June 2007", _gnu("GNU General Public License", "3")],
    "LGPL-3.0": ["GNU Lesser General Public License Version 3, 29 June 2007", _gnu("GNU Lesser General Public License", "3"), _gnu("GNU Lesser General Public License", "3", "library")],
    "MIT": ["distributed under the MIT license", "The MIT License (MIT)", _GRANT + _AS_IS],
    "MPL-2.0": ["Mozilla Public License Version 2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"],
    "Proprietary": ["Copyright. All rights reserved."],
    "Unlicense": ["This is free and unencumbered software released into the public domain.", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."],
}


def pairs(text: str) -> set[str]:
    words = re.findall(WORD, text.lower().replace("licence", "license"))
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def wide_weights() -> list[tuple[str, int, str, float, float]]:
    """``licence, number, pair, weight, idf`` of the unit vectors of ``TEXTS``, ``TEMPLATES`` and the SPDX identifiers."""
    texts = [(name, t) for name in TEMPLATES for t in (*TEXTS[name], TEMPLATES[name], f"SPDX-License-Identifier: {name}")]
    found = [(name, pairs(t)) for name, t in texts]
    often = Counter(w for _, ws in found for w in ws)
    idf = {w: math.log((1 + len(found)) / (1 + c)) + 1 for w, c in often.items()}
    rows = []
    for k, (name, ws) in enumerate(found):
        norm = math.sqrt(sum(idf[w] ** 2 for w in ws))
        rows += [(name, k, w, idf[w] / norm, idf[w]) for w in sorted(ws)]
    return rows


def weights() -> tuple[dict[str, float], list[tuple[str, str, float]], float]:
    """Inverse document frequency of each template word; ``licence, word, weight`` of unit vectors; and the
    frequency of a word that no template has."""
    counts = {name: Counter(re.findall(TERM, text.lower())) for name, text in TEMPLATES.items()}
    n = len(counts)
    idf = {w: math.log((1 + n) / (1 + sum(w in c for c in counts.values()))) + 1 for w in sorted(set().union(*counts.values()))}
    rows = []
    for name, c in counts.items():
        norm = math.sqrt(sum((k * idf[w]) ** 2 for w, k in c.items()))
        rows += [(name, w, k * idf[w] / norm) for w, k in sorted(c.items())]
    return idf, rows, math.log(1 + n) + 1


def unit_terms(files: DataFrame) -> DataFrame:
    """``p, th, unit, wide, terms`` of the texts that speak of licences: the words of each cue line, and of each wider
    part the distinct pairs that a licence's text has. One pass over the texts, written as the table that all else
    reads."""
    known = ", ".join(f"'{w}'" for w in sorted({row[2] for row in wide_weights()}))
    said = " OR ".join(f"contains(t, '{cue}')" for cue in CUE_WORDS)
    word = WORD.replace(chr(92), chr(92) * 2)
    # Lines, flags and words are bound once: what refers to them may be pushed down and computed again.
    units = F.expr(
        f"""element_at(transform(array(split(text, '\n')), ls -> concat(
            transform(filter(ls, x -> lower(x) RLIKE '{CUES}'), x -> named_struct('wide', false, 'terms', regexp_extract_all(lower(x), '{TERM}', 0))),
            transform(array(
                array_join(element_at(transform(array(transform(ls, x -> lower(x) RLIKE '{CUES}')), f ->
                    filter(ls, (x, i) -> array_contains(slice(f, greatest(1, i + 1 - {NEAR}), least({2 * NEAR + 1}, i + 1 + {NEAR})), true))), 1), '\n'),
                array_join(slice(filter(ls, x -> x RLIKE '[A-Za-z0-9]'), 1, {FIRST}), '\n'),
                text), words -> named_struct('wide', true, 'terms',
                element_at(transform(array(regexp_extract_all(replace(lower(words), 'licence', 'license'), '{word}', 0)), t ->
                    array_distinct(filter(zip_with(t, slice(t, 2, size(t)), (a, b) -> concat(a, ' ', b)), x -> x IN ({known})))), 1))))), 1)"""
    )
    some = files.filter(F.expr(f"exists(array(lower(text)), t -> {said})"))
    each = some.select("p", "th", F.posexplode(units).alias("unit", "u")).select("p", "th", "unit", "u.wide", "u.terms")
    return written(each.filter(F.size("terms") > 0))


def wide_licences(units: DataFrame) -> DataFrame:
    """``p, th, licence, score`` of the files whose header, first lines or whole text reach ``LEAST``."""
    rows = units.sparkSession.createDataFrame(wide_weights(), "licence string, number int, term string, weight double, idf double")
    known = F.broadcast(rows.groupBy("term", "idf").agg(F.collect_list(F.struct("licence", "number", "weight")).alias("of")))  # the texts' pairs
    terms = units.filter("wide").select("p", "th", "unit", F.explode("terms").alias("term")).join(known, "term").dropDuplicates(["p", "th", "unit", "term"])
    norms = terms.groupBy("p", "th", "unit").agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"))
    each = terms.select("p", "th", "unit", "idf", F.inline("of"))
    dots = each.groupBy("p", "th", "unit", "licence", "number").agg(F.sum(F.col("idf") * F.col("weight")).alias("dot"), F.count("*").alias("n"))
    scored = dots.filter(F.col("n") >= PAIRS).join(norms, ["p", "th", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6))
    return scored.filter(F.col("score") >= LEAST).select("p", "th", "licence", "score")


def own_licences(files: DataFrame) -> DataFrame:
    """``p, th, licence, score`` of the files with a licence: that of the best line which reaches ``LEAST``, or
    without such a line that of the best wider part. What only reserves all rights comes last."""
    spark = files.sparkSession
    idf, rows, rarest = weights()
    known = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))  # the templates' words
    template = F.broadcast(spark.createDataFrame(rows, "licence string, term string, weight double"))
    units = unit_terms(files)
    terms = units.filter("not wide").select("p", "th", "unit", F.explode("terms").alias("term"))
    counted = terms.groupBy("p", "th", "unit", "term").count()
    vectors = counted.join(known, "term", "left").withColumn("x", F.col("count") * F.coalesce("idf", F.lit(rarest)))
    norms = vectors.groupBy("p", "th", "unit").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = vectors.join(template, "term").groupBy("p", "th", "unit", "licence").agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
    scored = dots.join(norms, ["p", "th", "unit"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).filter(F.col("score") >= LEAST)
    scored = scored.select("p", "th", "licence", "score", F.lit(0).alias("part")).unionByName(wide_licences(units).withColumn("part", F.lit(1)))
    # A sentence that reserves all rights also stands above licences.
    scored = scored.withColumn("part", F.col("part") + F.when(F.col("licence") == "Proprietary", 2).otherwise(0))
    best = F.min(F.struct("part", (-F.col("score")).alias("s"), "licence")).alias("best")
    return written(scored.groupBy("p", "th").agg(best).select("p", "th", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score")))


def parent(path: Column) -> Column:
    """The directory that a path lies in; null at the top."""
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, "/[^/]*$", ""))


def scan(files: DataFrame, path: str = "path", text: str = "text", licence_file: Column | None = None) -> DataFrame:
    """The files (without ``text``) with ``licence, score, how, licence_dir``. ``how`` is ``own``, ``inherited``
    or ``none``. ``licence_file``, a condition on the path ``p``, says which files speak for their directory: by default those named so."""
    named = F.col("p").rlike(r"(?i)(^|/)(licen[sc]e|copying|notice|unlicense)[^/]*$") if licence_file is None else licence_file
    out = ("licence", "score", "how", "licence_dir")
    kept = [c for c in files.columns if c not in (text, *out)]
    keyed = files.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), F.coalesce(F.col(path), F.lit("")).alias("p"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    own = own_licences(keyed.select("p", "th", "text"))
    rows = keyed.drop("text").withColumn("dir", parent(F.col("p")))
    spoken = own.filter(named).withColumn("dir", parent(F.col("p"))).filter(F.col("dir").isNotNull())
    of_dir = spoken.groupBy("dir").agg(F.min_by("licence", F.struct("p", "licence")).alias("dir_licence"))
    # Every directory's ancestors, itself included; each directory once, however many files it has.
    up = F.expr("transform(sequence(1, size(split(dir, '/'))), n -> array_join(slice(split(dir, '/'), 1, n), '/'))")
    dirs = rows.select("dir").filter(F.col("dir").isNotNull()).distinct()
    above = dirs.select(F.col("dir").alias("below"), F.explode(up).alias("dir"))
    nearest = above.join(of_dir, "dir").groupBy("below").agg(F.max(F.struct(F.length("dir").alias("n"), F.col("dir"), "dir_licence")).alias("x"))
    found = nearest.select(F.col("below").alias("dir"), F.col("x.dir").alias("licence_dir"), F.col("x.dir_licence").alias("dir_licence"))
    joined = rows.join(own, ["p", "th"], "left").join(found, "dir", "left")
    has = F.col("licence").isNotNull()
    return joined.select(
        *(F.col(f"row.`{c}`").alias(c) for c in kept),
        F.coalesce("licence", "dir_licence").alias("licence"),
        "score",
        F.when(has, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("how"),
        F.when(~has, F.col("licence_dir")).alias("licence_dir"),
    )


def document_path() -> Column:
    """A document's place in a tree of directories: source, thousands, fifties, id."""
    d = F.col("doc_id")
    return F.concat_ws("/", F.coalesce("source", F.lit("-")), F.floor(d / 1000).cast("string"), F.floor(d / 50).cast("string"), d.cast("string"))


def sql() -> str:
    """``scan`` of the documents, each of which with a licence speaks for its directory, as DuckDB SQL."""
    idf, rows, rarest = weights()
    known = ", ".join(f"('{w}', {x!r}::DOUBLE)" for w, x in idf.items())
    template = ", ".join(f"('{n}', '{w}', {x!r}::DOUBLE)" for n, w, x in rows)
    return f"""
    WITH known(term, idf) AS (VALUES {known}), template(licence, term, weight) AS (VALUES {template}),
    files AS (
        SELECT doc_id, text, concat_ws('/', coalesce(source, '-'), CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 50 AS VARCHAR)) AS dir
        FROM documents),
    lines AS (
        SELECT doc_id, dir, line, words FROM (
            SELECT doc_id, dir, unnest(string_split(text, chr(10))) AS words, generate_subscripts(string_split(text, chr(10)), 1) AS line FROM files)
        WHERE regexp_matches(lower(words), '{CUES}')),
    terms AS (SELECT doc_id, line, unnest(regexp_extract_all(lower(words), '{TERM}')) AS term FROM lines),
    vectors AS (
        SELECT doc_id, line, term, n * coalesce(idf, {rarest!r}) AS x
        FROM (SELECT doc_id, line, term, count(*) AS n FROM terms GROUP BY ALL) LEFT JOIN known USING (term)),
    norms AS (SELECT doc_id, line, sqrt(sum(x * x)) AS norm FROM vectors GROUP BY ALL),
    scored AS (
        SELECT doc_id, licence, round(sum(x * weight) / any_value(norm), 6) AS score
        FROM vectors JOIN template USING (term) JOIN norms USING (doc_id, line) GROUP BY doc_id, line, licence),
    own AS (
        SELECT doc_id, licence, score FROM scored WHERE score >= {LEAST}
        QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
    of_dir AS (
        SELECT dir, licence AS dir_licence FROM own JOIN files USING (doc_id)
        QUALIFY row_number() OVER (PARTITION BY dir ORDER BY CAST(doc_id AS VARCHAR)) = 1),
    found AS (
        SELECT d.dir, a.dir AS licence_dir, dir_licence FROM (SELECT DISTINCT dir FROM files) d JOIN of_dir a
            ON d.dir = a.dir OR starts_with(d.dir, a.dir || '/')
        QUALIFY row_number() OVER (PARTITION BY d.dir ORDER BY length(a.dir) DESC) = 1)
    SELECT doc_id, coalesce(licence, dir_licence) AS licence, score,
           CASE WHEN licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS how,
           CASE WHEN licence IS NULL THEN licence_dir END AS licence_dir
    FROM files LEFT JOIN own USING (doc_id) LEFT JOIN found USING (dir)"""
