"""License scans [native].

Method: spans of a file are compared with licence templates (notices, SPDX tags, texts of licence
files) by the cosine of sparse TF-IDF vectors. Document frequencies of the templates' terms are
counted over all files; terms of no template count as never seen.

A template's anchors are its heaviest terms, without which no vector reaches the threshold, by
the prefix-filter bound: those that it holds once, if there are any. Wherever an anchor occurs
in a file, the template is laid on the file so that both meet, and the file's terms under it are
one span; so line breaks, comment marks and other words on the line do not matter. A template
of whose weight the whole file holds too little for any span is left out before.

Of spans that reach the threshold and overlap, the best counts: at each term of the file the
span with the highest score there, the longest of equal ones; a span that is best at more than
half of its terms is a licence of the file, so a file may have several, and of licences that
share sentences the one that fits as a whole wins. A file is a licence file if its name says so,
or if its licences' spans hold most of its terms. Licence files license their directory: files
without an own licence inherit from the nearest ancestor directory that has a licence file, by
joining the directories' ancestor paths; if it has several, all apply.

Defined results: null or empty text has no own licence but inherits; null path inherits
nothing; spans of equal score and length go to the first in the file, then to the first
template; repeated rows are kept; an empty table gives no rows; extra columns pass through,
but for those whose name starts with _lic_, which are dropped.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.text import all_of, named, without_reserved
from lodestone.runtime import Scratch

THRESHOLD = 0.75
FILE_SHARE = 0.5
BROADCAST_DIRS = 100_000
TERM = r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([._-].*)?$"

_PERMIT = "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_NAME = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
_GNU = "This {what} is free software{sign} you can redistribute it and/or modify it under the terms of the GNU {kind} Public License as published by the Free Software Foundation{either} version {n} of the License, or (at your option) any later version."
_GNU_TITLE = "GNU {kind} PUBLIC LICENSE Version {n}, {day} Copyright (C) {years} Free Software Foundation, Inc."

#: Notices and texts of public licences, (licence, text).
NOTICES = [
    ("AGPL-3.0", _GNU.format(what="program", sign=":", kind="Affero General", either=", either", n=3)),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU_TITLE.format(kind="AFFERO GENERAL", n=3, day="19 November 2007", years="2007")),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", f"{_BSD} {_BSD_END}"),
    ("BSD-3-Clause", f"{_BSD} {_BSD_NAME} {_BSD_END}"),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work. CC0 1.0 Universal Public Domain Dedication."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format(what="program", sign=";", kind="General", either="; either", n=2)),
    ("GPL-2.0", _GNU_TITLE.format(kind="GENERAL", n=2, day="June 1991", years="1989, 1991")),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format(what="program", sign=":", kind="General", either=", either", n=3)),
    ("GPL-3.0", _GNU_TITLE.format(kind="GENERAL", n=3, day="29 June 2007", years="2007")),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. {_PERMIT}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. {_PERMIT}"),
    ("LGPL-2.1", _GNU.format(what="library", sign=";", kind="Lesser General", either="; either", n="2.1")),
    ("LGPL-2.1", _GNU_TITLE.format(kind="LESSER GENERAL", n="2.1", day="February 1999", years="1991, 1999")),
    ("LGPL-3.0", "This library is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format(what="library", sign=":", kind="Lesser General", either=", either", n=3)),
    ("LGPL-3.0", _GNU_TITLE.format(kind="LESSER GENERAL", n=3, day="29 June 2007", years="2007")),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("Proprietary", "All rights reserved."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."),
]


def _tags(names: list[str]) -> list[tuple[str, str]]:
    """SPDX tags of licences; those of GNU come in two more forms."""
    out = []
    for n in names:
        forms = [n, f"{n}-only", f"{n}-or-later"] if "GPL" in n else [n]
        out += [(n, f"SPDX-License-Identifier: {f}") for f in forms]
    return out


TEMPLATES = NOTICES + _tags(sorted({n for n, _ in NOTICES} - {"Proprietary"}))


def terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def _template_terms(spark, templates) -> list[list[str]]:
    """Terms of each template, by the same expression as the files'."""
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(templates)], "i int, text string").select("i", terms(F.col("text")).alias("t"))
    out: list[list[str]] = [[] for _ in templates]
    for r in df.collect():
        out[r["i"]] = r["t"]
    return out


def _frequencies(files: DataFrame, text_col: str, vocabulary: list[str]) -> tuple[int, dict[str, int]]:
    """Number of files with a text; of each template term the files that hold it."""
    known = F.array(*map(F.lit, vocabulary))
    held = files.where(named(text_col).isNotNull()).select(F.array_intersect(terms(named(text_col)), known).alias("t"))
    # One row a file that holds none of them still counts: the empty string stands for all files.
    rows = held.select(F.explode(F.concat("t", F.array(F.lit("")))).alias("t")).groupBy("t").count().collect()
    df = {r["t"]: r["count"] for r in rows}
    return df.pop("", 0), df


def signature_terms(vector: dict[str, float], threshold: float) -> set[str]:
    """The heaviest terms of a unit vector, without which no other unit vector reaches the threshold."""
    rest, out = 1.0, set()
    for t, w in sorted(vector.items(), key=lambda x: (-x[1], x[0])):
        if rest < threshold * threshold - 1e-9:
            break
        out.add(t)
        rest -= w * w
    return out


def anchors(template: list[str], vector: dict[str, float], threshold: float) -> dict[str, int]:
    """The terms at which a template is laid on a file, with their places in it."""
    marks = signature_terms(vector, threshold)
    once = {t for t in marks if template.count(t) == 1}
    return {t: template.index(t) for t in once or marks}


def own_licences(
    files: DataFrame, scratch: Scratch, *, text_col: str = "text", templates=TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """(doc, licences, score, line, share) of each distinct text that has a licence; doc is its MD5, line that of the first span."""
    spark = files.sparkSession
    bags = _template_terms(spark, templates)
    vocabulary = sorted({t for b in bags for t in b})
    n, df = _frequencies(files, text_col, vocabulary)
    idf = {t: math.log((1 + n) / (1 + df.get(t, 0))) + 1 for t in vocabulary}
    unseen = math.log(1 + n) + 1
    vectors = []
    for b in bags:
        norm = math.sqrt(sum((b.count(t) * idf[t]) ** 2 for t in set(b)))
        vectors.append({t: b.count(t) * idf[t] / norm for t in set(b)})
    laid = [(t, i, at, len(bags[i])) for i, v in enumerate(vectors) for t, at in anchors(bags[i], v, threshold).items()]
    # These tables are bounded by the templates.
    weights = F.broadcast(spark.createDataFrame([(t, i, w) for i, v in enumerate(vectors) for t, w in v.items()], "term string, i int, w double"))
    idfs = F.broadcast(spark.createDataFrame(list(idf.items()), "term string, idf double"))
    places = F.broadcast(spark.createDataFrame(laid, "term string, i int, at int, long int"))

    rows = files.where(named(text_col).isNotNull()).select(F.unhex(F.md5(named(text_col))).alias("doc"), named(text_col).alias("text"))
    marked = F.arrays_overlap(terms(F.col("text")), F.array(*map(F.lit, sorted({t for t, *_ in laid}))))
    rows = rows.where(marked).dropDuplicates(["doc"])
    # Terms hold no line feed, so they are found line by line.
    by_line = F.flatten(F.transform(F.split("text", "\n"), lambda x, i: F.transform(terms(x), lambda t: F.struct(t.alias("term"), i.alias("line")))))
    texts = scratch.keep(rows.select("doc", by_line.alias("t")).withColumn("n", F.size("t")), "texts")
    held = texts.select("doc", F.explode(F.array_distinct(F.transform("t", lambda x: x["term"]))).alias("term"))
    mass = held.join(weights, "term").groupBy("doc", "i").agg(F.sum(F.col("w") * F.col("w")).alias("mass"))
    able = scratch.keep(mass.where(F.col("mass") >= threshold * threshold - 1e-9).select("doc", "i"), "able")

    words = texts.select("doc", "n", F.posexplode("t").alias("pos", "x")).select("doc", "n", "pos", F.col("x.term").alias("term"))
    start = F.col("pos") - F.col("at")
    spans = words.join(places, "term").join(able, ["doc", "i"]).select(
        "doc", "i", F.greatest(start, F.lit(0)).alias("lo"), F.least(start + F.col("long"), F.col("n")).alias("hi")
    )
    spans = scratch.keep(spans.distinct(), "spans")
    inside = F.transform(F.slice("t", F.col("lo") + 1, F.col("hi") - F.col("lo")), lambda x: x["term"])
    bag = spans.join(texts, "doc").select("doc", "i", "lo", "hi", F.explode(inside).alias("term"))
    bag = bag.groupBy("doc", "i", "lo", "hi", "term").agg(F.count(F.lit(1)).alias("tf")).join(idfs, "term", "left").join(weights, ["i", "term"], "left")
    weight = F.col("tf") * F.coalesce("idf", F.lit(unseen))
    # Six decimals: the order in which a sum is taken must not decide a tie.
    score = F.round(F.sum(weight * F.coalesce("w", F.lit(0.0))) / F.sqrt(F.sum(weight * weight)), 6)
    found = scratch.keep(bag.groupBy("doc", "i", "lo", "hi").agg(score.alias("score")).where(F.col("score") >= threshold), "found")

    rank = F.struct("score", (F.col("hi") - F.col("lo")).alias("long"), (-F.col("lo")).alias("first"), (-F.col("i")).alias("template"))
    covered = found.select("doc", "lo", rank.alias("r"), F.explode(F.sequence("lo", F.col("hi") - 1)).alias("pos"))
    best = covered.groupBy("doc", "pos").agg(F.max("r").alias("r"))
    wins = best.groupBy("doc", "r").agg(F.count(F.lit(1)).alias("k")).where(2 * F.col("k") > F.col("r.long"))
    names = F.array(*(F.lit(k) for k, _ in templates))
    wins = wins.select("doc", "k", F.element_at(names, 1 - F.col("r.template")).alias("licence"), F.col("r.score").alias("score"), (-F.col("r.first")).alias("lo"))
    own = wins.groupBy("doc").agg(
        F.array_sort(F.collect_set("licence")).alias("licences"), F.max("score").alias("score"), F.min("lo").alias("lo"), F.sum("k").alias("k")
    )
    own = own.join(texts, "doc").select("doc", "licences", "score", F.get("t", F.col("lo"))["line"].alias("line"), (F.col("k") / F.col("n")).alias("share"))
    own = scratch.keep(own, "own", files=64)
    scratch.drop("texts", "able", "spans", "found")
    return own


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def scan(
    files: DataFrame,
    *,
    path_col: str = "path",
    text_col: str = "text",
    templates=TEMPLATES,
    threshold: float = THRESHOLD,
    file_share: float = FILE_SHARE,
) -> DataFrame:
    """files with _lic_own, _lic_score, _lic_line, _lic_is_file, _lic_inherited, _lic_from (directory), _lic_licence."""
    scratch = Scratch(files.sparkSession, "license")
    files = without_reserved(files, "_lic_")
    own = own_licences(files, scratch, text_col=text_col, templates=templates, threshold=threshold)
    own = own.select(F.col("doc").alias("_lic_doc"), F.col("licences").alias("_lic_own"), F.col("score").alias("_lic_score"), F.col("line").alias("_lic_line"), F.col("share").alias("_lic_share"))
    base = F.regexp_extract(named(path_col), r"(?s)([^/]*)$", 1)
    by_name = F.coalesce(base.rlike(FILE_NAME), F.lit(False))
    rows = files.withColumn("_lic_doc", F.unhex(F.md5(named(text_col)))).join(own, "_lic_doc", "left")
    is_file = F.col("_lic_own").isNotNull() & (by_name | (F.col("_lic_share") >= file_share))
    rows = rows.withColumn("_lic_is_file", F.coalesce(is_file, F.lit(False))).withColumn("_lic_folder", _folder(named(path_col)))
    light = scratch.keep(rows.select(F.col("_lic_folder").alias("folder"), F.when(F.col("_lic_is_file"), F.col("_lic_own")).alias("licences")).distinct(), "folders", files=64)
    holders = light.where("folder IS NOT NULL").select("folder", F.explode("licences").alias("licence")).groupBy("folder").agg(
        F.array_join(F.array_sort(F.collect_set("licence")), " AND ").alias("licence")
    )
    parts = F.split("folder", "/")
    ups = light.select("folder").where("folder IS NOT NULL").distinct().select(
        "folder", F.explode(F.sequence(F.lit(0), F.size(parts))).alias("depth")
    )
    ups = ups.withColumn("up", F.array_join(F.slice(parts, 1, F.col("depth")), "/"))
    near = ups.join(holders.select(F.col("folder").alias("up"), "licence"), "up").groupBy("folder").agg(
        F.max(F.struct("depth", "up", "licence")).alias("m")
    )
    near = near.select(F.col("folder").alias("_lic_folder"), F.col("m.licence").alias("_lic_inherited"), F.col("m.up").alias("_lic_from"))
    near = scratch.keep(near, "inherited", files=64)
    if near.count() <= BROADCAST_DIRS:
        near = F.broadcast(near)
    out = rows.join(near, "_lic_folder", "left").withColumn("_lic_own", F.array_join("_lic_own", " AND "))
    out = out.withColumn("_lic_licence", F.coalesce("_lic_own", "_lic_inherited"))
    return out.select(*all_of(files), "_lic_own", "_lic_score", "_lic_line", "_lic_is_file", "_lic_inherited", "_lic_from", "_lic_licence")
