"""Licence scans, native: lines and windows of words compared with licence templates by Dice's coefficient over word bigrams.

A line is lower-cased (A-Z), what isn't a-z or 0-9 parts words, and its distinct pairs of
neighbouring words make a set. Dice is 2 |A and B| / (|A| + |B|), so a template can reach a
threshold t only if |A| lies between t / (2 - t) |B| and (2 - t) / t |B|: other templates are not
compared. Lines without a pair of words match nothing.

Notices that are wrapped or stand within longer lines are found by windows over the words of the
whole text (``windows``), with whole short licences and further notices as templates. A window has
as many words as its template, or up to half as many more: a shorter one could leave out just the
version number. Of overlapping windows the one with most common pairs after the pairs of one side alone are
taken off stays. A line that matches counts as such, unless a window twice as long contains it.

Templates are a table (``template_table``; any number of them). Either way a match holds at least t / (2 - t) of a
template's pairs, so it holds one of any larger remainder of them: the rarest pairs, by their length, are an inverted index. Texts
are read once: their pairs are looked up among the hashes of the index, texts without any are done with, and the others are joined with the
index and the templates (a parameter, whose tables Spark broadcasts) and compared with the templates that come out. No text leaves its task.

Null and empty texts have no match; texts may be of any length; an empty table gives an empty table; repeated rows
give equal rows, each as often as before; matches that tie go to the later place, lines that tie to the last licence by name; extra columns
are not read.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .line_dedup import UPPER, ascii_lower, let, split_lines
from .staging import staged

THRESHOLD = 0.8

# Notices by which public licences are commonly applied, by SPDX identifier.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("BSD-2-Clause", "Use of this source code is governed by a BSD 2-Clause license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MIT", "Released under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]

_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_NAMES = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_AS_IS = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) "
    "HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
)
_MIT_KEEP = " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
_APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
    'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
    "See the License for the specific language governing permissions and limitations under the License."
)


def _gnu(name: str, version: str, later: bool = True) -> str:
    of = f"either version {version} of the License, or (at your option) any later version." if later else f"version {version} of the License."
    return f"This program is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the Free Software Foundation, {of}"


_VERBATIM = "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
#: Templates of windows besides TEMPLATES: whole short licences, notices, and how the long licences begin.
NOTICES = [
    ("AGPL-3.0", _gnu("Affero General Public License", "3")),
    ("AGPL-3.0", _gnu("Affero General Public License", "3", later=False)),
    ("AGPL-3.0", f"GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("Apache-2.0", _APACHE),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSD-3-Clause", _BSD + _BSD_NAMES + _BSD_AS_IS),
    ("GPL-2.0", _gnu("General Public License", "2")),
    ("GPL-2.0", _gnu("General Public License", "2", later=False)),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation."),
    ("GPL-2.0", f"GNU GENERAL PUBLIC LICENSE Version 2, June 1991 Copyright (C) 1989, 1991 Free Software Foundation, Inc. {_VERBATIM}"),
    ("GPL-3.0", _gnu("General Public License", "3")),
    ("GPL-3.0", _gnu("General Public License", "3", later=False)),
    ("GPL-3.0", f"GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
     'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER '
     "RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1")),
    ("LGPL-2.1", _gnu("Lesser General Public License", "2.1", later=False)),
    ("LGPL-2.1", f"GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999 Copyright (C) 1991, 1999 Free Software Foundation, Inc. {_VERBATIM}"),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3")),
    ("LGPL-3.0", _gnu("Lesser General Public License", "3", later=False)),
    ("LGPL-3.0", f"GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007 Copyright (C) 2007 Free Software Foundation, Inc. {_VERBATIM}"),
    ("MIT", _MIT),
    ("MIT", _MIT + _MIT_KEEP + _AS_IS),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Distributed under the MIT License."),
    ("MIT", "Under the terms of the MIT License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
]
#: Words of a window by words of its template.
SIZES = (1.0, 1.1, 1.2, 1.3, 1.4, 1.5)


def template_bigrams(text: str) -> list[str]:
    w = re.findall("[a-z0-9]+", text.lower())
    return sorted({f"{a} {b}" for a, b in zip(w, w[1:])})


def split_words(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(text), "[^a-z0-9]+"), "")


def neighbours(w: Column) -> Column:
    """All pairs of neighbouring words, in order; ``w`` is read several times."""
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))


def pair_hashes(w: Column) -> Column:
    return F.when(F.size(w) > 1, F.zip_with(F.slice(w, 1, F.size(w) - 1), F.slice(w, 2, F.size(w) - 1), lambda a, b: F.xxhash64(a, b))).otherwise(F.array().cast("array<bigint>"))


def template_table(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, notices: list[tuple[str, str]] = NOTICES) -> DataFrame:
    """(license, text, by_line): ``templates`` are compared with lines and windows, ``notices`` with windows only. Any table of these columns will do."""
    rows = [F.struct(F.lit(n).alias("license"), F.lit(t).alias("text"), F.lit(line).alias("by_line")) for of, line in ((templates, True), (notices, False)) for n, t in of]
    return spark.range(1).select(F.inline(F.array(*rows)))


def prepared(templates: DataFrame, threshold: float) -> DataFrame:
    """tid, license, by_line, n (words), known (pairs), least (pairs that a match holds), low and high (pairs that a line has)."""
    share = threshold / (2 - threshold)
    words = templates.select("license", "by_line", split_words(F.col("text")).alias("w")).groupBy("license", "w").agg(F.bool_or("by_line").alias("by_line"))
    known = words.select(F.xxhash64("license", "w").alias("tid"), "license", "by_line", F.size("w").alias("n"), F.array_sort(F.array_distinct(neighbours(F.col("w")))).alias("known")).where(F.size("known") > 0)
    size = F.size("known")
    return known.select("*", F.greatest(F.lit(1), F.ceil(share * size - 1e-9).cast("int")).alias("least"), (share * size - 1e-9).alias("low"), (size / share + 1e-9).alias("high"))


def inverted_index(known: DataFrame) -> DataFrame:
    """(pair, tid, pairs): the hash of each of as many pairs of a template, longest first, as a match can't do without, and of all of them."""
    ordered = F.transform(F.array_sort(F.transform("known", lambda b: F.struct((-F.length(b)).alias("l"), b.alias("b")))), lambda x: x["b"])
    chosen = F.slice(ordered, F.lit(1), F.size("known") - F.col("least") + 1)
    pairs = F.transform(chosen, lambda b: let(F.split(b, " "), lambda w: F.xxhash64(w[0], w[1])))
    return known.select("tid", pairs.alias("pairs")).select(F.explode("pairs").alias("pair"), "tid", "pairs")


KEY = ("doc_id", "th1", "th2")


def keyed(docs: DataFrame, row_id: str, text: str) -> DataFrame:
    return docs.select(F.col(row_id).alias("doc_id"), F.xxhash64(text).alias("th1"), F.xxhash64(F.lit(1), F.col(text)).alias("th2"), F.coalesce(text, F.lit("")).alias("text"))


def same_row(left: DataFrame, right: DataFrame) -> Column:
    return left["doc_id"].eqNullSafe(right["__doc_id"]) & (left["th1"] == right["__th1"]) & (left["th2"] == right["__th2"])


def renamed(rows: DataFrame) -> DataFrame:
    return rows.select(*(F.col(c).alias(f"__{c}") for c in KEY), *(c for c in rows.columns if c not in KEY))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``docs`` (see ``keyed``) with the tid of each template that may match in the text, a row each."""
    index = staged(inverted_index(known), "pairs")
    pairs = [r[0] for r in index.select("pair").distinct().collect()]  # of the templates, which are a parameter
    found = let(split_words(F.col("text")), lambda w: F.array_distinct(F.filter(pair_hashes(w), lambda x: x.isin(pairs) if pairs else F.lit(False))))
    some = docs.withColumn("found", found).where(F.size("found") > 0)
    met = some.select("*", F.explode("found").alias("pair")).join(F.broadcast(index), "pair")
    # A template that several pairs of the text name counts where the first of them does.
    return met.where(F.col("pair") == F.get(F.array_intersect("pairs", "found"), F.lit(0))).select(*KEY, "text", "tid")


def line_matches(text: Column, t: Column, threshold: float) -> Column:
    """array<struct<line, dice, license, at, to>>: lines that reach the threshold, from 0, and their words ``at`` to ``to`` - 1."""
    lines = let(split_lines(text), lambda ls: F.transform(ls, lambda x: split_words(x)))

    def compared(w: Column, i: Column) -> Column:
        return let(F.array_distinct(neighbours(w)), lambda b: F.when(F.size(b).between(t["low"], t["high"]), F.struct(
            i.alias("line"), F.round(2.0 * F.size(F.array_intersect(b, t["known"])) / (F.size(b) + F.size(t["known"])), 6).alias("dice"), t["license"].alias("license"), F.size(w).alias("n"))))

    def found(ls: Column) -> Column:
        good = F.filter(F.transform(ls, compared), lambda m: m["dice"] >= threshold)
        before = lambda m: F.aggregate(F.slice(ls, F.lit(1), m["line"]), F.lit(0), lambda n, w: n + F.size(w))
        return F.transform(good, lambda m: let(before(m), lambda at: F.struct(m["line"].alias("line"), m["dice"].alias("dice"), m["license"].alias("license"), at.alias("at"), (at + m["n"]).alias("to"))))

    return let(lines, found)


def windows(text: Column, t: Column, threshold: float) -> Column:
    """array<struct<gain, at, to, dice, license>>: at each place the best window of words ``at`` to ``to`` - 1 that reaches the threshold; ``at`` is negated, so that the first of equals is the largest."""

    def compared(g: Column, at: Column, size: float) -> Column:
        """The window of words that begins at pair ``at``; it ends where the text does."""
        to = F.least(at + F.ceil(t["n"] * F.lit(size)).cast("int"), F.size(g) + 1)
        return let(F.array_distinct(F.slice(g, at + 1, to - at - 1)), lambda a: let(F.size(F.array_intersect(a, t["known"])), lambda c: F.struct(
            (3 * c - F.size(a) - F.size(t["known"])).alias("gain"), (-at).alias("at"), to.alias("to"),
            F.round(2.0 * c / (F.size(a) + F.size(t["known"])), 6).alias("dice"), t["license"].alias("license"))))

    def search(g: Column) -> Column:
        def starts(h: Column) -> Column:
            # Enough known pairs must follow within the longest window.
            near = F.filter(h, lambda x, q: F.coalesce(F.get(h, q + t["least"] - 1) - x < F.ceil(t["n"] * F.lit(SIZES[-1])), F.lit(False)))
            best = F.transform(near, lambda x: F.array_max(F.filter(F.array(*(compared(g, x, m) for m in SIZES)), lambda m: m["dice"] >= threshold)))
            return F.filter(best, lambda m: m.isNotNull())

        return let(F.filter(F.transform(g, lambda b, i: F.when(F.array_contains(t["known"], b), i)), lambda i: i.isNotNull()), starts)

    return let(let(split_words(text), neighbours), search)


def apart(found: Column) -> Column:
    """Windows that don't overlap: by gain, then by place in the text."""
    kind = "array<struct<gain:int,at:int,to:int,dice:double,license:string>>"
    best_first = F.transform(F.reverse(F.array_sort(found)), lambda m: F.struct(m["gain"].alias("gain"), (-m["at"]).alias("at"), m["to"].alias("to"), m["dice"].alias("dice"), m["license"].alias("license")))
    free = lambda kept, m: ~F.exists(kept, lambda k: (k["at"] < m["to"]) & (m["at"] < k["to"]))
    return F.aggregate(best_first, F.array().cast(kind), lambda kept, m: F.when(free(kept, m), F.concat(kept, F.array(m)).cast(kind)).otherwise(kept))


def best_of_lines(found: Column) -> Column:
    """The best template of each line; a tie goes to the last name in order."""
    return let(F.array_sort(found), lambda ms: F.filter(ms, lambda m, i: F.coalesce(F.get(ms, i + 1)["line"] != m["line"], F.lit(True))))


def merged(lines: Column, found: Column) -> Column:
    """array<struct<dice, license>>: matching lines, and windows apart from them; a window twice as long as a line that it contains replaces it."""
    kind = "array<struct<dice:double,license:string>>"
    plain = lambda ms: F.transform(ms, lambda m: F.struct(m["dice"].alias("dice"), m["license"].alias("license")))
    over = lambda w, m: (w["at"] <= m["at"]) & (w["to"] >= m["to"]) & (w["to"] - w["at"] >= 2 * (m["to"] - m["at"]))
    touch = lambda w, m: (w["at"] < m["to"]) & (m["at"] < w["to"])
    wide = F.filter(found, lambda w: ~F.exists(lines, lambda m: touch(w, m) & ~over(w, m)))
    return let(wide, lambda ws: F.concat(plain(F.filter(lines, lambda m: ~F.exists(ws, lambda w: over(w, m)))), plain(ws)).cast(kind))


def compared(docs: DataFrame, templates: DataFrame, threshold: float) -> DataFrame:
    """(__doc_id, __th1, __th2, lines, found) of the texts (see ``keyed``) in which a line or a window matches."""
    known = staged(prepared(templates, threshold), "templates")
    rows = candidates(docs, known).join(F.broadcast(known), "tid")
    t = F.struct("license", "n", "known", "least", "low", "high")
    none = lambda c: c.cast("array<struct<line:int,dice:double,license:string,at:int,to:int>>")
    lines = F.when(F.col("by_line"), none(let(t, lambda x: line_matches(F.col("text"), x, threshold)))).otherwise(none(F.array()))
    hits = rows.select(*KEY, lines.alias("lines"), let(t, lambda x: windows(F.col("text"), x, threshold)).alias("found")).where((F.size("lines") > 0) | (F.size("found") > 0))
    hits = hits.groupBy(*KEY).agg(F.array_distinct(F.flatten(F.collect_list("lines"))).alias("lines"), F.array_distinct(F.flatten(F.collect_list("found"))).alias("found"))
    return staged(renamed(hits).select(*(f"__{c}" for c in KEY), best_of_lines(F.col("lines")).alias("lines"), apart(F.col("found")).alias("found")), "matches")


def scan(docs: DataFrame, row_id: str = "doc_id", text: str = "text", templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """row_id, matches (array<struct<line, dice, license, at, to>>: the best template of each line that reaches the threshold) of every row."""
    rows = keyed(docs, row_id, text)
    hits = compared(rows, template_table(docs.sparkSession, notices=[]) if templates is None else templates, threshold)
    return rows.join(hits, same_row(rows, hits), "left").select(F.col("doc_id").alias(row_id), F.coalesce("lines", F.expr("array()").cast(hits.schema["lines"].dataType)).alias("matches"))


def report(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_matches, licenses (distinct, sorted, comma-joined), best_dice (0 without a match) of every row."""
    rows = keyed(docs, "doc_id", "text")
    hits = compared(rows, template_table(docs.sparkSession) if templates is None else templates, threshold)
    hits = hits.withColumn("matches", merged(F.col("lines"), F.col("found"))).drop("lines", "found")
    return rows.join(hits, same_row(rows, hits), "left").select(
        "doc_id",
        F.coalesce(F.size("matches"), F.lit(0)).cast("long").alias("n_matches"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct("matches.license")), ","), F.lit("")).alias("licenses"),
        F.coalesce(F.array_max("matches.dice"), F.lit(0.0)).alias("best_dice"),
    )


def _sql() -> str:
    rows = ",\n        ".join("('%s', [%s])" % (name, ", ".join(f"'{b}'" for b in template_bigrams(t))) for name, t in TEMPLATES)
    return f"""
WITH templates(name, known) AS (
    VALUES
        {rows}
), lines AS (
    SELECT r, p, list_filter(regexp_split_to_array(translate(line, '{UPPER}', '{UPPER.lower()}'), '[^a-z0-9]+'), lambda x: x <> '') AS w
    FROM (SELECT r, unnest(l) AS line, generate_subscripts(l, 1) AS p FROM (SELECT row_number() OVER () AS r, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))
), pairs AS (
    SELECT r, p, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS b FROM lines WHERE len(w) > 1
), compared AS (
    SELECT r, p, round(2.0 * len(list_intersect(b, known)) / (len(b) + len(known)), 6) AS dice, name
    FROM pairs, templates
    WHERE len(b) BETWEEN {THRESHOLD / (2 - THRESHOLD)} * len(known) - 1e-9 AND {(2 - THRESHOLD) / THRESHOLD} * len(known) + 1e-9
), best AS (
    SELECT r, p, max(struct_pack(dice := dice, name := name)) AS m FROM compared WHERE dice >= {THRESHOLD} GROUP BY r, p
), rows AS (
    SELECT r, count(*) AS n, string_agg(DISTINCT m.name, ',' ORDER BY m.name) AS licenses, max(m.dice) AS dice FROM best GROUP BY r
)
SELECT doc_id, coalesce(n, 0) AS n_matches, coalesce(licenses, '') AS licenses, coalesce(dice, 0)::DOUBLE AS best_dice
FROM (SELECT doc_id, row_number() OVER () AS r FROM documents) LEFT JOIN rows USING (r)
"""


SQL = _sql()
