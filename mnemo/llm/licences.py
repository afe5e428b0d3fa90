"""Licence scans: Dice coefficient over word bigrams, with DataFrame functions only.

A document's passages (its lines, its paragraphs of several lines, and itself if it has several of those) are normalised to lower-case words and compared to
licence templates: 2 * shared distinct bigrams / (bigrams of one + bigrams of the other). At a coefficient of at least T the sizes
must be within T / (2 - T) of each other, so templates out of a passage's bounds are pruned before any bigram is compared, and so is
a passage that has none of the templates' marks: for each template marks are chosen such that a passage without them can't share
enough bigrams. Both are exact.

The templates are a table of constants: bounded, broadcast, and met by bigram hash; a passage and template that share a bigram make
one group, so a licence line in a third of all documents is summed where it is read.

Defined cases: null and empty texts have no passage; passages of fewer than 3 words are too short for a template; of equal best
templates the first by name counts; repeated rows give their results each (grouped by row, not by doc_id); other columns are unused.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

THRESHOLD = 0.8

# Short notices and the paragraphs of well-known licences, by name.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0',
    "apache-2.0-disclaimer": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "mit-notice": "Released under the MIT License.",
    "mit-notice-licensed": "Licensed under the MIT License.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:',
    "mit-condition": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-disclaimer": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.",
    "lgpl-3.0-notice": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-notice": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "bsd-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "reserved": "All rights reserved.",
}


#: Words too common to tell a licence by; they are marks only where nothing else is left. Fixed values.
_COMMON = set("a an and any are as at be by for from in is it may not of on or that the this to under use with without".split())


def words_of(text: str) -> list[str]:
    return re.sub(r"[^a-z0-9]+", " ", text.lower()).split()


def bigrams_of(text: str) -> set[str]:
    words = words_of(text)
    return {f"{a} {b}" for a, b in zip(words, words[1:])}


def bounds(size: int, threshold: float) -> tuple[int, int]:
    """Least and most distinct bigrams of a passage that can reach the threshold with a template of size."""
    return math.ceil(size * threshold / (2 - threshold) - 1e-9), math.floor(size * (2 - threshold) / threshold + 1e-9)


def marks(templates: dict[str, str], threshold: float) -> list[str]:
    """Words of which a passage that reaches the threshold with any template has at least one.

    Such a passage shares at least threshold * (least size + size) / 2 bigrams with its template; words are marked, longest
    first, until fewer bigrams than that are without a mark.
    """
    chosen: set[str] = set()
    for text in templates.values():
        grams = [g.split() for g in bigrams_of(text)]
        need = math.ceil(threshold * (bounds(len(grams), threshold)[0] + len(grams)) / 2 - 1e-9)
        for word in sorted({w for g in grams for w in g}, key=lambda w: (w in _COMMON, w not in chosen, -len(w), w)):
            if sum(not (set(g) & chosen) for g in grams) < need:
                break
            chosen.add(word)
    return sorted(chosen)


def _words(passage: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(passage), "[^a-z0-9]+", " ")), " ")


def scan(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, passage ('line', 'paragraph' or 'document'), place (from 0, of its kind), licence, shared bigrams and dice of each match."""
    templates = TEMPLATES if templates is None else templates
    spark = docs.sparkSession
    grams = {name: bigrams_of(text) for name, text in templates.items()}
    grams = {name: g for name, g in grams.items() if len(g) >= 2}
    wanted = spark.createDataFrame([(name, len(g), *bounds(len(g), threshold), gram) for name, g in grams.items() for gram in sorted(g)] or [("", 0, 0, 0, "")], "licence string, size int, low int, high int, gram string")
    sizes = [bounds(len(g), threshold) for g in grams.values()] or [(1, 0)]
    least, most = min(a for a, _ in sizes), max(b for _, b in sizes)
    mark = "(?<![a-z0-9])(?:" + "|".join(marks({n: templates[n] for n in grams}, threshold)) + ")(?![a-z0-9])"

    marked = docs.select("doc_id", "text").where(F.lower("text").rlike(mark)).withColumn("row", F.monotonically_increasing_id())
    lines = F.split("text", "\n", -1)
    paragraphs = F.split("text", "\n[\\t\\r ]*\n\\s*", -1)

    def numbered(kind: str, parts: Column, only: Column | None = None) -> Column:
        one = F.transform(parts, lambda p, i: F.struct(F.lit(kind).alias("passage"), i.cast("long").alias("place"), p.alias("body")))
        one = F.filter(one, lambda p: F.lower(p["body"]).rlike(mark))
        return F.when(only, one).otherwise(F.array().cast(f"array<struct<passage:string,place:bigint,body:string>>")) if only is not None else one

    whole = F.array(F.col("text"))
    several = F.filter(paragraphs, lambda p: F.contains(p, F.lit("\n")))
    passages = F.concat(numbered("line", lines), numbered("paragraph", several), numbered("document", whole, F.size(paragraphs) > 1))
    each = marked.select("doc_id", "row", F.explode(passages).alias("p"))

    def bigrams(words: Column) -> Column:
        return F.array_distinct(F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(" ", w, F.get(words, i + 1))))

    # Passages out of all templates' bounds by their number of words alone go first: distinct bigrams are at most one fewer.
    each = each.where(F.regexp_count(F.lower("p.body"), F.lit("[a-z0-9]+")) > least)
    # The words are bound to a lambda's variable, so that the optimiser can't write their split out once for each word.
    each = each.select("doc_id", "row", "p.passage", "p.place", F.transform(F.array(_words(F.col("p.body"))), bigrams)[0].alias("grams"))
    each = each.withColumn("n", F.size("grams")).where((F.col("n") >= least) & (F.col("n") <= most))
    met = each.select("doc_id", "row", "passage", "place", "n", F.explode("grams").alias("gram")).join(F.broadcast(wanted), "gram")
    met = met.where((F.col("n") >= F.col("low")) & (F.col("n") <= F.col("high")))
    dice = met.groupBy("doc_id", "row", "passage", "place", "n", "licence", "size").agg(F.count("*").alias("shared"))
    dice = dice.withColumn("dice", 2 * F.col("shared") / (F.col("n") + F.col("size"))).where(F.col("dice") >= threshold)
    best = dice.groupBy("doc_id", "row", "passage", "place").agg(F.min(F.struct((-F.col("dice")).alias("minus"), "licence", "shared")).alias("b"))
    return best.select("doc_id", "passage", "place", F.col("b.licence").alias("licence"), F.col("b.shared").alias("shared"), (-F.col("b.minus")).alias("dice"))


def _literal(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def oracle_sql(threshold: float = THRESHOLD) -> str:
    """The same by comparing every passage with every template."""
    rows = ", ".join(f"({_literal(n)}, {_literal(' '.join(words_of(t)))})" for n, t in TEMPLATES.items())
    normal = "string_split(trim(regexp_replace(lower({}), '[^a-z0-9]+', ' ', 'g')), ' ')"
    grams = "list_distinct(list_transform(range(1, len({0})), lambda i: {0}[i] || ' ' || {0}[i + 1]))"
    return f"""with templates as (select * from (values {rows}) v(licence, body)),
known as (select licence, {grams.format("string_split(body, ' ')")} as grams from templates),
pieces as (
  select doc_id, 'line' as passage, string_split(text, chr(10)) as parts from documents
  union all
  select doc_id, 'paragraph', list_filter(regexp_split_to_array(text, '\\n[\\t\\r ]*\\n\\s*'), lambda p: contains(p, chr(10))) from documents
  union all
  select doc_id, 'document', [text] from documents where len(regexp_split_to_array(text, '\\n[\\t\\r ]*\\n\\s*')) > 1),
placed as (select doc_id, passage, unnest(range(0, len(parts))) as place, unnest(parts) as body from pieces),
worded as (select doc_id, passage, place, {normal.format("body")} as words from placed),
read as (select doc_id, passage, place, {grams.format("words")} as grams from worded where len(words) > 2),
compared as (
  select doc_id, passage, place, licence, len(list_intersect(read.grams, known.grams)) as shared,
         2 * len(list_intersect(read.grams, known.grams)) / cast(len(read.grams) + len(known.grams) as double) as dice
  from read, known where len(read.grams) between 2 and 400),
ranked as (select *, row_number() over (partition by doc_id, passage, place order by dice desc, licence) as n from compared where dice >= {threshold})
select doc_id, passage, cast(place as bigint) as place, licence, cast(shared as bigint) as shared, dice from ranked where n = 1"""
