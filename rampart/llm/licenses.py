"""License scans: passages compared with licence templates by the Dice coefficient of their word bigrams.

A passage and a template whose sizes differ too much cannot reach the threshold, so only templates within the
bounds are candidates. Counting shared bigrams is a join with the table of all templates' bigrams, which is fixed.
Bigrams count as often as they occur, so a passage's size is its words less one.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import quoted
from .decontaminate import words_of

#: Licence notices and texts, as published; a licence may have several passages.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the MIT License - see the LICENSE file for details."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without"
            " restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the"
            " Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND"
            " NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,"
            " OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"
                   " http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND,"
                   " either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "SPDX-License-Identifier: GPL-3.0-or-later"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3"
                " of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "SPDX-License-Identifier: GPL-2.0-only"),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2"
                " of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either"
                 " version 2.1 of the License, or (at your option) any later version."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written"
                     " permission."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice"
            " appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at"
                " http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


@dataclass(frozen=True)
class LicenseParams:
    """Least Dice coefficient of a match."""

    threshold: float = 0.8


def template_frame(spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """template number, license, template_size, pair (hash of a bigram), n: one row per different bigram of each template."""
    rows = F.array(*(F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(body).alias("body")) for i, (name, body) in enumerate(templates)))
    words = spark.range(1).select(F.explode(rows).alias("t")).select("t.template", "t.license", words_of(F.col("t.body")).alias("words"))
    return _bigrams(words.withColumn("template_size", F.size("words") - 1)).groupBy("template", "license", "template_size", "pair").agg(F.count(F.lit(1)).alias("n"))


def _bigrams(frame: DataFrame) -> DataFrame:
    """Rows of ``frame`` (with ``words``) for every two words in a row, with their hash ``pair``."""
    at = frame.filter(F.size("words") > 1).select("*", F.explode(F.sequence(F.lit(0), F.size("words") - 2)).alias("at"))
    return at.withColumn("pair", F.xxhash64(F.get("words", F.col("at")), F.get("words", F.col("at") + 1))).drop("words", "at")


def passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """id, row number inside the scan, unit, start line and text of every passage: lines (unit ``line``), blocks of lines between blank
    ones (``block``, where of several lines) and whole texts of several blocks (``text``)."""
    rows = docs.select(quoted(docs, id_col).alias("id"), F.monotonically_increasing_id().alias("row"), quoted(docs, text).cast("string").alias("text")).filter("text is not null")
    lines = rows.select("id", "row", F.posexplode(F.split("text", r"\r?\n")).alias("number", "passage")).select("id", "row", F.lit("line").alias("unit"), "number", "passage")
    blank = r"\n[\x20\t\r]*\n\s*"
    blocks = rows.filter(F.col("text").contains("\n")).select("id", "row", F.posexplode(F.split("text", blank)).alias("number", "passage"))
    blocks = blocks.filter(F.trim("passage").contains("\n")).select("id", "row", F.lit("block").alias("unit"), "number", "passage")
    whole = rows.filter(F.col("text").rlike(blank)).select("id", "row", F.lit("text").alias("unit"), F.lit(0).alias("number"), F.col("text").alias("passage"))
    return lines.unionByName(blocks).unionByName(whole)


def scan(docs: DataFrame, id_col: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, params: LicenseParams = LicenseParams()) -> DataFrame:
    """id, unit, number, license, dice: the best template of every passage that reaches the threshold.

    Of equal coefficients the earlier template counts. Null texts, and passages of fewer than two words, match
    nothing. Rows are told apart, so a repeated row gives repeated results.
    """
    table = template_frame(docs.sparkSession, templates)  # fixed: about 30 templates of 100 bigrams at most
    sizes = [r[0] for r in table.select("template_size").distinct().collect()] or [1]
    ratio = params.threshold / (2 - params.threshold)
    sized = passages(docs, id_col, text).select("id", "row", "unit", "number", words_of(F.col("passage")).alias("words")).withColumn("size", F.size("words") - 1)
    each = _bigrams(sized.filter(F.col("size").between(min(sizes) * ratio, max(sizes) / ratio)))
    fits = (F.col("size") >= F.col("template_size") * ratio) & (F.col("size") * ratio <= F.col("template_size"))
    shared = each.join(F.broadcast(table), "pair").filter(fits)
    same = ["row", "unit", "number", "id", "size", "template", "license", "template_size"]
    both = shared.groupBy(*same, "pair", "n").agg(F.count(F.lit(1)).alias("m")).groupBy(*same).agg((2 * F.sum(F.least("m", "n"))).alias("twice"))
    scored = both.select("*", (F.col("twice") / (F.col("size") + F.col("template_size"))).alias("dice")).filter(F.col("dice") >= params.threshold)
    best = scored.groupBy("row", "unit", "number", "id").agg(F.max(F.struct("dice", (-F.col("template")).alias("order"), "license")).alias("best"))
    return best.select(F.col("id").alias(id_col), "unit", "number", F.col("best.license").alias("license"), F.col("best.dice").alias("dice"))


def oracle_sql(templates: list[tuple[str, str]] = TEMPLATES, params: LicenseParams = LicenseParams()) -> str:
    """DuckDB SQL for ``scan`` of ``documents``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({i}, {quote(name)}, {quote(body)})" for i, (name, body) in enumerate(templates))
    words = r"list_filter(regexp_split_to_array(lower({0}), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')"
    pairs = "list_transform(list_zip(w[1:len(w) - 1], w[2:len(w)]), lambda x: x[1] || ' ' || x[2])"
    return rf"""
with t as (select i, license, {pairs} p from (select i, license, {words.format('body')} w from (values {values}) v(i, license, body)) where len(w) > 1),
lines as (select doc_id, 'line' unit, unnest(regexp_split_to_array(text, '\r?\n')) passage, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) - 1 number from documents where text is not null),
blocks as (select doc_id, 'block' unit, unnest(regexp_split_to_array(text, '\n[\x20\t\r]*\n\s*')) passage, generate_subscripts(regexp_split_to_array(text, '\n[\x20\t\r]*\n\s*'), 1) - 1 number
  from documents where contains(text, chr(10))),
units as (select doc_id, unit, number, passage from lines union all select doc_id, unit, number, passage from blocks where contains(trim(passage, ' '), chr(10))
  union all select doc_id, 'text', 0, text from documents where regexp_matches(text, '\n[\x20\t\r]*\n\s*')),
u as (select doc_id, unit, number, {pairs} p from (select doc_id, unit, number, {words.format('passage')} w from units) where len(w) > 1),
each as (select doc_id, unit, number, size, pair, count(*) m from (select doc_id, unit, number, len(p) size, unnest(p) pair from u) group by all),
te as (select i, license, template_size, pair, count(*) n from (select i, license, len(p) template_size, unnest(p) pair from t) group by all),
d as (select doc_id, unit, number, i, license, 2 * sum(least(m, n)) / (size + template_size) dice from each join te using (pair) group by doc_id, unit, number, i, license, size, template_size)
select doc_id, unit, number, arg_max(license, (dice, -i)) license, max(dice) dice from d where dice >= {params.threshold} group by doc_id, unit, number
"""
