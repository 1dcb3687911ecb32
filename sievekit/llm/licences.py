"""Licence scans: Dice coefficient over word bigrams against templates (operator 3, native).

A unit of text (the whole text, a paragraph, a line or a run of as many words
as the template has) and a template are normalised the same way: ``A-Z`` as ``a-z``, every run of characters that are
neither letters nor digits one space. Their sets of word bigrams are compared
by ``2 |A n B| / (|A| + |B|)``. A score of ``t`` needs set sizes within a
factor ``(2 - t) / t``, so a unit meets only the templates whose size lies in
that range, and only in texts that hold enough of its bigrams somewhere; most
texts meet none. The template list is short and fixed: it is the only thing
broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sievekit.llm.common import ascii_lower, stash

THRESHOLD = 0.8

# Notices and short licence texts, by licence and form.
TEMPLATES = {
    "Apache-2.0/line": "Licensed under the Apache License, Version 2.0.",
    "Apache-2.0/notice": (
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in '
        "compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, "
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS '
        "OF ANY KIND, either express or implied. See the License for the specific language governing permissions and "
        "limitations under the License."),
    "BSD-2-Clause/text": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
        "that the following conditions are met: 1. Redistributions of source code must retain the above copyright "
        "notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must "
        "reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
        "documentation and/or other materials provided with the distribution."),
    "BSD-3-Clause/line": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "CC-BY-4.0/line": "Licensed under CC BY 4.0.",
    "CC-BY-4.0/notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-NC-4.0/line": "Licensed under CC BY-NC 4.0.",
    "CC-BY-NC-4.0/notice": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "CC-BY-SA-4.0/notice": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    "CC0-1.0/line": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "GPL-3.0/line": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-3.0/notice": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
        "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
        "option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY "
        "WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the "
        "GNU General Public License for more details."),
    "ISC/text": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
        "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    "MIT/line": "Released under the MIT License.",
    "MIT/text": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without '
        "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
        "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions: The above copyright notice and this permission notice shall be included in all copies or "
        "substantial portions of the Software."),
    "MPL-2.0/notice": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
        "was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
}


def _words(text: Column) -> Column:
    """Normalised words (letters and digits of any script) of a text."""
    return F.filter(F.split(F.regexp_replace(ascii_lower(text), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def _bigrams(words: Column) -> Column:
    """Neighbouring words joined by a blank, with repeats (empty below two words)."""
    pairs = F.transform(F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))), lambda w, i: F.concat_ws(
        " ", F.get(words, i), w))
    return pairs


def template_table(spark: SparkSession, templates: dict[str, str] | None = None,
                   threshold: float = THRESHOLD) -> DataFrame:
    """``template, tgrams, tn, tw, lo, hi, need``: bigrams, their number, words, the unit sizes that can reach the
    threshold and the shared bigrams that any such unit has at least."""
    rows = spark.createDataFrame(sorted((templates or TEMPLATES).items()), "template string, text string")
    words = rows.withColumn("w", _words(F.col("text")))
    grams = words.withColumn("tgrams", F.array_distinct(_bigrams(F.col("w")))).filter("size(tgrams) > 0")
    tn = F.size("tgrams")
    lo = F.ceil(tn * threshold / (2 - threshold) - 1e-9)
    return grams.select("template", "tgrams", tn.alias("tn"), F.size("w").alias("tw"), lo.alias("lo"),
                        F.floor(tn * (2 - threshold) / threshold + 1e-9).alias("hi"),
                        F.ceil(threshold * (lo + tn) / 2 - 1e-9).alias("need"))


def candidates(docs: DataFrame, known: DataFrame) -> DataFrame:
    """``id, text, w, t``: the texts that can hold a licence, their words and one entry of ``known`` per row.

    Whatever unit of a text reaches the threshold, its bigrams are bigrams of
    the whole text. So a text is looked at closer for those templates only of
    which it has ``need`` bigrams somewhere; one pass over its words finds out.
    """
    table = known.agg(F.array_sort(F.collect_list(F.struct("template", "tgrams", "tn", "tw", "lo", "hi", "need"))).alias("ts"),
                      F.array_distinct(F.flatten(F.collect_list("tgrams"))).alias("all"))
    words = docs.withColumn("w", _words(F.col("text")))
    # One row: all bigrams of all templates, looked up by hash; the words of a text are hashed once.
    marks = table.select("ts", F.transform("all", lambda g: F.xxhash64(F.xxhash64(F.split_part(g, F.lit(" "), F.lit(1))),
                                           F.xxhash64(F.split_part(g, F.lit(" "), F.lit(2))))).alias("marks"))
    met = words.withColumn("h", F.transform("w", lambda w: F.xxhash64(w))).crossJoin(F.broadcast(marks))
    pairs = F.transform(F.slice("h", F.lit(2), F.greatest(F.size("h") - 1, F.lit(0))), lambda x, i: F.xxhash64(F.get("h", i), x))
    # A hash may be shared by chance: exact bigrams decide below. One-row generators here and below keep a filter
    # from being pushed to where it would work out the arrays a second time.
    shared = F.size(F.array_intersect(pairs, "marks"))
    few = met.select("id", "text", "w", "ts", F.inline_outer(F.array(F.struct(shared.alias("n_marks"))))).filter(
        F.col("n_marks") >= F.array_min(F.transform("ts", lambda t: t["need"])))
    grams = few.withColumn("grams", F.array_distinct(_bigrams(F.col("w"))))
    some = F.filter("ts", lambda t: F.size(F.array_intersect("grams", t["tgrams"])) >= t["need"])
    return grams.select("id", "text", "w", F.explode_outer(some).alias("t")).filter("t IS NOT NULL")


def scan_units(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``id, unit, part, template, score``: every unit that reaches the threshold with a template.

    ``unit`` is ``text``, ``paragraph`` (cut at blank lines), ``line`` or
    ``run``: as many words as the template has, from a bigram that both share,
    across lines and paragraphs. ``part`` is the unit's number from 0 (of a
    run, the place of its first word).
    """
    known = template_table(docs.sparkSession, templates, threshold)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    found = stash(candidates(docs.select(F.col(id_col).alias("id"), text.alias("text")), known), "candidates")
    label = lambda kind, parts: F.transform(parts, lambda x, i: F.struct(
        F.lit(kind).alias("unit"), i.alias("part"), _words(x).alias("w")))
    pieces = found.select("id", "t", F.inline_outer(F.concat(
        label("paragraph", F.split("text", r"\n[ \t\r]*\n")), label("line", F.split("text", "\n")))))
    starts = F.filter(F.transform(_bigrams(F.col("w")), lambda g, i: F.when(F.array_contains(F.col("t.tgrams"), g), i)),
                      lambda i: i.isNotNull())
    # A run needs ``need`` shared bigrams, so as many starts lie inside it.
    runs = found.withColumn("at", starts).select("id", "t", "w", F.posexplode_outer("at").alias("k", "part"), "at").filter(
        F.get("at", F.col("k") + F.col("t.need").cast("int") - 1) < F.col("part") + F.col("t.tw") - 1)
    units = found.select("id", "t", F.lit("text").alias("unit"), F.lit(0).alias("part"), "w").unionByName(pieces).unionByName(
        runs.select("id", "t", F.lit("run").alias("unit"), "part", F.slice("w", F.col("part") + 1, F.col("t.tw")).alias("w")))
    # Every distinct word but one ends a bigram of its own: too many distinct words need no bigrams.
    sized = units.filter((F.size("w") > F.col("t.lo")) & (F.size(F.array_distinct("w")) <= F.col("t.hi") + 1))
    grams = F.array_distinct(_bigrams(F.col("w")))
    sized = sized.select("id", "unit", "part", "t", F.inline_outer(F.array(F.struct(grams.alias("grams"))))).select(
        "id", "unit", "part", "t", F.inline_outer(F.array(F.struct("grams", F.size("grams").alias("n")))))
    scored = sized.filter((F.col("n") >= F.col("t.lo")) & (F.col("n") <= F.col("t.hi"))).withColumn(
        "score", 2.0 * F.size(F.array_intersect("grams", F.col("t.tgrams"))) / (F.col("n") + F.col("t.tn")))
    return scored.filter(F.col("score") >= threshold).select("id", "unit", "part", F.col("t.template").alias("template"), "score")


def scan_licences(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                  templates: dict[str, str] | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``id_col, licence, template, score, n_lines, licences`` for every row of ``docs``.

    ``template`` is the one with the highest Dice score over all units of the
    text (ties: the first by name), ``licence`` its licence, ``licences`` all
    licences found, sorted and comma-joined, ``n_lines`` the lines that reach
    the threshold. Texts without a match, null and empty texts have nulls,
    an empty list and 0. Rows that share an id are one document: each shows
    the findings of all. An empty table gives an empty result; other columns
    are not read.
    """
    hits = stash(scan_units(docs, id_col, text_col, templates, threshold), "hits")
    name = F.substring_index("template", "/", 1)
    found = hits.groupBy("id").agg(
        F.min_by("template", F.struct(-F.col("score"), F.col("template"))).alias("template"),
        F.max("score").alias("score"),
        F.countDistinct(F.when(F.col("unit") == "line", F.col("part"))).alias("n_lines"),
        F.array_join(F.array_sort(F.collect_set(name)), ",").alias("licences"))
    out = docs.select(F.col(id_col)).join(found, F.col(id_col).eqNullSafe(F.col("id")), "left")
    return out.select(id_col, name.alias("licence"), "template", F.round("score", 6).alias("score"),
                      F.coalesce("n_lines", F.lit(0)).alias("n_lines"),
                      F.coalesce("licences", F.lit("")).alias("licences"))
