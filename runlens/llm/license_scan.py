"""License scans: diagonal voting of rolling word k-grams against the words of templates.

Only DataFrame functions. Every run of K neighbouring words of every text
(PAIR words for phrases and single sentences, which hold few longer runs) is
joined by its hash to the places of that run in the templates. Hits on one
diagonal (place in the text less place in the template) vote for one start;
diagonals next to each other are merged, which lets a few words be missing or
added, and a span counts once enough of the template's runs are covered. Each
hit is verified word by word.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import corpus, stored

#: Phrases and their labels; every place where the words stand consecutively counts.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: Sentences that name a license, and the notices and grants of well-known licenses (fixed values), with their labels.
TEMPLATES = {
    "All rights reserved.": "all-rights-reserved",
    "Licensed under the Apache License, Version 2.0": "apache-2.0",
    "Redistribution and use in source and binary forms": "bsd",
    "Licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
    "Licensed under CC BY-NC 4.0": "cc-by-nc-4.0",
    "Licensed under the GNU General Public License, version 3": "gpl-3.0",
    "Released under the MIT License": "mit-notice",
    "Subject to the terms of the Mozilla Public License, version 2.0": "mpl-2.0",
    """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation
    files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy,
    modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software
    is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be
    included in all copies or substantial portions of the Software.""": "mit-text",
    """The Software is provided "as is", without warranty of any kind, express or implied, including but not limited to the
    warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the authors or copyright
    holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from,
    out of or in connection with the software or the use or other dealings in the software.""": "mit-disclaimer",
    """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the
    License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law
    or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR
    CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and
    limitations under the License.""": "apache-2.0-header",
    """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following
    conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the
    following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the
    following disclaimer in the documentation and/or other materials provided with the distribution.""": "bsd-text",
    """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived
    from this software without specific prior written permission.""": "bsd-3-clause",
    """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as
    published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program
    is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.""": "gpl-3.0-notice",
    """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed
    with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""": "mpl-2.0-notice",
    """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted,
    provided that the above copyright notice and this permission notice appear in all copies.""": "isc-text",
    """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile,
    sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or
    non-commercial, and by any means.""": "unlicense-text",
    """This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License. To view a copy of this
    license, visit http://creativecommons.org/licenses/by-sa/4.0/""": "cc-by-sa-4.0-notice",
}
#: Share of a template's runs of words that must stand on merged diagonals.
COVERED = 0.8
#: Words in a run, and in those of templates of fewer than LONG words.
K, PAIR, LONG = 4, 2, 20
#: Diagonals so far apart are merged.
APART = 2

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """Words of ASCII digits, letters (A-Z lower-cased) and all characters beyond ASCII; null has none."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"), "")


def templates() -> list[tuple[str, str, bool, list[str], int]]:
    """(name, label, whether it is a base phrase, words, words in a run) of each template."""
    out = [(t, label, True, t.split(), PAIR) for t, label in BASE.items()]
    for text, label in TEMPLATES.items():
        w = re.findall("[0-9a-z]+", text.lower())
        out.append((" ".join(w), label, False, w, PAIR if len(w) < LONG else K))
    return out


def _runs(docs: DataFrame) -> DataFrame:
    """The fixed table (template, base, runs, k, at, run, hash) of the templates' runs of words."""
    rows = [(name, base, len(w) - k + 1, k, i, w[i : i + k]) for name, _, base, w, k in templates() for i in range(len(w) - k + 1)]
    pairs = F.transform(F.sequence(F.lit(0), F.size("run") - 2), lambda i: F.xxhash64(F.get("run", i), F.get("run", i + 1)))
    table = docs.sparkSession.createDataFrame(rows, "template string, base boolean, runs int, k int, at int, run array<string>").withColumn("pairs", pairs)
    return table.withColumn("hash", F.when(F.col("k") == PAIR, F.get("pairs", F.lit(0))).otherwise(F.xxhash64(F.get("pairs", F.lit(0)), F.get("pairs", F.lit(K - PAIR))))).drop("pairs")


def spans(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, template, base, start, covered, runs): merged diagonals and how many of the template's runs they hold."""
    rolled = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words(F.col("text")).alias("w"))
    rolled = rolled.withColumn("pairs", F.zip_with(F.slice("w", 1, F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", 2, F.size("w")), lambda a, b: F.xxhash64(a, b)))
    # A run of K words is its first and its last pair.
    longer = F.zip_with(F.slice("pairs", 1, F.greatest(F.size("pairs") - (K - PAIR), F.lit(0))), F.slice("pairs", K - PAIR + 1, F.size("pairs")), lambda a, b: F.xxhash64(a, b))
    # An outer explosion: for an inner one the optimiser adds a filter that splits the text a second time.
    hits = rolled.select("doc_id", "text_hash", "w", F.posexplode_outer(F.concat("pairs", longer)).alias("pos", "hash"))
    # The templates are a constant of this module, some six hundred rows.
    hits = hits.join(F.broadcast(_runs(docs)), "hash").withColumn("pos", F.when(F.col("pos") >= F.size("w") - 1, F.col("pos") - F.size("w") + 1).otherwise(F.col("pos")))
    hits = hits.where(F.slice("w", F.col("pos") + 1, F.col("k")) == F.col("run"))
    votes = hits.groupBy("doc_id", "text_hash", "template", "base", "runs", (F.col("pos") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("held"))
    w = Window.partitionBy("doc_id", "text_hash", "template").orderBy("diagonal")
    new = F.coalesce(F.col("diagonal") - F.lag("diagonal").over(w) > F.when(F.col("base"), 0).otherwise(APART), F.lit(True)).cast("int")
    merged = votes.withColumn("new", new).withColumn("span", F.sum("new").over(w)).groupBy("doc_id", "text_hash", "template", "base", "runs", "span")
    return merged.agg(F.min("diagonal").alias("start"), F.size(F.array_distinct(F.flatten(F.collect_list("held")))).alias("covered"))


def license_scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score.

    n_base counts all places of the base phrases, first_word and last_word are
    their smallest and largest start. labels adds the templates of which 0.8
    of the runs of words stand together; score is the largest such share, of
    any template or phrase, 0 without a hit. Null and empty texts have no words,
    no labels (empty strings) and score 0; repeated rows get equal results; an
    empty table gives an empty result; other columns are not read.
    """
    docs = corpus(docs)
    found = stored(spans(docs), "spans")
    label = F.create_map(*(F.lit(x) for name, of, *_ in templates() for x in (name, of)))[F.col("template")]
    whole = F.col("base") & (F.col("covered") == F.col("runs"))
    enough = whole | (~F.col("base") & (F.col("covered") >= COVERED * F.col("runs")))
    named = found.groupBy("doc_id", "text_hash").agg(
        F.count_if(whole).alias("n_base"),
        F.min(F.when(whole, F.col("start"))).cast("long").alias("first_word"),
        F.max(F.when(whole, F.col("start"))).cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.collect_set(F.when(whole, label))), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.collect_set(F.when(enough, label))), ",").alias("labels"),
        F.max(F.col("covered") / F.col("runs")).alias("score"),
    )
    named = named.withColumnsRenamed({"doc_id": "_id", "text_hash": "_hash"})
    rows = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words(F.col("text"))).cast("long").alias("n_words"))
    out = rows.join(named, rows.doc_id.eqNullSafe(named._id) & (rows.text_hash == named._hash), "left")
    return out.select("doc_id", "n_words", F.coalesce("n_base", F.lit(0)).alias("n_base"), "first_word", "last_word", F.coalesce("base_labels", F.lit("")).alias("base_labels"), F.coalesce("labels", F.lit("")).alias("labels"), F.coalesce("score", F.lit(0.0)).alias("score"))


_VALUES = ", ".join(f"('{name}', '{label}', {base}, {k})" for name, label, base, _, k in templates())

SQL = rf"""
WITH tw AS (SELECT t, label, base, k, string_split(t, ' ') AS ws FROM (VALUES {_VALUES}) v(t, label, base, k)),
tp AS (SELECT t, label, base, k, len(ws) - k + 1 AS runs, i AS at, array_to_string(ws[i + 1:i + k], ' ') AS g FROM tw, unnest(range(len(ws) - k + 1)) u(i)),
w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT doc_id, k, i AS pos, array_to_string(ws[i + 1:i + k], ' ') AS g FROM w, (VALUES ({PAIR}), ({K})) s(k), unnest(range(len(ws) - k + 1)) u(i)),
h AS (SELECT DISTINCT doc_id, t, label, base, runs, tp.at AS at_, pos - tp.at AS diagonal FROM g JOIN tp ON g.g = tp.g AND g.k = tp.k),
d AS (SELECT DISTINCT doc_id, t, base, diagonal FROM h),
n AS (SELECT *, CASE WHEN diagonal - lag(diagonal) OVER (PARTITION BY doc_id, t ORDER BY diagonal) <= CASE WHEN base THEN 0 ELSE {APART} END THEN 0 ELSE 1 END AS new FROM d),
s AS (SELECT doc_id, t, diagonal, sum(new) OVER (PARTITION BY doc_id, t ORDER BY diagonal) AS span FROM n),
m AS (SELECT h.doc_id, h.t, any_value(h.label) AS label, any_value(h.base) AS base, any_value(h.runs) AS runs, span, min(h.diagonal) AS start, count(DISTINCT at_) AS covered FROM h JOIN s ON s.doc_id = h.doc_id AND s.t = h.t AND s.diagonal = h.diagonal GROUP BY h.doc_id, h.t, span),
r AS (
  SELECT doc_id, count(*) FILTER (base AND covered = runs) AS n_base, min(start) FILTER (base AND covered = runs) AS first_word, max(start) FILTER (base AND covered = runs) AS last_word,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND covered = runs) AS base_labels,
         string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base AND covered = runs OR NOT base AND covered >= {COVERED} * runs) AS labels,
         max(covered / runs) AS score
  FROM m GROUP BY doc_id)
SELECT w.doc_id, len(ws) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0.0)::double AS score
FROM w LEFT JOIN r USING (doc_id)
"""
