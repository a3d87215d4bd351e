"""License scans: phrases that name a license, and spans of license texts found by diagonal voting.

1. Words of a text are lower-cased runs of letters, digits and other scripts. Base places are where a phrase's words stand.
2. Every run of GRAM words is hashed and joined to the places where the templates have it (hashes that no template has are left
   out by a set before rows are made of them); the words themselves must agree too. Each pair votes for its diagonal, place less template place.
3. Diagonals of a text and template that lie within a quarter of the template's words, SLACK at most, are one span, so that
   inserted, dropped or changed words do not break it.
4. A span stands if SHARE of the template's words and DENSITY of its own words are covered by votes. Its template's label is added.

The score is the greatest share of a template that a standing span covers, or 1 where a phrase stands.

Nulls and edge cases: a null or empty text has no word, no label ('') and score 0; rows are judged one by one, so repeated rows, shared
or null ids get equal results; ties do not arise; very long texts are folded within their row and their votes are rows; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from crawlsmith.llm._store import Tables

#: Parameters.
GRAM = 4
SLACK = 8
SHARE = 0.8
DENSITY = 0.5

#: The phrases of the contract and their labels.
PHRASES = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

#: The wording of public licenses and of the notices that their makers recommend, by label.
TEMPLATES = [
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the
"Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute,
sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN
THE SOFTWARE."""),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO
THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS."""),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form
must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""),
    ("bsd-3-clause", """Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this
software without specific prior written permission."""),
    ("apache", """you may not use this file except in compliance with the License. You may obtain a copy of the License at
http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed
on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."""),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("gpl", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the
Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be
useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""),
    ("gpl-3.0", "licensed under the GNU General Public License, version 3"),
    ("gpl-2.0", "licensed under the GNU General Public License, version 2"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
You can obtain one at https://mozilla.org/MPL/2.0/."""),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or
distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."""),
    ("cc-by-4.0", "Licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0"),
    ("cc-by-nc-4.0", "Licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
]

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
_BASE = ["n_words", "n_base", "first_word", "last_word", "base_labels"]


def _words(text: str) -> str:
    """SQL of a text's words, lower-cased in A-Z only."""
    return rf"filter(split(translate({text}, '{_UPPER}', '{_LOWER}'), '{_GAPS}'), x -> x <> '')"


def _gram(word: str, i: str) -> list[str]:
    return [f"{word}[{i} + {k}]" for k in range(GRAM)]


def templates(spark: SparkSession) -> DataFrame:
    """template, label, n_template, hash, gram, at: a row for each place of a template; a fixed table."""
    rows = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(TEMPLATES)], "template int, label string, text string")
    rows = rows.selectExpr("template", "label", f"{_words('text')} AS w").selectExpr("template", "label", "w", "size(w) AS n_template")
    rows = rows.selectExpr("template", "label", "n_template", "w", f"explode(sequence(0, n_template - {GRAM})) AS at")
    return rows.selectExpr("template", "label", "n_template", f"xxhash64({', '.join(_gram('w', 'at'))}) AS hash", f"concat_ws(' ', {', '.join(_gram('w', 'at'))}) AS gram", "at")


def phrase_sql(word: str, i: str) -> str:
    """SQL of the label of the phrase that stands at a place, or null."""
    cases = [f"WHEN {' AND '.join(f"get({word}, {i} + {k}) = '{x}'" for k, x in enumerate(phrase.split()))} THEN '{label}'" for phrase, label in PHRASES.items()]
    return f"CASE {' '.join(cases)} END"


def scanned(docs: DataFrame, hashes: list[int]) -> DataFrame:
    """Base columns of each row, and ``hits``: the places of grams whose hash a template has. One pass, no shuffle."""
    last = {phrase.split()[-1] for phrase in PHRASES}
    rows = docs.selectExpr("doc_id", f"{_words("coalesce(CAST(text AS STRING), '')")} AS w").selectExpr("doc_id", "w", "CAST(size(w) AS BIGINT) AS n_words")
    places = f"filter(transform(sequence(0, size(w) - 1), i -> struct(CAST(i AS BIGINT) AS at, {phrase_sql('w', 'i')} AS label)), x -> x.label IS NOT NULL)"
    rows = rows.withColumn("places", F.expr(f"IF(arrays_overlap(w, array({', '.join(f"'{x}'" for x in sorted(last))})), {places}, CAST(array() AS ARRAY<STRUCT<at: BIGINT, label: STRING>>))"))
    found = f"filter(transform(sequence(0, size(w) - {GRAM}), i -> struct(i AS at, xxhash64({', '.join(_gram('w', 'i'))}) AS hash)), x -> x.hash IN ({', '.join(map(str, hashes))}))"
    hits = f"transform({found}, x -> struct(x.at AS at, x.hash AS hash, concat_ws(' ', {', '.join(_gram('w', 'x.at'))}) AS gram))"
    rows = rows.withColumn("hits", F.expr(f"IF(n_words < {GRAM}, CAST(array() AS ARRAY<STRUCT<at: INT, hash: BIGINT, gram: STRING>>), {hits})"))
    return rows.selectExpr(
        "doc_id", "n_words", "CAST(size(places) AS BIGINT) AS n_base",
        "array_min(places.at) AS first_word", "array_max(places.at) AS last_word",
        "array_join(array_sort(array_distinct(places.label)), ',') AS base_labels", "hits",
    )


def votes(rows: DataFrame, places: DataFrame) -> DataFrame:
    """row, template, diagonal, at, of: a row for each gram of a text and place of a template that has the same words."""
    grams = rows.select("row", F.explode("hits").alias("hit")).select("row", "hit.*")
    t = places.select("template", "label", "n_template", "hash", F.col("gram").alias("template_gram"), F.col("at").alias("of"))
    both = grams.join(F.broadcast(t), "hash").where("gram = template_gram")  # a fixed table
    return both.select("row", "template", "label", "n_template", (F.col("at") - F.col("of")).alias("diagonal"), "at", "of")


def spans(votes: DataFrame) -> DataFrame:
    """row, template, label, first_at, last_at, share, density: neighbouring diagonals merged, and those that stand kept."""
    key = ["row", "template"]
    diagonals = votes.groupBy(*key, "diagonal").agg(F.first("label").alias("label"), F.first("n_template").alias("n_template"), F.collect_set("of").alias("of"))  # at most a template's places
    order = Window.partitionBy(*key).orderBy("diagonal")
    new = F.col("diagonal") - F.lag("diagonal").over(order) > F.least(F.lit(SLACK), F.floor(F.col("n_template") / 4))
    islands = diagonals.withColumn("new", F.coalesce(new.cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(order))
    covered = lambda at: F.size(F.array_distinct(F.flatten(F.transform(at, lambda x: F.sequence(x, x + (GRAM - 1))))))
    merged = islands.groupBy(*key, "island").agg(
        F.first("label").alias("label"), F.first("n_template").alias("n_template"),
        F.flatten(F.collect_list("of")).alias("of"),
        F.flatten(F.collect_list(F.transform("of", lambda x: x + F.col("diagonal")))).alias("at"),
    )
    measured = merged.select(*key, "label", F.array_min("at").alias("first_at"), (F.array_max("at") + (GRAM - 1)).alias("last_at"), (covered(F.col("of")) / F.col("n_template")).alias("share"), covered(F.col("at")).alias("covered"))
    measured = measured.withColumn("density", F.col("covered") / (F.col("last_at") - F.col("first_at") + 1)).drop("covered")
    return measured.where((F.col("share") >= SHARE) & (F.col("density") >= DENSITY))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, the base columns, labels, score and n_spans of each row."""
    spark = docs.sparkSession
    places = templates(spark)
    hashes = sorted({r[0] for r in places.select("hash").collect()})  # a fixed number
    with Tables(spark) as tables:
        rows = tables.keep(scanned(docs, hashes).withColumn("row", F.monotonically_increasing_id()), "license-rows")
        found = tables.keep(spans(votes(rows.where("size(hits) > 0"), places)).groupBy("row").agg(F.collect_set("label").alias("found"), F.max("share").alias("share"), F.count(F.lit(1)).alias("n_spans")), "license-found")
    out = rows.drop("hits").join(found, "row", "left")
    base = F.when(F.col("n_base") > 0, F.split("base_labels", ",")).otherwise(F.array().cast("array<string>"))
    labels = F.array_join(F.array_sort(F.array_union(base, F.coalesce("found", F.array().cast("array<string>")))), ",")
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0)))
    return out.select("doc_id", *_BASE, labels.alias("labels"), score.alias("score"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"))


def oracle_sql() -> str:
    """The same for DuckDB, with words and grams unnested and joined as strings."""
    words = lambda t: rf"regexp_extract_all(translate(coalesce({t}, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    rows = ", ".join(f"({i}, '{label}', '{text.replace(chr(39), chr(39) * 2)}')" for i, (label, text) in enumerate(TEMPLATES))
    gram = lambda w, i: " || ' ' || ".join(f"{w}[{i} + {k}]" for k in range(1, GRAM + 1))
    phrases = " ".join(f"WHEN {' AND '.join(f"w[i + {k}] = '{x}'" for k, x in enumerate(p.split()))} THEN '{label}'" for p, label in PHRASES.items())
    grid = lambda c: f"len(list_distinct(flatten(list(list_transform(range({GRAM}), lambda j: {c} + j)))))"
    return f"""
WITH t AS (SELECT column0 AS template, column1 AS label, {words('column2')} AS w FROM (VALUES {rows}) v(column0, column1, column2)),
tg AS (SELECT template, label, len(w) AS nt, i AS tp, {gram('w', 'i')} AS g FROM (SELECT *, unnest(range(0, len(w) - {GRAM - 1})) AS i FROM t) x),
d AS (SELECT doc_id, {words('text')} AS w FROM documents),
p AS (SELECT doc_id, i - 1 AS pos, CASE {phrases} END AS label FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d) x),
b AS (SELECT doc_id, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list_sort(list_distinct(list(label))) AS ls FROM p WHERE label IS NOT NULL GROUP BY doc_id),
dg AS (SELECT doc_id, i AS pos, {gram('w', 'i')} AS g FROM (SELECT *, unnest(range(0, len(w) - {GRAM - 1})) AS i FROM d) x),
v AS (SELECT DISTINCT doc_id, template, label, nt, pos, tp, pos - tp AS dia FROM dg JOIN tg USING (g)),
n AS (SELECT DISTINCT doc_id, template, nt, dia FROM v),
k AS (SELECT *, coalesce(dia - lag(dia) OVER o > least({SLACK}, nt // 4), true) AS new FROM n WINDOW o AS (PARTITION BY doc_id, template ORDER BY dia)),
m AS (SELECT doc_id, template, dia, sum(CAST(new AS INT)) OVER (PARTITION BY doc_id, template ORDER BY dia) AS island FROM k),
s AS (SELECT doc_id, template, island, max(label) AS label, CAST({grid('tp')} AS DOUBLE) / max(nt) AS share, CAST({grid('pos')} AS DOUBLE) / (max(pos) + {GRAM} - min(pos)) AS density
  FROM v JOIN m USING (doc_id, template, dia) GROUP BY ALL),
f AS (SELECT doc_id, list(DISTINCT label) AS ls, max(share) AS share, count(*) AS n_spans FROM s WHERE share >= {SHARE} AND density >= {DENSITY} GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, array_to_string(coalesce(b.ls, []), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(b.ls, []), coalesce(f.ls, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(share, 0.0) END AS score, coalesce(n_spans, 0) AS n_spans
FROM d LEFT JOIN b ON d.doc_id = b.doc_id LEFT JOIN f ON d.doc_id = f.doc_id
"""
