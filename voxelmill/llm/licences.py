"""Licence scan by Dice coefficient over word bigrams, with DataFrame functions only (operator 1).

A text is scanned by its lines, its paragraphs of several lines and as a whole. A unit and a template of m distinct
bigrams can reach a coefficient of t only if the unit has between m * t / (2 - t) and m * (2 - t) / t of them, so
a template is joined on the sizes it can match: an equality join with a small table of fixed size. Notices inside longer
units, wrapped or in comments are found in windows of the running words that have a template's own length.

Both kinds need at least m * t / (2 - t) of the template's bigrams. So all but a smaller number of them may be taken as its
*keys*, of which every match has one: a text, unit or place without any key is put aside at once, exactly.
"""

from __future__ import annotations

import re
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import table

LEAST = Fraction(4, 5)

# The notices and texts of public licences.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("MIT", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
]


#: Common words, which say little about a text.
COMMON = frozenset("a all and any are as at by can for if in is of on or that the this to under was with you".split())
#: Bigrams of running words in one block; blocks overlap by the longest template, so no window is cut.
BLOCK = 2048


def _words(text: str) -> list[str]:
    return re.sub(r"[\W_]+", " ", text.lower()).split()


def _bigrams(text: str) -> list[str]:
    words = _words(text)
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:], strict=False)))


def _sizes(m: int) -> tuple[int, int]:
    low, high = m * LEAST / (2 - LEAST), m * (2 - LEAST) / LEAST
    return -(-low.numerator // low.denominator), high.numerator // high.denominator


def _rows() -> list[tuple[int, str, list[str], int, int, int]]:
    """Of each template: its number, licence, distinct bigrams, the bounds of sizes and the number of its bigrams with repeats."""
    out = []
    for k, (name, text) in enumerate(TEMPLATES):
        grams = _bigrams(text)
        out.append((k, name, grams, *_sizes(len(grams)), len(_words(text)) - 1))
    return out


def _keys() -> dict[int, list[str]]:
    """The keys of each template: its rarest bigrams, by the letters of words that aren't common, so many that fewer than any match has are left."""
    letters = lambda g: sum(len(w) for w in g.split(" ") if w not in COMMON and not w.isdigit())
    return {k: sorted(grams, key=lambda g: (-letters(g), g))[: len(grams) - low + 1] for k, _, grams, low, _, _ in _rows()}


def _once(c: Column) -> Column:
    """Stands in a generator, so that later filters and projections read the value and don't compute it again."""
    return F.explode(F.array(c))


def _normal(text: Column) -> Column:
    """Lower case, with one space for anything but letters and digits."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _mentions(normal: str) -> Column:
    """Whether a normalised text holds the letters of a key."""
    keys = sorted({g for x in _keys().values() for g in x})
    out = F.contains(normal, F.lit(keys[0]))
    for g in keys[1:]:
        out = out | F.contains(normal, F.lit(g))
    return out


def _pairs(w: Column) -> Column:
    """Bigrams of words, in order."""
    n = F.greatest(F.size(w) - 1, F.lit(0))
    return F.zip_with(F.slice(w, 1, n), F.slice(w, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def _dice(part: Column, grams: Column) -> Column:
    return 2.0 * F.size(F.array_intersect(part, grams)) / (F.size(F.array_distinct(part)) + F.size(grams))


def _in_windows(docs: DataFrame) -> DataFrame:
    """doc_id, licence and dice of the places in running words that match a template. docs: doc_id, text, normal.

    A window has as many words as its template, at the text's end fewer, and begins with a bigram of it. It counts if no window that shares a
    word with it is better: of a higher coefficient, then longer, of an earlier template, earlier in the text.
    """
    spark = docs.sparkSession
    rows, keys = _rows(), _keys()
    longest = max(r[5] for r in rows)
    by_key = [(g, k, name, grams, low, n) for k, name, grams, low, _, n in rows for g in keys[k]]
    templates = F.broadcast(spark.createDataFrame(by_key, "key string, template int, licence string, grams array<string>, low int, k int"))  # a fixed table
    known = sorted({g for x in keys.values() for g in x})

    grams = docs.select("doc_id", F.xxhash64("text").alias("h"), _once(_pairs(F.split("normal", " "))).alias("g")).where(F.size("g") > 0)
    blocks = F.transform(F.sequence(F.lit(0), F.size("g") - 1, F.lit(BLOCK)), lambda a: F.struct(a.alias("at"), F.slice("g", a + 1, BLOCK + longest).alias("s")))
    blocks = grams.select("doc_id", "h", F.explode(blocks).alias("x")).select("doc_id", "h", "x.at", "x.s")
    places = F.filter(F.transform("s", lambda x, i: F.when(x.isin(known), i)), lambda p: p.isNotNull())
    # Each place of a key with what a template's window around it may reach.
    around = lambda p: F.struct(p.alias("p"), F.greatest(p - longest + 1, F.lit(0)).alias("first"), F.slice("s", F.greatest(p - longest + 1, F.lit(0)) + 1, 2 * longest - 1).alias("s"))
    near = blocks.select("doc_id", "h", "at", F.explode(F.transform(places, around)).alias("x"))
    near = near.select("doc_id", "h", "at", "x.p", "x.first", "x.s", F.element_at("x.s", F.col("x.p") - F.col("x.first") + 1).alias("key"))
    near = near.join(templates, "key")
    begin = F.greatest(F.col("p") - F.col("k") + 1, F.lit(0))
    near = near.where(F.size(F.array_intersect(F.slice("s", begin - F.col("first") + 1, 2 * F.col("k") - 1), "grams")) >= F.col("low"))

    def window(i: Column) -> Column:
        part = F.slice("s", i - F.col("first") + 1, F.col("k"))
        starts = (i < BLOCK) & F.array_contains("grams", part[0])
        return F.struct((F.col("at") + i).cast("long").alias("a"), F.when(starts, _dice(part, F.col("grams"))).otherwise(0.0).alias("dice"))

    windows = F.filter(F.transform(F.sequence(begin, F.col("p")), window), lambda x: x["dice"] >= float(LEAST))
    hits = near.select("doc_id", "h", "template", "licence", "k", F.explode(windows).alias("x")).select("doc_id", "h", "template", "licence", "k", "x.a", "x.dice").distinct()
    beside = Window.partitionBy("doc_id", "h").orderBy("a").rangeBetween(-longest, longest)
    hits = hits.withColumn("beside", F.collect_list(F.struct("dice", "k", "template", "a")).over(beside))
    rank = lambda x: F.struct(x["dice"], x["k"], -x["template"], -x["a"])
    mine = F.struct("dice", "k", -F.col("template"), -F.col("a"))
    better = F.exists("beside", lambda y: (rank(y) > mine) & (y["a"] <= F.col("a") + F.col("k")) & (F.col("a") <= y["a"] + y["k"]))
    return hits.where(~better).select("doc_id", "licence", "dice")


def licence_scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, n_units and dice (the best) of every licence whose template a unit of the document matches, or a window of its words.

    A unit is matched to the template of the highest coefficient, at least LEAST; of equal ones the first listed. For a licence that
    no unit matches n_units counts the places of its windows. Null and empty texts and units of fewer than two words match nothing. Rows
    that repeat a doc_id are scanned together: equal units and equal texts count once per document. Very long texts are windowed in blocks.
    """
    spark = docs.sparkSession
    rows = _rows()
    low, high = min(r[3] for r in rows), max(r[4] for r in rows)
    sizes = [(n, k, name, grams) for k, name, grams, a, b, _ in rows for n in range(a, b + 1)]
    templates = F.broadcast(spark.createDataFrame(sizes, "n int, template int, licence string, grams array<string>"))  # a fixed table
    docs = docs.where("text is not null").select("doc_id", "text", _once(_normal(F.col("text"))).alias("normal")).where(_mentions("normal"))
    lines = F.split("text", r"\n")
    several = F.filter(F.split("text", r"\n[ \t\r]*\n"), lambda p: F.contains(p, F.lit("\n")))
    whole = F.when(F.contains("text", F.lit("\n")), F.array("text")).otherwise(F.array().cast("array<string>"))
    units = F.array_distinct(F.concat(lines, several, whole))
    found = docs.select("doc_id", F.explode(units).alias("unit")).select("doc_id", "unit", _once(_normal(F.col("unit"))).alias("normal")).where(_mentions("normal"))
    # u different words make u - 1 different bigrams at least, so longer units go before theirs are made.
    words = found.select("doc_id", "unit", _once(F.split("normal", " ")).alias("w")).where((F.size("w") > low) & (F.size(F.array_distinct("w")) - 1 <= high))
    found = words.select("doc_id", "unit", _once(F.array_distinct(_pairs(F.col("w")))).alias("b")).withColumn("n", F.size("b"))
    both = found.join(templates, "n").select("doc_id", "unit", "template", "licence", _once(_dice(F.col("b"), F.col("grams"))).alias("dice"))
    both = both.where(F.col("dice") >= float(LEAST))
    best = both.groupBy("doc_id", "unit").agg(F.min(F.struct((-F.col("dice")).alias("d"), "template", "licence")).alias("m"))
    best = best.select("doc_id", "m.licence", (-F.col("m.d")).alias("dice"))
    count = [F.count(F.lit(1)).alias("n"), F.max("dice").alias("dice")]
    sides = best.groupBy("doc_id", "licence").agg(*count).withColumn("side", F.lit(0))
    sides = sides.unionByName(_in_windows(docs).groupBy("doc_id", "licence").agg(*count).withColumn("side", F.lit(1)))
    out = sides.groupBy("doc_id", "licence").agg(F.min(F.struct("side", "n", "dice")).alias("m"))
    return out.select("doc_id", "licence", F.col("m.n").alias("n_units"), F.col("m.dice").alias("dice"))


def scan_sql() -> str:
    """The same scan in DuckDB's SQL, without keys and blocks."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    values = ", ".join(f"({k}, {quote(name)}, [{', '.join(map(quote, grams))}], {n})" for k, name, grams, _, _, n in _rows())
    t = float(LEAST)
    split = lambda c: f"string_split(trim(regexp_replace(lower({c}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g')), ' ')"
    pairs = "list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])"
    dice = "2.0::DOUBLE * len(list_intersect(b, grams)) / (len(b) + len(grams))"
    return f"""
WITH templates(template, licence, grams, k) AS (VALUES {values}),
units AS (
  SELECT DISTINCT doc_id, unit FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents WHERE text IS NOT NULL
    UNION ALL SELECT doc_id, unit FROM (SELECT doc_id, unnest(string_split_regex(text, '\\n[ \\t\\r]*\\n')) AS unit FROM documents WHERE text IS NOT NULL) WHERE contains(unit, chr(10))
    UNION ALL SELECT doc_id, text FROM documents WHERE contains(text, chr(10)))),
words AS (SELECT doc_id, unit, {split('unit')} AS w FROM units),
grams AS (SELECT doc_id, unit, list_distinct({pairs}) AS b FROM words),
matched AS (
  SELECT doc_id, unit, template, licence, {dice} AS dice
  FROM grams, templates WHERE len(b) BETWEEN ceil(len(grams) * {t} / (2 - {t}) - 1e-9) AND floor(len(grams) * (2 - {t}) / {t} + 1e-9)),
best AS (SELECT doc_id, unit, licence, dice FROM matched WHERE dice >= {t} QUALIFY row_number() OVER (PARTITION BY doc_id, unit ORDER BY dice DESC, template) = 1),
texts AS (SELECT row_number() OVER () AS t, doc_id, {pairs} AS g FROM (SELECT DISTINCT doc_id, text, {split('text')} AS w FROM documents WHERE text IS NOT NULL)),
places AS (SELECT t, doc_id, g, generate_subscripts(g, 1) AS a FROM texts),
starts AS (SELECT t, doc_id, a, template, licence, grams, k, list_distinct(g[a : a + k - 1]) AS b
  FROM places JOIN (SELECT template, licence, grams, k, unnest(grams) AS gram FROM templates) ON g[a] = gram),
windows AS (SELECT * FROM (SELECT t, doc_id, a, template, licence, k, {dice} AS dice FROM starts) WHERE dice >= {t}),
kept AS (SELECT doc_id, licence, dice FROM windows x WHERE NOT EXISTS (
  SELECT 1 FROM windows y WHERE y.t = x.t AND y.a <= x.a + x.k AND x.a <= y.a + y.k AND (y.dice, y.k, -y.template, -y.a) > (x.dice, x.k, -x.template, -x.a))),
sides AS (SELECT doc_id, licence, count(*) AS n, max(dice) AS dice, 0 AS side FROM best GROUP BY ALL
  UNION ALL SELECT doc_id, licence, count(*), max(dice), 1 FROM kept GROUP BY doc_id, licence)
SELECT doc_id, licence, n AS n_units, dice FROM sides QUALIFY row_number() OVER (PARTITION BY doc_id, licence ORDER BY side) = 1"""


def op1_licence_scan(spark, sf_dir: str) -> DataFrame:
    return licence_scan(table(spark, sf_dir, "documents"))
