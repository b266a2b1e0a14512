"""Licence notices in texts: the Dice coefficient of word bigrams against templates, pruned by size.

Units are the lines, the blank-line separated paragraphs and the whole of a text, normalised to words of ASCII letters and
digits in lower case. Bigrams count as often as they occur: with m and n bigrams, of which c are common, the coefficient is
2 c / (m + n). As c is at most the lesser number, a template can only match units whose number of bigrams lies between
t m / (2 - t) and (2 - t) m / t for threshold t. A unit's number of bigrams is its number of spaces, so all other units go
before any word is looked at; the rest meet the templates by an equi-join on that number.

A notice may share its line with other words. For licences that no unit reaches, windows of the templates' numbers of words
are compared as well, at all places where one of few bigrams occurs of which any window that reaches the threshold must
hold one.
"""

from __future__ import annotations

import functools
import math
import re
from collections import Counter
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from eventloom.llm.common import text_of

THRESHOLD = 0.85
# fixed values: notices of public licences
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    (
        "Apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
        "License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    ),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    (
        "MIT",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        'files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, '
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the "
        "Software is furnished to do so, subject to the following conditions:",
    ),
    (
        "BSD",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
        "conditions are met:",
    ),
    (
        "ISC",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.",
    ),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    (
        "GPL-3.0",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
        "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    (
        "LGPL-2.1",
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public "
        "License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    ),
    (
        "MPL-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not "
        "distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
)


def bigrams(text: str) -> list[str]:
    """The word bigrams of a template in their order, repeated ones too."""
    words = re.sub("[^A-Za-z0-9]+", " ", text).strip().lower().split()
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def sizes(count: int, threshold: float = THRESHOLD) -> range:
    """The numbers of bigrams that a unit may have if its coefficient with a template of `count` is to reach the threshold."""
    low, high = threshold * count / (2 - threshold), (2 - threshold) * count / threshold
    return range(max(1, math.ceil(low - 1e-9)), math.floor(high + 1e-9) + 1)


def admissible(threshold: float = THRESHOLD) -> list[int]:
    """All numbers of bigrams with which a unit can match some template."""
    return sorted({n for _, text in TEMPLATES for n in sizes(len(bigrams(text)), threshold)})


def template_table(spark: SparkSession, threshold: float = THRESHOLD) -> DataFrame:
    """(size, license, template, repeats): every template under every admissible size; bounded by the templates.

    `repeats` is how many of its bigrams are repetitions.
    """
    rows = []
    for name, text in TEMPLATES:
        own = bigrams(text)
        rows += [(n, name, own, len(own) - len(set(own))) for n in sizes(len(own), threshold)]
    return spark.createDataFrame(rows, "size int, license string, template array<string>, repeats int")


def _spaces(unit: Column) -> Column:
    return F.char_length(unit) - F.char_length(F.replace(unit, F.lit(" "), F.lit("")))


def _one_line(unit: Column) -> Column:
    return F.trim(F.regexp_replace(unit, "[ \n]+", " "))


def _units(text: Column, threshold: float) -> Column:
    """The different units of a normalised text that have an admissible number of bigrams."""
    none = F.array().cast("array<string>")
    wanted = admissible(threshold)
    lines = F.transform(F.split(text, "\n"), lambda u: F.trim(u))
    words = F.aggregate(lines, F.lit(0), lambda n, u: n + F.when(u == "", 0).otherwise(_spaces(u) + 1))
    paragraphs = F.when(text.rlike("\n ?\n"), F.transform(F.split(text, "\n ?\n"), _one_line)).otherwise(none)
    whole = F.when(words <= wanted[-1] + 1, F.array(_one_line(text))).otherwise(none)
    return F.array_distinct(F.filter(F.concat(lines, paragraphs, whole), lambda u: _spaces(u).isin(wanted)))


@dataclass(frozen=True)
class Anchors:
    """For each template a few bigrams of which every window that reaches the threshold holds one.

    A window has as many words as its template, so it may lack `missing` of the template's bigrams; of any `missing` + 1
    different ones it holds one at least. The longest are taken, as they are rare in other text. `words` are words of which
    every anchor holds one; a text without them has no window to compare.
    """

    rows: list[tuple[str, int, int, str, list[str]]]  # anchor, number of the template, its bigrams, licence, bigrams
    words: list[str]

    @staticmethod
    def of(threshold: float) -> Anchors:
        rows = []
        for number, (name, text) in enumerate(TEMPLATES):
            own = bigrams(text)
            missing = len(own) - math.ceil(threshold * len(own) - 1e-9)
            chosen = sorted(set(own), key=lambda b: (-len(b), b))[: missing + 1]
            rows += [(anchor, number, len(own), name, own) for anchor in chosen]
        words, open_ = [], {r[0] for r in rows}
        while open_:
            counts = Counter(w for b in open_ for w in set(b.split()))
            words.append(max(counts, key=lambda w: (counts[w] * len(w), w)))
            open_ = {b for b in open_ if words[-1] not in b.split()}
        return Anchors(rows, sorted(words))


def _windows(rows: DataFrame, threshold: float) -> DataFrame:
    """(doc_id, license, unit, dice): windows of a template's number of words, anywhere in a normalised text, that reach the threshold."""
    anchors = Anchors.of(threshold)
    likely = functools.reduce(Column.__or__, [F.contains("text", F.lit(w)) for w in anchors.words])
    listed = F.array(*[F.lit(a) for a in sorted({r[0] for r in anchors.rows})])
    flat = F.explode(F.array(F.split(_one_line(F.col("text")), " "))).alias("words")
    words = rows.filter(likely).select("doc_id", flat).filter(F.size("words") > 1)

    def pair(words: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.element_at(words, i), F.element_at(words, i + 1))

    places = F.filter(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.array_contains(listed, pair(F.col("words"), i)))
    hits = words.select("doc_id", "words", F.explode(places).alias("at")).withColumn("anchor", pair(F.col("words"), F.col("at")))
    table = rows.sparkSession.createDataFrame(anchors.rows, "anchor string, template int, size int, license string, own array<string>")
    met = hits.join(F.broadcast(table), "anchor")
    first, last = F.greatest(F.col("at") - F.col("size") + 1, F.lit(1)), F.least(F.col("at"), F.size("words") - F.col("size"))
    spans = met.filter(first <= last).withColumns({"first": first, "last": last})
    spans = spans.withColumn("words", F.slice("words", F.col("first"), F.col("last") - F.col("first") + F.col("size") + 1))
    starts = F.explode(F.sequence(F.lit(1), F.col("last") - F.col("first") + 1)).alias("start")
    found = spans.select("doc_id", "license", "template", "size", "own", "words", starts)
    found = found.select("doc_id", "license", "template", "size", "own", F.array_join(F.slice("words", F.col("start"), F.col("size") + 1), " ").alias("unit"))
    found = found.dropDuplicates(["doc_id", "template", "unit"])
    # arrays that lambdas refer to are exploded from one element, or they would be made again for each element
    found = found.select("doc_id", "license", "size", "own", "unit", F.explode(F.array(F.split("unit", " "))).alias("words"))
    held = F.transform(F.sequence(F.lit(1), F.col("size")), lambda i: pair(F.col("words"), i))
    common = F.aggregate(
        F.array_distinct("own"), F.lit(0), lambda n, b: n + F.least(F.size(F.filter("own", lambda x: x == b)), F.size(F.filter("held", lambda x: x == b)))
    )
    scored = found.select("doc_id", "license", "size", "own", "unit", F.explode(F.array(held)).alias("held"))
    scored = scored.withColumn("dice", 2 * common / (2 * F.col("size")))
    return scored.filter(F.col("dice") >= threshold).select("doc_id", "license", "unit", "dice")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, license, dice, n_units): the licences that a document names, the best coefficient, and the different units that match.

    Units are the lines, the paragraphs and the whole text. For a licence that none of a document's units reaches, all
    windows of its templates' numbers of words are compared, wherever they lie in the text; `n_units` are then the different
    windows that match.

    Null and empty texts match nothing; a coefficient of exactly the threshold counts. Rows of one id are one document;
    rows without id are one document as well.
    """
    text = F.lower(F.regexp_replace(text_of(text_col), "[^A-Za-z0-9\n]+", " "))
    # one element exploded: the text is normalised once for each branch and not once for each condition on it
    plain = docs.select(F.col(id_col).alias("doc_id"), F.explode(F.array(text)).alias("text"))
    by_unit = _matched(plain, threshold)
    windows = _windows(plain, threshold).groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("n_units"))
    both = by_unit.withColumn("kind", F.lit(0)).unionByName(windows.withColumn("kind", F.lit(1)))
    first = F.min_by(F.struct("dice", "n_units"), "kind").alias("best")
    return both.groupBy("doc_id", "license").agg(first).select("doc_id", "license", "best.dice", "best.n_units")


def _matched(plain: DataFrame, threshold: float) -> DataFrame:
    """The licences that units of the texts reach."""
    rows = plain.select("doc_id", F.explode(_units(F.col("text"), threshold)).alias("unit"))
    words = F.split("unit", " ")
    pairs = F.transform(F.sequence(F.lit(1), F.size("words") - 1), lambda i: F.concat_ws(" ", F.element_at("words", i), F.element_at("words", i + 1)))
    rows = rows.select("doc_id", "unit", words.alias("words")).select("doc_id", "unit", pairs.alias("own"), (F.size("words") - 1).alias("size"))
    met = rows.join(F.broadcast(template_table(plain.sparkSession, threshold)), "size")
    total = F.col("size") + F.size("template")
    # the different common bigrams and all repetitions bound the common bigrams
    met = met.filter(2 * (F.size(F.array_intersect("own", "template")) + F.col("repeats")) >= threshold * total - 1e-9)

    def common(n: Column, bigram: Column) -> Column:
        return n + F.least(*(F.size(F.filter(c, lambda x: x == bigram)) for c in ("own", "template")))

    dice = 2 * F.aggregate(F.array_distinct("template"), F.lit(0), common) / total
    met = met.withColumn("dice", dice).filter(F.col("dice") >= threshold)
    return met.groupBy("doc_id", "license").agg(F.max("dice").alias("dice"), F.count_distinct("unit").alias("n_units"))


def scan_sql(threshold: float = THRESHOLD) -> str:
    listed = ", ".join(f"('{name}', {[*bigrams(text)]})" for name, text in TEMPLATES)
    anchored = ", ".join(f"('{anchor}', {number}, {size}, '{name}', {own})" for anchor, number, size, name, own in Anchors.of(threshold).rows)
    return f"""WITH templates AS (SELECT * FROM (VALUES {listed}) AS t(license, template)),
        plain AS (SELECT doc_id, lower(regexp_replace(text, '[^A-Za-z0-9\n]+', ' ', 'g')) AS text FROM documents WHERE text IS NOT NULL),
        parts AS (SELECT doc_id, unnest(list_concat(string_split(text, chr(10)), string_split_regex(text, '\n ?\n'), [text])) AS unit FROM plain),
        units AS (SELECT DISTINCT doc_id, trim(regexp_replace(unit, '[ \n]+', ' ', 'g')) AS unit FROM parts),
        worded AS (SELECT doc_id, unit, string_split(unit, ' ') AS words FROM units),
        paired AS (SELECT doc_id, unit, list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1]) AS own
            FROM worded WHERE len(words) >= 2),
        likely AS (SELECT * FROM paired, templates WHERE 2 * least(len(own), len(template)) >= {threshold} * (len(own) + len(template)) - 0.000001
            AND list_has_any(own, template)),
        scored AS (SELECT doc_id, license, unit, 2 * list_sum(list_transform(list_distinct(template), lambda b:
            least(len(list_filter(own, lambda x: x = b)), len(list_filter(template, lambda x: x = b))))) / (len(own) + len(template)) AS dice FROM likely),
        by_unit AS (SELECT doc_id, license, max(dice) AS dice, count(DISTINCT unit) AS n_units, 0 AS kind FROM scored WHERE dice >= {threshold} GROUP BY doc_id, license),
        anchors AS (SELECT * FROM (VALUES {anchored}) AS a(anchor, template, size, license, own)),
        flat AS (SELECT row_number() OVER () AS rid, doc_id, string_split(trim(regexp_replace(text, '[ \n]+', ' ', 'g')), ' ') AS words FROM plain),
        places AS (SELECT rid, unnest(range(1, len(words))) AS place, unnest(list_transform(range(1, len(words)), lambda i: words[i] || ' ' || words[i + 1])) AS anchor FROM flat),
        spans AS (SELECT DISTINCT rid, template, size, license, own, unnest(range(greatest(place - size + 1, 1), place + 1)) AS start FROM places JOIN anchors USING (anchor)),
        windows AS (SELECT doc_id, license, size, own, words[start : start + size] AS cut FROM spans JOIN flat USING (rid) WHERE start + size <= len(words)),
        held AS (SELECT *, array_to_string(cut, ' ') AS unit, list_transform(range(1, size + 1), lambda i: cut[i] || ' ' || cut[i + 1]) AS held FROM windows),
        rated AS (SELECT doc_id, license, unit, 2 * list_sum(list_transform(list_distinct(own), lambda b:
            least(len(list_filter(own, lambda x: x = b)), len(list_filter(held, lambda x: x = b))))) / (2 * size) AS dice FROM held),
        by_window AS (SELECT doc_id, license, max(dice) AS dice, count(DISTINCT unit) AS n_units, 1 AS kind FROM rated WHERE dice >= {threshold} GROUP BY doc_id, license),
        best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, license ORDER BY kind) AS rank FROM (SELECT * FROM by_unit UNION ALL SELECT * FROM by_window))
        SELECT doc_id, license, dice, n_units FROM best WHERE rank = 1"""
