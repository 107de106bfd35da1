"""License scan by a positional rare-token index (DataFrame functions only).

The index holds, for each licence template, its rarest words: document frequencies of all template
words are counted over the whole corpus, and the words with the highest IDF get postings (template,
position, weight).  A document's rare words are looked up; each posting votes for the start that the
template would have in the document, and only where the template's mandatory key phrase stands at its
place from that start, give or take SLACK words.  Votes whose starts lie within SLACK words are summed,
each word of the template once; the best start of a template gives its score, the matched share of the
template's weight.  Templates are paragraphs of licences and their short notices.

Base labels come from fixed phrases and always stay.

Documents without any rare word yield one row; the others one more row per vote.  Aggregations are
keyed by document row.  What reaches the driver is the frequency of each template word: its size is
the templates' vocabulary.

Defined cases: null text is empty and has no words, places or labels; empty and very long texts are
handled whole; rows that repeat a document are scanned each by itself; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, UPPER, content_words, let

#: Base phrases and their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, text of the template, mandatory key phrase within it.
_TEXTS = (
    ("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
        You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing,
        software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""", "apache license version 2"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0", "apache license version 2"),
    ("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
        Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.""", "redistribution and use in source and binary forms"),
    ("bsl-1.0", """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this
        license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software""", "any person or organization obtaining a copy"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0", "cc by nc"),
    ("cc-by-nc", "This work is licensed under the Creative Commons Attribution-NonCommercial 4.0 International License.", "creative commons attribution noncommercial"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0", "cc by sa"),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License.", "creative commons attribution sharealike"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "has waived all copyright and related"),
    ("gpl-2", "GNU General Public License version 2", "general public license version 2"),
    ("gpl-3", "GNU General Public License version 3", "general public license version 3"),
    ("gpl-3", """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by
        the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it
        will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""", "either version 3 of the license"),
    ("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that
        the above copyright notice and this permission notice appear in all copies.""", "permission to use copy modify and or distribute this software"),
    ("lgpl", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by
        the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.""", "lesser general public license"),
    ("lgpl", "GNU Lesser General Public License", "lesser general public license"),
    ("mit", "Released under the MIT License", "mit license"),
    ("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"),
        to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
        copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:""", "permission is hereby granted free of charge to any person obtaining a copy of this software"),
    ("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file,
        You can obtain one at http://mozilla.org/MPL/2.0/.""", "mozilla public license"),
    ("unlicense", """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute
        this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""", "free and unencumbered software"),
    ("zlib", """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the
        use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely""", "permission is granted to anyone to use this software"),
)
TEMPLATES = tuple((label, " ".join(re.findall(r"[0-9a-z]+", text.lower())), phrase) for label, text, phrase in _TEXTS)
#: Rare words in the index per template: a third of its words within these bounds; and the share of their
#: weight that a match must reach.
FEWEST, MOST, LEAST = 4, 8, 0.6
#: Words by which a rare word or the key phrase may be displaced against the template.
SLACK = 3


def rare_words(text: str) -> int:
    return min(MOST, max(FEWEST, len(text.split()) // 3))


def phrase_place(text: str, phrase: str) -> int:
    return len(text[: f" {text} ".index(f" {phrase} ")].split())


def word_frequencies(docs: DataFrame, words: list[str]) -> tuple[int, dict[str, int]]:
    """Number of documents, and in how many of them each of the given words stands."""
    vocabulary = F.array(*[F.lit(w) for w in words])
    found = docs.select(F.explode(F.concat(F.array(F.lit("")), F.array_intersect(content_words(F.col("text")), vocabulary))).alias("word"))
    counts = {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count(F.lit(1)).alias("n")).collect()}
    return counts.pop("", 0), counts


def rare_postings(n_docs: int, df: dict[str, int]) -> tuple[dict[str, list[tuple[int, int, int]]], list[int]]:
    """word -> [(template, position, weight)], and each template's whole weight."""
    postings, weights = defaultdict(list), []
    for t, (_, text, _) in enumerate(TEMPLATES):
        words = text.split()
        rare = set(sorted(set(words), key=lambda w: (df.get(w, 0), w))[: rare_words(text)])
        held = [(w, p, math.floor(1000 * math.log((n_docs + 1) / (df.get(w, 0) + 1)) + 0.5) + 1) for p, w in enumerate(words) if w in rare]
        for w, p, weight in held:
            postings[w].append((t, p, weight))
        weights.append(sum(x[2] for x in held))
    return dict(postings), weights


def _places(plain: Column, words: Column) -> Column:
    """(label, start) of all places of the base phrases."""
    none = F.array().cast("array<struct<label:string,start:int>>")

    def of(phrase: str, label: str) -> Column:
        first, *rest = phrase.split()

        def stands(i: Column) -> Column:
            fits = F.get(words, i) == first
            for k, part in enumerate(rest, 1):
                fits = fits & F.coalesce(F.get(words, i + k) == part, F.lit(False))
            return fits

        starts = F.filter(F.sequence(F.lit(0), F.size(words) - 1), stands)
        return F.when(plain.contains(first), F.transform(starts, lambda i: F.struct(F.lit(label).alias("label"), i.alias("start")))).otherwise(none)

    return F.concat(*[of(*x) for x in BASE])


def _votes(words: Column, postings: dict[str, list[tuple[int, int, int]]]) -> Column:
    """(template, position, start, weight) of all rare words whose template's key phrase stands in place."""
    none = F.array().cast("array<struct<template:int,position:int,start:int,weight:int>>")

    def literal(t: int, p: int, weight: int) -> Column:
        _, text, phrase = TEMPLATES[t]
        return F.struct(F.lit(t).alias("t"), F.lit(p).alias("p"), F.lit(weight).alias("weight"), F.lit(phrase_place(text, phrase)).alias("at"), F.lit(len(phrase.split())).alias("len"), F.lit(phrase).alias("phrase"))

    index = F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*[literal(*q) for q in postings[w]]))])
    rare = F.array(*[F.lit(w) for w in sorted(postings)])
    shifts = F.array(*[F.lit(d) for d in range(-SLACK, SLACK + 1)])

    def stands(i: Column, q: Column) -> Column:
        at = lambda d: i - q["p"] + q["at"] + d
        return F.exists(shifts, lambda d: (at(d) >= 0) & (F.array_join(F.slice(words, F.greatest(at(d), F.lit(0)) + 1, q["len"]), " ") == q["phrase"]))

    def vote(i: Column) -> Column:
        fits = F.filter(F.element_at(index, F.get(words, i)), lambda q: stands(i, q))
        return F.transform(fits, lambda q: F.struct(q["t"].alias("template"), q["p"].alias("position"), (i - q["p"]).alias("start"), q["weight"].alias("weight")))

    at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(*sorted(postings)))
    return F.when(F.arrays_overlap(words, rare), F.flatten(F.transform(at, vote))).otherwise(none)


def scan_licenses(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_words, places (label and start of base phrases), found
    (label and score of the method's matches)."""
    vocabulary = sorted({w for _, text, _ in TEMPLATES for w in text.split()})
    postings, weights = rare_postings(*word_frequencies(docs, vocabulary))
    plain = F.translate(F.coalesce(F.col("text"), F.lit("")), UPPER + NOT_WORD, UPPER.lower() + " " * len(NOT_WORD))

    def read(p: Column) -> Column:
        def split(w: Column) -> Column:
            return F.struct(F.size(w).alias("n_words"), F.when(F.size(w) > 0, _places(p, w)).alias("places"), F.when(F.size(w) > 0, _votes(w, postings)).alias("votes"))

        return let(F.array_remove(F.split(p, " "), ""), split)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", let(plain, read).alias("r"))
    none = F.array().cast("array<struct<template:int,position:int,start:int,weight:int>>")
    whole = F.struct(F.lit(-1).alias("template"), F.lit(0).alias("position"), F.lit(0).alias("start"), F.lit(0).alias("weight"))
    votes = rows.select("rid", F.struct("doc_id", "r.n_words", "r.places").alias("doc"), F.inline(F.concat(F.array(whole), F.coalesce("r.votes", none))))
    # Starts up to SLACK apart fall into one stretch of 2 * SLACK words of one of two rows of stretches.
    places = [F.struct(F.lit(g).alias("row"), F.floor((F.col("start") + g * SLACK) / (2 * SLACK)).alias("at")) for g in (0, 1)]
    stretch = F.explode(F.when(F.col("template") < 0, F.array(places[0])).otherwise(F.array(*places)))
    votes = votes.select("rid", F.when(F.col("template") < 0, F.col("doc")).alias("doc"), "template", "position", "weight", stretch.alias("stretch"))
    words = votes.groupBy("rid", "template", "stretch", "position").agg(F.first("doc", ignorenulls=True).alias("doc"), F.max("weight").alias("weight"))
    starts = words.groupBy("rid", "template", "stretch").agg(F.first("doc", ignorenulls=True).alias("doc"), F.sum("weight").alias("weight"))
    labels, totals = F.array(*[F.lit(x) for x, _, _ in TEMPLATES]), F.array(*[F.lit(float(x)) for x in weights])
    score = F.col("weight") / F.get(totals, F.col("template"))
    match = F.when((F.col("template") >= 0) & (score >= LEAST), F.struct(F.get(labels, F.col("template")).alias("label"), score.alias("score")))
    found = starts.groupBy("rid").agg(F.first("doc", ignorenulls=True).alias("doc"), F.collect_set(match).alias("found"))
    none = F.array().cast("array<struct<label:string,start:int>>")
    return found.select("doc.doc_id", "doc.n_words", F.coalesce("doc.places", none).alias("places"), "found")


def digest(docs: DataFrame) -> DataFrame:
    scanned = scan_licenses(docs.select("doc_id", "text"))
    starts, base = F.col("places.start"), F.array_distinct("places.label")
    best = F.coalesce(F.array_max("found.score"), F.lit(0.0))
    return scanned.select(
        "doc_id",
        F.col("n_words").cast("long").alias("n_words"),
        F.size("places").cast("long").alias("n_base"),
        F.array_min(starts).cast("long").alias("first_word"),
        F.array_max(starts).cast("long").alias("last_word"),
        F.array_join(F.array_sort(base), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union(base, F.col("found.label"))), ",").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(best).alias("score"),
    )


_TEMPLATE_ROWS = ", ".join(f"({t}, '{label}', '{text}', '{phrase}', {phrase_place(text, phrase)}, {rare_words(text)})" for t, (label, text, phrase) in enumerate(TEMPLATES))
_BASE_SQL = " UNION ALL ".join(
    f"SELECT doc_id, '{label}' AS label, i FROM x WHERE array_to_string(w[i + 1:i + {len(phrase.split())}], ' ') = '{phrase}'" for phrase, label in BASE
)
SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(0, len(w))) AS i FROM d),
xw AS (SELECT doc_id, w, i, w[i + 1] AS word FROM x),
base AS ({_BASE_SQL}),
b AS (SELECT doc_id, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list(DISTINCT label) AS labels FROM base GROUP BY doc_id),
t AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) v(t, label, body, phrase, place, rare)),
tw AS (SELECT *, string_split(body, ' ')[p + 1] AS word FROM (SELECT *, unnest(range(0, len(string_split(body, ' ')))) AS p FROM t)),
df AS (SELECT word, count(DISTINCT doc_id) AS df FROM xw WHERE word IN (SELECT word FROM tw) GROUP BY word),
rk AS (SELECT t, word, coalesce(df, 0) AS df, row_number() OVER (PARTITION BY t ORDER BY coalesce(df, 0), word) AS r FROM (SELECT DISTINCT t, word FROM tw) LEFT JOIN df USING (word)),
ps AS (SELECT tw.t, tw.label, tw.phrase, tw.place, tw.p, tw.word, floor(1000 * ln(((SELECT count(*) FROM d) + 1) / (df + 1)) + 0.5)::BIGINT + 1 AS weight FROM tw JOIN rk USING (t, word) WHERE r <= rare),
tot AS (SELECT t, sum(weight) AS total FROM ps GROUP BY t),
k AS (SELECT doc_id, w, i, word, t, label, p, place, weight, phrase, len(string_split(phrase, ' ')) AS n FROM xw JOIN ps USING (word)),
v AS (SELECT DISTINCT doc_id, t, label, p, i - p AS start, weight FROM (SELECT *, unnest(range(-{SLACK}, {SLACK} + 1)) AS d FROM k)
      WHERE i - p + place + d >= 0 AND array_to_string(w[i - p + place + d + 1:i - p + place + d + n], ' ') = phrase),
z AS (SELECT DISTINCT doc_id, t, label, p, weight, g, floor((start + g * {SLACK}) / {2 * SLACK}) AS stretch FROM v, (SELECT unnest([0, 1]) AS g)),
s AS (SELECT doc_id, label, sum(weight) / any_value(total) AS score FROM z JOIN tot USING (t) GROUP BY doc_id, t, label, g, stretch),
m AS (SELECT doc_id, list(DISTINCT label) AS found, max(score) AS best FROM s WHERE score >= {LEAST} GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(labels), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(labels, []), coalesce(found, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0) END::DOUBLE AS score
FROM d LEFT JOIN b USING (doc_id) LEFT JOIN m USING (doc_id)
"""
