"""License scans as an exact set-similarity join of text blocks with license templates, in DataFrame functions alone.

A block is a run of ``2 h`` consecutive words, ``h`` words after the block before it, where ``h`` is the power of two (8 at least) not
below a template's words: every passage as long as the template lies whole in one block. A block meets a template if it holds
``percent`` of the template's distinct words. Such pairs are found without comparing every block with every template:

* the words of all templates are ordered by the number of documents that hold them, counted over all documents, rarest first;
* prefix filter: a block that meets a template holds one of the first ``n - need + 1`` of its ``n`` words, so only blocks around
  such words are cut out, and they join the templates on those words;
* length filter: a block needs ``need`` words of the templates at least;
* positional filter: with a shared word at place i of the template and place j of the block, both in the global order, no more than
  ``min(i, j) + min(n - i, size - j)`` words are shared.

Pairs that are left are counted exactly. Words outside the templates never matter to an overlap, so blocks are cut down to the
templates' words. Matches are kept per distinct text, so a text with thousands of copies is one row of the join back to the documents.

Templates are a parameter; their words (``TEMPLATE_WORDS`` at most) and their counts are all that reaches the driver.

Edge cases: null and empty texts have no words and no labels; repeated rows and null doc_ids are judged row by row; an empty table
gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded, stored

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAPS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PERCENT = 95
LEAST_HALF = 8
#: Greatest number of distinct template words: they travel inside the plan.
TEMPLATE_WORDS = 20_000

#: Fixed values of the query: phrases and their labels.
PHRASES = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]

#: Texts by which licenses are known, with SPDX names.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
            "files, to deal in the Software without restriction"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
            "as published by the Free Software Foundation"),
    ("LGPL", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
            "conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
]


def _plain(text: str) -> F.Column:
    """Words joined by one space."""
    lower = F.translate(F.coalesce(F.col(text).cast("string"), F.lit("")), _UPPER, _LOWER)
    return F.btrim(F.regexp_replace(lower, _GAPS, " "))


def _words_of(plain: str) -> F.Column:
    return F.when(F.col(plain) == "", F.array().cast("array<string>")).otherwise(F.split(plain, " "))


def _strings(items: list[str]) -> F.Column:
    return F.array(*[F.lit(x) for x in items]).cast("array<string>")


def split_words(text: str) -> list[str]:
    lower = text.translate(str.maketrans(_UPPER, _LOWER))
    return [w for w in re.split(_GAPS, lower) if w]


def need(n: int, percent: int) -> int:
    """Shared words that make ``percent`` of ``n``."""
    return max(1, -(-n * percent // 100))


def half_block(n_words: int) -> int:
    return max(LEAST_HALF, 1 << max(0, n_words - 1).bit_length())


def _parsed(templates: list[tuple[str, str]]) -> list[tuple[int, str, list[str], int]]:
    """(template, label, distinct words, half a block) of every template with words."""
    out = []
    for i, (label, text) in enumerate(templates):
        words = split_words(text)
        if words:
            out.append((i, label, sorted(set(words)), half_block(len(words))))
    if len({w for t in out for w in t[2]}) > TEMPLATE_WORDS:
        raise ValueError(f"templates hold more than {TEMPLATE_WORDS} distinct words")
    return out


def _with_words(docs: DataFrame, text: str) -> DataFrame:
    """(digest, words) of every row; equal texts have one digest."""
    return (docs.select(F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("digest"), _plain(text).alias("plain"))
            .select("digest", "plain", _words_of("plain").alias("words")))


def word_order(measured: DataFrame, vocabulary: list[str]) -> list[str]:
    """The vocabulary by the number of documents that hold each word, rarest first; ties by the word."""
    held = measured.select(F.explode_outer("held").alias("word"))
    counts = {r["word"]: r["n"] for r in held.filter("word is not null").groupBy("word").agg(F.count("*").alias("n")).collect()}  # a row per template word
    return sorted(vocabulary, key=lambda w: (counts.get(w, 0), w))


def template_matches(docs: DataFrame, parsed: list[tuple[int, str, list[str], int]], order: list[str], percent: int = PERCENT,
                     text: str = "text") -> DataFrame:
    """(digest, template, label, block, shared, score): every block of a distinct text that meets a template; ``order`` is global."""
    spark = docs.sparkSession
    place = {w: i for i, w in enumerate(order)}
    prefixes, classes = [], {}
    for i, label, words, half in parsed:
        words = sorted(words, key=place.__getitem__)
        least = need(len(words), percent)
        for at, w in enumerate(words[: len(words) - least + 1], 1):
            prefixes.append((half, w, i, label, words, least, at))
        members, heads, fewest = classes.get(half, (set(), set(), least))
        classes[half] = (members | set(words), heads | set(words[: len(words) - least + 1]), min(fewest, least))
    table = spark.createDataFrame(prefixes, "half int, word string, template int, label string, words array<string>, need int, i int")

    def blocks(half: int) -> F.Column:
        """Blocks around the class's prefix words, cut down to the class's words in global order."""
        members, heads, fewest = classes[half]
        ordered = _strings(sorted(members, key=place.__getitem__))
        head = _strings(sorted(heads, key=place.__getitem__))
        hits = F.filter(F.sequence(F.lit(0), F.size("words") - 1), lambda p: F.array_contains(head, F.get("words", p)))
        last = F.transform(hits, lambda p: F.floor(p / half).cast("int"))
        around = F.array_distinct(F.concat(last, F.filter(F.transform(last, lambda b: b - 1), lambda b: b >= 0)))
        cut = F.transform(around, lambda b: F.struct(F.lit(half).alias("half"), b.alias("block"), F.array_intersect(
            ordered, F.slice("words", b * half + 1, F.lit(2 * half))).alias("held")))
        enough = F.filter(cut, lambda x: F.size(x["held"]) >= fewest)
        return F.when(F.arrays_overlap("words", head), enough)

    if not classes:
        return spark.createDataFrame([], "digest string, template int, label string, block int, shared int, score double")
    kind = "array<struct<half:int,block:int,held:array<string>>>"
    found = F.concat(*[F.coalesce(blocks(h), F.array().cast(kind)) for h in sorted(classes)])
    # Only small structs are exploded: the words of the text stay behind. The outer form keeps Spark from testing for empty lists below
    # the projections, where it would split the text again for every word.
    cut = (_with_words(docs, text).select("digest", F.explode_outer(found).alias("b")).select("digest", "b.half", "b.block", "b.held"))
    size = F.size("held")
    candidates = (cut.select("*", F.posexplode("held").alias("j", "word")).join(F.broadcast(table), ["half", "word"])
                  .filter((size >= F.col("need"))
                          & (F.least(F.col("i"), F.col("j") + 1) + F.least(F.size("words") - F.col("i"), size - F.col("j") - 1) >= F.col("need"))))
    shared = F.size(F.array_intersect("words", "held"))
    return (candidates.withColumn("shared", shared).filter(F.col("shared") >= F.col("need"))
            .select("digest", "template", "label", "block", "shared", (F.col("shared") / F.size("words")).alias("score")).distinct())


def _places(phrase: str) -> F.Column:
    """Where the phrase's words stand consecutively. Words are searched only in texts that hold the phrase at all."""
    words = split_words(phrase)
    here = lambda p: F.array_position(F.array(*[F.get("words", p + i) == w for i, w in enumerate(words)]), F.lit(False)) == 0
    found = F.filter(F.sequence(F.lit(0), F.size("words") - len(words)), here)
    held = F.contains(F.concat(F.lit(" "), F.col("plain"), F.lit(" ")), F.lit(" " + " ".join(words) + " "))
    return F.when(held, found).otherwise(F.array().cast("array<int>"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, percent: int = PERCENT,
         text: str = "text", broadcast_bytes: int | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels and score of every document.

    ``score`` is the greatest share of a template that one block holds, among those that meet the threshold; a phrase counts as whole.
    """
    parsed = _parsed(templates)
    vocabulary = sorted({w for t in parsed for w in t[2]})
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.md5(F.coalesce(F.col(text).cast("string"), F.lit(""))).alias("digest"),
                       _plain(text).alias("plain")).select("*", _words_of("plain").alias("words"))
    placed = stored(rows.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"),
                                F.array(*[_places(p) for p, _ in phrases]).alias("places"),
                                F.array_intersect(_strings(vocabulary), "words").alias("held")), "license-words")
    matches = stored(template_matches(docs, parsed, word_order(placed, vocabulary), percent, text), "license-blocks")
    # A text has as many labels as there are templates at most.
    per_text = stored(matches.groupBy("digest").agg(F.collect_set("label").alias("found"), F.max("score").alias("best")), "license-texts")
    every = F.flatten("places")
    names = F.array_sort(F.array_distinct(F.filter(F.transform("places", lambda p, i: F.when(F.size(p) > 0, F.get(_strings([n for _, n in phrases]), i))),
                                                   lambda n: n.isNotNull())))
    base = placed.select("doc_id", "digest", "n_words", F.size(every).cast("long").alias("n_base"), F.array_min(every).cast("long").alias("first_word"),
                         F.array_max(every).cast("long").alias("last_word"), names.alias("base"))
    joined = base.join(bounded(per_text, 512, broadcast_bytes), "digest", "left")
    labels = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, 1.0).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"),
                         F.array_join(labels, ",").alias("labels"), score.alias("score"))


def scan_sql(templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, percent: int = PERCENT) -> str:
    """The same as SQL over ``documents``: every block is compared with every template of its size."""
    quoted = lambda items: "[" + ", ".join(f"'{w}'" for w in items) + "]"
    rows = ", ".join(f"('{label}', {quoted(words)}, {need(len(words), percent)}, {half})" for _, label, words, half in _parsed(templates))
    bases = ", ".join(f"('{name}', {quoted(split_words(p))})" for p, name in phrases)
    return rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id,
                  regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
t(label, words, need, half) AS (VALUES {rows}), p(label, words) AS (VALUES {bases}),
c AS (SELECT r, half, unnest(generate_series(0, (len(w) - 1) // half)) AS b FROM d, (SELECT DISTINCT half FROM t) WHERE len(w) > 0),
m AS (SELECT c.r, t.label, len(list_intersect(t.words, d.w[c.b * c.half + 1 : c.b * c.half + 2 * c.half])) AS shared, len(t.words) AS n, t.need
      FROM c JOIN d USING (r) JOIN t USING (half)),
f AS (SELECT r, label, max(shared / n) AS best FROM m WHERE shared >= need GROUP BY ALL),
i AS (SELECT r, unnest(generate_series(1, len(w))) AS pos FROM d WHERE len(w) > 0),
h AS (SELECT i.r, p.label, i.pos - 1 AS pos FROM i JOIN d USING (r), p WHERE d.w[i.pos] = p.words[1] AND d.w[i.pos : i.pos + len(p.words) - 1] = p.words),
g AS (SELECT r, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM h GROUP BY r),
a AS (SELECT r, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT r, label FROM f UNION SELECT r, label FROM h) GROUP BY r)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1 ELSE coalesce((SELECT max(best) FROM f WHERE f.r = d.r), 0) END AS DOUBLE) AS score
FROM d LEFT JOIN g USING (r) LEFT JOIN a USING (r)"""
