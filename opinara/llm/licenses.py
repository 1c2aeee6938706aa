"""License scans (operator 11): phrases at their places, and an exact set-similarity join with notice templates.

A text's words are cut into blocks of 2w words, w apart, for each width w that templates need: every run of w words stands whole in some
block, across line breaks too. A template matches a block if the block holds at least ``threshold`` of its distinct words. The join finds all such
pairs: words are ordered by how many documents of the corpus hold them, rarest first; a template is indexed by its first words in this order, as many
as it can't lack all of (prefix filter); a block that holds one of these is kept only if it has enough words of templates at all
(length filter) and enough behind this one in the order (positional filter), and is confirmed on full sets. A pair is taken at
its first common word, so once. Only DataFrame functions are used.

Templates are a stated, small list: their index is broadcast, bounded by the number of their words. Corpus counts are of their words only. Texts never move:
what is shuffled is a row of numbers per document and what was found, which is joined by id and the text's SHA-256, so
that rows with null or repeated ids keep what is theirs.

Defined results: null and empty texts, and those without words, have 0 words, no places, no labels and score 0. score is the largest contained share of a
template, 1 where a phrase stands. Repeated rows each get a row. Other columns are ignored, whatever their names; an empty table gives an empty result;
without templates, labels are those of the phrases.
"""

from __future__ import annotations

import math
import re
import string

from pyspark.sql import Column, DataFrame, functions as F

from .common import checkpoint

SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Phrase and label.
PHRASES = [("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit")]
#: Notices as their licences' publishers word them.
TEMPLATES = [
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("agpl", "You should have received a copy of the GNU Affero General Public License along with this program."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0'),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-sa", "This work is licensed under the Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("mit", "Released under the MIT License."),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.'),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("epl", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]
THRESHOLD = 0.9
MIN_WIDTH = 16
#: Of templates' distinct words: the index is in each task.
MAX_VOCABULARY = 50_000


def words_of(text: str) -> list[str]:
    """A template's words, by the rule of texts."""
    return [w for w in re.split(SEPARATORS, text.translate(str.maketrans(string.ascii_uppercase, string.ascii_lowercase))) if w]


def words(text: Column) -> Column:
    lower = F.translate(F.coalesce(text, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.array_remove(F.split(lower, SEPARATORS), "")


def width_of(n: int) -> int:
    """The smallest of 16, 64, 256, ... words that holds n."""
    w = MIN_WIDTH
    while w < n:
        w *= 4
    return w


def templates_table(templates: list[tuple[str, str]], threshold: float) -> list[dict]:
    out = []
    for label, text in templates:
        found = words_of(text)
        if distinct := sorted(set(found)):
            out.append({"label": label, "words": distinct, "width": width_of(len(found)), "need": max(1, math.ceil(threshold * len(distinct) - 1e-9))})
    return out


def places(found: Column, phrase: str) -> Column:
    """Starts of the phrase in an array of words; empty where it isn't there."""
    parts = phrase.split()

    def here(i):
        out = F.get(found, i) == parts[0]
        for k, w in enumerate(parts[1:], 1):
            out = out & (F.get(found, i + k) == w)
        return out

    none = F.array().cast("array<int>")
    return F.when(F.arrays_overlap(found, F.array(F.lit(max(parts, key=len)))), F.filter(F.sequence(F.lit(0), F.size(found) - 1), here)).otherwise(none)


def _texts(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<string>")


def word_counts(found: DataFrame, vocabulary: list[str]) -> dict[str, int]:
    """In how many rows of ``words`` each word of the vocabulary stands."""
    rows = found.select(F.explode(F.array_intersect("words", _texts(vocabulary))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    return {r["word"]: r["n"] for r in rows.collect()}


def matches(docs: DataFrame, templates: list[dict], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, digest, start (the block's first word), width, label, template (its place in the list), score: all pairs of a block and a template it holds enough of."""
    found = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), words(F.col(text_col)).alias("words"))
    vocabulary = sorted({w for t in templates for w in t["words"]})
    if len(vocabulary) > MAX_VOCABULARY:
        raise ValueError(f"templates hold {len(vocabulary)} words; the index takes {MAX_VOCABULARY}")
    counts = word_counts(found, vocabulary)
    rank = lambda w: (counts.get(w, 0), w)
    order, index = sorted(vocabulary, key=rank), []
    for k, t in enumerate(templates):
        own = sorted(t["words"], key=rank)
        index += [(w, t["width"], k, t["label"], i, len(own), t["need"], own) for i, w in enumerate(own[: len(own) - t["need"] + 1])]
    indexed = sorted({row[0] for row in index}, key=rank)
    index = docs.sparkSession.createDataFrame(index, "word string, width int, template int, label string, place int, n int, need int, own array<string>")

    def cut(w: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("words") - w - 1), F.lit(w))
        return F.transform(starts, lambda s: F.struct(s.alias("start"), F.lit(w).alias("width"), F.slice(F.col("words"), s + 1, 2 * w).alias("words")))

    some = found.where(F.arrays_overlap("words", _texts(indexed))).select("id", F.unhex(F.sha2("text", 256)).alias("digest"), F.explode(F.concat(*[cut(w) for w in sorted({t["width"] for t in templates})])).alias("block"))
    some = some.select("id", "digest", F.col("block.start").alias("start"), F.col("block.width").alias("width"), F.col("block.words").alias("words")).where(F.arrays_overlap("words", _texts(indexed)))
    kept = some.select("id", "digest", "start", "width", F.array_intersect(_texts(order), F.col("words")).alias("held"))
    asked = kept.select("*", F.explode(F.array_intersect("held", _texts(indexed))).alias("word"))
    met = asked.join(F.broadcast(index), ["word", "width"])
    behind = F.least(F.col("n") - F.col("place"), F.size("held") - F.array_position("held", F.col("word")) + 1)
    common = F.array_intersect("own", "held")
    sure = met.where((F.size("held") >= F.col("need")) & (behind >= F.col("need"))).withColumn("common", common)
    sure = sure.where((F.size("common") >= F.col("need")) & (F.get("common", F.lit(0)) == F.col("word")))
    return sure.select("id", "digest", "start", "width", "label", "template", (F.size("common") / F.col("n")).alias("score"))


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, phrases: list[tuple[str, str]] = PHRASES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    rows = docs.select("doc_id", F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256)).alias("digest"), words(F.col("text")).alias("words"))
    rows = rows.select("doc_id", "digest", F.size("words").cast("long").alias("n_words"), F.array(*[F.struct(places(F.col("words"), p).alias("at"), F.lit(label).alias("label")) for p, label in phrases]).alias("base"))
    rows = rows.withColumn("at", F.flatten("base.at")).withColumn("base_names", F.array_sort(F.array_distinct(F.filter("base", lambda b: F.size(b["at"]) > 0)["label"])))
    table = templates_table(templates, threshold)
    if table:
        found = matches(docs, table).groupBy("id", "digest").agg(F.collect_set("label").alias("names"), F.max("score").alias("share"))
        # Read back from storage, it has no aggregate in front of the join, so that rows of a frequent id or text can be split.
        found = checkpoint(found).withColumnRenamed("digest", "_digest")
        rows = rows.join(found, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("_digest")), "left")
    else:
        rows = rows.withColumn("names", F.lit(None).cast("array<string>")).withColumn("share", F.lit(None).cast("double"))
    all_names = F.array_sort(F.array_union("base_names", F.coalesce("names", F.array().cast("array<string>"))))
    return rows.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join("base_names", ",").alias("base_labels"), F.array_join(all_names, ",").alias("labels"), F.when(F.size("at") > 0, 1.0).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"),
    )
