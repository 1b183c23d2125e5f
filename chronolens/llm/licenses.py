"""License scan: an exact set-similarity join between the lines and runs of words of all documents and license templates.

Main path: DataFrame functions only.

Method. A text block is a line, or a run of words whatever lines they stand on: for each size c of RUNS every c-th word begins a run of 2 c words, so that any c words in a
row lie in one of them. Lines are held against all templates, runs of 2 c words against those of at most c words (and more than the next smaller size), so that a notice is found however it is wrapped, and words
scattered over a long text are no match. Blocks and templates are sets of words. A block matches a template if it contains at
least `threshold` of the template's words: overlap >= o = ceil(threshold * |template|). Words are ordered by their count
over the blocks of all documents that are long enough to match at all, rarest first. If a block matches, then
- it has at least o words that occur in any template (length filter),
- among the |template| - o + 1 rarest words of the template (its prefix) and the |block| - o + 1 rarest of the block,
  at least one is shared (prefix filter),
- for some shared prefix word at positions i and j, 1 + min(|template| - 1 - i, |block| - 1 - j) >= o (positional filter),
so the equi-join on prefix words misses none. Whole texts go through the same filters first, and only those that hold a template's words somewhere are cut into runs. Words outside all templates never overlap and are dropped beforehand.

A text of one line has no runs, its line being all of it. Nulls: a null text counts as empty; a null doc_id is an ordinary value. Repeated rows: each row gets its own result row.
Empty tables give empty results. Other columns of the input are ignored. Texts are scanned whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import row_key, staged, text_of, word_array, word_line

#: Phrases and their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

#: (label, notice). Labels with a version or a variant are the method's own.
TEMPLATES = [
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("apache-2", "Licensed under the Apache License, Version 2.0"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("mit-notice", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "Copyright all rights reserved no part of this publication may be reproduced"),
    ("mit-warranty", "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT"),
    ("bsd-warranty", "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("apache-2-notice", "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("agpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software"),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
]

#: Sizes of templates, in words, that runs of twice as many are cut for. Longer templates are found on lines only.
RUNS = (16, 48)
#: Templates of at most so many prefix words are broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000


def phrase_places(line: Column, n_words: Column) -> dict[str, tuple[Column, Column, Column]]:
    """For each phrase: its number of places in a word_line, and the first and last start in words."""
    spaced = F.concat(F.lit(" "), F.regexp_replace(line, " ", "  "), F.lit(" "))  # each word has spaces of its own
    words = lambda part: ((F.length(part) - F.length(F.replace(part, F.lit(" "), F.lit("")))) / 2).cast("long")
    found = {}
    for phrase, _ in PHRASES:
        needle = " " + phrase.replace(" ", "  ") + " "
        there = F.contains(F.concat(F.lit(" "), line, F.lit(" ")), F.lit(f" {phrase} "))
        places = ((F.length(spaced) - F.length(F.replace(spaced, F.lit(needle), F.lit("")))) / len(needle)).cast("long")
        first = words(F.substring_index(spaced, needle, 1))
        last = n_words - words(F.substring_index(spaced, needle, -1)) - len(phrase.split())
        found[phrase] = (F.when(there, places).otherwise(F.lit(0).cast("long")), F.when(there, first), F.when(there, last))
    return found


def run_of(n_words: Column) -> Column:
    """The size of RUNS for a template of so many words; null beyond them."""
    out = F.lit(None).cast("int")
    for c in sorted(RUNS, reverse=True):
        out = F.when(n_words <= c, F.lit(c)).otherwise(out)
    return out


def runs_of(words: Column, size: Column) -> Column:
    """Array of runs of 2 * size words, one from every size-th word."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - 1, F.lit(0)), size)
    return F.transform(starts, lambda i: F.slice(words, i + 1, 2 * size))


def template_table(spark: SparkSession, templates: list[tuple[str, str]], threshold: float) -> DataFrame:
    """One row for each template: number, label, words as a set, size and least overlap. A template without words never matches."""
    raw = spark.createDataFrame([(i, label, text) for i, (label, text) in enumerate(templates)], "tid int, label string, text string")
    words = raw.select("tid", "label", word_array(text_of()).alias("all")).withColumns({"words": F.array_distinct("all"), "run": run_of(F.size("all"))}).where(F.size("words") > 0).drop("all")
    return words.withColumns({"size": F.size("words"), "least": F.ceil(F.size("words") * threshold - 1e-9).cast("int")})


def license_blocks(docs: DataFrame, spark: SparkSession, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """All (doc_id, key, block, run, label, containment) with containment >= threshold; block counts lines from 0 (run: null) or runs of twice `run` words."""
    table = template_table(spark, templates, threshold)
    vocabulary = sorted({w for r in table.select("words").collect() for w in r.words})  # bounded: templates are given as a Python list
    if not vocabulary:
        return spark.createDataFrame([], "doc_id long, key long, block int, run int, label string, containment double")
    fewest = table.agg(F.min("least")).first()[0]
    known = F.array(*map(F.lit, vocabulary))
    lines = docs.select("doc_id", row_key(text_of()).alias("key"), F.posexplode(F.split(text_of(), "\n", -1)).alias("block", "line"))
    lines = lines.select("doc_id", "key", "block", F.lit(False).alias("whole"), F.array_intersect(word_array(F.col("line")), known).alias("words"))
    several = docs.where(F.contains(text_of(), F.lit("\n")))
    texts = several.select("doc_id", row_key(text_of()).alias("key"), F.lit(0).alias("block"), F.lit(True).alias("whole"), F.array_intersect(word_array(text_of()), known).alias("words"))
    blocks = staged(lines.unionByName(texts).where(F.size("words") >= fewest), "license-blocks")

    counted = blocks.select(F.explode("words").alias("w")).groupBy("w").count()  # as many rows as words in templates
    ranks = {r.w: i for i, r in enumerate(counted.orderBy("count", "w").collect())}
    order = sorted(vocabulary, key=lambda w: (ranks.get(w, -1), w))
    ordered = F.array(*map(F.lit, order))
    by_rank = lambda words: F.array_intersect(ordered, words)  # noqa: E731  rarest first

    prefixes = table.withColumn("ranked", by_rank(F.col("words"))).select(
        "tid", "label", F.col("run").alias("of"), "size", "least", "ranked", F.posexplode(F.slice("ranked", F.lit(1), F.col("size") - F.col("least") + 1)).alias("i", "w")
    )
    if sum(len(t.split()) for _, t in templates) <= BROADCAST_ROWS:
        prefixes = F.broadcast(prefixes)
    ranked = blocks.withColumn("ranked", by_rank(F.col("words"))).withColumn("n", F.size("ranked"))
    rare = ranked.select("doc_id", "key", "block", "whole", "ranked", "n", F.posexplode(F.slice("ranked", F.lit(1), F.col("n") - fewest + 1)).alias("j", "w"))
    fits = (F.col("n") >= F.col("least")) & (1 + F.least(F.col("size") - 1 - F.col("i"), F.col("n") - 1 - F.col("j")) >= F.col("least"))
    candidates = rare.join(prefixes.withColumnRenamed("ranked", "template"), "w").where(fits & (~F.col("whole") | F.col("of").isNotNull()))
    overlap = F.size(F.array_intersect("ranked", "template"))
    checked = candidates.withColumn("overlap", overlap).where(F.col("overlap") >= F.col("least"))
    found = staged(checked.groupBy("doc_id", "key", "block", "whole", "tid").agg(*(F.first(c).alias(c) for c in ("label", "of", "size", "least", "template")), F.max("overlap").alias("overlap")), "license-found")
    on_lines = found.where("not whole").select("doc_id", "key", "block", F.lit(None).cast("int").alias("run"), "label", (F.col("overlap") / F.col("size")).alias("containment"))

    # a run that holds a template lies in a text that does, so only such texts are cut into runs
    wanted = found.where("whole").select(F.col("doc_id").alias("d"), F.col("key").alias("k"), "label", "of", "size", "least", "template")
    few = wanted.count() <= BROADCAST_ROWS
    held = several.select("doc_id", row_key(text_of()).alias("key"), word_array(text_of()).alias("all")).join(F.broadcast(wanted) if few else wanted, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("key") == F.col("k")))
    runs = held.select("doc_id", "key", "of", "label", "size", "least", "template", F.posexplode(runs_of(F.col("all"), F.col("of"))).alias("block", "run"))
    runs = runs.withColumn("overlap", F.size(F.array_intersect("template", "run"))).where(F.col("overlap") >= F.col("least"))
    return on_lines.unionByName(runs.select("doc_id", "key", "block", F.col("of").alias("run"), "label", (F.col("overlap") / F.col("size")).alias("containment")))


def license_scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = 0.8) -> DataFrame:
    """For each row of docs: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score (largest containment, else 0)."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    hits = license_blocks(docs, spark, templates, threshold).groupBy("doc_id", "key").agg(F.collect_set("label").alias("found"), F.max("containment").alias("best"))
    rows = docs.select("doc_id", row_key(text_of()).alias("key"), word_line(text_of()).alias("line"))
    rows = rows.withColumn("n_words", F.when(F.col("line") == "", 0).otherwise(F.length("line") - F.length(F.replace(F.col("line"), F.lit(" "), F.lit(""))) + 1).cast("long"))
    places = phrase_places(F.col("line"), F.col("n_words"))
    counts = [c for c, _, _ in places.values()]
    labels = F.array_compact(F.array(*[F.when(places[p][0] > 0, F.lit(label)) for p, label in PHRASES]))
    base = rows.select(
        "doc_id", "key", "n_words", sum(counts[1:], counts[0]).alias("n_base"),
        F.least(*[f for _, f, _ in places.values()]).alias("first_word"), F.greatest(*[x for _, _, x in places.values()]).alias("last_word"),
        F.array_sort(F.array_distinct(labels)).alias("base"),
    )
    hits = hits.withColumnsRenamed({"doc_id": "hit_id", "key": "hit_key"})
    joined = base.join(hits, F.col("doc_id").eqNullSafe(F.col("hit_id")) & (F.col("key") == F.col("hit_key")), "left")
    every = F.array_sort(F.array_union("base", F.coalesce("found", F.array().cast("array<string>"))))
    return joined.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join(every, ",").alias("labels"), F.coalesce("best", F.lit(0.0)).alias("score"))
