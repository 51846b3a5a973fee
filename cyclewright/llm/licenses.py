"""License scans: phrases, and an exact set-similarity join with notice templates. DataFrame functions only.

Base labels are places where a phrase's words stand one after the other. The join finds every text block that
holds at least CONTAINMENT of a template's distinct words. Words of all templates are ordered by the number of
documents they occur in, rarest first. Then three filters lose nothing: a matching block holds one of the
template's |T| - a + 1 rarest words, where a is the least overlap (prefix); it holds at least a words of any
template (length); and from the first word that both have, enough words are left on both sides (positional). What is
left is counted exactly.

Blocks are the lines of a text, and its paragraphs (lines between empty ones) where these differ. A block of more than
WINDOW words is its windows of that size, which overlap by half, so that a notice in a long line is found and the
words of a whole book are no notice.

Defined results: a null text counts as empty and has no words; a text without phrases has n_base 0, null places and
empty labels; score is 1 with a phrase, else the greatest containment of a matching block, else 0; repeated rows
are returned as often as they stand; texts are read whole, whatever their length; an empty table gives no rows. Only doc_id and text are read.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cyclewright.llm.common import lowered

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
# The phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Opening sentences of public license notices, with the label of each.
TEMPLATES = (
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("apache", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0, Creative Commons Attribution-NonCommercial"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
)
#: Share of a template's distinct words that a block must hold.
CONTAINMENT = 0.8
#: Words of a window of a long block, and words from one window's start to the next.
WINDOW, STEP = 256, 128


def template_words(text: str) -> list[str]:
    """Distinct words of a template, in order."""
    return list(dict.fromkeys(re.findall(r"[a-z0-9]+", text.lower())))


def least_overlap(n_words: int, containment: float = CONTAINMENT) -> int:
    return math.ceil(n_words * containment - 1e-9)


def words_of(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def places(words: Column, text: Column, phrase: str) -> Column:
    """Word numbers, from 0, where the phrase starts. Words are looked at only where the text holds their letters."""
    parts = phrase.split()
    possible = F.lit(True)
    for p in parts:
        possible = possible & F.contains(text, F.lit(p))

    def starts(i: Column) -> Column:
        same = F.get(words, i) == parts[0]
        for k, p in enumerate(parts[1:], 1):
            same = same & (F.get(words, i + k) == p)
        return same

    found = F.filter(F.sequence(F.lit(0), F.size(words) - 1), starts)
    return F.when(possible & (F.size(words) > 0), found).otherwise(F.array().cast("array<int>"))


def windows(words: Column) -> Column:
    """The words as one block, or where they are more than WINDOW as windows; STEP words in a row are in one of them."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - STEP - 1, F.lit(0)), F.lit(STEP))
    return F.when(F.size(words) <= WINDOW, F.array(words)).otherwise(F.transform(starts, lambda i: F.slice(words, i + 1, WINDOW)))


def literal(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def by_rarity(docs: DataFrame, words: list[str]) -> list[str]:
    """The given words (as many as the templates have), those that fewest documents hold first."""
    text = lowered(F.coalesce("text", F.lit("")))
    counts = (
        docs.select(F.explode(F.array_intersect(literal(words), words_of(text))).alias("word")).groupBy("word").count().collect()
    )
    seen = {r["word"]: r["count"] for r in counts}
    return sorted(words, key=lambda w: (seen.get(w, 0), w))


def scanned(docs: DataFrame, templates=TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score of every row."""
    sets = [template_words(t) for _, t in templates]
    order = by_rarity(docs, sorted({w for s in sets for w in s}))
    rank = {w: i for i, w in enumerate(order)}
    index, need, size, label = [], {}, {}, {}
    for t, own in enumerate(sets):
        own = sorted(own, key=rank.get)
        least = least_overlap(len(own), containment)
        need[t], size[t], label[t] = least, len(own), templates[t][0]
        index += [(own[i], t, i, own, least, len(own), label[t]) for i in range(len(own) - least + 1)]
    # As many rows as the templates have rare words: the broadcast doesn't grow with the documents.
    spark = docs.sparkSession
    index_table = spark.createDataFrame(index, "word string, template int, place int, own array<string>, least int, n_own int, label string")
    rare = literal(sorted({row[0] for row in index}, key=rank.get))

    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), lowered(F.coalesce("text", F.lit(""))).alias("text")
    ).withColumn("words", words_of(F.col("text")))
    found = {p: places(F.col("words"), F.col("text"), p) for p in PHRASES}
    rows = rows.select("row", "doc_id", "text", "words", *[x.alias(f"places{i}") for i, x in enumerate(found.values())])
    all_places = F.flatten(F.array(*[f"places{i}" for i in range(len(found))]))
    marks = F.array_compact(F.array(*[F.when(F.size(f"places{i}") > 0, F.lit(v)) for i, v in enumerate(PHRASES.values())]))
    # Only texts with one of the rare words can hold a matching block.
    lines = F.split("text", r"\n")
    blocks = F.array_union(lines, F.split("text", r"\n[\x20\x09\x0B-\x0D]*\n"))
    rows = rows.select(
        "row",
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.size(all_places).cast("long").alias("n_base"),
        F.array_min(all_places).cast("long").alias("first_word"),
        F.array_max(all_places).cast("long").alias("last_word"),
        marks.alias("marks"),
        F.when(F.arrays_overlap("words", rare), blocks).alias("blocks"),
    )
    head = ["row", "doc_id", "n_words", "n_base", "first_word", "last_word", "marks"]
    blocks = rows.select(*head, F.posexplode_outer("blocks").alias("block", "line"))
    blocks = blocks.withColumn("line_words", F.explode_outer(windows(words_of(F.col("line")))))
    blocks = blocks.select(*head, "block", F.array_intersect(literal(order), F.col("line_words")).alias("held"))
    few = min(need.values())
    blocks = blocks.withColumn("probes", F.when(F.size("held") >= few, F.array_intersect("held", rare)))
    probes = blocks.select(*head, "block", "held", F.explode_outer("probes").alias("probe"))
    left = F.least(F.col("n_own") - F.col("place"), F.size("held") - F.array_position("held", F.col("probe")) + 1)
    passes = (
        (F.col("probe") == F.col("word"))
        & (F.size("held") >= F.col("least"))
        & (left >= F.col("least"))
    )
    overlap = F.size(F.array_intersect("own", "held"))
    hits = probes.join(F.broadcast(index_table), passes, "left").select(
        *head,
        F.when(overlap >= F.col("least"), F.col("label")).alias("label"),
        F.when(overlap >= F.col("least"), overlap / F.col("n_own")).alias("containment"),
    )
    return (
        hits.groupBy(*head)
        .agg(F.collect_set("label").alias("own"), F.max("containment").alias("containment"))
        .select(
            "doc_id",
            "n_words",
            "n_base",
            "first_word",
            "last_word",
            F.array_join(F.array_sort(F.array_distinct("marks")), ",").alias("base_labels"),
            F.array_join(F.array_sort(F.array_union("marks", "own")), ",").alias("labels"),
            F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
        )
    )
