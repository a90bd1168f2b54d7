"""License statements in text: fixed phrases, and an exact set-similarity join of text blocks with license templates.

A block of a template of n words is any run of n / ``threshold`` consecutive words, wherever lines end. A block meets the
template when it holds at least ``threshold`` of its distinct words. Words are ordered by how many documents of the whole
corpus hold them, rarest first. A template of m distinct words has to share one of its m - ceil(threshold m) + 1 rarest with
every block that meets it (prefix filter); the block needs ceil(threshold m) template words (length filter); and the places
of the shared word in both orders bound what can still be shared (positional filter). Filters run on the documents' own
word sets first, so most texts are cut into words once; what passes is counted exactly, block by block around the shared
words. DataFrame functions only.

One pass over the texts writes the counts of each document, the words it holds of those that occur in templates, and its
text where these are enough for some template; the frequencies and the join read that small table.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.functions.sizes import cut_lineage

# Fixed phrases of the task and their labels.
PHRASES = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Statements of public licenses and their labels; each is matched by its words.
TEMPLATES = (
    ("Released under the MIT License", "mit"),
    ("Licensed under the MIT License", "mit"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
     "files, to deal in the Software without restriction", "mit"),
    ("Licensed under the Apache License, Version 2.0", "apache-2.0"),
    ("This work is licensed under the GNU General Public License, version 3", "gpl-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License", "gpl"),
    ("Licensed under the GNU Lesser General Public License", "lgpl"),
    ("Licensed under CC BY-NC 4.0", "cc-by-nc-4.0"),
    ("Licensed under CC BY-SA 4.0", "cc-by-sa-4.0"),
    ("Licensed under the Creative Commons Attribution 4.0 International License", "cc-by-4.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted", "bsd"),
    ("Licensed under the Mozilla Public License, Version 2.0", "mpl-2.0"),
    ("All rights reserved", "reserved"),
)
THRESHOLD = 0.9
_BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def words_of(text: Column) -> Column:
    """Words of a text whose A-Z is already in lower case."""
    return F.filter(F.split(text, _BREAKS), lambda w: w != "")


def _lower(text: Column) -> Column:
    """A-Z in lower case. Other letters may change too, but never into a-z: the two that would are mapped the slow way."""
    into_ascii = text.contains("\u212a") | text.contains("\u0130")
    return F.when(into_ascii, F.translate(text, _UPPER, _UPPER.lower())).otherwise(F.lower(text))


def _places(words: Column, phrase: list[str]) -> Column:
    """Indexes at which the phrase's words stand one after the other."""
    hit = lambda w, i: F.when(
        w == phrase[0], F.forall(F.sequence(F.lit(1), F.lit(len(phrase) - 1)), lambda k: F.get(words, i + k) == F.get(F.array(*map(F.lit, phrase)), k))
        if len(phrase) > 1 else F.lit(True))
    return F.filter(F.transform(words, lambda w, i: F.when(F.coalesce(hit(w, i), F.lit(False)), i)), lambda i: i.isNotNull())


def template_sets(templates, threshold: float) -> list[tuple[int, str, set[str], int, int]]:
    """Number, label, distinct words, words needed and words of a block of each template."""
    out = []
    for number, (statement, label) in enumerate(templates):
        listed = "".join(c if c.isascii() and c.isalnum() else " " for c in statement.lower()).split()
        distinct = set(listed)
        out.append((number, label, distinct, math.ceil(threshold * len(distinct) - 1e-9), math.ceil(len(listed) / threshold - 1e-9)))
    return out


def _array(words: list[str]) -> Column:
    return F.array(*map(F.lit, words))


def _best_share(own: list[str], rarest: list[str], need: int, block: int) -> Column:
    """Largest share of ``own`` in a block of the words ``_w`` that holds ``need`` of them, else 0; ``_at``: places of rare words."""
    held = lambda start, n: F.size(F.array_intersect(_array(own), F.slice("_w", start + 1, n)))
    low = lambda p: F.greatest(p - (block - 1), F.lit(0))
    # Around a place, all blocks through it together have to hold enough; then each of them that starts with a template word.
    near = F.filter("_at", lambda p: F.get("_w", p).isin(rarest) & (held(low(p), F.lit(2 * block)) >= need))
    starts = lambda p: F.filter(F.sequence(low(p), p), lambda s: F.get("_w", s).isin(own))
    best = F.array_max(F.flatten(F.transform(near, lambda p: F.transform(starts(p), lambda s: held(s, F.lit(block))))))
    return F.coalesce(F.when(best >= need, best / F.lit(len(own))), F.lit(0.0))


def scan(
    docs: DataFrame, phrases=PHRASES, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text",
    keys: tuple[str, ...] = ("doc_id",),
) -> DataFrame:
    """``keys``, n_words, n_base, first_word, last_word, base_labels, labels, score: one row per input row.

    A null text is empty: no words, no labels, score 0, null places. Repeated rows are judged each for itself; overlapping
    phrases all count. score is the largest share of a template's words found in one of the document's blocks that meet
    it, 1 for documents with a phrase. An empty table stays empty. Other columns are not read.
    """
    spark = docs.sparkSession
    known = template_sets(templates, threshold)
    vocabulary = sorted(set().union(*(distinct for _, _, distinct, _, _ in known)))
    body = _lower(F.coalesce(F.col(text), F.lit("")))
    with_words = docs.select(*(F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)), body.alias("_t")).withColumn("_w", words_of(F.col("_t")))
    own_keys = [f"_k{i}" for i in range(len(keys))]
    places = [
        F.when(F.forall(_array(p.split()), lambda w: F.contains("_t", w)), _places(F.col("_w"), p.split()))
        .otherwise(F.array().cast("array<int>")) for p, _ in phrases
    ]
    named = F.array_compact(F.array(*(F.when(F.size(F.col("_p")[i]) > 0, F.lit(label)) for i, (_, label) in enumerate(phrases))))
    found = F.flatten("_p")
    enough = reduce(lambda a, b: a | b, (F.size(F.array_intersect(_array(sorted(d)), "_have")) >= need for _, _, d, need, _ in known))
    # The row number is written with the rows, so it is the same for every later reader.
    scanned = cut_lineage(with_words.select(
        *own_keys, F.size("_w").alias("n_words"), F.array(*places).alias("_p"), F.col("_t"), F.array_intersect("_w", _array(vocabulary)).alias("_have")).select(
        *own_keys, F.monotonically_increasing_id().alias("_row"), F.col("n_words").cast("bigint").alias("n_words"),
        F.size(found).cast("bigint").alias("n_base"), F.array_min(found).cast("bigint").alias("first_word"),
        F.array_max(found).cast("bigint").alias("last_word"), F.array_sort(F.array_distinct(named)).alias("_base"), "_have", F.when(enough, F.col("_t")).alias("_text")))

    frequency = scanned.select(F.explode("_have").alias("word")).groupBy("word").agg(F.count("*").alias("df"))
    held = {r["word"]: r["df"] for r in frequency.collect()}  # at most the templates' own words
    order = sorted(vocabulary, key=lambda w: (held.get(w, 0), w))
    prefixes, rarest = [], {}
    for number, _, distinct, need, _ in known:
        own = [w for w in order if w in distinct]
        rarest[number] = own[: len(own) - need + 1]
        prefixes += [(w, at, number, len(own), need) for at, w in enumerate(rarest[number])]
    prefix = F.broadcast(spark.createDataFrame(prefixes, "word string, at int, template int, n int, need int"))
    # The intersection keeps the order of its first side: rarest first.
    ordered = scanned.filter("_text is not null").select("_row", F.array_intersect(_array(order), "_have").alias("have"))
    m, place, at = F.size("have"), F.col("place"), F.col("at")
    most = F.least(place, at) + 1 + F.least(m - place - 1, F.col("n") - at - 1)
    candidates = ordered.select("_row", "have", F.posexplode("have").alias("place", "word")).join(prefix, "word").filter(
        (m >= F.col("need")) & (most >= F.col("need"))).groupBy("_row").agg(F.collect_set("template").alias("_may"))  # at most the templates
    # Only these texts are cut into words again.
    first = sorted(set().union(*rarest.values()))
    cut = scanned.select("_row", "_text").filter("_text is not null").join(candidates, "_row").select("_row", "_may", words_of(F.col("_text")).alias("_w"))
    cut = cut.withColumn("_at", F.filter(F.transform("_w", lambda w, i: F.when(w.isin(first), i)), lambda i: i.isNotNull()))
    shares = F.array(*(
        F.when(F.array_contains("_may", number), _best_share(sorted(distinct), rarest[number], need, block)).otherwise(0.0)
        for number, _, distinct, need, block in known))
    met = cut.select("_row", shares.alias("_s")).filter(F.array_max("_s") > 0).select(
        "_row", F.array_compact(F.array(*(F.when(F.col("_s")[i] > 0, F.lit(label)) for i, (_, label, *_) in enumerate(known)))).alias("_more"),
        F.array_max("_s").alias("_share"))
    labels = F.array_sort(F.array_distinct(F.array_union("_base", F.coalesce("_more", F.array().cast("array<string>")))))
    return scanned.drop("_text", "_have").join(met, "_row", "left").select(
        *(F.col(k).alias(name) for k, name in zip(own_keys, keys, strict=True)), "n_words", "n_base", "first_word", "last_word",
        F.array_join("_base", ",").alias("base_labels"), F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.col("n_base") > 0, 1.0).otherwise(0.0), F.coalesce("_share", F.lit(0.0))).alias("score"))
