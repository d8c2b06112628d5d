"""License scans: an exact set-similarity join of text blocks with license notices, in DataFrame operations only.

A block is a line of a text, or as many words as a notice has twice, over any line ends: a wrapped notice
stands in one of these.  A notice (template) is found in a block that holds at least
THRESHOLD of its distinct words.  Whole texts are joined first; only in those that meet a template the
blocks over line ends are looked at.  Words are ordered by how many blocks of the corpus have them,
rarest first.  A block that meets a template of n words, of which it must hold k, holds one of the
template's n - k + 1 rarest words: only these are joined on (prefix filter).  A block of fewer than
k words of templates can't (length filter), nor one where the places of the first common word leave
too few words behind it on either side (positional filter).  What is left is counted in full.

Templates are a parameter, and as such of a bounded size (MOST_WORDS words, checked).  Words are
[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z are lower-cased.  Null and empty texts have no words, no blocks and no
labels.  Repeated rows each have their result.  Other columns are not looked at.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitalspark.llm.common import keyed, sized, written

THRESHOLD, MOST_WORDS = 0.8, 20_000

#: Base phrases and their labels.
PHRASES = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))

#: Notices and their labels.
TEMPLATES = (
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the software without restriction"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This source code form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("all-rights-reserved", "Copyright. All rights reserved. No part may be reproduced without permission"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_WORD), F.lit(0))


def template_words(text: str) -> list[str]:
    """Distinct words of a notice, in order of appearance."""
    return list(dict.fromkeys(re.findall(_WORD, text.translate(str.maketrans(_UPPER, _LOWER)))))


def needed(size: int, threshold: float = THRESHOLD) -> int:
    """Least number of words of a template of `size` that meets the threshold."""
    return next(k for k in range(1, size + 1) if k >= threshold * size - 1e-9)


def phrase_places(found: Column, phrase: str) -> Column:
    """Array of the words at which a phrase starts, in an array of words."""
    parts = phrase.split()
    first = F.sequence(F.lit(0), F.size(found) - len(parts))

    def here(i: Column) -> Column:
        same = F.get(found, i) == parts[0]
        for k, part in enumerate(parts[1:], 1):
            same = same & (F.get(found, i + k) == part)
        return same

    return F.when(F.size(found) >= len(parts), F.filter(first, here)).otherwise(F.array().cast("array<int>"))


def vocabulary(templates: tuple[tuple[str, str], ...] = TEMPLATES) -> list[str]:
    """Distinct words of all templates, in order."""
    found = sorted({w for _, text in templates for w in template_words(text)})
    if len(found) > MOST_WORDS:
        raise ValueError(f"templates of more than {MOST_WORDS} words: scan for them in parts")
    return found


def block_matches(held: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id0, key, line, template, label, containment: all blocks that hold enough of a template.

    held: (id0, key, line, held: the words of the templates' vocabulary in a block), read twice: to count, then to join.
    """
    spark = held.sparkSession
    sets = [(i, label, template_words(text)) for i, (label, text) in enumerate(templates)]
    counts = {r["word"]: r["n"] for r in held.select(F.explode("held").alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()}
    order = sorted(vocabulary(templates), key=lambda w: (counts.get(w, 0), w))
    rank = {w: i for i, w in enumerate(order)}
    prefixes = []
    for i, label, x in sets:
        x, k = sorted(x, key=rank.get), needed(len(x), threshold) if x else 1
        prefixes += [(w, i, label, p, len(x), k, x) for p, w in enumerate(x[: len(x) - k + 1], 1)]
    index = spark.createDataFrame(prefixes, "word string, template int, label string, place int, size int, needed int, words array<string>")
    rare = sorted({p[0] for p in prefixes}, key=rank.get)
    # array_intersect keeps its first array's order: here rarest first.
    long = held.where(F.size("held") >= min((p[5] for p in prefixes), default=1))
    probes = long.select("id0", "key", "line", F.array_intersect(F.array(*map(F.lit, order)), "held").alias("held")).select("*", F.explode(F.array_intersect(F.array(*map(F.lit, rare)), "held")).alias("word"))
    meets = probes.join(F.broadcast(index), "word").withColumn("at", F.array_position("held", F.col("word")))
    left = F.least(F.col("size") - F.col("place"), F.size("held") - F.col("at")) + 1
    first = meets.where((F.size("held") >= F.col("needed")) & (left >= F.col("needed"))).dropDuplicates(["id0", "key", "line", "template"])
    shared = F.size(F.array_intersect("held", "words"))
    return first.where(shared >= F.col("needed")).select("id0", "key", "line", "template", "label", (shared / F.col("size")).alias("containment"))


def window_matches(met: DataFrame, docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """id0, key, label, containment: of the texts and templates (id0, key, template) met, those where a window of twice the template's words holds enough of it; the greatest containment of a window."""
    spark = docs.sparkSession
    sets = [(i, label, template_words(text), 2 * len(re.findall(_WORD, text))) for i, (label, text) in enumerate(templates)]
    index = spark.createDataFrame([(i, label, x, len(x), needed(len(x), threshold), wide) for i, label, x, wide in sets if x], "template int, label string, words array<string>, size int, needed int, wide int")
    met = sized(written(spark, met.select("id0", "key", "template").distinct(), "met"))
    rows = keyed(docs).join(met, ["id0", "key"]).join(F.broadcast(index), "template")
    placed = F.transform(words(F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER)), lambda w, i: F.struct(w.alias("w"), i.alias("i")))
    rows = rows.select("id0", "key", "label", "size", "needed", "wide", F.filter(placed, lambda x: F.array_contains("words", x["w"])).alias("at"))
    rows = written(spark, rows, "places")  # else each window would look for the places anew

    def held(x: Column, i: Column) -> Column:
        return F.size(F.array_distinct(F.transform(F.filter(F.slice("at", i + 1, F.col("wide")), lambda y: y["i"] < x["i"] + F.col("wide")), lambda y: y["w"])))

    rows = rows.select("id0", "key", "label", "size", "needed", F.explode(F.array(F.array_max(F.transform("at", held)))).alias("shared"))
    return rows.where(F.col("shared") >= F.col("needed")).select("id0", "key", "label", (F.col("shared") / F.col("size")).alias("containment"))


def scan(docs: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for each row of docs.

    Base: the places of PHRASES.  labels has also those of the templates found in blocks.  score: 1 with
    a base phrase, else the greatest containment found, else 0.  Texts are split once; what the join needs of them is written.
    """
    none = F.array().cast("array<int>")
    known = F.array(*map(F.lit, vocabulary(templates)))
    rows = keyed(docs).withColumn("text", F.translate(F.coalesce("text", F.lit("")), _UPPER, _LOWER))
    rows = rows.select("doc_id", "id0", "key", F.contains("text", F.lit("license")).alias("hint"), F.transform(F.split("text", "\n"), words).alias("lines"))
    rows = rows.withColumn("found", F.when(F.col("hint"), F.flatten("lines")))
    places = {phrase: F.coalesce(phrase_places(F.col("found"), phrase), none) for phrase, _ in PHRASES}
    split = rows.select(
        "doc_id", "id0", "key", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.size(x)).alias("n_words"),
        F.array(*(F.struct(F.lit(label).alias("label"), places[phrase].alias("at")) for phrase, label in PHRASES)).alias("base"), F.transform("lines", lambda x: F.array_intersect(known, x)).alias("blocks"),
    )
    split = written(docs.sparkSession, split, "blocks")
    held = split.select("id0", "key", F.posexplode("blocks").alias("line", "held")).where(F.size("held") > 0)
    whole = split.where(F.size("blocks") > 1).select("id0", "key", F.lit(-1).alias("line"), F.array_distinct(F.flatten("blocks")).alias("held")).where(F.size("held") > 0)
    met = written(docs.sparkSession, block_matches(held.union(whole), templates, threshold), "matches")
    wrapped = window_matches(met.where("line < 0"), docs, templates, threshold)
    found = met.where("line >= 0").select("id0", "key", "label", "containment").union(wrapped).groupBy("id0", "key").agg(F.collect_set("label").alias("more"), F.max("containment").alias("containment"))
    counted = split.select("doc_id", "id0", "key", "n_words", F.flatten(F.transform("base", lambda x: x["at"])).alias("at"), F.transform(F.filter("base", lambda x: F.size(x["at"]) > 0), lambda x: x["label"]).alias("base"))
    joined = counted.join(found, ["id0", "key"], "left")
    return joined.select(
        "doc_id", "n_words", F.size("at").cast("long").alias("n_base"), F.array_min("at").cast("long").alias("first_word"), F.array_max("at").cast("long").alias("last_word"),
        F.array_join(F.array_sort(F.array_distinct("base")), ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base", F.coalesce("more", F.array().cast("array<string>")))), ",").alias("labels"),
        F.when(F.size("at") > 0, F.lit(1.0)).otherwise(F.coalesce("containment", F.lit(0.0))).alias("score"),
    )
