"""License scans by diagonal voting.

Words are runs of ASCII letters and digits and of non-ASCII characters, A-Z
lower-cased.  Every rolling ``K``-word gram of a text is hashed and joined with
the gram positions of the license templates; a hit votes for the diagonal
(position in the text minus position in the template).  Votes are aggregated
per diagonal, diagonals at most ``GAP`` apart merge (a word more or less in a
copied notice moves the rest to the next diagonal), and a merged band is a
span of that license if it covers ``MIN_SHARE`` of the template's grams within
twice its length.  Hits join on the hash and on the gram's own words, so a
hash collision never votes.

Sibling licenses differ in a word or two (lesser, affero, noncommercial,
sharealike), which a merged band would pass over.  Where the text of another
license covers enough of a template, a span of the template must also hold one of
the grams that the other text lacks; those grams follow from the templates.

Base places are where a phrase's words stand consecutively ("mit license",
"apache license", "general public license"); their labels are always kept.

The template table holds a few hundred constant rows, hence the broadcast; a
constant bitmap of gram hashes sifts grams before rows are made of them (it
only passes too many).  A document's rows travel in one path from the scan, so
texts are read and split once and only hits are shuffled.

Null or empty text has no words.  Every row is its own document, repeated rows
and null ids included; an empty table gives an empty result; extra columns are
never read.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import lower_ascii

K = 3
GAP = 2
MIN_SHARE = 0.6
BITMAP = 1 << 15
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: fixed values: phrases whose places count, with their labels
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}
#: fixed values: wordings of license notices
TEMPLATES = [
    ("mit", "Released under the MIT License"),
    ("mit", "Licensed under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
            "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
               "http://www.apache.org/licenses/LICENSE-2.0"),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public "
            "License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"),
    ("lgpl", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation"),
    ("agpl", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met"),
    ("bsd", "Licensed under the BSD License"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "This is free and unencumbered software released into the public domain"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by", "Licensed under CC BY 4.0"),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("proprietary", "All rights reserved. No part of this publication may be reproduced"),
]


def template_words(text: str) -> list[str]:
    return re.findall(WORD, "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))


def gram_list(text: str) -> list[str]:
    words = template_words(text)
    return [" ".join(words[i:i + K]) for i in range(len(words) - K + 1)]


def own_positions(templates) -> list[list[int]]:
    """For each template the positions of the grams that no other license's text,
    if it covers ``MIN_SHARE`` of the template, has; empty where none does."""
    grams = [(label, gram_list(text)) for label, text in templates]
    out = []
    for label, mine in grams:
        siblings = [set(g) for other, g in grams if other != label and sum(x in set(g) for x in mine) >= MIN_SHARE * len(mine)]
        out.append([i for i, x in enumerate(mine) if not any(x in g for g in siblings)] if siblings else [])
    return out


def template_grams(spark: SparkSession, templates=None) -> DataFrame:
    """(template, label, n_grams, t_pos, gram, own, hash): constant rows of the template texts."""
    rows, templates = [], templates or TEMPLATES
    for number, ((label, text), own) in enumerate(zip(templates, own_positions(templates))):
        grams = gram_list(text)
        rows += [(number, label, len(grams), i, gram, f"array({', '.join(map(str, own))})") for i, gram in enumerate(grams)]
    quote = lambda s: s.replace("'", "''")
    values = ", ".join(f"({n}, '{quote(label)}', {g}, {i}, '{quote(gram)}', CAST({own} AS ARRAY<INT>))" for n, label, g, i, gram, own in rows)
    grams = spark.sql(f"SELECT * FROM VALUES {values} AS t(template, label, n_grams, t_pos, gram, own)")
    return grams.withColumn("hash", F.xxhash64(*[F.split("gram", " ")[i] for i in range(K)]))


def _bitmap(grams: DataFrame) -> str:
    bits = bytearray(BITMAP)
    for r in grams.select("hash").distinct().collect():  # a few hundred constants
        bits[r["hash"] % BITMAP] = 1
    return bits.hex()


def scan(docs: DataFrame, templates=None) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, spans."""
    grams = template_grams(docs.sparkSession, templates)
    bitmap = _bitmap(grams)
    text = lower_ascii(F.coalesce(F.col("text"), F.lit("")))
    split = docs.select("doc_id", F.monotonically_increasing_id().alias("row"), text.alias("text")).select(
        "doc_id", "row", F.regexp_extract_all("text", F.lit(WORD), F.lit(0)).alias("words"),
        F.contains(F.col("text"), F.lit("license")).alias("maybe"))
    n = F.size("words")
    word = lambda i: F.get("words", i)

    def place(i):
        out = F.lit(None).cast("struct<start:int,label:string>")
        for phrase, label in PHRASES.items():
            parts = phrase.split(" ")
            whole = F.lit(True)
            for back, p in enumerate(reversed(parts)):
                whole = whole & F.coalesce(word(i - back) == p, F.lit(False))
            out = F.when(whole, F.struct((i - (len(parts) - 1)).alias("start"), F.lit(label).alias("label"))).otherwise(out)
        return out

    none = F.array().cast("array<struct<start:int,label:string>>")
    lasts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: word(i) == "license")
    base = F.when(F.col("maybe") & (n > 1), F.filter(F.transform(lasts, place), lambda x: x.isNotNull())).otherwise(none)
    gram_hash = lambda i: F.xxhash64(*[word(i + j) for j in range(K)])
    passed = F.filter(F.sequence(F.lit(0), n - K), lambda i: F.substring(
        F.lit(bytes.fromhex(bitmap)), (F.pmod(gram_hash(i), F.lit(BITMAP)) + 1).cast("int"), F.lit(1)) == F.lit(b"\x01"))
    hits = F.when(n >= K, F.transform(passed, lambda i: F.struct(
        i.alias("pos"), gram_hash(i).alias("hash"), F.concat_ws(" ", *[word(i + j) for j in range(K)]).alias("gram"))))
    rows = split.select("doc_id", "row", n.cast("long").alias("n_words"), base.alias("base"), hits.alias("hits"))
    # every document keeps one row without a hit, so none is lost when only some hits join
    rows = rows.select(
        "doc_id", "row", "n_words", F.size("base").cast("long").alias("n_base"),
        F.array_min("base.start").cast("long").alias("first_word"), F.array_max("base.start").cast("long").alias("last_word"),
        F.array_sort(F.array_distinct("base.label")).alias("base_set"), F.explode_outer("hits").alias("hit"))
    own = ["doc_id", "row", "n_words", "n_base", "first_word", "last_word", "base_set"]
    votes = rows.join(F.broadcast(grams.withColumnsRenamed({"hash": "t_hash", "gram": "t_gram"})),
                      (F.col("hit.hash") == F.col("t_hash")) & (F.col("hit.gram") == F.col("t_gram")), "left")
    # a diagonal has at most as many distinct template positions as the template has grams
    diagonals = votes.groupBy(*own, "template", "label", "n_grams", (F.col("hit.pos") - F.col("t_pos")).alias("diagonal")).agg(
        F.collect_set("t_pos").alias("at"), F.first("own").alias("own"), F.min("hit.pos").alias("first"), F.max("hit.pos").alias("last"))
    along = Window.partitionBy("row", "template").orderBy("diagonal", "first")
    # a band goes on while diagonals are near and the text has not moved on by more than a template
    apart = ((F.col("diagonal") - F.lag("diagonal").over(along) > GAP)
             | (F.col("first") - F.lag("last").over(along) > F.col("n_grams")))
    bands = diagonals.withColumn("new", F.coalesce(apart, F.lit(True)).cast("int")).withColumn(
        "band", F.sum("new").over(along.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    spans = bands.groupBy(*own, "template", "label", "n_grams", "band").agg(
        F.array_distinct(F.flatten(F.collect_list("at"))).alias("at"), F.first("own").alias("own"), F.min("first").alias("first"), F.max("last").alias("last"))
    share = F.least(F.lit(1.0), F.size("at") / F.col("n_grams"))
    itself = (F.size("own") == 0) | F.arrays_overlap("at", "own")
    good = itself & (share >= MIN_SHARE) & (F.col("last") - F.col("first") + K <= 2 * (F.col("n_grams") + K))
    found = spans.groupBy(*own).agg(
        F.collect_set(F.when(good, F.col("label"))).alias("method"), F.max(F.when(good, share)).alias("best"),
        F.sort_array(F.collect_list(F.when(good, F.struct("label", F.col("first").alias("first_word"), (F.col("last") + K - 1).alias("last_word"))))).alias("spans"))
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_set", ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_union("base_set", "method")), ",").alias("labels"),
        F.greatest(F.coalesce("best", F.lit(0.0)), F.when(F.col("n_base") > 0, 0.5).otherwise(0.0)).alias("score"), "spans")
