"""Licence scans through a positional index of rare licence words, in DataFrame operations only.

Licence words are weighted by their inverse document frequency over all files.  A template is looked up by its anchor, the
rarest word of its mandatory phrases: a file without it cannot have the phrases, so that no label is lost.  Files that have
it are verified for the phrases, and their places of the template's words meet its postings; places that agree on one
relative position (file place minus template place) vote together, and a template with enough votes labels the file.
Three fixed phrases are also counted place by place, by plain string functions.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Counted phrases and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Words too common in any text to be licence words.
COMMON = frozenset(
    "a an and any are as at be but by copy do file for form forms free from hereby if in is it may met no not of on or other person purpose see shall software source such terms that the their this to under use used version was whether which who will with without work you your".split()
)
#: Label, notice in words, phrases without which the label is not given.
TEMPLATES = [
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind", ["apache license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", ["permission is hereby granted free of charge"]),
    ("mit", "released under the mit license", ["mit license"]),
    ("mit", "licensed under the mit license", ["mit license"]),
    ("mit", "spdx license identifier mit", ["spdx license identifier mit"]),
    ("apache-2.0", "spdx license identifier apache 2 0", ["spdx license identifier apache 2 0"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ["redistribution and use in source and binary forms"]),
    ("bsd", "spdx license identifier bsd 3 clause", ["spdx license identifier bsd"]),
    ("gpl-notice", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ["gnu general public license"]),
    ("gpl-notice", "spdx license identifier gpl 3 0", ["spdx license identifier gpl"]),
    ("lgpl-notice", "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ["lesser general public license"]),
    ("agpl-notice", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ["affero general public license"]),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one", ["mozilla public license"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies", ["with or without fee is hereby granted"]),
    ("creative-commons", "this work is licensed under a creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("creative-commons", "this work is licensed under cc by sa 4 0", ["licensed under cc by"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["released into the public domain"]),
    ("mit", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", ["shall be included in all copies or substantial portions of the software"]),
    ("bsd", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission", ["may be used to endorse or promote products derived from this software"]),
    ("gpl-notice", "you should have received a copy of the gnu general public license along with this program", ["received a copy of the gnu general public license"]),
    ("zlib", "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely", ["permission is granted to anyone to use this software for any purpose"]),
    ("boost-1.0", "distributed under the boost software license version 1 0", ["boost software license"]),
    ("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license", ["eclipse public license"]),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ["waived all copyright and related or neighboring rights"]),
    ("copyright", "copyright c all rights reserved", ["copyright", "all rights reserved"]),
]
#: The votes a template needs (fewer if it has fewer words).
VOTES = 3


def template_words(notice: str) -> list[tuple[int, str]]:
    return [(i, w) for i, w in enumerate(notice.split()) if w not in COMMON]


VOCABULARY = sorted({w for _, notice, _ in TEMPLATES for _, w in template_words(notice)})


def spaced(text):
    """The words of the text between single spaces, with one before the first and after the last; ' ' without words.

    lower() differs from lower-casing A-Z only on characters that are word characters before and after.
    """
    words = F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), NOT_WORD, " "))
    return F.when(words == "", F.lit(" ")).otherwise(F.concat(F.lit(" "), words, F.lit(" ")))


def _spaces(text):
    return F.length(text) - F.length(F.replace(text, F.lit(" "), F.lit("")))


def _files(docs: DataFrame) -> DataFrame:
    """One pass over the texts: counts, phrase places, licence words, and the spaced text of files with two of them."""
    files = docs.select(F.col("doc_id").cast("long"), spaced(F.col("text").cast("string")).alias("s"))
    files = files.withColumn("n_words", (_spaces(F.col("s")) - 1).cast("long"))
    has = {p: F.contains(F.col("s"), F.lit(f" {p} ")) for p in PHRASES}
    first = [F.when(h, _spaces(F.substring(F.col("s"), F.lit(1), F.locate(f" {p} ", F.col("s")))) - 1) for p, h in has.items()]
    last = [F.when(h, F.col("n_words") - _spaces(F.substring_index("s", f" {p} ", -1)) - len(p.split())) for p, h in has.items()]
    some = F.lit(False)
    for h in has.values():
        some = some | h
    places = F.regexp_count("s", F.lit(f"(?<= )(?:{'|'.join(PHRASES)})(?= )"))
    hits = F.array_intersect(F.split("s", " "), F.array(*[F.lit(w) for w in VOCABULARY]))
    files = files.select(
        "doc_id", "n_words", F.xxhash64("s").alias("text_hash"),
        F.when(some, places).otherwise(0).cast("long").alias("n_base"),
        F.least(*first).cast("long").alias("first_word"), F.greatest(*last).cast("long").alias("last_word"),
        F.array_compact(F.array(*[F.when(h, F.lit(PHRASES[p])) for p, h in has.items()])).alias("base"),
        hits.alias("hits"), "s",
    )
    return files.withColumn("s", F.when(F.size("hits") >= 2, F.col("s")))


def _votes(files: DataFrame, rows: int) -> DataFrame:
    """doc_id, text_hash, found (labels), score of each file that a template labels."""
    spark = files.sparkSession
    seen = {r["w"]: r["count"] for r in files.select(F.explode("hits").alias("w")).groupBy("w").count().collect()}  # at most the vocabulary
    idf = {w: math.log((rows + 1) / (seen.get(w, 0) + 1)) + 1e-3 for w in VOCABULARY}
    postings, lookups = [], []
    for t, (label, notice, mandatory) in enumerate(TEMPLATES):
        words = template_words(notice)
        distinct = sorted({w for _, w in words})
        need, weight = min(VOTES, len(distinct)), sum(idf[w] for w in distinct)
        anchor = max((w for p in mandatory for w in p.split() if w in idf), key=lambda w: (idf[w], w))
        lookups.append((anchor, t, label, need, weight, [f" {p} " for p in mandatory], distinct))
        postings += [(t, w, i, idf[w]) for i, w in words]
    lookups = spark.createDataFrame(lookups, "anchor string, template int, label string, need int, weight double, phrases array<string>, words array<string>")
    postings = spark.createDataFrame(postings, "template int, w string, at int, idf double")
    # The templates' rarest words are looked up in the file's licence words; both tables are as large as TEMPLATES.
    files = files.filter("s is not null").select("doc_id", "text_hash", "s", F.explode("hits").alias("anchor"))
    files = files.join(F.broadcast(lookups), "anchor").filter(F.forall("phrases", lambda p: F.contains(F.col("s"), p)))
    placed = files.select("doc_id", "text_hash", "template", "label", "need", "weight", "words", F.posexplode(F.split(F.trim("s"), " ")).alias("place", "w")).filter(F.array_contains(F.col("words"), F.col("w")))
    met = placed.join(F.broadcast(postings), ["template", "w"])
    votes = met.groupBy("doc_id", "text_hash", "template", "label", "need", "weight", (F.col("place") - F.col("at")).alias("shift"))
    # A word has one idf, so its places at one shift count once by the maximum per word; words differ in their postings.
    votes = votes.agg(F.collect_set(F.struct("w", "idf")).alias("words")).filter(F.size("words") >= F.col("need"))
    share = F.aggregate("words", F.lit(0.0), lambda a, x: a + x["idf"]) / F.col("weight")
    return votes.groupBy("doc_id", "text_hash").agg(F.collect_set("label").alias("found"), F.max(F.least(share, F.lit(1.0))).alias("found_score"))


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of docs.

    Null and empty texts have no words, no labels ('') and score 0; a base phrase gives score 1, else the score is the
    share of the best template's word weight that agrees.  Repeated rows get repeated results; a null doc_id stays null; an
    empty table gives no rows; other columns are ignored, whatever their names.
    """
    files = materialize(_files(docs), "files")
    found = _votes(files, files.count())
    found = found.select(F.col("doc_id").alias("id2"), F.col("text_hash").alias("hash2"), "found", "found_score")
    joined = files.join(found, files["doc_id"].eqNullSafe(found["id2"]) & (files["text_hash"] == found["hash2"]), "left")
    labels = F.array_sort(F.array_distinct(F.concat("base", F.coalesce("found", F.array().cast("array<string>")))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("found_score", F.lit(0.0)))
    return joined.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", F.array_sort("base")).alias("base_labels"), F.concat_ws(",", labels).alias("labels"), score.alias("score"),
    )
