"""Licence notices in documents, with DataFrame functions only.

Texts and templates are compared as lower-case words of letters and digits, in shingles of five. Of each template, the
shingles with the longest words are picked, one more than a match may lack; a match holds one of them and so its longest
word, an anchor. Only windows around anchors can match. Texts are read in blocks of words,
each with the first words of the next. Windows overlap such that any stretch as long as a template lies inside one; a window with 0.8 of a template's shingles then has a similarity of
0.25 or more to it, and with 48 bands of one row a MinHash retrieves it with a probability of at least
``1 - 0.75**48 > 0.999999``. What is retrieved is verified by exact containment. A notice of fewer than five words is
one shingle of its whole length; its windows are as long and start at every word.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.llm.common import pick, row_key

SHINGLE, BANDS, CONTAINMENT = 5, 48, 0.8
#: window classes: template lengths are rounded up to the next of a geometric series
GROWTH = 1.25

#: fixed values: the notices that are looked for, as their authors print them
NOTICES = [
    ("All-rights-reserved", "All rights reserved."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0-header", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at'),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("MIT", "Released under the MIT License."),
    ("MIT-permission", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction'),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(NOTICES, "license string, text string")


def words_of(text: Column) -> Column:
    return F.split(F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " ")), " ")


def shingles_of(words: Column) -> Column:
    """Distinct shingles of an array of words; none where there are too few words."""
    places = F.when(F.size(words) >= SHINGLE, F.sequence(F.lit(0), F.size(words) - SHINGLE)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(places, lambda i: F.concat_ws(" ", *[F.get(words, i + j) for j in range(SHINGLE)])))


def whole(words: Column, length: Column) -> Column:
    """Words of a short notice or of its window as their only shingle; none where there are fewer."""
    return F.when(F.size(words) == length, F.array(F.concat_ws(" ", words))).otherwise(F.array().cast("array<string>"))


def band_keys(shingles: Column) -> Column:
    """A 64-bit minimum for each band, of shingle hashes that are mixed anew for the band."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    return F.transform(F.sequence(F.lit(1), F.lit(BANDS)), lambda b: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, b))))


def blocks_of(text: Column, size: int, overlap: int) -> Column:
    """Normalised text as an array of blocks of ``size`` words, each followed by the next ``overlap`` words.

    One linear scan: no part of a long text is looked at from its beginning again.
    """
    pieces = F.regexp_extract_all(text, F.lit(r"(?:[^ ]++ ?+){1,%d}+" % size), F.lit(0))
    return F.transform(pieces, lambda p, i: F.concat_ws(" ", F.rtrim(p), F.substring_index(F.get(pieces, i + 1), " ", overlap)))


def computed(df: DataFrame, name: str, value: Column) -> DataFrame:
    """``df`` with a column that is evaluated once per row: the optimizer would move a plain one into every lambda that reads it."""
    return df.select("*", F.explode(F.array(value)).alias(name))


def find_licenses(docs: DataFrame, notices: DataFrame | None = None, id_column: str = "doc_id", text: str = "text", name: str = "license", notice: str = "text") -> DataFrame:
    """``doc_id, license, containment, first_word``: documents of which some window holds 0.8 or more of a notice's shingles.

    One row per document and notice: the largest containment, and the first word (from 0) of the first such window.
    Null and empty texts hold nothing; notices without a word, null ones and those without a name match nothing. A notice of
    fewer than five words matches only as a whole. Of rows equal in id and text each pair is reported once. The notices are a bounded table (a few thousand at most) and are broadcast.
    """
    spark = docs.sparkSession
    notices = templates(spark) if notices is None else notices
    wanted = pick(notices, license=name, t=notice).where(F.col("license").isNotNull() & F.col("t").isNotNull()).distinct()
    wanted = wanted.withColumn("w", words_of(F.col("t"))).where(F.get("w", F.lit(0)) != "")
    short = F.size("w") < SHINGLE
    wanted = wanted.withColumn("tsh", F.when(short, whole(F.col("w"), F.size("w"))).otherwise(shingles_of(F.col("w"))))
    steps = F.ceil(F.log(F.size("w") / float(SHINGLE)) / F.log(F.lit(GROWTH)) - 1e-9)
    wanted = wanted.withColumn("length", F.when(short, F.size("w")).otherwise(F.ceil(F.pow(F.lit(GROWTH), steps) * SHINGLE).cast("int"))).select("license", "tsh", "length")
    longest = F.transform("tsh", lambda s: F.array_max(F.transform(F.split(s, " "), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))))
    # a match lacks at most this many shingles, so one more of them always meets it: those with the longest words serve as anchors
    spared = F.size("tsh") - F.ceil(F.size("tsh") * F.lit(CONTAINMENT) - 1e-9).cast("int")
    rarest = F.slice(F.sort_array(longest, asc=False), F.lit(1), spared + 1)
    bounded = wanted.select("length", F.explode(F.transform(rarest, lambda a: a["w"])).alias("anchor")).distinct().collect()  # of the notices alone
    anchors: dict[int, set[str]] = {}
    for r in bounded:
        anchors.setdefault(r["length"], set()).add(r["anchor"])
    if not anchors:
        kind = pick(docs, doc_id=id_column).schema["doc_id"].dataType.simpleString()
        return spark.createDataFrame([], f"doc_id {kind}, license string, containment double, first_word long")

    def marks(words):
        return F.array(*map(F.lit, sorted(words)))

    overlap = -(-3 * max(anchors) // 2)
    block = max(256, 2 * overlap)
    source = pick(docs, doc_id=id_column, text=text).where(F.col("text").isNotNull()).withColumn("key", row_key("doc_id", "text"))
    source = computed(source.select("key", "doc_id", F.trim(F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}]+", " ")).alias("text")), "plain", F.col("text"))
    source = computed(source.select("key", "doc_id", "plain"), "pieces", blocks_of(F.col("plain"), block, overlap))
    source = source.select("key", "doc_id", F.posexplode("pieces").alias("number", "piece"))
    source = computed(source, "words", F.split("piece", " ")).drop("piece").where(F.arrays_overlap("words", marks(set().union(*anchors.values()))))
    # a class of lengths looks around the anchors of its own notices
    classes = F.explode(F.array(*[F.struct(F.lit(n).alias("length"), marks(w).alias("marks")) for n, w in sorted(anchors.items())]))
    source = source.withColumn("class", classes).select("*", "class.*").where(F.arrays_overlap("words", "marks"))
    at = F.filter(F.transform("words", lambda w, i: F.when(F.array_contains("marks", w), i)), lambda i: i.isNotNull())
    source = computed(source.select("key", "doc_id", "number", "words", "length", "marks"), "at", at)
    short = F.col("length") < SHINGLE
    stride = F.when(short, 1).otherwise(F.ceil(F.col("length") / 2).cast("int"))
    width = F.when(short, F.col("length")).otherwise(F.ceil(F.col("length") * 1.5).cast("int"))
    # windows start at multiples of the stride in their block; those that hold the place of an anchor
    first = lambda i: F.greatest(F.lit(0), F.ceil((i - width + 1) / stride).cast("int"))
    last = lambda i: F.floor(F.least(i, F.lit(block - 1)) / stride).cast("int")
    spans = F.transform("at", lambda i: F.when(first(i) <= last(i), F.sequence(first(i), last(i))).otherwise(F.array().cast("array<int>")))
    windows = source.select("key", "doc_id", "number", "length", "words", F.explode(F.array_distinct(F.flatten(spans))).alias("n"))
    windows = computed(windows, "here", F.slice("words", F.col("n") * stride + 1, width))
    windows = windows.withColumn("start", F.col("number").cast("long") * block + F.col("n") * stride).drop("words")
    windows = computed(windows, "sh", F.when(short, whole(F.col("here"), F.col("length"))).otherwise(shingles_of(F.col("here")))).where(F.size("sh") > 0)
    windows = computed(windows.select("key", "doc_id", "length", "start", "sh"), "keys", band_keys(F.col("sh")))
    windows = windows.withColumn("keys", F.when(short, F.slice("keys", 1, 1)).otherwise(F.col("keys")))  # a single shingle has the same key or another in all bands
    bands = wanted.select("license", "tsh", "length", F.posexplode(band_keys(F.col("tsh"))).alias("band", "least"))
    met = windows.select("key", "doc_id", "length", "start", "sh", F.posexplode("keys").alias("band", "least")).join(F.broadcast(bands), ["length", "band", "least"])
    held = met.withColumn("containment", F.size(F.array_intersect("sh", "tsh")) / F.size("tsh")).where(F.col("containment") >= CONTAINMENT)
    best = held.groupBy("key", "license").agg(
        F.min("doc_id").alias("doc_id"), F.max(F.struct("containment", (-F.col("start")).alias("back"))).alias("top")
    )
    return best.select("doc_id", "license", F.col("top.containment").alias("containment"), (-F.col("top.back")).alias("first_word"))
