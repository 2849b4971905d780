"""Licence notices: MinHash bands over overlapping windows of a text retrieve templates, exact shingle containment verifies them.

Everything is column functions. A window of ``2 * L`` shingles starts at every ``L``-th one, so that a notice of up to ``L``
shingles lies whole in some window; templates of L/2 to L shingles are looked for in windows of that class. A window that
holds 0.8 of a template then has a Jaccard similarity of 0.19 or more with it, and 64 bands of one minhash miss such a pair
with a chance below 2 in a million. Windows without a single shingle of any template share no minhash with one and are left out before
the bands are made.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, quoted

SIZE, BANDS = 5, 64
MAX_TEMPLATE_SHINGLES = 20_000   # what is sent to every task

# Notices in the words of the licences' own texts.
TEMPLATES = {
    "mit": ["Released under the MIT License.", "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."],
    "gpl-3.0": ["This work is licensed under the GNU General Public License, version 3.",
                "it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl-2.0": ["This work is licensed under the GNU General Public License, version 2."],
    "lgpl-3.0": ["it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License"],
    "cc-by-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "bsd-3-clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
}


def words_of(text: str) -> list[str]:
    return [w for w in re.split(r"[\W_]+", text.lower()) if w]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def _shingles(words: Column, size: int) -> Column:
    """64-bit hashes of the runs of ``size`` words."""
    return F.when(F.size(words) < size, F.array().cast("array<bigint>")).otherwise(
        F.transform(F.sequence(F.lit(0), F.size(words) - size), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(size)])))


def _minhashes(shingles: Column, bands: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda b: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))))


def length_class(n_shingles: int) -> int:
    return 1 << max(0, (n_shingles - 1).bit_length())


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, list[str]] | None = None, size: int = SIZE, least: float = 0.8, bands: int = BANDS) -> DataFrame:
    """(key, license, containment, first_word, last_word): one row for each licence found in a row's text, however often it stands there.

    ``containment`` is the best share of a template's shingles in one window; the words (numbered from 0; runs of letters and
    digits, lower-cased) are the first and last of any verified notice. Null and empty texts and texts of fewer than ``size``
    words hold none; rows that repeat a key report together; a template needs ``size`` words.
    """
    templates = TEMPLATES if templates is None else templates
    listed = [(name, words_of(t)) for name, texts in templates.items() for t in texts]
    if any(len(w) < size for _, w in listed):
        raise ValueError(f"a template has fewer than {size} words")
    if sum(len(w) for _, w in listed) > MAX_TEMPLATE_SHINGLES:
        raise ValueError("the templates are too large to be sent to every task")
    spark = df.sparkSession
    rows = [F.struct(F.lit(i).alias("template"), F.lit(name).alias("license"), F.lit(length_class(len(w) - size + 1)).alias("L"), F.array(*[F.lit(x) for x in w]).alias("words")) for i, (name, w) in enumerate(listed)]
    known = spark.range(1).select(F.explode(F.array(*rows)).alias("t")).select("t.*").withColumn("ts", F.array_distinct(_shingles(F.col("words"), size))).drop("words")
    banded = known.select("license", "L", "ts", F.posexplode(_minhashes(F.col("ts"), bands)).alias("band", "least"))
    every = sorted({h for r in known.select("ts").collect() for h in r["ts"]})
    classes = sorted({length_class(len(w) - size + 1) for _, w in listed})

    docs = only(df, _key=key, _x=text).select("_key", _words(F.col("_x")).alias("ws"))
    docs = docs.select("_key", _shingles(F.col("ws"), size).alias("sh"))
    hits = F.filter(F.transform("sh", lambda h, i: F.when(h.isin(every), i)), lambda i: i.isNotNull())
    docs = docs.select("_key", "sh", hits.alias("hits"))

    def starts(step: int) -> Column:
        """The windows of a class that hold a hit: at most two for each."""
        near = F.transform("hits", lambda i: F.array(F.floor(i / step).cast("int"), F.greatest(F.floor(i / step).cast("int") - 1, F.lit(0))))
        return F.transform(F.array_distinct(F.flatten(near)), lambda w: F.struct(F.lit(step).alias("L"), (w * step).alias("at")))

    # An outer explode: a filter on the arrays would be pushed below the columns that they are made of and take them apart again.
    windows = docs.select("_key", "sh", F.explode_outer(F.flatten(F.array(*[starts(c) for c in classes]))).alias("w")).filter("w IS NOT NULL")
    windows = windows.select("_key", "w.L", "w.at", F.slice("sh", F.col("w.at") + 1, 2 * F.col("w.L")).alias("win"))
    windows = windows.select("*", F.posexplode(_minhashes(F.col("win"), bands)).alias("band", "least"))
    met = windows.join(F.broadcast(banded), ["L", "band", "least"])
    there = F.filter(F.transform("win", lambda h, i: F.when(F.array_contains("ts", h), F.col("at") + i)), lambda i: i.isNotNull())
    met = met.select("_key", "license", (F.size(F.array_intersect("win", "ts")) / F.size("ts")).alias("containment"), F.array_min(there).alias("a"), F.array_max(there).alias("b"))
    found = met.filter(F.col("containment") >= least).groupBy("_key", "license").agg(F.max("containment").alias("containment"), F.min("a").alias("first_word"), (F.max("b") + size - 1).alias("last_word"))
    return found.select(F.col("_key").alias(key), "license", F.round("containment", 6).alias("containment"), "first_word", "last_word")
