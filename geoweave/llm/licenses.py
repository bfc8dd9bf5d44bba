"""License scans with DataFrame operations only.

Templates and texts become sets of hashed word shingles. For templates of up to L words, texts are cut into windows of
2 L words that overlap by half, so a passage as long as its template lies whole in one window. MinHash values, each a band
of one row, retrieve the templates of a window; their number is set for each length so that a window with the wanted
containment meets its template with probability 1 - MISS. Exact containment of the template's shingles in the window then
decides. A band can only meet where the text has the template's least shingle itself, so texts and windows with
none of the templates' shingles are passed over before: no collision is lost.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Probability that a window with the wanted containment meets its template in no band.
MISS = 1e-6
#: Rows of template bands up to which they are sent to all tasks; beyond, the join is by shuffle.
BROADCAST_ROWS = 100_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MARKS = ".,;:()[]{}<>\"'`*#/-_=+!?\t\n\x0b\x0c\r"

# Wording of public license notices.
TEMPLATES = {
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "mit-line": "Released under the MIT License.",
    "gpl-3-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "mit-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), "
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
        "and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"
    ),
    "bsd-grant": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
    ),
    "apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. "
        "You may obtain a copy of the License at"
    ),
    "gpl-header": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by "
        "the Free Software Foundation"
    ),
    "isc-grant": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
}


def bound(value: Column, use) -> Column:
    """use(value) with value computed once, however often lambdas in it refer to it."""
    return F.transform(F.array(value), use)[0]


def plain_words(text: Column) -> Column:
    """Words with A-Z in lower case, cut at spaces and marks; none for null."""
    plain = F.translate(F.coalesce(text, F.lit("")), _UPPER + _MARKS, _UPPER.lower() + " " * len(_MARKS))
    return F.filter(F.split(plain, " +"), lambda w: w != "")


def shingles(words: Column, k: int) -> Column:
    """Hashes of the k-word shingles in order; none if there are fewer words."""

    def of(w: Column) -> Column:
        starts = F.when(F.size(w) >= k, F.sequence(F.lit(1), F.size(w) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.xxhash64(F.slice(w, i, k)))

    return bound(words, of)


def least_hashes(hashes: Column, bands: Column) -> Column:
    return bound(hashes, lambda h: F.transform(F.sequence(F.lit(1), bands), lambda s: F.array_min(F.transform(h, lambda x: F.xxhash64(x, s)))))


def windows(hashes: Column, spans: list[int], k: int) -> Column:
    """For each window length: structs (span, place, s) of the windows' first words and shingles."""

    def of(span: int, h: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(h) - 1, F.lit(0)), F.lit(span // 2))
        return F.transform(starts, lambda at: F.struct(F.lit(span).alias("span"), at.alias("place"), F.slice(h, at + 1, span - k + 1).alias("s")))

    return bound(hashes, lambda h: F.concat(*[of(span, h) for span in spans]))


def window_words(n_words: int) -> int:
    """The window for templates of n words: 2 L for the least power of two L that is n or more."""
    return 2 << max(2, (n_words - 1).bit_length())


def bands_for(window: int, k: int, percent: int) -> int:
    """Bands so that the least similar window with the wanted containment is missed with probability MISS at most."""
    worst = 1.0
    for n in range(max(k, window // 4 + 1 if window > 8 else k), window // 2 + 1):
        size = n - k + 1
        shared = math.ceil(size * percent / 100)
        worst = min(worst, shared / (window - k + 1 + size - shared))
    return math.ceil(math.log(MISS) / math.log(1 - worst)) if worst < 1 else 1


def scan(docs: DataFrame, templates: dict[str, str], k: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, license, n_shared, n_shingles, first_word) for docs (doc_id, text): templates with 100 * shared >= percent * all.

    n_shingles: distinct k-word shingles of the template; n_shared: the most of them in one window of the text, and
    first_word, from 0, the first such window's first word. Templates of fewer than k words, and null, empty and shorter
    texts, match nothing; texts are looked through whole, however long. Rows that share a doc_id give one row for each license. Columns beside doc_id and text are not
    looked at. An empty table gives an empty one.
    """
    spark: SparkSession = docs.sparkSession
    # bounded by the notices given, not by the documents
    table = spark.createDataFrame(sorted(templates.items()), "license string, notice string").select("license", plain_words(F.col("notice")).alias("w"))
    table = table.select("license", F.size("w").alias("n"), F.array_distinct(shingles(F.col("w"), k)).alias("t")).where(F.size("t") > 0)
    rows = table.collect()
    if not rows:
        return spark.createDataFrame([], "doc_id long, license string, n_shared long, n_shingles long, first_word long")
    bands = {span: bands_for(span, k, percent) for span in sorted({window_words(r["n"]) for r in rows})}
    known = spark.createDataFrame([(r["license"], window_words(r["n"]), r["t"]) for r in rows], "license string, span int, t array<long>")
    n_bands = F.element_at(F.create_map(*[F.lit(x) for pair in bands.items() for x in pair]), F.col("span"))
    banded = known.select("license", "span", "t", F.posexplode(least_hashes(F.col("t"), n_bands)).alias("band", "m"))
    if sum(bands[window_words(r["n"])] for r in rows) <= BROADCAST_ROWS:
        banded = F.broadcast(banded)
    seeds = sorted({x for r in rows for x in r["t"]})
    text = docs.select(F.col("doc_id").cast("long").alias("doc_id"), shingles(plain_words(F.col("text").cast("string")), k).alias("h"))
    hit = text.where(F.exists("h", lambda x: x.isin(seeds)))
    cut = hit.select("doc_id", F.inline(windows(F.col("h"), list(bands), k)))
    cut = cut.where(F.exists("s", lambda x: x.isin(seeds)))
    met = cut.select("doc_id", "span", "place", "s", F.posexplode(least_hashes(F.col("s"), n_bands)).alias("band", "m")).join(banded, ["span", "band", "m"])
    shared = F.size(F.array_intersect("s", "t"))
    every = met.select("doc_id", "license", F.col("place").alias("at"), shared.alias("n_shared"), F.size("t").alias("n_shingles")).where(100 * F.col("n_shared") >= percent * F.col("n_shingles"))
    best = F.max(F.struct("n_shared", (-F.col("at")).alias("back")))
    return every.groupBy("doc_id", "license", "n_shingles").agg(best.alias("b")).select(
        "doc_id", "license", F.col("b.n_shared").cast("long").alias("n_shared"), F.col("n_shingles").cast("long").alias("n_shingles"), (-F.col("b.back")).cast("long").alias("first_word")
    )
