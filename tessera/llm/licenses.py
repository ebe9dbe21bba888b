"""License scan with built-in functions only.

Texts and license templates become shingles of five words; windows of 1, 2, 4 and 8 shingles overlap, one
at every word. ``BANDS`` minhashes of one row each are taken of every window by doubling: the minimum over
a window is the lesser of the minima over its halves. A template is indexed by its windows of the
longest size that fits it; a window of a document that has a minhash in common with one of them (a
set of literals, tested inside the document's arrays) is a hit. Two windows of similarity s
have none in common with probability ``(1 - s) ** BANDS``: 0.2 % at 0.78 (one word off), and never if
they are equal.

Each hit puts the template at one place in the document. There the share of the template's distinct
shingles that the document's words of that place hold is computed on the words themselves, and matches
of ``CONTAINMENT`` or more are kept. Nothing is shuffled but the matches.

Words are runs of letters and digits in lower case, with dots and hyphens inside. Templates are a
parameter, so their number is known; they are scanned for ``PART`` at a time.

Templates of fewer than five words are one shingle of their own length: a place where a document's words equal
them is a match. Only texts that contain all their words as strings are looked at for that.

Defined cases: a null or short text matches nothing. A template without words is an error.
A row without a doc_id is scanned as well. Rows that repeat a doc_id count as one. Equal containments
keep the first place.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE, BANDS, CONTAINMENT = 5, 4, 0.8
#: Window sizes in shingles.
SIZES = (1, 2, 4, 8)
#: Templates of one pass.
PART = 500
WORD = r"[\p{L}\p{N}]+(?:[.\-][\p{L}\p{N}]+)*"
#: The same for Python, where \w without the underscore stands for letters and digits.
WORD_ASCII = r"[^\W_]+(?:[.\-][^\W_]+)*"

#: The notices by which works declare common public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("All-rights-reserved", "All rights reserved."),
    ("Apache-2.0-SPDX", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-SPDX", "SPDX-License-Identifier: GPL-3.0"),
    ("GPL-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT-grant", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT-SPDX", "SPDX-License-Identifier: MIT"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
]


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})"), F.lit(1))


def _shingles(words: Column) -> Column:
    """Hash of the shingle at every word but the last four."""
    last = F.size(words) - SHINGLE
    at = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    return F.transform(at, lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(SHINGLE)]))


def _minhash(band: int) -> Column:
    return F.transform("shingles", lambda h: F.xxhash64(h, F.lit(band)))


def _places(size: int, band: int, keys: list[int]) -> Column:
    """Where a window's minhash of the band is one of ``keys``."""
    at = F.transform(
        f"m{size}_{band}",
        lambda m, p: F.when(
            m.isin(keys),
            F.struct(F.lit(size).alias("size"), F.lit(band).alias("band"), m.alias("key"), p.alias("p")),
        ),
    )
    return F.filter(at, lambda h: h.isNotNull())


def _with_minhashes(df: DataFrame, sizes: Sequence[int]) -> DataFrame:
    """Adds ``m<size>_<band>`` of the windows from every shingle of ``shingles``."""
    df = df.withColumns({f"m1_{b}": _minhash(b) for b in range(BANDS)})
    for size in SIZES[1:]:
        if size > max(sizes):
            break
        half = size // 2

        def doubled(name: str, half: int = half) -> Column:
            later = F.slice(name, F.lit(half + 1), F.greatest(F.size(name), F.lit(1)))
            return F.zip_with(name, later, lambda x, y: F.least(x, y))

        df = df.withColumns({f"m{size}_{b}": doubled(f"m{half}_{b}") for b in range(BANDS)})
    return df


def _index(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """``size, band, key, at, license_id, shingles, n`` of each template's windows."""
    given = [F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("text")) for i, t in templates]
    rows = docs.sparkSession.range(1).select(F.inline(F.array(*given)))
    words = rows.select("license_id", _words(F.col("text")).alias("words"))
    last = F.size("words") - SHINGLE
    texts = F.transform(
        F.sequence(F.lit(1), last + 1), lambda i: F.array_join(F.slice("words", i, SHINGLE), " ")
    )
    whole = words.select(
        "license_id", _shingles(F.col("words")).alias("shingles"), (last + 1).alias("n"),
        F.array_distinct(texts).alias("texts"),
    )
    fitting = F.lit(SIZES[-1])
    for size in reversed(SIZES[:-1]):
        fitting = F.when(F.col("n") < 2 * size, size).otherwise(fitting)
    sized = _with_minhashes(whole.filter("n > 0").withColumn("size", fitting), SIZES)
    none = F.array().cast("array<struct<band: int, at: int, key: bigint>>")
    windows = [_windows(size, band, none) for size in SIZES for band in range(BANDS)]
    return sized.select("license_id", "texts", "n", "size", F.inline(F.concat(*windows)))


def _windows(size: int, band: int, none: Column) -> Column:
    """The windows of the band, for templates of that size of window."""
    windows = F.slice(f"m{size}_{band}", F.lit(1), F.greatest(F.col("n") - size + 1, F.lit(1)))
    each = F.transform(
        windows, lambda m, at: F.struct(F.lit(band).alias("band"), at.alias("at"), m.alias("key"))
    )
    return F.when(F.col("size") == size, each).otherwise(none)


def license_scan(
    docs: DataFrame, templates: Sequence[tuple[str, str]] = tuple(TEMPLATES)
) -> DataFrame:
    """``doc_id, license_id, containment, first_word, n_words``: the best place of each match."""
    sized = [(len(re.findall(WORD_ASCII, t.lower())), (i, t)) for i, t in templates]
    if not all(n for n, _ in sized):
        raise ValueError("templates need words")
    short, long = [t for n, t in sized if n < SHINGLE], [t for n, t in sized if n >= SHINGLE]
    found = _short(docs, short) if short else None
    for lo in range(0, len(long), PART):
        part = _scan(docs, long[lo : lo + PART])
        found = part if found is None else found.union(part)
    best = F.max(F.struct("containment", -F.col("first_word"), "n_words")).alias("best")
    return found.groupBy("doc_id", "license_id").agg(best).select(
        "doc_id", "license_id", "best.containment",
        (-F.col("best.col2")).cast("long").alias("first_word"), "best.n_words",
    )


def _short(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    """Places of templates shorter than a shingle, word by word."""
    low, none = F.lower("text"), F.array().cast("array<struct<license_id:string,p:int,n:int>>")
    hold, found = [], []
    for license_id, text in templates:
        own = re.findall(WORD_ASCII, text.lower())
        all_in = reduce(and_, [F.contains(low, F.lit(w)) for w in own])
        hold.append(all_in)
        at = F.filter(
            F.sequence(F.lit(0), F.greatest(F.size("words") - len(own), F.lit(0))),
            lambda i: reduce(and_, [F.get("words", i + k) == F.lit(w) for k, w in enumerate(own)]),
        )
        place = F.transform(at, lambda p: F.struct(F.lit(license_id).alias("license_id"), p.alias("p"), F.lit(len(own)).alias("n")))
        found.append(F.when(all_in, F.slice(place, 1, 1)).otherwise(none))
    rows = docs.filter(reduce(or_, hold)).select("doc_id", "text", _words(F.col("text")).alias("words"))
    return rows.select("doc_id", F.inline(F.concat(*found))).select(
        "doc_id", "license_id", F.lit(1.0).alias("containment"), F.col("p").cast("long").alias("first_word"),
        F.col("n").cast("long").alias("n_words"),
    )


def _scan(docs: DataFrame, templates: Sequence[tuple[str, str]]) -> DataFrame:
    index = _index(docs, templates)
    listed = index.select("size", "band", "key").distinct().collect()  # bounded by PART
    known: dict[tuple[int, int], list[int]] = {}
    for size, band, key in listed:
        known.setdefault((size, band), []).append(key)
    sizes = sorted({size for size, _ in known})
    shingled = docs.select("doc_id", _words(F.col("text")).alias("words")).withColumn(
        "shingles", _shingles(F.col("words"))
    )
    # Few documents hold a known minhash; only these are searched for its places.
    none = F.array().cast("array<struct<size: int, band: int, key: bigint, p: int>>")
    found = []
    for size in sizes:
        bands = {band: known[size, band] for band in range(BANDS)}
        some = [
            F.arrays_overlap(f"m{size}_{band}", F.array(*[F.lit(k) for k in keys]))
            for band, keys in bands.items()
        ]
        places = F.concat(*[_places(size, band, keys) for band, keys in bands.items()])
        found.append(F.when(reduce(or_, some), places).otherwise(none))
    # The outer form keeps Spark from testing the array's size in a filter of its own, which would
    # compute all of it twice.
    rows = (
        _with_minhashes(shingled, sizes)
        .select("doc_id", "words", F.concat(*found).alias("hits"))
        .select("doc_id", "words", F.explode_outer("hits").alias("hit"))
        .filter("hit IS NOT NULL")
        .select("doc_id", "words", "hit.*")
    )
    first = F.col("p") - F.col("at")
    placed = rows.join(F.broadcast(index), ["size", "band", "key"]).select(
        "doc_id", "license_id", "texts", F.greatest(first, F.lit(0)).alias("first_word"),
        F.slice("words", F.greatest(first, F.lit(0)) + 1, F.col("n") + SHINGLE - 1 + F.least(first, F.lit(0))).alias("region"),
    )
    last = F.size("region") - SHINGLE
    own = F.transform(
        F.when(last >= 0, F.sequence(F.lit(1), last + 1)),
        lambda i: F.array_join(F.slice("region", i, SHINGLE), " "),
    )
    share = F.size(F.array_intersect("texts", own)) / F.size("texts")
    return placed.select(
        "doc_id", "license_id", share.alias("containment"),
        F.col("first_word").cast("long").alias("first_word"), F.size("region").cast("long").alias("n_words"),
    ).filter(F.col("containment") >= CONTAINMENT)
