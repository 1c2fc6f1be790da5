"""License templates in texts: MinHash bands over overlapping windows, then exact containment. DataFrame functions only.

A template of m shingles is looked for in windows of m + s - 1 shingles that start at every s-th word, s = m / 4, so
every stretch of m shingles lies in a window. A window that holds the share c of a template has a similarity of at
least c / (1.25 + 1 - c), 0.55 for c = 0.8. Of ``BANDS`` one-row bands one collides with probability
1 - 0.45 ^ BANDS, above 1 - 1e-8 for 24.

The least value of a band is that of one of the template's shingles. So a window can collide only if it holds such a
shingle, and only windows around those are signed; the signatures of all others need not be computed to know that
they do not collide.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from changeguard.llm.common import row_key

BANDS = 24
CONTAINMENT = 0.8
SHINGLE = 5
#: Shingles of all templates together; the templates are broadcast.
MOST_SHINGLES = 200_000

# Notices as their licenses ask for them.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0-header", "You may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. "
     "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License."),
    ("mit-permission", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), "
     "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, "
     "and/or sell copies of the Software"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
     "provided that the above copyright notice and this permission notice appear in all copies."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-header", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
     "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. "
     "If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)

#: What separates words: runs of ASCII characters that are no letters or digits.
SEPARATORS = r"[\x00-/:-@\[-`{-\x7f]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), SEPARATORS), "")


def shingles(words_column: str, size: int) -> Column:
    """Hashes of all runs of ``size`` words, in order; none if there are fewer words."""
    rest = "".join(f", get(`{words_column}`, i + {k})" for k in range(1, size))
    return F.expr(f"transform(slice(`{words_column}`, 1, greatest(size(`{words_column}`) - {size - 1}, 0)), (x, i) -> xxhash64(x{rest}))")


def _mask(band: int) -> int:
    """A fixed number per band: ordering shingle hashes xor it is one random order."""
    x = (band + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1
    x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & (1 << 64) - 1
    x ^= x >> 27
    return x - (1 << 64) if x >> 63 else x


def _prepared(spark, templates: Iterable[tuple[str, str]]) -> list[dict]:
    """license, size of its shingles, and the distinct shingles of every template with a word."""
    rows = spark.createDataFrame(list(templates), "license string, body string").withColumn("w", words(F.col("body"))).filter("size(w) > 0")
    picked = F.coalesce(*[F.when(F.least(F.size("w"), F.lit(SHINGLE)) == n, shingles("w", n)) for n in range(1, SHINGLE + 1)])
    found = rows.select("license", F.least(F.size("w"), F.lit(SHINGLE)).alias("size"), F.array_distinct(picked).alias("shingles")).collect()
    if sum(len(r["shingles"]) for r in found) > MOST_SHINGLES:
        raise ValueError("too many templates for one scan: scan in several runs")
    return [r.asDict() for r in found]


def _bands(spark, prepared: list[dict]) -> DataFrame:
    """A row for each template, band and least shingle; bounded by MOST_SHINGLES and BANDS."""
    rows = []
    for t in prepared:
        m = len(t["shingles"])
        step = max(1, m // 4)
        for band in range(BANDS):
            mask = _mask(band)
            rows.append((t["license"], t["size"], min(t["shingles"], key=lambda h: h ^ mask), mask, m, step, m + step - 1, t["shingles"]))
    return spark.createDataFrame(rows, "license string, q int, least bigint, mask bigint, m int, step int, length int, template array<bigint>")


def scan(df: DataFrame, doc_id: str = "doc_id", text: str = "text", templates: Iterable[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT) -> DataFrame:
    """One row per document and license that it holds: the id, ``license``, ``n_shared`` and ``n_shingles`` of the
    best window, ``first_word`` (where the first window above the limit begins), ``n_windows`` above the limit.

    Words are compared without case and punctuation, by runs of five; a shorter template is one run. NULL and empty
    texts hold nothing, a template without words is in nothing; repeated rows are found once; no rows give no rows.
    """
    spark = df.sparkSession
    prepared = _prepared(spark, templates)
    if not prepared:
        raise ValueError("no template has a word")
    bands = _bands(spark, prepared)
    sizes = sorted({t["size"] for t in prepared})
    least = {q: sorted({min(t["shingles"], key=lambda h, m=_mask(b): h ^ m) for t in prepared if t["size"] == q for b in range(BANDS)}) for q in sizes}
    longest = {q: max(len(t["shingles"]) + max(1, len(t["shingles"]) // 4) - 1 for t in prepared if t["size"] == q) for q in sizes}
    listed = df.select(row_key(doc_id, text).alias("__key"), F.col(doc_id).alias("__id"), words(F.col(text)).alias("__w"))
    hashed = listed.select("__key", "__id", *(shingles("__w", q).alias(f"__s{q}") for q in sizes))
    found = [f"""filter(transform(__s{q}, (x, i) -> if(array_contains({_literal(least[q])}, x), struct({q} as q, x as least, i as i,
        greatest(i - {longest[q] - 1}, 0) as base, slice(__s{q}, greatest(i - {longest[q] - 1}, 0) + 1, {2 * longest[q] - 1}) as near), null)), x -> x is not null)""" for q in sizes]
    any_least = " or ".join(f"arrays_overlap(__s{q}, {_literal(least[q])})" for q in sizes)
    hits = hashed.select("__key", "__id", F.expr(f"if({any_least}, concat({', '.join(found)}), null)").alias("__hits"))
    # The outer form, for a filter on the hits would be moved below the hashing and hash anew for every word.
    hits = hits.select("__key", "__id", F.inline_outer("__hits")).filter("least is not null")
    met = hits.join(F.broadcast(bands), ["q", "least"])
    starts = F.expr("sequence(cast(ceil(greatest(i - length + 1, 0) / step) * step as int), cast(floor(i / step) * step as int), step)")
    framed = met.filter("ceil(greatest(i - length + 1, 0) / step) <= floor(i / step)").withColumn("a", F.explode(starts))
    signed = framed.withColumn("window", F.expr("slice(near, a - base + 1, length)")).filter(F.expr("array_min(transform(window, x -> x ^ mask)) = (least ^ mask)"))
    shared = signed.withColumn("n", F.size(F.array_intersect("template", "window"))).filter(F.col("n") >= F.lit(containment) * F.col("m"))
    return shared.groupBy("__key", "license").agg(
        F.any_value("__id").alias(doc_id), F.max("n").alias("n_shared"), F.any_value("m").alias("n_shingles"),
        F.min("a").alias("first_word"), F.size(F.collect_set("a")).alias("n_windows")).select(doc_id, "license", "n_shared", "n_shingles", "first_word", "n_windows")


def _literal(numbers: list[int]) -> str:
    return f"array({', '.join(f'{n}L' if n > -(1 << 63) else 'cast(-9223372036854775808 as bigint)' for n in numbers)})"
