"""Operator 6: license scan, with DataFrame functions only.

A text's words (lower case, letters and digits) give shingles of three. For each
class of templates (up to 1, 2, 4, ... shingles) windows of 2 * half - 1 shingles
start at every multiple of half, so any passage of a template's length lies whole
in one window. BANDS bands of one MinHash row each retrieve the templates of a
window. A template that lies in a window of its class fills over a quarter of it,
so a match is missed with probability under 0.75 ** BANDS (1 %). Then the exact
share of the template's shingles in the window decides; of the versions of one
license in overlapping windows, that of the greatest share counts. A band can agree only in
a window that holds the template's least shingle of that band, so bands are
worked out for such windows alone.

Defined cases: null and empty texts match nothing; repeated rows give repeated
findings per doc_id only once (counts add up); an empty table gives no rows.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

BANDS, CONTAINED, SHINGLE = 16, 0.9, 3

#: License statements, grants and disclaimers in their usual wording, by version.
TEMPLATES = {
    "agpl-3.0": "This work is licensed under the GNU Affero General Public License, version 3.",
    "agpl-header": "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": "You may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-4.0": "Licensed under CC BY 4.0.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0.",
    "cc0-1.0": "dedicated all copyright and related and neighboring rights to this software to the public domain worldwide",
    "gpl-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-header": "it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "lgpl-2.1": "This work is licensed under the GNU Lesser General Public License, version 2.1.",
    "lgpl-3.0": "This work is licensed under the GNU Lesser General Public License, version 3.",
    "lgpl-header": "it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "mit": "Released under the MIT License.",
    "mit-disclaimer": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}
#: Templates whose names begin alike are versions of one license; of those found in overlapping windows the best counts.
_FAMILY = "^[al]?(gpl|cc|apache|mit|bsd|mpl)"


def _seeds(bands: int) -> list[int]:
    """A 64-bit mask per band, from a linear congruential sequence."""
    out, x = [], 88172645463325252
    for _ in range(bands):
        x = (x * 6364136223846793005 + 1442695040888963407) % 2**64
        out.append(x - 2**64 if x >= 2**63 else x)
    return out


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), "[^\\p{L}\\p{N}]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Hashes of runs of SHINGLE words."""
    starts = F.sequence(F.lit(0), F.greatest(F.size(words) - SHINGLE, F.lit(0)))
    runs = F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + d) for d in range(SHINGLE)]))
    return F.when(F.size(words) >= SHINGLE, runs).otherwise(F.array().cast("array<bigint>"))


def _template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    rows = spark.createDataFrame(sorted(templates.items()), "template string, body string")
    return rows.withColumn("_t", F.array_distinct(_shingles(tokens(F.col("body")))))


def _class(n_shingles: int) -> int:
    """Half the window, in shingles, for a template of n_shingles: the next power of two."""
    half = 1
    while half < n_shingles:
        half *= 2
    return half


def _permuted(mask: int):
    return lambda x: x.bitwiseXOR(F.lit(mask))


def _bands(shingles: Column, seeds: list[int]) -> list[Column]:
    return [F.array_min(F.transform(shingles, _permuted(mask))) for mask in seeds]


def _windows(shingles: Column, at: Column, half: int, seeds: list[int], wanted: list[Column]) -> Column:
    """The windows of a class over the positions `at` (from 0) that some band retrieves.

    Windows start at multiples of half, so those over i start in its block or the block before.
    """
    block = F.transform(at, lambda i: i.bitwiseAND(-half))
    starts = F.array_distinct(F.concat(block, F.filter(F.transform(block, lambda b: b - half), lambda b: b >= 0)))
    windows = F.transform(starts, lambda i: F.struct(F.lit(half).alias("w"), (i + 1).alias("i"), F.slice(shingles, i + 1, 2 * half - 1).alias("s")))
    return F.filter(windows, lambda w: functools.reduce(Column.__or__, [F.array_contains(values, band) for values, band in zip(wanted, _bands(w["s"], seeds), strict=True)]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, bands: int = BANDS, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, text) -> doc_id, template, n_windows, first_word, containment (best), for each template found.

    Only windows that some band retrieves leave the projection; they meet the
    templates (at most as many rows as there are templates, so they are broadcast)
    on equal band values. Nothing is shuffled but the few findings.
    """
    spark, seeds = docs.sparkSession, _seeds(bands)
    known = _template_table(spark, templates)

    known = known.withColumn("_bands", F.array(*_bands(F.col("_t"), seeds))).select("template", "_t", "_bands").collect()  # one row per template
    by_class: dict[int, list] = {}
    for row in known:
        by_class.setdefault(_class(len(row["_t"])), []).append(row)
    wanted = {half: [F.array(*[F.lit(v) for v in sorted({r["_bands"][j] for r in rows})]) for j in range(bands)] for half, rows in sorted(by_class.items())}
    # a band agrees only where the window holds the template's shingle that is least in that band's order
    least = F.array(*[F.lit(v) for v in sorted({v ^ mask for r in known for v, mask in zip(r["_bands"], seeds, strict=True)})])

    def retrieved(s: Column) -> Column:
        at = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: F.array_contains(least, F.get(s, i)))
        return common.bind(at, lambda hits: F.concat(*[_windows(s, hits, half, seeds, values) for half, values in wanted.items()]))

    found = common.bind(tokens(F.col("text")), lambda words: common.bind(_shingles(words), lambda s: F.when(F.arrays_overlap(s, least), retrieved(s))))
    windows = docs.select("doc_id", F.xxhash64("text").alias("_text"), F.explode(found).alias("_w")).select("doc_id", "_text", F.col("_w.w").alias("_half"), F.col("_w.i").alias("_at"), F.col("_w.s").alias("_s"))
    keys = spark.createDataFrame(
        [(r["template"], list(r["_t"]), half, j, v) for half, rows in by_class.items() for r in rows for j, v in enumerate(r["_bands"])],
        "template string, _t array<bigint>, _half int, _band int, _value long",
    )
    found = windows.select("*", F.posexplode(F.array(*_bands(F.col("_s"), seeds))).alias("_band", "_value")).join(F.broadcast(keys), ["_half", "_band", "_value"])
    share = F.size(F.array_intersect("_t", "_s")) / F.size("_t")
    found = found.select("doc_id", "template", "_text", "_half", "_at", share.alias("_share")).filter(F.col("_share") >= contained)
    family = F.regexp_extract("template", _FAMILY, 1)
    block = ((F.col("_at") - 1) / F.col("_half")).cast("int")
    beside = Window.partitionBy("doc_id", "_text", "_half", F.when(family == "", F.col("template")).otherwise(family)).orderBy(block).rangeBetween(-1, 1)
    best = F.max("_share").over(beside)
    found = found.withColumn("_best", best).filter(F.col("_share") == F.col("_best"))
    out = found.groupBy("doc_id", "template").agg(F.countDistinct("_at").alias("n_windows"), F.min("_at").cast("long").alias("first_word"), F.max("_share").alias("containment"))
    return out.select("doc_id", "template", F.col("n_windows").cast("long"), "first_word", "containment")


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents").select("doc_id", "text"))
