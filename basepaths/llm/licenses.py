"""License scans with MinHash bands over overlapping windows, in DataFrame functions only.

Texts become words, words five-word shingles. A template of m shingles is looked for in windows of
m + ceil(m / 4) shingles whose starts are ceil(m / 4) + 1 apart, so that every place where
the template can stand lies whole in a window. A window and a template are a candidate if one of their MinHash bands agrees.
Templates of ``LONG`` shingles or more have ``BANDS`` bands of ``ROWS`` values: at the least containment of 0.8 their Jaccard
similarity is about 0.8 / (1.25 + 0.2) = 0.55 or more, so a band agrees with probability 0.30 and
one of 24 with 0.9998; a whole copy (about 0.8) is missed with probability under 1e-10. Shorter templates, as all registered ones
are, have the same 48 values in bands of one: their similarity is 0.5 or more, so a place is missed with probability under 1e-14.
Candidates are verified by the exact containment of the template's shingles in the window.

A band can only agree where window and template share a shingle. So MinHash values are
computed for the windows that hold a template shingle at all, which changes no result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
BANDS, ROWS = 24, 2
CONTAINMENT = 0.8
LONG = 32
MOST_WORDS = 200_000

# Short forms of license notices as they are customarily written.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-notice": "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0-terms": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "gpl-terms": "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "rights-reserved": "No part of this text may be reproduced without permission. All rights reserved.",
}


def shingle_hashes(text: Column) -> Column:
    """Hashes of the five-word shingles; texts of fewer words have none."""
    words = F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _joined(hashes: Column) -> Column:
    last = F.size(hashes) - SHINGLE
    whole = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(SHINGLE)]))
    return F.when(last >= 0, whole).otherwise(F.array().cast("array<bigint>"))


def bands(shingles: Column, rows: int = ROWS) -> Column:
    """(band, value) of the MinHash signature of an array of shingles, ``rows`` of its values to a band."""
    least = lambda k: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, F.lit(k))))
    return F.array(*[
        F.struct(F.lit(b).alias("band"), F.xxhash64(*[least(b * rows + r) for r in range(rows)]).alias("value")) for b in range(BANDS * ROWS // rows)
    ])


def _signed(shingles: str) -> Column:
    return F.explode(F.when(F.col("long"), bands(F.col(shingles))).otherwise(bands(F.col(shingles), 1)))


def template_table(spark, templates: dict[str, str]) -> DataFrame:
    """(template, shingles, m, step, span) of the templates; each needs five words."""
    if sum(len(t.split()) for t in templates.values()) > MOST_WORDS:
        raise ValueError("the templates are broadcast, so their words are limited")
    listed = F.array(*[F.struct(F.lit(name).alias("template"), F.lit(text).alias("text")) for name, text in templates.items()])
    rows = spark.range(1).select(F.explode(listed).alias("x")).select("x.template", "x.text")
    hashed = rows.withColumn("words", shingle_hashes(F.col("text"))).withColumn("shingles", F.array_distinct(_joined(F.col("words"))))
    step = F.ceil(F.col("m") / F.lit(4)).cast("int") + 1
    return hashed.withColumn("m", F.size(F.col("words")) - (SHINGLE - 1)).withColumn("step", step).select(
        "template", "shingles", "m", "step", (F.col("m") + F.col("step") - 1).alias("span")
    )


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = CONTAINMENT) -> DataFrame:
    """(doc_id, template, containment, first_word) for every document and template found in it.

    ``containment`` is the best over the windows, ``first_word`` the place (from 0) of the first
    window that has it. Null, empty and short texts match nothing; rows with the same id, null
    included, are reported together; other columns are not looked at.
    """
    templates = TEMPLATES if templates is None else templates
    if any(len(t.split()) < SHINGLE for t in templates.values()):
        raise ValueError(f"a template needs {SHINGLE} words")
    known = template_table(docs.sparkSession, templates)
    hashes = [h for r in known.select("shingles").collect() for h in r["shingles"]]
    wanted = F.array(*[F.lit(h) for h in sorted(set(hashes))])
    # one value per text: the optimizer copies no part of it into the conditions below
    sh = F.transform(F.array(shingle_hashes(F.col("text"))), _joined)
    rows = docs.select("doc_id", F.explode(sh).alias("sh")).where(F.arrays_overlap("sh", wanted))
    hits = rows.select("doc_id", "sh", F.explode(
        F.filter(F.transform("sh", lambda h, i: F.struct(h.alias("h"), i.alias("i"))), lambda x: F.array_contains(wanted, x["h"]))
    ).alias("hit"))
    known = known.withColumn("long", F.col("m") >= LONG)
    owners = known.select("long", "step", "span", F.explode("shingles").alias("t"))
    met = hits.join(F.broadcast(owners), F.col("hit.h") == F.col("t"))
    first = F.greatest(F.lit(0), F.ceil((F.col("hit.i") - F.col("span") + 1) / F.col("step")).cast("int"))
    window = met.select(
        "doc_id", "sh", "long", "step", "span", F.explode(F.sequence(first, F.floor(F.col("hit.i") / F.col("step")).cast("int"))).alias("w")
    ).select("doc_id", F.slice("sh", F.col("w") * F.col("step") + 1, F.col("span")).alias("sh"), "long", (F.col("w") * F.col("step")).alias("at"), "span").distinct()
    signed = window.withColumn("b", _signed("sh")).select("doc_id", "sh", "at", "span", "long", "b.band", "b.value")
    index = known.withColumn("b", _signed("shingles")).select(
        "template", "shingles", F.col("span").alias("ts"), F.col("long").alias("tl"), F.col("b.band").alias("tb"), F.col("b.value").alias("tv")
    )
    agreed = (F.col("band") == F.col("tb")) & (F.col("value") == F.col("tv")) & (F.col("span") == F.col("ts")) & (F.col("long") == F.col("tl"))
    candidates = signed.join(F.broadcast(index), agreed).select("doc_id", "template", "at", "sh", "shingles").distinct()
    share = F.size(F.array_intersect("shingles", "sh")) / F.size("shingles")
    pairs = candidates.select("doc_id", "template", share.alias("containment"), "at")
    pairs = pairs.where(F.col("containment") >= least)
    best = pairs.groupBy("doc_id", "template").agg(F.min(F.struct((-F.col("containment")).alias("c"), "at")).alias("best"))
    return best.select("doc_id", "template", (-F.col("best.c")).alias("containment"), F.col("best.at").alias("first_word"))
