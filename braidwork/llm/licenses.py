"""License scan: MinHash bands over overlapping text windows, then exact shingle containment; DataFrame expressions only.

A window is ``WINDOW`` words, one begins every ``STRIDE``. Of its word trigrams each of ``BANDS`` hash functions
keeps the smallest; a band is one such value (bands of one row), so a window that shares a share j of the trigrams
of it and of a window of a template meets it in a band with probability 1 - (1 - j) ** BANDS: 0.9998 at j = 0.4.
Templates have a window at each word. A text that shares no trigram with any template can't meet one and is left
out before. What the bands retrieve is verified: the share of the template's trigrams that the text contains.

Defined results: null and empty texts, and texts shorter than a trigram, match nothing; a text matches each
template it contains; repeated rows match alike, each; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, paired

SHINGLE, WINDOW, STRIDE, BANDS = 3, 8, 4, 16
CONTAINED = 0.8
#: Words of templates whose bands are broadcast; longer lists are joined by a shuffle.
BROADCAST_WORDS = 100_000
#: Notices and openings of licenses, by SPDX name.
TEMPLATES = {
    "MIT": (
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    ),
    "GPL-3.0": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    ),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    "BSD-3-Clause": ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",),
}


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^a-z0-9\u0080-￿]+"), "")


def with_shingles(df: DataFrame, text: str) -> DataFrame:
    """Adds shingles: hashes of the trigrams, in order; fewer words than three have none."""
    n = F.greatest(F.size("_h") - 2, F.lit(0))
    return (
        df.withColumn("_h", F.transform(words(F.coalesce(F.col(text), F.lit(""))), lambda w: F.xxhash64(w)))
        .withColumn("shingles", F.zip_with(F.slice(paired(F.col("_h"), 1), 1, n), F.slice("_h", 3, n), lambda a, b: F.xxhash64(a, b)))
        .drop("_h")
    )


def banded(df: DataFrame, *keys: str, stride: int) -> DataFrame:
    """(keys, band, value) of all windows of the shingles."""
    width = WINDOW - SHINGLE + 1
    begin = F.explode(F.sequence(F.lit(1), F.greatest(F.size("shingles") - width + stride, F.lit(1)), F.lit(stride)))
    windows = df.where(F.size("shingles") > 0).select(*keys, "shingles", begin.alias("i")).select(*keys, F.slice("shingles", F.col("i"), width).alias("w"))
    values = F.array(*[F.array_min(F.transform("w", _hasher(b))) for b in range(BANDS)])
    return windows.select(*keys, F.posexplode(values).alias("band", "value"))


def _hasher(band: int):  # noqa: ANN202
    return lambda x: F.xxhash64(x, F.lit(band))


def template_rows(spark: SparkSession, templates: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    rows = [(name, i, text) for name, texts in (TEMPLATES if templates is None else templates).items() for i, text in enumerate(texts)]
    return with_shingles(spark.createDataFrame(rows, "license string, variant int, text string"), "text").drop("text").withColumn("shingles", F.array_distinct("shingles"))


def scan(docs: DataFrame, templates: dict[str, tuple[str, ...]] | None = None, contained: float = CONTAINED) -> DataFrame:
    """(doc_id, license, containment) for each license one of whose variants a row of ``docs`` (doc_id, text) contains."""
    spark = docs.sparkSession
    given = TEMPLATES if templates is None else templates
    n_words = sum(len(t.split()) for texts in given.values() for t in texts)
    small = (lambda df: F.broadcast(df)) if n_words <= BROADCAST_WORDS else (lambda df: df)
    rows = template_rows(spark, given)
    texts = with_shingles(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), "text").select("doc_id", "shingles")
    if n_words <= BROADCAST_WORDS:
        known = [r["s"] for r in rows.select(F.explode("shingles").alias("s")).distinct().collect()]
        texts = texts.withColumn("shares", F.explode(F.array(F.arrays_overlap("shingles", F.lit(known))))).where("shares").drop("shares")
    near = cut(texts.withColumn("row", F.monotonically_increasing_id()))
    bands = banded(rows, "license", "variant", stride=1).distinct()
    met = banded(near, "row", stride=STRIDE).join(small(bands), ["band", "value"]).select("row", "license", "variant").distinct()
    share = F.size(F.array_intersect(F.col("t.shingles"), F.col("d.shingles"))) / F.size("t.shingles")
    return (
        met.alias("m")
        .join(near.alias("d"), "row")
        .join(small(rows).alias("t"), ["license", "variant"])
        .select("row", "doc_id", "license", share.alias("containment"))
        .where(F.col("containment") >= contained)
        .groupBy("row", "doc_id", "license")
        .agg(F.max("containment").alias("containment"))
        .drop("row")
    )
