"""License scans, in DataFrame and SQL expressions only.

Texts and templates are cut into word shingles. Windows of doubling sizes overlap by half; a template belongs to the smallest size of which it fills at most
half, so a copy of it lies whole in some window and is more than a quarter of that window's shingles. A window's MinHash components, one a band, retrieve the
templates that share one; exact containment of the template's shingles in the window then decides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

SHINGLE = 3
#: A template alone in its window shares a component with probability over 1/4 each, so all of these bands miss it with probability under 0.75 ** 32 = 0.0001.
BANDS = 32
#: Half of the smallest window.
STEP = 4
CONTAINMENT = 0.8

# Notices by which texts state their license.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "MIT": ["Released under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "LGPL-3.0": ["This work is licensed under the GNU Lesser General Public License, version 3."],
    "BSD-3-Clause": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0."],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC0-1.0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."],
}

#: Words here are runs of letters and digits, A-Z folded, so that line ends, comment marks and quotes don't matter.
_WORDS = r"filter(split(translate({text}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-/:-`{{-\\x7f]+'), w -> w != '')"


def shingled(df: DataFrame, text: str, k: int) -> DataFrame:
    """df with h: the fingerprints of its text's word shingles, in order."""
    words = _WORDS.format(text=f"coalesce(`{text}`, '')").replace("{{", "{")
    empty = f"case when size(w) >= {k} then {{}} else cast(array() as array<bigint>) end"
    made = f"transform(sequence(1, greatest(size(w) - {k - 1}, 1)), i -> xxhash64(concat_ws(' ', slice(w, i, {k}))))"
    return df.withColumn("w", F.expr(words)).withColumn("h", F.expr(empty.format(made))).drop("w")


def scale_of(n: int) -> int:
    """Size of the windows for a template of n shingles: at least twice as long, a power of two times STEP, two steps at least."""
    size = 2 * STEP
    while size < 2 * n:
        size *= 2
    return size


def _seeds() -> list[int]:
    """Multiples of the golden ratio modulo 2**64, as signed numbers."""
    return [(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1) - (1 << 63) for k in range(1, BANDS + 1)]


def scan(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", templates: dict[str, list[str]] | None = None, shingle: int = SHINGLE, containment: float = CONTAINMENT) -> DataFrame:
    """doc_id, license, notice (which of the license's templates), containment, first_word (of the first shingle found, from 0), windows (how many hold it), one row for each row of docs and template found in it.

    Null and empty texts and texts under `shingle` words hold none. Rows that repeat are reported each. The templates are few and given as a parameter;
    those with under `shingle` words can't be found.
    """
    spark = docs.sparkSession
    flat = [(lic, i, t) for lic, ts in (templates or TEMPLATES).items() for i, t in enumerate(ts)]
    known = shingled(spark.createDataFrame(flat, "license string, notice int, text string"), "text", shingle).where("size(h) > 0").drop("text").withColumn("t", F.array_distinct("h"))
    rows = known.collect()  # the templates
    if not rows:
        return docs.select(F.col(doc_id).alias("doc_id")).where("false").selectExpr("doc_id", "'' as license", "0 as notice", "0d as containment", "0 as first_word", "0L as windows")
    # each template's smallest shingle under each band's order
    smallest = sorted({(min(r["h"], key=lambda x: x ^ s), s, scale_of(len(r["h"])), r["license"], r["notice"]) for r in rows for s in _seeds()})
    by_value = F.broadcast(spark.createDataFrame(smallest, "value long, seed long, scale int, license string, notice int"))
    full = F.broadcast(known.select("license", "notice", "t"))

    source = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    hashed = shingled(source, "text", shingle).drop("text")
    # A band of a window and of a template agree only if the template's smallest shingle is in the window: elsewhere no component needs to be computed.
    some = ", ".join(f"{v}L" for v in sorted({v[0] for v in smallest}))
    at = f"filter(transform(h, (x, i) -> if(x in ({some}), i, -1)), i -> i >= 0)"
    # the number of the row also keeps the optimizer from testing the places below, which would compute them twice
    placed = hashed.select("doc_id", F.monotonically_increasing_id().alias("row"), "h", F.expr(at).alias("places"))
    placed = placed.select("doc_id", "row", "h", F.explode("places").alias("place")).withColumn("value", F.expr("h[place]")).join(by_value, "value")
    # two windows hold a place: the one that begins at the half before it, and the one half a window earlier
    begin = F.expr("explode(filter(array(place - place % (scale div 2), place - place % (scale div 2) - scale div 2), b -> b >= 0))")
    banded = placed.select("doc_id", "row", "license", "notice", "scale", "value", "seed", "h", begin.alias("begin")).withColumn("window", F.expr("slice(h, begin + 1, scale)")).drop("h")
    found = banded.where("array_min(transform(window, x -> x ^ seed)) = (value ^ seed)").dropDuplicates(["row", "scale", "begin", "license", "notice"]).join(full, ["license", "notice"])
    found = found.withColumn("containment", F.expr("size(array_intersect(window, t)) / size(t)")).where(F.col("containment") >= containment)
    first = F.expr("begin + array_position(transform(window, x -> array_contains(t, x)), true) - 1").cast("int")
    return found.withColumn("first", first).groupBy("doc_id", "row", "license", "notice").agg(F.max("containment").alias("containment"), F.min("first").alias("first_word"), F.count("*").alias("windows")).drop("row")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.documents(spark, sf_dir))
