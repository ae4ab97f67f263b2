"""License scan: MinHash bands over overlapping text windows find templates, exact shingle containment verifies them.

Words are runs of letters and digits in lower case, dots inside numbers included; shingles are five words. Windows
hold two neighbouring shingles and start at every word; templates are cut the same way. A window's band is the least
of its two shingles under one of eight hash functions. Where a template's text occurs, a window of two of its
shingles equals the template's window and meets it in every band. A template of one shingle lies in two windows, and
one of the two has it as its least with probability 2/3 in each band, so it is missed with probability 3**-8 or
0.015 %. Whatever meets is verified: at least `containment` of the template's shingles must occur in the stretch of
text as long as the template allows around the meeting place.

Everything is DataFrame functions. Windows are dropped where they are made unless a band's value is a template's, and
only matches are shuffled; the texts of documents that a template met are read again to verify them.

Defined cases: a null text counts as empty; a text of fewer than five words has no shingle and no license; several
licenses give several rows; repeated rows give their rows once; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, staged, text_or_empty

SHINGLE, BANDS, CONTAINMENT = 5, 8, 0.8
#: Public license statements; fixed values.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


def shingled(rows: DataFrame, *keep: str) -> DataFrame:
    """The columns keep and s: hashes of all five-word shingles of column text, in order. The words are a column of
    their own, so that they are found once and not once for each shingle."""
    found = F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]++(?:\.(?=\p{N})\p{N}++)?+"), F.lit(0))
    words = rows.select(*keep, found.alias("words")).select(*keep, F.transform("words", lambda w: F.xxhash64(w)).alias("words"))
    at = F.sequence(F.lit(1), F.size("words") - (SHINGLE - 1))
    made = F.transform(at, lambda i: F.xxhash64(*[F.element_at("words", i + k) for k in range(SHINGLE)]))
    return words.select(*keep, F.when(F.size("words") >= SHINGLE, made).otherwise(F.array().cast("array<bigint>")).alias("s"))


def _windows() -> Column:
    """Windows of two neighbouring shingles of column s; the last shingle, with no neighbour, stands alone."""
    return F.zip_with("s", F.slice("s", 2, F.size("s")), lambda one, two: F.struct(one.alias("one"), F.coalesce(two, one).alias("two")))


def _bands() -> list[Column]:
    """The band values of a window (columns one and two): the shingle that is least under each hash function."""
    least = [F.xxhash64("one", F.lit(i)) <= F.xxhash64("two", F.lit(i)) for i in range(BANDS)]
    return [F.when(x, F.col("one")).otherwise(F.col("two")) for x in least]


def scan_licenses(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: Sequence[tuple[str, str]] = TEMPLATES, containment: float = CONTAINMENT
) -> DataFrame:
    """One row per document and license found: doc_id, license, at (first shingle's word, from 0), containment."""
    spark = docs.sparkSession
    known = spark.createDataFrame([(i, name, text) for i, (name, text) in enumerate(templates)], "template int, license string, text string")
    known = staged(shingled(known, "template", "license").where(F.size("s") > 0))
    listed = known.select("template", F.explode(_windows()).alias("w")).select("template", "w.one", "w.two")
    known = known.withColumnRenamed("s", "wanted")
    bands = listed.select("template", F.posexplode(F.array(*_bands())).alias("band", "least")).distinct()
    values: list[list[int]] = [[] for _ in range(BANDS)]
    for r in bands.select("band", "least").distinct().collect():  # as many as the templates have shingles, at most
        values[r["band"]].append(r["least"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    cut = shingled(rows, "doc_id").select("doc_id", F.explode(_windows()).alias("w")).select("doc_id", "w.one", "w.two")
    meets = F.lit(False)
    for band, own in zip(_bands(), values, strict=True):
        meets = meets | band.isin(own)
    cut = cut.where(meets).select("doc_id", F.posexplode(F.array(*_bands())).alias("band", "least"))
    met = staged(cut.join(F.broadcast(bands), ["band", "least"]).select("doc_id", "template").distinct())
    # the met (doc_id, template) pairs are narrow; a template's shingles come in by its number, never once a document
    found = met.groupBy("doc_id").agg(F.collect_set("template").alias("found"))
    few = met.count() <= BROADCAST_ROWS
    own = shingled(rows.join(F.broadcast(found) if few else found, "doc_id"), "doc_id", "found")
    own = own.select("doc_id", "s", F.explode("found").alias("template")).join(F.broadcast(known), "template")
    own = own.select("doc_id", "s", "license", "wanted", F.size("wanted").alias("n"))
    hits = F.filter(F.sequence(F.lit(0), F.size("s") - 1), lambda i: F.array_contains("wanted", F.get("s", i)))
    shares = F.transform(hits, lambda i: F.size(F.array_intersect(F.slice("s", F.greatest(i - F.col("n"), F.lit(0)) + 1, 2 * F.col("n") + 2), "wanted")))
    best = own.select("doc_id", "license", F.array_max(shares).alias("most"), F.array_min(hits).alias("at"), F.size(F.array_distinct("wanted")).alias("of"))
    best = best.withColumn("containment", F.col("most") / F.col("of")).where(F.col("containment") >= containment)
    return best.groupBy("doc_id", "license").agg(F.min("at").alias("at"), F.max("containment").alias("containment"))
