"""License texts inside documents.

Texts and templates are lower-cased and cut into words of letters and digits; a shingle is five words. Windows of four
shingles, one at every second word, get `BANDS` MinHash values; each is a band of its own. The templates' windows, at
every word, have theirs in a table whose size is that of the template list. Windows that share a band with a template
make the document a candidate for it; the exact share of the template's shingles that the text contains decides.

A template of up to four shingles is contained only if all of them are; its first shingle's hash is looked up among all
shingles of the texts by the same join, so none is missed. A text that contains five or more neighbouring shingles of a
template has a window that equals one of the template's, which meets in every band. What can be missed is a text that has
only shorter pieces of a template. Only SQL functions are used; a
text meets no other text, and the rows that are shuffled are candidates.

Cases: a null text has no words; texts of fewer than five words match nothing; repeated rows are judged one by one; rows
that share a doc_id share candidates, and the exact check is on each row's own text; extra columns are ignored; an empty
table gives an empty result.
"""

from __future__ import annotations

import importlib.resources
import json
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plantlens.functions.lineage import stored
from plantlens.llm.sized import small_or_shuffled
from plantlens.llm.words import let, text_of

SHINGLE = 5
WINDOW = 4
BANDS = 8
# The band of single shingles; templates of up to SHORT shingles are contained only as a whole and have one row there.
EXACT = BANDS
SHORT = 4
LEAST_CONTAINED = 0.8


@dataclass(frozen=True)
class Template:
    name: str
    family: str
    text: str


# Public license notices and the openings of license texts; further notices and whole texts are in the file.
TEMPLATES = [
    Template("apache-2.0", "permissive", "Licensed under the Apache License, Version 2.0"),
    Template("apache-2.0-header", "permissive",
             "you may not use this file except in compliance with the License. You may obtain a copy of the License at "
             "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software "
             "distributed under the License is distributed on an \"AS IS\" BASIS"),
    Template("mit", "permissive", "Released under the MIT License"),
    Template("mit-grant", "permissive",
             "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
             "documentation files, to deal in the Software without restriction"),
    Template("bsd", "permissive",
             "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
             "the following conditions are met"),
    Template("gpl-3.0", "copyleft", "This work is licensed under the GNU General Public License, version 3"),
    Template("gpl-header", "copyleft",
             "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
             "Public License as published by the Free Software Foundation"),
    Template("mpl-2.0", "copyleft", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    Template("cc-by-4.0", "permissive", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    Template("cc-by-nc-4.0", "noncommercial", "Licensed under CC BY-NC 4.0"),
]
TEMPLATES += [Template(**t) for t in json.loads(importlib.resources.files("plantlens.llm").joinpath("license_templates.json").read_text("utf-8"))]


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+"), lambda w: w != "")


def _shingles(words: Column) -> Column:
    """Distinct shingles as text. The words are worked out once, not for each shingle."""
    def joined(w: Column) -> Column:
        places = F.sequence(F.lit(1), F.size(w) - SHINGLE + 1)
        return F.when(F.size(w) >= SHINGLE, F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice(w, i, SHINGLE), " "))))
    return let(words, joined)


def _bands(df: DataFrame, every: int) -> DataFrame:
    """A row for each band of each window of `words`, and one with the band EXACT for each of its first two shingles, which
    with a window at every second word are all shingles; the other columns are kept."""
    last = SHINGLE + WINDOW - 1
    fields = ",".join(f"w{k}:bigint" for k in range(last))
    aside = let(F.transform("words", lambda w: F.xxhash64(w)), lambda h: F.arrays_zip(
        *[F.slice(h, k + 1, F.greatest(F.size(h), F.lit(1))) for k in range(last)]).cast(f"array<struct<{fields}>>"))
    rest = [c for c in df.columns if c != "words"]
    each = df.select(*rest, F.posexplode(aside).alias("at", "w")).where((F.col("at") % every == 0) & F.col(f"w.w{SHINGLE - 1}").isNotNull())
    hashes = [F.when(F.col(f"w.w{k + SHINGLE - 1}").isNotNull(), F.xxhash64(*[F.col(f"w.w{k + j}") for j in range(SHINGLE)])) for k in range(WINDOW)]
    each = each.select(*rest, *[h.alias(f"h{k}") for k, h in enumerate(hashes)])

    # the band is a column and not eight expressions: a method that grows too long is never compiled by the JVM
    banded = each.withColumn("band", F.explode(F.array(*[F.lit(b) for b in range(EXACT + 2)])))
    value = F.least(*[F.when(F.col(f"h{k}").isNotNull(), F.xxhash64("band", f"h{k}")) for k in range(WINDOW)])
    value = F.when(F.col("band") < EXACT, value).when(F.col("band") == EXACT, F.col("h0")).otherwise(F.col("h1"))
    return banded.select(*rest, F.least("band", F.lit(EXACT)).alias("band"), value.alias("value"))


def template_table(spark: SparkSession, templates: list[Template]) -> tuple[DataFrame, DataFrame]:
    """band, value and name of all windows of the templates; and name, family and shingles of each. Both are bounded by the list."""
    rows = spark.createDataFrame([(t.name, t.family, t.text) for t in templates], "name string, family string, text string")
    rows = rows.select("name", "family", _words(F.col("text")).alias("words"))
    windows = _bands(rows.select("name", "words"), 1).where(F.col("band") < EXACT).distinct()
    short = rows.where(F.size("words").between(SHINGLE, SHINGLE + SHORT - 1)).select(
        F.lit(EXACT).alias("band"), F.xxhash64(*[F.xxhash64(F.get("words", F.lit(k))) for k in range(SHINGLE)]).alias("value"), "name")
    return (stored(windows.select("band", "value", "name").union(short), "template-bands"),
            stored(rows.select("name", "family", _shingles(F.col("words")).alias("wanted")).where("wanted IS NOT NULL"), "templates"))


def scan(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """One row per document: doc_id, n_licenses, licenses (names in order, comma-joined), families and best_contained."""
    docs = docs.select("doc_id", "text")
    bands, wanted = template_table(docs.sparkSession, templates or TEMPLATES)
    met = _bands(docs.select("doc_id", _words(text_of()).alias("words")), 2).join(small_or_shuffled(bands), ["band", "value"])
    candidates = stored(met.groupBy("doc_id").agg(F.collect_set("name").alias("candidates")), "candidates")
    listed = small_or_shuffled(candidates.withColumnRenamed("doc_id", "of_doc"))
    same = F.col("doc_id").eqNullSafe(F.col("of_doc"))

    # a row's number stands for it, since doc_id may repeat; it is stored with the row
    judged = stored(docs.join(listed, same).select("doc_id", "text", "candidates").withColumn("row", F.monotonically_increasing_id()), "judged")
    each = judged.select("row", _shingles(_words(text_of())).alias("own"), F.explode("candidates").alias("name"))
    shares = each.join(small_or_shuffled(wanted), "name").select(
        "row", "name", "family", (F.size(F.array_intersect("wanted", "own")) / F.size("wanted")).alias("share"))
    found = stored(shares.where(F.col("share") >= LEAST_CONTAINED).groupBy("row").agg(
        F.array_sort(F.collect_list("name")).alias("names"), F.array_sort(F.collect_set("family")).alias("kinds"), F.max("share").alias("best")), "found")
    with_some = judged.select("doc_id", "row").join(small_or_shuffled(found), "row", "left").select("doc_id", "names", "kinds", "best")
    without = docs.join(listed, same, "left_anti").select("doc_id", *[F.lit(None).cast(found.schema[c].dataType).alias(c) for c in ("names", "kinds", "best")])
    return with_some.union(without).select(
        "doc_id", F.when(F.col("names").isNull(), 0).otherwise(F.size("names")).cast("long").alias("n_licenses"),
        F.coalesce(F.array_join("names", ","), F.lit("")).alias("licenses"),
        F.coalesce(F.array_join("kinds", ","), F.lit("")).alias("families"), F.col("best").alias("best_contained"))
