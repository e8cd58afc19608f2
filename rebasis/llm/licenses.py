"""License scans: TF-IDF cosine of lines to templates, then inheritance from the nearest directory.

Every line of every text is a possible header. Terms are runs of letters and digits in
lower case; weights are term count times ln((1 + documents) / (1 + documents with the term)) + 1,
counted over all documents. A line carries the license of the template with the highest cosine,
if that is ``threshold`` or more.

Few lines need a vector: a template's heaviest terms, down to where the rest is
shorter than the threshold, are its anchors, and a line without any anchor of a
template cannot reach the threshold with it. Lines are scored once per distinct wording.

A document is a license file if matched lines hold at least half of its terms. A document without a
license of its own takes that of the nearest license file above: its own directory, then
each ancestor, found by joining directory paths. Directories are joined once each, not once per document.

A null or empty text has no license of its own and may inherit one; a null path inherits none. Equal
cosines go to the first name. Rows of one path are one file. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rebasis.llm.common import small, stored

NOISE = r"[^\p{L}\p{N}]+"
THRESHOLD = 0.6
FILE_SHARE = 0.5

# License names and the standard wording of their notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Proprietary", "All rights reserved"),
]


def terms(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), NOISE), "")


def idf(df: Column, n: int) -> Column:
    return F.log(F.lit(1.0 + n) / (1 + df)) + 1


def sharded_path() -> Column:
    """A path for tables without one: source, a directory per digit of the id but its last, the id."""
    name = F.col("doc_id").cast("string")
    return F.concat("source", F.lit("/"), F.regexp_replace(F.substring(name, F.lit(1), F.length(name) - 1), "(.)", "$1/"), name, F.lit(".txt"))


def document_frequencies(docs: DataFrame) -> DataFrame:
    """(term, df) over all documents."""
    return docs.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).groupBy("term").agg(
        F.count("*").alias("df"))


def weighted(bags: DataFrame, key: list[str], frequencies: DataFrame, n: int) -> DataFrame:
    """(key, term, w): unit TF-IDF vectors of (key, terms) rows."""
    counts = bags.select(*key, F.explode("terms").alias("term")).groupBy(*key, "term").agg(F.count("*").alias("tf"))
    wanted = counts.select("term").distinct()
    known = frequencies.join(small(wanted, wanted.count()), "term", "left_semi")
    raw = counts.join(small(known, known.count()), "term", "left").select(
        *key, "term", (F.col("tf") * idf(F.coalesce("df", F.lit(0)), n)).alias("w"))
    return raw.join(raw.groupBy(*key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length")), key).select(
        *key, "term", (F.col("w") / F.col("length")).alias("w"))


def anchors(vectors: DataFrame, threshold: float) -> list[str]:
    """Terms of which every match at the threshold has one."""
    heavy = Window.partitionBy("template").orderBy(F.desc("w"), "term")
    before = F.coalesce(F.sum(F.col("w") * F.col("w")).over(heavy.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    found = vectors.withColumn("rest", 1 - before).where(F.col("rest") >= threshold**2 - 1e-9)
    return sorted(r.term for r in found.select("term").distinct().collect())  # terms of the templates


def scan(docs: DataFrame, path: Column | None = None, templates: list[tuple[str, str]] | None = None,
         threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, path, own_license, own_score, is_license_file, license, inherited_from) of every row."""
    spark = docs.sparkSession
    rows = docs.withColumn("path", sharded_path() if path is None else path).select("doc_id", "path", "text")
    n = rows.count()
    frequencies = stored(document_frequencies(rows), "frequencies")
    named = spark.createDataFrame(
        [(i, a, b) for i, (a, b) in enumerate(templates or TEMPLATES)], "template int, name string, notice string")
    bags = named.select("template", "name", terms(F.col("notice")).alias("terms"))
    vectors = stored(weighted(bags, ["template", "name"], frequencies, n), "templates")
    keys = F.array(*map(F.lit, anchors(vectors, threshold)))

    lines = rows.select(
        "path", F.size(terms(F.col("text"))).alias("n_terms"),
        F.explode(F.transform(F.split("text", "\n"), terms)).alias("terms"))
    near = lines.where(F.arrays_overlap("terms", keys)).select(
        "path", "n_terms", F.array_join("terms", " ").alias("line"), F.size("terms").alias("n_line"))
    near = stored(near, "license-lines")
    wordings = near.select("line", F.split("line", " ").alias("terms")).distinct()
    by_line = weighted(wordings, ["line"], frequencies, n)
    cosines = by_line.join(F.broadcast(vectors.withColumnRenamed("w", "t")), "term").groupBy("line", "template", "name").agg(
        F.sum(F.col("w") * F.col("t")).alias("cosine"))
    best = stored(
        cosines.where(F.col("cosine") >= threshold).select("line", F.round("cosine", 6).alias("cosine"), "name")
        .groupBy("line").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("b"))
        .select("line", (-F.col("b.c")).alias("cosine"), "b.name"), "license-scores")
    own = (
        near.join(small(best, best.count()), "line").groupBy("path")
        .agg(F.min(F.struct((-F.col("cosine")).alias("c"), "name")).alias("b"), F.sum("n_line").alias("hit"),
             F.max("n_terms").alias("n_terms"))
        .select(F.col("path").alias("own_path"), (-F.col("b.c")).alias("own_score"), F.col("b.name").alias("own_license"),
                (F.col("hit") >= FILE_SHARE * F.col("n_terms")).alias("is_license_file"))
    )
    own = stored(own, "own-licenses")
    parent = lambda p: F.regexp_extract(p, r"^(.*)/[^/]*$", 1)
    holders = own.where("is_license_file").select(
        parent(F.col("own_path")).alias("dir"), "own_license", "own_score", "own_path").groupBy("dir").agg(
        F.min(F.struct((-F.col("own_score")).alias("c"), "own_path", "own_license")).alias("b")).select(
        "dir", F.col("b.own_license").alias("held"))
    dirs = rows.where(F.col("path").isNotNull()).select(parent(F.col("path")).alias("of")).distinct()
    parts = F.split("of", "/")
    up = dirs.select("of", F.explode(F.transform(
        F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))).alias("dir")).distinct()
    nearest = up.join(small(holders, holders.count()), "dir").groupBy("of").agg(
        F.max(F.struct(F.length("dir").alias("n"), "dir", "held")).alias("b")).select(
        "of", F.col("b.dir").alias("inherited_from"), F.col("b.held").alias("held"))
    nearest = stored(nearest, "inherited")
    return (
        rows.select("doc_id", "path", parent(F.col("path")).alias("dir"))
        .join(small(own, own.count()), F.col("path") == F.col("own_path"), "left")
        .join(small(nearest, nearest.count()), F.col("dir") == F.col("of"), "left")
        .select(
            "doc_id", "path", "own_license", "own_score", F.coalesce("is_license_file", F.lit(False)).alias("is_license_file"),
            F.coalesce("own_license", "held").alias("license"),
            F.when(F.col("own_license").isNull(), F.col("inherited_from")).alias("inherited_from"))
    )
