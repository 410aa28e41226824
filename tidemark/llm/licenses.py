"""License scans in DataFrame functions only: sparse TF-IDF cosine to templates, then inheritance by folder.

Units are header lines (lines of the whole text with a cue such as ``licensed`` or ``copyright``) and whole
licence files (by name, such as ``LICENSE``). Equal units are one row with a count from the start, so a line
that a third of all files have is scored once. A unit's vector has ``tf * idf`` for each of its terms, with
document frequencies over all units of the corpus; its cosine with each template is a join on terms with the
templates' vectors and a sum. A file takes its best unit. A file without one inherits from the nearest folder
above it that has a licence file, by a join of folders, not of files, with their ancestors. A line that very many
files have, and a folder above very many, meet the joins in ``SALT`` pieces.

Null texts have no unit; null paths are in the root. Ties go to the first license by name. Files with one
path and one text get equal results. Whole texts are read, however long; a line counts once in a file. An empty table
gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.common import fresh, written

# Fixed wordings: license, text. Several for one license are alternatives.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, version 3."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    ("BSD-3-Clause", "Use of this source code is governed by a BSD-style license."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights to this work (CC0 1.0)."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("proprietary", "Copyright. All rights reserved."),
)
CUE = r"(?i)licen[sc]e|copyright|all rights reserved|permission is hereby|redistribut|public domain"
FILE_NAME = r"(?i)(^|/)(licen[sc]e|copying|unlicense)([._-][^/]*)?$"
#: The least cosine, in thousandths.
THRESHOLD = 600
#: Pieces into which the rows of one line, or of one folder above others, are dealt.
SALT = 16


def terms(text: Column) -> Column:
    """Lower-case words of letters, digits and inner ``.``, ``-``; A-Z only are lower-cased."""
    lowered = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.regexp_extract_all(lowered, F.lit(r"[a-z0-9]+([.-][a-z0-9]+)*"), F.lit(0))


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def _salted(rows: DataFrame, by: str) -> DataFrame:
    return rows.withColumn("salt", F.pmod(F.xxhash64(by), F.lit(SALT)).cast("int"))


def _for_each_salt(rows: DataFrame) -> DataFrame:
    return rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))


def _counted(units: DataFrame, key: str) -> DataFrame:
    """``key, term, tf`` from ``key, unit``; a short key, as it goes with every term."""
    return units.select(key, F.explode(terms(F.col("unit"))).alias("term")).groupBy(key, "term").agg(F.count("*").alias("tf"))


def _weighted(tf: DataFrame, idf: DataFrame, key: str, unseen: Column) -> DataFrame:
    """``key, term, weight`` of length 1; ``unseen`` is the idf of a term that no unit has."""
    w = tf.join(idf, "term", "left").select(key, "term", (F.col("tf") * F.coalesce("idf", unseen)).alias("w"))
    length = w.groupBy(key).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("length"))
    return w.join(length, key).select(key, "term", (F.col("w") / F.col("length")).alias("weight"))


def scored(units: DataFrame, templates: DataFrame) -> DataFrame:
    """``unit_id, license, similarity`` (thousandths) of the best template, from ``unit_id, unit, n`` (distinct, with counts)."""
    tf = _counted(units, "unit_id")
    total = units.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    df = tf.join(units.select("unit_id", "n"), "unit_id").groupBy("term").agg(F.sum("n").alias("df"))
    idf = df.select("term", (F.log((F.lit(total) + 1) / (F.col("df") + 1)) + 1).alias("idf"))
    unseen = F.log(F.lit(total) + 1) + 1
    mine = _weighted(tf, idf, "unit_id", unseen)
    numbered = templates.select("template", F.col("text").alias("unit"))
    theirs = _weighted(_counted(numbered, "template"), idf, "template", unseen).withColumnRenamed("weight", "weight_of_template")
    cosine = mine.join(theirs, "term").groupBy("unit_id", "template").agg(F.sum(F.col("weight") * F.col("weight_of_template")).alias("cosine"))
    named = cosine.join(templates.select("template", "license"), "template")
    similarity = F.round(F.col("cosine") * 1000).cast("long")
    return _best(named.withColumn("similarity", similarity))


def _best(named: DataFrame) -> DataFrame:
    """The highest similarity; of equal ones the first license."""
    top = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("license").alias("license"))).alias("top")
    return named.groupBy("unit_id").agg(top).select("unit_id", F.col("top.license").alias("license"), (-F.col("top.s")).alias("similarity"))


def templates(spark: SparkSession, rows: tuple = TEMPLATES) -> DataFrame:
    return spark.createDataFrame([(k, license_, text) for k, (license_, text) in enumerate(rows)], "template int, license string, text string")


def scan(files: DataFrame, wordings: DataFrame, path: str = "path", text: str = "text", threshold: int = THRESHOLD) -> DataFrame:
    """The frame with ``license, similarity, found_in``: ``header``, ``file`` or ``inherited``; nulls if there is none.

    Columns of these names are replaced. ``wordings`` has ``template, license, text``.
    """
    unit, kind, up = fresh(files, "unit"), fresh(files, "unit_kind"), fresh(files, "folder")
    body, is_file = F.col(text), F.coalesce(F.col(path), F.lit("")).rlike(FILE_NAME)
    lines = F.when(body.rlike(CUE), F.array_distinct(F.filter(F.split(body, "\n"), lambda x: x.rlike(CUE)))).otherwise(F.array().cast("array<string>"))
    had = files.drop("license", "similarity", "found_in")
    had = had.withColumn(up, folder(F.coalesce(F.col(path), F.lit("")))).withColumn(kind, F.when(is_file, "file").otherwise("header"))
    had = had.withColumn(unit, F.when(is_file & body.isNotNull(), F.array(body)).otherwise(F.coalesce(lines, F.array().cast("array<string>"))))

    # distinct sets of units, so that texts are searched once for them and files with the same header meet the join once
    counted = had.where(F.size(unit) > 0).groupBy(F.transform(unit, F.md5).alias("units")).agg(F.first(unit).alias("lines"), F.count("*").alias("n"))
    sets = written(counted, "sets")
    each = sets.select(F.explode("lines").alias("unit"), "n")
    units = written(each.groupBy(F.md5("unit").alias("unit_id")).agg(F.first("unit").alias("unit"), F.sum("n").alias("n")), "units")
    known = scored(units, wordings).where(F.col("similarity") >= threshold)
    top = F.min(F.struct((-F.col("similarity")).alias("s"), F.col("license").alias("l"))).alias("top")
    of_sets = _salted(sets.select("units", F.explode("units").alias("unit_id")), "units").join(_for_each_salt(known), ["unit_id", "salt"])
    own = of_sets.groupBy("units").agg(top).select("units", F.col("top.l").alias("own_license"), (-F.col("top.s")).alias("own_similarity"))
    # files of one set meet its license in SALT pieces, files without units are spread by their own hash;
    # a salt that may be null would be tested for it on all rows, with the search for units
    salt, of_salt, of_unit, spread = fresh(files, "file_salt"), fresh(files, "of_salt"), fresh(files, "of_unit"), F.xxhash64(path, text)
    had = had.withColumn(unit, F.transform(unit, F.md5)).withColumn(salt, F.coalesce(F.when(F.size(unit) > 0, F.pmod(spread, F.lit(SALT))).otherwise(spread), F.lit(0)))
    theirs = _for_each_salt(own).select(F.col("units").alias(of_unit), F.col("salt").cast("long").alias(of_salt), "own_license", "own_similarity")
    with_own = had.join(theirs, (F.col(unit) == F.col(of_unit)) & (F.col(salt) == F.col(of_salt)), "left").drop(salt, of_unit, of_salt)

    top = F.min(F.struct((-F.col("own_similarity")).alias("s"), F.col("own_license").alias("l"))).alias("top")
    of_folder = with_own.where((F.col(kind) == "file") & F.col("own_license").isNotNull()).groupBy(F.col(up).alias("above")).agg(top)
    folders = had.select(F.col(up).alias("folder_")).distinct()
    parts = F.split("folder_", "/")
    chain = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    above = folders.select("folder_", F.posexplode(chain).alias("depth", "above"))
    nearest = _salted(above, "folder_").join(_for_each_salt(of_folder), ["above", "salt"]).groupBy("folder_").agg(F.max_by("top", "depth").alias("top")).select("folder_", F.col("top.l").alias("folder_license"), (-F.col("top.s")).alias("folder_similarity"))

    out = with_own.join(nearest, F.col(up) == F.col("folder_"), "left")
    columns = {
        "license": F.coalesce("own_license", "folder_license"),
        "similarity": F.coalesce("own_similarity", "folder_similarity"),
        "found_in": F.when(F.col("own_license").isNotNull(), F.col(kind)).when(F.col("folder_license").isNotNull(), "inherited"),
    }
    return out.withColumns(columns).drop(unit, kind, up, "own_license", "own_similarity", "folder_", "folder_license", "folder_similarity")
