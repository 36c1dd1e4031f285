"""Licence scan: sparse TF-IDF cosine to templates, then inheritance from the nearest directory that declares a licence.

1. **Notices.** Lines of a file that hold a licence word are its notices, wherever in the text they stand; of mark-up the tags are cut out first.
   Equal notices are compared once, however many files hold them.
2. **Cosine.** Notices and templates are sparse vectors of words, weighted by 1 + ln tf and the inverse of how many distinct notices hold the word. Dot
   products are joins on words with the templates, whose number of words is fixed. The best template of at least ``CLOSE`` is the notice's licence. A notice
   that equals none is also compared by its windows of the templates' sizes around each licence word, so that it may stand within a longer line. A file has the
   licence of its best notice.
3. **Inheritance.** A licence file (by name, or the index of a directory) with a licence declares it for its directory. A file without a licence of
   its own takes that of the deepest declaring directory above it: its path is cut at the depths at which directories declare something, and joined on the cut path.

Defined results: null texts and paths count as empty; a file in no declaring directory has no licence; of several licence files in a directory the closest notice,
then the first licence name, counts; ties between templates go to the first name; null ids and repeated rows are kept; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from risemeter.llm.tables import saved

CLOSE = 0.6
NOTICE = r"(?i)licen[cs]|copyright|permission|public domain|all rights reserved|warrant"
WINDOW_WORD = r"licen[cs]|copyright|permi(?:ssion|tted)|domain|reserved|warrant"
TAG = r"</?[A-Za-z!?][^<>]*>"
LICENCE_FILE = r"(?i)(?:^|/)(?:licen[cs]e|copying|notice|unlicense)[^/]*$|/$"

#: The notices that licences ask for, in their short forms.
TEMPLATES = (
    ("Apache-2.0", "Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "you may not use this file except in compliance with the License"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License, CC BY 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("GPL-2.0", "GNU General Public License, version 2"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("GPL-3.0", "GNU General Public License, version 3"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "GNU Lesser General Public License, version 3"),
    ("LGPL-3.0", "licensed under the GNU Lesser General Public License, version 3"),
    ("MIT", "MIT License"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("proprietary", "All rights reserved"),
)


def _terms(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}.-]+|[.](?=\s|$)"), lambda w: w != "")


def notices_of(text: Column) -> Column:
    """The distinct lines with a licence word."""
    lines = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), TAG, "\n"), r"\r?\n")
    return F.array_distinct(F.filter(F.transform(lines, F.trim), lambda line: line.rlike(NOTICE)))


def _windows(terms: Column, sizes: list[int]) -> Column:
    """The distinct runs of so many words that hold a licence word, at about four places each."""
    n = F.size(terms)
    at = F.filter(F.transform(terms, lambda w, i: F.when(w.rlike(WINDOW_WORD), i)), lambda i: i.isNotNull())

    def around(p: Column, size: int, before: int) -> Column:
        return F.array_join(F.slice(terms, F.greatest(F.lit(0), F.least(p - before, n - size)) + 1, size), " ")

    return F.array_distinct(
        F.flatten(F.transform(at, lambda p: F.array(*[around(p, size, k) for size in sizes for k in range(0, size, max(1, size // 4))])))
    )


def closest_templates(notices: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, close: float = CLOSE) -> DataFrame:
    """(notice, license, score) of the distinct ``notice`` values that come close to a template."""
    spark = notices.sparkSession
    given = spark.range(1 if templates else 0).select(F.posexplode(F.array(*[F.struct(F.lit(name).alias("license"), F.lit(text).alias("text")) for name, text in templates])).alias("template", "t"))
    given = given.select("template", "t.license", F.explode(_terms(F.col("t.text"))).alias("term")).groupBy("template", "license", "term").count()
    words = notices.select("notice", F.explode(_terms(F.col("notice"))).alias("term")).groupBy("notice", "term").count()
    spread = words.groupBy("term").agg(F.count("*").alias("held"))
    total = notices.agg(F.count("*").alias("all"))
    idf = F.log((F.col("all") + 1) / (F.coalesce("held", F.lit(0)) + 1)) + 1
    tf = 1 + F.log(F.col("count").cast("double"))
    template_words = given.join(spread, "term", "left").join(F.broadcast(total)).select("template", "license", "term", (tf * idf).alias("v"))
    template_sizes = template_words.groupBy("template").agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("template_size"))
    # The templates are a parameter of fixed size.
    held = F.broadcast(template_words.join(template_sizes, "template"))
    nearest = F.min(F.struct((-F.col("score")).alias("least"), "license")).alias("b")
    named = [F.col("b.license").alias("license"), (-F.col("b.least")).alias("score")]

    def best_of(words: DataFrame) -> DataFrame:
        weighted = words.join(spread, "term").join(F.broadcast(total)).select("notice", "term", (tf * idf).alias("w"))
        lengths = weighted.groupBy("notice").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
        dots = weighted.join(held, "term").groupBy("notice", "template", "license", "template_size").agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
        scored = dots.join(lengths, "notice").select("notice", "license", (F.col("dot") / (F.col("size") * F.col("template_size"))).alias("score"))
        return scored.where(F.col("score") >= close).groupBy("notice").agg(nearest).select("notice", *named)

    whole = saved(best_of(words), "whole")
    sizes = sorted(r.n for r in given.groupBy("template").agg(F.sum("count").alias("n")).select("n").distinct().collect())  # of the templates
    same = whole.where(F.col("score") > 1 - 1e-9)  # no window comes closer
    rest = notices.join(same, "notice", "left_anti").select("notice", F.monotonically_increasing_id().alias("line"), _terms(F.col("notice")).alias("terms"))
    rest = saved(rest.where(F.size("terms") > min(sizes, default=0)), "rest")
    windows = saved(rest.select("line", F.explode(_windows(F.col("terms"), sizes)).alias("notice")), "windows")
    parts = windows.select("notice").distinct().select("notice", F.explode(F.split("notice", " ")).alias("term")).groupBy("notice", "term").count()
    within = windows.join(best_of(parts), "notice").groupBy("line").agg(nearest).select("line", *named)
    found = whole.unionByName(rest.select("line", "notice").join(within, "line").drop("line"))
    return found.groupBy("notice").agg(nearest).select("notice", *named)


def scan_licenses(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, close: float = CLOSE) -> DataFrame:
    """(id, path, license, score, source, declared_in) of every row of ``files`` (id, path, text).

    ``source`` is ``own``, ``inherited`` or null; ``declared_in`` is the directory a licence was inherited from.
    """
    held = files.select("id", F.coalesce("path", F.lit("")).alias("path"), notices_of(F.col("text")).alias("notices"))
    held = saved(held.withColumn("row", F.monotonically_increasing_id()), "files")
    lines = held.select("row", F.explode("notices").alias("notice"))
    matched = saved(closest_templates(lines.select("notice").distinct(), templates, close), "notices")
    best = F.min(F.struct((-F.col("score")).alias("least"), "license")).alias("b")
    own = saved(lines.join(matched, "notice").groupBy("row").agg(best).select("row", F.col("b.license").alias("own"), (-F.col("b.least")).alias("own_score")), "own")
    known = held.select("row", "id", "path").join(own, "row", "left")

    directory = F.regexp_extract("path", r"^(.*)/[^/]*$", 1)
    declared = known.where(F.col("own").isNotNull() & F.col("path").rlike(LICENCE_FILE)).select(directory.alias("directory"), "own", "own_score")
    declared = declared.groupBy("directory").agg(F.min(F.struct((-F.col("own_score")).alias("least"), F.col("own").alias("license"))).alias("b"))
    declared = saved(declared.select("directory", F.col("b.license").alias("given"), _depth(F.col("directory")).alias("depth")), "declared")
    depths = sorted(r.depth for r in declared.select("depth").distinct().collect())  # how deep directories lie, not how many there are
    seeking = known.where("own is null").select("row", directory.alias("folder"))
    cuts = F.filter(F.array(*map(F.lit, depths)) if depths else F.lit([]).cast(T.ArrayType(T.IntegerType())), lambda d: d <= _depth(F.col("folder")))
    places = seeking.select("row", "folder", F.explode(cuts).alias("depth")).select("row", F.when(F.col("depth") == 0, "").otherwise(F.call_function("substring_index", F.col("folder"), F.lit("/"), F.col("depth"))).alias("directory"))
    found = places.join(declared, "directory").groupBy("row").agg(F.max(F.struct("depth", "directory", "given")).alias("f"))
    return known.join(found, "row", "left").select(
        "id",
        "path",
        F.coalesce("own", "f.given").alias("license"),
        F.col("own_score").alias("score"),
        F.when(F.col("own").isNotNull(), "own").when(F.col("f").isNotNull(), "inherited").alias("source"),
        F.when(F.col("own").isNull(), F.col("f.directory")).alias("declared_in"),
    )


def _depth(directory: Column) -> Column:
    return F.when(directory == "", 0).otherwise(F.size(F.split(directory, "/"))).cast("int")
