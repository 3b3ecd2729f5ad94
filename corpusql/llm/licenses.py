"""License scans: TF-IDF cosine of headers and licence files to templates, then inheritance by directories.

1. Headers are lines that hold a cue (license, copyright, SPDX, a template's first words, ...), and, as notices
   are wrapped, every run of up to SPAN lines of a block that holds one, and the block; blocks end at lines without
   letters and digits. A file whose words lie mostly in lines of a cue, or which is named so, is a licence file;
   the whole text of a licence file is a header too. Whole texts are read.
2. Headers and templates are sparse vectors over the templates' words, a list of (word, weight) with
   weight = tf * idf; idf = ln((N + 1) / (df + 1)) + 1 counts lines of a cue and templates of the whole corpus, one row a
   word of the templates. A header matches its best template if their cosine is at least COSINE and the
   template's words make up COVER of its own.
3. A file takes its best header's license. A file without one takes that of the nearest ancestor directory
   that has a licence file: distinct directories, not files, are joined to their ancestors, and files then
   join their directory, whose side has one row a key, so a directory of a third of all files can be split.

Nulls and edges: null or empty texts have no header but may inherit; a null path has no directory and
inherits nothing; of ties the higher cosine, then the smaller license, then the smaller path counts; repeated
rows, ids and null ids give a row each, judged by its own text; an empty table gives no rows; columns that aren't asked for aren't read."""

from __future__ import annotations

import json
import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.llm.common import Staged, table, text_or_empty

COSINE, COVER, MOSTLY, SPAN = 0.6, 0.6, 0.5, 8
NAMED = r"(?i)(^|/)(licen[cs]e|copying|unlicense|notice)(\.[a-z]+)?$"
WORD = r"[a-z0-9]+(?:[.+-][a-z0-9]+)*"

#: What notices of these licences commonly say.
TEMPLATES = {
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.", "SPDX-License-Identifier: Apache-2.0", "Apache License Version 2.0, January 2004"],
    "MIT": ["Released under the MIT License.", "This project is licensed under the terms of the MIT license.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction"],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or any later version.", "SPDX-License-Identifier: GPL-3.0-or-later"],
    "GPL-2.0": ["Licensed under the GNU General Public License, version 2.", "SPDX-License-Identifier: GPL-2.0-only"],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-3.0-or-later"],
    "AGPL-3.0": ["Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "BSD-3-Clause": ["Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "SPDX-License-Identifier: MPL-2.0"],
    "CC-BY-4.0": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA-4.0": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC-4.0": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC0-1.0": ["Released into the public domain under CC0 1.0.", "Dedicated to the public domain under Creative Commons Zero, CC0 1.0 Universal."],
    "proprietary": ["Copyright. All rights reserved.", "Confidential and proprietary. No license is granted; redistribution prohibited."],
}

_CUES = r"licen[cs]e|copyright|\bspdx\b|\bpublic\s+domain\b|\bcreative\s+commons\b|redistribut|\bwarrant(y|ies)\b"
#: A template that has none of the cues gives its first four words as one; white space may be a line's end.
_FIRST = [r"\s+".join(re.escape(w) for w in t.lower().split()[:4]) for ts in TEMPLATES.values() for t in ts if not re.search(_CUES, t.lower())]
CUE = "(?i)" + "|".join([_CUES, *_FIRST])


def template_rows(templates: dict[str, list[str]]) -> list[tuple[int, str, dict[str, int]]]:
    out = []
    for name, texts in templates.items():
        for t in texts:
            words: dict[str, int] = {}
            for w in re.findall(WORD, t.lower()):
                words[w] = words.get(w, 0) + 1
            out.append((len(out), name, words))
    return out


def headers(files: DataFrame) -> DataFrame:
    """file, path, headers (solo: a line of a cue alone, w: words), any and licence_file of files(file, path, text)."""
    text = text_or_empty()
    named = F.coalesce(F.col("path").rlike(NAMED), F.lit(False))
    df = files.select("file", "path", named.alias("named"), F.when(text.rlike(CUE) | named, text).otherwise("").alias("text"))
    cues = F.filter(F.split("text", "\n"), lambda x: x.rlike(CUE))
    df = df.select("*", cues.alias("cues"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("words"))
    inside = F.aggregate("cues", F.lit(0), lambda s, x: s + F.size(F.regexp_extract_all(x, F.lit(r"\S+"), F.lit(0))))
    df = df.withColumn("licence_file", F.col("named") | ((F.size("cues") > 0) & (inside >= MOSTLY * F.col("words"))))
    blocks = F.transform(F.filter(F.split("text", r"\n(?:[^\p{L}\p{N}\n]*(?:\n|\z))+"), lambda b: b.rlike(CUE)), lambda b: F.split(b, "\n"))

    def runs(b: Column) -> Column:
        lengths = F.sequence(F.lit(2), F.greatest(F.least(F.size(b), F.lit(SPAN)), F.lit(2)))
        at = F.flatten(F.transform(F.sequence(F.lit(1), F.size(b)), lambda i: F.transform(lengths, lambda n: F.array_join(F.slice(b, i, n), "\n"))))
        return F.array_distinct(F.concat(F.filter(at, lambda x: x.rlike(CUE)), F.array(F.array_join(b, "\n"))))

    wrapped = F.concat(F.flatten(F.transform(blocks, runs)), F.when(F.col("licence_file") & (F.col("text") != ""), F.array("text")).otherwise(F.array().cast("array<string>")))
    wrapped = F.array_distinct(F.filter(wrapped, lambda x: ~F.array_contains(F.col("cues"), x)))

    def said(lines: Column, solo: bool) -> Column:
        return F.transform(lines, lambda x: F.struct(F.lit(solo).alias("solo"), F.regexp_extract_all(F.lower(x), F.lit(WORD), F.lit(0)).alias("w")))

    heads = F.when(F.col("text") == "", F.array().cast("array<struct<solo: boolean, w: array<string>>>")).otherwise(F.concat(said(F.col("cues"), True), said(wrapped, False)))
    return df.select("file", "path", heads.alias("headers"), (F.col("text") != "").alias("any"), "licence_file")


def declared(units: DataFrame, templates: dict[str, list[str]]) -> DataFrame:
    """file, license, cosine: the best of each file's headers(file, headers)."""
    spark = units.sparkSession
    rows = template_rows(templates)
    vocabulary = sorted({w for *_, words in rows for w in words})  # a bound on what is sent: the templates' words
    known = F.array(*(F.lit(w) for w in vocabulary))
    lines = units.select("file", F.posexplode("headers").alias("line", "x")).select("file", "line", "x.solo", "x.w").where(F.size("w") > 0)
    lines = lines.select("file", "line", "solo", F.size("w").alias("n"), F.filter("w", lambda x: F.array_contains(known, x)).alias("w"))
    lines = Staged(lines.where(F.size("w") > 0), "headers").df
    alone = lines.where("solo")
    n = alone.count() + len(rows)
    df = dict(alone.select(F.explode(F.array_distinct("w")).alias("x")).groupBy("x").count().collect())
    for *_, words in rows:
        for w in words:
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log((n + 1) / (df[w] + 1)) + 1 for w in vocabulary}
    tf = lines.select("file", "line", "n", F.explode("w").alias("x")).groupBy("file", "line", "n", "x").agg(F.count("*").alias("tf"))
    made = [{"template": k, "license": name, "x": w, "b": c * idf[w]} for k, name, words in rows for w, c in words.items()]
    vectors = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(made)), "array<struct<template: int, license: string, x: string, b: double>>")))
    lengths = vectors.groupBy("template").agg(F.sqrt(F.sum(F.col("b") ** 2)).alias("tb"))
    vectors = F.broadcast(vectors.join(lengths, "template"))
    weigh = F.create_map(*(F.lit(y) for w in vocabulary for y in (w, float(idf[w]))))
    tf = tf.withColumn("a", F.col("tf") * weigh[F.col("x")])
    own = tf.groupBy("file", "line", "n").agg(F.sqrt(F.sum(F.col("a") ** 2)).alias("ta"), F.sum("tf").alias("known"))
    dots = tf.join(vectors, "x").groupBy("file", "line", "template", "license", "tb").agg(F.sum(F.col("a") * F.col("b")).alias("dot"))
    scored = dots.join(own, ["file", "line"]).withColumn("cosine", F.round(F.col("dot") / (F.col("ta") * F.col("tb")), 6))
    good = scored.where((F.col("cosine") >= COSINE) & (F.col("known") >= COVER * F.col("n")))
    best = good.groupBy("file").agg(F.max("cosine").alias("cosine"))
    return good.join(best, ["file", "cosine"]).groupBy("file", "cosine").agg(F.min("license").alias("license"))


def parent(path: Column) -> Column:
    """The directory of a path; '' is the top."""
    return F.regexp_replace(path, r"/?[^/]*$", "")


def scan(files: DataFrame, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """file, path, license, how (header, file, inherited, none), cosine, licence_dir of files(file: long, path, text)."""
    # each row is a file of its own, whatever its id: rows are numbered in the table that is written
    units = Staged(headers(files.select("*")).withColumn("row", F.monotonically_increasing_id()), "files").df
    own = Staged(declared(units.where("any").select(F.col("row").alias("file"), "headers"), templates).withColumnRenamed("file", "row"), "declared").df
    stated = units.where("any").select("row", "path", "licence_file").join(own, "row")
    of = stated.where("licence_file and path is not null").withColumn("dir", parent(F.col("path")))
    pick = F.min_by(F.struct("license", "path"), F.struct(-F.col("cosine"), "license", "path"))
    dirs = of.groupBy("dir").agg(pick.alias("x")).select(F.col("dir").alias("up"), "x.license")
    here = units.where("path is not null").select(parent(F.col("path")).alias("dir")).distinct()
    parts = F.filter(F.split("dir", "/"), lambda p: p != "")
    ups = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "/"))
    rooted = F.when(F.col("dir").startswith("/"), F.transform(ups, lambda p: F.when(p == "", "").otherwise(F.concat(F.lit("/"), p)))).otherwise(ups)
    near = here.select("dir", F.posexplode(rooted).alias("depth", "up")).join(dirs, "up")
    near = near.groupBy("dir").agg(F.max_by(F.struct("license", "up"), "depth").alias("x")).select("dir", F.col("x.license").alias("given"), F.col("x.up").alias("licence_dir"))
    out = units.withColumn("dir", parent(F.col("path"))).join(near, "dir", "left").join(own, "row", "left")
    how = F.when(F.col("license").isNotNull(), F.when(F.col("licence_file"), "file").otherwise("header")).when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("file", "path", F.coalesce("license", "given").alias("license"), how.alias("how"), "cosine", F.when(how == "inherited", F.col("licence_dir")).alias("licence_dir"))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files {source}/{lang}/doc_{doc_id}.txt."""
    path = F.concat_ws("/", "source", "lang", F.concat(F.lit("doc_"), F.col("doc_id"), F.lit(".txt")))
    found = scan(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), path.alias("path"), "text"))
    return found.withColumnRenamed("file", "doc_id")
