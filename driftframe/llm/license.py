"""License scans by Spark expressions only.

Templates are license notices.  A text is cut into overlapping windows, one set for each length class of the
templates: a window is about as long as the templates of its class and the next begins a quarter of the class
later, so every place of a whole template lies in a window.  A template is found where a window holds 0.75 of
its five-word shingles or more.

Retrieval is by MinHash bands of one row.  From the sizes of a class's windows and of a template follows the
least Jaccard similarity J that 0.75 containment allows; the number of bands is the least for which a match
collides in none with a probability below ``MISS`` ((1 - J) ^ bands, checked for each template).  A template of
a single shingle, whose J would be low, is retrieved by that shingle itself.  What collides is verified by exact
shingle containment.  Before all that, each template has cue words that leave too few shingles for 0.75 when they
are absent, so a text, and a window, without any cue can't match.

Words are runs of ASCII letters and digits, in lower case.  Null and empty texts match nothing; every text
that matches gives one row for each license; rows repeated in documents count once (by id); windows that tie give
one row; a null doc_id is kept; extra columns are ignored.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE = 5
NEED, OF = 75, 100
#: The probability, at most, that a window which holds a template collides with it in no band.
MISS = 1e-9

#: Public license notices by SPDX-like name.
TEMPLATES = {
    "Apache-2.0-line": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "Apache-2.0-warranty": "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
    "MIT-line": "Released under the MIT License",
    "MIT-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction",
    "MIT-warranty": "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT",
    "BSD-grant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "GPL-grant": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    "GPL-line": "This work is licensed under the GNU General Public License",
    "LGPL-grant": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    "MPL-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-SA-4.0-line": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    "ISC-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(text: str) -> list[str]:
    words = words_of(text)
    return list(dict.fromkeys(" ".join(words[i : i + SHINGLE]) for i in range(max(1, len(words) - SHINGLE + 1))))


def cues_of(templates: dict[str, str]) -> list[str]:
    """Words of which every occurrence of a template with 0.75 of its shingles holds one."""
    cues: list[str] = []
    for text in templates.values():
        shingles = shingles_of(text)
        need = -(-NEED * len(shingles) // OF)
        while True:
            without = [s for s in shingles if not set(s.split()) & set(cues)]
            if len(without) < need:
                break
            count = {w: sum(w in s.split() for s in without) for s in without for w in s.split()}
            cues.append(max(sorted(count), key=lambda w: (len(w) >= 7, count[w])))
    return sorted(set(cues))


def size_class(text: str) -> int:
    """The least of 8, 12, 16, 24, 32, 48 ... words that holds the template."""
    n, size = len(words_of(text)), 8
    while size < n:
        size = size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


def step_of(size: int) -> int:
    return size // 4


def window_of(size: int) -> int:
    """Words of a window: at any place, so many words lie in the window that begins a step before or less."""
    return size + step_of(size) - 1


def least_similarity(text: str) -> float:
    """The least Jaccard similarity of the template with a window that holds 0.75 of it."""
    n = len(shingles_of(text))
    need = -(-NEED * n // OF)
    return need / (n + window_of(size_class(text)) - SHINGLE + 1 - need)


def bands_of(text: str) -> int:
    """Bands after which a match is missed with a probability below MISS; none for a template of one shingle."""
    if len(shingles_of(text)) == 1:
        return 0
    return math.ceil(math.log(MISS) / math.log1p(-least_similarity(text)))


def signature(shingles: Column, bands: Column | int) -> Column:
    """The least hash of the shingles in each band."""
    hashes = F.transform(shingles, lambda s: F.xxhash64(s))
    numbers = F.sequence(F.lit(1), F.lit(bands) if isinstance(bands, int) else bands)
    return F.transform(numbers, lambda i: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, i))))


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """license, size, shingles, values to be retrieved by: as large as the templates given, whatever the corpus."""
    rows = [(name, size_class(text), shingles_of(text), bands_of(text)) for name, text in templates.items()]
    table = spark.createDataFrame(rows, "license string, size int, shingles array<string>, bands int")
    values = F.when(F.col("bands") == 0, F.transform("shingles", lambda s: F.xxhash64(s))).otherwise(signature(F.col("shingles"), F.greatest("bands", F.lit(1))))
    return table.withColumn("values", values)


def windows(texts: DataFrame, sizes: list[int], cues: list[str]) -> DataFrame:
    """doc_id, size and shingles of the windows that hold a cue; each window leaves its text as a part of its own."""
    words = F.filter(F.split(F.lower("text"), "[^a-z0-9]+"), lambda w: w != "")
    rows = texts.select("doc_id", words.alias("words")).where(F.size("words") > 0)
    wanted = F.array(*map(F.lit, cues))

    def with_cue(size: int) -> Column:
        step, width = step_of(size), window_of(size)
        last = F.greatest(F.lit(0), F.ceil((F.size("words") - width) / F.lit(step)).cast("int"))  # it reaches the end
        parts = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice("words", i * step + 1, width))
        parts = F.filter(parts, lambda part: F.arrays_overlap(part, wanted))
        return F.transform(parts, lambda part: F.struct(F.lit(size).alias("size"), part.alias("part")))

    sets = [with_cue(size) for size in sizes]
    rows = rows.select("doc_id", F.explode(F.concat(*sets)).alias("w")).select("doc_id", "w.size", "w.part")
    places = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("part") - SHINGLE + 1))
    return rows.select("doc_id", "size", F.array_distinct(F.transform(places, lambda i: F.array_join(F.slice("part", i, SHINGLE), " "))).alias("shingles"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, license, matched, total: the best window's shared shingles of each template found in a text."""
    table = template_table(docs.sparkSession, templates)
    cues = cues_of(templates)
    lowered = F.lower("text")
    holds = F.lit(False)
    for cue in cues:
        holds |= F.contains(lowered, F.lit(cue))
    parts = windows(docs.select("doc_id", "text").where(holds), sorted({size_class(t) for t in templates.values()}), cues)
    bands = max(1, *(bands_of(t) for t in templates.values()))
    values = F.concat(signature(F.col("shingles"), bands), F.transform("shingles", lambda s: F.xxhash64(s)))
    # the windows' values that are a template's, and from them the templates of the same class
    known = F.array(*(F.lit(r[0]) for r in table.select(F.explode("values").alias("v")).distinct().orderBy("v").collect()))
    keyed = parts.select("doc_id", "size", "shingles", F.explode(F.array_intersect(values, known)).alias("value"))
    library = table.select("license", F.col("size").alias("t_size"), F.col("shingles").alias("wanted"), F.explode("values").alias("t_value"))
    met = keyed.join(F.broadcast(library), (F.col("size") == F.col("t_size")) & (F.col("value") == F.col("t_value")))
    verified = met.select("doc_id", "license", F.size(F.array_intersect("wanted", "shingles")).cast("long").alias("matched"), F.size("wanted").cast("long").alias("total"))
    verified = verified.where(OF * F.col("matched") >= NEED * F.col("total"))
    return verified.groupBy("doc_id", "license").agg(F.max("matched").alias("matched"), F.max("total").alias("total"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))


def sql(templates: dict[str, str] = TEMPLATES) -> str:
    """The same by exact containment over all windows."""
    rows = ", ".join(f"('{name}', {size_class(text)}, {step_of(size_class(text))}, {window_of(size_class(text))}, [{', '.join(repr(s) for s in shingles_of(text))}])" for name, text in templates.items())
    return f"""
WITH templates(license, size, step, width, wanted) AS (VALUES {rows}),
texts AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents WHERE text IS NOT NULL),
sized AS (SELECT doc_id, words, size, step, width FROM texts, (SELECT DISTINCT size, step, width FROM templates) WHERE len(words) > 0),
places AS (SELECT doc_id, words, size, step, width, unnest(range(1 + greatest(0, CAST(ceil((len(words) - width) / step) AS BIGINT)))) AS place FROM sized),
parts AS (SELECT doc_id, size, list_slice(words, place * step + 1, place * step + width) AS part FROM places),
cut AS (SELECT doc_id, size, list_transform(range(1, greatest(1, len(part) - {SHINGLE - 1}) + 1), lambda i: array_to_string(list_slice(part, i, i + {SHINGLE - 1}), ' ')) AS shingles FROM parts),
met AS (SELECT doc_id, license, len(list_intersect(wanted, shingles)) AS matched, len(wanted) AS total FROM cut JOIN templates USING (size))
SELECT doc_id, license, max(matched) AS matched, max(total) AS total FROM met WHERE {OF} * matched >= {NEED} * total GROUP BY doc_id, license
"""
