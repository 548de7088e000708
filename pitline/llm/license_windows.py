"""License scans: MinHash bands over overlapping windows retrieve templates, exact containment of shingles confirms them.
DataFrame functions only.

A template is looked for in windows a quarter longer than its size class, so that a whole copy lies in one of them and the
window's Jaccard similarity to it has a floor. Bands of one MinHash each then collide with near certainty. Windows are only
laid around anchor words: of every template more shingles hold an anchor than a copy may lack, so a copy always has one.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pitline.session import read_table

#: Public license notices and the opening or granting passages of public license texts.
TEMPLATES = {
    "MIT notice": "Released under the MIT License.",
    "Apache-2.0 notice": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0 notice": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0 notice": "Licensed under CC BY-NC 4.0.",
    "MIT": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
    "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
    "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
    "BSD": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "ISC": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
    "provided that the above copyright notice and this permission notice appear in all copies.",
    "GPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "LGPL": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License "
    "as published by the Free Software Foundation",
    "AGPL": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License "
    "as published by the Free Software Foundation",
    "EPL-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
    "which is available at https://www.eclipse.org/legal/epl-2.0/",
    "Unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or "
    "distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "Zlib": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it "
    "freely, subject to the following restrictions",
    "BSL-1.0": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation "
    "covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software",
    "CC0-1.0": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
    "public domain worldwide. This software is distributed without any warranty.",
}
SHINGLE, CONTAINED = 5, 80
#: One MinHash per band: a window whose similarity is at least 0.2 misses all of them with chance 0.8 ** 48, about 2e-5.
BANDS = 48
CLASSES = (5, 8, 16, 32, 64, 128, 256)
#: Templates whose bands and shingles are broadcast, at most some 100 MB; with more of them the joins are left to the planner.
SENT_TEMPLATES = 5_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits, in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles_of(words: Column, start: Column, stop: Column) -> Column:
    """Distinct hashes of the five-word shingles that lie in words start (from 0) to stop (exclusive)."""
    last = stop - SHINGLE
    whole = F.transform(F.sequence(start, F.greatest(last, start)), lambda i: F.xxhash64(F.array_join(F.slice(words, i + 1, SHINGLE), " ")))
    return F.when(last >= start, F.array_distinct(whole)).otherwise(F.array().cast("array<bigint>"))


def signature(shingles: Column) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda seed: F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, seed))))


def size_class(n_words: int) -> int:
    return next((c for c in CLASSES if n_words <= c), n_words)


def step_of(size: int) -> int:
    return max(1, size // 4)


def _plain(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def anchor_words(templates: dict[str, str], contained: int = CONTAINED) -> list[str]:
    """Words such that in each template more shingles hold one of them than a copy may lack; words of many templates and
    rare letters first, a word of few letters last."""
    spelled = {name: _plain(t) for name, t in templates.items()}
    uses = {w: sum(w in s for s in spelled.values()) for s in spelled.values() for w in s}
    chosen: set[str] = set()
    for words in spelled.values():
        shingles = {tuple(words[k : k + SHINGLE]) for k in range(len(words) - SHINGLE + 1)}
        allowed = math.floor(len(shingles) * (100 - contained) / 100)
        for word in sorted(set(words), key=lambda w: (w not in chosen, -len(w), -uses[w], w)):
            if sum(any(w in chosen for w in s) for s in shingles) > allowed:
                break
            if any(word in s for s in shingles):
                chosen.add(word)
    return sorted(chosen)


def find_licenses(docs: DataFrame, templates: dict[str, str] | None = None, contained: int = CONTAINED) -> DataFrame:
    """``doc_id, license, word_start, n_found, n_shingles``: documents that hold ``contained`` per cent or more of a
    template's five-word shingles within one window; word_start is the first such window's place in words.

    Words are runs of letters and digits, compared in lower case. Templates of fewer than five words are an error, as they
    have no shingle. Null, empty and short texts hold nothing. Rows with the same doc_id are one document with several
    texts and give one row per license; a null doc_id is one document too. An empty table or no templates give no rows.
    Only doc_id and text are looked at. Whole texts are searched, and up to SENT_TEMPLATES templates no shuffle moves their
    windows.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    sizes = {name: len(_plain(t)) for name, t in templates.items()}
    if any(n < SHINGLE for n in sizes.values()):
        raise ValueError(f"templates need {SHINGLE} words")
    anchors = anchor_words(templates, contained) if templates else ["-"]
    known = spark.createDataFrame([(n, t, size_class(sizes[n])) for n, t in templates.items()], "license string, body string, size int")
    known = known.withColumn("own", words_of(F.col("body"))).withColumn("own", shingles_of(F.col("own"), F.lit(0), F.size("own")))
    bands = known.select("license", "size", F.posexplode(signature(F.col("own"))).alias("band", "value"))
    own = known.select("license", "own")
    if len(templates) <= SENT_TEMPLATES:
        bands, own = F.broadcast(bands), F.broadcast(own)

    near = docs.select("doc_id", "text").where(F.col("text").rlike(r"(?i)\b(?:" + "|".join(anchors) + r")\b"))
    spelled = near.select("doc_id", words_of(F.col("text")).alias("words"))
    is_anchor = F.array(*[F.lit(a) for a in anchors])
    placed = spelled.withColumn("anchors", F.filter(F.transform("words", lambda w, i: F.when(F.array_contains(is_anchor, w), i)), lambda p: p.isNotNull()))
    windows = []
    for size in sorted({size_class(n) for n in sizes.values()}):
        step = step_of(size)
        length = size + step
        first = lambda p, length=length, step=step: F.greatest(F.lit(0), F.ceil((p - length + 1) / step).cast("int"))
        starts = F.transform("anchors", _stretch(first, step))
        windows.append(F.transform(F.array_distinct(F.flatten(starts)), _window(size, step, length)))
    laid = placed.select("doc_id", "words", F.explode(F.concat(*windows)).alias("w")) if windows else placed.select("doc_id", "words", F.lit(None).alias("w")).limit(0)
    filled = laid.select("doc_id", "w.size", "w.start", shingles_of(F.col("words"), F.col("w.start"), F.least(F.col("w.stop"), F.size("words"))).alias("shingles"))
    filled = filled.where(F.size("shingles") > 0)
    looked_up = filled.select("*", F.posexplode(signature(F.col("shingles"))).alias("band", "value")).join(bands, ["size", "band", "value"])
    looked_up = looked_up.join(own, "license")
    checked = looked_up.withColumn("n_found", F.size(F.array_intersect("shingles", "own"))).where(100 * F.col("n_found") >= contained * F.size("own"))
    best = F.max(F.struct("n_found", (-F.col("start")).alias("late"))).alias("b")
    return checked.groupBy("doc_id", "license").agg(best, F.max(F.size("own")).alias("n_shingles")).select(
        "doc_id", "license", (-F.col("b.late")).cast("long").alias("word_start"), F.col("b.n_found").cast("long").alias("n_found"), F.col("n_shingles").cast("long")
    )


def _stretch(first, step: int):
    return lambda p: F.sequence(first(p), F.floor(p / step).cast("int"))


def _window(size: int, step: int, length: int):
    return lambda k: F.struct(F.lit(size).alias("size"), (k * step).alias("start"), (k * step + length).alias("stop"))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licenses in all ``documents``."""
    return find_licenses(read_table(spark, sf_dir, "documents"))
