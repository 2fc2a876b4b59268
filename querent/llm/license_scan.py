r"""License scan: MinHash bands over text windows, then exact containment.

A text is lower-cased and cut into words of letters and digits; its shingles
are five words. Templates are classed by their number of shingles m, and each
class has windows of W shingles, taken every S shingles of a document and at
every place of a template, with W + S - 1 <= m: any occurrence of a template
holds a whole document window, which then equals one of the template's windows
and collides with certainty. A window damaged by edits still collides with
probability 1 - (1 - J)^B for a Jaccard similarity J of the windows and B bands
of one row, each an order of its own by a hash with the band's number (B = 12:
0.992 for J = 1/3, 0.9998 for J = 1/2; measured in the tests).

A band of one row collides only if both windows share the shingle that has the
least hash, so windows without any template shingle can be passed over without
losing a collision; bands are computed for the others. Windows meet templates by
an equi-join on (class, band, key), and what it retrieves is verified on the
exact shingles around the window: a match holds ``share`` or more of the
template's.

Templates are bounded by MOST_SHINGLES: that many numbers in the scan's filter,
and BANDS times that many rows in the broadcast side of the join. Everything
before the matches is one row a document where it lies; only retrieved windows
are shuffled. Defined results: a null text, or one of fewer than five words,
matches nothing; texts of any length are scanned whole; documents that share an
id are reported together; a notice within ``share`` of two templates (GPL 2 and
3) matches both, and the containment tells them apart; templates of fewer than
five words are refused; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from querent.llm.shared import once, pick

SIZE = 5
SHARE = 0.8
BANDS = 12
#: (least shingles of a template, W, S) of each class.
CLASSES = ((1, 1, 1), (8, 4, 2), (32, 16, 8))
#: Shingles of all templates together; a broadcast row is some 60 bytes.
MOST_SHINGLES = 50_000

# Fixed texts: customary licence notices.
TEMPLATES = {
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-2.0-notice": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "lgpl-2.1-notice": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "agpl-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "mpl-2.0-notice": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd-clauses": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-clause": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def _hash(words: Column, at: Column) -> Column:
    """Hash of the shingle whose first word is words[at]."""
    return F.xxhash64(*[F.get(words, at + i) for i in range(SIZE)])


def _count(words: Column) -> Column:
    return F.size(words) - (SIZE - 1)


def _bands(words: Column, start: Column, width: int) -> Column:
    """One key a band for the window of ``width`` shingles at start: the least hash in the band's own order."""
    last = F.least(start + width, _count(words)) - 1
    return _least(F.transform(F.sequence(start, last), lambda p: _hash(words, p)))


def _least(hashes: Column) -> Column:
    return F.array(*[F.array_min(F.transform(hashes, _in_band(i))) for i in range(BANDS)])


def _in_band(i: int):
    return lambda h: F.xxhash64(F.lit(i), h)


def _shingles(words: Column) -> Column:
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.size(words) - (SIZE - 1)), lambda p: F.array_join(F.slice(words, p, SIZE), " ")))


def _class(m: int) -> tuple[int, int, int]:
    return max(c for c in CLASSES if c[0] <= m)


def prepared(spark: SparkSession, templates: dict[str, str]) -> list[dict]:
    """Each template's class, shingles, hashes and the band keys of all its windows."""
    rows = spark.createDataFrame(list(templates.items()), "name string, text string")
    base = rows.select("name", _words(F.col("text")).alias("words")).withColumn("m", _count(F.col("words")))
    sizes = base.select("name", "m").collect()
    if short := sorted(r.name for r in sizes if r.m < 1):
        raise ValueError(f"templates of fewer than {SIZE} words: {short}")
    if sum(r.m for r in sizes) > MOST_SHINGLES:
        raise ValueError(f"templates of more than {MOST_SHINGLES} shingles")
    places = F.sequence(F.lit(0), F.col("m") - 1)
    base = base.withColumn("hashes", F.transform(places, lambda p: _hash(F.col("words"), p))).withColumn("shingles", _shingles(F.col("words")))
    out = []
    for least, width, _ in CLASSES:
        above = [c[0] for c in CLASSES if c[0] > least]
        own = base.where((F.col("m") >= least) & (F.col("m") < (min(above) if above else 1 << 30)))
        starts = F.sequence(F.lit(0), F.greatest(F.col("m") - width, F.lit(0)))
        bands = F.transform(starts, _window_bands(width))
        out += [r.asDict() | {"class": least} for r in own.select("name", "m", "hashes", "shingles", bands.alias("bands")).collect()]
    return out


def _window_bands(width: int):
    return lambda s: _bands(F.col("words"), s, width)


def license_scan(docs: DataFrame, templates: dict[str, str] | None = None, share: float = SHARE) -> DataFrame:
    """doc_id, template, containment, first_word, windows of every match."""
    spark = docs.sparkSession
    known = prepared(spark, templates or TEMPLATES)
    base = once(pick(docs, "doc_id", "text").withColumn("row", F.monotonically_increasing_id()), "words", _words(F.col("text"))).where(F.size("words") >= SIZE)
    every = ", ".join(f"{h}L" if h > -(1 << 63) else "-9223372036854775807L - 1L" for h in sorted({h for t in known for h in t["hashes"]}))
    shingle = ", ".join(f"get(words, p + {i})" for i in range(SIZE))
    hits = F.expr(f"filter(sequence(0, size(words) - {SIZE}), p -> xxhash64({shingle}) in ({every}))")
    base = once(base.select("row", "doc_id", "words"), "hits", hits).where(F.size("hits") > 0)
    windows = F.flatten(F.array(*[_windows(c) for c in CLASSES if any(t["class"] == c[0] for t in known)]))
    found = base.select("row", "doc_id", "words", F.explode(windows).alias("w"))
    found = found.select("row", "doc_id", "words", F.col("w.class").alias("class"), F.col("w.width").alias("width"), F.col("w.start").alias("start"), F.posexplode("w.bands").alias("band", "key"))
    keys = sorted({(t["class"], i, k, t["name"], t["m"]) for t in known for bands in t["bands"] for i, k in enumerate(bands)})
    # At most BANDS * MOST_SHINGLES rows.
    table = F.broadcast(spark.createDataFrame(keys, "class int, band int, key long, template string, m int"))
    met = found.join(table, ["class", "band", "key"])
    left = F.greatest(F.col("start") - F.col("m"), F.lit(0))
    near = F.slice(F.col("words"), left + 1, F.col("start") + F.col("width") + F.col("m") + (SIZE - 1) - left)
    # A window that meets a template in several bands is verified once.
    met = met.select("row", "doc_id", "class", "start", "template", near.alias("near")).dropDuplicates(["row", "class", "start", "template"])
    exact = F.broadcast(spark.createDataFrame([(t["name"], t["shingles"]) for t in known], "template string, shingles array<string>"))
    met = once(met.join(exact, "template"), "own", _shingles(F.col("near")))
    met = met.withColumn("containment", F.size(F.array_intersect("shingles", "own")) / F.size("shingles"))
    matches = met.where(F.col("containment") >= share).groupBy("doc_id", "template")
    return matches.agg(F.round(F.max("containment"), 6).alias("containment"), F.min("start").cast("long").alias("first_word"), F.count("*").alias("windows"))


def _windows(c: tuple[int, int, int]) -> Column:
    """The class's windows that hold a hit, with their bands."""
    least, width, step = c
    words, n = F.col("words"), _count(F.col("words"))
    # Starts are multiples of step, and the last whole window of the text.
    last = F.greatest(n - width, F.lit(0))
    down = lambda x: F.floor(x / step).cast("int") * step
    first = lambda p: F.least(down(F.greatest(p - (width - 1) + (step - 1), F.lit(0))), down(p))
    starts = F.transform(F.col("hits"), lambda p: F.concat(F.sequence(first(p), down(p), F.lit(step)), F.array(F.when(p >= last, last))))
    kept = F.array_distinct(F.filter(F.flatten(starts), lambda s: s.isNotNull() & (s <= last)))
    return F.transform(kept, lambda s: F.struct(F.lit(least).alias("class"), F.lit(width).alias("width"), s.alias("start"), _bands(words, s, width).alias("bands")))


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return license_scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
