"""License texts in documents: MinHash bands of overlapping windows, then exact containment; DataFrame functions only.

Words are runs of letters and digits, lower-cased; shingles are five words.  A template of n words belongs to the size
class C, the power of two from n on; windows of a class have 2 C words and start every C words, so any place of n
words lies within one.  A window that holds a template in the sense of ``SHARE`` has at least m = ceil(SHARE s) of its s
shingles in common with it and 2 C - 4 shingles itself, so their Jaccard similarity is at least m / (2 C - 4 + s - m).
One row of MinHash meets with that chance; a class gets as many one-row bands as its least similar template needs for
all of them to miss with less than ``MISS``.  What meets is verified by the exact share of the template's shingles.

A document, and then a window, without a single shingle of any template of the class can hold none and gets no bands.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.llm.tables import materialise, texts, where_computed

K, SHARE, MISS = 5, 0.8, 1e-6

# Names and texts of public license notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "mit": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the "
        "Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, "
        "and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT "
        "LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY "
        "CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER "
        "DEALINGS IN THE SOFTWARE."
    ),
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" "
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."
    ),
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, "
        "either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
        "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details."
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code "
        "must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this "
        "list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
    ),
    "mpl-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/."
    ),
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "all-rights": "All rights reserved. No part of this publication may be reproduced, distributed, or transmitted in any form or by any means without the prior written permission of the publisher.",
}


def _words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")


def _shingles(words: Column) -> Column:
    starts = F.when(F.size(words) >= K, F.sequence(F.lit(0), F.size(words) - K)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*[F.get(words, i + j) for j in range(K)]))


def bands_of(size: int, shingles: int) -> int:
    """One-row bands that a template of so many shingles needs in windows of its class."""
    least = next(m for m in range(shingles + 1) if m / shingles >= SHARE)
    similarity = least / (max(2 * size - (K - 1), shingles) + shingles - least)
    return 1 if similarity >= 1 else math.ceil(math.log(MISS) / math.log(1 - similarity))


def _bands(shingles: Column, number: Column) -> Column:
    """(band, least hash) of the first ``number`` bands."""
    return F.transform(F.sequence(F.lit(0), number - 1), lambda b: F.struct(b.alias("band"), F.array_min(F.transform(shingles, lambda h: F.xxhash64(h, b))).alias("key")))


def scan(docs: DataFrame, templates: dict[str, str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document and template found in it: ``doc_id, license, share, first_word``.

    ``share`` is the largest share of the template's shingles in one window, at least ``SHARE``; ``first_word`` is
    where the first such window starts.  Null and empty texts hold nothing; rows that repeat an id are one document, of
    null ids too; other columns are ignored; no rows give no rows.  A template needs at least five words (ValueError).
    """
    spark = docs.sparkSession
    given = templates if templates is not None else TEMPLATES
    known = spark.createDataFrame(sorted(given.items()), "license string, body string")
    known = known.withColumn("words", _words(F.col("body"))).withColumn("own", F.array_distinct(_shingles(F.col("words"))))
    rows = known.select("license", F.size("words").alias("n"), "own").collect()  # as many rows as templates
    if any(not r["own"] for r in rows):
        raise ValueError("a template needs at least five words")
    size = lambda n: 1 << (n - 1).bit_length()
    sizes = sorted({size(r["n"]) for r in rows})
    bands = {s: max(bands_of(s, len(r["own"])) for r in rows if size(r["n"]) == s) for s in sizes}
    table = spark.createDataFrame([(r["license"], size(r["n"]), r["own"]) for r in rows], "license string, size int, own array<bigint>")
    of_class = {s: sorted({h for r in rows if size(r["n"]) == s for h in r["own"]}) for s in sizes}
    every = F.lit(sorted({h for own in of_class.values() for h in own}))
    number, wanted = F.lit(None).cast("int"), F.array().cast("array<bigint>")
    for s in sizes:
        number, wanted = F.when(F.col("size") == s, F.lit(bands[s])).otherwise(number), F.when(F.col("size") == s, F.lit(of_class[s])).otherwise(wanted)

    hashed = texts(docs, id_col, text_col).withColumn("words", _words(F.col("text"))).select("doc_id", _shingles(F.col("words")).alias("h"))
    some = materialise(where_computed(hashed, F.arrays_overlap("h", every)), "license-shingles")
    windows = some.select("doc_id", "h", F.explode(F.array(*[F.lit(s) for s in sizes])).alias("size"))
    # Windows are cut before they become rows, so that no row carries its whole document.
    starts = F.sequence(F.lit(0), F.size("h") - 1, F.col("size"))
    cut = F.transform(starts, lambda i: F.struct(i.alias("first_word"), F.array_distinct(F.slice("h", i + 1, 2 * F.col("size") - (K - 1))).alias("near")))
    windows = windows.select("doc_id", "size", F.explode(cut).alias("w")).select("doc_id", "size", "w.first_word", "w.near")
    windows = where_computed(windows, F.arrays_overlap("near", wanted))
    marked = windows.select("doc_id", "size", "first_word", "near", F.explode(_bands(F.col("near"), number)).alias("b")).select("doc_id", "size", "first_word", "near", "b.band", "b.key")
    marks = table.select("license", "size", "own", F.explode(_bands(F.col("own"), number)).alias("b")).select("license", "size", "own", "b.band", "b.key")
    met = marked.join(F.broadcast(marks), ["size", "band", "key"]).select(
        "doc_id", "license", "first_word", (F.size(F.array_intersect("near", "own")) / F.size("own")).alias("share")
    )
    return met.where(F.col("share") >= SHARE).groupBy("doc_id", "license").agg(F.max("share").alias("share"), F.min("first_word").cast("long").alias("first_word"))
