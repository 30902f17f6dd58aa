"""License scans by MinHash bands over overlapping text windows, in DataFrame functions only.

Words are lower-cased runs outside [\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]; a shingle is five words. A template
matches a document that holds at least 0.8 of its distinct shingles, anywhere in the whole text.

Templates are cut into windows of z shingles at every position, z being the largest of SIZES that is at
most half of the template's length; documents into windows of each z, a quarter of z apart. A window's
signature is BANDS x ROWS MinHash values. A pair of windows with Jaccard similarity s shares a band with
probability 1 - (1 - s^ROWS)^BANDS: above 0.9999 at s = 0.67 for 16 bands of 2, and 1 where a copy is
verbatim. Every template with a shared band is verified by exact containment, so nothing false is
reported. Windows without any template shingle cannot share a MinHash value and get no signature.

Defined cases: null and empty texts and texts of under five words have no shingles, so such a document has
no license and such a template is never found; give templates of five words or more. Repeated rows are
reported each; a null doc_id is an id like any other. A very long text is scanned whole by one task, in
time that grows with its length and with the template shingles that it holds. Extra columns, whatever
their names, are not read. Without documents there are no rows, without templates no licenses.

Scale: one pass over the text keeps shingle hashes of texts with a template shingle only, and is cut().
Templates are a small table that the driver reads and the plan holds, in blocks of at most BLOCK distinct
shingles (some 4,000 words of templates), each with a search of its own.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

SHINGLE = 5
SHARE = 0.8
SIZES = (1, 2, 4, 8, 16)
BANDS, ROWS = 16, 2
BLOCK = 4096

#: Notices, grants and short texts of public licenses.
TEMPLATES = {
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.',
    "bsd-2-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-3-clause": 'Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.',
    "cc-by-4.0-notice": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mit-grant": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.',
    "mit-full": 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.',
    "mit-notice": "Released under the MIT License.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
}


def default_templates(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TEMPLATES.items()), "template_id string, text string")


def _with_shingles(df: DataFrame, text: str) -> DataFrame:
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), lambda w: w != "")
    hashed = F.transform(F.sequence(F.lit(1), F.size("__words") - SHINGLE + 1), lambda i: F.xxhash64(F.slice("__words", i, SHINGLE)))
    none = F.array().cast("array<bigint>")
    return df.withColumn("__words", words).withColumn("sh", F.when(F.size("__words") >= SHINGLE, hashed).otherwise(none)).drop("__words")


def _signed(windows: DataFrame, keep: list[str]) -> DataFrame:
    """windows: keep and own (array of shingle hashes). Returns keep, band, value: a row for each band."""
    bands = []
    for band in range(BANDS):
        low = [F.array_min(F.transform("own", lambda x, j=band * ROWS + row: F.xxhash64(x, F.lit(j)))) for row in range(ROWS)]
        bands.append(F.xxhash64(F.lit(band), *low))
    return windows.select(*keep, F.posexplode(F.array(*bands)).alias("band", "value"))


def _windows(df: DataFrame, starts: Column, size: Column, keep: list[str]) -> DataFrame:
    return df.select(*keep, "sh", size.alias("z"), F.explode(starts).alias("start")).select(*keep, "z", F.slice("sh", F.col("start") + 1, F.col("z")).alias("own"))


def _matches(rows: DataFrame, templates: DataFrame, known: list[int], share: float) -> DataFrame:
    """row, template_id, containment of one block of templates; rows: row, sh."""
    z = F.coalesce(*[F.when(F.size("sh") >= 2 * s, s) for s in reversed(SIZES) if s > 1], F.lit(1))
    cut_up = templates.withColumn("z", z)
    signed = _signed(_windows(cut_up, F.sequence(F.lit(0), F.size("sh") - F.col("z")), F.col("z"), ["template_id"]), ["template_id", "z"]).distinct()
    known_array = F.array(*[F.lit(k) for k in known])
    # The template shingles that a text holds, by hashing, once (as an argument of a lambda they are not computed again
    # at each position); its positions are held against these few only.
    shared = F.array(F.array_intersect("sh", known_array))
    at = F.flatten(F.transform(shared, lambda own: F.filter(F.sequence(F.lit(0), F.size("sh") - 1), lambda i: F.array_contains(own, F.get("sh", i)))))
    hits = cut(rows.where(F.arrays_overlap("sh", known_array)).withColumn("at", at))
    found = None
    for size in SIZES:
        step = max(1, size // 4)
        # Starts, multiples of step, of the windows that cover a position held by some template.
        cover = F.array_distinct(F.flatten(F.transform("at", lambda p: F.sequence(F.ceil(F.greatest(p - size + 1, F.lit(0)) / step).cast("int") * step, F.floor(p / step).cast("int") * step, F.lit(step)))))
        windows = _windows(hits.where(F.size("sh") >= size), cover, F.lit(size), ["row"])
        found = windows if found is None else found.unionByName(windows)
    banded = _signed(found, ["row", "z"]).distinct()
    pairs = banded.join(F.broadcast(signed), ["z", "band", "value"]).select("row", "template_id").distinct()
    own = F.array_distinct("t_sh")
    held = F.size(F.array_intersect(own, "sh")) / F.size(own)
    return pairs.join(hits.select("row", "sh"), "row").join(F.broadcast(templates.select("template_id", F.col("sh").alias("t_sh"))), "template_id").select("row", "template_id", held.alias("containment")).where(F.col("containment") >= share)


def license_scan(docs: DataFrame, templates: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per document: id_col, n_licenses, licenses (ids in order, comma-joined), containment (the highest)."""
    spark = docs.sparkSession
    shingled = _with_shingles((default_templates(spark) if templates is None else templates).select("template_id", "text"), "text").where(F.size("sh") > 0).select("template_id", "sh")
    listed = [(r["template_id"], list(r["sh"])) for r in shingled.toLocalIterator()]
    blocks, kinds = [[]], set()
    for template, sh in sorted(listed):
        if kinds and len(kinds | set(sh)) > BLOCK:
            blocks.append([])
            kinds = set()
        blocks[-1].append((template, sh))
        kinds |= set(sh)
    narrow = _with_shingles(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), "text").select("id", F.monotonically_increasing_id().alias("row"), "sh")
    # What holds no template shingle is not kept, whatever the number of templates.
    held = [F.arrays_overlap("sh", F.array(*[F.lit(k) for k in sorted({x for _, sh in block for x in sh})])) for block in blocks if block]
    rows = cut(narrow.withColumn("sh", F.when(reduce(or_, held, F.lit(False)), F.col("sh"))))
    found = None
    for block in blocks:
        if block:
            one = _matches(rows.where("size(sh) > 0").select("row", "sh"), spark.createDataFrame(block, "template_id string, sh array<long>"), sorted({x for _, sh in block for x in sh}), share)
            found = one if found is None else found.unionByName(one)
    if found is None:
        return rows.select(F.col("id").alias(id_col), F.lit(0).cast("long").alias("n_licenses"), F.lit("").alias("licenses"), F.lit(0.0).alias("containment"))
    by_row = found.groupBy("row").agg(F.array_sort(F.collect_set("template_id")).alias("ids"), F.max("containment").alias("containment"))
    return rows.select("id", "row").join(by_row, "row", "left").select(
        F.col("id").alias(id_col), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_licenses"), F.coalesce(F.array_join("ids", ","), F.lit("")).alias("licenses"), F.coalesce("containment", F.lit(0.0)).alias("containment")
    )
