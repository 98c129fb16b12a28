"""License scan: MinHash bands over overlapping text windows, verified by exact containment.

Windows of `w` shingles start every w / 2 shingles, so a passage of up to w / 2 + 1 shingles lies
whole in one of them. A template of m shingles belongs to the smallest window size, a power of two,
that covers it, and such a window's Jaccard similarity to it is at least about 1 / 4. Each band is one
MinHash row, and there are as many bands as make a miss rarer than `miss`:
(1 - 1 / 4) ^ bands <= miss. A window that agrees with a template in any band is a candidate, and
the exact share of the template's five-word shingles that the window holds decides (0.8 or more).

A window can only agree with a template in a band if it holds the template's minimal shingle of that
band. So windows are hashed only around shingles that are minimal for some template and band; all
other windows would fail every band. Everything is DataFrame functions over whole texts, each row on
its own: nothing is shuffled, and only the templates' signatures travel with the plan.

Defined cases: null, empty and short texts (under five words) have no shingles and no match; repeated
rows each get a result; an empty table or no templates give no matches.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHINGLE = 5
CONTAINED = 0.8
MISS = 0.001

# Wording of widely used license notices.
TEMPLATES = {
    "mit-line": "Released under the MIT License.",
    "apache-2.0-line": "Licensed under the Apache License, Version 2.0.",
    "cc-by-nc-4.0-line": "Licensed under CC BY-NC 4.0.",
    "gpl-3.0-line": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-4.0-line": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was "
    "not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in "
    "compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
    "required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS "
    "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific "
    "language governing permissions and limitations under the License.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
    "later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even "
    "the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for "
    "more details.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the Software), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice "
    "and this permission notice shall be included in all copies or substantial portions of the Software.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
    "granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
    "following conditions are met: Redistributions of source code must retain the above copyright notice, this list of "
    "conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the "
    "distribution.",
    "unlicense": "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, "
    "publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any "
    "purpose, commercial or non-commercial, and by any means.",
}


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def places(count: Column) -> Column:
    """0 to count - 1, nothing for a count below 1."""
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def shingle_hashes(own: Column) -> Column:
    """A 64-bit hash of every run of five words."""
    return F.transform(places(F.size(own) - (SHINGLE - 1)), lambda i: F.xxhash64(*[F.get(own, i + k) for k in range(SHINGLE)]))


def window_size(shingles: int) -> int:
    """The smallest power of two, 2 at least, whose windows cover so many shingles wherever they lie."""
    return max(2, 1 << (2 * (shingles - 1) - 1).bit_length()) if shingles > 1 else 2


def least_similarity(shingles: int, size: int, contained: float) -> float:
    """Of a full window that holds just the share `contained` of a template's shingles, among others."""
    held = math.ceil(contained * shingles)
    return held / (size + shingles - held)


def bands(miss: float, similarity: float) -> list[int]:
    """Seeds of the bands: as many as keep a miss at that similarity below `miss`."""
    n = math.ceil(math.log(miss) / math.log1p(-similarity))
    seeds = ((k + 1) * 0x9E3779B97F4A7C15 & (1 << 64) - 1 for k in range(n))
    return [s - (1 << 64) if s >> 63 else s for s in seeds]


def scan(docs: DataFrame, templates: dict[str, str] | None = None, contained: float = CONTAINED, miss: float = MISS) -> DataFrame:
    """doc_id, matches (array of template, window, size, share): one row for each row of docs.

    window is the first shingle of a matching window, size its length. templates are a bounded
    list that travels with the plan.
    """
    spark = docs.sparkSession
    templates = TEMPLATES if templates is None else templates
    known = spark.createDataFrame(sorted(templates.items()), "name string, text string").select("name", words(F.col("text")).alias("w"))
    known = known.select("name", "w", shingle_hashes(F.col("w")).alias("h")).collect()
    if short := [row["name"] for row in known if not row["h"]]:
        raise ValueError(f"templates of under {SHINGLE} words have no shingle to match: {', '.join(short)}")
    if not known:
        return docs.select("doc_id", F.array().cast("array<struct<template:string,window:int,size:int,share:double>>").alias("matches"))
    # For each minimal shingle, (template, window size, seed) of the bands it is minimal in.
    signature: dict[int, list[tuple[int, int, int]]] = {}
    for t, row in enumerate(known):
        shingles = len(set(row["h"]))
        size = window_size(shingles)
        for seed in bands(miss, least_similarity(shingles, size, contained)):
            signature.setdefault(min(row["h"], key=lambda v: v ^ seed), []).append((t, size, seed))
    band = F.create_map(*[x for key, rows in signature.items() for x in (F.lit(key), F.array(*[F.struct(F.lit(t).alias("t"), F.lit(size).alias("size"), F.lit(seed).alias("seed")) for t, size, seed in rows]))])
    names = F.array(*[F.lit(row["name"]) for row in known])
    sets = F.array(*[F.array(*map(F.lit, sorted(grams(row["w"])))) for row in known])

    rows = docs.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", "w", shingle_hashes(F.col("w")).alias("h"))
    minimal = list(signature)
    hits = F.filter(places(F.size("h")), lambda i: F.get("h", i).isin(minimal))
    rows = rows.select("doc_id", "w", "h", hits.alias("hits"))

    def around(i: Column) -> Column:
        """The two windows that hold shingle i, for each template and band it is minimal in."""
        first = lambda b: (i - i % (b["size"] / 2).cast("int")).cast("int")
        one = lambda b, start: F.struct(b["t"].alias("t"), b["size"].alias("size"), b["seed"].alias("seed"), start.alias("start"), F.get("h", i).alias("low"))  # noqa: E731, E501
        own = F.element_at(band, F.get("h", i))
        return F.concat(
            F.transform(own, lambda b: one(b, first(b))),
            F.transform(F.filter(own, lambda b: first(b) > 0), lambda b: one(b, first(b) - (b["size"] / 2).cast("int"))),
        )

    rows = rows.select("doc_id", "w", "h", F.flatten(F.transform("hits", around)).alias("near"))
    agrees = lambda c: F.array_min(F.transform(F.slice("h", c["start"] + 1, c["size"]), lambda v: v.bitwiseXOR(c["seed"]))) == c["low"].bitwiseXOR(c["seed"])  # noqa: E731, E501
    found = F.transform(F.filter("near", agrees), lambda c: F.struct(c["t"].alias("t"), c["start"].alias("start"), c["size"].alias("size")))
    rows = rows.select("doc_id", "w", F.array_distinct(found).alias("candidates"))

    def share(c: Column) -> Column:
        text = F.transform(
            F.sequence(c["start"], F.least(c["start"] + c["size"], F.size("w") - (SHINGLE - 1)) - 1),
            lambda i: F.array_join(F.slice("w", i + 1, SHINGLE), " "),
        )
        own = F.get(sets, c["t"])
        return F.size(F.array_intersect(own, text)) / F.size(own)

    judged = F.transform("candidates", lambda c: F.struct(F.get(names, c["t"]).alias("template"), c["start"].alias("window"), c["size"].alias("size"), share(c).alias("share")))  # noqa: E501
    return rows.select("doc_id", F.array_sort(F.filter(judged, lambda m: m["share"] >= contained)).alias("matches"))


def grams(own: list[str]) -> set[str]:
    return {" ".join(own[i : i + SHINGLE]) for i in range(len(own) - SHINGLE + 1)}
