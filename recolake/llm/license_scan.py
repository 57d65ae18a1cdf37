"""License scans over overlapping text windows (DataFrame operations only).

Texts and templates become lower-case words; a unit is a run of five words (shingle). A template of n
shingles falls in the class of the next power of two; the windows of that class hold CLASS + step shingles and start
every max(1, CLASS / 4), so that some window holds any occurrence of the template with a Jaccard similarity of at least 0.4
when all of it is there (1 for a template of one shingle, whose windows are single shingles).

Retrieval: BANDS MinHash bands of one row each. Two sets of similarity s share a band with probability
1 - (1 - s) ** BANDS: for s = 0.4 and 24 bands that is above 0.99999. A window can only share a band if it holds a shingle that is a
template's minimum, so texts without any such shingle (a set that the templates bound) are passed
over before windows are formed. Verification: the share of the template's shingles in the window is exact,
and PERCENT of them must be there. Where the text of another license's template holds as much of a template (GPL-2.0 of GPL-3.0,
LGPL of GPL), the window must also hold a shingle that the other lacks, so that a notice is not taken for a kindred one.

Short templates (fewer than five words, a table of their own) are one shingle each, the whole sequence; their windows are all
runs of as many words, and only the same words in the same order count (containment 1). The table of templates refuses them.

Defined results: a null text, or one without words, has no window and no row, one of fewer than five words only
those of short templates; several windows with the same template count once, with the best containment, the
position of the first shared word (the smallest among the best), and the number of windows; rows that repeat a doc_id are one document each time
they are scanned and come together in one row; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

WORDS = 5
BANDS = 24
PERCENT = 75

# fixed values: the usual notices of public licenses, by SPDX identifier; "BSD" is the opening that BSD-2-Clause and BSD-3-Clause share
NOTICES = {
    "AGPL-3.0": [
        "GNU Affero General Public License, version 3",
        "GNU Affero General Public License v3.0",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the "
        "Free Software Foundation, either version 3 of the License",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed "
        'on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
        "following conditions are met",
    ],
    "BSD-3-Clause": [
        "nor the names of its contributors may be used to endorse or promote products derived from this software without "
        "specific prior written permission",
    ],
    "CC-BY-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License", "Licensed under CC BY 4.0"],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ],
    "CC-BY-NC-ND-4.0": [
        "Licensed under CC BY-NC-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
    ],
    "CC-BY-NC-SA-4.0": [
        "Licensed under CC BY-NC-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
    ],
    "CC-BY-ND-4.0": [
        "Licensed under CC BY-ND 4.0",
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
    ],
    "CC-BY-SA-4.0": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ],
    "CC0-1.0": ["has waived all copyright and related or neighboring rights to"],
    "GPL-2.0": [
        "GNU General Public License, version 2",
        "GNU General Public License v2.0",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation; either version 2 of the License",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
        "Free Software Foundation, either version 3 of the License",
        "GNU General Public License, version 3",
        "GNU General Public License v3.0",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "LGPL-2.1": [
        "GNU Lesser General Public License, version 2.1",
        "GNU Lesser General Public License v2.1",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation; either version 2.1 of the License",
    ],
    "LGPL-3.0": [
        "GNU Lesser General Public License, version 3",
        "GNU Lesser General Public License v3.0",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the "
        "Free Software Foundation, either version 3 of the License",
    ],
    "MIT": [
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction',
    ],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"],
}

# fixed values: notices of fewer than five words
SHORT_NOTICES = {
    "LicenseRef-All-Rights-Reserved": ["All rights reserved"],
    "Apache-2.0": ["Apache License 2.0", "Apache License, Version 2.0"],
    "BSD-2-Clause": ["BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"],
    "BSD-3-Clause": ["BSD 3-Clause License", "3-Clause BSD License", "New BSD License", "Modified BSD License"],
    "CC-BY-4.0": ["CC BY 4.0"],
    "CC-BY-NC-4.0": ["CC BY-NC 4.0"],
    "CC-BY-NC-ND-4.0": ["CC BY-NC-ND 4.0"],
    "CC-BY-NC-SA-4.0": ["CC BY-NC-SA 4.0"],
    "CC-BY-ND-4.0": ["CC BY-ND 4.0"],
    "CC-BY-SA-4.0": ["CC BY-SA 4.0"],
    "CC0-1.0": ["CC0 1.0 Universal"],
    "ISC": ["ISC License"],
    "MIT": ["MIT License"],
    "MPL-2.0": ["Mozilla Public License 2.0"],
} | {name: [] for name in ("AGPL-3.0", "GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0")}
for _name, _texts in SHORT_NOTICES.items():
    if not _name.startswith("LicenseRef"):
        _ends = ("", "-only", "-or-later") if "GPL" in _name else ("",)
        _texts += [f"SPDX-License-Identifier: {_name}{_end}" for _end in _ends]


def templates(spark: SparkSession, notices: dict[str, list[str]] = NOTICES, mark: str = "") -> DataFrame:
    """template_id, license, text."""
    rows = [(f"{name}/{mark}{i}", name, text) for name, texts in notices.items() for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "template_id string, license string, text string")


def short_templates(spark: SparkSession, notices: dict[str, list[str]] = SHORT_NOTICES) -> DataFrame:
    """template_id, license, text; the ids differ from those of ``templates``."""
    return templates(spark, notices, "short-")


def words(text: Column) -> Column:
    """Lower-case words: runs of letters, digits and points inside numbers; everything else separates."""
    plain = F.lower(F.coalesce(text.cast("string"), F.lit("")))
    return F.regexp_extract_all(plain, F.lit(r"[\p{L}\p{N}]+(?:[.-][\p{L}\p{N}]+)*"), F.lit(0))


def _run(w: Column, size: int):
    return lambda i: F.xxhash64(*[w[i + k] for k in range(size)])


def shingles(w: Column, size: int = WORDS) -> Column:
    """The hashes of all runs of five (or ``size``) words, in order; empty for fewer words."""
    n = F.size(w)
    return F.when(n < size, F.array().cast("array<bigint>")).otherwise(F.transform(F.sequence(F.lit(0), n - size), _run(w, size)))


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """The rows with a column that is computed once a row: as a generated column it is never written
    out again inside the expressions that use it."""
    return rows.select("*", F.explode(F.array(value)).alias(name))


def _permuted(band: int):
    return lambda x: F.struct(F.xxhash64(F.lit(band), x).alias("h"), x.alias("s"))


def minima(s: Column) -> list[Column]:
    """The MinHash of each band: the smallest hash under the band's permutation, with the shingle it comes from."""
    return [F.array_min(F.transform(s, _permuted(b))) for b in range(BANDS)]


def minimum_shingles(s: Column) -> Column:
    """The shingles at which the bands' minima lie."""
    return F.array_distinct(F.array(*[m["s"] for m in minima(s)]))


def _windows_from(size: int, width: int):
    return lambda i: F.struct(F.lit(size).alias("class"), i.alias("start"), F.slice("s", i + 1, F.lit(width)).alias("ws"))


def _short_windows(w: Column, size: int, keys: list[int]) -> Column:
    """The windows of ``size`` words that are one of the keys."""
    n, run = F.size(w), _run(w, size)
    starts = F.when(n < size, F.array().cast("array<int>")).otherwise(
        F.filter(F.sequence(F.lit(0), n - size), lambda i: run(i).isin(keys)))
    return F.transform(starts, lambda i: F.struct(F.lit(-size).alias("class"), i.alias("start"), F.array(run(i)).alias("ws")))


def _template_sets(table: DataFrame) -> DataFrame:
    """template_id, license, ts (distinct shingles), class."""
    t = _once(table.select("template_id", "license", "text"), "w", words(F.col("text")))
    t = t.select("template_id", "license", F.array_distinct(shingles(F.col("w"))).alias("ts"))
    small = t.filter(F.size("ts") == 0).select("template_id").limit(1).collect()
    if small:
        raise ValueError(f"template {small[0].template_id} has fewer than {WORDS} words: it goes into the table of short templates")
    return t.withColumn("class", F.pow(F.lit(2), F.ceil(F.log2(F.size("ts")))).cast("int"))


def _with_musts(sets: DataFrame) -> DataFrame:
    """A column ``musts``: for every template of another license whose text holds PERCENT of this one, the shingles that it lacks."""
    a = sets.select("template_id", "license", "class", "ts", F.explode("ts").alias("x"))
    b = sets.select(F.col("template_id").alias("other"), F.col("license").alias("other_license"), F.col("ts").alias("other_ts"), F.explode("ts").alias("x"))
    kin = a.join(b, "x").filter("license <> other_license").groupBy("template_id", "other", "ts", "other_ts").count()
    kin = kin.filter(F.col("count") * 100 >= F.size("ts") * PERCENT).withColumn("must", F.array_except("ts", "other_ts")).filter(F.size("must") > 0)
    musts = kin.groupBy("template_id").agg(F.collect_list("must").alias("musts"))
    return sets.join(musts, "template_id", "left").withColumn("musts", F.coalesce("musts", F.array().cast("array<array<bigint>>")))


def _short_sets(table: DataFrame) -> DataFrame:
    """template_id, license, ts (the whole sequence as one shingle), class (minus the number of words)."""
    t = _once(table.select("template_id", "license", "text"), "w", words(F.col("text")))
    n = F.size("w")
    other = t.filter((n == 0) | (n >= WORDS)).select("template_id").limit(1).collect()
    if other:
        raise ValueError(f"short template {other[0].template_id} has no words or {WORDS} and more")
    whole = F.coalesce(*[F.when(n == k, shingles(F.col("w"), k)) for k in range(1, WORDS)])
    return t.select("template_id", "license", whole.alias("ts"), (-n).alias("class"))


def scan(docs: DataFrame, table: DataFrame, id_col: str = "doc_id", text_col: str = "text", short: DataFrame | None = None) -> DataFrame:
    """doc_id, license, template_id, containment, first_word, n_windows: the templates of the table, and of the table of
    short ones, found in each document."""
    sets = _template_sets(table)
    t = stored(_with_musts(sets if short is None else sets.unionByName(_short_sets(short))), "license-templates")
    # as many rows and values as the templates have, whatever the corpus
    found = t.select("class", minimum_shingles(F.col("ts")).alias("k")).collect()
    keys = {c: sorted({x for r in found if r["class"] == c for x in r.k}) for c in sorted({r["class"] for r in found})}
    if not keys:
        raise ValueError("no templates")
    classes = [c for c in keys if c > 0]
    held = F.array(*[F.lit(k) for c in classes for k in keys[c]]).cast("array<bigint>")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = _once(_once(rows, "w", words(F.col("text"))).select("doc_id", "w"), "s", shingles(F.col("w")))
    brief = [_short_windows(F.col("w"), -c, keys[c]) for c in keys if c < 0]
    none = F.array().cast("array<struct<class:int,start:int,ws:array<bigint>>>")
    rows = _once(rows, "brief", F.concat(none, *brief)).select("doc_id", "s", "brief", F.arrays_overlap("s", held).alias("long"))
    rows = rows.filter(F.col("long") | (F.size("brief") > 0))
    starts = []
    for c in classes:
        step = max(1, c // 4)
        width = c + step if c > 1 else 1
        starts.append(F.transform(F.sequence(F.lit(0), F.size("s") - 1, F.lit(step)), _windows_from(c, width)))
    long = F.filter(F.concat(none, *starts), lambda x: F.arrays_overlap(x["ws"], held))
    windows = rows.select("doc_id", F.explode(F.concat(F.when(F.col("long"), long).otherwise(none), "brief")).alias("w")).select("doc_id", "w.*")
    banded = windows.select("doc_id", "class", "start", "ws", F.posexplode(F.array(*[m["h"] for m in minima(F.col("ws"))])).alias("band", "h"))
    index = t.select("template_id", "license", "ts", "musts", "class", F.posexplode(F.array(*[m["h"] for m in minima(F.col("ts"))])).alias("band", "h"))
    # the index has BANDS rows a template
    met = banded.join(F.broadcast(index), ["class", "band", "h"]).dropDuplicates(["doc_id", "class", "start", "template_id"])
    common = F.size(F.array_intersect("ts", "ws"))
    found = met.withColumn("common", common).filter(F.col("common") * 100 >= F.size("ts") * PERCENT)
    found = found.filter(F.forall("musts", lambda m: F.arrays_overlap(m, F.col("ws"))))
    # where the first shared shingle stands
    first = F.col("start") + F.array_min(F.transform(F.array_intersect("ts", "ws"), lambda x: F.array_position("ws", x))) - 1
    best = F.max(F.struct((F.col("common") / F.size("ts")).alias("c"), (-first).alias("at")))
    return (found.groupBy("doc_id", "license", "template_id").agg(best.alias("b"), F.count(F.lit(1)).alias("n_windows"))
            .select("doc_id", "license", "template_id", F.col("b.c").alias("containment"), (-F.col("b.at")).cast("int").alias("first_word"), "n_windows"))
