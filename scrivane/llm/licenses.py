"""License scans in DataFrame operations only.

A text's words (runs of letters and digits, lower-cased) give hashed five-word
shingles. Every template is compared with overlapping windows of the text: a
window is ``length + stride - 1`` words long, windows begin every ``stride``
words, so some window holds any whole occurrence. Windows retrieve templates by
MinHash: BANDS bands of one row each, and a window is a candidate if one band's
minimum equals the template's. Candidates are verified by exact containment:
the share of the template's shingles that the window holds.

Settings. With stride max(2, words // 2) a window with a whole occurrence has a
Jaccard similarity of at least 1/2 with the template, and one that holds the
least containment of 0.8 about 0.4; a band misses it with probability 0.6, all 24
bands with 5e-6.

Retrieval is by (band, minimum): the templates' minima are a table of bands and
the shingles that are minimal in them. A window's minimum in a band can equal a
template's only if the window holds that very shingle, so one pass over the hashed
shingles marks where such minima stand, and windows are made around marks only,
from the neighbouring hashes and not from the whole text. A window is a
candidate if no other of its shingles is smaller in one of the mark's bands.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scrivane.llm._kit import table

SHINGLE = 5
BANDS = 24
LEAST = 0.8
MOST_TEMPLATES = 10_000

#: Notices by SPDX identifier.
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "either version 3 of the License, or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-3-Clause", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("GPL-2.0-only", "it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation"),
    ("GPL-2.0-or-later", "either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1-or-later", "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License"),
    ("AGPL-3.0-only", "it under the terms of the GNU Affero General Public License as published by the Free Software Foundation"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work"),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003"),
    ("Zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)

_BREAK = r"[^\p{L}\p{N}]+"


def template_words(text: str) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower())


def _stride(words: int) -> int:
    return max(2, words // 2)


def _words(text_col: str):
    return F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), _BREAK), lambda w: w != "")


def _shingles(words: str):
    i = [f"{words}[i + {k}]" for k in range(SHINGLE)]
    return F.expr(f"CASE WHEN size({words}) >= {SHINGLE} THEN transform(sequence(0, size({words}) - {SHINGLE}), i -> xxhash64({', '.join(i)})) ELSE array() END")


def scan_licenses(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", templates: tuple[tuple[str, str], ...] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """License notices in every whole text.

    Returns one row for each document and template that it holds: the id,
    license, template (its number in ``templates``), containment (the largest of
    its windows, ``least`` or more), first_word (where the first verified window
    begins) and n_windows (verified windows). Documents without a notice give no
    row, so null, empty and short texts give none. Rows that repeat an id are
    scanned one by one. Other columns are not read. Templates must have five
    words or more; at most MOST_TEMPLATES are broadcast.
    """
    spark = docs.sparkSession
    if len(templates) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    words = [template_words(t) for _, t in templates]
    if any(len(w) < SHINGLE for w in words):
        raise ValueError(f"a template needs {SHINGLE} words")
    rows = [(i, name, _stride(len(w)), len(w) + _stride(len(w)) - 1, w) for i, ((name, _), w) in enumerate(zip(templates, words, strict=True))]
    known = spark.createDataFrame(rows, "template int, license string, stride int, width int, words array<string>").withColumn("tset", F.array_distinct(_shingles("words"))).drop("words")
    # Of each template and band the minimum and the shingle that gives it, gathered by shingle.
    least_ = F.expr(f"transform(sequence(0, {BANDS - 1}), b -> array_min(transform(tset, h -> named_struct('low', xxhash64(h, b), 'a', h, 'b', b))))")
    minima = known.withColumn("_m", F.explode(least_)).groupBy("template", "license", "stride", "width", "tset", F.col("_m.a").alias("_a")).agg(F.collect_list(F.struct("_m.b", "_m.low")).alias("bands"))
    anchors = sorted(r["_a"] for r in minima.select("_a").distinct().collect())
    # The row numbers also keep the optimiser from moving the filter below the projections, where it
    # would split the text anew for every shingle.
    split = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(id_col).alias("_id"), _words(text_col).alias("_w"))
    hashed = split.select("_row", "_id", _shingles("_w").alias("_h"))
    places = F.filter(F.transform("_h", lambda h, i: F.when(h.isin(anchors), i)), lambda i: i.isNotNull())
    marked = hashed.select("_row", "_id", "_h", places.alias("_at"), F.monotonically_increasing_id().alias("_fence")).where(F.size("_at") > 0)
    reach = max(r[3] for r in rows) if rows else 1
    near = F.transform("_at", lambda p: F.struct(p.alias("p"), F.greatest(F.lit(0), p - reach).alias("lo"), F.slice("_h", F.greatest(F.lit(0), p - reach) + 1, 2 * reach + 1).alias("h")))
    hits = marked.select("_row", "_id", F.explode(near).alias("_n")).select("_row", "_id", "_n.*").withColumn("_a", F.element_at("h", F.col("p") - F.col("lo") + 1))
    met = hits.join(F.broadcast(minima), "_a")
    lo = F.greatest(F.lit(0), F.ceil((F.col("p") - (F.col("width") - SHINGLE)) / F.col("stride")).cast("int"))
    windows = met.withColumn("_k", F.explode(F.sequence(lo, F.floor(F.col("p") / F.col("stride")).cast("int"))))
    windows = windows.withColumn("_win", F.slice("h", F.col("_k") * F.col("stride") - F.col("lo") + 1, F.col("width") - SHINGLE + 1)).drop("h", "p", "lo")
    found = windows.where(F.expr("exists(bands, m -> array_min(transform(_win, h -> xxhash64(h, m.b))) = m.low)"))
    verified = found.withColumn("_c", F.size(F.array_intersect("_win", "tset")) / F.size("tset")).where(F.col("_c") >= least)
    best = verified.groupBy("_row", "template").agg(F.first("_id").alias("_id"), F.first("license").alias("license"), F.max("_c").alias("containment"), F.min(F.col("_k") * F.col("stride")).cast("long").alias("first_word"), F.count_distinct("_k").alias("n_windows"))
    return best.select(F.col("_id").alias(id_col), "license", "template", "containment", "first_word", "n_windows")


def op9_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _sql() -> str:
    rows = []
    for i, (name, text) in enumerate(TEMPLATES):
        w = template_words(text)
        rows += [f"({i}, '{name}', {_stride(len(w))}, {len(w) + _stride(len(w)) - 1}, '{' '.join(w[k : k + SHINGLE])}')" for k in range(len(w) - SHINGLE + 1)]
    return f"""
WITH t AS (SELECT DISTINCT * FROM (VALUES {', '.join(rows)}) AS v(template, license, stride, width, shingle)),
n AS (SELECT template, count(*) AS n FROM t GROUP BY template),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\\p{{L}}\\p{{N}}]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, p, array_to_string(w[p + 1 : p + {SHINGLE}], ' ') AS shingle
      FROM (SELECT doc_id, w, unnest(range(0, len(w) - {SHINGLE - 1})) AS p FROM w WHERE len(w) >= {SHINGLE})),
hit AS (SELECT doc_id, template, license, stride, width, p, s.shingle FROM s JOIN t ON s.shingle = t.shingle),
win AS (SELECT doc_id, template, license, stride, shingle,
               unnest(range(greatest(0, CAST(ceil((p - (width - {SHINGLE})) / CAST(stride AS DOUBLE)) AS BIGINT)), p // stride + 1)) AS k FROM hit),
c AS (SELECT doc_id, template, license, stride, k, count(DISTINCT shingle) AS shared FROM win GROUP BY ALL)
SELECT doc_id, license, template, max(shared / CAST(n AS DOUBLE)) AS containment, min(k * stride) AS first_word, count(*) AS n_windows
FROM c JOIN n USING (template) WHERE shared / CAST(n AS DOUBLE) >= {LEAST} GROUP BY doc_id, license, template
"""


SQL = {"op9_license_scan": _sql()}
