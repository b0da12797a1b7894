"""Licences of files: sparse TF-IDF cosine to templates, and inheritance from directories.

A file is read line by line, in overlapping runs of up to RUN lines and by sentences, a licence file (by its name)
also as a whole; an SPDX tag names its licence. A caller may ask for the lines and wholes alone. A line is a vector of
term counts times inverse document frequency, the documents being the templates; terms of no
template count in its length only. A file has the licence of its best line, if that is near
enough to a template. A file with none takes that of the nearest directory above it that has a
licence file with one.

All work is done by DataFrame operations. The templates are a fixed list, so their vectors are small
enough to be sent to all tasks. Before texts and lines are taken apart, those are passed over that cannot
reach the threshold: what each template weighs without its telling terms is too little, and so is what
it weighs in the terms that are there.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from medialog.llm.common import written

THRESHOLD = 0.8
TERM = "[a-z0-9]+(?:[.-][a-z0-9]+)*"
LICENCE_FILE = r"(?i)^(licen[cs]e|copying|notice)([.-].*)?$"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Words too common in any text to tell a licence by. With short words and numbers they are the first to
# be left out of the telling terms.
COMMON = frozenset("a and and or any are be by can file for form in is it may not of or program software source the this to under use with work you".split())

# Lines that are read together, so that a notice may be wrapped.
RUN = 4
SPDX = r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9][A-Za-z0-9.+-]*)"

# fixed: usual notices of public licences
TEMPLATES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", "Apache License, Version 2.0, January 2004. Terms and conditions for use, reproduction, and distribution."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Under the terms of the GNU General Public License as published by the Free Software Foundation."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
)


class Vectors:
    """Template vectors of length one, the frequencies behind them, and the telling terms."""

    def __init__(self, templates: tuple[tuple[str, str], ...], threshold: float):
        counts = [Counter(re.findall(TERM, text.translate(str.maketrans(UPPER, LOWER)))) for _, text in templates]
        spread = Counter(t for c in counts for t in c)
        self.idf = {t: math.log((1 + len(templates)) / (1 + n)) + 1 for t, n in sorted(spread.items())}
        self.other = math.log(1 + len(templates)) + 1
        #: Term, number of the template, its licence, weight.
        self.entries: list[tuple[str, int, str, float]] = []
        telling: set[str] = set()
        for k, (count, (name, _)) in enumerate(zip(counts, templates, strict=True)):
            size = math.sqrt(sum((n * self.idf[t]) ** 2 for t, n in count.items()))
            weight = {t: n * self.idf[t] / size for t, n in sorted(count.items())}
            self.entries += [(t, k, name, w) for t, w in weight.items()]
            left_out = 0.0
            for t in sorted(weight, key=lambda t: (t not in COMMON and len(t) > 2 and not t[0].isdigit(), weight[t], t)):
                left_out += weight[t] ** 2
                if left_out >= (threshold - 1e-9) ** 2:
                    telling.add(t)
        self.telling = sorted(telling)


def _plain(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def unit_scores(units: DataFrame, vectors: Vectors, threshold: float) -> DataFrame:
    """``file``, ``score``, ``licence`` of the best of each file's ``units`` (``file``, ``unit``, ``text``)."""
    spark = units.sparkSession
    idf = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_values(list(vectors.idf.items()))} AS t(term, idf)"))
    entries = F.broadcast(spark.sql(f"SELECT * FROM VALUES {_values(vectors.entries)} AS t(term, template, licence, weight)"))
    terms = units.select("file", "unit", F.explode(F.regexp_extract_all(_plain(F.col("text")), F.lit(f"({TERM})"), 1)).alias("term"))
    counted = terms.groupBy("file", "unit", "term").agg(F.count("*").alias("n")).join(idf, "term", "left")
    weighed = counted.select("file", "unit", "term", (F.col("n") * F.coalesce("idf", F.lit(vectors.other))).alias("w"))
    sizes = weighed.groupBy("file", "unit").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("size"))
    products = weighed.join(entries, "term").groupBy("file", "unit", "template", "licence").agg(F.sum(F.col("w") * F.col("weight")).alias("product"))
    scored = products.join(sizes, ["file", "unit"]).select("file", "licence", F.round(F.col("product") / F.col("size"), 4).alias("score"))
    near = scored.where(F.col("score") >= threshold)
    # The best score, then the licence first by name.
    best = near.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
    return best.select("file", (-F.col("b.s")).alias("score"), F.col("b.licence").alias("licence"))


def scan_licences(files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD, lines_only: bool = False) -> DataFrame:
    """``path``, ``own_licence``, ``own_score``, ``licence``, ``origin``, ``from_dir`` for each path of ``files``
    (``path``, ``text``).

    ``origin`` is ``own``, ``inherited`` or ``none``. Among the licence files of a directory the best score
    counts, then the licence first by name. Null and empty texts have no licence of their own.
    With ``lines_only`` neither runs of lines, sentences nor SPDX tags are read.
    Rows of one path are one file with the lines of all; rows without a path are left out.
    """
    vectors = Vectors(templates, threshold)
    rows = files.select(F.col("path").cast("string").alias("file"), F.col("text").cast("string").alias("text")).where("file IS NOT NULL")
    name = F.substring_index("file", "/", -1)

    def hint(text: Column) -> Column:
        # The one-element array lets a text be lower-cased once for all terms.
        return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [F.contains(low, F.lit(t)) for t in vectors.telling]))

    def reaches(text: Column) -> Column:
        # A line's cosine is at most the length of the template's part that the line has terms of.
        def part(low: Column, k: int) -> Column:
            return reduce(add, [F.when(F.contains(low, F.lit(t)), w * w).otherwise(0.0) for t, n, _, w in vectors.entries if n == k])

        least = (threshold - 1e-6) ** 2
        return F.exists(F.array(F.lower(text)), lambda low: reduce(or_, [part(low, k) >= least for k in range(len(templates))]))

    likely = rows.where(hint(F.col("text"))).where(reaches(F.col("text")))
    pieces = F.split("text", "\n")
    if not lines_only:
        def run(n: int) -> Column:
            every = F.sequence(F.lit(1), F.size(split) - n + 1)
            return F.when(F.size(split) >= n, F.transform(every, lambda k: F.array_join(F.slice(split, k, n), " "))).otherwise(F.array().cast("array<string>"))

        split = F.split("text", "\n")
        sentences = F.split(F.translate("text", "\r\n", "  "), r"(?<=[.;:!?])\s+")
        pieces = F.concat(pieces, sentences, *[run(n) for n in range(2, RUN + 1)])
    lines = likely.select("file", F.posexplode(pieces).alias("unit", "text")).where(hint(F.col("text"))).where(reaches(F.col("text")))
    wholes = likely.where(name.rlike(LICENCE_FILE)).select("file", F.lit(-1).alias("unit"), "text")
    # The units left are few; written, they are found in one scan of the texts.
    units = written(lines.unionByName(wholes), "licence-units")
    scored = unit_scores(units, vectors, threshold)
    if not lines_only:
        tags = rows.where(F.contains("text", F.lit("SPDX-License-Identifier:"))).select("file", F.explode(F.regexp_extract_all("text", F.lit(SPDX), 1)).alias("licence"))
        every = scored.unionByName(tags.select("file", F.lit(1.0).alias("score"), "licence"))
        best = every.groupBy("file").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b"))
        scored = best.select("file", (-F.col("b.s")).alias("score"), F.col("b.licence").alias("licence"))
    own = written(scored, "licences")

    def directory(path: Column) -> Column:
        return F.when(F.contains(path, F.lit("/")), F.substring(path, F.lit(1), F.length(path) - F.length(F.substring_index(path, "/", -1)) - 1)).otherwise(F.lit(""))

    holders = own.where(F.substring_index("file", "/", -1).rlike(LICENCE_FILE)).select(directory(F.col("file")).alias("dir"), "score", "licence")
    granted = holders.groupBy("dir").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("b")).select("dir", F.col("b.licence").alias("dir_licence"))
    paths = rows.select("file").distinct().withColumn("dir", directory(F.col("file")))
    parts = F.split("dir", "/")
    above = paths.select("dir").distinct().select(
        "dir", F.explode(F.concat(F.array(F.lit("")), F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k), "/")))).alias("from_dir")
    )
    nearest = (
        above.distinct()
        .join(granted.withColumnRenamed("dir", "from_dir"), "from_dir")
        .groupBy("dir")
        .agg(F.max(F.struct(F.length("from_dir").alias("depth"), "from_dir", "dir_licence")).alias("b"))
        .select("dir", "b.from_dir", "b.dir_licence")
    )
    joined = paths.join(own, "file", "left").join(nearest, "dir", "left")
    has_own = F.col("licence").isNotNull()
    return joined.select(
        F.col("file").alias("path"),
        F.col("licence").alias("own_licence"),
        F.col("score").alias("own_score"),
        F.coalesce("licence", "dir_licence").alias("licence"),
        F.when(has_own, "own").when(F.col("dir_licence").isNotNull(), "inherited").otherwise("none").alias("origin"),
        F.when(~has_own, F.col("from_dir")).alias("from_dir"),
    )


def document_paths(docs: DataFrame) -> DataFrame:
    """Documents as files: a folder by source, language and hundreds of ids. Texts of 100 characters
    or fewer are their folders' licence files; most of them tell nothing, some are a notice."""
    folder = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("none")), F.floor(F.col("doc_id") / 100).cast("string"))
    name = F.when(F.length("text") <= 100, F.concat(F.lit("LICENSE."), F.col("doc_id").cast("string"))).otherwise(F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return docs.select("doc_id", F.concat(folder, F.lit("/"), name).alias("path"), "text")


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else f"{v!r}e0" if isinstance(v, float) else repr(v) for v in row) + ")" for row in rows)


def oracle() -> str:
    """The same over ``documents`` in DuckDB, without the filter by telling terms."""
    v = Vectors(TEMPLATES, THRESHOLD)
    return f"""
WITH idf(term, idf) AS (VALUES {_values(list(v.idf.items()))}),
entries(term, template, licence, weight) AS (VALUES {_values(v.entries)}),
files AS (
  SELECT doc_id, coalesce(text, '') AS text,
         coalesce(source, 'none') || '/' || coalesce(lang, 'none') || '/' || CAST(doc_id // 100 AS VARCHAR) AS dir,
         CASE WHEN length(text) <= 100 THEN 'LICENSE.' || CAST(doc_id AS VARCHAR) ELSE CAST(doc_id AS VARCHAR) || '.txt' END AS name
  FROM documents),
units AS (
  SELECT doc_id, k AS unit, string_split(text, chr(10))[k] AS text FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS k FROM files)
  UNION ALL SELECT doc_id, -1, text FROM files WHERE name LIKE 'LICENSE%'),
terms AS (SELECT doc_id, unit, unnest(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{TERM}')) AS term FROM units),
weighed AS (
  SELECT doc_id, unit, c.term, n * coalesce(idf, {v.other!r}e0) AS w
  FROM (SELECT doc_id, unit, term, count(*) AS n FROM terms GROUP BY ALL) c LEFT JOIN idf ON c.term = idf.term),
sizes AS (SELECT doc_id, unit, sqrt(sum(w * w)) AS size FROM weighed GROUP BY ALL),
products AS (
  SELECT doc_id, unit, template, licence, sum(w * weight) AS product
  FROM weighed JOIN entries ON weighed.term = entries.term GROUP BY ALL),
own AS (
  SELECT doc_id, licence, score FROM (
    SELECT doc_id, licence, round(product / size, 4) AS score FROM products JOIN sizes USING (doc_id, unit))
  WHERE score >= {THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, licence) = 1),
granted AS (
  SELECT dir, licence AS dir_licence FROM own JOIN files USING (doc_id) WHERE name LIKE 'LICENSE%'
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY score DESC, licence) = 1)
SELECT doc_id, dir || '/' || name AS path, licence AS own_licence, score AS own_score,
       coalesce(licence, dir_licence) AS licence,
       CASE WHEN licence IS NOT NULL THEN 'own' WHEN dir_licence IS NOT NULL THEN 'inherited' ELSE 'none' END AS origin,
       CASE WHEN licence IS NULL AND dir_licence IS NOT NULL THEN dir END AS from_dir
FROM files LEFT JOIN own USING (doc_id) LEFT JOIN granted USING (dir)"""
