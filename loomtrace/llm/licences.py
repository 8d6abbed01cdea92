"""License scans: TF-IDF cosine of headers and whole files to templates, then inheritance by directory.

Every block of a text (lines up to a blank or comment-only one: a possible header notice), every line and
the text as a whole (a possible licence file) is compared with all templates. Terms weigh by their inverse
document frequency among the templates; terms that no template has weigh most. Files without a license of
their own take that of the nearest ancestor directory that has a licence file, i.e. a file that is a
licence as a whole: directories are made distinct, joined with the licensed directories on every ancestor
path, and the longest path wins. All steps are DataFrame functions.

A part can reach the threshold against a template only if it has one of the template's heaviest terms (what
is left of the template's vector without them is too short); texts and parts without any such term are not
compared, which changes no result.

Texts are known by two hashes, not by a doc_id, so that rows with equal, clashing or no ids are scanned
each, and copies of a text once.

Defined results of the edge cases: null and empty texts have no license of their own; a null path is a
file without directory, which inherits nothing; of several equally similar templates the first by name
counts, of several licence files of a directory the first by path, then by license (those without a path
last); repeated rows are returned each; extra columns are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Short notices, standard headers by paragraph, and whole texts of short licences.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("BSD-3-Clause", """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""),
    ("LGPL-3.0", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Least cosine of a notice or licence file.
THRESHOLD = 0.8
TERM = "[a-z0-9]+"
#: Between blocks: lines that are blank or hold comment marks only.
BLOCK_END = "\n(?:[^\\p{L}\\p{N}\n]*\n)+"
#: Words too common in texts of some language to be worth looking for ("mit" is German for "with").
COMMON = frozenset("a an and any are as at be by can do for from have i if in is it its may mit no not of on or that the this to under use was we with you 0 1 2 3 4".split())


def vectors() -> tuple[list[dict[str, float]], dict[str, float], float]:
    """Unit TF-IDF vectors of the templates, idf by term, and the idf of terms that no template has."""
    counts = [Counter(re.findall(TERM, text.lower())) for _, text in TEMPLATES]
    seen = Counter(term for c in counts for term in c)
    other = math.log(1 + len(counts)) + 1
    idf = {term: math.log((1 + len(counts)) / (1 + n)) + 1 for term, n in seen.items()}
    out = []
    for c in counts:
        raw = {term: n * idf[term] for term, n in c.items()}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append({term: x / norm for term, x in raw.items()})
    return out, idf, other


def required_terms() -> list[str]:
    """Terms of which any text that reaches the threshold has at least one.

    Per template the heaviest terms, ``COMMON`` ones last, until those left out can't reach the threshold by
    themselves.
    """
    found = set()
    for vector in vectors()[0]:
        rest = 1.0
        for term, x in sorted(vector.items(), key=lambda p: (p[0] in COMMON, -p[1], p[0])):
            if math.sqrt(max(rest, 0)) < THRESHOLD * (1 - 1e-9):
                break
            found.add(term)
            rest -= x * x
    return sorted(found)


def term_table(spark: SparkSession) -> DataFrame:
    """(term, idf, [template, weight]...) for the terms of the templates: some hundred rows."""
    unit, idf, _ = vectors()
    rows = [(t, idf[t], [(k, v[t]) for k, v in enumerate(unit) if t in v]) for t in sorted(idf)]
    return spark.createDataFrame(rows, "term string, idf double, weights array<struct<template:int,weight:double>>")


def _terms(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))


def own_licences(files: DataFrame, key: str, text: str) -> DataFrame:
    """(key, license, similarity, unit) of the rows whose text has a notice or is a licence file."""
    spark = files.sparkSession
    other = vectors()[2]
    hint = "(?i)(?<![a-z0-9])(" + "|".join(required_terms()) + ")(?![a-z0-9])"
    source = files.select(F.col(key).alias("file"), F.col(text).cast("string").alias("body")).where(F.col("body").rlike(hint))
    parts = F.filter(F.array_distinct(F.concat(F.split("body", BLOCK_END), F.split("body", "\n"))), lambda x: x.rlike(hint))
    units = F.concat(F.array(F.struct(F.lit("file").alias("unit"), F.col("body").alias("part"))), F.transform(parts, lambda x: F.struct(F.lit("header").alias("unit"), x.alias("part"))))
    parts = source.select("file", F.posexplode(units).alias("at", "u")).select("file", "at", "u.unit", F.explode(_terms(F.col("u.part"))).alias("term"))
    counted = parts.groupBy("file", "at", "unit", "term").agg(F.count(F.lit(1)).alias("tf"))
    joined = counted.join(F.broadcast(term_table(spark)), "term", "left")
    size = F.sum(F.pow(F.col("tf") * F.coalesce("idf", F.lit(other)), F.lit(2.0)))
    unit_norms = joined.groupBy("file", "at", "unit").agg(
        F.sqrt(size).alias("norm"),
        F.flatten(F.collect_list(F.transform("weights", lambda w: F.struct(w["template"].alias("template"), (w["weight"] * F.col("tf") * F.col("idf")).alias("x"))))).alias("products"),
    )
    sums = F.array(
        *(
            F.struct(
                (F.aggregate(F.filter("products", _of(k)), F.lit(0.0), lambda a, p: a + p["x"]) / F.col("norm")).alias("similarity"),
                F.lit(name).alias("license"),
            )
            for k, (name, _) in enumerate(TEMPLATES)
        )
    )
    ranked = unit_norms.select("file", "at", "unit", F.explode(sums).alias("s")).where(F.col("s.similarity") >= THRESHOLD)
    # ties: the most similar, then whole files before lines and earlier before later ones, then the first name
    top = ranked.groupBy("file", "at", "unit").agg(F.max("s.similarity").alias("similarity"), F.min_by("s.license", F.struct(-F.col("s.similarity"), F.col("s.license"))).alias("license"))
    return top.groupBy("file").agg(F.min_by(F.struct("license", "similarity", "unit"), F.struct(-F.col("similarity"), "at")).alias("b")).select(F.col("file").alias(key), "b.license", "b.similarity", "b.unit")


def _of(template: int):
    return lambda product: product["template"] == template


def ancestors(path: Column) -> Column:
    """All ancestor directories of a directory path, itself included."""
    pieces = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(pieces)), lambda i: F.array_join(F.slice(pieces, 1, i), "/"))


def nearest_licences(directories: DataFrame, licensed: DataFrame) -> DataFrame:
    """For each directory the license of its nearest ancestor (itself included) that has a licence file.

    ``directories`` has (directory), ``licensed`` (directory, license, licence_file). Only distinct
    directories are spread over their ancestors, so a root that holds most files is not a hot key.
    """
    owned = licensed.groupBy("directory").agg(F.min_by(F.struct("license", "licence_file"), F.struct(F.col("licence_file").isNull(), "licence_file", "license")).alias("own")).select(F.col("directory").alias("ancestor"), "own")
    spread = directories.where("directory is not null").select("directory").distinct().select("directory", F.explode(ancestors(F.col("directory"))).alias("ancestor"))
    return (
        spread.join(owned, "ancestor")
        .groupBy("directory")
        .agg(F.max_by(F.struct("ancestor", "own"), F.length("ancestor")).alias("n"))
        .select("directory", F.col("n.ancestor").alias("inherited_from"), F.col("n.own.license").alias("inherited"))
    )


def scan(files: DataFrame) -> DataFrame:
    """License of every file: its own, or else that of the nearest directory with a licence file.

    ``files`` has (doc_id, path, directory, text).
    """
    body = F.col("text").cast("string")
    known = F.struct(F.xxhash64(body).alias("a"), F.xxhash64(F.lit(1), body).alias("b"))
    keyed = files.select("doc_id", "path", "directory", body.alias("text"), F.when(body.isNotNull(), known).alias("known"))
    own = own_licences(keyed, "known", "text")
    facts = keyed.drop("text").join(own, "known", "left")
    licensed = facts.where("unit = 'file' and directory is not null").select("directory", "license", F.col("path").alias("licence_file"))
    near = nearest_licences(facts.select("directory"), licensed)
    return facts.join(near, "directory", "left").select(
        "doc_id",
        "path",
        F.coalesce("license", "inherited").alias("license"),
        F.when(F.col("license").isNotNull(), F.col("unit")).when(F.col("inherited").isNotNull(), F.lit("inherited")).otherwise(F.lit("none")).alias("evidence"),
        F.round("similarity", 6).alias("similarity"),
        F.when(F.col("license").isNull(), F.col("inherited_from")).alias("inherited_from"),
    )


def document_files(documents: DataFrame) -> DataFrame:
    """The documents table, which has no paths, as a file tree: ``source/thousands/hundreds/doc_id``.

    A document without a doc_id is a file without path and directory.
    """
    number = F.col("doc_id").cast("long")
    lower = F.concat(F.coalesce(F.col("source").cast("string"), F.lit("none")), F.lit("/"), F.floor(number / 1000).cast("string"), F.lit("/"), F.floor(number / 100).cast("string"))
    return documents.select(number.alias("doc_id"), F.concat(lower, F.lit("/"), number.cast("string")).alias("path"), lower.alias("directory"), "text")
