"""Licence scans in DataFrame functions only: TF-IDF cosine of lines to templates, then inheritance by path.

Every line of every text is compared with short licence templates. Weights are counts times inverse document
frequencies over all lines; a word that no template has gets the weight of an unseen word. A line whose cosine with a template
is at least ``CUT`` is a licence line. Few lines need the full sum: a template is cut down to its heaviest
words until the rest could not reach the cut alone, and only lines with one of these words go on (exact, by
Cauchy-Schwarz).

The best line gives a file its own licence. A file that consists mostly of licence lines is a licence file and
covers its directory; a file without its own licence inherits from the nearest directory above it that
has a licence file. Inheritance is settled per directory, by joins of path prefixes.

Defined cases: NULL and empty texts have no own licence; a NULL path inherits nothing and covers nothing; rows with
a NULL id have no own licence; ties go to the higher cosine, then the name; of two licence files in a
directory the same order decides; repeated rows get the same result; an empty table gives no rows.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import small, written
from .text import quoted, refuse_clash

CUT = 0.6
FILE_SHARE = 0.5  # of the characters of a licence file

# Phrases by which licences are declared.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3 of the License"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("proprietary", "All rights reserved"),
]
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~\t\r"


def _template_words(text: str) -> list[str]:
    return re.sub("[" + re.escape(_SIGNS) + "]", " ", text.lower()).split()


VOCABULARY = sorted({w for _, t in TEMPLATES for w in _template_words(t)})


def _words(line: Column) -> Column:
    return F.array_remove(F.split(F.translate(F.lower(line), _SIGNS, " " * len(_SIGNS)), " "), "")


def _vectors(idf: dict[str, float]) -> list[tuple[int, str, dict[str, float]]]:
    """Number, licence and unit vector of each template."""
    out = []
    for k, (name, text) in enumerate(TEMPLATES):
        words = _template_words(text)
        raw = {w: words.count(w) * idf[w] for w in words}
        norm = math.sqrt(sum(x * x for x in raw.values()))
        out.append((k, name, {w: x / norm for w, x in raw.items()}))
    return out


def _anchors(vectors: list[tuple[int, str, dict[str, float]]], cut: float) -> list[str]:
    """Words of which a line must have one to reach the cut with any template."""
    words = set()
    for _, _, v in vectors:
        rest = 1.0
        for w, x in sorted(v.items(), key=lambda p: (-p[1], p[0])):
            if rest < cut * cut - 1e-9:
                break
            words.add(w)
            rest -= x * x
    return sorted(words)


def own_licenses(docs: DataFrame, doc_id: str, text: str, cut: float = CUT) -> DataFrame:
    """doc_id, own_license, own_score, share (of characters in licence lines) of the texts that have a licence line."""
    whole = docs.where(F.col(quoted(text)).isNotNull() & F.col(quoted(doc_id)).isNotNull()).select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    lines = whole.select("doc_id", F.length("text").alias("chars"), F.posexplode(F.split("text", "\n")).alias("place", "line"))
    lines = lines.withColumn("words", _words(F.col("line"))).where(F.size("words") > 0)
    # one count per template word and line, one for the line itself
    seen = F.array_append(F.array_intersect("words", F.array(*[F.lit(w) for w in VOCABULARY])), F.lit(""))
    counts = {r.w: r.n for r in lines.select(F.explode(seen).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()}
    total = counts.get("", 0)
    idf = {w: math.log((1 + total) / (1 + counts.get(w, 0))) + 1 for w in VOCABULARY}
    vectors = _vectors(idf)
    spark = docs.sparkSession
    known = spark.createDataFrame([(w, x) for w, x in idf.items()], "word string, idf double")
    templates = spark.createDataFrame([(w, k, name, x) for k, name, v in vectors for w, x in v.items()], "word string, template int, license string, part double")
    near = lines.where(F.arrays_overlap("words", F.array(*[F.lit(w) for w in _anchors(vectors, cut)])))
    near = written(near.select("doc_id", "place", "chars", F.length("line").alias("length"), "words").distinct())
    weighted = near.select("doc_id", "place", F.explode("words").alias("word")).groupBy("doc_id", "place", "word").agg(F.count("*").alias("n"))
    weighted = weighted.join(F.broadcast(known), "word", "left").withColumn("x", F.col("n") * F.coalesce("idf", F.lit(math.log(1 + total) + 1)))
    norms = weighted.groupBy("doc_id", "place").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("norm"))
    dots = weighted.join(F.broadcast(templates), "word").groupBy("doc_id", "place", "template", "license").agg(F.sum(F.col("x") * F.col("part")).alias("dot"))
    scored = dots.join(norms, ["doc_id", "place"]).withColumn("score", F.round(F.col("dot") / F.col("norm"), 6)).where(F.col("score") >= cut)
    best = scored.groupBy("doc_id", "place").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best"))
    best = best.join(near.select("doc_id", "place", "chars", "length"), ["doc_id", "place"])
    return best.groupBy("doc_id").agg(F.min("best").alias("best"), (F.sum("length") / F.max("chars")).alias("share")).select("doc_id", F.col("best.license").alias("own_license"), (-F.col("best.minus")).alias("own_score"), "share")


def inherited(directories: DataFrame, files: DataFrame) -> DataFrame:
    """directory, inherited_license, inherited_from: of each directory, the licence file of the nearest directory at or above it.

    ``files`` has directory, license and score of licence files."""
    covers = files.groupBy("directory").agg(F.min(F.struct((-F.col("score")).alias("minus"), "license")).alias("best")).select(F.col("directory").alias("above"), F.col("best.license").alias("license"))
    parts = F.split("directory", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    steps = directories.select("directory", F.posexplode(above).alias("depth", "above"))
    found = steps.join(covers, "above").groupBy("directory").agg(F.max(F.struct("depth", "above", "license")).alias("near"))
    return found.select("directory", F.col("near.license").alias("inherited_license"), F.col("near.above").alias("inherited_from"))


def scanned(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text", cut: float = CUT, file_share: float = FILE_SHARE) -> DataFrame:
    """All columns of ``docs`` plus own_license, own_score, license and inherited_from (NULL if it is its own)."""
    refuse_clash(docs, ["own_license", "own_score", "share", "license", "inherited_license", "inherited_from", "directory"])
    own = written(own_licenses(docs, doc_id, text, cut))
    directory = F.regexp_extract(F.col(quoted(path)), r"^(.*)/[^/]*$", 1)
    joined = docs.withColumn("directory", directory).join(small(own, 64).withColumnRenamed("doc_id", doc_id), doc_id, "left")
    files = written(joined.where(F.col("share") >= file_share).where("directory <> ''").select("directory", F.col("own_license").alias("license"), F.col("own_score").alias("score")))
    near = small(written(inherited(docs.select(directory.alias("directory")).where("directory <> ''").distinct(), files)), 256)
    full = joined.join(near, "directory", "left")
    lacks = F.col("own_license").isNull()
    return full.select(
        *[F.col(quoted(c)) for c in docs.columns], "own_license", "own_score", F.coalesce("own_license", "inherited_license").alias("license"),
        F.when(lacks, F.col("inherited_from")).alias("inherited_from"),
    )


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The registered query over all documents; a document's path is its source, its thousand, its hundred and its id."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    path = F.concat_ws("/", "source", F.expr("cast(doc_id div 1000 as string)"), F.expr("cast(doc_id div 100 as string)"), F.col("doc_id").cast("string"))
    return scanned(docs.withColumn("path", path), "path").select("doc_id", "path", "own_license", "own_score", "license", "inherited_from")


def _sql() -> str:
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({k}, {quote(name)}, {quote(w)}, {_template_words(text).count(w)})" for k, (name, text) in enumerate(TEMPLATES) for w in sorted(set(_template_words(text))))
    signs = quote(_SIGNS.replace("\t", "").replace("\r", "")) + " || chr(9) || chr(13)"
    return f"""
WITH d AS (SELECT doc_id, text, concat_ws('/', source, CAST(doc_id // 1000 AS VARCHAR), CAST(doc_id // 100 AS VARCHAR), CAST(doc_id AS VARCHAR)) AS path FROM documents),
l AS (SELECT doc_id, length(text) AS chars, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS place FROM d),
w AS (SELECT doc_id, place, chars, length(line) AS length, list_filter(string_split(translate(lower(line), {signs}, repeat(' ', {len(_SIGNS)})), ' '), lambda x: x <> '') AS ws FROM l),
t AS (SELECT doc_id, place, word, count(*) AS n FROM (SELECT doc_id, place, unnest(ws) AS word FROM w) GROUP BY 1, 2, 3),
lines AS (SELECT count(*) AS total FROM w WHERE len(ws) > 0),
tpl(template, license, word, tf) AS (VALUES {rows}),
idf AS (SELECT v.word, ln((1 + total) / (1 + coalesce(df, 0))) + 1 AS idf FROM (SELECT DISTINCT word FROM tpl) v LEFT JOIN (SELECT word, count(*) AS df FROM t GROUP BY 1) c USING (word), lines),
tv AS (SELECT template, license, word, tf * idf / sqrt(sum((tf * idf) ** 2) OVER (PARTITION BY template)) AS part FROM tpl JOIN idf USING (word)),
x AS (SELECT doc_id, place, word, n * coalesce(idf, ln(1 + total) + 1) AS x FROM t LEFT JOIN idf USING (word), lines),
norm AS (SELECT doc_id, place, sqrt(sum(x * x)) AS norm FROM x GROUP BY 1, 2),
s AS (SELECT doc_id, place, license, max(score) AS score FROM (SELECT x.doc_id, x.place, template, license, round(sum(x * part) / any_value(norm), 6) AS score FROM x JOIN tv USING (word) JOIN norm ON norm.doc_id = x.doc_id AND norm.place = x.place GROUP BY 1, 2, 3, 4) WHERE score >= {CUT} GROUP BY 1, 2, 3),
b AS (SELECT doc_id, place, max(score) AS score, arg_min(license, struct_pack(a := -score, b := license)) AS license FROM s GROUP BY 1, 2),
own AS (SELECT doc_id, arg_min(license, struct_pack(a := -score, b := license)) AS own_license, max(score) AS own_score, sum(length) / max(chars) AS share FROM b JOIN w USING (doc_id, place) GROUP BY 1),
p AS (SELECT doc_id, path, regexp_extract(path, '^(.*)/[^/]*$', 1) AS directory, own_license, own_score, share FROM d LEFT JOIN own USING (doc_id)),
f AS (SELECT directory, arg_min(own_license, struct_pack(a := -own_score, b := own_license)) AS license FROM p WHERE share >= {FILE_SHARE} AND directory <> '' GROUP BY 1),
n AS (SELECT doc_id, arg_max(f.license, len(f.directory)) AS license, arg_max(f.directory, len(f.directory)) AS directory FROM p JOIN f ON p.directory = f.directory OR starts_with(p.directory, f.directory || '/') GROUP BY 1)
SELECT p.doc_id, p.path, own_license, own_score, coalesce(own_license, n.license) AS license, CASE WHEN own_license IS NULL THEN n.directory END AS inherited_from FROM p LEFT JOIN n USING (doc_id)
"""


SQL = _sql()
