"""License notices in texts: MinHash bands over word windows retrieve templates, exact containment verifies.

DataFrame functions only. Templates are a parameter of bounded size; all tables broadcast here are
derived from it.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SHINGLE, CONTAINMENT, CERTAINTY, SHORTEST = 5, 0.8, 0.9999, 8
#: Templates may have so many words in all: what is broadcast and searched for is in proportion to them.
MAX_TEMPLATE_WORDS = 200_000

#: Notices to look for, by license.
TEMPLATES = {
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
}


def words_of(text: str) -> list[str]:
    return re.findall("[a-z0-9]+", text.lower())


def shingles_of(words: list[str]) -> list[str]:
    return sorted({" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)})


def length_class(n_words: int) -> int:
    """Windows of twice this many words, one starting at each multiple of it, hold any passage of n_words whole."""
    return max(SHORTEST, 1 << (n_words - 1).bit_length())


def bands_for(least_shingles: int, window: int) -> int:
    """Bands of one MinHash each, so that a window that contains CONTAINMENT of a template shares one with probability CERTAINTY.

    Such a window has a Jaccard similarity of at least CONTAINMENT * s / (s + the window's other shingles).
    """
    need = math.ceil(CONTAINMENT * least_shingles)
    least = need / (window - SHINGLE + 1 + least_shingles - need)
    return math.ceil(math.log(1 - CERTAINTY) / math.log(1 - min(least, 0.9999)))


def anchors(shingle_lists: list[list[str]]) -> list[str]:
    """Words of which every template shingle has one: a window without any can't contain a part of a template."""
    out: set[str] = set()
    for s in sorted({x for xs in shingle_lists for x in xs}):
        parts = s.split(" ")
        if not out.intersection(parts):
            out.add(max(parts, key=lambda w: (len(w), w)))
    return sorted(out)


def scan_licenses(spark: SparkSession, docs: DataFrame, templates: dict[str, str] | None = None) -> DataFrame:
    """(doc_id, license, n_windows, first_word, containment): the windows of each text that contain a template.

    A window contains a template if CONTAINMENT of its distinct five-word shingles stand in it; n_windows
    counts those, first_word is where the first starts and containment the largest share. Windows have twice
    as many words as the power of two that the template's length rounds up to, and start at its multiples. Texts are
    lower-cased and cut into words of a-z and 0-9. Null, empty and short texts give no rows; rows of
    the same doc_id count together; a null doc_id is an id like others. Templates of fewer than five
    words raise ValueError.
    """
    templates = TEMPLATES if templates is None else templates
    split = {k: words_of(v) for k, v in templates.items()}
    if any(len(w) < SHINGLE for w in split.values()) or sum(map(len, split.values())) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates need {SHINGLE} words each and {MAX_TEMPLATE_WORDS} in all at most")
    sizes = sorted({length_class(len(w)) for w in split.values()})
    own = {k: shingles_of(w) for k, w in split.items()}
    bands = {n: bands_for(min(len(own[k]) for k, w in split.items() if length_class(len(w)) == n), 2 * n) for n in sizes}
    marks = anchors(list(own.values()))
    per_size = F.create_map(*[F.lit(x) for n in sizes for x in (n, bands[n])])

    def banded(df: DataFrame) -> DataFrame:
        """A row for each band, with the least hash of the shingles under that band's function."""
        least = F.transform(F.sequence(F.lit(1), per_size[F.col("size")]), lambda b: F.array_min(F.transform("hashes", lambda h: F.xxhash64(h, b))))
        return df.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s))).select("*", F.posexplode(least).alias("band", "least")).drop("hashes")

    rows = [(k, length_class(len(w)), own[k]) for k, w in split.items()]
    wanted = banded(spark.createDataFrame(rows, "license string, size int, shingles array<string>")).select("license", "size", F.col("shingles").alias("wanted"), "band", "least")
    near = docs.select("doc_id", F.lower("text").alias("text")).where(F.col("text").rlike("(?<![a-z0-9])(?:" + "|".join(marks) + ")(?![a-z0-9])"))
    words = near.select("doc_id", F.regexp_extract_all("text", F.lit("[a-z0-9]+"), F.lit(0)).alias("words")).where(F.size("words") >= SHINGLE)
    sized = words.select("doc_id", "words", F.explode(F.array(*map(F.lit, sizes))).alias("size"))
    starts = sized.select("doc_id", "words", "size", F.explode(F.sequence(F.lit(0), F.size("words") - 1, F.col("size"))).alias("first_word"))
    windows = starts.select("doc_id", "size", "first_word", F.slice("words", F.col("first_word") + 1, 2 * F.col("size")).alias("words")).where(F.arrays_overlap("words", F.array(*map(F.lit, marks))) & (F.size("words") >= SHINGLE))
    shingled = windows.select("doc_id", "size", "first_word", F.array_distinct(F.transform(F.sequence(F.lit(1), F.size("words") - SHINGLE + 1), lambda i: F.array_join(F.slice("words", i, SHINGLE), " "))).alias("shingles"))
    met = banded(shingled).join(F.broadcast(wanted), ["size", "band", "least"])
    share = F.size(F.array_intersect("shingles", "wanted")) / F.size("wanted")
    found = met.select("doc_id", "license", F.col("first_word").cast("long").alias("first_word"), share.alias("containment")).where(F.col("containment") >= CONTAINMENT).distinct()
    return found.groupBy("doc_id", "license").agg(F.count("*").alias("n_windows"), F.min("first_word").alias("first_word"), F.max("containment").alias("containment"))


def license_sql(templates: dict[str, str] | None = None) -> str:
    """The same rows by testing every window against every template."""
    templates = TEMPLATES if templates is None else templates
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    rows = []
    for k, v in templates.items():
        w = words_of(v)
        rows.append(f"({quote(k)}, {length_class(len(w))}, [{', '.join(map(quote, shingles_of(w)))}])")
    return f"""
WITH t(license, size, wanted) AS (VALUES {', '.join(rows)}),
w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS words FROM documents WHERE text IS NOT NULL),
c AS (SELECT DISTINCT size FROM t),
s AS (SELECT doc_id, size, words, unnest(range(0, len(words), size)) AS first_word FROM w, c WHERE len(words) >= {SHINGLE}),
x AS (SELECT doc_id, size, first_word, words[first_word + 1 : first_word + 2 * size] AS words FROM s),
g AS (SELECT doc_id, size, first_word, list_distinct(list_transform(range(1, len(words) - {SHINGLE - 2}), lambda i : array_to_string(words[i : i + {SHINGLE - 1}], ' '))) AS shingles FROM x WHERE len(words) >= {SHINGLE}),
m AS (SELECT doc_id, license, first_word, len(list_intersect(shingles, wanted)) / len(wanted) AS containment FROM g JOIN t USING (size))
SELECT doc_id, license, count(*) AS n_windows, min(first_word) AS first_word, max(containment) AS containment
FROM m WHERE containment >= {CONTAINMENT} GROUP BY doc_id, license"""
