"""Licence scans: sparse TF-IDF cosine to templates, then inheritance from the nearest directory.

A notice is a line of a file's text whose cosine to a licence template reaches a threshold. Only
lines with an anchor word are scored. Anchors are the heaviest words of each template, enough
that a line without any of them cannot reach the threshold, so no notice is lost. A file without
a notice of its own takes the licence of the nearest directory above it that has one; a
directory has the licence of the best notice among the files directly in it.

Files whose text is missing have no notice; files whose path is missing inherit nothing.
Repeated rows are scanned each by itself.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tenc.llm.common import attach, saved

THRESHOLD = 0.6

# Identifying statements of common licences.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This program is free software under the terms of the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Proprietary", "All rights reserved. Unauthorized copying of this file is strictly prohibited."),
)

# Words that say nothing about a licence and are left out on both sides.
STOP_WORDS = "a an and any are by for in is of or the this to under use with without".split()

_WORD = r"[\p{L}\p{N}]+"


def _template_words(text: str) -> list[str]:
    return [w for w in re.findall(r"[^\W_]+", text.lower()) if w not in STOP_WORDS]


def template_weights(
    templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD
) -> tuple[list[tuple[int, str, str, float]], dict[str, float], float, list[str]]:
    """Rows (template, licence, word, weight of a unit vector), inverse frequencies, that of unseen words, anchors."""
    counts = [Counter(_template_words(text)) for _, text in templates]
    n = len(counts)
    seen = Counter(word for c in counts for word in c)
    idf = {w: math.log((1 + n) / (1 + k)) + 1 for w, k in seen.items()}
    rows, anchors = [], set()
    for number, ((name, _), count) in enumerate(zip(templates, counts)):
        weights = {w: k * idf[w] for w, k in count.items()}
        norm = math.sqrt(sum(x * x for x in weights.values()))
        left = 1.0
        for word, weight in sorted(weights.items(), key=lambda item: (-item[1], -len(item[0]), item[0])):
            rows.append((number, name, word, weight / norm))
            if left >= threshold * threshold * (1 - 1e-9):
                anchors.add(word)
                left -= (weight / norm) ** 2
    return rows, idf, math.log(1 + n) + 1, sorted(anchors)


def notices(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``row``, ``line`` and for each notice the best template's ``license`` and ``score``.

    ``files`` has ``row``, a name for the text, and ``text``; a text that comes more often under the
    same name has the same notices. Among equal scores the first template counts.
    """
    spark: SparkSession = files.sparkSession
    rows, idf, unseen, anchors = template_weights(templates, threshold)
    vectors = spark.createDataFrame(rows, "template int, license string, word string, weight double")
    rarity = spark.createDataFrame(sorted(idf.items()), "word string, idf double")
    edge = r"[\p{L}\p{N}]"
    has_anchor = F.col("content").rlike(f"(?<!{edge})({'|'.join(anchors)})(?!{edge})")
    text = F.lower(F.coalesce("text", F.lit("")))
    lines = files.select("row", F.posexplode(F.split(text, "\n")).alias("line", "content")).where(has_anchor)
    counted = (
        lines.select("row", "line", F.explode(F.regexp_extract_all("content", F.lit(_WORD), F.lit(0))).alias("word"))
        .where(~F.col("word").isin(STOP_WORDS))
        .groupBy("row", "line", "word").agg(F.count("*").alias("tf"))
        .join(F.broadcast(rarity), "word", "left")
        .withColumn("x", F.col("tf") * F.coalesce("idf", F.lit(unseen)))
    )
    norms = F.sqrt(F.sum(F.col("x") * F.col("x")))
    words = F.collect_list(F.when(F.col("idf").isNotNull(), F.struct("word", "x")))
    # At most the templates' vocabulary comes together for a line.
    found = counted.groupBy("row", "line").agg(norms.alias("norm"), words.alias("known"))
    scored = (
        found.select("row", "line", "norm", F.explode("known").alias("k"))
        .select("row", "line", "norm", F.col("k.word").alias("word"), F.col("k.x").alias("x"))
        .join(F.broadcast(vectors), "word")
        .groupBy("row", "line", "norm", "template", "license")
        .agg(F.sum(F.col("x") * F.col("weight")).alias("dot"))
        .withColumn("score", F.least(F.round(F.col("dot") / F.col("norm"), 9), F.lit(1.0)))
        .where(F.col("score") >= threshold)
    )
    best = F.max(F.struct("score", (-F.col("template")).alias("t"), "license")).alias("b")
    return scored.groupBy("row", "line").agg(best).select("row", "line", "b.license", "b.score")


def ancestors(path: Column) -> Column:
    """The directories above a path, nearest last: ``a/b/c`` gives ``a`` and ``a/b``."""
    parts = F.split(path, "/")
    return F.when(
        F.size(parts) > 1,
        F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/")),
    ).otherwise(F.array().cast("array<string>"))


def scan(
    files: DataFrame, templates: tuple[tuple[str, str], ...] = TEMPLATES, threshold: float = THRESHOLD
) -> DataFrame:
    """``file_id``, ``path``, ``n_notices``, ``license``, ``score``, ``found`` and ``inherited_from``.

    ``files`` has ``file_id``, ``path`` and ``text``. ``found`` is ``own``, ``inherited`` or
    ``none``. Of a file's notices, and of a directory's, the best score counts, then the name.
    """
    known = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in ("file_id", "path", "text")]
    rows = files.select(
        F.md5(F.concat_ws("\x1f", *known).cast("binary")).alias("row"), "file_id", "path", "text"
    )
    best = F.max(F.struct("score", "license"))
    own = saved(
        notices(rows, templates, threshold).groupBy("row")
        .agg(F.count("*").alias("n_notices"), best.alias("b"))
        .select("row", "n_notices", "b.license", "b.score"),
        "notices",
    )
    judged = saved(attach(rows.select("row", "file_id", "path"), own, ["row"]), "judged")
    directories = saved(
        judged.where(F.col("license").isNotNull() & F.col("path").contains("/"))
        .groupBy(F.regexp_replace("path", "/[^/]*$", "").alias("directory")).agg(best.alias("b"))
        .select("directory", F.col("b.license").alias("above")),
        "directories",
    )
    orphans = judged.where("license is null").select(
        "row", F.posexplode(ancestors(F.col("path"))).alias("depth", "directory")
    )
    inherited = saved(
        attach(orphans, directories, ["directory"], "inner")
        .groupBy("row").agg(F.max(F.struct("depth", "directory", "above")).alias("d"))
        .select("row", F.col("d.above").alias("above"), F.col("d.directory").alias("inherited_from")),
        "inherited",
    )
    return attach(judged, inherited, ["row"]).select(
        "file_id", "path", F.coalesce("n_notices", F.lit(0)).alias("n_notices"),
        F.coalesce("license", "above").alias("license"), "score",
        F.when(F.col("license").isNotNull(), "own")
        .when(F.col("above").isNotNull(), "inherited").otherwise("none").alias("found"),
        "inherited_from",
    )
