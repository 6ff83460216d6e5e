"""License scan: notices by sparse TF-IDF cosine to templates, and inheritance by directory.

A file's text is cut into segments: lines and sentences in them, paragraphs of several lines
(comment marks aside) and sentences that run over lines. Templates are usual notices, header
paragraphs and whole licence texts (folder license_texts). A segment's words are
weighed by their count and by how few templates have them (common English words aside), and compared with each template
by cosine. A file named like a licence file is also compared as a whole. The best
comparison of a file counts if it reaches ``least``. A file without a licence of its own
takes that of the licence file in its nearest directory upwards.

Only segments that can reach ``least`` are weighed: for each template, words are taken, short
ones last, until those left have less than ``least`` of its length. By the inequality of
Cauchy and Schwarz, a segment with none of the taken words can't reach ``least``; texts, and
then segments, without them go first. Nor can a segment whose words of any template have less
than ``least`` of its length; this is told inside the row, from how often its words stand
there. Of the segments that are left, only words of templates are shuffled: the other words
add to the length alone, with one number.

Directories are joined, not files: distinct directories meet those of their ancestors that
have licence files, and the nearest wins. Templates are settings and their size is checked.
All work is done by DataFrame functions.

Defined results: a null or empty text has no licence of its own; a null path has no
directory and inherits nothing. Rows equal in path and text get equal results. Ties go to
the licence, then the path, that sorts first. Where a directory has several licence files,
the best comparison counts.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping, Sequence
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm.frames import col, identity

LEAST = 0.7
TEMPLATE_WORDS = 100_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SENTENCE_END = r"(?<=[.;!?])\s+"
#: Lines without letters or digits part paragraphs.
PARAGRAPH_END = r"\r?\n(?:[^\p{L}\p{N}\n]*\n)+"
SEGMENT_END = r"\n|(?<=[.;!?])\s+"
FILE_NAME = r"(?i)^(licen[cs]e|copying|unlicense|notice)([.-].*)?$"

# English words that most texts have; they are not weighed.
COMMON = frozenset(
    "a all an and any are as at be been by can for from had has have he her his if in into is it its may more no not of"
    " on one or other our out she so some such that the their them then there these they this those to under up use was"
    " we were what when which who will with without would you your".split()
)

# Usual notices, by SPDX identifier.
NOTICES: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is"
        " distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    ),
    "BSD-3-Clause": (
        "Licensed under the BSD 3-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided"
        " that the following conditions are met",
    ),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", "Licensed under the Creative Commons Attribution 4.0 International License"),
    "CC-BY-NC-4.0": (
        "Licensed under CC BY-NC 4.0",
        "Licensed under the Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "CC-BY-SA-4.0": (
        "Licensed under CC BY-SA 4.0",
        "Licensed under the Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "CC0-1.0": ("Released under CC0 1.0", "To the extent possible under law, all copyright and related rights are waived"),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2",),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3",),
    "ISC": ("Released under the ISC License",),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3",),
    "MIT": (
        "Released under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and"
        " associated documentation files",
    ),
    "MPL-2.0": ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",),
    "Unlicense": ("This is free and unencumbered software released into the public domain",),
}
_GNU = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU {kind}General"
    " Public License as published by the Free Software Foundation, either version {n} of the License, or (at your"
    " option) any later version"
)
_GNU_ONLY = (
    "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {kind}General"
    " Public License version {n} as published by the Free Software Foundation"
)

# Header paragraphs as they stand in source files. Paragraphs that are the same
# for several licences (warranty, "You should have received a copy") tell none and are left out.
HEADERS: dict[str, tuple[str, ...]] = {
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance"
        " with the License",
    ),
    "GPL-2.0": (_GNU.format(kind="", n=2), _GNU_ONLY.format(kind="", n=2)),
    "GPL-3.0": (_GNU.format(kind="", n=3), _GNU_ONLY.format(kind="", n=3)),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby"
        " granted, provided that the above copyright notice and this permission notice appear in all copies",
    ),
    "LGPL-3.0": (_GNU.format(kind="Lesser ", n=3), _GNU_ONLY.format(kind="Lesser ", n=3)),
    "MIT": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
        " documentation files (the Software), to deal in the Software without restriction, including without limitation"
        " the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,"
        " and to permit persons to whom the Software is furnished to do so, subject to the following conditions",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was"
        " not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
    ),
}
#: Whole licence texts, by SPDX identifier.
TEXTS = {file.stem: file.read_text(encoding="utf-8") for file in sorted((Path(__file__).parent / "license_texts").glob("*.txt"))}
TEMPLATES = {
    name: (*texts, f"SPDX-License-Identifier: {name}", *HEADERS.get(name, ()), *([TEXTS[name]] if name in TEXTS else []))
    for name, texts in NOTICES.items()
}


def _words(text: str) -> list[str]:
    found = re.findall("[a-z0-9]+", text.translate(str.maketrans(UPPER, LOWER)))
    return [word for word in found if word not in COMMON]


class Weights:
    """Words' weights and templates as vectors of length 1."""

    def __init__(self, templates: Mapping[str, Sequence[str]], least: float):
        counted = [(name, Counter(_words(text))) for name, texts in sorted(templates.items()) for text in texts]
        counted = [x for x in counted if x[1]]
        if (size := sum(len(words) for _, words in counted)) > TEMPLATE_WORDS:
            raise ValueError(f"templates have {size} words, {TEMPLATE_WORDS} are allowed")
        df = Counter(word for _, words in counted for word in words)
        self.unknown = math.log(1 + len(counted)) + 1
        self.idf = {word: math.log((1 + len(counted)) / (1 + n)) + 1 for word, n in df.items()}
        self.rows: list[tuple[int, str, str, float]] = []
        needed = set()
        for number, (name, words) in enumerate(counted):
            weights = {word: n * self.idf[word] for word, n in words.items()}
            length = math.sqrt(sum(w * w for w in weights.values()))
            self.rows += [(number, name, word, w / length) for word, w in weights.items()]
            left = 1.0
            # Any words will do whose rest is light enough; short ones are taken last.
            for word, w in sorted(weights.items(), key=lambda x: (len(x[0]) < 3, -x[1], x[0])):
                if left < least**2 - 1e-9:
                    break
                needed.add(word)
                left -= (w / length) ** 2
        #: Every segment that can reach ``least`` has one of them.
        self.needed = sorted(needed)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(template, license, token, weight)"""
        return spark.createDataFrame(self.rows, "template int, license string, token string, weight double")

    def words(self, spark: SparkSession) -> DataFrame:
        """(token, idf)"""
        return spark.createDataFrame(list(self.idf.items()), "token string, idf double")


def directory(path: Column) -> Column:
    """A path without its last part; empty if it has one part only."""
    return F.regexp_replace(path, "/?[^/]*$", "")


def _tokens(text: Column) -> Column:
    """Words of a text, A-Z in lower case; an empty one where it begins or ends with something else."""
    return F.transform(F.split(text, "[^a-zA-Z0-9]+"), F.lower)


def _squares(words: Column) -> Column:
    """The sum of the squares of how often each word stands in a list."""
    nothing = F.struct(F.lit("").alias("word"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("sum"))

    def step(so_far: Column, word: Column) -> Column:
        run = F.when(so_far["word"] == word, so_far["run"] + 1).otherwise(F.lit(1).cast("long"))
        # The n-th of equal words adds n * n - (n - 1) * (n - 1).
        return F.struct(word.alias("word"), run.alias("run"), (so_far["sum"] + 2 * run - 1).alias("sum"))

    return F.aggregate(F.array_sort(words), nothing, step, lambda x: x["sum"])


def segments(text: Column, path: Column) -> Column:
    """Lines and sentences in them, paragraphs and sentences over several lines, and a licence file as a whole."""
    paragraphs = F.split(text, PARAGRAPH_END)
    sentences = F.flatten(F.transform(paragraphs, lambda paragraph: F.split(paragraph, SENTENCE_END)))
    # Over several lines only: the others are segments of one line.
    several = F.array_distinct(F.filter(F.concat(paragraphs, sentences), lambda part: F.trim(part).contains("\n")))
    whole = F.when(F.regexp_extract(path, "[^/]*$", 0).rlike(FILE_NAME), F.array(text)).otherwise(F.array().cast("array<string>"))
    return F.concat(F.split(text, SEGMENT_END), several, F.coalesce(whole, F.array().cast("array<string>")))


def own_licenses(files: DataFrame, weights: Weights, least: float) -> DataFrame:
    """(k1, k2, license, cosine) of the files (k1, k2, path, text) that have a licence themselves."""
    spark = files.sparkSession
    needed = F.array(*map(F.lit, weights.needed)).cast("array<string>")

    def able(words: Column) -> Column:
        return F.arrays_overlap(words, needed)

    # Each row of its own: equal ones have equal keys.
    texts = files.where(able(_tokens(F.col("text")))).withColumn("row", F.monotonically_increasing_id())
    found = F.filter(F.transform(segments(F.col("text"), F.col("path")), _tokens), able)
    parts = texts.select("k1", "k2", "row", F.posexplode(found).alias("segment", "words"))
    known = parts.select(
        "k1", "k2", "row", "segment",
        F.filter("words", lambda w: w.isin(list(weights.idf))).alias("known"),
        (_squares(F.filter("words", lambda w: ~w.isin(["", *COMMON, *weights.idf]))) * F.lit(weights.unknown**2)).alias("rest"),
    )
    # Words of templates weigh this much at most; they alone can add to a cosine.
    most = _squares(F.col("known")) * F.lit(max(weights.idf.values(), default=0.0) ** 2)
    known = known.where(most * (1 - least**2) + 1e-6 >= F.col("rest") * least**2)
    counted = known.select("k1", "k2", "row", "segment", "rest", F.explode("known").alias("token"))
    counted = counted.groupBy("k1", "k2", "row", "segment", "rest", "token").count()
    vocabulary, templates = weights.words(spark), weights.frame(spark)
    of_token = templates.groupBy("token").agg(F.collect_list(F.struct("template", "license", "weight")).alias("held"))
    itself = F.struct(F.lit(-1).alias("template"), F.lit(None).cast("string").alias("license"), F.lit(None).cast("double").alias("weight"))
    # One aggregation gives both length and products: template -1 is the segment with itself.
    products = (
        counted.join(F.broadcast(vocabulary.join(of_token, "token")), "token")
        .select("k1", "k2", "row", "segment", "rest", (F.col("count") * F.col("idf")).alias("w"), F.inline(F.concat(F.array(itself), "held")))
        .groupBy("k1", "k2", "row", "segment", "rest", "template", "license")
        .agg(F.sum(F.col("w") * F.coalesce("weight", "w")).alias("product"))
    )
    length = F.sqrt(F.col("rest") + F.max(F.when(F.col("template") == -1, F.col("product"))))
    by_segment = products.groupBy("k1", "k2", "row", "segment", "rest").agg(
        length.alias("length"),
        F.min(F.when(F.col("template") >= 0, F.struct((-F.round("product", 9)).alias("less"), "license"))).alias("best"),
    )
    cosine = F.round(-F.col("best.less") / F.col("length"), 6)
    found = by_segment.select("k1", "k2", F.col("best.license").alias("license"), cosine.alias("cosine")).where(F.col("cosine") >= least)
    ranked = F.min(F.struct((-F.col("cosine")).alias("less"), "license"))
    return found.groupBy("k1", "k2").agg(ranked.alias("best")).select(
        "k1", "k2", F.col("best.license").alias("license"), (-F.col("best.less")).alias("cosine")
    )


def scan(
    frame: DataFrame, path: str = "path", text: str = "text", keep: Sequence[str] = (), least: float = LEAST,
    templates: Mapping[str, Sequence[str]] = TEMPLATES,
) -> DataFrame:
    """(keep..., path, license, cosine, found, file) for each row of the frame.

    found is ``own`` or ``inherited`` (then file is the licence file), or null with license.
    """
    weights = Weights(templates, least)
    k1, k2 = identity(col(path), col(text))
    files = frame.select(k1.alias("k1"), k2.alias("k2"), col(path).cast("string").alias("path"), col(text).cast("string").alias("text"))
    own = own_licenses(files, weights, least)
    kept = frame.select(
        *[col(c).alias(f"kept_{i}") for i, c in enumerate(keep)], k1.alias("k1"), k2.alias("k2"),
        col(path).cast("string").alias("path"),
    )
    told = kept.join(own, ["k1", "k2"], "left").withColumn("dir", directory(F.col("path")))
    ranked = F.min(F.struct((-F.col("cosine")).alias("less"), "license", "path")).alias("best")
    of_directory = (
        told.where(F.col("license").isNotNull() & F.regexp_extract("path", "[^/]*$", 0).rlike(FILE_NAME))
        .groupBy("dir").agg(ranked)
        .select(F.col("dir").alias("above"), (-F.col("best.less")).alias("cosine_"), F.col("best.license").alias("license_"), F.col("best.path").alias("file_"))
    )
    steps = F.split("dir", "/")
    upwards = F.sequence(F.lit(0), F.when(F.col("dir") == "", 0).otherwise(F.size(steps)))
    above = (
        told.where("dir IS NOT NULL").select("dir").distinct()
        .select("dir", F.explode(upwards).alias("depth"))
        .withColumn("above", F.array_join(F.slice(steps, F.lit(1), F.col("depth")), "/"))
    )
    nearest = (
        above.join(of_directory, "above")
        .groupBy("dir").agg(F.max(F.struct("depth", "license_", "cosine_", "file_")).alias("near"))
        .select("dir", "near.license_", "near.cosine_", "near.file_")
    )
    joined = told.join(nearest, "dir", "left")
    is_own = F.col("license").isNotNull()
    return joined.select(
        *[F.col(f"kept_{i}").alias(c) for i, c in enumerate(keep)],
        "path",
        F.coalesce("license", "license_").alias("license"),
        F.coalesce("cosine", "cosine_").alias("cosine"),
        F.when(is_own, "own").when(F.col("license_").isNotNull(), "inherited").alias("found"),
        F.when(~is_own, F.col("file_")).alias("file"),
    )
