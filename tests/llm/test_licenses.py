import math
from collections import Counter

from tallyline.llm.licenses import TEMPLATES, TEXTS, Weights, _words, scan


def cosine(segment):
    """The best licence of one segment, by definition."""
    weights = Weights(TEMPLATES, 0.7)
    own = {w: n * weights.idf.get(w, weights.unknown) for w, n in Counter(_words(segment)).items()}
    length = math.sqrt(sum(w * w for w in own.values()))
    products = Counter()
    for number, name, word, weight in weights.rows:
        products[number, name] += own.get(word, 0) * weight
    (_, name), product = max(products.items(), key=lambda x: (round(x[1], 9), x[0][1]))
    return name, product / length


def test_notices_and_inheritance(spark, odd, none):
    rows = [
        ("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"
         " and associated documentation files\nmore words of it"),
        ("a/b/c/x.py", "print(1)"),
        ("a/b/y.py", "# Licensed under the Apache License, Version 2.0.\nprint(2)"),
        ("a/b/z.py", "Some words. RELEASED under the MIT License! More words"),
        ("a/b/COPYING.txt", "This work is licensed under the GNU General Public License, version 3."),
        ("a/b/c/LICENSE.md", "nothing of that kind"),
        ("ab/x.py", "licensed"),
        ("x.py", ""),
        (None, "Licensed under CC BY-NC 4.0."),
        ("a/b/z.py", "Some words. RELEASED under the MIT License! More words"),
        ("a/b/q.py", None),
        ("/", "x"),
        ("", "x"),
    ]
    frame = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "path string, text string, license int")
    got = sorted((r for r in scan(frame.withColumnRenamed("license", "k1"), keep=["k1"]).collect()), key=lambda r: r.k1)
    assert [(r.license, r.found, r.file) for r in got] == [
        ("MIT", "own", None),
        ("GPL-3.0", "inherited", "a/b/COPYING.txt"),
        ("Apache-2.0", "own", None),
        ("MIT", "own", None),
        ("GPL-3.0", "own", None),
        ("GPL-3.0", "inherited", "a/b/COPYING.txt"),
        (None, None, None),
        (None, None, None),
        ("CC-BY-NC-4.0", "own", None),
        ("MIT", "own", None),
        ("GPL-3.0", "inherited", "a/b/COPYING.txt"),
        (None, None, None),
        (None, None, None),
    ]
    assert got[3].cosine == 1 == got[8].cosine
    assert scan(odd, path="source").count() == odd.count()
    assert scan(none, path="source").collect() == []


def test_segments_against_the_definition(spark):
    segments = [
        "Licensed under the Apache Licence Version 2.0 by its authors",
        "this work is licensed under gnu gpl version 3",
        "Licensed under CC BY 4.0",
        "mit license",
        "SPDX-License-Identifier: BSD-3-Clause",
        "the words of a text that has a version but no license",
        "public domain software released free and unencumbered into the",
    ]
    frame = spark.createDataFrame([(s, f"d{i}/f") for i, s in enumerate(segments)], "text string, path string")
    got = {r.path: (r.license, r.cosine) for r in scan(frame).collect()}
    for i, segment in enumerate(segments):
        name, value = cosine(segment)
        want = (name, round(value, 6)) if round(value, 6) >= 0.7 else (None, None)
        assert got[f"d{i}/f"] == want
    assert sum(x[0] is not None for x in got.values()) >= 3


def test_no_python_in_the_plan(spark, odd, capsys):
    scan(odd, path="source").explain()
    plan = capsys.readouterr().out
    assert "Join" in plan and not any(x in plan for x in ("Python", "Pandas", "Arrow", "CartesianProduct"))


GNU = """/*
 * Copyright (C) 2020 Somebody
 *
 * This program is free software: you can redistribute it and/or modify
 * it under the terms of the GNU {kind}General Public License as published by
 * the Free Software Foundation, either version {n} of the License, or
 * (at your option) any later version.
 *
 * This program is distributed in the hope that it will be useful,
 * but WITHOUT ANY WARRANTY; without even the implied warranty of
 * MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
 */
int main(void) {{ return 0; }}
"""


def test_wrapped_headers_and_whole_texts(spark):
    rows = [
        ("GPL-2.0", "a/x.c", GNU.format(kind="", n=2)),
        ("GPL-3.0", "b/x.c", GNU.format(kind="", n=3)),
        ("LGPL-3.0", "c/x.c", GNU.format(kind="Lesser ", n=3)),
        ("ISC", "d/x.py", "# Permission to use, copy, modify, and/or distribute this software for any\n# purpose with or"
         " without fee is hereby granted, provided that the above\n# copyright notice and this permission notice appear in"
         " all copies.\nx = 1"),
        ("Apache-2.0", "e/x.py", "#\n# Unless required by applicable law or agreed to in writing, software\n# distributed"
         " under the License is distributed on an AS IS BASIS,\n# WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either"
         " express or implied.\n# See the License for the specific language governing permissions and\n# limitations"
         " under the License.\n\nx = 1"),
        *((name, f"{name}/LICENSE", f"Copyright 2020 Somebody\n\n{text}") for name, text in TEXTS.items()),
    ]
    assert len(TEXTS) >= 9 and {"GPL-2.0", "GPL-3.0", "LGPL-3.0"} < set(TEXTS)
    frame = spark.createDataFrame(rows, "want string, path string, text string")
    got = {r.path: (r.license, r.found) for r in scan(frame).collect()}
    assert got == {path: (want, "own") for want, path, _ in rows}
