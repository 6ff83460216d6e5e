"""Line dedup: repeated windows of three consecutive lines are removed but for the first.

A window is three consecutive lines that are not blank, each without the spaces, tabs and
carriage returns around it; a document with fewer such lines is one window. Windows are
hashed to 128 bits and compared over all documents. Occurrences are ordered by document
id (null first), then by the document's hash, then by place. Every occurrence but the
first is covered, covered positions are merged, and these lines go, with blank lines
inside them. A removed line stands once more at an earlier place that is kept: each
covered window has an earlier twin, and a chain of twins ends at a first occurrence.

Defined results: a null, empty or blank text has no window and stays as it is. Rows equal
in id and text are one document and are treated alike; rows with one id and different
texts are different documents. Input columns named like a result column are replaced.

Only hashes and positions are compared, never texts. A window of a third of all documents
is one row after map-side combine; its occurrences are joined with that one row, which
Spark's skew join splits. The texts are shuffled once, for the covered positions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.llm.frames import col, identity, unused

WINDOW = 3


def _raw_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def windows(text: Column, size: int = WINDOW) -> Column:
    """(h1, h2, first, last) of each window: hash and the numbers of its first and last line."""
    numbered = F.transform(
        _raw_lines(text), lambda line, at: F.struct(at.alias("at"), F.trim(line, F.lit(" \t\r")).alias("line"))
    )
    lines = F.filter(numbered, lambda x: x["line"] != "")

    def cut(found: Column) -> Column:
        many = F.greatest(F.size(found) - F.lit(size), F.lit(0))

        def window(start: Column) -> Column:
            part = F.slice(found, start + 1, F.lit(size))
            words = part["line"]
            return F.struct(
                F.xxhash64(F.lit(1), words).alias("h1"),
                F.xxhash64(F.lit(2), words).alias("h2"),
                F.element_at(part, 1)["at"].alias("first"),
                F.element_at(part, -1)["at"].alias("last"),
            )

        return F.when(F.size(found) > 0, F.transform(F.sequence(F.lit(0), many), window))

    # A list of one, so that the lines are found once and not once for each window.
    return F.flatten(F.filter(F.transform(F.array(lines), cut), F.isnotnull))


def covered_spans(keyed: DataFrame, size: int = WINDOW) -> DataFrame:
    """(k1, k2, spans): first and last line of each window of a document that stood earlier.

    ``keyed`` has k1 and k2 (the document's hash), doc_id and text.
    """
    cut = keyed.select("k1", "k2", "doc_id", F.explode(windows(F.col("text"), size)).alias("w"))
    found = cut.select("k1", "k2", "doc_id", "w.h1", "w.h2", "w.first", "w.last")
    place = F.struct("doc_id", "k1", "k2", "first")
    repeated = (
        found.groupBy("h1", "h2")
        .agg(F.min(place).alias("kept"), F.count("*").alias("times"))
        .where("times > 1")
        .select("h1", "h2", F.struct("kept.k1", "kept.k2", "kept.first").alias("kept"))
    )
    later = found.join(repeated, ["h1", "h2"]).where(F.struct("k1", "k2", "first") != F.col("kept"))
    return later.groupBy("k1", "k2").agg(F.collect_set(F.struct("first", "last")).alias("spans"))


def dedup_lines(frame: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The frame with repeated windows cut out of ``text``, and n_lines and n_removed."""
    k1, k2, spans = unused(frame, "k1", "k2", "spans")
    first, second = identity(col(doc_id), col(text))
    keyed = frame.select(
        first.alias("k1"), second.alias("k2"), col(doc_id).alias("doc_id"), col(text).cast("string").alias("text")
    )
    covered = covered_spans(keyed, size).toDF(k1, k2, spans)
    joined = frame.withColumns({k1: first, k2: second}).join(covered, [k1, k2], "left").drop(k1, k2)
    lines = _raw_lines(col(text))
    removed = F.array_distinct(F.flatten(F.transform(col(spans), lambda s: F.sequence(s["first"], s["last"]))))
    left = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), removed)
    rebuilt = F.array_join(F.transform(left, lambda at: F.get(lines, at)), "\n")
    return joined.withColumns(
        {
            "n_lines": F.coalesce(F.size(lines), F.lit(0)),
            "n_removed": F.coalesce(F.size(removed), F.lit(0)),
            text: F.when(col(spans).isNull(), col(text)).otherwise(rebuilt),
        }
    ).drop(spans)
