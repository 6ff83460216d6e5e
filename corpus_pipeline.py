"""A training corpus from documents: five stages, each of one operator of tallyline.llm.

Each stage takes the documents its predecessor left, and returns documents with the same
columns, the last one token pieces. Stages are joined by Parquet files in the folder that
all executors share, so that a lost executor costs a part of one stage only.

What every stage does with unusual documents: columns beyond text, id and language stay as
they are, whatever their names and values; an empty table stays one. A null or empty text
is of no language, so that the first stage removes it; given to a later stage, it has no
lines, no shingles and no words, which keeps it, and it is packed as its end id. Null ids
are ids like any other. Of rows equal in id and text, near-duplicate detection keeps one;
the other stages treat such rows alike. Ties are settled by id, then by the document's
hash; nulls come first for lines, last for near duplicates.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.llm import decontaminate, hyperminhash, language_mixture, line_dedup, packing
from tallyline.llm.frames import col, scratch, unused
from tallyline.llm.queries import table, tokenizer

#: A document stays if one language has at least this share of its words.
LEAST_SHARE = 0.4

#: No SQL says what these stages do; tests hold them against brute force.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a main language; the languages are learned from their own labels.

    Documents without a letter go. If no document has a language, all others stay.
    """
    return language_mixture.keep_identified(docs, language_mixture.learn(docs), least=LEAST_SHARE)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the windows of lines that stood earlier; those with nothing left go.

    A document that loses nothing stays as it is, also an empty one. ``n_chars``, if there
    is such a column, follows a text that changes.
    """
    # Columns that are called like the operator's results keep their values.
    other = {c: unused(docs, c)[0] for c in docs.columns if c.lower() in ("n_lines", "n_removed")}
    cleaned = line_dedup.dedup_lines(docs.withColumnsRenamed(other))
    left = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        changed = F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars"))
        left = left.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return left.select(*[col(other.get(c, c)).alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, at four fifths of shingles in common.

    That with the least id stays. Documents without words are no duplicates of one another,
    unless id and text are equal.
    """
    return hyperminhash.keep_one(docs).select(*map(col, docs.columns))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark, whatever their other columns are called."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*map(col, docs.columns))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, in sequences of 4096; a document without words has its end id."""
    return packing.pack(docs, tokenizer("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("line_dedup", lines),
    ("minhash_near_dedup", near_duplicates),
    ("decontamination", decontaminated),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces that the stages make of a folder's documents."""
    docs, place = table(spark, sf_dir, "documents"), scratch(spark, "pipeline")
    for number, (name, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{place}/{number}-{name}")
        docs = spark.read.schema(made.schema).parquet(f"{place}/{number}-{name}")
    return docs


QUERIES = {"pipeline": run}
ORACLES: dict[str, str] = {}
