"""Telemetry batches: one JSON document per text line."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallyline.operators.flatten import flatten_batches
from tallyline.session import prepare

#: So many splits at most are told to every worker at once (about 60 bytes each); beyond, lines
#: are dealt to tasks by split.
BROADCAST_SPLITS = 1_000_000


def read_telemetry_batches(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """One row per logged event of the JSONL files at ``path`` (files, folders or globs)."""
    return flatten_batches(read_lines(spark, path))


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Every text line with its file and its line number: (source_file, line_number, value)."""
    text = prepare(spark).read.text(path)
    return number_lines(with_position(text), most_splits(text) <= BROADCAST_SPLITS)


def most_splits(text: DataFrame) -> int:
    """A bound of the number of splits of a text source, from its files' number and size."""
    size = int(text._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    least = text.sparkSession._jsparkSession.sessionState().conf().filesOpenCostInBytes()
    largest = text.sparkSession._jsparkSession.sessionState().conf().filesMaxPartitionBytes()
    return len(text._jdf.inputFiles()) + size // max(1, min(least, largest))


def with_position(text: DataFrame) -> DataFrame:
    """Add file, split start and a running row id to lines fresh from the text source."""
    return text.select(
        F.col("_metadata.file_path").alias("source_file"),
        F.col("_metadata.file_block_start").alias("_split"),
        F.monotonically_increasing_id().alias("_row"),
        "value",
    )


def number_lines(lines: DataFrame, few_splits: bool = False) -> DataFrame:
    """Turn positions into 1-based line numbers per file.

    Rows of one split are consecutive in ``_row``, so a line's number is its offset in the
    split plus the lines of the file's earlier splits. A second scan in the same plan counts
    lines per split; that small table, two numbers for each split, is broadcast to the
    lines if there are ``few_splits``, so that text isn't exchanged; else Spark chooses the
    join, and a split's lines meet in one task at most. Nothing runs before the lines are
    read, and no file is gathered in one task. A line whose split was not counted, or that
    lies outside of what was counted, stops the job instead of getting lost.
    """
    split = F.xxhash64("source_file", "_split")
    per_split = lines.groupBy("source_file", "_split").agg(
        F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_lines")
    )
    earlier = Window.partitionBy("source_file").orderBy("_split").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_lines").over(earlier), F.lit(0))
    offsets = (
        per_split.withColumn("_before", before)
        .groupBy(split.alias("_key"))
        .agg(F.max("_first").alias("_first"), F.max("_lines").alias("_lines"), F.max("_before").alias("_before"), F.count("*").alias("_splits"))
    )
    joined = lines.withColumn("_key", split).join(F.broadcast(offsets) if few_splits else offsets, "_key", "left")
    place = F.col("_row") - F.col("_first")
    counted = (F.col("_splits") == 1) & (place >= 0) & (place < F.col("_lines"))
    lost = F.raise_error(F.concat(F.lit("lines of a split were not counted: "), F.col("source_file")))
    return joined.select(
        "source_file",
        F.when(counted, (F.col("_before") + place + 1).cast("int")).otherwise(lost.cast("int")).alias("line_number"),
        "value",
    )
