"""The employee dimension from CSV."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.sources.batches import with_position
from tallyline.sources.records import read_records

# Cell texts that mean "no value".
NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)

# Position of a row in its file, used to keep the first of several rows; cleaning drops it.
FILE_ORDER = ("_file", "_split", "_row")


def read_employees_csv(
    spark: SparkSession, path: str | list[str], *, quoted_newlines: bool = True
) -> DataFrame:
    """All columns of a CSV with header, as text, plus each row's file position.

    Cells may hold line breaks, and files are read in splits all the same (see
    ``sources.records``). Turn ``quoted_newlines`` off for files without such cells: then a
    line is a record, and nothing is shuffled. Every file has to begin with the same header.
    """
    options = {"header": True, "quote": '"', "escape": '"', "multiLine": quoted_newlines}
    header = spark.read.options(**options).csv(path).schema
    schema = T.StructType([T.StructField(f.name, T.StringType()) for f in header])
    if quoted_newlines:
        table = _parsed(read_records(with_position(spark.read.option("lineSep", "\n").text(path))), schema)
        place = [F.col(c) for c in ("source_file", "_split", "_row")]
    else:
        table = spark.read.options(**options, enforceSchema=False).schema(schema).csv(path)
        place = [F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id()]
    cells = [
        F.when(~F.col(_quoted(name)).isin(*NULL_TOKENS), F.col(_quoted(name))).alias(name)
        for name in schema.names
    ]
    return table.select(*cells, *[c.alias(name) for c, name in zip(place, FILE_ORDER, strict=True)])


def _parsed(records: DataFrame, schema: T.StructType) -> DataFrame:
    """Cells of records; the first record of each file is its header, and goes."""
    wide = T.StructType([T.StructField(f"c{i}", T.StringType()) for i in range(len(schema))])
    cells = F.from_csv("record", wide.simpleString()[7:-1].replace(":", " "), {"quote": '"', "escape": '"', "multiLine": "true"})
    told = records.withColumn("_cells", cells)
    names = F.array(*map(F.lit, schema.names))
    same = F.array(*[F.lower(F.coalesce(f"_cells.{c}", F.lit(""))) for c in wide.names]) == F.transform(names, F.lower)
    other = F.raise_error(F.concat(F.lit("a file has another header: "), F.col("source_file"))).cast("boolean")
    rows = told.where(F.when(~F.col("first"), True).when(same, False).otherwise(other))
    return rows.select(*[F.col(f"_cells.{c}").alias(name) for c, name in zip(wide.names, schema.names, strict=True)], "source_file", "_split", "_row")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"
