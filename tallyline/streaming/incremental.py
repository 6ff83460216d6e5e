"""Load new batch files as they arrive, with the same rules as a full load."""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass
from itertools import batched

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from tallyline.operators.cleaning import clean_events
from tallyline.operators.flatten import flatten_batches
from tallyline.operators.storage import exists, remove, save_events
from tallyline.plans.quality import reject_rows
from tallyline.schemas import NOT_NULL, TELEMETRY_EVENTS
from tallyline.session import prepare
from tallyline.sources.batches import read_lines

REJECTS = "rejects"
LEDGER = "files"
FLAT = "_flat"
FILES_PER_BATCH = 10_000
_FILE = ["path", "length", "modificationTime"]


@dataclass(frozen=True)
class Loaded:
    """What a call of ``incremental_load`` did."""

    files: int
    rows: int


def loaded_files(spark: SparkSession, root: str) -> DataFrame:
    """The ledger: (path, length, modificationTime, batch) of every file that was loaded."""
    schema = "path string, length long, modificationTime timestamp, batch int"
    if not exists(spark, f"{root}/{LEDGER}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{root}/{LEDGER}")


def new_files(spark: SparkSession, folder: str, root: str) -> DataFrame:
    """(path, length, modificationTime) of the files of a folder that are not in the ledger.

    A file that has changed since it was loaded is a new one.
    """
    # The source of whole files lists them as rows; their content isn't read.
    listed = spark.read.format("binaryFile").load(folder).select(*_FILE)
    return listed.join(loaded_files(spark, root).select(*_FILE), _FILE, "left_anti")


def incremental_load(
    spark: SparkSession, folder: str, root: str, *, files_per_batch: int = FILES_PER_BATCH
) -> Loaded:
    """Append the events of files not loaded before; call it again for later files.

    Which files were loaded is a table, ``root/files``, that is joined with the listing:
    files may be of any age, none is forgotten, and the driver holds the names of one batch
    only. The oldest come first. A batch's files enter the ledger after its events are
    stored; should that be repeated after a failure, the events are left out by their id.
    Rows that can't be loaded go to ``root/rejects``, one folder per batch. A batch's
    flattened rows are written once, to a folder of their own below ``root``, and read from
    there. One writer per root at a time.
    """
    if files_per_batch < 1:
        raise ValueError("files_per_batch must be positive")
    prepare(spark)
    number = loaded_files(spark, root).agg(F.coalesce(F.max("batch") + 1, F.lit(0))).first()[0]
    files = rows = 0
    waiting = new_files(spark, folder, root).orderBy("modificationTime", "path").toLocalIterator()
    for batch in batched(waiting, files_per_batch):
        rows += _absorb(spark, batch, root, number)
        files, number = files + len(batch), number + 1
    return Loaded(files, rows)


def _absorb(spark: SparkSession, files: tuple[Row, ...], root: str, number: int) -> int:
    """Store the events of some files, their rejects, and their names, in this order of visibility."""
    place = f"{root}/{FLAT}-{uuid.uuid4().hex}"
    try:
        flattened = flatten_batches(read_lines(spark, [_literally(f.path) for f in files]))
        flattened.write.parquet(place)
        flat = spark.read.schema(flattened.schema).parquet(place)
        reject_rows(flat).write.mode("overwrite").parquet(f"{root}/{REJECTS}/batch={number}")
        loadable = clean_events(flat).dropna(subset=list(NOT_NULL[TELEMETRY_EVENTS]))
        stored = save_events(loadable, root, replace=False, on_duplicate="first")
    finally:
        remove(spark, place)
    told = spark.createDataFrame([tuple(f) for f in files], "path string, length long, modificationTime timestamp")
    told.coalesce(1).write.mode("overwrite").parquet(f"{root}/{LEDGER}/batch={number}")
    return stored


def _literally(path: str) -> str:
    """A path whose characters stand for themselves, not for patterns."""
    return re.sub(r"([\[\]{}*?\\,])", r"\\\1", path)
