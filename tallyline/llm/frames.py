"""Small helpers that the operators share: names, row identity, shared folder, Arrow text."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.session import checkpoint_folder

# Texts are handled in slices of about this many bytes, so that a batch of long texts
# needs no more memory than a batch of short ones. A longer text is a slice of its own.
SLICE_BYTES = 800_000


def quoted(name: str) -> str:
    """A column name as Spark's expressions want it, whatever it holds."""
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def unused(frame: DataFrame, *names: str) -> list[str]:
    """The given names, each lengthened until no column of the frame has it."""
    taken = {c.lower() for c in frame.columns}
    found = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found


def without(frame: DataFrame, *names: str) -> list[Column]:
    """The frame's columns but those of the given names (which an operator returns itself)."""
    drop = {n.lower() for n in names}
    return [col(c) for c in frame.columns if c.lower() not in drop]


def identity(*columns: Column) -> list[Column]:
    """Two 64-bit hashes that stand for the given values; nulls and their places count.

    Together they are 128 bits wide: among 10^12 different rows the chance of any two
    alike is about 10^-15, while 64 bits would be expected to give thousands.
    """
    told = [x for c in columns for x in (c.isNull(), c)]
    return [F.xxhash64(F.lit(1), *told), F.xxhash64(F.lit(2), *told)]


_SENT: set[str] = set()


def sent(frame: DataFrame) -> DataFrame:
    """The same frame, once the package is where this application's executors can import it."""
    context = frame.sparkSession.sparkContext
    if context.applicationId not in _SENT:
        package = Path(__file__).resolve().parent.parent
        archive = Path(tempfile.mkdtemp(prefix="tallyline-")) / "tallyline_package.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(package.rglob("*.py")):
                out.write(file, file.relative_to(package.parent))
        context.addPyFile(str(archive))
        _SENT.add(context.applicationId)
    return frame


def reliable(frame: DataFrame) -> DataFrame:
    """The frame, computed once and written to the folder that all executors share.

    A written table rather than a checkpoint: it is compressed, read by column, and its plan
    doesn't inherit the constraints of what it was made from, which grow from round to round.
    """
    spark = frame.sparkSession
    path = scratch(spark, "kept")
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


#: A key with this share of all rows or more is a heavy one; there can be no more of them.
HEAVY = 1000


def evenly_joined(rows: DataFrame, table: DataFrame, keys: list[str], count: str) -> DataFrame:
    """``rows`` left-joined with the other columns of ``table``, which has a row for each key.

    ``count`` names the column that says how many rows a key has. Heavy keys, HEAVY at most,
    are broadcast, and their rows are dealt to any task, so that copies of one thing don't
    meet in one. The table should be a stored one, as it is read three times.
    """
    values = [c for c in table.columns if c not in (*keys, count)]
    told = F.struct(*[F.col(quoted(c)) for c in values])
    least = (table.agg(F.sum(count)).first()[0] or 0) / HEAVY
    name, other, light = unused(rows, "held", "other", "light")
    heavy = table.where(F.col(count) >= least).select(*keys, told.alias(name))
    first = rows.join(F.broadcast(heavy), keys, "left")
    free = F.xxhash64(F.monotonically_increasing_id())
    kinds = dict(table.dtypes)
    # A row that is served already gets keys that lead anywhere, and a flag that fits none.
    dealt = {f"{light}{i}": F.when(F.col(name).isNull(), F.col(k)).otherwise(free.cast(kinds[k])) for i, k in enumerate(keys)}
    dealt[light] = F.col(name).isNull()
    rest = table.where(F.col(count) < least).select(
        *[F.col(k).alias(f"{light}{i}") for i, k in enumerate(keys)], F.lit(True).alias(light), told.alias(other)
    )
    joined = first.withColumns(dealt).join(rest, list(dealt), "left").withColumn(name, F.coalesce(name, other))
    return joined.select(*[col(c) for c in rows.columns], *[F.col(name)[c].alias(c) for c in values])


#: Rows that go to a worker at once where whole texts do; Spark's default is for short rows.
TEXTS_AT_ONCE = 1000


@contextmanager
def few_at_once(spark: SparkSession, rows: int = TEXTS_AT_ONCE) -> Iterator[None]:
    """Inside, jobs send fewer rows to a worker at once; afterwards the setting is as before."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(min(rows, int(before)) if int(before) > 0 else rows))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def scratch(spark: SparkSession, purpose: str) -> str:
    """A new path in the folder that all executors share."""
    return f"{checkpoint_folder(spark)}/{purpose}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a folder of intermediate results that nothing reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a text column, and where each row's begin (one more for the end)."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets


def slices(batches: Iterator[pa.RecordBatch], text: str, size: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Batches cut into runs of rows with about ``size`` bytes of text, one row at least."""
    for batch in batches:
        if not batch.num_rows:
            continue
        _, offsets = text_bytes(batch.column(text))
        at = 0
        while at < batch.num_rows:
            to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
            yield batch.slice(at, to - at)
            at = to
