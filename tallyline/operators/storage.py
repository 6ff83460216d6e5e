"""Stored tables: Parquet loads that become visible only after their checks pass.

A load is written once into its own folder below the table and checked there by
reading just the columns the checks need. Publishing replaces a small list of the
folders that make up the table, so readers see the old or the new table and a
failed load leaves the old one untouched. One writer per table at a time.

Rows that a load has to leave out are not written again without them: a small list beside
the load names them, and reading leaves them out (merge on read). Each load also has an
index of its keys, 32 bits of a hash for each in blocks, and the least and greatest key. An
append asks these first, and reads stored keys only of loads that may hold one of its own.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from functools import cached_property
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.operators.validation import Profile, ValidationError, profile_values
from tallyline.schemas import EMPLOYEES, JSON_COLUMNS, KEY, NOT_NULL, SCHEMA, TELEMETRY_EVENTS

_LIST, _RANGES, _KEYS, _HIDDEN = "_loads", "_ranges", "_keys", "_hidden"
REPEATS = "repeats"
#: Keys of a block of an index: a key that isn't there is taken for one that may be with a
#: chance of KEYS_IN_BLOCK / 2^32.
KEYS_IN_BLOCK = 1024
# The place of a stored row, which names it in lists of hidden rows.
_FILE, _ROW = "_file", "_row"


class Listed(NamedTuple):
    """A load that is part of a table, and its list of hidden rows, if it has one."""

    folder: str
    hidden: str = ""


class ConstraintError(ValidationError):
    """A load that breaks a key or a NOT NULL rule of its table."""


@dataclass(frozen=True)
class StagedLoad:
    """Rows written below a table but not yet part of it."""

    spark: SparkSession
    root: str
    table: str
    folder: str

    @property
    def rows(self) -> DataFrame:
        return _read_loads(self.spark, self.root, self.table, [Listed(self.folder)])

    @cached_property
    def profile(self) -> Profile:
        """Counts behind the checks of values, taken in one job."""
        wrong = {}
        if self.table == TELEMETRY_EVENTS:
            # Reports skip days by event_date, so it may not contradict the timestamp.
            wrong["day"] = F.col("event_date") != F.to_date("event_timestamp")
        # Distinct event ids are counted apart, to keep other columns out of that shuffle.
        key = KEY[self.table] if self.table == EMPLOYEES else None
        return profile_values(self.rows, NOT_NULL[self.table], key, wrong)

    def discard(self) -> None:
        remove(self.spark, f"{self.root}/{self.table}/{self.folder}")
        remove(self.spark, f"{self.root}/{self.table}/{_KEYS}/{self.folder}")


def save_employees(employees: DataFrame, root: str, *, replace: bool = True) -> int:
    """Store employees; returns the number of rows written."""
    return publish(stage(employees, EMPLOYEES, root), replace=replace)


def save_events(
    events: DataFrame, root: str, *, replace: bool = True, on_duplicate: str = "error"
) -> int:
    """Store events by day; returns the number of rows written.

    ``on_duplicate`` decides about a repeated ``event_id``: ``error`` fails the load,
    ``first`` keeps the first event in source order (and stored ones before new ones).
    The places of those left out are recorded below ``root/repeats``.
    """
    staged = stage(events, TELEMETRY_EVENTS, root)
    return publish(staged, replace=replace, on_duplicate=on_duplicate)


def load_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The published rows of a table; no rows before the first load."""
    return _read_loads(spark, root, table, published_loads(spark, root, table))


def align_to_schema(frame: DataFrame, schema: T.StructType) -> DataFrame:
    """Every column of the schema, in order and typed; others are dropped, absent ones NULL."""
    types = {field.name: field.dataType for field in frame.schema}
    return frame.select(*[_aligned(types.get(field.name), field).alias(field.name) for field in schema])


def _aligned(actual: T.DataType | None, field: T.StructField) -> Column:
    if actual is None:
        return F.lit(None).cast(field.dataType)
    column = F.col(field.name)
    if field.name in JSON_COLUMNS:
        return serialize_json(column, actual)
    if isinstance(field.dataType, T.IntegralType) and isinstance(actual, (T.DoubleType, T.FloatType)):
        column = F.rint(column)
    return column if actual == field.dataType else column.cast(field.dataType)


def serialize_json(column: Column, actual: T.DataType) -> Column:
    """JSON text of a structured value; text stays as it is, NULL stays NULL."""
    if isinstance(actual, T.StringType):
        return column
    if isinstance(actual, (T.StructType, T.MapType, T.ArrayType, T.VariantType)):
        return F.to_json(column)
    return column.cast("string")


def duplicate_keys(frame: DataFrame, key: str) -> DataFrame:
    """Keys that occur more than once, with their number of rows."""
    return frame.groupBy(key).agg(F.count(F.lit(1)).alias("copies")).filter("copies > 1")


def stage(frame: DataFrame, table: str, root: str) -> StagedLoad:
    """Write rows into a new load folder; days are spread over as many tasks as they need."""
    aligned = align_to_schema(frame, SCHEMA[table])
    load = StagedLoad(frame.sparkSession, root, table, f"load={uuid.uuid4().hex}")
    path = f"{root}/{table}/{load.folder}"
    if table == TELEMETRY_EVENTS:
        # AQE splits large days and merges small ones. Rows of one event name and
        # time lie together, so row groups can be skipped by their value ranges.
        (
            aligned.hint("rebalance", "event_date")
            .sortWithinPartitions("event_date", "event_name", "event_timestamp")
            .write.partitionBy("event_date")
            .parquet(path)
        )
    else:
        aligned.write.parquet(path)
    return load


def publish(load: StagedLoad, *, replace: bool = True, on_duplicate: str = "error") -> int:
    """Check a staged load and make it the table, or part of it. No rows: nothing happens."""
    if on_duplicate not in ("error", "first"):
        raise ValueError("on_duplicate must be 'error' or 'first'")
    spark, root, table = load.spark, load.root, load.table
    kept = [] if replace else published_loads(spark, root, table)
    hidden, told = "", f"{root}/{REPEATS}/{load.folder}"
    try:
        rows = _require_constraints(load)
        if rows:
            index = _write_index(load)
            known = _known_keys(load, kept, index) if kept else None
            if on_duplicate == "first":
                hidden = f"{uuid.uuid4().hex}"
                gone = _hide_repeats(load, known, f"{root}/{table}/{_HIDDEN}/{hidden}", told)
                rows, hidden = rows - gone, hidden if gone else ""
            else:
                _require_unique(load.rows, known, table)
    except Exception:
        load.discard()
        if hidden:
            remove(spark, f"{root}/{table}/{_HIDDEN}/{hidden}")
            remove(spark, told)
        raise
    if rows == 0:
        load.discard()
        if hidden:
            remove(spark, f"{root}/{table}/{_HIDDEN}/{hidden}")
    else:
        # Ranges of loads that are not listed say nothing, so that they can come first.
        ranges = {k: v for k, v in _ranges(spark, root, table).items() if k in {x.folder for x in kept}}
        _replace_file(spark, f"{root}/{table}/{_RANGES}", [json.dumps([k, *v]) for k, v in {**ranges, load.folder: index}.items()])
        _list_loads(spark, root, table, [*kept, Listed(load.folder, hidden)])
    return rows


def _require_constraints(load: StagedLoad) -> int:
    """Number of rows, after the NOT NULL rules and the day rule hold."""
    broken = ", ".join(f"{c}={n}" for c, n in load.profile.nulls.items() if n)
    if broken:
        raise ConstraintError(f"{load.table} has NULL in NOT NULL columns: {broken}")
    if load.profile.wrong.get("day"):
        raise ConstraintError(f"{load.table}.event_date differs from the day of event_timestamp")
    return load.profile.rows


def _require_unique(staged: DataFrame, known: DataFrame | None, table: str) -> None:
    """The key may not repeat within the load nor against stored rows."""
    key = KEY[table]
    doubled = duplicate_keys(staged, key).select(key)
    example = (known.first() if known is not None else None) or doubled.first()
    if example is not None:
        raise ConstraintError(f"{table}.{key} is not unique, for example {example[0]!r}")


def _print_of(key: str) -> Column:
    """32 bits of a hash that is not the one that names the block."""
    return F.xxhash64(F.lit(1), key).bitwiseAND(F.lit(0xFFFFFFFF)).alias("print")


def _write_index(load: StagedLoad) -> tuple[int, str, str]:
    """Write the load's index of keys; gives its number of blocks and the least and greatest key."""
    key, blocks = KEY[load.table], -(-load.profile.rows // KEYS_IN_BLOCK)
    keys = load.rows.select(key)
    prints = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"), _print_of(key)).distinct()
    listed = prints.groupBy("block").agg(F.collect_list("print").alias("prints"))
    listed.write.mode("overwrite").parquet(f"{load.root}/{load.table}/{_KEYS}/{load.folder}")
    low, high = keys.agg(F.min(key), F.max(key)).first()
    return blocks, low, high


def _ranges(spark: SparkSession, root: str, table: str) -> dict[str, tuple[int, str, str]]:
    """Blocks of the index, least and greatest key by load."""
    lines = _read_file(spark, f"{root}/{table}/{_RANGES}")
    return {folder: tuple(rest) for folder, *rest in map(json.loads, lines)}


def loads_with_keys(load: StagedLoad, kept: list[Listed], index: tuple[int, str, str]) -> tuple[list[Listed], DataFrame]:
    """Of the stored loads those that may hold a key of a staged one, and the keys in question.

    Ranges of keys are asked first, then indexes; a load without them may hold any key.
    """
    spark, key = load.spark, KEY[load.table]
    ranges, (_, low, high) = _ranges(spark, load.root, load.table), index
    unknown = [x for x in kept if x.folder not in ranges]
    near = [x for x in kept if x.folder in ranges and ranges[x.folder][1] <= high and low <= ranges[x.folder][2]]
    keys = load.rows.select(key)
    if not near:
        return unknown, keys
    paths = [f"{load.root}/{load.table}/{_KEYS}/{x.folder}" for x in near]
    stored = spark.read.schema("block long, prints array<long>").parquet(*paths)
    stored = stored.select(F.regexp_extract(F.col("_metadata.file_path"), f"{_KEYS}/([^/]+)/[^/]*$", 1).alias("load"), "block", "prints")
    asked = F.array(*[F.struct(F.lit(x.folder).alias("load"), F.lit(ranges[x.folder][0]).alias("blocks")) for x in near])
    told = keys.distinct().select(key, F.xxhash64(key).alias("_hash"), _print_of(key), F.explode(asked).alias("at"))
    told = told.select(key, "print", "at.load", F.pmod("_hash", "at.blocks").alias("block"))
    found = told.join(stored, ["load", "block"]).where(F.array_contains("prints", F.col("print"))).select(key, "load")
    names = {r["load"] for r in found.select("load").distinct().collect()}
    held = [x for x in near if x.folder in names]
    return [*unknown, *held], keys if unknown else found.select(key).distinct()


def _known_keys(load: StagedLoad, kept: list[Listed], index: tuple[int, str, str]) -> DataFrame | None:
    """Keys of the load that the table has already; None if no stored load may hold one.

    The load is the side Spark may broadcast, so a small load only scans the stored keys.
    """
    loads, keys = loads_with_keys(load, kept, index)
    if not loads:
        return None
    key = KEY[load.table]
    return _read_loads(load.spark, load.root, load.table, loads).select(key).join(keys, key, "left_semi").distinct()


def _hide_repeats(load: StagedLoad, known: DataFrame | None, hidden: str, told: str) -> int:
    """List the rows of a load whose key is stored already or stands earlier in it; their number.

    Only keys and places are read. Of rows at one place (files read twice) one stays.
    """
    key, spark = KEY[load.table], load.spark
    place = ["source_file", "line_number", "event_index"]
    rows = _read_loads(spark, load.root, load.table, [Listed(load.folder)], place=True).select(key, *place, _FILE, _ROW)
    here = F.struct(*place, _FILE, _ROW)
    several = rows.groupBy(key).agg(F.min(here).alias("_first"), F.count(F.lit(1)).alias("_copies")).where("_copies > 1")
    later = rows.join(several, key).where(here != F.col("_first")).select(rows.columns)
    if known is not None:
        of_known = rows.join(known, key, "left_semi")
        later = of_known.unionByName(later.join(known, key, "left_anti"))
    if later.isEmpty():
        return 0
    later.write.parquet(hidden)
    gone = spark.read.schema(later.schema).parquet(hidden)
    gone.groupBy(key, *place).agg(F.count(F.lit(1)).alias("left_out")).write.parquet(told)
    return gone.count()


def recorded_repeats(spark: SparkSession, root: str) -> DataFrame:
    """Places of events that loads have left out because their id was known."""
    schema = "event_id string, source_file string, line_number int, event_index int, left_out bigint"
    if not exists(spark, f"{root}/{REPEATS}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{REPEATS}")


def _read_loads(spark: SparkSession, root: str, table: str, loads: list[Listed], place: bool = False) -> DataFrame:
    """Rows of loads without their hidden ones; with ``place``, each with its file and row."""
    schema = SCHEMA[table]
    at = [_FILE, _ROW] if place else []
    if not loads:
        return spark.createDataFrame([], schema)

    def read(some: list[Listed], *more: str) -> DataFrame:
        paths = [f"{root}/{table}/{x.folder}" for x in some]
        frame = spark.read.schema(schema).option("basePath", f"{root}/{table}").parquet(*paths)
        file = F.regexp_extract("_metadata.file_path", ".*(load=[^/]*/.*)$", 1).alias(_FILE)
        known = {_FILE: file, _ROW: F.col("_metadata.row_index").alias(_ROW)}
        return frame.select(*schema.names, *[known[c] for c in more])

    whole, partly = [x for x in loads if not x.hidden], [x for x in loads if x.hidden]
    frames = [read(whole, *at)] if whole else []
    if partly:
        lists = [f"{root}/{table}/{_HIDDEN}/{x.hidden}" for x in partly]
        gone = spark.read.schema(f"{_FILE} string, {_ROW} long").parquet(*lists)
        frames.append(read(partly, _FILE, _ROW).join(gone, [_FILE, _ROW], "left_anti").select(*schema.names, *at))
    return frames[0] if len(frames) == 1 else frames[0].unionByName(frames[1])


def published_loads(spark: SparkSession, root: str, table: str) -> list[Listed]:
    """Loads that make up the table now."""
    return [Listed(*line.split()) for line in _read_file(spark, f"{root}/{table}/{_LIST}")]


def _read_file(spark: SparkSession, name: str) -> list[str]:
    """Lines of a small file; none if it isn't there."""
    path, fs = _hadoop(spark, name)
    if not fs.exists(path):
        return []
    stream = fs.open(path)
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return text.splitlines()


def remove_unlisted_loads(spark: SparkSession, root: str, table: str) -> int:
    """Delete folders of replaced loads; call it when no reader uses the old rows any more."""
    listed = published_loads(spark, root, table)
    known = {x.folder for x in listed} | {x.hidden for x in listed}
    removed = 0
    for below in ("", f"/{_KEYS}", f"/{_HIDDEN}"):
        path, fs = _hadoop(spark, f"{root}/{table}{below}")
        for status in fs.listStatus(path) if fs.exists(path) else []:
            name = status.getPath().getName()
            if name not in known and (below or name.startswith("load=")):
                fs.delete(status.getPath(), True)
                removed += not below
    return removed


def _list_loads(spark: SparkSession, root: str, table: str, loads: list[Listed]) -> None:
    _replace_file(spark, f"{root}/{table}/{_LIST}", [" ".join(filter(None, x)) for x in loads])


def _replace_file(spark: SparkSession, name: str, lines: list[str]) -> None:
    """Replace a small file by renaming a complete new one over it."""
    path, fs = _hadoop(spark, name)
    fresh, _ = _hadoop(spark, f"{name}.{uuid.uuid4().hex}")
    stream = fs.create(fresh)
    stream.write("\n".join(lines).encode())
    stream.close()
    jvm = spark._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    options = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 1)
    options[0] = jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri(), conf).rename(
        fs.makeQualified(fresh), fs.makeQualified(path), options
    )


def exists(spark: SparkSession, name: str) -> bool:
    path, fs = _hadoop(spark, name)
    return fs.exists(path)


def remove(spark: SparkSession, name: str) -> None:
    """Delete a folder with all that is in it, if it is there."""
    path, fs = _hadoop(spark, name)
    fs.delete(path, True)


def _hadoop(spark: SparkSession, name: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(name)
    return path, path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
