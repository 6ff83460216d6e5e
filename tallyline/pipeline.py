"""The whole load: read, flatten, clean, check, store."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tallyline.operators.cleaning import clean_employees, clean_events
from tallyline.operators.storage import exists, load_table, publish, published_loads, remove, stage
from tallyline.operators.validation import (
    EMPLOYEE_RULES,
    EVENT_RULES,
    column_issues,
    require,
    validate_employees,
    validate_events,
)
from tallyline.plans.quality import reject_rows
from tallyline.schemas import EMPLOYEES, TELEMETRY_EVENTS
from tallyline.session import prepare
from tallyline.sources.batches import read_telemetry_batches
from tallyline.sources.employees import read_employees_csv
from tallyline.streaming.incremental import REJECTS

# Default input locations.
TELEMETRY_PATH = "data/telemetry_logs.jsonl"
EMPLOYEES_PATH = "data/employees.csv"


def load_datasets(
    spark: SparkSession,
    telemetry_path: str | list[str] = TELEMETRY_PATH,
    employees_path: str | list[str] = EMPLOYEES_PATH,
) -> tuple[DataFrame, DataFrame]:
    """Flattened telemetry and raw employees."""
    return read_telemetry_batches(spark, telemetry_path), read_employees_csv(spark, employees_path)


def run_pipeline(
    spark: SparkSession,
    root: str,
    telemetry_path: str | list[str] = TELEMETRY_PATH,
    employees_path: str | list[str] = EMPLOYEES_PATH,
    *,
    replace: bool = True,
    on_duplicate: str = "error",
) -> dict[str, int]:
    """Load both tables below ``root``; returns the rows stored per table.

    Source text is parsed once, into Parquet of its own; events and rejects are made from
    there, and every check reads only the columns it needs. Nothing is published unless both
    inputs are valid; employees are published before events. Rows that can't be loaded go to
    ``root/rejects``, one folder per load; a load that fails leaves none.
    """
    prepare(spark)
    telemetry, employees = load_datasets(spark, telemetry_path, employees_path)
    # Before rows are cast to the stored types, and before anything is read.
    for rules, rows in ((EVENT_RULES, clean_events(telemetry)), (EMPLOYEE_RULES, clean_employees(employees))):
        require(rules.table, column_issues(rows, rules))
    staged, number = {}, uuid.uuid4().hex
    place, rejected = f"{root}/_flat-{number}", f"{root}/{REJECTS}/load={number}"
    try:
        telemetry.write.parquet(place)
        flat = spark.read.schema(telemetry.schema).parquet(place)
        for table, rows in ((TELEMETRY_EVENTS, clean_events(flat)), (EMPLOYEES, clean_employees(employees))):
            staged[table] = stage(rows, table, root)
        validate_events(staged[TELEMETRY_EVENTS].rows, staged[TELEMETRY_EVENTS].profile)
        validate_employees(staged[EMPLOYEES].rows, staged[EMPLOYEES].profile)
        reject_rows(flat).write.parquet(rejected)
        counts = {EMPLOYEES: publish(staged[EMPLOYEES], replace=replace)}
        counts[TELEMETRY_EVENTS] = publish(staged[TELEMETRY_EVENTS], replace=replace, on_duplicate=on_duplicate)
    except Exception:
        listed = {load.folder for table in staged for load in published_loads(spark, root, table)}
        for load in staged.values():
            if load.folder not in listed:
                load.discard()
        remove(spark, rejected)
        raise
    finally:
        remove(spark, place)
    return counts


def stored_rejects(spark: SparkSession, root: str) -> DataFrame:
    """Rows that loads and incremental batches could not load."""
    schema = "source_file string, line_number int, event_index int, event_id string, raw_text string, category string, message string"
    if not exists(spark, f"{root}/{REJECTS}"):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{root}/{REJECTS}")


def open_tables(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """The stored events and employees."""
    return load_table(spark, root, TELEMETRY_EVENTS), load_table(spark, root, EMPLOYEES)
