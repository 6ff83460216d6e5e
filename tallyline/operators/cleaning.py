"""Flattened text rows to typed rows."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.parsing import (
    clean_text,
    snake_case,
    to_decimal_number,
    to_flag,
    to_utc,
    to_whole_number,
)
from tallyline.schemas import (
    DECIMAL_COLUMNS,
    EMPLOYEE_COLUMNS,
    EVENT_MUST_HAVE,
    EVENT_SCHEMA,
    REDACTED_PROMPT,
    TEXT_COLUMNS,
    WHOLE_NUMBER_COLUMNS,
)
from tallyline.sources.employees import FILE_ORDER


def clean_events(flat: DataFrame) -> DataFrame:
    """Drop unusable rows, then type and tidy the columns that are there.

    Rows are dropped before blanks become NULL, so a blank id stays and is left
    for validation to report.
    """
    return (
        flat.transform(standardize_column_names)
        .transform(drop_malformed)
        .transform(drop_missing_required, EVENT_MUST_HAVE)
        .transform(normalize_timestamps)
        .transform(derive_event_date)
        .transform(convert_numbers)
        .transform(convert_flags)
        .transform(clean_strings, TEXT_COLUMNS)
        .transform(flag_prompt_redacted)
    )


def clean_employees(raw: DataFrame) -> DataFrame:
    """Tidy employee rows, lower-case the e-mail and keep the first row of each."""
    order = [c for c in FILE_ORDER if c in raw.columns]
    if not order:
        raw, order = raw.withColumn(FILE_ORDER[-1], F.monotonically_increasing_id()), [FILE_ORDER[-1]]
    named = standardize_column_names(raw, keep=order)
    tidy = clean_strings(drop_missing_required(named, EMPLOYEE_COLUMNS), EMPLOYEE_COLUMNS)
    return first_per_key(tidy.withColumn("email", F.lower("email")), "email", order).drop(*order)


def standardize_column_names(frame: DataFrame, keep: Iterable[str] = ()) -> DataFrame:
    """Columns in snake case; two columns that would share a name are an error."""
    names = [name if name in keep else snake_case(name) for name in frame.columns]
    doubled = sorted({name for name in names if names.count(name) > 1})
    if doubled:
        raise ValueError(f"columns share a standard name: {', '.join(doubled)}")
    return frame if names == frame.columns else frame.toDF(*names)


def drop_malformed(frame: DataFrame) -> DataFrame:
    """Keep rows not marked as malformed; no mark counts as fine."""
    if "is_malformed" not in frame.columns:
        return frame
    return frame.filter(~F.coalesce(F.col("is_malformed"), F.lit(False)))


def drop_missing_required(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Drop rows with NULL in one of the columns that are there."""
    there = _there(frame, columns)
    return frame.dropna(subset=there) if there else frame


def normalize_timestamps(frame: DataFrame, column: str = "event_timestamp") -> DataFrame:
    """ISO text to UTC timestamps; rows whose text is no timestamp are dropped."""
    if column not in frame.columns:
        return frame
    if frame.schema[column].dataType.typeName() == "string":
        frame = frame.withColumn(column, to_utc(F.col(column)))
    return frame.filter(F.col(column).isNotNull())


def derive_event_date(frame: DataFrame) -> DataFrame:
    """The UTC day of the timestamp."""
    if "event_timestamp" not in frame.columns:
        return frame
    return frame.withColumn("event_date", F.to_date("event_timestamp"))


def convert_numbers(frame: DataFrame) -> DataFrame:
    """Numbers from text; what is not a number becomes NULL."""
    whole = {
        name: to_whole_number(F.col(name), EVENT_SCHEMA[name].dataType.simpleString())
        for name in _there(frame, WHOLE_NUMBER_COLUMNS)
    }
    decimal = {c: to_decimal_number(F.col(c)) for c in _there(frame, DECIMAL_COLUMNS)}
    return frame.withColumns({**whole, **decimal})


def convert_flags(frame: DataFrame, columns: Iterable[str] = ("success",)) -> DataFrame:
    return frame.withColumns({c: to_flag(F.col(c)) for c in _there(frame, columns)})


def clean_strings(frame: DataFrame, columns: Iterable[str]) -> DataFrame:
    """Strip text columns and turn blanks into NULL."""
    return frame.withColumns(
        {c: clean_text(F.col(c).cast("string")) for c in _there(frame, columns)}
    )


def flag_prompt_redacted(frame: DataFrame) -> DataFrame:
    """Whether the prompt text was removed at the source; NULL without a prompt."""
    if "prompt" not in frame.columns:
        return frame
    return frame.withColumn("prompt_redacted", F.col("prompt") == REDACTED_PROMPT)


def _there(frame: DataFrame, columns: Iterable[str]) -> list[str]:
    """The given columns that the frame has."""
    known = set(frame.columns)
    return [c for c in columns if c in known]


def first_per_key(frame: DataFrame, key: str, order: list[str | Column]) -> DataFrame:
    """The first row of each key in the given order.

    An aggregate rather than a window: copies of one key collapse on the map side,
    so a key with very many rows does not meet in one task.
    """
    row = F.struct(*frame.columns)
    kept = frame.groupBy(F.col(key).alias("_key")).agg(F.min_by(row, F.struct(*order)).alias("_kept"))
    return kept.select("_kept.*")
