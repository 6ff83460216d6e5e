"""Column expressions for the measures the reports share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyline.schemas import API_REQUEST

# The parts of a request's token volume.
TOKEN_COLUMNS = ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens")
UNKNOWN = "Unknown"


def tokens() -> Column:
    """Token volume of one event; missing parts count as zero."""
    parts = [F.coalesce(F.col(name), F.lit(0).cast("bigint")) for name in TOKEN_COLUMNS]
    return parts[0] + parts[1] + parts[2] + parts[3]


def is_event(name: str) -> Column:
    return F.col("event_name") == name


def api_only(value: Column) -> Column:
    return F.when(is_event(API_REQUEST), value)


def or_zero(value: Column) -> Column:
    return F.coalesce(value, F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """``part / whole`` as a double, 0 where there is nothing to divide by."""
    return F.when(
        (whole == 0) | whole.isNull(), F.lit(0.0)
    ).otherwise(F.coalesce(part, F.lit(0)).cast("double") / whole)


def elapsed_ms(start: Column, end: Column) -> Column:
    """Milliseconds between two timestamps, counted as whole clock milliseconds."""
    return F.unix_millis(end) - F.unix_millis(start)


def resolved_practice() -> Column:
    """Practice of the employee, else the one the event carries."""
    return F.coalesce(F.col("practice"), F.col("resource_user_practice"))
