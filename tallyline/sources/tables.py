"""Reads of the stored tables, as analysts ask for them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.operators.filters import EventFilters, require_positive, with_employee
from tallyline.schemas import EMPLOYEES, TELEMETRY_EVENTS

PERSON = ["full_name", "practice", "level", "location"]


def scan_employees(
    employees: DataFrame, *, practice: str | None = None, location: str | None = None
) -> DataFrame:
    out = employees
    if practice is not None:
        out = out.filter(F.col("practice") == practice)
    if location is not None:
        out = out.filter(F.col("location") == location)
    return out


def scan_events(
    events: DataFrame,
    *,
    event_name: str | None = None,
    user_email: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Matching events in time order (ties by id); with a limit, the earliest ones."""
    filters = EventFilters(
        event_name=event_name, user_email=user_email, start_date=start_date, end_date=end_date
    )
    return _in_time_order(filters.on_events(events), limit)


def scan_events_enriched(
    events: DataFrame,
    employees: DataFrame,
    *,
    event_name: str | None = None,
    practice: str | None = None,
    start_date: str | None = None,
    end_date: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Events with their employee's details; ``practice`` looks at the employee only.

    Without a practice condition the limit is taken before the join, which e-mail
    uniqueness allows. With one, Spark turns the left join into an inner join.
    """
    filters = EventFilters(event_name=event_name, start_date=start_date, end_date=end_date)
    matching = filters.on_events(events)
    if practice is None:
        cut = _in_time_order(matching, limit) if limit is not None else matching
        return _in_time_order(with_employee(cut, employees, PERSON), None)
    joined = with_employee(matching, employees, PERSON).filter(F.col("practice") == practice)
    return _in_time_order(joined, limit)


def count_rows(tables: dict[str, DataFrame], table: str) -> DataFrame:
    """Number of rows of one of the two stored tables."""
    if table not in (EMPLOYEES, TELEMETRY_EVENTS):
        raise ValueError(f"there is no table {table!r}, only {EMPLOYEES} and {TELEMETRY_EVENTS}")
    return tables[table].agg(F.count(F.lit(1)).alias("row_count"))


def _in_time_order(frame: DataFrame, limit: int | None) -> DataFrame:
    if limit is not None:
        require_positive(limit)
    ordered = frame.orderBy(F.asc_nulls_last("event_timestamp"), F.asc_nulls_last("event_id"))
    return ordered if limit is None else ordered.limit(limit)
