"""Figures by any one dimension, of the event or of its employee."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import UNKNOWN, resolved_practice
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters

# Dimensions of an event and of its employee.
EVENT_DIMENSIONS = (
    "event_date", "event_name", "user_email", "organization_id", "session_id", "model",
    "terminal_type", "tool_name", "decision", "source", "status_code", "error", "attempt",
)
EMPLOYEE_DIMENSIONS = ("practice", "level", "location")


def by_dimension(
    events: DataFrame,
    employees: DataFrame,
    dimension: str,
    measures: list[R.Measure],
    filters: EventFilters = NO_FILTERS,
    further: tuple[str, ...] = (),
) -> DataFrame:
    """Measures per value of a dimension (and ``further`` event columns).

    Employee dimensions: the events are counted per user first, then joined. Users
    without an employee fall back to the practice of their events, then to Unknown.
    Event dimensions keep their missing value as a NULL group.
    """
    if dimension in EVENT_DIMENSIONS:
        return R.summarize(events, employees, filters, list(dict.fromkeys([dimension, *further])), measures)
    if dimension not in EMPLOYEE_DIMENSIONS:
        raise ValueError(f"Unsupported dimension: {dimension}")
    keys = ["user_email", *further]
    if dimension == "practice":
        keys.append("resource_user_practice")
    partial = R.grains(
        events, employees, filters, list(dict.fromkeys(keys)), measures, employee_columns=(dimension,)
    )
    own = resolved_practice() if dimension == "practice" else F.col(dimension)
    return R.merge(partial, [F.coalesce(own, F.lit(UNKNOWN)).alias(dimension), *further], measures)


def value_counts(events: DataFrame, dimension: str, *, event_names: list[str] | None = None) -> DataFrame:
    """How often each known value of a column occurs, most frequent first."""
    rows = events.filter(F.col(dimension).isNotNull())
    if event_names is not None:
        rows = rows.filter(F.col("event_name").isin(event_names))
    return (
        rows.groupBy(dimension)
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.desc("event_count"), dimension)
    )
