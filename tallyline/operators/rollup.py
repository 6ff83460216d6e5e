"""Aggregate first, then filter and join the much smaller result.

Practice, level, location and session conditions need a join. Joining whole
events would shuffle every row by user or session, and one hot user or session
would land in one task. Instead events are first aggregated (with map-side
combine) to the columns a report and its conditions use; conditions, joins and
the final aggregation then work on that.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.operators.filters import EventFilters, with_employee

_MERGE = {"sum": F.sum, "min": F.min, "max": F.max}


@dataclass(frozen=True)
class Measure:
    """An aggregate that can be computed in two steps."""

    name: str
    over_events: Column
    merge: str = "sum"

    def first(self) -> Column:
        return self.over_events.alias(self.name)

    def again(self) -> Column:
        return _MERGE[self.merge](self.name).alias(self.name)


def total(name: str, value: Column) -> Measure:
    return Measure(name, F.sum(value))


def count(name: str, condition: Column | None = None) -> Measure:
    """Number of events, or of those that meet the condition."""
    if condition is None:
        return Measure(name, F.count(F.lit(1)))
    return Measure(name, F.count(F.when(condition, F.lit(1))))


def known(name: str, value: Column) -> Measure:
    """Number of non-NULL values."""
    return Measure(name, F.count(value))


def earliest(name: str, value: Column) -> Measure:
    return Measure(name, F.min(value), "min")


def latest(name: str, value: Column) -> Measure:
    return Measure(name, F.max(value), "max")


def grains(
    events: DataFrame,
    employees: DataFrame,
    filters: EventFilters,
    keys: list[str],
    measures: list[Measure],
    *,
    only: Column | None = None,
    employee_columns: tuple[str, ...] = (),
    by_session: bool = False,
) -> DataFrame:
    """Measures of the matching events, at least as fine as ``keys``.

    ``only`` is a further condition on the counted events; it does not limit the
    events in which sessions of a model are looked up.
    Columns: the keys, any columns the conditions needed, the employee columns
    asked for, the measures. Merge with ``merge``.
    """
    by_model_session = by_session and filters.model is not None
    wanted = list(dict.fromkeys([*employee_columns, *filters.employee_columns]))
    grain = list(keys)
    if wanted:
        grain.append("user_email")
    if "practice" in wanted:
        grain.append("resource_user_practice")
    if by_model_session:
        grain.append("session_id")
    grain = list(dict.fromkeys(grain))

    matching = filters.on_events(events, by_session=by_session)
    if only is not None:
        matching = matching.filter(only)
    out = matching.groupBy(*grain).agg(*[m.first() for m in measures])
    if by_model_session:
        out = out.join(filters.model_sessions(events), "session_id", "left_semi")
    if wanted:
        out = with_employee(out, employees, wanted)
        condition = filters.on_employees()
        if condition is not None:
            out = out.filter(condition)
    return out


def merge(partial: DataFrame, keys: list[str | Column], measures: list[Measure]) -> DataFrame:
    """Bring partial measures to the final keys."""
    return partial.groupBy(*keys).agg(*[m.again() for m in measures])


def summarize(
    events: DataFrame,
    employees: DataFrame,
    filters: EventFilters,
    keys: list[str],
    measures: list[Measure],
    *,
    only: Column | None = None,
    by_session: bool = False,
) -> DataFrame:
    """Measures of the matching events per key."""
    partial = grains(
        events, employees, filters, keys, measures, only=only, by_session=by_session
    )
    if set(partial.columns) == {*keys, *(m.name for m in measures)}:
        return partial
    return merge(partial, keys, measures)
