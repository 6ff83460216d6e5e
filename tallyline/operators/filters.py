"""The filters every report shares."""

from __future__ import annotations

from dataclasses import dataclass, replace
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import resolved_practice
from tallyline.schemas import API_REQUEST

Moment = str | date | datetime


def require_positive(limit: int) -> int:
    if limit <= 0:
        raise ValueError(f"a positive number of rows is needed, not {limit}")
    return limit


@dataclass(frozen=True)
class EventFilters:
    """Optional conditions, all of which have to hold.

    ``start_date`` is included and ``end_date`` excluded. ``practice`` matches the
    employee's practice or, without one, the practice the event carries.
    ``model`` has two readings, chosen per report: the event itself names the
    model, or its session holds an API request with that model.
    """

    start_date: Moment | None = None
    end_date: Moment | None = None
    practice: str | None = None
    model: str | None = None
    event_name: str | None = None
    user_email: str | None = None
    tool_name: str | None = None
    terminal_type: str | None = None
    level: str | None = None
    location: str | None = None

    def through(self, last_day: Moment) -> EventFilters:
        """The same filters, ending with ``last_day`` included."""
        day = date.fromisoformat(str(last_day)[:10])
        return replace(self, end_date=date.fromordinal(day.toordinal() + 1).isoformat())

    def for_event(self, name: str) -> EventFilters:
        return replace(self, event_name=name)

    @property
    def employee_columns(self) -> list[str]:
        """Employee columns the conditions look at."""
        return [c for c in ("practice", "level", "location") if getattr(self, c) is not None]

    def on_events(self, events: DataFrame, *, by_session: bool = False) -> DataFrame:
        """Apply the conditions an event can answer alone, so they reach the scan."""
        out = events
        if self.start_date is not None:
            out = out.filter(F.col("event_timestamp") >= moment(self.start_date))
            out = out.filter(_day_open(events, F.col("event_date") >= F.to_date(moment(self.start_date))))
        if self.end_date is not None:
            out = out.filter(F.col("event_timestamp") < moment(self.end_date))
            out = out.filter(_day_open(events, F.col("event_date") <= F.to_date(moment(self.end_date))))
        for name in ("event_name", "user_email", "tool_name", "terminal_type"):
            if getattr(self, name) is not None:
                out = out.filter(F.col(name) == getattr(self, name))
        if self.model is not None and not by_session:
            out = out.filter(F.col("model") == self.model)
        return out

    def on_employees(self) -> Column | None:
        """Condition over joined employee columns (and the event's own practice)."""
        tests = []
        if self.practice is not None:
            tests.append(resolved_practice() == self.practice)
        if self.level is not None:
            tests.append(F.col("level") == self.level)
        if self.location is not None:
            tests.append(F.col("location") == self.location)
        if not tests:
            return None
        condition = tests[0]
        for test in tests[1:]:
            condition = condition & test
        return condition

    def model_sessions(self, events: DataFrame) -> DataFrame | None:
        """Sessions with a request to the model, whatever the other conditions say."""
        if self.model is None:
            return None
        hit = (F.col("event_name") == API_REQUEST) & (F.col("model") == self.model)
        return events.filter(hit & F.col("session_id").isNotNull()).select("session_id").distinct()

    def apply(self, events: DataFrame, employees: DataFrame, *, by_session: bool = False) -> DataFrame:
        """The matching events themselves."""
        out = self.on_events(events, by_session=by_session)
        if by_session and self.model is not None:
            out = out.join(self.model_sessions(events), "session_id", "left_semi")
        condition = self.on_employees()
        if condition is not None:
            out = with_employee(out, employees, self.employee_columns).filter(condition)
        return out.select(*events.columns)


NO_FILTERS = EventFilters()


def moment(value: Moment) -> Column:
    """A bound as a timestamp; without a zone it is UTC (the session zone)."""
    return F.lit(value if isinstance(value, str) else value.isoformat()).cast("timestamp")


def _day_open(events: DataFrame, condition: Column) -> Column:
    """Day condition that lets partitions be skipped and never rejects a missing day."""
    return F.col("event_date").isNull() | condition


def with_employee(frame: DataFrame, employees: DataFrame, columns: list[str]) -> DataFrame:
    """Add employee columns by e-mail; rows without an employee stay, with NULLs.

    E-mail is unique in ``employees``. Spark broadcasts the dimension when its
    measured size allows it and otherwise shuffles, splitting hot users (AQE).
    """
    side = employees.select(F.col("email").alias("_email"), *columns)
    return frame.join(side, frame["user_email"] == side["_email"], "left").drop("_email")
