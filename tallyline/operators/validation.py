"""What a table has to be like before it is stored, as rules, and what breaks them.

A table's rules are data: its fields, the kind and need of each, and its key. All of them
are looked at together: columns and types from the schema, values in one aggregate. The
outcome is a list of issues, so that a load that fails says everything that is wrong.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.schemas import EMPLOYEES, KEY, NOT_NULL, TELEMETRY_EVENTS

TEXT, NUMBER, TIME, FLAG = "text", "number", "time", "flag"
_TYPES = {
    TEXT: T.StringType,
    NUMBER: T.NumericType,
    TIME: (T.TimestampType, T.TimestampNTZType),
    FLAG: T.BooleanType,
}


@dataclass(frozen=True)
class Field:
    """A column's kind; if ``needed``, it has to be there and may hold no NULL."""

    name: str
    kind: str
    needed: bool = False


@dataclass(frozen=True)
class Rules:
    """The rules of a table; ``key`` may not repeat, unless that is checked elsewhere."""

    table: str
    fields: tuple[Field, ...]
    key: str | None = None


def _fields(needed: Sequence[str], **kinds: Sequence[str]) -> tuple[Field, ...]:
    return tuple(Field(name, kind, name in needed) for kind, names in kinds.items() for name in names)


EVENT_RULES = Rules(
    TELEMETRY_EVENTS,
    _fields(
        NOT_NULL[TELEMETRY_EVENTS],
        text=("event_id", "event_name", "user_email", "session_id"),
        time=("event_timestamp",),
        number=("cost_usd", "duration_ms", "input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens"),
        flag=("success",),
    ),
)
EMPLOYEE_RULES = Rules(EMPLOYEES, _fields(NOT_NULL[EMPLOYEES], text=NOT_NULL[EMPLOYEES]), KEY[EMPLOYEES])


@dataclass(frozen=True)
class Issue:
    """One broken rule: what is wrong with which field, in how many rows if rows are wrong."""

    problem: str
    field: str | None = None
    amount: int | None = None

    def __str__(self) -> str:
        where = f" {self.field}" if self.field else ""
        return f"{self.problem}{where}" + (f" ({self.amount} rows)" if self.amount else "")


NO_ROWS, NO_COLUMN, NO_VALUE, REPEATED = "no rows", "column not there:", "NULL in", "repeated key"
WRONG_KIND = {kind: f"no {kind} column:" for kind in _TYPES}


class ValidationError(ValueError):
    """A table that may not be stored; ``issues`` has all that is wrong with it."""

    def __init__(self, table: str, issues: Sequence[Issue] = ()):
        self.issues = tuple(issues)
        super().__init__(f"{table}: {'; '.join(map(str, issues))}" if issues else table)


@dataclass(frozen=True)
class Profile:
    """Rows, NULLs per needed column, distinct keys, and rows per condition of a table."""

    rows: int
    nulls: dict[str, int]
    keys: int | None
    wrong: dict[str, int]


def profile_values(
    frame: DataFrame, needed: Sequence[str], key: str | None = None, wrong: Mapping[str, Column] | None = None
) -> Profile:
    """Count everything the checks of values want, in one job."""
    there = [c for c in needed if c in frame.columns]
    key = key if key in frame.columns else None
    counts = {"rows": F.count(F.lit(1)), "keys": F.countDistinct(key) if key else F.lit(None)}
    counts |= {f"null {c}": F.count_if(F.col(c).isNull()) for c in there}
    counts |= {f"wrong {name}": F.count_if(test) for name, test in (wrong or {}).items()}
    found = frame.agg(*[column.alias(name) for name, column in counts.items()]).first().asDict()
    return Profile(
        found["rows"],
        {c: found[f"null {c}"] for c in there},
        found["keys"],
        {name: found[f"wrong {name}"] for name in wrong or {}},
    )


def column_issues(frame: DataFrame, rules: Rules) -> list[Issue]:
    """Columns that are not there or not of their kind; no job runs."""
    types = {f.name: f.dataType for f in frame.schema}
    absent = [Issue(NO_COLUMN, f.name) for f in rules.fields if f.needed and f.name not in types]
    other = [
        Issue(WRONG_KIND[f.kind], f.name)
        for f in rules.fields
        if f.name in types and not isinstance(types[f.name], _TYPES[f.kind])
    ]
    return absent + other


def value_issues(profile: Profile, rules: Rules) -> list[Issue]:
    """What the counts of a table's values show."""
    if not profile.rows:
        return [Issue(NO_ROWS)]
    found = [Issue(NO_VALUE, name, n) for name, n in profile.nulls.items() if n]
    if rules.key and profile.keys is not None and profile.keys < profile.rows:
        found.append(Issue(REPEATED, rules.key, profile.rows - profile.keys))
    return found


def find_issues(frame: DataFrame, rules: Rules, profile: Profile | None = None) -> list[Issue]:
    """Everything that is wrong with a table; pass the counts if they are taken already."""
    if profile is None:
        profile = profile_values(frame, [f.name for f in rules.fields if f.needed], rules.key)
    return column_issues(frame, rules) + value_issues(profile, rules)


def require(table: str, issues: Sequence[Issue]) -> None:
    """Fail if there are issues."""
    if issues:
        raise ValidationError(table, issues)


def validate_events(events: DataFrame, profile: Profile | None = None) -> None:
    require(TELEMETRY_EVENTS, find_issues(events, EVENT_RULES, profile))


def validate_employees(employees: DataFrame, profile: Profile | None = None) -> None:
    require(EMPLOYEES, find_issues(employees, EMPLOYEE_RULES, profile))
