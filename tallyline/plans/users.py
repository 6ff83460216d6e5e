"""Activity per user and per tool."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import api_only, is_event, ratio
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters, require_positive, with_employee
from tallyline.schemas import API_REQUEST, TOOL_RESULT, USER_PROMPT

PERSON = ["full_name", "practice", "level", "location"]


def _activity(
    events: DataFrame, employees: DataFrame, filters: EventFilters, extra: list[R.Measure]
) -> DataFrame:
    """One row per user, counted over (user, session) rows so sessions need no distinct pass."""
    measures = [
        R.count("event_count"),
        R.count("prompt_count", is_event(USER_PROMPT)),
        R.count("api_request_count", is_event(API_REQUEST)),
        *extra,
        R.total("cost_usd", api_only(F.col("cost_usd"))),
    ]
    keys = ["user_email", "session_id"]
    per_session = R.summarize(
        events,
        employees,
        filters,
        keys,
        measures,
        only=F.col("user_email").isNotNull(),
        by_session=True,
    )
    out = per_session.groupBy("user_email").agg(
        F.count("session_id").alias("session_count"), *[m.again() for m in measures]
    )
    return out.select(
        "user_email",
        "event_count",
        "session_count",
        "prompt_count",
        "api_request_count",
        *[m.name for m in extra],
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
    )


def _most_active_first(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.desc("event_count"), "user_email")


def _described(users: DataFrame, employees: DataFrame) -> DataFrame:
    counts = [c for c in users.columns if c != "user_email"]
    return with_employee(users, employees, PERSON).select("user_email", *PERSON, *counts)


def top_active_users(
    events: DataFrame,
    employees: DataFrame,
    filters: EventFilters = NO_FILTERS,
    limit: int = 10,
) -> DataFrame:
    """The ranking is cut before employees are joined: e-mail alone decides it."""
    require_positive(limit)
    top = _most_active_first(_activity(events, employees, filters, [])).limit(limit)
    return _most_active_first(_described(top, employees))


def user_activity_summary(events: DataFrame, employees: DataFrame) -> DataFrame:
    extra = [R.count("tool_result_count", is_event(TOOL_RESULT))]
    users = _activity(events, employees, NO_FILTERS, extra)
    return _most_active_first(_described(users, employees))


def top_used_tools(
    events: DataFrame,
    employees: DataFrame,
    filters: EventFilters = NO_FILTERS,
    limit: int = 10,
) -> DataFrame:
    require_positive(limit)
    measures = [
        R.count("tool_result_count"),
        R.count("successful_tool_results", F.col("success")),
        R.total("duration", F.col("duration_ms")),
        R.known("durations", F.col("duration_ms")),
    ]
    out = R.summarize(
        events,
        employees,
        filters.for_event(TOOL_RESULT),
        ["tool_name"],
        measures,
        only=F.col("tool_name").isNotNull(),
        by_session=True,
    )
    return (
        out.select(
            "tool_name",
            "tool_result_count",
            "successful_tool_results",
            ratio(F.col("successful_tool_results"), F.col("tool_result_count")).alias(
                "success_rate"
            ),
            ratio(F.col("duration"), F.col("durations")).alias("average_duration_ms"),
        )
        .orderBy(F.desc("tool_result_count"), "tool_name")
        .limit(limit)
    )
