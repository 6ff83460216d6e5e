"""Wide scorecards per day, practice, model and user."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import api_only, is_event, ratio, tokens
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters
from tallyline.plans.dimensions import by_dimension
from tallyline.schemas import API_ERROR, API_REQUEST, TOOL_RESULT, USER_PROMPT


def _measures() -> list[R.Measure]:
    return [
        R.count("event_count"),
        R.count("prompt_count", is_event(USER_PROMPT)),
        R.count("request_count", is_event(API_REQUEST)),
        R.count("error_count", is_event(API_ERROR)),
        R.count("tool_result_count", is_event(TOOL_RESULT)),
        R.count("ok_count", is_event(TOOL_RESULT) & F.col("success")),
        R.total("cost_usd", api_only(F.col("cost_usd"))),
        R.total("total_tokens", api_only(tokens())),
        R.total("duration", api_only(F.col("duration_ms"))),
        R.known("durations", api_only(F.col("duration_ms"))),
    ]


def _figures() -> list[Column]:
    """Columns every scorecard ends with, from merged measures."""
    attempts = F.col("request_count") + F.col("error_count")
    return [
        F.col("event_count"),
        F.col("prompt_count"),
        F.col("request_count"),
        F.col("error_count"),
        ratio(F.col("error_count"), attempts).alias("api_error_rate"),
        F.col("tool_result_count"),
        ratio(F.col("ok_count"), F.col("tool_result_count")).alias("success_rate"),
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        F.coalesce("total_tokens", F.lit(0)).alias("total_tokens"),
        ratio(F.col("duration"), F.col("durations")).alias("average_duration_ms"),
    ]


def scorecard(
    events: DataFrame, employees: DataFrame, dimension: str, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    """Volume, reach, cost and reliability per value of a dimension.

    Users and sessions are counted over (dimension, user, session) rows, a small frame
    compared to the events.
    """
    measures = _measures()
    partial = by_dimension(events, employees, dimension, measures, filters, ("user_email", "session_id"))
    merged = partial.groupBy(dimension).agg(
        F.countDistinct("user_email").alias("active_users"),
        F.countDistinct("session_id").alias("session_count"),
        *[m.again() for m in measures],
    )
    return merged.select(dimension, "active_users", "session_count", *_figures())


def daily_kpis(events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS) -> DataFrame:
    return scorecard(events, employees, "event_date", filters).orderBy("event_date")


def practice_kpis(events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS) -> DataFrame:
    """Per practice, with the number of its employees and the share of them that is active."""
    staff = employees.groupBy("practice").agg(F.count(F.lit(1)).alias("employee_count"))
    return (
        scorecard(events, employees, "practice", filters)
        .join(staff, "practice", "left")
        .withColumn("employee_count", F.coalesce("employee_count", F.lit(0)))
        .withColumn("cost_per_employee", ratio(F.col("cost_usd"), F.col("employee_count")))
        .orderBy(F.desc("cost_usd"), "practice")
    )


def model_kpis(events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS) -> DataFrame:
    """Per model; events without a model are left out."""
    known = events.filter(F.col("model").isNotNull())
    return scorecard(known, employees, "model", filters).orderBy(F.desc("request_count"), "model")


def user_kpis(events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS) -> DataFrame:
    known = events.filter(F.col("user_email").isNotNull())
    return (
        scorecard(known, employees, "user_email", filters)
        .drop("active_users")
        .orderBy(F.desc("cost_usd"), "user_email")
    )
