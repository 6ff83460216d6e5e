"""Headline figures."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import (
    TOKEN_COLUMNS,
    api_only,
    elapsed_ms,
    is_event,
    or_zero,
    ratio,
    tokens,
)
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters, with_employee
from tallyline.schemas import API_REQUEST, TOOL_RESULT


def total_users(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("user_email").alias("total_users"))


def total_sessions(events: DataFrame) -> DataFrame:
    return events.agg(F.countDistinct("session_id").alias("total_sessions"))


def total_events(events: DataFrame) -> DataFrame:
    return events.agg(F.count(F.lit(1)).alias("total_events"))


def total_token_usage(events: DataFrame) -> DataFrame:
    sums = [or_zero(F.sum(name)).alias(name) for name in TOKEN_COLUMNS]
    return events.filter(is_event(API_REQUEST)).agg(
        *sums, or_zero(F.sum(tokens())).alias("total_tokens")
    )


def total_cost(events: DataFrame) -> DataFrame:
    return events.filter(is_event(API_REQUEST)).agg(
        F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("total_cost_usd")
    )


def average_session_duration(events: DataFrame) -> DataFrame:
    per_session = (
        events.filter(F.col("session_id").isNotNull())
        .groupBy("session_id")
        .agg(elapsed_ms(F.min("event_timestamp"), F.max("event_timestamp")).alias("ms"))
    )
    return per_session.agg(
        F.coalesce(F.avg("ms"), F.lit(0.0)).alias("average_session_duration_ms")
    )


def success_rate(events: DataFrame) -> DataFrame:
    """A result without a success flag counts as a failure."""
    return (
        events.filter(is_event(TOOL_RESULT))
        .agg(
            F.count(F.lit(1)).alias("tool_result_count"),
            F.count(F.when(F.col("success"), 1)).alias("successful_tool_results"),
        )
        .withColumn(
            "success_rate", ratio(F.col("successful_tool_results"), F.col("tool_result_count"))
        )
    )


def average_tokens_per_request(events: DataFrame) -> DataFrame:
    return events.filter(is_event(API_REQUEST)).agg(
        F.count(F.lit(1)).alias("api_request_count"),
        F.coalesce(F.avg(tokens()), F.lit(0.0)).alias("average_tokens_per_request"),
    )


def kpi_summary(
    events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    """One row of headline figures over the matching events.

    One fact scan: (session, user) rows first, then session rows and user rows
    by grouping sets over that small frame, then one global aggregate.
    """
    measures = [
        R.earliest("first_at", F.col("event_timestamp")),
        R.latest("last_at", F.col("event_timestamp")),
        R.count("events"),
        R.total("cost", api_only(F.col("cost_usd"))),
        R.total("tokens", api_only(tokens())),
    ]
    keys = ["session_id", "user_email"]
    partial = R.grains(events, employees, filters, keys, measures, by_session=True)
    session, user = F.col("session_id"), F.col("user_email")
    either = (
        partial.groupingSets([[session], [user]], session, user)
        .agg(F.grouping("session_id").alias("is_user_row"), *[m.again() for m in measures])
    )
    is_user = F.col("is_user_row") == 1
    is_session = (F.col("is_user_row") == 0) & session.isNotNull()
    duration = F.when(is_session, elapsed_ms(F.col("first_at"), F.col("last_at")))
    return either.agg(
        F.count(F.when(is_user, user)).alias("total_users"),
        F.count(F.when(is_session, session)).alias("total_sessions"),
        or_zero(F.sum(F.when(is_user, F.col("events")))).alias("total_events"),
        F.coalesce(F.sum(F.when(is_user, F.col("cost"))), F.lit(0.0)).alias("total_cost_usd"),
        or_zero(F.sum(F.when(is_user, F.col("tokens")))).alias("total_tokens"),
        F.coalesce(F.avg(duration), F.lit(0.0)).alias("average_session_duration_ms"),
    )


def filter_options(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Values a filter can take: the day range, practices with usage, models."""
    used = events.groupBy("user_email", "model").agg(
        F.min("event_date").alias("first_day"), F.max("event_date").alias("last_day")
    )

    def listed(name: str):
        values = F.array_sort(F.collect_set(name))
        return F.when(F.size(values) > 0, values)

    return with_employee(used, employees, ["practice"]).agg(
        F.min("first_day").alias("min_date"),
        F.max("last_day").alias("max_date"),
        listed("practice").alias("practices"),
        listed("model").alias("models"),
    )
