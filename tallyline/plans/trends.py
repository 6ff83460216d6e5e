"""Figures per day; days without events are not listed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import is_event, ratio
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters
from tallyline.schemas import API_REQUEST, TOOL_RESULT


def _by_day(frame: DataFrame) -> DataFrame:
    return frame.orderBy(F.asc_nulls_last("event_date"))


def requests_per_day(
    events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    return _by_day(
        R.summarize(
            events,
            employees,
            filters.for_event(API_REQUEST),
            ["event_date"],
            [R.count("request_count")],
        ).select("event_date", "request_count")
    )


def daily_cost(events: DataFrame) -> DataFrame:
    return _by_day(
        events.filter(is_event(API_REQUEST))
        .groupBy("event_date")
        .agg(F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"))
    )


def daily_active_users(events: DataFrame) -> DataFrame:
    return _by_day(
        events.filter(F.col("user_email").isNotNull())
        .groupBy("event_date")
        .agg(F.countDistinct("user_email").alias("active_users"))
    )


def daily_success_rate(events: DataFrame) -> DataFrame:
    return _by_day(
        events.filter(is_event(TOOL_RESULT))
        .groupBy("event_date")
        .agg(
            F.count(F.lit(1)).alias("tool_result_count"),
            F.count(F.when(F.col("success"), 1)).alias("ok"),
        )
        .select(
            "event_date",
            "tool_result_count",
            ratio(F.col("ok"), F.col("tool_result_count")).alias("success_rate"),
        )
    )
