"""Requests, tokens and cost by model and by practice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import (
    TOKEN_COLUMNS,
    UNKNOWN,
    is_event,
    or_zero,
    ratio,
    resolved_practice,
    tokens,
)
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters
from tallyline.schemas import API_REQUEST


def requests_per_model(
    events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    measures = [
        R.count("request_count"),
        R.total("cost_usd", F.col("cost_usd")),
        R.total("duration", F.col("duration_ms")),
        R.known("durations", F.col("duration_ms")),
    ]
    out = _per_model(events, employees, filters, measures)
    return out.select(
        "model",
        "request_count",
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
        ratio(F.col("duration"), F.col("durations")).alias("average_duration_ms"),
    ).orderBy(F.desc("request_count"), "model")


def token_usage_per_model(
    events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    measures = [R.total(name, F.col(name)) for name in TOKEN_COLUMNS]
    measures.append(R.total("total_tokens", tokens()))
    out = _per_model(events, employees, filters, measures)
    return out.select(
        "model", *[or_zero(F.col(m.name)).alias(m.name) for m in measures]
    ).orderBy(F.desc("total_tokens"), "model")


def cost_per_practice(
    events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    """Requests are counted per user first; the join then sees one row per user and practice."""
    measures = [R.count("request_count"), R.total("cost_usd", F.col("cost_usd"))]
    partial = R.grains(
        events,
        employees,
        filters.for_event(API_REQUEST),
        ["user_email", "resource_user_practice"],
        measures,
        employee_columns=("practice",),
    )
    named = F.coalesce(resolved_practice(), F.lit(UNKNOWN)).alias("practice")
    per_user = R.merge(partial, [named, "user_email"], measures)
    return (
        per_user.groupBy("practice")
        .agg(
            F.sum("request_count").alias("request_count"),
            F.count("user_email").alias("active_users"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
        )
        .withColumn("cost_per_active_user", ratio(F.col("cost_usd"), F.col("active_users")))
        .orderBy(F.desc("cost_usd"), "practice")
    )


def average_tokens_per_model_request(events: DataFrame) -> DataFrame:
    return (
        events.filter(is_event(API_REQUEST) & F.col("model").isNotNull())
        .groupBy("model")
        .agg(
            F.count(F.lit(1)).alias("request_count"),
            F.coalesce(F.avg(tokens()), F.lit(0.0)).alias("average_tokens_per_request"),
        )
        .orderBy(F.desc("average_tokens_per_request"), "model")
    )


def _per_model(
    events: DataFrame, employees: DataFrame, filters: EventFilters, measures: list[R.Measure]
) -> DataFrame:
    return R.summarize(
        events,
        employees,
        filters.for_event(API_REQUEST),
        ["model"],
        measures,
        only=F.col("model").isNotNull(),
    )
