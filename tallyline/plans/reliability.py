"""Errors, latency and retries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import is_event, ratio
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters
from tallyline.operators.quantiles import COUNT, SUM, exact_percentiles
from tallyline.plans.dimensions import by_dimension
from tallyline.schemas import API_ERROR, API_REQUEST, TOOL_RESULT

# Status of a rate limit, and when a call counts as slow.
RATE_LIMITED = "429"
SLOW_MS = 30_000
UNDEFINED = "undefined"


def api_error_rate(
    events: DataFrame, employees: DataFrame, dimension: str | None = None, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    """Errors among requests and errors, overall or per value of a dimension."""
    measures = [
        R.count("request_count", is_event(API_REQUEST)),
        R.count("error_count", is_event(API_ERROR)),
    ]
    calls = events.filter(F.col("event_name").isin(API_REQUEST, API_ERROR))
    if dimension is None:
        counts = R.summarize(calls, employees, filters, [], measures)
    else:
        counts = by_dimension(calls, employees, dimension, measures, filters)
    rate = ratio(F.col("error_count"), F.col("request_count") + F.col("error_count"))
    keys = [] if dimension is None else [dimension]
    whole = [F.coalesce(m.name, F.lit(0)).alias(m.name) for m in measures]
    out = counts.select(*keys, *whole).withColumn("api_error_rate", rate)
    return out if dimension is None else out.orderBy(F.asc_nulls_last(dimension))


def errors_by_status(events: DataFrame) -> DataFrame:
    """API errors per status; a missing status counts as undefined."""
    return _errors_by(events, F.coalesce("status_code", F.lit(UNDEFINED)).alias("status_code"), "status_code")


def errors_by_message(events: DataFrame) -> DataFrame:
    return _errors_by(events, F.col("error"), "error")


def _errors_by(events: DataFrame, key, name: str) -> DataFrame:
    return (
        events.filter(is_event(API_ERROR))
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("error_count"))
        .orderBy(F.desc("error_count"), F.asc_nulls_last(name))
    )


def rate_limit_events(events: DataFrame, bucket: str = "1 hour") -> DataFrame:
    """Rate limited calls per user, organization and time bucket."""
    limited = events.filter(is_event(API_ERROR) & (F.col("status_code") == RATE_LIMITED))
    return (
        limited.groupBy(F.window("event_timestamp", bucket).alias("w"), "user_email", "organization_id")
        .agg(F.count(F.lit(1)).alias("rate_limit_count"))
        .select(F.col("w.start").alias("bucket_start"), "user_email", "organization_id", "rate_limit_count")
        .orderBy("bucket_start", "user_email", F.asc_nulls_last("organization_id"))
    )


def error_classes(events: DataFrame) -> DataFrame:
    """Authentication errors, rate limits, server errors and all others, in one row."""
    status = F.col("status_code")

    def number(condition, name: str):
        return F.count(F.when(condition, 1)).alias(name)

    return events.filter(is_event(API_ERROR)).agg(
        number(status == "401", "auth_error_count"),
        number(status == RATE_LIMITED, "rate_limit_count"),
        number(status == "500", "server_error_count"),
        number(F.coalesce(~status.isin("401", RATE_LIMITED, "500"), F.lit(True)), "other_error_count"),
    )


def latency_summary(events: DataFrame, dimension: str = "event_name", slow_ms: int = SLOW_MS) -> DataFrame:
    """Mean and 95th percentile duration and share of slow calls, of requests and tool results.

    Per event name, or per ``model`` or ``tool_name``; calls without a duration do not count.
    """
    if dimension not in ("event_name", "model", "tool_name", "terminal_type"):
        raise ValueError(f"Unsupported dimension: {dimension}")
    keys = list(dict.fromkeys(["event_name", dimension]))
    calls = events.filter(
        F.col("event_name").isin(API_REQUEST, TOOL_RESULT) & F.col("duration_ms").isNotNull()
    )
    slow = {"_slow": (F.col("duration_ms") > slow_ms).cast("int")}
    marks = exact_percentiles(calls, keys, "duration_ms", {"p95_duration_ms": 0.95}, slow)
    return marks.select(
        *keys,
        F.col(COUNT).alias("call_count"),
        (F.col(SUM) / F.col(COUNT)).alias("average_duration_ms"),
        "p95_duration_ms",
        ratio(F.col("_slow"), F.col(COUNT)).alias("slow_rate"),
    ).orderBy(*[F.asc_nulls_last(k) for k in keys])


def retry_patterns(events: DataFrame) -> DataFrame:
    """How many errors happened on which attempt, per status."""
    return (
        events.filter(is_event(API_ERROR) & F.col("attempt").isNotNull())
        .groupBy("attempt", F.coalesce("status_code", F.lit(UNDEFINED)).alias("status_code"))
        .agg(F.count(F.lit(1)).alias("error_count"))
        .orderBy("attempt", "status_code")
    )
