"""What usage costs, by dimension and per unit of work."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import (
    TOKEN_COLUMNS,
    UNKNOWN,
    api_only,
    is_event,
    or_zero,
    ratio,
    resolved_practice,
    tokens,
)
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters, with_employee
from tallyline.plans.dimensions import by_dimension
from tallyline.schemas import API_REQUEST, USER_PROMPT


def _measures() -> list[R.Measure]:
    return [
        R.count("request_count", is_event(API_REQUEST)),
        R.count("prompt_count", is_event(USER_PROMPT)),
        R.total("cost_usd", api_only(F.col("cost_usd"))),
        R.total("output_tokens", api_only(F.col("output_tokens"))),
    ]


def _unit_costs() -> list[Column]:
    cost = F.col("cost_usd")
    return [
        F.coalesce(cost, F.lit(0.0)).alias("cost_usd"),
        ratio(cost, F.col("active_users")).alias("cost_per_active_user"),
        ratio(cost, F.col("session_count")).alias("cost_per_session"),
        ratio(cost, F.col("prompt_count")).alias("cost_per_prompt"),
        ratio(cost * 1000, F.col("output_tokens")).alias("cost_per_1k_output_tokens"),
    ]


def cost_breakdown(
    events: DataFrame, employees: DataFrame, dimension: str, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    """Cost per value of a dimension, and per user, session, prompt and 1,000 output tokens."""
    measures = _measures()
    partial = by_dimension(events, employees, dimension, measures, filters, ("user_email", "session_id"))
    merged = partial.groupBy(dimension).agg(
        F.countDistinct("user_email").alias("active_users"),
        F.countDistinct("session_id").alias("session_count"),
        *[m.again() for m in measures],
    )
    return merged.select(
        dimension, "request_count", "active_users", "session_count", *_unit_costs()
    ).orderBy(F.desc("cost_usd"), F.asc_nulls_last(dimension))


def cost_totals(events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS) -> DataFrame:
    """The same figures over all matching events, in one row."""
    measures = _measures()
    partial = R.summarize(events, employees, filters, ["user_email", "session_id"], measures)
    merged = partial.agg(
        F.countDistinct("user_email").alias("active_users"),
        F.countDistinct("session_id").alias("session_count"),
        *[m.again() for m in measures],
    )
    return merged.select(
        or_zero(F.col("request_count")).alias("request_count"),
        "active_users",
        "session_count",
        *_unit_costs(),
    )


def cost_by_dimensions(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Requests and cost by day, model, practice, level and location at once, one per row.

    One scan: requests are counted per day, model and user, joined to employees, and
    grouped by every dimension with grouping sets.
    """
    measures = [R.count("request_count"), R.total("cost_usd", F.col("cost_usd"))]
    keys = ["event_date", "model", "user_email", "resource_user_practice"]
    small = R.summarize(
        events, employees, EventFilters(event_name=API_REQUEST), keys, measures
    )
    joined = with_employee(small, employees, ["practice", "level", "location"])
    labels = {
        "event_date": F.col("event_date").cast("string"),
        "model": F.coalesce("model", F.lit(UNKNOWN)),
        "practice": F.coalesce(resolved_practice(), F.lit(UNKNOWN)),
        "level": F.coalesce("level", F.lit(UNKNOWN)),
        "location": F.coalesce("location", F.lit(UNKNOWN)),
    }
    named = joined.select(*[c.alias(n) for n, c in labels.items()], *[m.name for m in measures])
    columns = [F.col(n) for n in labels]
    sets = named.groupingSets([[c] for c in columns], *columns).agg(
        *[F.grouping(n).alias(f"not_{n}") for n in labels], *[m.again() for m in measures]
    )
    dimension = F.coalesce(*[F.when(F.col(f"not_{n}") == 0, F.lit(n)) for n in labels])
    return sets.select(
        dimension.alias("dimension"),
        F.coalesce(*columns).alias("value"),
        "request_count",
        F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"),
    ).orderBy("dimension", "value")


def _cache_columns() -> list[Column]:
    return [
        *[or_zero(F.sum(name)).alias(name) for name in TOKEN_COLUMNS],
        ratio(F.sum("cache_read_tokens"), F.sum(tokens())).alias("cache_efficiency"),
    ]


def cache_efficiency(events: DataFrame) -> DataFrame:
    """Share of the processed tokens that were read from the cache."""
    return events.filter(is_event(API_REQUEST)).agg(*_cache_columns())


def daily_cache_efficiency(events: DataFrame) -> DataFrame:
    return (
        events.filter(is_event(API_REQUEST))
        .groupBy("event_date")
        .agg(*_cache_columns())
        .orderBy("event_date")
    )
