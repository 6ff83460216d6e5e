"""Everything one overview page shows, under one set of filters."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyline.operators.filters import NO_FILTERS, EventFilters
from tallyline.plans import kpis, models, trends, users


def overview_report(
    events: DataFrame,
    employees: DataFrame,
    filters: EventFilters = NO_FILTERS,
    limit: int = 10,
) -> dict[str, DataFrame]:
    """Six lazy results. Each prunes its own columns and reads the events once,
    which costs less than keeping a shared copy of all matching events."""
    return {
        "kpi_summary": kpis.kpi_summary(events, employees, filters),
        "requests_per_day": trends.requests_per_day(events, employees, filters),
        "token_usage_per_model": models.token_usage_per_model(events, employees, filters),
        "cost_per_practice": models.cost_per_practice(events, employees, filters),
        "top_active_users": users.top_active_users(events, employees, filters, limit),
        "top_used_tools": users.top_used_tools(events, employees, filters, limit),
    }
