"""Cost reports."""

from __future__ import annotations

from catalog.base import TOKENS_SQL, report
from tallyline.operators.filters import EventFilters
from tallyline.plans import costs

_JOINED = "t LEFT JOIN e ON t.user_email = e.email"
_COST = "coalesce(sum(t.cost_usd) FILTER (WHERE t.event_name = 'api_request'), 0)"


def _per(unit: str, factor: str = "") -> str:
    return f"round(round(coalesce({_COST}{factor} / nullif({unit}, 0), 0), 9), 6)"


_FIGURES = f"""count(*) FILTER (WHERE t.event_name = 'api_request') AS request_count,
  count(DISTINCT t.user_email) AS active_users, count(DISTINCT t.session_id) AS session_count,
  round(round({_COST}, 9), 6) AS cost_usd,
  {_per("count(DISTINCT t.user_email)")} AS cost_per_active_user,
  {_per("count(DISTINCT t.session_id)")} AS cost_per_session,
  {_per("count(*) FILTER (WHERE t.event_name = 'user_prompt')")} AS cost_per_prompt,
  {_per("sum(t.output_tokens) FILTER (WHERE t.event_name = 'api_request')", " * 1000")} AS cost_per_1k_output_tokens"""

_DIMENSIONS = {
    "event_date": "t.event_date",
    "user_email": "t.user_email",
    "model": "t.model",
    "terminal_type": "t.terminal_type",
    "practice": "coalesce(e.practice, t.resource_user_practice, 'Unknown')",
    "level": "coalesce(e.level, 'Unknown')",
    "location": "coalesce(e.location, 'Unknown')",
}
for _name, _expression in _DIMENSIONS.items():
    report(
        f"cost_breakdown_by_{_name}",
        lambda t, e, name=_name: costs.cost_breakdown(t, e, name),
        f"SELECT {_expression} AS {_name}, {_FIGURES} FROM {_JOINED} GROUP BY {_expression}",
    )
report(
    "cost_breakdown_filtered",
    lambda t, e: costs.cost_breakdown(
        t, e, "level", EventFilters(practice="FURNITURE", start_date="2024-01-08")
    ),
    f"""SELECT coalesce(e.level, 'Unknown') AS level, {_FIGURES} FROM {_JOINED}
    WHERE coalesce(e.practice, t.resource_user_practice) = 'FURNITURE' AND t.event_timestamp >= TIMESTAMP '2024-01-08'
    GROUP BY 1""",
)
report("cost_totals", costs.cost_totals, f"SELECT {_FIGURES} FROM t")
report(
    "cost_by_dimensions",
    costs.cost_by_dimensions,
    " UNION ALL ".join(
        f"""SELECT '{name}' AS dimension, CAST({expression} AS STRING) AS value, count(*) AS request_count,
        round(round(coalesce(sum(t.cost_usd), 0), 9), 6) AS cost_usd
        FROM {_JOINED} WHERE t.event_name = 'api_request' GROUP BY {expression}"""
        for name, expression in {
            **{n: x for n, x in _DIMENSIONS.items() if n not in ("user_email", "terminal_type")},
            "model": "coalesce(t.model, 'Unknown')",
        }.items()
    ),
)
_CACHE = f"""CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens,
  CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
  round(round(sum(cache_read_tokens) / sum({TOKENS_SQL}), 9), 6) AS cache_efficiency"""
report(
    "cache_efficiency",
    lambda t, e: costs.cache_efficiency(t),
    f"SELECT {_CACHE} FROM t WHERE event_name = 'api_request'",
)
report(
    "daily_cache_efficiency",
    lambda t, e: costs.daily_cache_efficiency(t),
    f"SELECT event_date, {_CACHE} FROM t WHERE event_name = 'api_request' GROUP BY event_date",
)
