"""Reliability reports."""

from __future__ import annotations

from catalog.base import report
from tallyline.plans import reliability

_JOINED = "t LEFT JOIN e ON t.user_email = e.email"
_ERRORS = "FROM t WHERE event_name = 'api_error'"
_RATE = """count(*) FILTER (WHERE t.event_name = 'api_request') AS request_count,
  count(*) FILTER (WHERE t.event_name = 'api_error') AS error_count,
  round(round(count(*) FILTER (WHERE t.event_name = 'api_error') / count(*), 9), 6) AS api_error_rate"""
_CALLS = "t.event_name IN ('api_request', 'api_error')"

report("api_error_rate", lambda t, e: reliability.api_error_rate(t, e), f"SELECT {_RATE} FROM t WHERE {_CALLS}")
for _name, _expression in {
    "event_date": "t.event_date",
    "model": "t.model",
    "terminal_type": "t.terminal_type",
    "practice": "coalesce(e.practice, t.resource_user_practice, 'Unknown')",
}.items():
    report(
        f"api_error_rate_by_{_name}",
        lambda t, e, name=_name: reliability.api_error_rate(t, e, name),
        f"SELECT {_expression} AS {_name}, {_RATE} FROM {_JOINED} WHERE {_CALLS} GROUP BY 1",
    )
report(
    "errors_by_status",
    lambda t, e: reliability.errors_by_status(t),
    f"SELECT coalesce(status_code, 'undefined') AS status_code, count(*) AS error_count {_ERRORS} GROUP BY 1",
)
report(
    "errors_by_message",
    lambda t, e: reliability.errors_by_message(t),
    f"SELECT error, count(*) AS error_count {_ERRORS} GROUP BY 1",
)
report(
    "rate_limit_events",
    lambda t, e: reliability.rate_limit_events(t),
    f"""SELECT date_trunc('hour', event_timestamp) AS bucket_start, user_email, organization_id, count(*) AS rate_limit_count
    {_ERRORS} AND status_code = '429' GROUP BY 1, 2, 3""",
)
report(
    "error_classes",
    lambda t, e: reliability.error_classes(t),
    f"""SELECT count(*) FILTER (WHERE status_code = '401') AS auth_error_count,
    count(*) FILTER (WHERE status_code = '429') AS rate_limit_count,
    count(*) FILTER (WHERE status_code = '500') AS server_error_count,
    count(*) FILTER (WHERE status_code IS NULL OR status_code NOT IN ('401', '429', '500')) AS other_error_count {_ERRORS}""",
)
for _dimension in ("event_name", "model", "tool_name", "terminal_type"):
    _keys = "event_name" if _dimension == "event_name" else f"event_name, {_dimension}"
    report(
        f"latency_summary_by_{_dimension}",
        lambda t, e, dimension=_dimension: reliability.latency_summary(t, dimension, slow_ms=15_000),
        f"""SELECT {_keys}, count(*) AS call_count, round(round(avg(duration_ms), 9), 6) AS average_duration_ms,
        round(round(quantile_cont(duration_ms, 0.95), 9), 6) AS p95_duration_ms,
        round(round(count(*) FILTER (WHERE duration_ms > 15000) / count(*), 9), 6) AS slow_rate
        FROM t WHERE event_name IN ('api_request', 'tool_result') AND duration_ms IS NOT NULL GROUP BY {_keys}""",
    )
report(
    "retry_patterns",
    lambda t, e: reliability.retry_patterns(t),
    f"""SELECT attempt, coalesce(status_code, 'undefined') AS status_code, count(*) AS error_count
    {_ERRORS} AND attempt IS NOT NULL GROUP BY 1, 2""",
)
