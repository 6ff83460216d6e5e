"""Adoption and engagement reports."""

from __future__ import annotations

from catalog.base import report
from tallyline.operators.filters import EventFilters
from tallyline.plans import adoption
from tallyline.plans.dimensions import value_counts

_JOINED = "t LEFT JOIN e ON t.user_email = e.email"

for _name, _period in {"daily": "day", "weekly": "week", "monthly": "month"}.items():
    report(
        f"{_name}_active_users" if _name != "daily" else "active_users_by_day",
        lambda t, e, period=_period: adoption.active_users(t, period),
        f"""SELECT CAST(date_trunc('{_period}', event_date) AS DATE) AS period_start,
        count(DISTINCT user_email) AS active_users FROM t GROUP BY 1""",
    )
report(
    "active_users_of_periods",
    lambda t, e: adoption.active_users_of_periods(t),
    " UNION ALL ".join(
        f"""SELECT '{p}' AS period, CAST(date_trunc('{p}', event_date) AS DATE) AS period_start,
        count(DISTINCT user_email) AS active_users FROM t GROUP BY ALL"""
        for p in adoption.PERIODS
    ),
)
report(
    "active_user_rate",
    adoption.active_user_rate,
    """SELECT coalesce(practice, '(all)') AS practice, count(*) FILTER (WHERE used) AS active_users,
    count(*) AS employee_count, round(round(count(*) FILTER (WHERE used) / count(*), 9), 6) AS active_user_rate
    FROM (SELECT practice, email IN (SELECT user_email FROM t) AS used FROM e)
    GROUP BY GROUPING SETS ((), (practice))""",
)


def _ratio(part: str, whole: str, name: str) -> str:
    return f"round(round(coalesce({part} / nullif({whole}, 0), 0), 9), 6) AS {name}"


_U, _S = "count(DISTINCT t.user_email)", "count(DISTINCT t.session_id)"
_P, _R, _T = [
    f"count(*) FILTER (WHERE t.event_name = '{n}')" for n in ("user_prompt", "api_request", "tool_result")
]
_RATIOS = ", ".join(
    [
        _ratio(_S, _U, "sessions_per_user"),
        _ratio(_P, _U, "prompts_per_user"),
        _ratio(_P, _S, "prompts_per_session"),
        _ratio(_R, _P, "requests_per_prompt"),
        _ratio(_T, _P, "tool_calls_per_prompt"),
        _ratio(_T, _S, "tool_calls_per_session"),
        _ratio("count(*)", _S, "events_per_session"),
        _ratio(_P, _T, "prompt_to_tool_ratio"),
        _ratio(_P, _R, "prompt_to_request_ratio"),
    ]
)
report("engagement_ratios", adoption.engagement_ratios, f"SELECT {_RATIOS} FROM t")
report(
    "engagement_ratios_filtered",
    lambda t, e: adoption.engagement_ratios(t, e, EventFilters(location="EUROPE", terminal_type="term-1")),
    f"SELECT {_RATIOS} FROM {_JOINED} WHERE e.location = 'EUROPE' AND t.terminal_type = 'term-1'",
)

_DEPTH = f"""{_U} AS active_users, {_S} AS session_count, count(*) AS event_count, {_P} AS prompt_count,
  {_R} AS request_count, {_T} AS tool_result_count"""
report(
    "adoption_by_terminal_type",
    lambda t, e: adoption.adoption_by(t, e, "terminal_type"),
    f"SELECT t.terminal_type AS terminal_type, {_DEPTH} FROM t GROUP BY 1",
)
for _dimension, _expression in {
    "practice": "coalesce(e.practice, t.resource_user_practice, 'Unknown')",
    "level": "coalesce(e.level, 'Unknown')",
    "location": "coalesce(e.location, 'Unknown')",
}.items():
    report(
        f"adoption_by_{_dimension}",
        lambda t, e, dimension=_dimension: adoption.adoption_by(t, e, dimension),
        f"""SELECT x.*, coalesce(staff, 0) AS employee_count,
        round(round(coalesce(event_count / nullif(staff, 0), 0), 9), 6) AS events_per_employee,
        round(round(coalesce(prompt_count / nullif(staff, 0), 0), 9), 6) AS prompts_per_employee
        FROM (SELECT {_expression} AS {_dimension}, {_DEPTH} FROM {_JOINED} GROUP BY 1) AS x
        LEFT JOIN (SELECT {_dimension} AS name, count(*) AS staff FROM e GROUP BY 1) ON {_dimension} = name""",
    )
for _column in ("model", "terminal_type", "tool_name"):
    report(
        f"adoption_of_{_column}_by_practice",
        lambda t, e, column=_column: adoption.adoption_matrix(t, e, column),
        f"""SELECT coalesce(e.practice, 'Unknown') AS practice, t.{_column} AS {_column}, {_U} AS active_users,
        count(*) AS event_count FROM {_JOINED} WHERE t.{_column} IS NOT NULL GROUP BY 1, 2""",
    )
report(
    "adoption_of_tool_name_by_level",
    lambda t, e: adoption.adoption_matrix(t, e, "tool_name", by="level"),
    f"""SELECT coalesce(e.level, 'Unknown') AS level, t.tool_name AS tool_name, {_U} AS active_users,
    count(*) AS event_count FROM {_JOINED} WHERE t.tool_name IS NOT NULL GROUP BY 1, 2""",
)
for _column in ("event_name", "terminal_type", "resource_user_practice"):
    report(
        f"value_counts_{_column}",
        lambda t, e, column=_column: value_counts(t, column),
        f"SELECT {_column}, count(*) AS event_count FROM t WHERE {_column} IS NOT NULL GROUP BY 1",
    )
report(
    "value_counts_tool_name",
    lambda t, e: value_counts(t, "tool_name", event_names=["tool_decision", "tool_result"]),
    """SELECT tool_name, count(*) AS event_count FROM t WHERE tool_name IS NOT NULL
    AND event_name IN ('tool_decision', 'tool_result') GROUP BY 1""",
)
