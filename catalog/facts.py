"""Fact tables, sessions, scorecards and drill-downs."""

from __future__ import annotations

from catalog.base import TABLES_SQL, TOKENS_SQL, register, report
from tallyline.plans import facts, scorecards, sessions
from tallyline.schemas import EVENT_SCHEMA
from tallyline.sources.sample import EXPRESSIONS, sample_events

_SHARED = "event_id, event_timestamp, event_date, user_email, session_id, organization_id, terminal_type"
_PERSON = "full_name, practice, level, location"
_COLUMNS = {
    "api_requests": ("api_request", "model, round(round(cost_usd, 9), 6) AS cost_usd, duration_ms, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens"),
    "api_errors": ("api_error", "model, status_code, error, attempt"),
    "user_prompts": ("user_prompt", "prompt_length, prompt_redacted"),
    "tool_decisions": ("tool_decision", "tool_name, decision, source"),
    "tool_results": ("tool_result", "tool_name, success, duration_ms, tool_result_size_bytes, decision_type, decision_source"),
}

# Columns of the sample's events; the others are NULL there.
_THERE = {*EXPRESSIONS, "event_timestamp", "event_date", "outer_timestamp_ms", "prompt_redacted"}
_EVENT = ", ".join(
    "round(round(cost_usd, 9), 6) AS cost_usd" if f.name == "cost_usd" else f.name if f.name in _THERE
    else "FALSE AS is_malformed" if f.name == "is_malformed" else f"NULL AS {f.name}"
    for f in EVENT_SCHEMA
)

for _name, (_event, _columns) in _COLUMNS.items():
    report(
        f"fact_{_name}",
        lambda t, e, name=_name: facts.fact(t, name),
        f"SELECT {_SHARED}, {_columns} FROM t WHERE event_name = '{_event}'",
    )
for _name in ("api_requests", "tool_results"):
    _event, _columns = _COLUMNS[_name]
    report(
        f"{_name}_enriched",
        lambda t, e, name=_name: facts.enriched(facts.fact(t, name), e),
        f"SELECT {_SHARED}, {_columns}, {_PERSON} FROM t LEFT JOIN e ON user_email = email WHERE event_name = '{_event}'",
    )
report(
    "events_enriched",
    lambda t, e: facts.enriched(t, e),
    f"SELECT {_EVENT}, {_PERSON} FROM t LEFT JOIN e ON user_email = email",
)

# The sample has one user per session; here sessions are days, so that many users share one.
_SESSION_SQL = """, ev AS (SELECT * EXCLUDE (session_id), {session} AS session_id FROM t),
pairs AS (SELECT session_id, user_email, organization_id, count(*) AS c FROM ev GROUP BY ALL),
per_user AS (SELECT session_id, user_email, sum(c) AS c, first(organization_id ORDER BY c DESC, organization_id) AS organization_id
  FROM pairs GROUP BY ALL),
main AS (SELECT session_id, first(user_email ORDER BY c DESC, user_email) AS user_email,
  first(organization_id ORDER BY c DESC, user_email) AS organization_id FROM per_user GROUP BY session_id)
SELECT s.session_id, user_email, organization_id, session_start, session_end, duration_ms, event_count, prompt_count,
  api_request_count, tool_result_count, api_error_count, total_cost_usd
FROM (SELECT session_id, min(event_timestamp) AS session_start, max(event_timestamp) AS session_end,
  date_diff('millisecond', min(event_timestamp), max(event_timestamp)) AS duration_ms, count(*) AS event_count,
  count(*) FILTER (WHERE event_name = 'user_prompt') AS prompt_count,
  count(*) FILTER (WHERE event_name = 'api_request') AS api_request_count,
  count(*) FILTER (WHERE event_name = 'tool_result') AS tool_result_count,
  count(*) FILTER (WHERE event_name = 'api_error') AS api_error_count,
  round(round(coalesce(sum(cost_usd) FILTER (WHERE event_name = 'api_request'), 0), 9), 6) AS total_cost_usd
  FROM ev {where} GROUP BY session_id) AS s JOIN main USING (session_id)"""


def _day_sessions(spark, folder):
    import pyspark.sql.functions as F

    return sessions.sessions(
        sample_events(spark, folder).withColumn("session_id", F.col("event_date").cast("string"))
    )


register(
    "sessions",
    lambda spark, folder: sessions.sessions(sample_events(spark, folder)),
    TABLES_SQL + _SESSION_SQL.format(session="session_id", where=""),
)
register(
    "sessions_shared",
    _day_sessions,
    TABLES_SQL + _SESSION_SQL.format(session="CAST(event_date AS STRING)", where=""),
)
register(
    "user_sessions",
    lambda spark, folder: sessions.user_sessions(sample_events(spark, folder), "user5@example.com"),
    TABLES_SQL
    + _SESSION_SQL.format(session="session_id", where="WHERE user_email = 'user5@example.com'"),
)
report(
    "session_timeline",
    lambda t, e: sessions.session_timeline(t, "1-2024-01-04"),
    """SELECT event_timestamp, event_id, event_name, user_email, model, tool_name, success, status_code, duration_ms,
    round(round(cost_usd, 9), 6) AS cost_usd FROM t WHERE session_id = '1-2024-01-04'""",
)
for _entity in ("user_email", "session_id", "event_id"):
    report(
        f"high_cost_by_{_entity}",
        lambda t, e, entity=_entity: sessions.high_cost(t, entity, 20),
        f"""SELECT {_entity}, round(round(c, 9), 6) AS cost_usd, request_count FROM (
        SELECT {_entity}, coalesce(sum(cost_usd), 0) AS c, count(*) AS request_count
        FROM t WHERE event_name = 'api_request' GROUP BY {_entity} ORDER BY c DESC, {_entity} LIMIT 20)""",
    )

_FIGURES = f"""count(*) AS event_count,
  count(*) FILTER (WHERE event_name = 'user_prompt') AS prompt_count,
  count(*) FILTER (WHERE event_name = 'api_request') AS request_count,
  count(*) FILTER (WHERE event_name = 'api_error') AS error_count,
  round(round(coalesce(count(*) FILTER (WHERE event_name = 'api_error')
    / nullif(count(*) FILTER (WHERE event_name IN ('api_error', 'api_request')), 0), 0), 9), 6) AS api_error_rate,
  count(*) FILTER (WHERE event_name = 'tool_result') AS tool_result_count,
  round(round(coalesce(count(*) FILTER (WHERE event_name = 'tool_result' AND success)
    / nullif(count(*) FILTER (WHERE event_name = 'tool_result'), 0), 0), 9), 6) AS success_rate,
  round(round(coalesce(sum(cost_usd) FILTER (WHERE event_name = 'api_request'), 0), 9), 6) AS cost_usd,
  CAST(coalesce(sum({TOKENS_SQL}) FILTER (WHERE event_name = 'api_request'), 0) AS BIGINT) AS total_tokens,
  round(round(coalesce(avg(duration_ms) FILTER (WHERE event_name = 'api_request'), 0), 9), 6) AS average_duration_ms"""
_REACH = "count(DISTINCT user_email) AS active_users, count(DISTINCT session_id) AS session_count"

report(
    "daily_kpis",
    scorecards.daily_kpis,
    f"SELECT event_date, {_REACH}, {_FIGURES} FROM t GROUP BY event_date",
)
report(
    "model_kpis",
    scorecards.model_kpis,
    f"SELECT model, {_REACH}, {_FIGURES} FROM t WHERE model IS NOT NULL GROUP BY model",
)
report(
    "user_kpis",
    scorecards.user_kpis,
    f"SELECT user_email, count(DISTINCT session_id) AS session_count, {_FIGURES} FROM t GROUP BY user_email",
)
report(
    "practice_kpis",
    scorecards.practice_kpis,
    f"""SELECT p.*, coalesce(staff, 0) AS employee_count,
    round(round(coalesce(cost_usd / nullif(staff, 0), 0), 9), 6) AS cost_per_employee
    FROM (SELECT coalesce(e.practice, resource_user_practice, 'Unknown') AS practice, {_REACH}, {_FIGURES}
          FROM t LEFT JOIN e ON user_email = email GROUP BY 1) AS p
    LEFT JOIN (SELECT practice AS name, count(*) AS staff FROM e GROUP BY practice) ON p.practice = name""",
)
