"""Headline figures, models, practices, days, users and tools, plain and filtered."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import ORACLES, TOKENS_SQL, register, report, sample_tables
from tallyline.operators.filters import EventFilters
from tallyline.plans import kpis, models, trends, users
from tallyline.plans.overview import overview_report

# Filters the filtered variants use; every one of them removes and keeps rows of the sample.
DATES = {"start_date": "2024-01-05", "end_date": "2024-01-20T12:00:00"}
DATES_SQL = "t.event_timestamp >= TIMESTAMP '2024-01-05' AND t.event_timestamp < TIMESTAMP '2024-01-20 12:00:00'"
PRACTICE_SQL = "coalesce(e.practice, t.resource_user_practice) = 'R1'"
BUILDING_SQL = "coalesce(e.practice, t.resource_user_practice) = 'BUILDING'"
JOINED = "t LEFT JOIN e ON t.user_email = e.email"
SESSION_SQL = (
    "EXISTS (SELECT 1 FROM t AS m WHERE m.session_id = t.session_id"
    " AND m.event_name = 'api_request' AND m.model = 'model-1')"
)

def shown(amount: str) -> str:
    """A double as results show it, 0 where there is none."""
    return f"round(round(coalesce({amount}, 0), 9), 6)"


# --- headline figures ---

report("total_users", lambda t, e: kpis.total_users(t), "SELECT count(DISTINCT user_email) AS total_users FROM t")
report("total_sessions", lambda t, e: kpis.total_sessions(t), "SELECT count(DISTINCT session_id) AS total_sessions FROM t")
report("total_events", lambda t, e: kpis.total_events(t), "SELECT count(*) AS total_events FROM t")
report(
    "total_token_usage",
    lambda t, e: kpis.total_token_usage(t),
    f"""SELECT CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
    CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
    CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS cache_creation_tokens,
    CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens,
    CAST(coalesce(sum({TOKENS_SQL}), 0) AS BIGINT) AS total_tokens
    FROM t WHERE event_name = 'api_request'""",
)
report(
    "total_cost",
    lambda t, e: kpis.total_cost(t),
    "SELECT round(round(coalesce(sum(cost_usd), 0), 9), 6) AS total_cost_usd FROM t WHERE event_name = 'api_request'",
)
report(
    "average_session_duration",
    lambda t, e: kpis.average_session_duration(t),
    """SELECT round(round(coalesce(avg(ms), 0), 9), 6) AS average_session_duration_ms FROM (
    SELECT date_diff('millisecond', min(event_timestamp), max(event_timestamp)) AS ms
    FROM t WHERE session_id IS NOT NULL GROUP BY session_id)""",
)
report(
    "success_rate",
    lambda t, e: kpis.success_rate(t),
    f"""SELECT tried AS tool_result_count, worked AS successful_tool_results,
    {shown("worked::DOUBLE / nullif(tried, 0)")} AS success_rate FROM results""",
    """results AS (
      SELECT count(*) AS tried, count(*) FILTER (WHERE success) AS worked FROM t WHERE event_name = 'tool_result')""",
)
report(
    "average_tokens_per_request",
    lambda t, e: kpis.average_tokens_per_request(t),
    f"""SELECT count(*) AS api_request_count, round(round(coalesce(avg({TOKENS_SQL}), 0), 9), 6) AS average_tokens_per_request
    FROM t WHERE event_name = 'api_request'""",
)


def _kpi_sql(where: str) -> tuple[str, str]:
    """Figures of sessions, then of all of them: each session is summed up before."""
    ctes = f"""f AS (SELECT t.* FROM {JOINED} WHERE {where}), requests AS (
      SELECT sum(cost_usd) AS cost, sum({TOKENS_SQL}) AS tokens FROM f WHERE event_name = 'api_request'
    ), spans AS (
      SELECT session_id, epoch_us(max(event_timestamp)) // 1000 - epoch_us(min(event_timestamp)) // 1000 AS ms
      FROM f GROUP BY session_id HAVING session_id IS NOT NULL
    ), people AS (SELECT user_email, count(*) AS n FROM f GROUP BY user_email)"""
    return (
        f"""SELECT (SELECT count(user_email) FROM people) AS total_users, (SELECT count(*) FROM spans) AS total_sessions,
        (SELECT CAST(coalesce(sum(n), 0) AS BIGINT) FROM people) AS total_events,
        {shown("cost")} AS total_cost_usd, CAST(coalesce(tokens, 0) AS BIGINT) AS total_tokens,
        (SELECT {shown("avg(ms)")} FROM spans) AS average_session_duration_ms
        FROM requests""",
        ctes,
    )


FILTER_CASES = {
    "": (EventFilters(), "TRUE"),
    "_by_dates": (EventFilters(**DATES), DATES_SQL),
    "_by_practice": (EventFilters(practice="R1"), PRACTICE_SQL),
    "_by_model": (EventFilters(model="model-1"), SESSION_SQL),
    "_by_all": (
        EventFilters(**DATES, practice="BUILDING", model="model-1"),
        f"{DATES_SQL} AND {BUILDING_SQL} AND {SESSION_SQL}",
    ),
}
DIRECT_CASES = {
    name: (filters, sql.replace(SESSION_SQL, "t.model = 'model-1'"))
    for name, (filters, sql) in FILTER_CASES.items()
}

for _case, (_filters, _where) in FILTER_CASES.items():
    report(
        f"kpi_summary{_case}",
        lambda t, e, f=_filters: kpis.kpi_summary(t, e, f),
        *_kpi_sql(_where),
    )

report(
    "filter_options",
    lambda t, e: kpis.filter_options(t, e).select(
        "min_date",
        "max_date",
        F.array_join("practices", "|").alias("practices"),
        F.array_join("models", "|").alias("models"),
    ),
    """SELECT first_day AS min_date, last_day AS max_date, nullif(practices, '') AS practices, nullif(models, '') AS models
    FROM span, of_practice, of_model""",
    """span AS (SELECT min(event_date) AS first_day, max(event_date) AS last_day FROM t
    ), of_practice AS (
      SELECT coalesce(string_agg(practice, '|' ORDER BY practice), '') AS practices
      FROM (SELECT DISTINCT practice FROM e WHERE email IN (SELECT user_email FROM t))
    ), of_model AS (
      SELECT coalesce(string_agg(model, '|' ORDER BY model), '') AS models FROM (SELECT DISTINCT model FROM t))""",
)

# --- by model and practice ---

for _case, (_filters, _where) in DIRECT_CASES.items():
    report(
        f"requests_per_model{_case}",
        lambda t, e, f=_filters: models.requests_per_model(t, e, f),
        f"""SELECT t.model AS model, count(*) AS request_count, round(round(coalesce(sum(t.cost_usd), 0), 9), 6) AS cost_usd,
        round(round(coalesce(avg(t.duration_ms), 0), 9), 6) AS average_duration_ms
        FROM {JOINED} WHERE t.event_name = 'api_request' AND {_where} AND t.model IS NOT NULL GROUP BY t.model""",
    )
    report(
        f"token_usage_per_model{_case}",
        lambda t, e, f=_filters: models.token_usage_per_model(t, e, f),
        f"""SELECT t.model AS model, CAST(coalesce(sum(input_tokens), 0) AS BIGINT) AS input_tokens,
        CAST(coalesce(sum(output_tokens), 0) AS BIGINT) AS output_tokens,
        CAST(coalesce(sum(cache_creation_tokens), 0) AS BIGINT) AS cache_creation_tokens,
        CAST(coalesce(sum(cache_read_tokens), 0) AS BIGINT) AS cache_read_tokens,
        CAST(coalesce(sum({TOKENS_SQL}), 0) AS BIGINT) AS total_tokens
        FROM {JOINED} WHERE t.event_name = 'api_request' AND {_where} AND t.model IS NOT NULL GROUP BY t.model""",
    )
    report(
        f"cost_per_practice{_case}",
        lambda t, e, f=_filters: models.cost_per_practice(t, e, f),
        f"""SELECT practice, CAST(sum(n) AS BIGINT) AS request_count, count(user_email) AS active_users,
        {shown("sum(cost)")} AS cost_usd, {shown("sum(cost) / nullif(count(user_email), 0)")} AS cost_per_active_user
        FROM users_of GROUP BY practice""",
        f"""users_of AS (
          SELECT ifnull(ifnull(e.practice, t.resource_user_practice), 'Unknown') AS practice, t.user_email,
                 count(*) AS n, sum(t.cost_usd) AS cost
          FROM {JOINED} WHERE {_where} AND t.event_name = 'api_request' GROUP BY ALL)""",
    )
    report(
        f"requests_per_day{_case}",
        lambda t, e, f=_filters: trends.requests_per_day(t, e, f),
        f"""SELECT t.event_date AS event_date, count(*) AS request_count
        FROM {JOINED} WHERE t.event_name = 'api_request' AND {_where} GROUP BY t.event_date""",
    )

report(
    "average_tokens_per_model_request",
    lambda t, e: models.average_tokens_per_model_request(t),
    f"""SELECT model, count(*) AS request_count, round(round(coalesce(avg({TOKENS_SQL}), 0), 9), 6) AS average_tokens_per_request
    FROM t WHERE event_name = 'api_request' AND model IS NOT NULL GROUP BY model""",
)

# --- by day ---

report(
    "daily_cost",
    lambda t, e: trends.daily_cost(t),
    "SELECT event_date, round(round(coalesce(sum(cost_usd), 0), 9), 6) AS cost_usd FROM t WHERE event_name = 'api_request' GROUP BY event_date",
)
report(
    "daily_active_users",
    lambda t, e: trends.daily_active_users(t),
    "SELECT event_date, count(DISTINCT user_email) AS active_users FROM t WHERE user_email IS NOT NULL GROUP BY event_date",
)
report(
    "daily_success_rate",
    lambda t, e: trends.daily_success_rate(t),
    f"""SELECT event_date, count(*) AS tool_result_count, {shown("avg(CAST(success IS TRUE AS INT))")} AS success_rate
    FROM t GROUP BY event_date, event_name HAVING event_name = 'tool_result'""",
)

# --- users and tools ---

def _activity_sql(where: str, wanted: str = "", tail: str = "") -> tuple[str, str]:
    """Figures of each user's sessions, then of the users, and their names last."""
    of_kind = ", ".join(
        f"count(*) FILTER (WHERE t.event_name = '{kind}') AS {name}"
        for kind, name in (("user_prompt", "prompts"), ("api_request", "requests"), ("tool_result", "results"))
    )
    ctes = f"""of_session AS (
      SELECT t.user_email, t.session_id, count(*) AS n, {of_kind},
             sum(t.cost_usd) FILTER (WHERE t.event_name = 'api_request') AS cost
      FROM {JOINED} WHERE {where} GROUP BY t.user_email, t.session_id
    ), of_user AS (
      SELECT user_email, sum(n) AS n, count(session_id) AS sessions, sum(prompts) AS prompts, sum(requests) AS requests,
             sum(results) AS results, sum(cost) AS cost FROM of_session GROUP BY user_email HAVING user_email IS NOT NULL
    )"""
    return (
        f"""SELECT user_email, full_name, practice, level, location, CAST(n AS BIGINT) AS event_count, sessions AS session_count,
        CAST(prompts AS BIGINT) AS prompt_count, CAST(requests AS BIGINT) AS api_request_count, {wanted} {shown("cost")} AS cost_usd
        FROM of_user LEFT JOIN e ON email = user_email ORDER BY n DESC, user_email {tail}""",
        ctes,
    )


for _case, (_filters, _where) in FILTER_CASES.items():
    report(
        f"top_active_users{_case}",
        lambda t, e, f=_filters: users.top_active_users(t, e, f),
        *_activity_sql(_where, tail="LIMIT 10"),
    )
    report(
        f"top_used_tools{_case}",
        lambda t, e, f=_filters: users.top_used_tools(t, e, f, limit=5),
        f"""SELECT tool_name, n AS tool_result_count, worked AS successful_tool_results,
        {shown("worked::DOUBLE / n")} AS success_rate, {shown("ms")} AS average_duration_ms
        FROM of_tool ORDER BY n DESC, tool_name LIMIT 5""",
        f"""of_tool AS (
          SELECT t.tool_name, count(*) AS n, count(*) FILTER (WHERE t.success) AS worked, avg(t.duration_ms) AS ms
          FROM {JOINED} WHERE {_where} AND t.event_name = 'tool_result' GROUP BY t.tool_name HAVING t.tool_name IS NOT NULL)""",
    )

report(
    "user_activity_summary",
    lambda t, e: users.user_activity_summary(t, e),
    *_activity_sql("TRUE", "CAST(results AS BIGINT) AS tool_result_count,"),
)


# --- the overview bundle, one row per figure ---

# What names a row of each part, its numbers, and its texts.
OVERVIEW = {
    "kpi_summary": ("'all'", ("total_users", "total_sessions", "total_events", "total_cost_usd", "total_tokens", "average_session_duration_ms"), ()),
    "requests_per_day": ("event_date", ("request_count",), ()),
    "token_usage_per_model": ("model", ("input_tokens", "output_tokens", "cache_creation_tokens", "cache_read_tokens", "total_tokens"), ()),
    "cost_per_practice": ("practice", ("request_count", "active_users", "cost_usd", "cost_per_active_user"), ()),
    "top_active_users": ("user_email", ("event_count", "session_count", "prompt_count", "api_request_count", "cost_usd"),
                         ("full_name", "practice", "level", "location")),
    "top_used_tools": ("tool_name", ("tool_result_count", "successful_tool_results", "success_rate", "average_duration_ms"), ()),
}


def _overview(t, e):
    """All six results of one overview, each column of each row as (part, label, figure, amount, told)."""
    parts = overview_report(t, e, FILTER_CASES["_by_all"][0], limit=5)
    out = None
    for part, (label, numbers, texts) in OVERVIEW.items():
        cells = [F.struct(F.lit(c).alias("figure"), F.col(c).cast("double").alias("amount"), F.lit(None).cast("string").alias("told")) for c in numbers]
        cells += [F.struct(F.lit(c).alias("figure"), F.lit(None).cast("double").alias("amount"), F.col(c).alias("told")) for c in texts]
        rows = parts[part].select(F.lit(part).alias("part"), F.expr(label).cast("string").alias("label"), F.inline(F.array(*cells)))
        out = rows if out is None else out.unionByName(rows)
    return out


def _overview_sql() -> str:
    selects = []
    for part, (label, numbers, texts) in OVERVIEW.items():
        of_part = ORACLES[f"{part}_by_all"].replace("LIMIT 10", "LIMIT 5")
        for c in (*numbers, *texts):
            amount, told = (f"CAST({c} AS DOUBLE)", "CAST(NULL AS STRING)") if c in numbers else ("CAST(NULL AS DOUBLE)", c)
            selects.append(
                f"SELECT '{part}' AS part, CAST({label} AS STRING) AS label, '{c}' AS figure, {amount} AS amount, {told} AS told FROM ({of_part})"
            )
    return " UNION ALL ".join(selects)


register("overview_report", lambda spark, folder: _overview(*sample_tables(spark, folder)), _overview_sql())

# --- each filter on its own, over the events themselves ---

for _name, _filters, _where, _by_session in [
    ("event_name", EventFilters(event_name="api_error"), "t.event_name = 'api_error'", False),
    ("dates", EventFilters(**DATES), DATES_SQL, False),
    ("practice", EventFilters(practice="BUILDING"), BUILDING_SQL, False),
    ("model", EventFilters(model="model-2"), "t.model = 'model-2'", False),
    ("model_session", EventFilters(model="model-1", **DATES), f"{SESSION_SQL} AND {DATES_SQL}", True),
    ("last_day", EventFilters().through("2024-01-10"), "t.event_timestamp < TIMESTAMP '2024-01-11'", False),
    ("level", EventFilters(level="L3"), "e.level = 'L3'", False),
    ("location", EventFilters(location="ASIA"), "e.location = 'ASIA'", False),
    ("user", EventFilters(user_email="user7@example.com"), "t.user_email = 'user7@example.com'", False),
    ("tool", EventFilters(tool_name="tool-3"), "t.tool_name = 'tool-3'", False),
    ("terminal", EventFilters(terminal_type="term-4"), "t.terminal_type = 'term-4'", False),
]:
    report(
        f"event_filters_{_name}",
        lambda t, e, f=_filters, s=_by_session: f.apply(t, e, by_session=s).select(
            "event_id", "event_name", "session_id"
        ),
        f"SELECT t.event_id, t.event_name, t.session_id FROM {JOINED} WHERE {_where}",
    )

# "Unknown" is a label of one report, not a practice, so filtering on it matches nothing.
report(
    "event_filters_unknown_practice",
    lambda t, e: EventFilters(practice="Unknown").apply(t, e).agg(F.count(F.lit(1)).alias("matching")),
    f"SELECT count(*) AS matching FROM {JOINED} WHERE coalesce(e.practice, t.resource_user_practice) = 'Unknown'",
)
