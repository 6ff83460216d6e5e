"""Tool reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import report
from tallyline.plans import tools

_RESULTS = "FROM t WHERE event_name = 'tool_result' AND tool_name IS NOT NULL"
report(
    "tool_reliability",
    lambda t, e: tools.tool_reliability(t),
    f"""SELECT tool_name, count(*) AS tool_result_count, round(round(count(*) FILTER (WHERE success) / count(*), 9), 6) AS success_rate,
    round(round(1 - count(*) FILTER (WHERE success) / count(*), 9), 6) AS failure_rate,
    round(round(avg(duration_ms), 9), 6) AS average_duration_ms, round(round(quantile_cont(duration_ms, 0.5), 9), 6) AS median_duration_ms
    {_RESULTS} GROUP BY tool_name""",
)
report(
    "tool_result_sizes",
    lambda t, e: tools.tool_result_sizes(t),
    f"""SELECT tool_name, count(*) AS sized_results, min(tool_result_size_bytes) AS smallest, max(tool_result_size_bytes) AS largest,
    round(round(avg(tool_result_size_bytes), 9), 6) AS average, round(round(quantile_cont(tool_result_size_bytes, 0.5), 9), 6) AS median,
    round(round(quantile_cont(tool_result_size_bytes, 0.9), 9), 6) AS p90, round(round(quantile_cont(tool_result_size_bytes, 0.99), 9), 6) AS p99
    {_RESULTS} AND tool_result_size_bytes IS NOT NULL GROUP BY tool_name""",
)
report(
    "tool_decision_mix",
    lambda t, e: tools.tool_decision_mix(t),
    """SELECT source, decision, count(*) AS decision_count,
    round(round(count(*) / sum(count(*)) OVER (PARTITION BY source), 9), 6) AS share
    FROM t WHERE event_name = 'tool_decision' GROUP BY source, decision""",
)


def _chain_sql(length: int, session: str) -> str:
    steps = " || ' > ' || ".join(["tool_name", *[f"lead(tool_name, {i}) OVER w" for i in range(1, length)]])
    return f"""SELECT chain, count(*) AS occurrences FROM (
    SELECT {steps} AS chain FROM (SELECT * EXCLUDE (session_id), {session} AS session_id FROM t)
    WHERE event_name = 'tool_result' AND tool_name IS NOT NULL
    WINDOW w AS (PARTITION BY session_id ORDER BY event_timestamp, event_id)) WHERE chain IS NOT NULL GROUP BY chain"""


report("tool_chains", lambda t, e: tools.tool_chains(t), _chain_sql(2, "session_id"))
report("tool_chains_of_three", lambda t, e: tools.tool_chains(t, 3), _chain_sql(3, "session_id"))
# A third of all users in one session that lasts for weeks.
report(
    "tool_chains_hot_session",
    lambda t, e: tools.tool_chains(
        t.withColumn(
            "session_id",
            F.when(F.col("user_id").cast("int") % 3 == 0, F.lit("hot")).otherwise(F.col("session_id")),
        ),
        3,
    ),
    _chain_sql(3, "CASE WHEN uid % 3 = 0 THEN 'hot' ELSE session_id END"),
)
# A third of all users in one session, and all of that in one hour.
report(
    "tool_chains_hot_hour",
    lambda t, e: tools.tool_chains(
        t.withColumn("session_id", F.when(F.col("user_id").cast("int") % 3 == 0, F.lit("hot")).otherwise(F.col("session_id"))).withColumn(
            "event_timestamp",
            F.when(F.col("session_id") == "hot", F.expr("timestamp_micros(1704067200000000 + (unix_micros(event_timestamp) - 1704067200000000) div 1000)"))
            .otherwise(F.col("event_timestamp")),
        ),
        2,
    ),
    _chain_sql(2, "CASE WHEN uid % 3 = 0 THEN 'hot' ELSE session_id END").replace(
        "ORDER BY event_timestamp",
        "ORDER BY CASE WHEN uid % 3 = 0 THEN (epoch_us(event_timestamp) - 1704067200000000) // 1000 ELSE epoch_us(event_timestamp) END",
    ),
)
