"""Data quality reports and incremental loading."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import register, report
from catalog.ingestion import EVENT_TEXT_SQL, LOADED_COLUMNS, RAW_SQL, SOURCE_SQL, _stored_rejects, clean_sql, flat, raw
from tallyline.operators import flatten
from tallyline.operators.storage import load_table
from tallyline.plans import quality
from tallyline.schemas import TELEMETRY_EVENTS
from tallyline.session import shared_folder
from tallyline.sources.sample import sample_employees, sample_lines
from tallyline.streaming.incremental import incremental_load

register(
    "raw_log_batches",
    lambda spark, folder: quality.raw_log_batches(raw(spark, folder)),
    RAW_SQL
    + """SELECT sha256('sample:' || (l.line + 1)) AS batch_id, 'sample' AS source_file, l.line + 1 AS line_number,
    CASE WHEN ok THEN 'DATA_MESSAGE' END AS message_type, CASE WHEN ok THEN 'owner-1' END AS owner,
    CASE WHEN ok THEN '/telemetry' END AS log_group, CASE WHEN ok THEN 'main' END AS log_stream,
    CASE WHEN ok THEN '["all"]' END AS subscription_filters, value AS raw_json,
    CASE WHEN ok THEN 2024 END AS year, CASE WHEN ok THEN 1 END AS month, CASE WHEN ok THEN 2 END AS day,
    CASE WHEN l.rule = 9 THEN 0 WHEN ok AND l.rule <> 6 THEN c END AS event_count
    FROM lines l JOIN (SELECT line, CAST(count(*) AS INT) AS c, any_value(rule) NOT IN (3, 12, 15, 18) AS ok FROM s GROUP BY line) b
    ON l.line = b.line""",
)
_REASONS_SQL = f"""CASE spot WHEN 7 THEN '{flatten.ITEM_NOT_OBJECT}' WHEN 17 THEN '{flatten.MESSAGE_NOT_TEXT}'
  WHEN 27 THEN '{flatten.MESSAGE_UNREADABLE}' WHEN 37 THEN '{flatten.MESSAGE_NOT_OBJECT}'
  WHEN 47 THEN 'Missing required values: event_timestamp, event_name, user_email, session_id'
  WHEN 11 THEN 'Missing required values: event_name' WHEN 21 THEN 'Missing required values: event_id'
  WHEN 31 THEN 'Unusable event_timestamp: junk' WHEN 41 THEN 'Unusable event_timestamp: 10:00' END"""
#: The text of a line that parses, but has no list of events: its keys in order.
_NO_LIST = """{"day":2,"logEvents":"none","logGroup":"/telemetry","logStream":"main","messageType":"DATA_MESSAGE","month":1,"owner":"owner-1","subscriptionFilters":["all"],"year":"2024"}"""


def _rejects_sql(place: str, line_place: str) -> str:
    return (
        RAW_SQL
        + f"""SELECT {place} idx AS event_index, CASE WHEN spot NOT IN (7, 21) THEN event_id END AS event_id,
    {EVENT_TEXT_SQL} AS raw_text, reason AS message,
    CASE WHEN spot = 7 THEN 'event_item' WHEN spot IN (17, 27, 37) THEN 'event_message'
      WHEN spot IN (11, 21, 47) THEN 'missing_required' ELSE 'type_conversion' END AS category
    FROM (SELECT *, {_REASONS_SQL} AS reason FROM r WHERE rule NOT IN (3, 6, 9, 12, 15, 18)) WHERE reason IS NOT NULL
    UNION ALL SELECT {line_place} NULL, NULL, CASE WHEN lines.rule = 6 THEN '{_NO_LIST}' ELSE value END, line_error,
    CASE WHEN line_error = '{flatten.NO_EVENT_LIST}' THEN 'log_events' ELSE 'top_level_json' END FROM bad JOIN lines USING (line)"""
    )


register(
    "reject_rows",
    lambda spark, folder: quality.reject_rows(flat(spark, folder)),
    _rejects_sql("'sample' AS source_file, line + 1 AS line_number,", "'sample', line + 1,"),
)
register("stored_rejects", _stored_rejects, _rejects_sql("", ""))
register(
    "data_quality",
    lambda spark, folder: quality.data_quality(flat(spark, folder), sample_employees(spark, folder)),
    SOURCE_SQL
    + """SELECT 'rows' AS issue, 'info' AS severity, (SELECT count(*) FROM good) + (SELECT count(*) FROM bad) AS found
    UNION ALL SELECT 'malformed_line', 'reject', count(*) FROM bad
    UNION ALL SELECT 'malformed_event', 'reject', count(*) FROM good WHERE spot IN (7, 17, 27, 37)
    UNION ALL SELECT 'missing_event_id', 'reject', count(*) FROM good WHERE spot = 21
    UNION ALL SELECT 'missing_event_timestamp', 'reject', count(*) FROM good WHERE spot = 47
    UNION ALL SELECT 'missing_event_name', 'reject', count(*) FROM good WHERE spot IN (11, 47)
    UNION ALL SELECT 'unusable_event_timestamp', 'reject', count(*) FROM good WHERE spot IN (31, 41)
    UNION ALL SELECT 'missing_user_email', 'fatal', 0 UNION ALL SELECT 'missing_session_id', 'fatal', 0
    UNION ALL SELECT 'duplicate_event_id', 'fatal', 0 UNION ALL SELECT 'unknown_event_name', 'warning', 0
    UNION ALL SELECT 'missing_employee', 'warning', count(*) FROM u LEFT JOIN e ON user_email = email WHERE spot <> 47 AND email IS NULL
    UNION ALL SELECT 'missing_cost', 'warning', count(*) FROM u WHERE spot NOT IN (47, 11) AND event_name = 'api_request' AND cost_usd IS NULL
    UNION ALL SELECT 'missing_success', 'warning', count(*) FROM u WHERE spot NOT IN (47, 11) AND event_name = 'tool_result' AND success IS NULL
    UNION ALL SELECT 'unusable_value', 'warning', count(*) FROM u WHERE spot <> 47 AND (
      (n % 9 IN (4, 5) AND coalesce(prompt_length, duration_ms, input_tokens) IS NOT NULL) OR (n % 7 IN (3, 4) AND success IS NOT NULL))""",
)
register(
    "conversion_failures",
    lambda spark, folder: quality.conversion_failures(flat(spark, folder)),
    SOURCE_SQL
    + " UNION ALL ".join(
        f"SELECT '{c}' AS field, "
        + {
            "success": "count(success) FILTER (WHERE n % 7 IN (3, 4) AND spot <> 47)",
            **dict.fromkeys(
                ("prompt_length", "duration_ms", "input_tokens"), f"count({c}) FILTER (WHERE n % 9 IN (4, 5) AND spot <> 47)"
            ),
        }.get(c, "count(*) FILTER (WHERE FALSE)")
        + " AS unusable FROM u"
        for c in quality.CONVERTED
    ),
)
report(
    "join_coverage",
    quality.join_coverage,
    """SELECT count(*) AS event_count, count(email) AS matched_events, count(DISTINCT user_email) AS user_count,
    count(DISTINCT email) AS matched_users, round(round(count(email) / count(*), 9), 6) AS event_coverage,
    round(round(count(DISTINCT email) / count(DISTINCT user_email), 9), 6) AS user_coverage
    FROM t LEFT JOIN e ON user_email = email""",
)
report(
    "unmatched_users",
    quality.unmatched_users,
    "SELECT user_email, count(*) AS event_count FROM t WHERE user_email NOT IN (SELECT email FROM e) GROUP BY user_email",
)
report(
    "idle_employees",
    quality.idle_employees,
    "SELECT * FROM e WHERE email NOT IN (SELECT user_email FROM t)",
)
report(
    "duplicate_events",
    lambda t, e: quality.duplicate_events(
        t.withColumn("line_number", F.col("event_id").cast("int")).withColumn(
            "event_id", F.concat(F.col("event_name"), F.lit("-"), F.col("line_number") % 1000)
        )
    ).select("event_id", "copies", "line_number"),
    """SELECT event_name || '-' || (n % 1000) AS event_id, count(*) AS copies, CAST(min(n) AS INT) AS line_number
    FROM t GROUP BY 1 HAVING count(*) > 1""",
)
report(
    "timestamp_skew",
    lambda t, e: quality.timestamp_skew(t),
    """SELECT event_name, count(*) AS compared, min(d) AS smallest_ms, max(d) AS largest_ms, round(round(avg(d), 9), 6) AS average_ms,
    count(*) FILTER (WHERE abs(d) > 1000) AS over_a_second
    FROM (SELECT event_name, outer_timestamp_ms - epoch_us(event_timestamp) // 1000 AS d FROM t) GROUP BY event_name""",
)
report(
    "missing_by_event",
    lambda t, e: quality.missing_by_event(t),
    " UNION ALL ".join(
        f"""SELECT '{name}' AS event_name, '{field}' AS field, count(*) AS event_count,
        count(*) FILTER (WHERE {field} IS NULL) AS missing, round(round(count(*) FILTER (WHERE {field} IS NULL) / count(*), 9), 6) AS missing_rate
        FROM t WHERE event_name = '{name}' HAVING count(*) > 0"""
        for name, fields in quality.EXPECTED.items()
        for field in fields
    ),
)
report(
    "unknown_events",
    lambda t, e: quality.unknown_events(
        t.withColumn("event_name", F.when(F.col("model") == "model-2", F.lit("new_kind")).otherwise(F.col("event_name")))
    ),
    "SELECT 'new_kind' AS event_name, count(*) AS event_count FROM t WHERE model = 'model-2'",
)


def _in_two_steps(spark: SparkSession, folder: str) -> tuple[str, str]:
    """Load even lines, then all lines again as further files: each event is stored once."""
    lines, root = (shared_folder(spark, n) for n in ("incoming", "tables"))
    source = sample_lines(spark, folder)
    source.filter("line_id % 2 = 0").select("value").write.text(lines)
    incremental_load(spark, lines, root)
    source.select("value").write.mode("append").text(lines)
    incremental_load(spark, lines, root)
    return root, lines


def _incremental(spark: SparkSession, folder: str) -> DataFrame:
    root, _ = _in_two_steps(spark, folder)
    return load_table(spark, root, TELEMETRY_EVENTS).select(*LOADED_COLUMNS)


register(
    "incremental_load",
    _incremental,
    clean_sql(LOADED_COLUMNS),
)
