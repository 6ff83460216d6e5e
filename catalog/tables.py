"""Stored tables: scans, saving, constraints and validation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.base import TABLES_SQL, register, report
from tallyline.operators import storage, validation
from tallyline.schemas import EMPLOYEES, EVENT_SCHEMA, KEY, NOT_NULL, SCHEMA, TELEMETRY_EVENTS
from tallyline.session import shared_folder
from tallyline.sources import tables
from tallyline.sources.sample import EXPRESSIONS, sample_employees, sample_events, table

_SHOWN = ["event_id", "event_timestamp", "event_name", "user_email", "cost_usd", "success"]
_SHOWN_SQL = "event_id, event_timestamp, event_name, user_email, round(round(cost_usd, 9), 6) AS cost_usd, success"
_PERSON = ["full_name", "practice", "level", "location"]

# --- scans ---

report(
    "scan_employees",
    lambda t, e: tables.scan_employees(e, practice="BUILDING", location="ASIA"),
    "SELECT * FROM e WHERE practice = 'BUILDING' AND location = 'ASIA'",
)
report(
    "scan_events",
    lambda t, e: tables.scan_events(
        t, event_name="api_request", start_date="2024-01-05", end_date="2024-01-25"
    ).select(*_SHOWN),
    f"""SELECT {_SHOWN_SQL} FROM t WHERE event_name = 'api_request'
    AND event_timestamp >= TIMESTAMP '2024-01-05' AND event_timestamp < TIMESTAMP '2024-01-25'""",
)
report(
    "scan_events_first",
    lambda t, e: tables.scan_events(t, user_email="user3@example.com", limit=25).select(*_SHOWN),
    f"SELECT {_SHOWN_SQL} FROM t WHERE user_email = 'user3@example.com' ORDER BY event_timestamp, event_id LIMIT 25",
)
report(
    "scan_events_enriched",
    lambda t, e: tables.scan_events_enriched(t, e, event_name="tool_result").select(*_SHOWN, *_PERSON),
    f"""SELECT {_SHOWN_SQL}, full_name, practice, level, location FROM t LEFT JOIN e ON user_email = email
    WHERE event_name = 'tool_result'""",
)
report(
    "scan_events_enriched_by_practice",
    lambda t, e: tables.scan_events_enriched(
        t, e, practice="MACHINERY", start_date="2024-01-03", limit=200
    ).select(*_SHOWN, *_PERSON),
    f"""SELECT {_SHOWN_SQL}, full_name, practice, level, location FROM t LEFT JOIN e ON user_email = email
    WHERE practice = 'MACHINERY' AND event_timestamp >= TIMESTAMP '2024-01-03'
    ORDER BY event_timestamp, event_id LIMIT 200""",
)


def _row_counts(events: DataFrame, employees: DataFrame) -> DataFrame:
    known = {EMPLOYEES: employees, TELEMETRY_EVENTS: events}
    counts = [tables.count_rows(known, name).withColumn("table_name", F.lit(name)) for name in known]
    return counts[0].unionByName(counts[1])


report(
    "count_rows",
    _row_counts,
    """SELECT 'employees' AS table_name, (SELECT count(*) FROM e) AS row_count
    UNION ALL SELECT 'telemetry_events', (SELECT count(*) FROM t)""",
)

# --- shaping ---


def _aligned(spark: SparkSession, folder: str) -> DataFrame:
    """Order lines as events with few, loosely typed columns; the rest is filled in."""
    loose = table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber").alias("event_id"),
        F.col("l_shipdate").cast("string").alias("event_timestamp"),
        (F.col("l_quantity") + 0.5).alias("duration_ms"),
        F.col("l_extendedprice").cast("string").alias("cost_usd"),
        F.struct("l_orderkey", "l_linenumber").alias("attributes_json"),
        F.lit("not stored").alias("other"),
    )
    return storage.align_to_schema(loose, EVENT_SCHEMA).select(
        "event_id", "event_timestamp", "duration_ms", "cost_usd", "attributes_json", "model", "year"
    )


_ALIGNED_SQL = """SELECT l_orderkey || '-' || l_linenumber AS event_id, CAST(l_shipdate AS TIMESTAMP) AS event_timestamp,
    CAST(l_quantity + 0.5 AS BIGINT) AS duration_ms, round(round(l_extendedprice, 9), 6) AS cost_usd,
    '{"l_orderkey":' || l_orderkey || ',"l_linenumber":' || l_linenumber || '}' AS attributes_json,
    CAST(NULL AS STRING) AS model, CAST(NULL AS INTEGER) AS year FROM lineitem"""
register("align_to_schema", _aligned, _ALIGNED_SQL)


def _serialized(spark: SparkSession, folder: str) -> DataFrame:
    frame = table(spark, folder, "events").select(
        "event_id",
        F.struct("event_type", "user_id").alias("attributes_json"),
        F.when(F.col("user_id") % 2 == 0, F.array("event_type", F.lit("x"))).alias("resource_json"),
        F.col("props").alias("raw_message_json"),
    )
    names = ["attributes_json", "resource_json", "raw_message_json"]
    return frame.select(
        "event_id",
        *[storage.serialize_json(F.col(n), frame.schema[n].dataType).alias(n) for n in names],
    )


register(
    "serialize_json",
    _serialized,
    """SELECT event_id, '{"event_type":"' || event_type || '","user_id":' || user_id || '}' AS attributes_json,
    CASE WHEN user_id % 2 = 0 THEN '["' || event_type || '","x"]' END AS resource_json, props AS raw_message_json FROM events""",
)

# --- saving ---


def _stored_employees(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "tables")
    storage.save_employees(sample_employees(spark, folder), root)
    return storage.load_table(spark, root, EMPLOYEES)


def _stored_events(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "tables")
    storage.save_events(sample_events(spark, folder), root)
    return storage.load_table(spark, root, TELEMETRY_EVENTS).select(*_SHOWN, "event_date", "input_tokens")


register("save_employees", _stored_employees, TABLES_SQL + "SELECT * FROM e")
register("save_events", _stored_events, TABLES_SQL + f"SELECT {_SHOWN_SQL}, event_date, input_tokens FROM t")


def _replaced(spark: SparkSession, folder: str) -> DataFrame:
    """Load errors, replace them by requests, ignore an empty replacement, append prompts."""
    root = shared_folder(spark, "tables")
    events = sample_events(spark, folder)
    saved = []
    for name, replace in [("api_error", True), ("api_request", True), ("none", True), ("user_prompt", False)]:
        part = events.filter(F.col("event_name") == name)
        saved.append((name, storage.save_events(part, root, replace=replace)))
    written = spark.createDataFrame(saved, "step string, written bigint")
    stored = storage.load_table(spark, root, TELEMETRY_EVENTS).groupBy("event_name").agg(
        F.count(F.lit(1)).alias("stored")
    )
    return written.join(stored, written.step == stored.event_name, "left").select("step", "written", "stored")


register(
    "replace_or_append",
    _replaced,
    TABLES_SQL
    + """SELECT step, (SELECT count(*) FROM t WHERE event_name = step) AS written,
    CASE WHEN step IN ('api_request', 'user_prompt') THEN (SELECT count(*) FROM t WHERE event_name = step) END AS stored
    FROM (VALUES ('api_error'), ('api_request'), ('none'), ('user_prompt')) AS steps(step)""",
)


def _repeated(spark: SparkSession, folder: str) -> str:
    """Every event twice and a third of all rows under one id: the first of each id is kept."""
    root = shared_folder(spark, "tables")
    events = sample_events(spark, folder)
    n = F.col("event_id").cast("int")
    copies = events.withColumn("copy", F.explode(F.array(F.lit(0), F.lit(1))))
    placed = copies.select(
        *[c for c in events.columns if c not in ("event_id", "source_file", "line_number", "event_index")],
        F.when(n % 3 == 0, F.lit("hot")).otherwise(F.col("event_id")).alias("event_id"),
        F.lit("a").alias("source_file"),
        (F.col("copy") * 1_000_000_000 + n).alias("line_number"),
        F.lit(0).alias("event_index"),
    )
    storage.save_events(placed, root, on_duplicate="first")
    return root


register(
    "recorded_repeats",
    lambda spark, folder: storage.recorded_repeats(spark, _repeated(spark, folder)),
    TABLES_SQL
    + """, c AS (
      SELECT CASE WHEN n % 3 = 0 THEN 'hot' ELSE event_id END AS event_id, CAST(copy * 1000000000 + n AS INT) AS line_number
      FROM t, (VALUES (0), (1)) AS copies(copy)
    ) SELECT event_id, 'a' AS source_file, line_number, 0 AS event_index, CAST(1 AS BIGINT) AS left_out
    FROM (SELECT *, row_number() OVER (PARTITION BY event_id ORDER BY line_number) AS k FROM c) WHERE k > 1""",
)
register(
    "save_events_first_of_duplicates",
    lambda spark, folder: storage.load_table(spark, _repeated(spark, folder), TELEMETRY_EVENTS).select(
        "event_id", "line_number", "event_name"
    ),
    TABLES_SQL
    + """SELECT CASE WHEN n % 3 = 0 THEN 'hot' ELSE event_id END AS event_id, CAST(n AS INT) AS line_number, event_name
    FROM t WHERE n % 3 <> 0 OR n = (SELECT min(n) FROM t WHERE n % 3 = 0)""",
)

# --- constraints and validation ---

register(
    "enforce_primary_key",
    lambda spark, folder: storage.duplicate_keys(table(spark, folder, "lineitem"), "l_orderkey"),
    "SELECT l_orderkey, count(*) AS copies FROM lineitem GROUP BY l_orderkey HAVING count(*) > 1",
)


def _refused(spark: SparkSession, folder: str) -> DataFrame:
    """A load with one id twice is refused as a whole; the table stays as it was."""
    root = shared_folder(spark, "tables")
    events = sample_events(spark, folder)
    storage.save_events(events.filter("event_name = 'user_prompt'"), root)
    doubled = events.withColumn("event_id", F.when(F.col("event_name") == "api_error", F.lit("one")).otherwise(F.col("event_id")))
    try:
        storage.save_events(doubled, root)
        refused = False
    except storage.ConstraintError as error:
        refused = "'one'" in str(error)
    stored = storage.load_table(spark, root, TELEMETRY_EVENTS)
    return stored.groupBy("event_name").agg(F.count(F.lit(1)).alias("stored")).withColumn("refused", F.lit(refused))


register(
    "enforce_primary_key_on_save",
    _refused,
    TABLES_SQL
    + """SELECT event_name, count(*) AS stored, (SELECT count(*) > 1 FROM t WHERE event_name = 'api_error') AS refused
    FROM t WHERE event_name = 'user_prompt' GROUP BY event_name""",
)


def outcome(name: str, act: Callable[[SparkSession, str], None], sql: str) -> None:
    """A query whose result is the message of the check it runs over the whole tables."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        try:
            act(spark, folder)
            message = "passed"
        except ValueError as error:
            message = str(error)
        return spark.createDataFrame([(message,)], "outcome string")

    register(name, run, sql)


_GAPS_SQL = """'user_email=' || (SELECT count(*) FROM t WHERE n % 4 = 1)
    || ', session_id=' || (SELECT count(*) FROM t WHERE n % 10 = 2)"""
outcome(
    "enforce_not_null",
    lambda spark, folder: storage.save_events(_with_gaps(sample_events(spark, folder)), shared_folder(spark, "tables")),
    TABLES_SQL + f"SELECT 'telemetry_events has NULL in NOT NULL columns: ' || {_GAPS_SQL} AS outcome",
)


def _limited(spark: SparkSession, folder: str) -> DataFrame:
    """What a scan gives for several limits; those that are no numbers of rows are refused."""
    events, found = sample_events(spark, folder), None
    for limit in (0, -1, 7, None):
        try:
            scanned = tables.scan_events(events, event_name="api_error", limit=limit)
            rows, refused = scanned.agg(F.count(F.lit(1)).alias("row_count")), False
        except ValueError:
            rows, refused = events.where("false").agg(F.count(F.lit(1)).alias("row_count")), True
        told = rows.select(F.lit(str(limit)).alias("asked"), F.lit(refused).alias("refused"), "row_count")
        found = told if found is None else found.unionByName(told)
    return found


register(
    "validate_limit",
    _limited,
    TABLES_SQL
    + """, x AS (SELECT count(*) AS n FROM t WHERE event_name = 'api_error')
    SELECT '0' AS asked, TRUE AS refused, 0 AS row_count UNION ALL SELECT '-1', TRUE, 0
    UNION ALL SELECT '7', FALSE, least(n, 7) FROM x UNION ALL SELECT 'None', FALSE, n FROM x""",
)


def _defined(spark: SparkSession, folder: str) -> DataFrame:
    """The stored tables as they are defined, next to what a load of them holds."""
    root, found = shared_folder(spark, "tables"), None
    storage.save_employees(sample_employees(spark, folder), root)
    storage.save_events(sample_events(spark, folder), root)
    for name, schema in SCHEMA.items():
        stored = storage.load_table(spark, root, name)
        columns = [
            F.struct(
                F.lit(name).alias("table_name"), F.lit(at).cast("int").alias("position"), F.lit(f.name).alias("column_name"),
                F.lit(stored.schema[f.name].dataType.simpleString()).alias("kind"), F.lit(f.name in NOT_NULL[name]).alias("needed"),
                F.lit(KEY[name] == f.name).alias("is_key"), F.col(f"n{at}").alias("filled"),
            )
            for at, f in enumerate(schema)
        ]
        counted = stored.agg(*[F.count(f.name).alias(f"n{at}") for at, f in enumerate(schema)])
        rows = counted.select(F.inline(F.array(*columns)))
        found = rows if found is None else found.unionByName(rows)
    return found


# The stored tables' columns and types, as SQL would create them.
_TABLES = {
    "employees": ("e", "email string, full_name string, practice string, level string, location string"),
    "telemetry_events": ("t", """event_id string, source_file string, line_number int, event_index int, message_type string,
      owner string, log_group string, log_stream string, subscription_filters string, year int, month int, day int,
      outer_timestamp_ms bigint, raw_message string, body string, scope_name string, scope_version string,
      event_timestamp timestamp, event_date date, event_name string, organization_id string, session_id string,
      terminal_type string, user_account_uuid string, user_email string, user_id string, prompt string, prompt_length bigint,
      prompt_redacted boolean, model string, cost_usd double, duration_ms bigint, input_tokens bigint, output_tokens bigint,
      cache_creation_tokens bigint, cache_read_tokens bigint, decision string, source string, tool_name string,
      decision_source string, decision_type string, success boolean, tool_result_size_bytes bigint, status_code string,
      error string, attempt int, host_arch string, host_name string, os_type string, os_version string, service_name string,
      service_version string, resource_user_email string, resource_user_practice string, resource_user_profile string,
      resource_user_serial string, attributes_json string, resource_json string, raw_message_json string,
      is_malformed boolean, parse_error string"""),
}
_NEEDED = {"employees": "email full_name practice level location", "telemetry_events": "event_id event_timestamp event_name user_email session_id"}
_IDS = {"employees": "email", "telemetry_events": "event_id"}
_THERE = {*EXPRESSIONS, "event_timestamp", "event_date", "outer_timestamp_ms", "prompt_redacted"}


def _defined_sql() -> str:
    rows = []
    for name, (source, columns) in _TABLES.items():
        for at, pair in enumerate(columns.split(",")):
            column, kind = pair.split()
            if column == "is_malformed":
                filled = f"(SELECT count(*) FROM {source})"
            else:
                filled = f"(SELECT count({column}) FROM {source})" if source == "e" or column in _THERE else "0"
            rows.append(
                f"SELECT '{name}' AS table_name, {at} AS position, '{column}' AS column_name, '{kind}' AS kind,"
                f" {column in _NEEDED[name].split()} AS needed, {column == _IDS[name]} AS is_key, {filled} AS filled"
            )
    return TABLES_SQL + " UNION ALL ".join(rows)


register("define_tables", _defined, _defined_sql())


def issues(name: str, rules: validation.Rules, spoil: Callable[[DataFrame], DataFrame], sql: str) -> None:
    """A query whose rows are the issues of a sample table that ``spoil`` has changed."""

    def run(spark: SparkSession, folder: str) -> DataFrame:
        frame = {TELEMETRY_EVENTS: sample_events, EMPLOYEES: sample_employees}[rules.table](spark, folder)
        rows = [(i.problem, i.field, i.amount) for i in validation.find_issues(spoil(frame), rules)]
        return spark.createDataFrame(rows, "problem string, field string, amount bigint")

    register(name, run, TABLES_SQL + sql)


def _violations_sql(tab: str, rules: validation.Rules) -> str:
    """NULLs in needed columns, repeated keys and emptiness, counted by SQL."""
    needed = [f.name for f in rules.fields if f.needed]
    counts = [f"SELECT 'NULL in' AS problem, '{c}' AS field, count(*) AS amount FROM {tab} WHERE {c} IS NULL" for c in needed]
    if rules.key:
        counts.append(f"SELECT 'repeated key', '{rules.key}', count(*) - count(DISTINCT {rules.key}) FROM {tab}")
    counted = f"SELECT * FROM ({' UNION ALL '.join(counts)}) WHERE amount > 0"
    return counted + f" UNION ALL SELECT 'no rows', NULL, NULL FROM (SELECT count(*) AS n FROM {tab}) WHERE n = 0"


def _with_gaps(frame: DataFrame) -> DataFrame:
    n = F.col("event_id").cast("bigint")
    return frame.withColumns(
        {
            "user_email": F.when(n % 4 != 1, F.col("user_email")),
            "session_id": F.when(n % 10 != 2, F.col("session_id")),
        }
    )


issues("validate_events", validation.EVENT_RULES, lambda t: t, _violations_sql("t", validation.EVENT_RULES))
issues("validate_employees", validation.EMPLOYEE_RULES, lambda t: t, _violations_sql("e", validation.EMPLOYEE_RULES))
issues(
    "validate_required_values",
    validation.EVENT_RULES,
    _with_gaps,
    """, g AS (SELECT * REPLACE (CASE WHEN n % 4 <> 1 THEN user_email END AS user_email,
      CASE WHEN n % 10 <> 2 THEN session_id END AS session_id) FROM t) """
    + _violations_sql("g", validation.EVENT_RULES),
)
issues(
    "validate_not_empty",
    validation.EVENT_RULES,
    lambda t: t.filter(F.col("event_name") == "unheard of"),
    ", g AS (SELECT * FROM t WHERE event_name = 'unheard of') " + _violations_sql("g", validation.EVENT_RULES),
)
issues(
    "validate_required_columns",
    validation.EVENT_RULES,
    lambda t: t.drop("user_email", "event_id"),
    """ SELECT 'column not there:' AS problem, field, CAST(NULL AS BIGINT) AS amount
    FROM (VALUES ('event_id'), ('user_email')) AS f(field) WHERE (SELECT count(*) FROM t) > 0""",
)
issues(
    "validate_data_types",
    validation.EVENT_RULES,
    lambda t: t.withColumns({"cost_usd": F.col("cost_usd").cast("string"), "success": F.col("success").cast("int")}),
    """ SELECT problem, field, CAST(NULL AS BIGINT) AS amount
    FROM (VALUES ('no number column:', 'cost_usd'), ('no flag column:', 'success')) AS f(problem, field)
    WHERE (SELECT count(*) FROM t) > 0""",
)
issues(
    "validate_timestamps",
    validation.Rules(TELEMETRY_EVENTS, (validation.Field("event_timestamp", validation.TIME, needed=True),)),
    lambda t: t.withColumn("event_timestamp", F.when(F.col("event_name") != "api_error", F.col("event_timestamp"))),
    " SELECT 'NULL in' AS problem, 'event_timestamp' AS field, count(*) AS amount FROM t WHERE event_name = 'api_error'",
)
issues(
    "validate_unique_key",
    validation.EMPLOYEE_RULES,
    lambda e: e.withColumn(
        "email", F.when(F.col("level") == "L1", F.lit("shared@example.com")).otherwise(F.col("email"))
    ),
    """, g AS (SELECT * REPLACE (CASE WHEN level = 'L1' THEN 'shared@example.com' ELSE email END AS email) FROM e) """
    + _violations_sql("g", validation.EMPLOYEE_RULES),
)


def _null_counts(spark: SparkSession, folder: str) -> DataFrame:
    """The counts behind the value checks."""
    profile = validation.profile_values(_with_gaps(sample_events(spark, folder)), NOT_NULL[TELEMETRY_EVENTS], "event_id")
    rows = [("rows", profile.rows), ("keys", profile.keys), *profile.nulls.items()]
    return spark.createDataFrame(rows, "measured string, amount bigint")


register(
    "profile_values",
    _null_counts,
    TABLES_SQL
    + """SELECT 'rows' AS measured, count(*) AS amount FROM t UNION ALL SELECT 'keys', count(DISTINCT event_id) FROM t
    UNION ALL SELECT 'event_id', 0 UNION ALL SELECT 'event_timestamp', 0 UNION ALL SELECT 'event_name', 0
    UNION ALL SELECT 'user_email', count(*) FROM t WHERE n % 4 = 1
    UNION ALL SELECT 'session_id', count(*) FROM t WHERE n % 10 = 2""",
)
