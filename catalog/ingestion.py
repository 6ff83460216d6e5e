"""Reading, flattening and cleaning, checked against the rows the raw text was made from."""

from __future__ import annotations

from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from catalog.base import TABLES_SQL, register
from tallyline.functions.parsing import clean_text, to_decimal_number, to_flag, to_utc, to_whole_number
from tallyline.operators import cleaning, flatten
from tallyline.pipeline import load_datasets, open_tables, run_pipeline, stored_rejects
from tallyline.schemas import ATTRIBUTE_FIELDS, EMPLOYEE_COLUMNS, EVENT_COLUMNS, EVENT_MUST_HAVE, RESOURCE_FIELDS, SCOPE_FIELDS, TEXT_COLUMNS
from tallyline.session import shared_folder
from tallyline.sources.batches import read_lines, read_telemetry_batches
from tallyline.sources.employees import FILE_ORDER, read_employees_csv
from tallyline.sources.sample import EVENTS_PER_LINE, sample_employees, sample_events, sample_lines, table

# `s` is every source event with its line, the rule that spoils the line, and its own rule;
# `u` the ones that reach the message, `c` the ones cleaning keeps.
SOURCE_SQL = (
    TABLES_SQL
    + f""", s AS (
  SELECT *, CAST(n // {EVENTS_PER_LINE} AS INT) AS line, CAST(n // {EVENTS_PER_LINE} AS INT) % 20 AS rule,
         CAST(n % {EVENTS_PER_LINE} AS INT) AS idx, n % 50 AS spot
  FROM t
), good AS (SELECT * FROM s WHERE rule NOT IN (3, 6, 9, 12, 15, 18)
), bad AS (
  SELECT DISTINCT line, CASE WHEN rule = 18 THEN '{flatten.LINE_NOT_OBJECT}'
    WHEN rule = 6 THEN '{flatten.NO_EVENT_LIST}' ELSE '{flatten.LINE_UNREADABLE}' END AS line_error
  FROM s WHERE rule IN (3, 6, 12, 15, 18)
), u AS (SELECT * FROM good WHERE spot NOT IN (7, 17, 27, 37)
), c AS (SELECT * FROM u WHERE spot NOT IN (47, 11, 21, 31, 41))
"""
)


def _whole_sql(name: str) -> str:
    return (
        f"CASE CAST(n % 9 AS INT) WHEN 2 THEN CAST(CAST({name} AS DOUBLE) + 0.5 AS BIGINT)"
        f" WHEN 3 THEN {name} + 1 WHEN 4 THEN NULL WHEN 5 THEN NULL ELSE {name} END AS {name}"
    )


_SUCCESS_SQL = "CASE WHEN n % 7 IN (3, 4) THEN NULL ELSE success END AS success"


def _form_sql(name: str) -> str:
    """A whole number as raw data has it."""
    return (
        f"CASE CAST(n % 9 AS INT) WHEN 1 THEN ' ' || {name} || chr(9) WHEN 2 THEN {name} || '.5' WHEN 3 THEN {name} || '.7'"
        f" WHEN 4 THEN {name} || 'd' WHEN 5 THEN CASE WHEN {name} IS NOT NULL THEN 'nan' END ELSE CAST({name} AS STRING) END"
    )


_MICROS = "%Y-%m-%dT%H:%M:%S.%f"
_TIME_TEXT_SQL = f"""CASE WHEN n % 50 = 31 THEN 'junk' WHEN n % 50 = 41 THEN '10:00'
  WHEN n % 10 = 2 THEN strftime(event_timestamp + INTERVAL 2 HOUR, '{_MICROS}') || '+02:00'
  WHEN n % 10 = 3 THEN strftime(event_timestamp, '{_MICROS.replace("T", " ")}')
  ELSE strftime(event_timestamp, '{_MICROS}') || 'Z' END"""
_FLAG_TEXT_SQL = """CASE CAST(n % 7 AS INT) WHEN 1 THEN CASE WHEN success THEN 'True' ELSE 'False' END
  WHEN 2 THEN ' ' || upper(CAST(success AS STRING)) || chr(10) WHEN 3 THEN 'yes' WHEN 4 THEN '1' ELSE CAST(success AS STRING) END"""
#: Each attribute of a message as text, by its key, in the order of the raw documents.
_ATTRIBUTES_SQL = {
    "event.timestamp": _TIME_TEXT_SQL,
    "event.name": "CASE WHEN spot <> 11 THEN event_name END",
    "organization.id": "organization_id", "session.id": "session_id", "terminal.type": "coalesce(terminal_type, '  ')",
    "user.email": "user_email", "user.id": "user_id", "prompt": "' ' || prompt || chr(9) || chr(10)",
    "prompt_length": _form_sql("prompt_length"), "model": "' ' || model || chr(9) || chr(10)", "cost_usd": "cost_usd",
    "duration_ms": _form_sql("duration_ms"), "input_tokens": _form_sql("input_tokens"), "output_tokens": "output_tokens",
    "cache_creation_tokens": "cache_creation_tokens", "cache_read_tokens": "cache_read_tokens", "decision": "decision",
    "source": "source", "tool_name": "tool_name", "decision_source": "decision_source", "decision_type": "decision_type",
    "success": f"CASE WHEN success IS NOT NULL THEN {_FLAG_TEXT_SQL} END", "tool_result_size_bytes": "tool_result_size_bytes",
    "status_code": "status_code", "error": "error", "attempt": "attempt",
}
_RESOURCE_SQL = {"host.arch": "'arm64'", "user.email": "''", "user.practice": "resource_user_practice"}
_NUMBERS = ("output_tokens", "tool_result_size_bytes", "attempt")


def _object_sql(values: dict[str, str], ordered: bool = False) -> str:
    """JSON text of an object without its NULLs; parsed ones have their keys in order."""
    parts = [
        f"""'"{key}":' || """ + (f"CAST({sql} AS STRING)" if key in _NUMBERS else f"to_json(CAST({sql} AS STRING))")
        for key, sql in (sorted(values.items()) if ordered else values.items())
    ]
    return f"'{{' || concat_ws(',', {', '.join(parts)}) || '}}'"


_HEAD = (
    '{"messageType":"DATA_MESSAGE","owner":"owner-1","logGroup":"/telemetry",'
    '"logStream":"main","subscriptionFilters":["all"],"year":"2024","month":1,"day":2,'
)
# `r` is every source event with its message as text, `lines` every line with its text.
RAW_SQL = (
    SOURCE_SQL
    + f""", p AS (
  SELECT *, '{{"body":' || to_json('telemetry.' || event_name) || ',"attributes":' || {_object_sql(_ATTRIBUTES_SQL)}
    || ',"scope":{{"name":"events","version":"1.0"}},"resource":' || {_object_sql(_RESOURCE_SQL)} || '}}' AS plain
  FROM s
), r AS (
  SELECT *, CASE spot WHEN 27 THEN left(plain, 40) WHEN 37 THEN '[1]'
    WHEN 47 THEN '{{"body":' || to_json('telemetry.' || event_name) || ',"attributes":"none"}}' ELSE plain END AS message
  FROM p
), items AS (
  SELECT line, rule, n, CASE WHEN spot = 7 THEN '5' ELSE
    '{{' || concat_ws(',', CASE WHEN spot <> 21 THEN '"id":"' || n || '"' END,
      CASE WHEN spot <> 17 THEN '"timestamp":' || outer_timestamp_ms END,
      '"message":' || CASE WHEN spot = 17 THEN '12' ELSE to_json(message) END) || '}}' END AS item
  FROM r
), listed AS (
  SELECT line, rule, '{_HEAD}"logEvents":[' || string_agg(item, ',' ORDER BY n) || ']}}' AS whole FROM items GROUP BY line, rule
), lines AS (
  SELECT line, rule, CASE rule WHEN 3 THEN left(whole, length(whole) - 5) WHEN 6 THEN '{_HEAD}"logEvents":"none"}}'
    WHEN 9 THEN '{_HEAD}"logEvents":[]}}' WHEN 12 THEN whole || ' tail' WHEN 15 THEN '' WHEN 18 THEN '[1]' ELSE whole END AS value
  FROM listed
)
"""
)
#: What a message that is not text, or none of whose fields can be read, leaves as its raw text.
EVENT_TEXT_SQL = "CASE spot WHEN 7 THEN '5' WHEN 17 THEN '12' ELSE message END"


def raw(spark: SparkSession, folder: str) -> DataFrame:
    return sample_lines(spark, folder).select(
        F.lit("sample").alias("source_file"),
        (F.col("line_id") + 1).cast("int").alias("line_number"),
        "value",
    )


def flat(spark: SparkSession, folder: str) -> DataFrame:
    return flatten.flatten_batches(raw(spark, folder))


# Inputs are written once for a session and folder, so that a second run times the query alone.
@lru_cache(maxsize=16)
def _written_lines(spark: SparkSession, folder: str) -> str:
    """The raw lines as text files; each also holds its position in its file."""
    path = shared_folder(spark, "lines")
    in_partition = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    line = F.concat_ws("\x1f", F.col("value"), in_partition.cast("string"))
    sample_lines(spark, folder).select(line.alias("value")).write.text(path)
    return path


@lru_cache(maxsize=16)
def _written_batches(spark: SparkSession, folder: str) -> str:
    path = shared_folder(spark, "batches")
    sample_lines(spark, folder).select("value").write.text(path)
    return path


@lru_cache(maxsize=16)
def _written_employees(spark: SparkSession, folder: str) -> str:
    path = shared_folder(spark, "employees")
    sample_employees(spark, folder).write.option("header", True).csv(path)
    return path


# --- sources ---


def _line_numbers(spark: SparkSession, folder: str) -> DataFrame:
    lines = read_lines(spark, _written_lines(spark, folder))
    position = F.substring_index("value", "\x1f", -1).cast("int")
    return lines.groupBy((F.col("line_number") == position + 1).alias("right_number")).agg(
        F.count(F.lit(1)).alias("lines")
    )


register(
    "line_number",
    _line_numbers,
    SOURCE_SQL + "SELECT TRUE AS right_number, count(DISTINCT line) AS lines FROM s",
)

_COUNTS_SQL = (
    SOURCE_SQL
    + f"""SELECT parse_error, count(*) AS events FROM (
  SELECT line_error AS parse_error FROM bad
  UNION ALL SELECT CASE spot WHEN 7 THEN '{flatten.ITEM_NOT_OBJECT}' WHEN 17 THEN '{flatten.MESSAGE_NOT_TEXT}'
    WHEN 27 THEN '{flatten.MESSAGE_UNREADABLE}' WHEN 37 THEN '{flatten.MESSAGE_NOT_OBJECT}' END FROM good
) GROUP BY parse_error"""
)
register(
    "read_telemetry_batches",
    lambda spark, folder: read_telemetry_batches(spark, _written_batches(spark, folder))
    .groupBy("parse_error")
    .agg(F.count(F.lit(1)).alias("events")),
    _COUNTS_SQL,
)
register(
    "read_employees_csv",
    lambda spark, folder: read_employees_csv(spark, _written_employees(spark, folder)).drop(*FILE_ORDER),
    TABLES_SQL + "SELECT * FROM e",
)


def _required(spark: SparkSession, folder: str) -> DataFrame:
    """Lines found at several paths: a file's folder, a pattern, and places where nothing is."""
    path, found = _written_batches(spark, folder), None
    for kind, name in (("folder", path), ("pattern", f"{path}/part-*"), ("missing", f"{path}-none"), ("missing file", f"{path}/none.jsonl")):
        try:
            lines, there = read_lines(spark, name), True
        except AnalysisException as error:
            lines, there = spark.createDataFrame([], "value string"), "PATH_NOT_FOUND" not in str(error)
        rows = lines.agg(F.lit(kind).alias("kind"), F.lit(there).alias("there"), F.count(F.lit(1)).alias("line_count"))
        found = rows if found is None else found.unionByName(rows)
    return found


register(
    "require_input",
    _required,
    SOURCE_SQL
    + """SELECT kind, kind NOT LIKE 'missing%' AS there, CASE WHEN kind LIKE 'missing%' THEN 0 ELSE (SELECT count(DISTINCT line) FROM s) END AS line_count
    FROM (VALUES ('folder'), ('pattern'), ('missing'), ('missing file')) AS v(kind)""",
)


def _both(spark: SparkSession, folder: str) -> DataFrame:
    telemetry, employees = load_datasets(
        spark, _written_batches(spark, folder), _written_employees(spark, folder)
    )
    counts = [
        frame.agg(F.lit(name).alias("dataset"), F.count(F.lit(1)).alias("row_count"))
        for name, frame in (("telemetry", telemetry), ("employees", employees))
    ]
    return counts[0].unionByName(counts[1])


register(
    "load_datasets",
    _both,
    SOURCE_SQL
    + """SELECT 'telemetry' AS dataset, (SELECT count(*) FROM bad) + (SELECT count(*) FROM good) AS row_count
    UNION ALL SELECT 'employees', (SELECT count(*) FROM e)""",
)

# --- flattening ---

register(
    "parse_batch_line",
    lambda spark, folder: flatten.parse_batch_lines(raw(spark, folder)).select("line_number", "line_error"),
    SOURCE_SQL
    + """SELECT DISTINCT s.line + 1 AS line_number, line_error FROM s LEFT JOIN bad ON s.line = bad.line""",
)
register(
    "explode_log_events",
    lambda spark, folder: flat(spark, folder).select("line_number", "event_index"),
    SOURCE_SQL
    + """SELECT line + 1 AS line_number, idx AS event_index FROM good
    UNION ALL SELECT line + 1, NULL FROM bad""",
)
register(
    "batch_context",
    lambda spark, folder: flat(spark, folder)
    .select(
        "line_number", "message_type", "owner", "log_group", "log_stream", "subscription_filters",
        "year", "month", "day",
    )
    .distinct(),
    SOURCE_SQL
    + f"""SELECT DISTINCT s.line + 1 AS line_number,
    CASE WHEN ok THEN 'DATA_MESSAGE' END AS message_type, CASE WHEN ok THEN 'owner-1' END AS owner,
    CASE WHEN ok THEN '/telemetry' END AS log_group, CASE WHEN ok THEN 'main' END AS log_stream,
    CASE WHEN ok THEN '["all"]' END AS subscription_filters, CASE WHEN ok THEN '2024' END AS year,
    CASE WHEN ok THEN '1' END AS month, CASE WHEN ok THEN '2' END AS day
    FROM (SELECT *, coalesce(line_error = '{flatten.NO_EVENT_LIST}', TRUE) AS ok
          FROM s LEFT JOIN bad USING (line)) s WHERE rule <> 9""",
)
register(
    "flatten_log_event",
    lambda spark, folder: flat(spark, folder).select(
        "line_number", "event_index", "event_id", "is_malformed", "parse_error"
    ),
    SOURCE_SQL
    + f"""SELECT line + 1 AS line_number, idx AS event_index,
    CASE WHEN spot NOT IN (7, 21) THEN event_id END AS event_id, spot IN (7, 17, 27, 37) AS is_malformed,
    CASE spot WHEN 7 THEN '{flatten.ITEM_NOT_OBJECT}' WHEN 17 THEN '{flatten.MESSAGE_NOT_TEXT}'
      WHEN 27 THEN '{flatten.MESSAGE_UNREADABLE}' WHEN 37 THEN '{flatten.MESSAGE_NOT_OBJECT}' END AS parse_error
    FROM good UNION ALL SELECT line + 1, NULL, NULL, TRUE, line_error FROM bad""",
)
register(
    "event_context",
    lambda spark, folder: flat(spark, folder)
    .filter("event_index IS NOT NULL")
    .select("line_number", "event_index", "event_id", "outer_timestamp_ms", "raw_message"),
    RAW_SQL
    + f"""SELECT line + 1 AS line_number, idx AS event_index, CASE WHEN spot NOT IN (7, 21) THEN event_id END AS event_id,
    CASE WHEN spot NOT IN (7, 17) THEN CAST(outer_timestamp_ms AS STRING) END AS outer_timestamp_ms,
    {EVENT_TEXT_SQL} AS raw_message FROM r WHERE rule NOT IN (3, 6, 9, 12, 15, 18)""",
)
_BATCH_SQL = {
    "message_type": "'DATA_MESSAGE'", "owner": "'owner-1'", "log_group": "'/telemetry'", "log_stream": "'main'",
    "subscription_filters": """'["all"]'""",
}
_KEPT_SQL = {
    "attributes_json": _object_sql(_ATTRIBUTES_SQL, ordered=True), "resource_json": _object_sql(_RESOURCE_SQL, ordered=True),
    "raw_message_json": "message",
}
_MESSAGE_COLUMNS = [
    "body", *SCOPE_FIELDS, *ATTRIBUTE_FIELDS, *RESOURCE_FIELDS, *_KEPT_SQL,
]


def _message_sql(name: str) -> str:
    """A message's field as text; messages of spot 47 have a body only."""
    if name in ("body", "raw_message_json"):
        return f"""{"'telemetry.' || event_name" if name == "body" else "message"} AS {name}"""
    if name in _KEPT_SQL:
        return f"CASE WHEN spot <> 47 THEN {_KEPT_SQL[name]} ELSE '{{}}' END AS {name}"
    known = {**{c: _ATTRIBUTES_SQL.get(k) for c, k in ATTRIBUTE_FIELDS.items()}, **{c: _RESOURCE_SQL.get(k) for c, k in RESOURCE_FIELDS.items()},
             "scope_name": "'events'", "scope_version": "'1.0'"}[name]
    return f"CASE WHEN spot <> 47 THEN CAST({known or 'NULL'} AS STRING) END AS {name}"


register(
    "extract_message_fields",
    lambda spark, folder: flat(spark, folder).filter("NOT is_malformed").select("line_number", "event_index", *_MESSAGE_COLUMNS),
    RAW_SQL
    + f"""SELECT line + 1 AS line_number, idx AS event_index, {", ".join(map(_message_sql, _MESSAGE_COLUMNS))}
    FROM r WHERE rule NOT IN (3, 6, 9, 12, 15, 18) AND spot NOT IN (7, 17, 27, 37)""",
)
register(
    "safe_object",
    lambda spark, folder: flat(spark, folder)
    .filter("NOT is_malformed")
    .groupBy(
        (F.col("attributes_json") == "{}").alias("no_attributes"),
        (F.col("resource_json") == "{}").alias("no_resource"),
        F.col("session_id").isNull().alias("no_session"),
        F.col("raw_message_json").isNull().alias("no_message"),
    )
    .agg(F.count(F.lit(1)).alias("events")),
    SOURCE_SQL
    + """SELECT spot = 47 AS no_attributes, spot = 47 AS no_resource, spot = 47 AS no_session, FALSE AS no_message,
    count(*) AS events FROM u GROUP BY spot = 47""",
)

# --- cleaning ---

_CLEAN = {
    "source_file": "'sample'", "line_number": "line + 1", "event_index": "idx", **_BATCH_SQL,
    "year": "2024", "month": "1", "day": "2", "raw_message": "message", "body": "'telemetry.' || event_name",
    "scope_name": "'events'", "scope_version": "'1.0'", "cost_usd": "round(round(cost_usd, 9), 6)",
    **{c: _whole_sql(c).rsplit(" AS ", 1)[0] for c in ("prompt_length", "duration_ms", "input_tokens")},
    "success": _SUCCESS_SQL.rsplit(" AS ", 1)[0], "host_arch": "'arm64'", **_KEPT_SQL, "is_malformed": "FALSE",
    # Never there, or blank, which cleaning makes NULL.
    **dict.fromkeys(("user_account_uuid", "host_name", "os_type", "os_version", "service_name", "service_version",
                     "resource_user_email", "resource_user_profile", "resource_user_serial", "parse_error"), "CAST(NULL AS STRING)"),
}
_CLEANED = "FROM r WHERE rule NOT IN (3, 6, 9, 12, 15, 18) AND spot NOT IN (7, 17, 27, 37, 47, 11, 21, 31, 41)"


def clean_sql(columns: list[str]) -> str:
    """Columns of the events that cleaning keeps."""
    return RAW_SQL + f"SELECT {', '.join(f'{_CLEAN.get(c, c)} AS {c}' for c in columns)} {_CLEANED}"


register(
    "clean_events",
    lambda spark, folder: cleaning.clean_events(flat(spark, folder)).select(*EVENT_COLUMNS),
    clean_sql(EVENT_COLUMNS),
)

#: Files that Spark writes have names and an order of lines of their own.
LOADED_COLUMNS = [c for c in EVENT_COLUMNS if c not in ("source_file", "line_number")]


def _loaded(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "tables")
    run_pipeline(spark, root, _written_batches(spark, folder), _written_employees(spark, folder))
    events, employees = open_tables(spark, root)
    known = employees.select(F.col("email").alias("user_email"), "full_name", "practice", "level", "location")
    placed = F.col("source_file").contains("/part-") & (F.col("line_number") > 0)
    return events.join(known, "user_email", "left").select(
        *LOADED_COLUMNS, placed.alias("has_place"), "full_name", "practice", "level", "location"
    )


register(
    "full_load",
    _loaded,
    f"WITH x AS ({clean_sql(LOADED_COLUMNS)}), y AS ({TABLES_SQL} SELECT * FROM e)"
    " SELECT x.*, TRUE AS has_place, y.full_name, y.practice, y.level, y.location FROM x LEFT JOIN y ON x.user_email = y.email",
)


def _stored_rejects(spark: SparkSession, folder: str) -> DataFrame:
    root = shared_folder(spark, "tables")
    run_pipeline(spark, root, _written_batches(spark, folder), _written_employees(spark, folder))
    return stored_rejects(spark, root).drop("source_file", "line_number")


register(
    "drop_malformed",
    lambda spark, folder: cleaning.drop_malformed(flat(spark, folder)).select("line_number", "event_index"),
    SOURCE_SQL + "SELECT line + 1 AS line_number, idx AS event_index FROM u",
)
register(
    "drop_missing_required",
    lambda spark, folder: cleaning.drop_missing_required(flat(spark, folder), EVENT_MUST_HAVE).select(
        "line_number", "event_index"
    ),
    SOURCE_SQL + "SELECT line + 1 AS line_number, idx AS event_index FROM u WHERE spot NOT IN (11, 21, 47)",
)
register(
    "normalize_timestamps",
    lambda spark, folder: cleaning.normalize_timestamps(flat(spark, folder)).select(
        "line_number", "event_index", "event_timestamp"
    ),
    SOURCE_SQL
    + "SELECT line + 1 AS line_number, idx AS event_index, event_timestamp FROM u WHERE spot NOT IN (31, 41, 47)",
)
register(
    "derive_event_date",
    lambda spark, folder: cleaning.derive_event_date(
        cleaning.normalize_timestamps(flat(spark, folder))
    )
    .groupBy("event_date")
    .agg(F.count(F.lit(1)).alias("events")),
    SOURCE_SQL
    + "SELECT event_date, count(*) AS events FROM u WHERE spot NOT IN (31, 41, 47) GROUP BY event_date",
)


def _numbers(spark: SparkSession, folder: str) -> DataFrame:
    """Prices and quantities of all order lines as text in several forms, read back as numbers."""
    form = F.col("l_orderkey") % 6
    price = F.col("l_extendedprice").cast("string")
    text = (
        F.when(form == 1, F.concat(F.lit("\t "), price))
        .when(form == 2, F.concat(price, F.lit("d")))
        .when(form == 3, F.lit("NaN"))
        .when(form == 4, F.lit(""))
        .otherwise(price)
    )
    return table(spark, folder, "lineitem").select(
        "l_orderkey",
        "l_linenumber",
        to_decimal_number(text).alias("price"),
        to_whole_number(F.concat(F.col("l_quantity").cast("string"), F.lit(" "))).alias("quantity"),
    )


register(
    "to_numeric",
    _numbers,
    """SELECT l_orderkey, l_linenumber,
    CASE WHEN l_orderkey % 6 IN (2, 3, 4) THEN NULL ELSE round(round(l_extendedprice, 9), 6) END AS price,
    CAST(l_quantity AS BIGINT) AS quantity FROM lineitem""",
)
register(
    "to_nullable_bool",
    lambda spark, folder: cleaning.convert_flags(cleaning.drop_malformed(flat(spark, folder))).select(
        "line_number", "event_index", "success"
    ),
    SOURCE_SQL
    + f"SELECT line + 1 AS line_number, idx AS event_index, CASE WHEN spot <> 47 THEN success END AS success FROM (SELECT * EXCLUDE (success), {_SUCCESS_SQL} FROM u)",
)
_BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12) || chr(160) || chr(8195) || chr(12288)"
register(
    "clean_strings",
    lambda spark, folder: cleaning.clean_strings(
        table(spark, folder, "documents").select(
            "doc_id",
            F.concat(F.lit(" \t "), F.col("text"), F.lit("　\r\n\xa0")).alias("text"),
            F.when(F.col("doc_id").cast("string").endswith("7"), F.lit(" \n "))
            .otherwise(F.col("lang"))
            .alias("lang"),
        ),
        ["text", "lang"],
    ).select("doc_id", "lang", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("text_length")),
    f"""SELECT doc_id, CASE WHEN CAST(doc_id AS STRING) LIKE '%7' THEN NULL ELSE lang END AS lang,
    md5(nullif(trim(text, {_BLANKS}), '')) AS text_md5, length(nullif(trim(text, {_BLANKS}), '')) AS text_length
    FROM documents""",
)
register(
    "flag_prompt_redacted",
    lambda spark, folder: cleaning.flag_prompt_redacted(
        cleaning.clean_strings(cleaning.drop_malformed(flat(spark, folder)), TEXT_COLUMNS)
    ).select("line_number", "event_index", "prompt_redacted"),
    SOURCE_SQL
    + "SELECT line + 1 AS line_number, idx AS event_index, CASE WHEN spot <> 47 THEN prompt_redacted END AS prompt_redacted FROM u",
)
register(
    "standardize_column_names",
    lambda spark, folder: cleaning.standardize_column_names(
        table(spark, folder, "orders").select(
            F.col("o_orderkey").alias("OrderKey"),
            F.col("o_custkey").alias(" Cust  Key"),
            F.col("o_orderstatus").alias("order-status2Code_"),
        )
    ),
    "SELECT o_orderkey AS order_key, o_custkey AS cust_key, o_orderstatus AS order_status2_code FROM orders",
)


def _raw_employees(spark: SparkSession, folder: str) -> DataFrame:
    """Employee rows with padded, blank and missing cells, and a second row for every fifth e-mail."""
    key = F.regexp_extract("email", "([0-9]+)", 1).cast("bigint")
    base = sample_employees(spark, folder).withColumn("key", key)
    twice = base.withColumn("copy", F.explode(F.when(F.col("key") % 5 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    second = F.col("copy") == 1
    return twice.select(
        F.when(second, F.concat(F.lit(" \t"), F.upper("email"), F.lit("\n"))).otherwise(F.col("email")).alias("Email"),
        F.concat(F.lit(" "), F.col("full_name")).alias("fullName"),
        F.when((F.col("key") % 7 != 3) | second, F.col("practice")).alias("practice"),
        F.when(second, F.lit("L10")).otherwise(F.col("level")).alias("Level"),
        "location",
        F.lit("employees.csv").alias(FILE_ORDER[0]),
        F.lit(0).cast("bigint").alias(FILE_ORDER[1]),
        (F.col("copy") * 1_000_000_000 + F.col("key")).alias(FILE_ORDER[2]),
    )


_EMPLOYEES_SQL = (
    TABLES_SQL
    + """, x AS (SELECT *, CAST(regexp_extract(email, '([0-9]+)', 1) AS BIGINT) AS key FROM e)
SELECT email, full_name, practice, CASE WHEN key % 7 = 3 THEN 'L10' ELSE level END AS level, location
FROM x WHERE key % 7 <> 3 OR key % 5 = 0"""
)
register(
    "clean_employees",
    lambda spark, folder: cleaning.clean_employees(_raw_employees(spark, folder)).select(*EMPLOYEE_COLUMNS),
    _EMPLOYEES_SQL,
)


def _first_rows(spark: SparkSession, folder: str) -> DataFrame:
    """The first order of each customer: the operator behind employee deduplication."""
    orders = table(spark, folder, "orders").select("o_custkey", "o_orderkey", "o_orderstatus")
    return cleaning.first_per_key(orders, "o_custkey", ["o_orderkey"])


register(
    "dedupe_employees",
    _first_rows,
    """SELECT o_custkey, o_orderkey, o_orderstatus FROM orders
    QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1""",
)


def _scalars(spark: SparkSession, folder: str) -> DataFrame:
    """Times, flags and texts of all events in several written forms."""
    form = F.col("n") % 5
    at = F.col("event_timestamp")
    shown = (
        F.when(form == 0, F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"))
        .when(form == 1, F.date_format(at - F.expr("INTERVAL 90 MINUTES"), "yyyy-MM-dd HH:mm:ss.SSSSSS'-01:30'"))
        .when(form == 2, F.date_format(at, "yyyy-MM-dd"))
        .when(form == 3, F.date_format(at, "HH:mm:ss"))
        .otherwise(F.lit("soon"))
    )
    events = sample_events(spark, folder).withColumn("n", F.col("event_id").cast("bigint"))
    return events.select(
        "event_id",
        to_utc(shown).alias("read_time"),
        to_flag(F.initcap(F.col("success").cast("string"))).alias("read_flag"),
        clean_text(F.concat(F.lit("\x1f "), F.col("tool_name"), F.lit(" \x85"))).alias("read_text"),
    )


register(
    "scalar_parsing",
    _scalars,
    TABLES_SQL
    + """SELECT event_id, CASE WHEN n % 5 IN (0, 1) THEN event_timestamp
    WHEN n % 5 = 2 THEN CAST(event_date AS TIMESTAMP) END AS read_time,
    success AS read_flag, tool_name AS read_text FROM t""",
)
