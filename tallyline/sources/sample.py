"""The sample star-schema tables read as telemetry.

``sample_events`` and ``sample_employees`` map the ``events`` and ``customer``
tables to the stored tables. ``sample_lines`` turns the same events back into the
raw form, JSON batches with two levels of JSON, and spoils some of them by fixed
rules, so that ingestion can be checked against the source rows at any scale.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyline.schemas import EVENT_SCHEMA

# Sample event type -> event name.
EVENT_NAMES = {
    "purchase": "api_request",
    "view": "tool_result",
    "click": "tool_decision",
    "signup": "user_prompt",
    "error": "api_error",
}

# Stored column -> expression over the sample columns, `k` and `shown` (event name).
EXPRESSIONS = {
    "event_id": "CAST(event_id AS STRING)",
    "event_name": "shown",
    "user_email": "'user' || CAST(user_id AS STRING) || '@example.com'",
    "user_id": "CAST(user_id AS STRING)",
    "organization_id": "'org-' || CAST(user_id % 30 AS STRING)",
    "session_id": "CAST(user_id AS STRING) || '-' || CAST(CAST(ts AS DATE) AS STRING)",
    "terminal_type": "CASE WHEN user_id % 9 <> 8 THEN 'term-' || CAST(user_id % 8 AS STRING) END",
    "model": "CASE WHEN shown = 'api_request' AND k % 10 <> 9 THEN 'model-' || CAST(k % 5 AS STRING) END",
    "cost_usd": "CASE WHEN shown = 'api_request' AND k % 7 <> 6 THEN value END",
    "duration_ms": "CASE WHEN shown IN ('api_request', 'tool_result') THEN CAST(event_id * 37 % 20000 AS BIGINT) END",
    "input_tokens": "CASE WHEN shown = 'api_request' THEN CAST(k * 11 AS BIGINT) END",
    "output_tokens": "CASE WHEN shown = 'api_request' AND k % 4 <> 3 THEN CAST(k * 7 AS BIGINT) END",
    "cache_creation_tokens": "CASE WHEN shown = 'api_request' THEN CAST(event_id % 1000 AS BIGINT) END",
    "cache_read_tokens": "CASE WHEN shown = 'api_request' THEN CAST(event_id % 5000 AS BIGINT) END",
    "prompt": "CASE WHEN shown = 'user_prompt' THEN CASE WHEN k % 3 <> 2 THEN '<REDACTED>' ELSE 'prompt ' || CAST(k AS STRING) END END",
    "prompt_length": "CASE WHEN shown = 'user_prompt' THEN CAST(k * 3 AS BIGINT) END",
    "decision": "CASE WHEN shown = 'tool_decision' THEN CASE WHEN k % 5 <> 4 THEN 'accept' ELSE 'reject' END END",
    "source": "CASE WHEN shown = 'tool_decision' THEN 'source-' || CAST(k % 3 AS STRING) END",
    "tool_name": "CASE WHEN shown IN ('tool_result', 'tool_decision') AND k % 10 <> 8 THEN 'tool-' || CAST(k % 8 AS STRING) END",
    "decision_source": "CASE WHEN shown = 'tool_result' THEN 'source-' || CAST(k % 4 AS STRING) END",
    "decision_type": "CASE WHEN shown = 'tool_result' THEN 'accept' END",
    "success": "CASE WHEN shown = 'tool_result' AND k % 20 <> 0 THEN k % 6 <> 5 END",
    "tool_result_size_bytes": "CASE WHEN shown = 'tool_result' AND k % 3 <> 0 THEN CAST(event_id * 13 % 100000 AS BIGINT) END",
    "status_code": "CASE WHEN shown = 'api_error' THEN CASE k % 5 WHEN 0 THEN '429' WHEN 1 THEN '500' WHEN 2 THEN '401' WHEN 3 THEN '400' ELSE 'undefined' END END",
    "error": "CASE WHEN shown = 'api_error' THEN 'message ' || CAST(k % 6 AS STRING) END",
    "attempt": "CASE WHEN shown = 'api_error' AND k % 3 <> 2 THEN CAST(k % 4 + 1 AS INT) END",
    "resource_user_practice": "CASE WHEN user_id % 4 <> 3 THEN 'R' || CAST(user_id % 3 AS STRING) END",
}


# Columns of the sample tables the mapping reads, so that no job has to infer them.
# Times are stored without a zone; read as UTC, conditions on them reach the scan.
SAMPLE_SCHEMAS = {
    "events": "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string",
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_mktsegment string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "region": "r_regionkey int, r_name string",
}


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    reader = spark.read
    if name in SAMPLE_SCHEMAS:
        reader = reader.schema(SAMPLE_SCHEMAS[name])
    return reader.parquet(f"{folder}/{name}.parquet")


def _named_events(spark: SparkSession, folder: str) -> DataFrame:
    cases = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in EVENT_NAMES.items())
    return table(spark, folder, "events").select(
        "event_id",
        "ts",
        "user_id",
        "value",
        F.regexp_extract("props", "([0-9]+)", 1).cast("int").alias("k"),
        F.expr(f"CASE event_type {cases} END").alias("shown"),
    )


def sample_events(spark: SparkSession, folder: str) -> DataFrame:
    """The sample events with the 61 stored columns."""
    return _as_events(_named_events(spark, folder))


def _as_events(named: DataFrame, *more: str) -> DataFrame:
    texts = {
        **EXPRESSIONS,
        "event_timestamp": "ts",
        "event_date": "to_date(ts)",
        "outer_timestamp_ms": "unix_millis(ts) + k * 10",
        "prompt_redacted": "CASE WHEN shown = 'user_prompt' THEN k % 3 <> 2 END",
        "is_malformed": "false",
    }
    return named.selectExpr(
        *more,
        *[
            f"CAST({texts.get(f.name, 'NULL')} AS {f.dataType.simpleString()}) AS {f.name}"
            for f in EVENT_SCHEMA
        ],
    )


def sample_employees(spark: SparkSession, folder: str) -> DataFrame:
    """Customers as employees; every tenth is left out."""
    nation, region = table(spark, folder, "nation"), table(spark, folder, "region")
    customer = table(spark, folder, "customer").filter("c_custkey % 10 <> 9")
    return (
        customer.join(nation, customer.c_nationkey == nation.n_nationkey)
        .join(region, nation.n_regionkey == region.r_regionkey)
        .selectExpr(
            "'user' || CAST(c_custkey AS STRING) || '@example.com' AS email",
            "c_name AS full_name",
            "c_mktsegment AS practice",
            "'L' || CAST(c_custkey % 10 + 1 AS STRING) AS level",
            "r_name AS location",
        )
    )


# Events per line of the raw form.
EVENTS_PER_LINE = 8


def _number_text(name: str) -> Column:
    """Whole numbers in the forms raw data has: padded, with a fraction, or not numbers."""
    n, form = F.col(name).cast("string"), F.col("event_id") % 9
    return (
        F.when(form == 1, F.concat(F.lit(" "), n, F.lit("\t")))
        .when(form == 2, F.concat(n, F.lit(".5")))
        .when(form == 3, F.concat(n, F.lit(".7")))
        .when(form == 4, F.concat(n, F.lit("d")))
        .when(form == 5, F.when(n.isNotNull(), F.lit("nan")))
        .otherwise(n)
    )


def _flag_text(name: str) -> Column:
    text, form = F.col(name).cast("string"), F.col("event_id") % 7
    return (
        F.when(form == 1, F.initcap(text))
        .when(form == 2, F.concat(F.lit(" "), F.upper(text), F.lit("\n")))
        .when(form == 3, F.when(text.isNotNull(), F.lit("yes")))
        .when(form == 4, F.when(text.isNotNull(), F.lit("1")))
        .otherwise(text)
    )


def _time_text() -> Column:
    """The event time with Z, with an offset, without a zone, and two useless forms."""
    form, at = F.col("event_id") % 10, F.col("event_timestamp")
    micros = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"
    return (
        F.when(F.col("event_id") % 50 == 31, F.lit("junk"))
        .when(F.col("event_id") % 50 == 41, F.lit("10:00"))
        .when(form == 2, F.concat(F.date_format(at + F.expr("INTERVAL 2 HOURS"), micros), F.lit("+02:00")))
        .when(form == 3, F.date_format(at, "yyyy-MM-dd HH:mm:ss.SSSSSS"))
        .otherwise(F.concat(F.date_format(at, micros), F.lit("Z")))
    )


def sample_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Raw batch lines: (line_id, value). Rules by line and by event spoil some of them."""
    # Shuffled as narrow source rows, so that the text is built in parallel next to its line.
    line = F.floor(F.col("event_id") / EVENTS_PER_LINE).alias("line_id")
    placed = _named_events(spark, folder).select("*", line).repartition("line_id")
    number = F.col("event_id").cast("bigint")
    typed = _as_events(placed, "line_id").withColumn("event_id", number)
    at = F.col("event_id") % 50

    def padded(name: str) -> Column:
        return F.concat(F.lit(" "), F.col(name), F.lit("\t\n")).alias(name)

    attributes = F.struct(
        _time_text().alias("event.timestamp"),
        F.when(at != 11, F.col("event_name")).alias("event.name"),
        F.col("organization_id").alias("organization.id"),
        F.col("session_id").alias("session.id"),
        F.coalesce(F.col("terminal_type"), F.lit("  ")).alias("terminal.type"),
        F.col("user_email").alias("user.email"),
        F.col("user_id").alias("user.id"),
        padded("prompt"),
        _number_text("prompt_length").alias("prompt_length"),
        padded("model"),
        F.col("cost_usd").cast("string").alias("cost_usd"),
        _number_text("duration_ms").alias("duration_ms"),
        _number_text("input_tokens").alias("input_tokens"),
        "output_tokens",
        F.col("cache_creation_tokens").cast("string").alias("cache_creation_tokens"),
        F.col("cache_read_tokens").cast("string").alias("cache_read_tokens"),
        "decision",
        "source",
        "tool_name",
        "decision_source",
        "decision_type",
        _flag_text("success").alias("success"),
        "tool_result_size_bytes",
        "status_code",
        "error",
        "attempt",
    )
    resource = F.struct(
        F.lit("arm64").alias("host.arch"),
        F.lit("").alias("user.email"),
        F.col("resource_user_practice").alias("user.practice"),
    )
    scope = F.struct(F.lit("events").alias("name"), F.lit("1.0").alias("version"))
    body = F.concat(F.lit("telemetry."), F.col("event_name")).alias("body")
    plain = F.to_json(F.struct(body, attributes.alias("attributes"), scope.alias("scope"), resource.alias("resource")))
    no_section = F.to_json(F.struct(body, F.lit("none").alias("attributes")))
    message = (
        F.when(at == 27, F.substring(plain, 1, 40))
        .when(at == 37, F.lit("[1]"))
        .when(at == 47, no_section)
        .otherwise(plain)
    )
    wrapper = {"timestamp": F.col("outer_timestamp_ms"), "message": message}
    identity = F.when(at != 21, F.col("event_id").cast("string")).alias("id")
    item = (
        F.when(at == 7, F.lit("5"))
        .when(at == 17, F.to_json(F.struct(identity, F.lit(12).alias("message"))))
        .otherwise(F.to_json(F.struct(identity, *[c.alias(n) for n, c in wrapper.items()])))
    )
    items = typed.select("line_id", "event_id", item.alias("item"))
    lists = items.groupBy("line_id").agg(
        F.concat_ws(",", F.transform(F.sort_array(F.collect_list(F.struct("event_id", "item"))), lambda x: x["item"])).alias("listed")
    )
    head = (
        '{"messageType":"DATA_MESSAGE","owner":"owner-1","logGroup":"/telemetry",'
        '"logStream":"main","subscriptionFilters":["all"],"year":"2024","month":1,"day":2,'
    )
    rule = F.col("line_id") % 20
    whole = F.concat(F.lit(head), F.lit('"logEvents":['), F.col("listed"), F.lit("]}"))
    value = (
        F.when(rule == 3, F.expr("left(whole, length(whole) - 5)"))
        .when(rule == 6, F.lit(head + '"logEvents":"none"}'))
        .when(rule == 9, F.lit(head + '"logEvents":[]}'))
        .when(rule == 12, F.concat(F.col("whole"), F.lit(" tail")))
        .when(rule == 15, F.lit(""))
        .when(rule == 18, F.lit("[1]"))
        .otherwise(F.col("whole"))
    )
    return lists.withColumn("whole", whole).select("line_id", value.alias("value"))
