"""How complete and consistent the data is."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import is_event, ratio
from tallyline.functions.parsing import clean_text, to_decimal_number, to_flag, to_utc, to_whole_number
from tallyline.operators import flatten
from tallyline.schemas import (
    API_REQUEST,
    DECIMAL_COLUMNS,
    EVENT_MUST_HAVE,
    EVENT_SCHEMA,
    KNOWN_EVENTS,
    NOT_NULL,
    TELEMETRY_EVENTS,
    TOOL_RESULT,
    WHOLE_NUMBER_COLUMNS,
)

# Columns that cleaning reads as numbers or flags.
CONVERTED = (*WHOLE_NUMBER_COLUMNS, *DECIMAL_COLUMNS, "success")

# What each kind of event should carry.
EXPECTED = {
    API_REQUEST: ("model", "cost_usd", "duration_ms", "input_tokens", "output_tokens",
                  "cache_creation_tokens", "cache_read_tokens"),
    "api_error": ("status_code", "error"),
    "user_prompt": ("prompt_length",),
    "tool_decision": ("tool_name", "decision", "source"),
    TOOL_RESULT: ("tool_name", "success", "duration_ms"),
}

# Category of each reason a row is malformed.
CATEGORIES = {
    flatten.LINE_UNREADABLE: "top_level_json",
    flatten.LINE_NOT_OBJECT: "top_level_json",
    flatten.NO_EVENT_LIST: "log_events",
    flatten.ITEM_NOT_OBJECT: "event_item",
    flatten.MESSAGE_NOT_TEXT: "event_message",
    flatten.MESSAGE_UNREADABLE: "event_message",
    flatten.MESSAGE_NOT_OBJECT: "event_message",
}


def raw_log_batches(lines: DataFrame) -> DataFrame:
    """One row per source line, with a stable id, its batch fields and number of events."""
    batches = flatten.parse_batch_lines(lines)
    return batches.select(
        F.sha2(F.concat_ws(":", "source_file", "line_number"), 256).alias("batch_id"),
        *flatten.batch_context(),
        F.when(F.col("line_error").isNull(), F.size("log_events")).alias("event_count"),
        F.col("value").alias("raw_json"),
    ).withColumns({c: F.expr(f"try_cast({c} AS INT)") for c in ("year", "month", "day")})


def reject_rows(flat: DataFrame) -> DataFrame:
    """Rows that cannot be loaded, each with its place, raw text, category and reason.

    Malformed rows, and readable rows that lack a required value or whose time is no
    time; blank counts as missing.
    """
    empty = [c for c in NOT_NULL[TELEMETRY_EVENTS] if c != "event_timestamp"]
    missing = F.concat_ws(", ", *[F.when(clean_text(F.col(c)).isNull(), F.lit(c)) for c in empty])
    no_time = F.col("event_timestamp").isNull()
    bad_time = to_utc(F.col("event_timestamp")).isNull()
    reason = (
        F.when(F.col("is_malformed"), F.col("parse_error"))
        .when(no_time, F.concat_ws(", ", F.lit("Missing required values: event_timestamp"), F.nullif(missing, F.lit(""))))
        .when(missing != "", F.concat(F.lit("Missing required values: "), missing))
        .when(bad_time, F.concat(F.lit("Unusable event_timestamp: "), F.col("event_timestamp")))
    )
    by_reason = F.create_map(*[F.lit(x) for pair in CATEGORIES.items() for x in pair])
    category = (
        F.when(F.col("is_malformed"), F.try_element_at(by_reason, F.col("parse_error")))
        .when(no_time | (missing != ""), F.lit("missing_required"))
        .otherwise(F.lit("type_conversion"))
    )
    return flat.select(
        "source_file",
        "line_number",
        "event_index",
        "event_id",
        F.coalesce("raw_message_json", "raw_message").alias("raw_text"),
        category.alias("category"),
        reason.alias("message"),
    ).filter(F.col("message").isNotNull())


def join_coverage(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Events and users that have an employee, as counts and shares."""
    per_user = events.groupBy(F.col("user_email").alias("email")).agg(F.count(F.lit(1)).alias("event_count"))
    known = employees.select("email", F.lit(True).alias("known"))
    joined = per_user.join(known, "email", "left")
    return joined.agg(
        F.coalesce(F.sum("event_count"), F.lit(0)).alias("event_count"),
        F.coalesce(F.sum(F.when(F.col("known"), F.col("event_count"))), F.lit(0)).alias("matched_events"),
        F.count("email").alias("user_count"),
        F.count("known").alias("matched_users"),
    ).select(
        "*",
        ratio(F.col("matched_events"), F.col("event_count")).alias("event_coverage"),
        ratio(F.col("matched_users"), F.col("user_count")).alias("user_coverage"),
    )


def unmatched_users(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Users of telemetry without an employee, with their number of events."""
    per_user = (
        events.filter(F.col("user_email").isNotNull())
        .groupBy("user_email")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )
    return per_user.join(
        employees.select(F.col("email").alias("user_email")), "user_email", "left_anti"
    ).orderBy(F.desc("event_count"), "user_email")


def idle_employees(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Employees without telemetry."""
    seen = events.select(F.col("user_email").alias("email")).distinct()
    return employees.join(seen, "email", "left_anti").orderBy("email")


def _unusable(name: str) -> Column:
    """A number or flag is there, but cleaning will make it NULL."""
    value = F.col(name)
    if name in DECIMAL_COLUMNS:
        read = to_decimal_number(value)
    elif name in WHOLE_NUMBER_COLUMNS:
        read = to_whole_number(value, EVENT_SCHEMA[name].dataType.simpleString())
    else:
        read = to_flag(value)
    return clean_text(value.cast("string")).isNotNull() & read.isNull()


def conversion_failures(flat: DataFrame) -> DataFrame:
    """How many values of each number and flag of readable rows can't be used; one scan.

    Their rows are loaded with NULL there.
    """
    counts = flat.filter(~F.col("is_malformed")).agg(*[F.count_if(_unusable(c)).alias(c) for c in CONVERTED])
    rows = [F.struct(F.lit(c).alias("field"), F.col(c).alias("unusable")) for c in CONVERTED]
    return counts.select(F.inline(F.array(*rows))).orderBy("field")


def duplicate_events(events: DataFrame) -> DataFrame:
    """Event ids that occur more than once, their copies and the first place of each."""
    place = F.struct("source_file", "line_number", "event_index")
    return (
        events.filter(F.col("event_id").isNotNull())
        .groupBy("event_id")
        .agg(F.count(F.lit(1)).alias("copies"), F.min(place).alias("first"))
        .filter("copies > 1")
        .select("event_id", "copies", "first.source_file", "first.line_number", "first.event_index")
    )


def timestamp_skew(events: DataFrame) -> DataFrame:
    """Difference between the log's time and the event's own, per event name."""
    skew = F.col("outer_timestamp_ms") - F.unix_millis("event_timestamp")
    return (
        events.groupBy("event_name")
        .agg(
            F.count(skew).alias("compared"),
            F.min(skew).alias("smallest_ms"),
            F.max(skew).alias("largest_ms"),
            F.avg(skew).alias("average_ms"),
            F.count(F.when(F.abs(skew) > 1000, 1)).alias("over_a_second"),
        )
        .orderBy("event_name")
    )


def missing_by_event(events: DataFrame) -> DataFrame:
    """How often each expected field is missing, per kind of event; one scan."""
    fields = sorted({f for names in EXPECTED.values() for f in names})
    counts = events.groupBy("event_name").agg(
        F.count(F.lit(1)).alias("event_count"),
        *[F.count(F.when(F.col(f).isNull(), 1)).alias(f) for f in fields],
    )
    pairs = [
        F.when(F.col("event_name") == name, F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("missing")) for f in names]))
        for name, names in EXPECTED.items()
    ]
    return (
        counts.select("event_name", "event_count", F.explode(F.coalesce(*pairs)).alias("m"))
        .select("event_name", "m.field", "event_count", "m.missing", ratio(F.col("m.missing"), F.col("event_count")).alias("missing_rate"))
        .orderBy("event_name", "field")
    )


def unknown_events(events: DataFrame) -> DataFrame:
    """Event names no report knows; they are kept, not dropped."""
    return (
        events.filter(~F.col("event_name").isin(*KNOWN_EVENTS))
        .groupBy("event_name")
        .agg(F.count(F.lit(1)).alias("event_count"))
        .orderBy(F.desc("event_count"), "event_name")
    )


def data_quality(flat: DataFrame, employees: DataFrame) -> DataFrame:
    """Issues found in flattened rows, with their severity and number.

    ``fatal`` stops a load, ``reject`` removes the row, ``warning`` keeps it. All checks of
    rows share one aggregation per user, which also finds users without an employee;
    repeated ids need a count per id, over that column alone.
    """
    readable = ~F.col("is_malformed")
    usable = readable & F.col("event_name").isNotNull()
    in_line = F.col("event_index").isNotNull()
    no_time = F.col("event_timestamp").isNotNull() & to_utc(F.col("event_timestamp")).isNull()
    checks = {
        "malformed_line": ("reject", ~readable & ~in_line),
        "malformed_event": ("reject", ~readable & in_line),
        **{f"missing_{c}": ("reject", readable & F.col(c).isNull()) for c in EVENT_MUST_HAVE},
        "unusable_event_timestamp": ("reject", readable & no_time),
        "missing_user_email": ("fatal", usable & clean_text(F.col("user_email")).isNull()),
        "missing_session_id": ("fatal", usable & clean_text(F.col("session_id")).isNull()),
        "unknown_event_name": ("warning", usable & ~F.col("event_name").isin(*KNOWN_EVENTS)),
        "missing_cost": ("warning", is_event(API_REQUEST) & F.col("cost_usd").isNull()),
        "missing_success": ("warning", is_event(TOOL_RESULT) & F.col("success").isNull()),
        "unusable_value": ("warning", readable & reduce(or_, map(_unusable, CONVERTED))),
    }
    per_user = flat.groupBy(clean_text(F.col("user_email")).alias("email")).agg(
        F.count(F.lit(1)).alias("rows"),
        *[F.count(F.when(test, 1)).alias(name) for name, (_, test) in checks.items()],
    )
    known = employees.select("email", F.lit(1).alias("known"))
    stray = F.when(F.col("email").isNotNull() & F.col("known").isNull(), F.col("rows"))
    severities = {"rows": "info", **{name: severity for name, (severity, _) in checks.items()}}
    severities["missing_employee"] = "warning"
    totals = (
        per_user.join(known, "email", "left")
        .withColumn("missing_employee", stray)
        .agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in severities])
    )
    rows = [
        F.struct(F.lit(name).alias("issue"), F.lit(severity).alias("severity"), F.col(name).alias("found"))
        for name, severity in severities.items()
    ]
    repeats = flat.filter(F.col("event_id").isNotNull()).groupBy("event_id").agg(
        (F.count(F.lit(1)) - 1).alias("more")
    )
    repeated = repeats.agg(
        F.lit("duplicate_event_id").alias("issue"),
        F.lit("fatal").alias("severity"),
        F.coalesce(F.sum("more"), F.lit(0)).alias("found"),
    )
    return totals.select(F.inline(F.array(*rows))).unionByName(repeated)
