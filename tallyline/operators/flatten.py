"""Log batches to event rows.

A batch is a JSON document with a ``logEvents`` list; each element carries a second
JSON document as text in ``message``. Everything is one linear chain of built-in
expressions: parse the line, explode, parse the message, pick the fields. Lines,
elements and messages that cannot be read become rows too, marked and explained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyline.functions.parsing import (
    document_root,
    fields_of,
    json_text,
    large_document,
    whole_document,
)
from tallyline.schemas import (
    ATTRIBUTE_FIELDS,
    BATCH_FIELDS,
    EVENT_FIELDS,
    RESOURCE_FIELDS,
    SCOPE_FIELDS,
)

# Members kept as JSON values because their own type matters.
BATCH_PARTS = ("subscriptionFilters", "logEvents")
EVENT_PARTS = ("message",)
EVENT_TEXTS = {name: key for name, key in EVENT_FIELDS.items() if key not in EVENT_PARTS}
KEPT_SECTIONS = ("attributes", "resource")
SECTIONS = {"scope": SCOPE_FIELDS, "attributes": ATTRIBUTE_FIELDS, "resource": RESOURCE_FIELDS}

# Reasons a row is malformed.
LINE_UNREADABLE = "Top-level JSON parse failed: not one valid JSON document"
LINE_NOT_OBJECT = "Top-level JSON value is not an object."
NO_EVENT_LIST = "Top-level logEvents field is missing or not a list."
ITEM_NOT_OBJECT = "logEvents item is not an object."
MESSAGE_NOT_TEXT = "logEvents.message is missing or not a string."
MESSAGE_UNREADABLE = "Nested message JSON parse failed: not one valid JSON document"
MESSAGE_NOT_OBJECT = "Nested message JSON value is not an object."


def parse_batch_lines(lines: DataFrame) -> DataFrame:
    """Add ``batch`` (the parsed line's fields), ``log_events`` and ``line_error`` to lines
    of (source_file, line_number, value).

    A list of events is an array also when it is empty; anything else is an error. A
    document too large for one JSON value is read field by field, its events one by one.
    """
    wrapped = lines.withColumn("_wrapped", whole_document(F.col("value")))
    parsed = wrapped.withColumn("_root", document_root(F.col("_wrapped"), F.col("value")))
    opened = parsed.withColumn("batch", fields_of(F.col("_root"), BATCH_FIELDS.values(), BATCH_PARTS))
    listed = opened.withColumn(
        "log_events", F.try_variant_get("batch.logEvents", "$", "array<variant>")
    )
    # Only for documents that are no JSON value: spoilt ones, which stay NULL, and large ones.
    columns = [f"`{key}`: string" for key in BATCH_FIELDS.values()]
    columns += ["`subscriptionFilters`: variant", "`logEvents`: array<variant>"]
    unread = F.when(F.col("_root").isNull(), F.col("value"))
    fixed = F.inline(F.array(F.struct(large_document(unread, ", ".join(columns)).alias("_large"))))
    large = listed.select("*", fixed)
    whole = F.struct(*[F.col("_large")[key].alias(key) for key in (*BATCH_FIELDS.values(), "subscriptionFilters")], F.lit(None).cast("variant").alias("logEvents"))
    return (
        large.withColumn("batch", F.coalesce("batch", F.when(F.col("_large").isNotNull(), whole)))
        .withColumn("log_events", F.coalesce("log_events", F.col("_large.logEvents")))
        .withColumn(
            "line_error",
            F.when(F.col("_root").isNull() & F.col("_large").isNull(), LINE_UNREADABLE)
            .when(F.col("batch").isNull(), LINE_NOT_OBJECT)
            .when(F.col("log_events").isNull(), NO_EVENT_LIST),
        )
        .drop("_wrapped", "_large")
    )


def batch_context() -> list[Column]:
    """Fields every event inherits from its batch."""
    return [
        F.col("source_file"),
        F.col("line_number"),
        *[F.col("batch")[key].alias(name) for name, key in BATCH_FIELDS.items()],
        json_text(F.col("batch")["subscriptionFilters"]).alias("subscription_filters"),
    ]


def explode_log_events(batches: DataFrame) -> DataFrame:
    """One row per list element with its 0-based index, one row per unreadable line.

    The line's text travels on only for unreadable lines.
    """
    no_element = F.array(F.lit(None).cast("variant"))
    raw = F.when(F.col("batch").isNull() | F.col("_root").isNull(), F.col("value")).otherwise(F.to_json("_root"))
    raw = F.when(F.col("line_error").isNotNull(), raw)
    one_or_more = F.when(F.col("line_error").isNotNull(), no_element).otherwise(F.col("log_events"))
    return batches.select(
        *batch_context(),
        "line_error",
        raw.alias("_raw_line"),
        F.posexplode(one_or_more).alias("_index", "item"),
    )


def flatten_log_events(items: DataFrame) -> DataFrame:
    """Read the element and the JSON document in its message."""
    context = [c for c in items.columns if c not in ("_index", "item", "_raw_line", "line_error")]
    line_ok = F.col("line_error").isNull()
    opened = items.withColumn("event", fields_of(F.col("item"), EVENT_TEXTS.values(), EVENT_PARTS))
    message = F.col("event.message")
    texts = opened.withColumn(
        "_text",
        F.when(F.schema_of_variant(message) == "STRING", F.try_variant_get(message, "$", "string")),
    )
    wrapped = texts.withColumn("_wrapped", whole_document(F.col("_text")))
    parsed = wrapped.withColumn("_root", document_root(F.col("_wrapped"), F.col("_text")))
    read = parsed.withColumn("document", fields_of(F.col("_root"), ["body"], SECTIONS))
    error = (
        F.when(~line_ok, F.col("line_error"))
        .when(F.col("event").isNull(), ITEM_NOT_OBJECT)
        .when(F.col("_text").isNull(), MESSAGE_NOT_TEXT)
        .when(F.col("_root").isNull(), MESSAGE_UNREADABLE)
        .when(F.col("document").isNull(), MESSAGE_NOT_OBJECT)
    )
    raw = (
        F.when(~line_ok, F.col("_raw_line"))
        .when(F.col("event").isNull(), F.to_json("item"))
        .otherwise(F.try_variant_get(message, "$", "string"))
    )
    sections = {name: F.col("document")[name] for name in SECTIONS}
    # Exploding a one-row list fixes the parsed parts as columns of their own. Without it
    # the optimizer would copy the parsing into every later filter on an event's fields.
    fixed = F.inline(
        F.array(
            F.struct(
                F.when(line_ok, F.col("_index")).alias("event_index"),
                *[F.col("event")[key].alias(name) for name, key in EVENT_TEXTS.items()],
                raw.alias("raw_message"),
                F.col("document")["body"].alias("body"),
                *[
                    fields_of(sections[name], keys.values()).alias(name)
                    for name, keys in SECTIONS.items()
                ],
                *[F.to_json(sections[name]).alias(f"{name}_text") for name in KEPT_SECTIONS],
                F.col("_text").alias("raw_message_json"),
                error.alias("parse_error"),
            )
        )
    )
    kept = {f"{name}_json": section_text(name) for name in KEPT_SECTIONS}
    kept["raw_message_json"] = F.col("raw_message_json")
    return read.select(*context, fixed).select(
        *context,
        "event_index",
        *EVENT_TEXTS,
        "raw_message",
        "body",
        *[
            F.col(section)[key].alias(name)
            for section, keys in SECTIONS.items()
            for name, key in keys.items()
        ],
        *[
            F.when(F.col("parse_error").isNull(), text).alias(name) for name, text in kept.items()
        ],
        F.col("parse_error").isNotNull().alias("is_malformed"),
        "parse_error",
    )


def section_text(section: str) -> Column:
    """JSON text of a parsed message section; anything but an object counts as empty."""
    return F.when(F.col(section).isNotNull(), F.col(f"{section}_text")).otherwise(F.lit("{}"))


def flatten_batches(lines: DataFrame) -> DataFrame:
    """Event rows, still as text, from (source_file, line_number, value)."""
    return flatten_log_events(explode_log_events(parse_batch_lines(lines)))
