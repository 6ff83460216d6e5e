"""Column names, types and JSON locations of the two stored tables."""

from __future__ import annotations

from pyspark.sql import types as T

# Column types in use.
_TYPES = {
    "string": T.StringType(),
    "int": T.IntegerType(),
    "bigint": T.LongType(),
    "double": T.DoubleType(),
    "boolean": T.BooleanType(),
    "timestamp": T.TimestampType(),
    "date": T.DateType(),
}


def _schema(columns: str) -> T.StructType:
    """``name type, name type, ...`` as a schema, also before a session exists."""
    pairs = [column.split() for column in columns.split(",")]
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in pairs])


EMPLOYEES = "employees"
TELEMETRY_EVENTS = "telemetry_events"

# The employee dimension.
EMPLOYEE_SCHEMA = _schema(
    "email string, full_name string, practice string, level string, location string"
)
EMPLOYEE_COLUMNS = EMPLOYEE_SCHEMA.names

# The stored event table, in storage order.
EVENT_SCHEMA = _schema(
    """
    event_id string, source_file string, line_number int, event_index int,
    message_type string, owner string, log_group string, log_stream string,
    subscription_filters string, year int, month int, day int,
    outer_timestamp_ms bigint, raw_message string, body string,
    scope_name string, scope_version string,
    event_timestamp timestamp, event_date date, event_name string,
    organization_id string, session_id string, terminal_type string,
    user_account_uuid string, user_email string, user_id string,
    prompt string, prompt_length bigint, prompt_redacted boolean,
    model string, cost_usd double, duration_ms bigint,
    input_tokens bigint, output_tokens bigint,
    cache_creation_tokens bigint, cache_read_tokens bigint,
    decision string, source string, tool_name string,
    decision_source string, decision_type string,
    success boolean, tool_result_size_bytes bigint,
    status_code string, error string, attempt int,
    host_arch string, host_name string, os_type string, os_version string,
    service_name string, service_version string,
    resource_user_email string, resource_user_practice string,
    resource_user_profile string, resource_user_serial string,
    attributes_json string, resource_json string, raw_message_json string,
    is_malformed boolean, parse_error string
    """
)
EVENT_COLUMNS = EVENT_SCHEMA.names

# Columns that hold JSON text.
JSON_COLUMNS = ("subscription_filters", "attributes_json", "resource_json", "raw_message_json")

# Stored column -> JSON key, per section of the source documents.
BATCH_FIELDS = {
    "message_type": "messageType",
    "owner": "owner",
    "log_group": "logGroup",
    "log_stream": "logStream",
    "year": "year",
    "month": "month",
    "day": "day",
}
EVENT_FIELDS = {"event_id": "id", "outer_timestamp_ms": "timestamp", "raw_message": "message"}
SCOPE_FIELDS = {"scope_name": "name", "scope_version": "version"}
ATTRIBUTE_FIELDS = {
    "event_timestamp": "event.timestamp",
    "event_name": "event.name",
    "organization_id": "organization.id",
    "session_id": "session.id",
    "terminal_type": "terminal.type",
    "user_account_uuid": "user.account_uuid",
    "user_email": "user.email",
    "user_id": "user.id",
    "prompt": "prompt",
    "prompt_length": "prompt_length",
    "model": "model",
    "cost_usd": "cost_usd",
    "duration_ms": "duration_ms",
    "input_tokens": "input_tokens",
    "output_tokens": "output_tokens",
    "cache_creation_tokens": "cache_creation_tokens",
    "cache_read_tokens": "cache_read_tokens",
    "decision": "decision",
    "source": "source",
    "tool_name": "tool_name",
    "decision_source": "decision_source",
    "decision_type": "decision_type",
    "success": "success",
    "tool_result_size_bytes": "tool_result_size_bytes",
    "status_code": "status_code",
    "error": "error",
    "attempt": "attempt",
}
RESOURCE_FIELDS = {
    "host_arch": "host.arch",
    "host_name": "host.name",
    "os_type": "os.type",
    "os_version": "os.version",
    "service_name": "service.name",
    "service_version": "service.version",
    "resource_user_email": "user.email",
    "resource_user_practice": "user.practice",
    "resource_user_profile": "user.profile",
    "resource_user_serial": "user.serial",
}

# Cleaning rules.
EVENT_MUST_HAVE = ("event_id", "event_timestamp", "event_name")
REDACTED_PROMPT = "<REDACTED>"
WHOLE_NUMBER_COLUMNS = (
    "outer_timestamp_ms",
    "year",
    "month",
    "day",
    "prompt_length",
    "duration_ms",
    "input_tokens",
    "output_tokens",
    "cache_creation_tokens",
    "cache_read_tokens",
    "tool_result_size_bytes",
    "attempt",
)
DECIMAL_COLUMNS = ("cost_usd",)
# Text columns stripped by cleaning; provenance, raw payloads and parse results are kept as read.
KEPT_AS_READ = ("source_file", "raw_message", "parse_error", *JSON_COLUMNS)
TEXT_COLUMNS = tuple(
    f.name
    for f in EVENT_SCHEMA
    if isinstance(f.dataType, T.StringType) and f.name not in KEPT_AS_READ
)

# Columns a stored row may not leave empty, and each table's key.
NOT_NULL = {
    EMPLOYEES: ("email", "full_name", "practice", "level", "location"),
    TELEMETRY_EVENTS: ("event_id", "event_timestamp", "event_name", "user_email", "session_id"),
}
KEY = {EMPLOYEES: "email", TELEMETRY_EVENTS: "event_id"}
SCHEMA = {EMPLOYEES: EMPLOYEE_SCHEMA, TELEMETRY_EVENTS: EVENT_SCHEMA}

# Event names.
API_REQUEST = "api_request"
API_ERROR = "api_error"
TOOL_RESULT = "tool_result"
TOOL_DECISION = "tool_decision"
USER_PROMPT = "user_prompt"
KNOWN_EVENTS = (API_REQUEST, API_ERROR, TOOL_RESULT, TOOL_DECISION, USER_PROMPT)
