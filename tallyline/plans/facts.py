"""One table per kind of event, and events with their employee."""

from __future__ import annotations

from pyspark.sql import DataFrame

from tallyline.functions.measures import is_event
from tallyline.operators.filters import with_employee
from tallyline.schemas import API_ERROR, API_REQUEST, TOOL_DECISION, TOOL_RESULT, USER_PROMPT

PERSON = ["full_name", "practice", "level", "location"]

# Columns of each fact table.
_SHARED = (
    "event_id", "event_timestamp", "event_date", "user_email", "session_id", "organization_id",
    "terminal_type",
)
FACTS = {
    "api_requests": (API_REQUEST, (
        "model", "cost_usd", "duration_ms", "input_tokens", "output_tokens",
        "cache_creation_tokens", "cache_read_tokens",
    )),
    "api_errors": (API_ERROR, ("model", "status_code", "error", "attempt")),
    "user_prompts": (USER_PROMPT, ("prompt_length", "prompt_redacted")),
    "tool_decisions": (TOOL_DECISION, ("tool_name", "decision", "source")),
    "tool_results": (TOOL_RESULT, (
        "tool_name", "success", "duration_ms", "tool_result_size_bytes", "decision_type",
        "decision_source",
    )),
}


def fact(events: DataFrame, name: str) -> DataFrame:
    """The fact table ``name``: its events and the columns they use."""
    event_name, columns = FACTS[name]
    return events.filter(is_event(event_name)).select(*_SHARED, *columns)


def enriched(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Events (or a fact table) with their employee's details."""
    return with_employee(events, employees, PERSON)
