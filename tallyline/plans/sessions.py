"""Sessions and users: summaries, rankings and drill-downs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyline.functions.measures import api_only, elapsed_ms, is_event
from tallyline.operators import rollup as R
from tallyline.operators.filters import require_positive
from tallyline.schemas import API_ERROR, API_REQUEST, KEY, TELEMETRY_EVENTS, TOOL_RESULT, USER_PROMPT


def sessions(events: DataFrame) -> DataFrame:
    """One row per session. Its user is the one with most events, ties by e-mail; its
    organization the most frequent one of that user in the session, ties by id."""
    measures = [
        R.earliest("session_start", F.col("event_timestamp")),
        R.latest("session_end", F.col("event_timestamp")),
        R.count("event_count"),
        R.count("prompt_count", is_event(USER_PROMPT)),
        R.count("api_request_count", is_event(API_REQUEST)),
        R.count("tool_result_count", is_event(TOOL_RESULT)),
        R.count("api_error_count", is_event(API_ERROR)),
        R.total("total_cost_usd", api_only(F.col("cost_usd"))),
    ]
    merged = [m.again() for m in measures]
    known = events.filter(F.col("session_id").isNotNull())
    finest = known.groupBy("session_id", "user_email", "organization_id").agg(
        *[m.first() for m in measures]
    )
    rank = (-F.col("event_count")).alias("rank")
    per_user = finest.groupBy("session_id", "user_email").agg(
        F.min_by("organization_id", F.struct(rank, "organization_id")).alias("organization_id"),
        *merged,
    )
    return (
        per_user.groupBy("session_id")
        .agg(
            F.min_by(F.struct("user_email", "organization_id"), F.struct(rank, "user_email")).alias("main"),
            *merged,
        )
        .select(
            "session_id",
            "main.user_email",
            "main.organization_id",
            "session_start",
            "session_end",
            elapsed_ms(F.col("session_start"), F.col("session_end")).alias("duration_ms"),
            "event_count",
            "prompt_count",
            "api_request_count",
            "tool_result_count",
            "api_error_count",
            F.coalesce("total_cost_usd", F.lit(0.0)).alias("total_cost_usd"),
        )
    )


def session_timeline(events: DataFrame, session_id: str) -> DataFrame:
    """The events of one session in order."""
    return (
        events.filter(F.col("session_id") == session_id)
        .select(
            "event_timestamp", "event_id", "event_name", "user_email", "model", "tool_name",
            "success", "status_code", "duration_ms", "cost_usd",
        )
        .orderBy("event_timestamp", "event_id")
    )


def user_sessions(events: DataFrame, user_email: str) -> DataFrame:
    """The sessions of one user, as that user's events show them, in order."""
    return sessions(events.filter(F.col("user_email") == user_email)).orderBy(
        "session_start", "session_id"
    )


def high_cost(events: DataFrame, entity: str, limit: int = 10) -> DataFrame:
    """The most expensive users (``user_email``), sessions (``session_id``) or requests (``event_id``)."""
    if entity not in ("user_email", "session_id", "event_id"):
        raise ValueError(f"Unsupported entity: {entity}")
    require_positive(limit)
    requests = events.filter(is_event(API_REQUEST) & F.col(entity).isNotNull())
    if entity == KEY[TELEMETRY_EVENTS]:
        # Each request is its own group: the top rows of each task are enough.
        summed = requests.select(entity, F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.lit(1).cast("bigint").alias("request_count"))
    else:
        summed = requests.groupBy(entity).agg(
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"), F.count(F.lit(1)).alias("request_count")
        )
    return summed.orderBy(F.desc("cost_usd"), entity).limit(limit)
