"""Who uses the tools, how often and how deeply."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.measures import UNKNOWN, is_event, ratio
from tallyline.operators import rollup as R
from tallyline.operators.filters import NO_FILTERS, EventFilters, with_employee
from tallyline.plans.dimensions import EMPLOYEE_DIMENSIONS, by_dimension
from tallyline.schemas import API_REQUEST, TOOL_RESULT, USER_PROMPT


# Periods that users are counted in.
PERIODS = ("day", "week", "month")
#: Users are dealt to so many parts before they are numbered; each meets in one task.
USER_PARTS = 4096


def _require_period(period: str) -> None:
    if period not in PERIODS:
        raise ValueError(f"Unsupported period: {period}")


def active_users(events: DataFrame, period: str) -> DataFrame:
    """Users per ``day``, ``week`` (from Monday) or ``month``, labelled by its first day."""
    _require_period(period)
    start = F.to_date(F.date_trunc(period, F.col("event_date").cast("timestamp")))
    return (
        events.filter(F.col("user_email").isNotNull())
        .groupBy(start.alias("period_start"))
        .agg(F.countDistinct("user_email").alias("active_users"))
        .orderBy("period_start")
    )


def user_bitmaps(events: DataFrame, parts: int = USER_PARTS) -> DataFrame:
    """(event_date, part, block, users): the users of each day as bits of bitmaps.

    Users are dealt to ``parts`` by hash and numbered inside theirs, in order of their
    e-mail; a block has 32,768 of them. The bitmaps of one result can be put together for any
    set of days, and counted, without seeing a user again.
    """
    pairs = events.filter(F.col("user_email").isNotNull()).select("event_date", "user_email").distinct()
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("user_email"), F.lit(parts)))
    number = F.dense_rank().over(Window.partitionBy("part").orderBy("user_email")).cast("bigint")
    numbered = dealt.select("event_date", "part", number.alias("_number"))
    return numbered.groupBy("event_date", "part", F.bitmap_bucket_number("_number").alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_number")).alias("users")
    )


def active_users_of_periods(events: DataFrame, periods: Sequence[str] = PERIODS) -> DataFrame:
    """Users of every day, week and month at once: (period, period_start, active_users).

    Events are read once; weeks and months are put together from the bitmaps of their days.
    """
    for period in periods:
        _require_period(period)
    day = F.col("event_date")
    starts = [F.struct(F.lit(p).alias("period"), F.to_date(F.date_trunc(p, day.cast("timestamp"))).alias("period_start")) for p in periods]
    spread = user_bitmaps(events).select("part", "block", "users", F.inline(F.array(*starts)))
    whole = spread.groupBy("period", "period_start", "part", "block").agg(F.bitmap_or_agg("users").alias("users"))
    return whole.groupBy("period", "period_start").agg(F.sum(F.bitmap_count("users")).alias("active_users")).orderBy("period", "period_start")


def active_user_rate(events: DataFrame, employees: DataFrame) -> DataFrame:
    """Employees with events among all employees, overall (practice NULL) and by practice."""
    active = events.select(F.col("user_email").alias("email")).distinct().withColumn("is_active", F.lit(1))
    people = employees.select("email", "practice").join(active, "email", "left")
    return (
        people.groupingSets([[], [F.col("practice")]], F.col("practice"))
        .agg(
            F.grouping("practice").alias("overall"),
            F.count("is_active").alias("active_users"),
            F.count(F.lit(1)).alias("employee_count"),
        )
        .select(
            F.when(F.col("overall") == 1, F.lit("(all)")).otherwise(F.col("practice")).alias("practice"),
            "active_users",
            "employee_count",
            ratio(F.col("active_users"), F.col("employee_count")).alias("active_user_rate"),
        )
        .orderBy("practice")
    )


def _depth_measures() -> list[R.Measure]:
    return [
        R.count("event_count"),
        R.count("prompt_count", is_event(USER_PROMPT)),
        R.count("request_count", is_event(API_REQUEST)),
        R.count("tool_result_count", is_event(TOOL_RESULT)),
    ]


def engagement_ratios(
    events: DataFrame, employees: DataFrame, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    """Sessions and prompts per user, requests and tool calls per prompt, depth of sessions."""
    measures = _depth_measures()
    small = R.summarize(events, employees, filters, ["user_email", "session_id"], measures)
    totals = small.agg(
        F.countDistinct("user_email").alias("users"),
        F.countDistinct("session_id").alias("sessions"),
        *[m.again() for m in measures],
    )
    users, sessions, prompts = F.col("users"), F.col("sessions"), F.col("prompt_count")
    requests, tools = F.col("request_count"), F.col("tool_result_count")
    return totals.select(
        ratio(sessions, users).alias("sessions_per_user"),
        ratio(prompts, users).alias("prompts_per_user"),
        ratio(prompts, sessions).alias("prompts_per_session"),
        ratio(requests, prompts).alias("requests_per_prompt"),
        ratio(tools, prompts).alias("tool_calls_per_prompt"),
        ratio(tools, sessions).alias("tool_calls_per_session"),
        ratio(F.col("event_count"), sessions).alias("events_per_session"),
        ratio(prompts, tools).alias("prompt_to_tool_ratio"),
        ratio(prompts, requests).alias("prompt_to_request_ratio"),
    )


def adoption_by(
    events: DataFrame, employees: DataFrame, dimension: str, filters: EventFilters = NO_FILTERS
) -> DataFrame:
    """Users, sessions, events and prompts per value; per employee for employee dimensions."""
    measures = _depth_measures()
    partial = by_dimension(events, employees, dimension, measures, filters, ("user_email", "session_id"))
    out = partial.groupBy(dimension).agg(
        F.countDistinct("user_email").alias("active_users"),
        F.countDistinct("session_id").alias("session_count"),
        *[m.again() for m in measures],
    )
    if dimension in EMPLOYEE_DIMENSIONS:
        staff = employees.groupBy(dimension).agg(F.count(F.lit(1)).alias("employee_count"))
        out = (
            out.join(staff, dimension, "left")
            .withColumn("employee_count", F.coalesce("employee_count", F.lit(0)))
            .withColumn("events_per_employee", ratio(F.col("event_count"), F.col("employee_count")))
            .withColumn("prompts_per_employee", ratio(F.col("prompt_count"), F.col("employee_count")))
        )
    return out.orderBy(F.desc("event_count"), F.asc_nulls_last(dimension))


def adoption_matrix(
    events: DataFrame, employees: DataFrame, dimension: str, *, by: str = "practice"
) -> DataFrame:
    """Events and users per pair of an event column and an employee dimension."""
    if by not in ("level", "location", "practice"):
        raise ValueError(f"Unsupported dimension: {by}")
    small = (
        events.filter(F.col(dimension).isNotNull())
        .groupBy(dimension, "user_email")
        .agg(F.count(F.lit(1)).alias("event_count"))
    )
    return (
        with_employee(small, employees, [by])
        .groupBy(F.coalesce(by, F.lit(UNKNOWN)).alias(by), dimension)
        .agg(F.count("user_email").alias("active_users"), F.sum("event_count").alias("event_count"))
        .orderBy(by, F.desc("event_count"), dimension)
    )
