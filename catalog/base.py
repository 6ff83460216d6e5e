"""Registry of queries over the sample tables and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyline.session import prepare
from tallyline.sources.sample import EVENT_NAMES, EXPRESSIONS, sample_employees, sample_events

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_CASES = " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in EVENT_NAMES.items())
_MAPPED = ",\n  ".join(f"{text} AS {name}" for name, text in EXPRESSIONS.items())

# `t` and `e` are the sample tables as telemetry events and employees.
TABLES_SQL = f"""
WITH named AS (
  SELECT event_id, ts, user_id, value,
         CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k,
         CASE event_type {_CASES} END AS shown
  FROM events
), t AS (
  SELECT
  {_MAPPED},
  ts AS event_timestamp, CAST(ts AS DATE) AS event_date,
  epoch_us(ts) // 1000 + k * 10 AS outer_timestamp_ms,
  event_id AS n, k, user_id AS uid,
  CASE WHEN shown = 'user_prompt' THEN k % 3 <> 2 END AS prompt_redacted
  FROM named
), e AS (
  SELECT 'user' || CAST(c_custkey AS STRING) || '@example.com' AS email, c_name AS full_name,
         c_mktsegment AS practice, 'L' || CAST(c_custkey % 10 + 1 AS STRING) AS level,
         r_name AS location
  FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
  WHERE c_custkey % 10 <> 9
)"""
TOKENS_SQL = (
    "(coalesce(input_tokens, 0) + coalesce(output_tokens, 0)"
    " + coalesce(cache_creation_tokens, 0) + coalesce(cache_read_tokens, 0))"
)


@lru_cache(maxsize=8)
def sample_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Events and employees of a folder, defined once per session (nothing is read yet)."""
    return sample_events(spark, folder), sample_employees(spark, folder)


def comparable(frame: DataFrame) -> DataFrame:
    """Doubles rounded and timestamps without a zone, as the SQL side returns them.

    Sums of doubles differ in their last bits. Rounding to 9 digits first removes that
    noise, so that values half way between two 6-digit numbers go the same way.
    """
    columns = []
    for field in frame.schema:
        column = F.col(field.name)
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            column = F.round(F.round(column, 9), 6)
        elif isinstance(field.dataType, T.TimestampType):
            column = column.cast("timestamp_ntz")
        columns.append(column.alias(field.name))
    return frame.select(*columns)


def register(name: str, build: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    """Add a query over (session, table folder)."""
    if name in QUERIES:
        raise ValueError(f"query {name} is registered twice")
    QUERIES[name] = lambda spark, folder: comparable(build(prepare(spark), folder))
    if sql is not None:
        ORACLES[name] = sql


def report(
    name: str, build: Callable[[DataFrame, DataFrame], DataFrame], select: str, ctes: str = ""
) -> None:
    """Add a query over (events, employees); ``select`` reads `t`, `e` and its own ``ctes``."""
    register(
        name,
        lambda spark, folder: build(*sample_tables(spark, folder)),
        TABLES_SQL + (f", {ctes}" if ctes else "") + "\n" + select,
    )
