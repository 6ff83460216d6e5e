import json
import sys
import tempfile
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

from tallyline.operators.storage import align_to_schema  # noqa: E402
from tallyline.schemas import EMPLOYEE_SCHEMA, EVENT_SCHEMA  # noqa: E402
from tallyline.session import build  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = build(
        "tests",
        master="local[4]",
        **{
            "spark.ui.enabled": "false",
            "spark.driver.memory": "4g",
            "spark.sql.shuffle.partitions": "4",
            "spark.sql.maxMetadataStringLength": "2000",
            "spark.checkpoint.dir": tempfile.mkdtemp(prefix="tallyline-tests-"),
        },
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="tallyline-case-")


def message(**attributes):
    """Message text; keyword names use underscores where keys have dots, given by ``KEYS``."""
    keys = {
        "event_timestamp": "event.timestamp",
        "event_name": "event.name",
        "session_id": "session.id",
        "user_email": "user.email",
        "terminal_type": "terminal.type",
    }
    defaults = {
        "event_timestamp": "2026-01-05T10:00:00.000Z",
        "event_name": "api_request",
        "session_id": "s1",
        "user_email": "ann@example.com",
    }
    merged = {k: v for k, v in {**defaults, **attributes}.items() if v is not ...}
    return json.dumps({"body": "b", "attributes": {keys.get(k, k): v for k, v in merged.items()}})


def event(number, text=None, **attributes):
    return {"id": f"e{number}", "timestamp": 1767607200000, "message": text or message(**attributes)}


def batch(*events, **fields):
    return json.dumps({"messageType": "DATA", "year": 2026, "month": 1, "day": 5, "logEvents": list(events), **fields})


@pytest.fixture
def lines(spark):
    """Lines of text as a frame ready to flatten."""

    def build_lines(*texts):
        rows = [("f.jsonl", i + 1, text) for i, text in enumerate(texts)]
        return spark.createDataFrame(rows, "source_file string, line_number int, value string")

    return build_lines


@pytest.fixture
def events(spark):
    """Typed events from partial rows."""

    def build_events(*rows):
        defaults = {
            "event_timestamp": "2026-01-05 10:00:00",
            "event_name": "api_request",
            "session_id": "s1",
            "user_email": "ann@example.com",
        }
        if not rows:
            return spark.createDataFrame([], EVENT_SCHEMA)
        full = [{"event_id": f"e{i}", **defaults, **row} for i, row in enumerate(rows)]
        names = list(dict.fromkeys(k for row in full for k in row))
        kinds = {f.name: f.dataType.simpleString() for f in EVENT_SCHEMA}
        ddl = ", ".join(f"{n} {'string' if kinds[n] in ('timestamp', 'date') else kinds[n]}" for n in names)
        frame = spark.createDataFrame([tuple(row.get(n) for n in names) for row in full], ddl)
        typed = align_to_schema(frame, EVENT_SCHEMA)
        return typed.selectExpr(
            *[c if c != "event_date" else "coalesce(event_date, to_date(event_timestamp)) AS event_date" for c in typed.columns]
        )

    return build_events


@pytest.fixture
def employees(spark):
    rows = [
        ("ann@example.com", "Ann", "Data", "L3", "Poland"),
        ("bob@example.com", "Bob", "Web", "L5", "Canada"),
        ("cas@example.com", "Cas", "Web", "L7", "Canada"),
    ]
    return spark.createDataFrame(rows, EMPLOYEE_SCHEMA)


def dicts(frame):
    return [row.asDict(recursive=True) for row in frame.collect()]
