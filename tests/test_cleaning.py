from datetime import date, datetime

import pytest
from conftest import batch, dicts, event
from pyspark.sql import functions as F

from tallyline.functions.parsing import snake_case
from tallyline.operators import cleaning
from tallyline.operators.flatten import flatten_batches


def cleaned(lines, *cases):
    frame = cleaning.clean_events(flatten_batches(lines(batch(*[event(i, **c) for i, c in enumerate(cases)]))))
    return {r["event_id"]: r for r in dicts(frame)}


def test_numbers(lines):
    texts = [" 12 ", "12.7", "12.5", "13.5", "abc", "1d", "nan", "1e3", "+5", "-3", "", "0x1", "12 "]
    rows = cleaned(lines, *[{"duration_ms": t, "cost_usd": t} for t in texts])
    got = [rows[f"e{i}"]["duration_ms"] for i in range(len(texts))]
    assert got == [12, 13, 12, 14, None, None, None, 1000, 5, -3, None, None, 12]
    assert [rows[f"e{i}"]["cost_usd"] for i in range(4)] == [12.0, 12.7, 12.5, 13.5]
    assert rows["e5"]["cost_usd"] is None and rows["e6"]["cost_usd"] is None


def test_numbers_given_as_json_numbers(lines):
    rows = cleaned(lines, {"duration_ms": 12, "cost_usd": 0.25, "input_tokens": 9007199254740993})
    assert (rows["e0"]["duration_ms"], rows["e0"]["cost_usd"]) == (12, 0.25)
    assert rows["e0"]["input_tokens"] == 9007199254740993 and rows["e0"]["outer_timestamp_ms"] == 1767607200000


def test_whole_number_out_of_range_is_null(lines):
    texts = ["99999999999999999999", "1e30", "-1e400", "inf", "9223372036854775807", "9223372036854775808"]
    rows = cleaned(lines, *[{"duration_ms": t, "attempt": t} for t in texts])
    assert [rows[f"e{i}"]["duration_ms"] for i in range(6)] == [None, None, None, None, 2**63 - 1, None]
    assert {r["attempt"] for r in rows.values()} == {None}


def test_flags(lines):
    texts = ["True", " false ", "yes", "1", "", True, None]
    rows = cleaned(lines, *[{"success": t} for t in texts])
    assert [rows[f"e{i}"]["success"] for i in range(7)] == [True, False, None, None, None, True, None]


def test_strings(lines):
    rows = cleaned(lines, {"model": "\t m1 　\n", "tool_name": " \n ", "error": "a b"})
    assert (rows["e0"]["model"], rows["e0"]["tool_name"], rows["e0"]["error"]) == ("m1", None, "a b")


def test_prompt_flag(lines):
    rows = cleaned(lines, {"prompt": " <REDACTED> "}, {"prompt": "hello"}, {})
    assert [rows[f"e{i}"]["prompt_redacted"] for i in range(3)] == [True, False, None]


def test_timestamps(lines):
    texts = [
        "2026-01-05T10:00:00Z",
        "2026-01-05T10:00:00.123456Z",
        "2026-01-05T01:30:00+02:00",
        "2026-01-05 10:00:00",
        "",
        "junk",
        "10:00",
        "2026",
        None,
        "20260105T100000Z",
        "20260105T0130+0200",
        "20260105T100000.5",
        "20260105",
        "20261305T100000Z",
    ]
    rows = cleaned(lines, *[{"event_timestamp": t} for t in texts])
    assert sorted(rows) == ["e0", "e1", "e10", "e11", "e2", "e3", "e9"]
    assert rows["e9"]["event_timestamp"] == datetime(2026, 1, 5, 10)
    assert rows["e10"]["event_timestamp"] == datetime(2026, 1, 4, 23, 30)
    assert rows["e11"]["event_timestamp"] == datetime(2026, 1, 5, 10, 0, 0, 500000)
    assert rows["e1"]["event_timestamp"] == datetime(2026, 1, 5, 10, 0, 0, 123456)
    assert rows["e2"]["event_timestamp"] == datetime(2026, 1, 4, 23, 30)
    assert rows["e2"]["event_date"] == date(2026, 1, 4)


def test_rows_missing_required_values_are_dropped_but_blanks_stay(lines):
    rows = cleaned(lines, {"event_name": ...}, {"event_name": " "}, {"user_email": ...})
    assert sorted(rows) == ["e1", "e2"]
    assert rows["e1"]["event_name"] is None and rows["e2"]["user_email"] is None


def test_blank_event_id_stays_for_validation(lines):
    frame = cleaning.clean_events(flatten_batches(lines(batch({**event(0), "id": " "}, {**event(1), "id": None}))))
    assert [r["event_id"] for r in dicts(frame)] == [None]


def test_unmarked_rows_are_not_malformed(spark):
    frame = spark.createDataFrame([(1, None), (2, True), (3, False)], "n int, is_malformed boolean")
    assert [r["n"] for r in dicts(cleaning.drop_malformed(frame))] == [1, 3]
    assert cleaning.drop_malformed(frame.drop("is_malformed")).count() == 3


def test_steps_skip_columns_that_are_not_there(spark):
    frame = spark.createDataFrame([("1",)], "EventId string")
    assert dicts(cleaning.clean_events(frame)) == [{"event_id": "1"}]


@pytest.mark.parametrize(
    "name, expected",
    [("Full Name", "full_name"), ("fullName", "full_name"), ("__a--b__", "a_b"), ("HTTPCode", "httpcode"), ("x2Y", "x2_y")],
)
def test_snake_case(name, expected):
    assert snake_case(name) == expected


def test_columns_that_collide_are_an_error(spark):
    with pytest.raises(ValueError, match="full_name"):
        cleaning.standardize_column_names(spark.createDataFrame([(1, 2)], "fullName int, full_name int"))


def test_employees_first_row_of_each_email(spark):
    rows = [
        (" Ann@Example.com ", "Ann", "Data", "L1", "Poland"),
        ("ann@example.com", "Other", "Data", "L2", "Poland"),
        ("bob@example.com", None, "Web", "L3", "Canada"),
        ("BOB@example.com", "Bob", " Web\t", "L4", "Canada"),
    ]
    frame = spark.createDataFrame(rows, "Email string, fullName string, practice string, level string, location string").coalesce(1)
    got = {r["email"]: r for r in dicts(cleaning.clean_employees(frame))}
    assert sorted(got) == ["ann@example.com", "bob@example.com"]
    assert got["ann@example.com"]["level"] == "L1"
    assert (got["bob@example.com"]["level"], got["bob@example.com"]["practice"]) == ("L4", "Web")


def test_first_per_key_has_no_window(spark):
    frame = spark.range(100).select((F.col("id") % 3).alias("k"), "id")
    out = cleaning.first_per_key(frame, "k", ["id"])
    assert sorted((r["k"], r["id"]) for r in dicts(out)) == [(0, 0), (1, 1), (2, 2)]
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString()
