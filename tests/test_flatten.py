import json

import pytest
from conftest import batch, dicts, event, message

from pyspark.sql import functions as F

from tallyline.operators import flatten
from tallyline.operators.flatten import flatten_batches, parse_batch_lines
from tallyline.schemas import EVENT_COLUMNS
from tallyline.session import prepare


def flat(frame):
    return sorted(dicts(flatten_batches(frame)), key=lambda r: (r["line_number"], r["event_index"] or 0))


def test_valid_batch_of_all_event_kinds(lines):
    names = ["api_request", "tool_result", "tool_decision", "user_prompt", "api_error"]
    rows = flat(lines(batch(*[event(i, event_name=n) for i, n in enumerate(names)], owner="o")))
    assert [r["event_name"] for r in rows] == names
    assert [r["event_index"] for r in rows] == [0, 1, 2, 3, 4]
    assert {r["owner"] for r in rows} == {"o"} and {r["year"] for r in rows} == {"2026"}
    assert not any(r["is_malformed"] for r in rows)
    assert {r["parse_error"] for r in rows} == {None}


def test_flat_columns_are_the_stored_ones_without_derived(lines):
    columns = flatten_batches(lines(batch(event(1)))).columns
    assert set(EVENT_COLUMNS) - set(columns) == {"event_date", "prompt_redacted"}
    assert set(columns) <= set(EVENT_COLUMNS)


@pytest.mark.parametrize("text", ["{not json", "", "   ", '{"logEvents": []} tail', '{"logEvents": []}{}', "[1] ]"])
def test_unreadable_line_is_one_malformed_row(lines, text):
    (row,) = flat(lines(text))
    assert row["is_malformed"] and row["parse_error"] == flatten.LINE_UNREADABLE
    assert row["raw_message"] == text and row["event_index"] is None and row["owner"] is None


@pytest.mark.parametrize("text", ["[1]", "5", '"x"', "null", "true"])
def test_line_that_is_no_object(lines, text):
    (row,) = flat(lines(text))
    assert row["parse_error"] == flatten.LINE_NOT_OBJECT and row["raw_message"] == text


@pytest.mark.parametrize("value", ["none", 5, None, {"a": 1}, ...])
def test_event_list_missing_or_of_another_type(lines, value):
    document = {"owner": "o"} if value is ... else {"owner": "o", "logEvents": value}
    (row,) = flat(lines(json.dumps(document)))
    assert row["parse_error"] == flatten.NO_EVENT_LIST and row["owner"] == "o"
    assert json.loads(row["raw_message"]) == document and row["event_index"] is None


def test_empty_event_list_gives_no_rows(lines):
    assert flat(lines(batch())) == []


def test_bad_events_keep_their_siblings(lines):
    rows = flat(
        lines(
            batch(
                event(0),
                7,
                {"id": "e2", "message": 12},
                {"id": "e3"},
                event(4, text="{broken"),
                event(5, text="[1]"),
                event(6, text='{"a": 1} x'),
                None,
            )
        )
    )
    assert [r["parse_error"] for r in rows] == [
        None,
        flatten.ITEM_NOT_OBJECT,
        flatten.MESSAGE_NOT_TEXT,
        flatten.MESSAGE_NOT_TEXT,
        flatten.MESSAGE_UNREADABLE,
        flatten.MESSAGE_NOT_OBJECT,
        flatten.MESSAGE_UNREADABLE,
        flatten.ITEM_NOT_OBJECT,
    ]
    assert [r["event_id"] for r in rows] == ["e0", None, "e2", "e3", "e4", "e5", "e6", None]
    assert [r["raw_message"] for r in rows[1:6]] == ["7", "12", None, "{broken", "[1]"]
    assert rows[1]["attributes_json"] is None and rows[4]["raw_message_json"] is None


def test_sections_that_are_no_objects_act_as_empty(lines):
    text = json.dumps({"body": "b", "attributes": [1], "scope": "s", "resource": None})
    (row,) = flat(lines(batch(event(0, text=text))))
    assert not row["is_malformed"] and row["event_name"] is None and row["scope_name"] is None
    assert row["attributes_json"] == "{}" and row["resource_json"] == "{}" and row["body"] == "b"
    assert json.loads(row["raw_message_json"]) == json.loads(text)


def test_keys_with_dots_and_kept_sections(lines):
    document = {
        "attributes": {"event.name": "x", "event": {"name": "other"}, "cost_usd": "0.5", "extra": {"a": [1, None]}},
        "resource": {"host.arch": "arm64", "user.practice": "Data"},
        "scope": {"name": "n", "version": "1"},
    }
    (row,) = flat(lines(batch(event(0, text=json.dumps(document)))))
    assert (row["event_name"], row["cost_usd"], row["host_arch"]) == ("x", "0.5", "arm64")
    assert (row["scope_name"], row["scope_version"], row["resource_user_practice"]) == ("n", "1", "Data")
    assert json.loads(row["attributes_json"]) == document["attributes"]
    assert json.loads(row["resource_json"]) == document["resource"]


def test_last_duplicate_key_wins(lines):
    text = '{"attributes": {"event.name": "first", "event.name": "last"}}'
    (row,) = flat(lines(batch(event(0, text=text))))
    assert row["event_name"] == "last"
    text = '{"attributes": {"model": "first"}, "attributes": {"model": "last"}}'
    (row,) = flat(lines(batch(event(0, text=text))))
    assert row["model"] == "last" and json.loads(row["attributes_json"]) == {"model": "last"}


def test_subscription_filters(lines):
    values = [["a", {"b": 1}], "plain", None]
    rows = flat(lines(*[batch(event(i), subscriptionFilters=v) for i, v in enumerate(values)]))
    assert [r["subscription_filters"] for r in rows] == ['["a",{"b":1}]', "plain", None]


def test_parsing_is_planned_once(lines, capsys):
    """Later filters on event fields must not copy the JSON parsing."""
    from tallyline.operators.cleaning import clean_events

    plan = clean_events(flatten_batches(lines(batch(event(1)))))._jdf.queryExecution().executedPlan().toString()
    # A line, a line too large for that, and a message; nothing is parsed again.
    assert plan.count("from_json") == 3 and plan.count("get_json_object") == 0
    assert "PythonUDF" not in plan and "BatchEvalPython" not in plan


def test_not_a_number_and_long_strings_are_read(lines):
    text = '{"attributes": {"event.name": "x", "cost_usd": NaN, "error": "%s"}}' % ("y" * 21_000_000)
    (row,) = flat(lines(batch(event(0, text=text))))
    assert not row["is_malformed"] and row["cost_usd"] == "NaN" and len(row["error"]) == 21_000_000
    kept = json.loads(row["attributes_json"])
    assert kept["error"] == row["error"] and kept["event.name"] == "x" and str(kept["cost_usd"]).lower() == "nan"


def test_documents_too_large_for_one_value_keep_their_events(lines):
    numbers = "[" + "1," * 30_000_000 + "1]"
    rows = flat(
        lines(
            '{"owner": "o", "numbers": %s, "logEvents": [%s, 5]}' % (numbers, json.dumps(event(1))),
            '{"owner": "p", "text": "%s", "logEvents": [%s]}' % ("y" * (130 << 20), json.dumps(event(2))),
        )
    )
    assert [(r["owner"], r["event_id"], r["parse_error"]) for r in rows] == [
        ("o", "e1", None), ("o", None, flatten.ITEM_NOT_OBJECT), ("p", "e2", None),
    ]


def test_line_errors_without_exploding(lines):
    rows = dicts(parse_batch_lines(lines(batch(), "x")).select("line_number", "line_error"))
    assert [r["line_error"] for r in rows] == [None, flatten.LINE_UNREADABLE]
    assert message() in batch(event(1)).encode().decode("unicode_escape")


def test_wide_rows_are_no_single_generated_method(spark, folder):
    frame = spark.range(1).selectExpr(*[f"CAST(id AS STRING) AS c{i}" for i in range(60)])
    frame.write.parquet(f"{folder}/wide")
    wide = prepare(spark).read.schema(frame.schema).parquet(f"{folder}/wide").select(*[F.upper(c).alias(c) for c in frame.columns])
    assert "*(" not in wide._jdf.queryExecution().executedPlan().toString()
    assert "*(" in wide.select("c1")._jdf.queryExecution().executedPlan().toString()
