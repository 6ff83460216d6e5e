import json
import os
from datetime import date

import pytest
from conftest import batch, dicts, event
from pyspark.sql import functions as F

from tallyline.operators import storage
from tallyline.operators.storage import ConstraintError, load_table, save_employees, save_events
from tallyline.operators.validation import ValidationError, validate_employees, validate_events
from tallyline.pipeline import open_tables, run_pipeline, stored_rejects
from tallyline.plans.kpis import total_events
from tallyline.schemas import EMPLOYEE_COLUMNS, EVENT_COLUMNS, EVENT_SCHEMA
from tallyline.streaming.incremental import Loaded, incremental_load, loaded_files


def ids(spark, root):
    return sorted(r["event_id"] for r in load_table(spark, root, "telemetry_events").collect())


def test_one_event_with_text_columns_only(spark, folder):
    """Few columns, all strings: the rest is NULL and texts are cast to the stored types."""
    frame = spark.createDataFrame(
        [("1", "2026-01-01 10:00:00", "2026-01-01", "api_request", "session-1", "test@example.com")],
        "event_id string, event_timestamp string, event_date string, event_name string, session_id string, user_email string",
    )
    assert save_events(frame, folder) == 1
    stored = load_table(spark, folder, "telemetry_events")
    assert stored.columns == EVENT_COLUMNS and len(stored.columns) == 61
    assert total_events(stored).first()["total_events"] == 1
    assert stored.first()["event_date"] == date(2026, 1, 1)


def test_one_employee(spark, folder):
    row = ("test@example.com", "Test User", "AI", "Junior", "Ukraine")
    assert save_employees(spark.createDataFrame([row], EMPLOYEE_COLUMNS), folder) == 1
    assert load_table(spark, folder, "employees").count() == 1


def test_replace_append_and_empty_replace(spark, folder, events):
    assert load_table(spark, folder, "telemetry_events").count() == 0
    save_events(events({"event_id": "a"}), folder)
    assert save_events(events({"event_id": "b"}), folder, replace=False) == 1
    assert ids(spark, folder) == ["a", "b"]
    assert save_events(events(), folder) == 0
    assert ids(spark, folder) == ["a", "b"]
    save_events(events({"event_id": "c"}), folder)
    assert ids(spark, folder) == ["c"]


def test_replaced_loads_are_removed_on_request(spark, folder, events):
    for name in ("a", "b"):
        save_events(events({"event_id": name}), folder)
    assert storage.remove_unlisted_loads(spark, folder, "telemetry_events") == 1
    assert storage.remove_unlisted_loads(spark, folder, "employees") == 0
    assert ids(spark, folder) == ["b"]


def test_table_can_be_read_while_it_is_replaced_from_itself(spark, folder, events):
    save_events(events({"event_id": "a"}, {"event_id": "b"}), folder)
    stored = load_table(spark, folder, "telemetry_events")
    save_events(stored.filter("event_id = 'a'"), folder)
    assert ids(spark, folder) == ["a"] and stored.count() == 2


def test_duplicate_key_publishes_nothing(spark, folder, events):
    save_events(events({"event_id": "a"}), folder)
    with pytest.raises(ConstraintError, match="not unique"):
        save_events(events({"event_id": "b"}, {"event_id": "b"}), folder)
    with pytest.raises(ConstraintError, match="not unique"):
        save_events(events({"event_id": "c"}, {"event_id": "a"}), folder, replace=False)
    assert ids(spark, folder) == ["a"]
    assert len([n for n in os.listdir(f"{folder}/telemetry_events") if n.startswith("load=")]) == 1


def test_first_of_duplicates_is_kept(spark, folder, events):
    place = {"source_file": "f", "event_index": 0}
    save_events(events({"event_id": "a", "model": "old"}), folder)
    frame = events(
        {"event_id": "b", "line_number": 2, "model": "second", **place},
        {"event_id": "b", "line_number": 1, "model": "first", **place},
        {"event_id": "a", "line_number": 3, "model": "new", **place},
        {"event_id": "c", "line_number": 4, **place},
        {"event_id": "d", "line_number": 5, **place},
        {"event_id": "d", "line_number": 5, **place},
    )
    assert save_events(frame, folder, replace=False, on_duplicate="first") == 3
    rows = {r["event_id"]: r["model"] for r in load_table(spark, folder, "telemetry_events").collect()}
    assert rows == {"a": "old", "b": "first", "c": None, "d": None}
    left_out = storage.recorded_repeats(spark, folder).orderBy("event_id").collect()
    assert [(r["event_id"], r["line_number"], r["left_out"]) for r in left_out] == [("a", 3, 1), ("b", 2, 1), ("d", 5, 1)]


def test_null_in_required_column_fails(spark, folder, events):
    with pytest.raises(ConstraintError, match="user_email=1, session_id=2"):
        save_events(events({"user_email": None, "session_id": None}, {"session_id": None}), folder)
    assert ids(spark, folder) == []


def test_day_that_contradicts_the_time_fails(folder, events):
    with pytest.raises(ConstraintError, match="event_date"):
        save_events(events({"event_date": "2026-02-01"}), folder)


def test_stored_days_are_skipped_by_date_filters(spark, folder, events):
    from tallyline.operators.filters import EventFilters

    save_events(events(*[{"event_timestamp": f"2026-01-0{d} 12:00:00"} for d in range(1, 8)]), folder)
    stored = load_table(spark, folder, "telemetry_events")
    picked = EventFilters(start_date="2026-01-03", end_date="2026-01-05", event_name="api_request").on_events(stored)
    assert picked.count() == 2
    plan = picked._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters" in plan and "event_date" in plan.split("PartitionFilters")[1][:300]
    assert "EqualTo(event_name,api_request)" in plan


def test_alignment(spark):
    frame = spark.createDataFrame([(12.5, "x", ["a"], "7")], "duration_ms double, extra string, resource_json array<string>, attempt string")
    row = storage.align_to_schema(frame, EVENT_SCHEMA).first()
    assert (row["duration_ms"], row["resource_json"], row["attempt"], row["event_id"]) == (12, '["a"]', 7, None)


def test_serialize_json(spark):
    frame = spark.createDataFrame([({"a": 1}, "text")], "m map<string,int>, s string").withColumn("v", F.parse_json(F.lit("[1]")))
    out = frame.select(*[storage.serialize_json(F.col(c), frame.schema[c].dataType).alias(c) for c in frame.columns]).first()
    assert (json.loads(out["m"]), out["s"], out["v"]) == ({"a": 1}, "text", "[1]")


def test_everything_wrong_is_told_at_once(events, employees):
    validate_events(events({}))
    validate_employees(employees)
    cases = [
        (validate_events, events(), "telemetry_events: no rows$"),
        (validate_events, events({}).drop("event_id", "session_id"), "column not there: event_id; column not there: session_id$"),
        (validate_events, events({}, {"user_email": None}), r"NULL in user_email \(1 rows\)$"),
        (validate_events, events({}).withColumn("cost_usd", F.lit("1")), "no number column: cost_usd$"),
        (validate_events, events({}).withColumn("event_timestamp", F.lit("1")), "no time column: event_timestamp$"),
        (validate_events, events({"event_name": None}).withColumn("success", F.lit(1)), r"no flag column: success; NULL in event_name \(1 rows\)$"),
        (validate_employees, employees.unionByName(employees), r"employees: repeated key email \(3 rows\)$"),
    ]
    for validate, frame, told in cases:
        with pytest.raises(ValidationError, match=told):
            validate(frame)
    assert issubclass(ValidationError, ValueError)


def write_inputs(folder, *lines):
    os.makedirs(f"{folder}/in")
    with open(f"{folder}/in/a.jsonl", "w") as file:
        file.write("\n".join(lines) + "\n")
    with open(f"{folder}/e.csv", "w") as file:
        file.write("email,full_name,practice,level,location\nANN@example.com,Ann,Data,L1,Poland\n")


def test_pipeline(spark, folder):
    write_inputs(folder, batch(event(1), event(2, duration_ms="12.5")), "broken", batch(event(3, event_name=...)))
    counts = run_pipeline(spark, f"{folder}/out", f"{folder}/in", f"{folder}/e.csv")
    assert counts == {"employees": 1, "telemetry_events": 2}
    events, employees = open_tables(spark, f"{folder}/out")
    assert sorted(r["duration_ms"] or 0 for r in dicts(events)) == [0, 12]
    assert employees.first()["email"] == "ann@example.com"


@pytest.mark.parametrize("bad", [{"user_email": ...}, {"session_id": "  "}])
def test_pipeline_with_invalid_events_stores_nothing(spark, folder, bad):
    write_inputs(folder, batch(event(1), event(2, **bad)))
    with pytest.raises(ValidationError, match="NULL in"):
        run_pipeline(spark, f"{folder}/out", f"{folder}/in", f"{folder}/e.csv")
    events, employees = open_tables(spark, f"{folder}/out")
    assert events.count() == 0 and employees.count() == 0


def test_pipeline_whose_employees_can_not_be_read_leaves_nothing(spark, folder):
    write_inputs(folder, batch(event(1)))
    with open(f"{folder}/e.csv", "w") as file:
        file.write("email,full_name\nann@example.com,Ann\n")
    with pytest.raises(ValidationError, match="column not there: level"):
        run_pipeline(spark, f"{folder}/out", f"{folder}/in", f"{folder}/e.csv")
    assert not os.path.exists(f"{folder}/out/telemetry_events") or os.listdir(f"{folder}/out/telemetry_events") == []


def test_pipeline_with_duplicate_ids_keeps_employees_only(spark, folder):
    write_inputs(folder, batch(event(1), event(1)))
    with pytest.raises(ConstraintError):
        run_pipeline(spark, f"{folder}/out", f"{folder}/in", f"{folder}/e.csv")
    events, employees = open_tables(spark, f"{folder}/out")
    assert events.count() == 0 and employees.count() == 1
    assert run_pipeline(spark, f"{folder}/out", f"{folder}/in", f"{folder}/e.csv", on_duplicate="first")["telemetry_events"] == 1


def test_incremental_load(spark, folder):
    write_inputs(folder, batch(event(1), event(2)), "broken")
    args = (spark, f"{folder}/in", f"{folder}/out")
    assert incremental_load(*args) == Loaded(1, 2)
    assert ids(spark, f"{folder}/out") == ["e1", "e2"]
    with open(f"{folder}/in/b.jsonl", "w") as file:
        file.write(batch(event(2), event(3), event(4, user_email=" ")) + "\n")
    assert incremental_load(*args) == Loaded(1, 1)
    assert incremental_load(*args) == Loaded(0, 0)
    assert ids(spark, f"{folder}/out") == ["e1", "e2", "e3"]
    rejects = dicts(spark.read.parquet(f"{folder}/out/rejects").orderBy("batch"))
    assert [(r["batch"], r["line_number"], r["category"]) for r in rejects] == [(0, 2, "top_level_json"), (1, 1, "missing_required")]


def test_incremental_load_of_old_files_and_bad_values(spark, folder):
    """Files far older than others are loaded too, and a number out of range stops nothing."""
    write_inputs(folder, batch(event(1)))
    for days, number in ((6, 2), (8, 3), (4000, 4)):
        path = f"{folder}/in/{number}.jsonl"
        with open(path, "w") as file:
            file.write(batch(event(number, duration_ms="1e30", success="perhaps")) + "\n")
        then = os.stat(path).st_mtime - days * 86400
        os.utime(path, (then, then))
    assert incremental_load(spark, f"{folder}/in", f"{folder}/out", files_per_batch=1) == Loaded(4, 4)
    assert ids(spark, f"{folder}/out") == ["e1", "e2", "e3", "e4"]
    path = f"{folder}/in/5.jsonl"
    with open(path, "w") as file:
        file.write(batch(event(5)) + "\n")
    os.utime(path, (1_000_000_000, 1_000_000_000))
    incremental_load(spark, f"{folder}/in", f"{folder}/out")
    assert ids(spark, f"{folder}/out") == ["e1", "e2", "e3", "e4", "e5"]
    assert not [n for n in os.listdir(f"{folder}/out") if n.startswith("_flat")]
    batches = {os.path.basename(r["path"]): r["batch"] for r in loaded_files(spark, f"{folder}/out").collect()}
    assert batches == {"4.jsonl": 0, "3.jsonl": 1, "2.jsonl": 2, "a.jsonl": 3, "5.jsonl": 4}


def test_incremental_batch_repeated_after_failure(spark, folder):
    """A batch that never reached the ledger is repeated; stored events are left out by their id."""
    write_inputs(folder, batch(event(1)), "broken")
    incremental_load(spark, f"{folder}/in", f"{folder}/out")
    storage.remove(spark, f"{folder}/out/files")
    assert incremental_load(spark, f"{folder}/in", f"{folder}/out") == Loaded(1, 0)
    assert ids(spark, f"{folder}/out") == ["e1"]
    assert stored_rejects(spark, f"{folder}/out").count() == 1


def test_incremental_load_of_changed_files_odd_names_and_two_roots(spark, folder):
    write_inputs(folder, batch(event(1)))
    os.rename(f"{folder}/in/a.jsonl", f"{folder}/in/a [1],{{x}}*.jsonl")
    for root in ("one", "two"):
        assert incremental_load(spark, f"{folder}/in", f"{folder}/{root}") == Loaded(1, 1)
    with open(f"{folder}/in/a [1],{{x}}*.jsonl", "a") as file:
        file.write(batch(event(2)) + "\n")
    assert incremental_load(spark, f"{folder}/in", f"{folder}/one") == Loaded(1, 1)
    assert ids(spark, f"{folder}/one") == ["e1", "e2"] and ids(spark, f"{folder}/two") == ["e1"]
    assert loaded_files(spark, f"{folder}/one").count() == 2
    with pytest.raises(ValueError, match="positive"):
        incremental_load(spark, f"{folder}/in", f"{folder}/one", files_per_batch=0)


def test_pipeline_stores_rejects(spark, folder):
    write_inputs(folder, batch(event(1), event(2, event_name=...)), "broken", batch(event(3, event_timestamp="soon")))
    assert stored_rejects(spark, f"{folder}/out").count() == 0
    run_pipeline(spark, f"{folder}/out", f"{folder}/in", f"{folder}/e.csv")
    rejects = dicts(stored_rejects(spark, f"{folder}/out").orderBy("line_number"))
    assert [(r["line_number"], r["event_index"], r["category"]) for r in rejects] == [
        (1, 1, "missing_required"), (2, None, "top_level_json"), (3, 0, "type_conversion"),
    ]
    assert rejects[1]["raw_text"] == "broken" and '"session.id":"s1"' in rejects[0]["raw_text"].replace(" ", "")
    assert not [n for n in os.listdir(f"{folder}/out") if n.startswith("_flat")]


def test_appends_read_keys_only_of_loads_that_may_hold_them(spark, folder, events):
    for load in range(4):
        save_events(events(*[{"event_id": f"k{load}{i:03}"} for i in range(50)]), folder, replace=False)
    table = "telemetry_events"
    loads = storage.published_loads(spark, folder, table)

    def asked(*names):
        staged = storage.stage(events(*[{"event_id": n} for n in names]), table, folder)
        held, keys = storage.loads_with_keys(staged, loads, storage._write_index(staged))
        found = [loads.index(x) for x in held], sorted(r["event_id"] for r in keys.collect())
        staged.discard()
        return found

    assert asked("a", "z")[0] == []  # inside all ranges, in no index
    assert asked("k1500", "k1", "k2049") == ([2], ["k2049"])
    assert asked("k0000", "k3049", "k") == ([0, 3], ["k0000", "k3049"])
    # A table from before there were indexes: every load may hold any key.
    storage.remove(spark, f"{folder}/{table}/_ranges")
    assert asked("x")[0] == [0, 1, 2, 3]
    with pytest.raises(ConstraintError, match="not unique"):
        save_events(events({"event_id": "k1001"}), folder, replace=False)
    assert save_events(events({"event_id": "x"}), folder, replace=False) == 1
    assert len(ids(spark, folder)) == 201


def test_a_repeated_id_writes_one_small_list(spark, folder, events):
    rows = [{"event_id": f"e{i}", "source_file": "f", "line_number": i, "event_index": 0} for i in range(200)]
    rows.append({**rows[7], "line_number": 300})
    assert save_events(events(*rows), folder, on_duplicate="first") == 200
    (load,) = storage.published_loads(spark, folder, "telemetry_events")
    table = f"{folder}/telemetry_events"
    assert len([n for n in os.listdir(table) if n.startswith("load=")]) == 1
    assert spark.read.parquet(f"{table}/{load.folder}").count() == 201
    assert spark.read.parquet(f"{table}/_hidden/{load.hidden}").count() == 1
    assert [r["line_number"] for r in storage.recorded_repeats(spark, folder).collect()] == [300]
    # A load of known ids only is no load; hidden rows are no keys of a later one.
    assert save_events(events(*rows[:3]), folder, replace=False, on_duplicate="first") == 0
    assert save_events(events(rows[7], {"event_id": "new"}), folder, replace=False, on_duplicate="first") == 1
    assert len(ids(spark, folder)) == 201
    assert save_events(load_table(spark, folder, "telemetry_events"), folder) == 201
    assert storage.remove_unlisted_loads(spark, folder, "telemetry_events") == 2
    assert os.listdir(f"{table}/_hidden") == [] and len(os.listdir(f"{table}/_keys")) == 1
    assert len(ids(spark, folder)) == 201
