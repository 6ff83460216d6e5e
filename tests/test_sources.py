import os

import pytest
from conftest import batch, dicts, event

from tallyline.operators.cleaning import clean_employees
from tallyline.sources import batches, tables
from tallyline.sources.batches import most_splits, read_lines, read_telemetry_batches, with_position
from tallyline.sources.employees import FILE_ORDER, read_employees_csv


def write(folder, name, text):
    path = os.path.join(folder, name)
    with open(path, "w", newline="") as file:
        file.write(text)
    return path


@pytest.fixture
def split_bytes(spark):
    """Sets the size of splits; afterwards it is as before."""
    name = "spark.sql.files.maxPartitionBytes"
    old = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, old)


def test_line_numbers_over_many_splits(spark, folder, split_bytes):
    for name, count in [("a.jsonl", 997), ("b.jsonl", 1), ("c.jsonl", 2500)]:
        write(folder, name, "".join(f"{name}:{i + 1}:{'x' * (i % 60)}\n" for i in range(count)))
    split_bytes(4096)
    lines = read_lines(spark, folder)
    assert lines.rdd.getNumPartitions() > 5
    rows = lines.collect()
    assert len(rows) == 3498
    for row in rows:
        name, number, _ = row["value"].split(":")
        assert row["source_file"].endswith(name) and row["line_number"] == int(number)


def test_no_line_is_lost_when_splits_change(spark, folder, split_bytes):
    write(folder, "a.jsonl", "".join(f"{i + 1}:{'x' * (i % 60)}\n" for i in range(3000)))
    for before, after in [(4096, 16384), (16384, 4096), (4096, 1 << 27)]:
        split_bytes(before)
        lines = read_lines(spark, folder)
        split_bytes(after)
        rows = lines.collect()
        assert sorted(r["line_number"] for r in rows) == list(range(1, 3001))
        assert all(r["value"].startswith(f"{r['line_number']}:") for r in rows)


def test_text_is_never_exchanged_to_number_lines(spark, folder):
    write(folder, "a.jsonl", "x\n\ny")
    lines = read_lines(spark, folder)
    assert [(r["line_number"], r["value"]) for r in lines.orderBy("line_number").collect()] == [(1, "x"), (2, ""), (3, "y")]
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = read_lines(spark, folder)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert not any("value" in line for line in plan.splitlines() if "Exchange hashpartitioning" in line)


def test_lines_of_many_splits_are_numbered_without_a_broadcast(spark, folder, split_bytes, monkeypatch):
    for name in "abc":
        write(folder, f"{name}.jsonl", "".join(f"{i + 1}:{'x' * (i % 60)}\n" for i in range(700)))
    split_bytes(4096)
    text = spark.read.text(folder)
    assert text.rdd.getNumPartitions() > 10
    splits = with_position(text).select("source_file", "_split").distinct().count()
    assert splits <= most_splits(text) < 3000
    monkeypatch.setattr(batches, "BROADCAST_SPLITS", splits - 1)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = read_lines(spark, folder)
        assert "BroadcastHashJoin" not in lines._jdf.queryExecution().executedPlan().toString()
        assert all(int(r["value"].split(":")[0]) == r["line_number"] for r in lines.collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_read_batches_with_blank_lines_and_crlf(spark, folder):
    path = write(folder, "a.jsonl", batch(event(1)) + "\r\n\n" + batch(event(2), event(3)))
    rows = dicts(read_telemetry_batches(spark, path).orderBy("line_number", "event_index"))
    assert [(r["line_number"], r["event_id"], r["is_malformed"]) for r in rows] == [
        (1, "e1", False), (2, None, True), (3, "e2", False), (3, "e3", False),
    ]


def test_missing_input_fails(spark, folder):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        read_lines(spark, folder + "/none.jsonl")


def test_employee_csv(spark, folder):
    path = write(
        folder,
        "e.csv",
        'email,full_name,practice,level,location\na@x.io,"Ann ""A"", B",Data,L1,Poland\n\nb@x.io,Bob,N/A,L2,null\nA@x.io,"Two\nlines",Web,L3,Canada\n',
    )
    rows = dicts(read_employees_csv(spark, path).drop(*FILE_ORDER))
    assert rows == [
        {"email": "a@x.io", "full_name": 'Ann "A", B', "practice": "Data", "level": "L1", "location": "Poland"},
        {"email": "b@x.io", "full_name": "Bob", "practice": None, "level": "L2", "location": None},
        {"email": "A@x.io", "full_name": "Two\nlines", "practice": "Web", "level": "L3", "location": "Canada"},
    ]
    kept = dicts(clean_employees(read_employees_csv(spark, path)))
    assert [r["level"] for r in kept] == ["L1"]


def test_scans(events, employees):
    frame = events(
        {"event_timestamp": "2026-01-05 00:00:00", "user_email": "ann@example.com"},
        {"event_timestamp": "2026-01-06 00:00:00", "user_email": "bob@example.com"},
        {"event_timestamp": "2026-01-04 23:59:59", "user_email": "zoe@example.com", "resource_user_practice": "Web"},
    )
    got = tables.scan_events(frame, start_date="2026-01-05", end_date="2026-01-06")
    assert [r["event_id"] for r in dicts(got)] == ["e0"]
    assert [r["event_id"] for r in dicts(tables.scan_events(frame, limit=2))] == ["e2", "e0"]
    joined = dicts(tables.scan_events_enriched(frame, employees))
    assert [(r["event_id"], r["practice"]) for r in joined] == [("e2", None), ("e0", "Data"), ("e1", "Web")]
    # The practice condition of this scan looks at employees only.
    only = tables.scan_events_enriched(frame, employees, practice="Web")
    assert [r["event_id"] for r in dicts(only)] == ["e1"]
    assert "LeftOuter" not in only._jdf.queryExecution().optimizedPlan().toString()
    assert tables.scan_employees(employees, practice="Web", location="Canada").count() == 2


@pytest.mark.parametrize("limit", [0, -1])
def test_limit_has_to_be_positive(events, employees, limit):
    with pytest.raises(ValueError, match="positive"):
        tables.scan_events(events({}), limit=limit)
    with pytest.raises(ValueError, match="positive"):
        tables.scan_events_enriched(events({}), employees, limit=limit)


def test_count_rows(events, employees):
    known = {"employees": employees, "telemetry_events": events({}, {})}
    assert tables.count_rows(known, "telemetry_events").first()["row_count"] == 2
    with pytest.raises(ValueError, match="no table 'other'"):
        tables.count_rows(known, "other")
