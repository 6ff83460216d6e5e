import pytest
from conftest import dicts
from pyspark.sql import functions as F

from tallyline.operators import rollup
from tallyline.operators.filters import EventFilters
from tallyline.operators.quantiles import exact_percentiles
from tallyline.schemas import EVENT_SCHEMA
from tallyline.plans import adoption, costs, facts, kpis, models, quality, reliability, scorecards, sessions, tools, trends, users
from tallyline.plans.dimensions import by_dimension, value_counts
from tallyline.plans.overview import overview_report

def plan(frame):
    return frame._jdf.queryExecution().optimizedPlan().toString()


@pytest.fixture
def mixed(events):
    return events(
        {"model": "m1", "cost_usd": 1.0, "input_tokens": 5, "cache_read_tokens": 5, "duration_ms": 100},
        {"model": "m2", "cost_usd": 2.0, "event_timestamp": "2026-01-06 10:00:00.500", "duration_ms": 300},
        {"model": None, "cost_usd": None, "user_email": "bob@example.com", "session_id": "s2"},
        {"event_name": "tool_result", "tool_name": "Read", "success": True, "duration_ms": 10},
        {"event_name": "tool_result", "tool_name": "Read", "success": None, "session_id": "s2", "user_email": "bob@example.com"},
        {"event_name": "tool_result", "tool_name": "Bash", "success": False},
        {"event_name": "user_prompt", "user_email": "zoe@example.com", "session_id": "s3", "resource_user_practice": "Ops"},
        {"event_name": "api_error", "user_email": "ANN@example.com", "session_id": "s4", "status_code": "429"},
    )


def test_headline_figures(mixed, employees):
    row = kpis.kpi_summary(mixed, employees).first().asDict()
    assert row == {
        "total_users": 4,
        "total_sessions": 4,
        "total_events": 8,
        "total_cost_usd": 3.0,
        "total_tokens": 10,
        "average_session_duration_ms": 86400500 / 4,
    }
    assert kpis.total_users(mixed).first()[0] == 4 and kpis.total_sessions(mixed).first()[0] == 4


def test_missing_success_counts_as_failure(mixed):
    row = kpis.success_rate(mixed).first()
    assert (row["tool_result_count"], row["successful_tool_results"], row["success_rate"]) == (3, 1, 1 / 3)


def test_no_rows_give_zeros_and_empty_results(events, employees):
    none = events()
    assert dicts(kpis.kpi_summary(none, employees)) == [
        dict.fromkeys(["total_users", "total_sessions", "total_events", "total_cost_usd", "total_tokens", "average_session_duration_ms"], 0)
    ]
    assert dicts(kpis.total_token_usage(none))[0]["total_tokens"] == 0
    assert kpis.total_cost(none).first()[0] == 0 and kpis.average_session_duration(none).first()[0] == 0
    assert dicts(kpis.success_rate(none))[0]["success_rate"] == 0
    assert dicts(kpis.average_tokens_per_request(none))[0]["average_tokens_per_request"] == 0
    options = kpis.filter_options(none, employees).first()
    assert options["practices"] is None and options["models"] is None and options["min_date"] is None
    for part, frame in overview_report(none, employees).items():
        assert frame.count() == (1 if part == "kpi_summary" else 0)
    assert reliability.api_error_rate(none, employees, filters=EventFilters(practice="x")).first()["api_error_rate"] == 0
    assert costs.cost_totals(none, employees).first()["request_count"] == 0
    assert dicts(quality.join_coverage(none, employees))[0]["event_coverage"] == 0


def test_filter_options_lists_practices_in_use(mixed, employees):
    row = kpis.filter_options(mixed, employees).first()
    assert row["practices"] == ["Data", "Web"] and row["models"] == ["m1", "m2"]


def test_three_rules_for_practice(mixed, employees):
    """Filter: employee, then event. Group: then Unknown. User details: employee only."""
    by_practice = {r["practice"]: r["request_count"] for r in dicts(models.cost_per_practice(mixed, employees))}
    assert by_practice == {"Data": 2, "Web": 1}
    everything = by_dimension(mixed, employees, "practice", [rollup.count("n")])
    assert {r["practice"]: r["n"] for r in dicts(everything)} == {"Data": 4, "Web": 2, "Ops": 1, "Unknown": 1}
    ops = EventFilters(practice="Ops")
    assert kpis.kpi_summary(mixed, employees, ops).first()["total_events"] == 1
    (zoe,) = dicts(users.top_active_users(mixed, employees, ops))
    assert zoe["user_email"] == "zoe@example.com" and zoe["practice"] is None
    assert kpis.kpi_summary(mixed, employees, EventFilters(practice="Unknown")).first()["total_events"] == 0


def test_mixed_case_email_does_not_match(mixed, employees):
    assert [r["user_email"] for r in dicts(quality.unmatched_users(mixed, employees))] == ["ANN@example.com", "zoe@example.com"]


def test_session_reading_of_the_model_filter_ignores_other_filters(mixed, employees):
    """Session s1 used m1 on the 5th, so its event of the 6th stays."""
    sixth = EventFilters(model="m1", start_date="2026-01-06")
    assert kpis.kpi_summary(mixed, employees, sixth).first()["total_events"] == 1
    assert dicts(models.requests_per_model(mixed, employees, sixth)) == []
    whole = EventFilters(model="m1")
    assert kpis.kpi_summary(mixed, employees, whole).first()["total_events"] == 4
    assert [r["tool_name"] for r in dicts(users.top_used_tools(mixed, employees, whole))] == ["Bash", "Read"]
    assert "LeftSemi" in plan(kpis.kpi_summary(mixed, employees, whole))


def test_end_date_is_excluded_and_through_includes_the_day(mixed, employees):
    assert kpis.kpi_summary(mixed, employees, EventFilters(end_date="2026-01-06")).first()["total_events"] == 7
    assert kpis.kpi_summary(mixed, employees, EventFilters().through("2026-01-06")).first()["total_events"] == 8
    assert EventFilters().through("2026-12-31").end_date == "2027-01-01"


def test_filtering_by_every_value_adds_up_to_no_filter(mixed, employees):
    whole = kpis.kpi_summary(mixed, employees).first()["total_events"]
    parts = [kpis.kpi_summary(mixed, employees, EventFilters(event_name=n)).first()["total_events"]
             for n in ("api_request", "tool_result", "user_prompt", "api_error")]
    assert sum(parts) == whole
    daily = sum(r["request_count"] for r in dicts(trends.requests_per_day(mixed, employees)))
    practice = sum(r["request_count"] for r in dicts(models.cost_per_practice(mixed, employees)))
    assert daily == practice == 3


def test_employees_are_joined_only_when_needed_and_after_aggregating(mixed, employees):
    assert "Join" not in plan(trends.requests_per_day(mixed, employees))
    assert "Join" not in plan(kpis.kpi_summary(mixed, employees))
    text = plan(trends.requests_per_day(mixed, employees, EventFilters(practice="Data")))
    assert text.index("Join") < text.rindex("Aggregate")
    assert text.count("Aggregate") == 2


def test_top_users_are_cut_before_the_join(mixed, employees):
    frame = users.top_active_users(mixed, employees, limit=2)
    assert [r["event_count"] for r in dicts(frame)] == [4, 2]
    assert "TakeOrderedAndProject" in frame._jdf.queryExecution().executedPlan().toString()


def test_kpi_summary_scans_once(mixed, employees, spark, folder):
    mixed.write.parquet(f"{folder}/t")
    frame = kpis.kpi_summary(spark.read.parquet(f"{folder}/t"), employees)
    assert frame._jdf.queryExecution().executedPlan().toString().count("FileScan") == 1


@pytest.mark.parametrize("limit", [0, -1])
def test_limits(mixed, employees, limit):
    for call in (users.top_active_users, users.top_used_tools):
        with pytest.raises(ValueError, match="positive number of rows"):
            call(mixed, employees, limit=limit)
    with pytest.raises(ValueError):
        sessions.high_cost(mixed, "user_email", limit)


def test_ties_are_broken_by_name(events, employees):
    frame = events(*[{"user_email": f"{n}@x.io", "model": n, "event_id": n} for n in "cab"])
    assert [r["user_email"][0] for r in dicts(users.user_activity_summary(frame, employees))] == ["a", "b", "c"]
    assert [r["model"] for r in dicts(models.requests_per_model(frame, employees))] == ["a", "b", "c"]


def test_percentiles(spark):
    frame = spark.createDataFrame([("a", v) for v in (1, 2, 3)] + [("b", 7), ("b", None), (None, 5), (None, 9000)], "k string, v bigint")
    got = {r["k"]: (r["p"], r["m"]) for r in dicts(exact_percentiles(frame, ["k"], "v", {"p": 0.95, "m": 0.5}))}
    assert got["a"] == pytest.approx((2.9, 2.0)) and got["b"] == (7.0, 7.0) and got[None] == pytest.approx((8550.25, 4502.5))


def test_percentiles_of_a_large_group(spark):
    frame = spark.range(20000).select(F.lit(1).alias("k"), ((F.col("id") * 7919) % 1_000_003 - 300_000).alias("v"))
    row = exact_percentiles(frame, ["k"], "v", {"a": 0.0, "b": 0.25, "c": 0.951, "d": 1.0}).first()
    expected = frame.selectExpr("percentile(v, array(0.0, 0.25, 0.951, 1.0))").first()[0]
    assert [row[n] for n in "abcd"] == pytest.approx(expected)
    overall = exact_percentiles(frame, [], "v", {"m": 0.5}).first()["m"]
    assert overall == pytest.approx(frame.selectExpr("percentile(v, 0.5)").first()[0])


def test_sums_and_percentiles_come_from_one_scan(spark, folder):
    values = [0, -1, 5, 1 << 40, -(1 << 45), (1 << 62), 70_000, 70_000, 65_535, 65_536, -65_536, None]
    rows = [(k, v, i) for k in ("a", None) for i, v in enumerate(values)] + [("empty", None, 4)]
    spark.createDataFrame(rows, "k string, v bigint, i int").write.parquet(f"{folder}/t")
    frame = spark.read.parquet(f"{folder}/t")
    shares = {f"p{n}": n / 10 for n in range(11)}
    got = exact_percentiles(frame, ["k"], "v", shares, {"all": F.lit(1), "i": F.col("i")})
    rows = {r["k"]: r for r in dicts(got)}
    assert rows["a"]["all"] == rows[None]["all"] == 12 and rows["a"]["i"] == 66 and rows["a"]["_count"] == 11
    held = sorted(v for v in values if v is not None)
    assert [rows[None][f"p{n}"] for n in range(11)] == [float(v) for v in held]
    assert (rows["a"]["_least"], rows["a"]["_greatest"], rows["a"]["_sum"]) == (held[0], held[-1], sum(held))
    assert rows["empty"]["p5"] is None and (rows["empty"]["_count"], rows["empty"]["all"]) == (0, 1)
    for report in (tools.tool_reliability, tools.tool_result_sizes, reliability.latency_summary):
        stored = spark.createDataFrame([], EVENT_SCHEMA)
        stored.write.parquet(f"{folder}/{report.__name__}")
        found = report(spark.read.parquet(f"{folder}/{report.__name__}"))
        found.collect()
        plan = found._jdf.queryExecution().executedPlan().toString()
        initial = plan.split("== Initial Plan ==")[-1]
        assert found._jdf.queryExecution().optimizedPlan().toString().count("Relation") >= 1
        assert "hashpartitioning(_k0" in initial and "SinglePartition" not in initial


def test_percentiles_scan_events_once(spark, folder):
    """Both uses of the counted values read one exchange."""
    frame = spark.range(1000).selectExpr("id % 7 AS k", "id * 37 AS v")
    frame.write.parquet(f"{folder}/t")
    found = exact_percentiles(spark.read.parquet(f"{folder}/t"), ["k"], "v", {"m": 0.5}, {"n": F.lit(1)})
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert plan.count("FileScan") == 1 and "ReusedExchange" in plan


def _chains(rows, length):
    """Brute force: per session, in order of time and id."""
    found, by_session = {}, {}
    for row in sorted(rows, key=lambda r: (r["event_timestamp"], r["event_id"])):
        if row["event_name"] == "tool_result" and row["tool_name"]:
            by_session.setdefault(row["session_id"], []).append(row["tool_name"])
    for steps in by_session.values():
        for i in range(len(steps) - length + 1):
            chain = " > ".join(steps[i : i + length])
            found[chain] = found.get(chain, 0) + 1
    return found


@pytest.mark.parametrize("length", [2, 3, 4])
def test_tool_chains_cross_hours(events, length):
    rows = [
        {"event_name": "tool_result", "event_id": f"{i:03}", "tool_name": "ABC"[(i * i) % 3] if i % 11 else None,
         "session_id": f"s{(i // 7) % 2}", "event_timestamp": f"2026-01-05 {(i * 5) // 60:02}:{(i * 5) % 60:02}:00"}
        for i in list(range(60)) + list(range(120, 126)) + [240]
    ]
    frame = events(*rows)
    got = {r["chain"]: r["occurrences"] for r in dicts(tools.tool_chains(frame, length))}
    assert got == _chains(rows, length)


@pytest.mark.parametrize("slices", [1, 7, 40, 200])
def test_tool_chains_over_slices_of_one_hot_hour(spark, events, slices):
    """Two thirds of all results in one hour of one session; slices down to a single row."""
    rows = [
        {"event_name": "tool_result", "event_id": f"{i:03}", "tool_name": "ABCDE"[(i * i * 7) % 5],
         "session_id": "hot" if i % 3 else f"s{i % 4}", "event_timestamp": f"2026-01-05 10:{i // 4 % 60:02}:00"}
        for i in range(150)
    ]
    frame = events(*rows)
    name = "spark.sql.shuffle.partitions"
    before = spark.conf.get(name)
    spark.conf.set(name, str(slices))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for length in (2, 3, 5):
            got = {r["chain"]: r["occurrences"] for r in dicts(tools.tool_chains(frame, length))}
            assert got == _chains(rows, length)
    finally:
        spark.conf.set(name, before)
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_sessions(events):
    frame = events(
        {"user_email": "b", "organization_id": "o2"},
        {"user_email": "b", "organization_id": "o1", "event_timestamp": "2026-01-05 10:00:01.001", "cost_usd": 0.5},
        {"user_email": "a", "event_name": "user_prompt"},
        {"user_email": "a", "event_name": "api_error"},
    )
    (row,) = dicts(sessions.sessions(frame))
    assert (row["user_email"], row["organization_id"]) == ("a", None)
    assert (row["duration_ms"], row["event_count"], row["prompt_count"], row["api_error_count"], row["total_cost_usd"]) == (1001, 4, 1, 1, 0.5)
    (own,) = dicts(sessions.user_sessions(frame, "b"))
    assert (own["organization_id"], own["event_count"]) == ("o1", 2)
    assert [r["event_id"] for r in dicts(sessions.session_timeline(frame, "s1"))] == ["e0", "e2", "e3", "e1"]
    with pytest.raises(ValueError, match="Unsupported entity"):
        sessions.high_cost(frame, "model")


def test_facts(mixed, employees):
    sizes = {name: facts.fact(mixed, name).count() for name in facts.FACTS}
    assert sizes == {"api_requests": 3, "api_errors": 1, "user_prompts": 1, "tool_decisions": 0, "tool_results": 3}
    assert len(facts.fact(mixed, "api_requests").columns) == 14 and len(facts.fact(mixed, "tool_results").columns) == 13
    assert facts.enriched(mixed, employees).count() == 8


def test_scorecards(mixed, employees):
    days = dicts(scorecards.daily_kpis(mixed, employees))
    assert [(d["active_users"], d["session_count"], d["event_count"]) for d in days] == [(4, 4, 7), (1, 1, 1)]
    practices = {r["practice"]: r for r in dicts(scorecards.practice_kpis(mixed, employees))}
    assert practices["Web"]["employee_count"] == 2 and practices["Unknown"]["employee_count"] == 0
    assert practices["Unknown"]["api_error_rate"] == 1.0 and practices["Web"]["success_rate"] == 0.0
    assert [r["model"] for r in dicts(scorecards.model_kpis(mixed, employees))] == ["m1", "m2"]
    assert dicts(scorecards.user_kpis(mixed, employees))[0]["user_email"] == "ann@example.com"


def test_reliability(mixed, employees):
    assert reliability.api_error_rate(mixed, employees).first()["api_error_rate"] == 0.25
    assert dicts(reliability.errors_by_status(mixed)) == [{"status_code": "429", "error_count": 1}]
    row = reliability.error_classes(mixed).first()
    assert (row["rate_limit_count"], row["auth_error_count"], row["other_error_count"]) == (1, 0, 0)
    rows = {r["event_name"]: r for r in dicts(reliability.latency_summary(mixed, slow_ms=200))}
    assert rows["api_request"]["p95_duration_ms"] == pytest.approx(290.0) and rows["api_request"]["slow_rate"] == 0.5


def test_adoption_and_quality(mixed, employees):
    rates = {r["practice"]: (r["active_users"], r["employee_count"]) for r in dicts(adoption.active_user_rate(mixed, employees))}
    assert rates == {"(all)": (2, 3), "Data": (1, 1), "Web": (1, 2)}
    assert [r["email"] for r in dicts(quality.idle_employees(mixed, employees))] == ["cas@example.com"]
    assert dicts(value_counts(mixed, "tool_name"))[0] == {"tool_name": "Read", "event_count": 2}
    assert dicts(quality.join_coverage(mixed, employees))[0]["matched_users"] == 2
    with pytest.raises(ValueError):
        adoption.active_users(mixed, "year")
    with pytest.raises(ValueError, match="Unsupported dimension"):
        costs.cost_breakdown(mixed, employees, "raw_message")


def test_users_of_all_periods_from_one_scan(spark, folder):
    """More users than a block has bits, in few parts; days of several weeks and months, and nulls."""
    rows = spark.range(150_000).selectExpr(
        "if(id % 1000 = 7, null, 'u' || id % 70001) AS user_email", "date_add(date'2026-01-20', int(id % 31)) AS event_date"
    )
    rows.write.parquet(f"{folder}/t")
    frame = spark.read.parquet(f"{folder}/t")
    for parts in (1, 3):
        days = adoption.user_bitmaps(frame, parts).groupBy("event_date").agg(F.sum(F.bitmap_count("users")).alias("n"))
        want = frame.groupBy("event_date").agg(F.countDistinct("user_email").alias("n"))
        assert sorted(map(tuple, days.collect())) == sorted(map(tuple, want.collect()))
    got = adoption.active_users_of_periods(frame)
    found = {(r["period"], r["period_start"]): r["active_users"] for r in got.collect()}
    for period in adoption.PERIODS:
        want = {(period, r["period_start"]): r["active_users"] for r in adoption.active_users(frame, period).collect()}
        assert {k: v for k, v in found.items() if k[0] == period} == want
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].count("FileScan") == 1
    with pytest.raises(ValueError, match="Unsupported period"):
        adoption.active_users_of_periods(frame, ["year"])


def test_no_python_functions_in_any_report(mixed, employees):
    for frame in overview_report(mixed, employees, EventFilters(practice="Data", model="m1")).values():
        assert "Python" not in frame._jdf.queryExecution().executedPlan().toString()
