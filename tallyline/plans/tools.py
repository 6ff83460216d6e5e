"""How tools are decided on, used and chained."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyline.functions.measures import is_event, ratio
from tallyline.operators.quantiles import COUNT, GREATEST, LEAST, SUM, exact_percentiles
from tallyline.schemas import TOOL_DECISION, TOOL_RESULT


def _results(events: DataFrame) -> DataFrame:
    return events.filter(is_event(TOOL_RESULT) & F.col("tool_name").isNotNull())


def tool_reliability(events: DataFrame) -> DataFrame:
    """Success, failure, mean and median duration per tool."""
    counts = exact_percentiles(
        _results(events),
        ["tool_name"],
        "duration_ms",
        {"median_duration_ms": 0.5},
        {"tool_result_count": F.lit(1), "_ok": F.col("success").cast("int")},
    )
    rate = ratio(F.col("_ok"), F.col("tool_result_count"))
    return counts.select(
        "tool_name",
        "tool_result_count",
        rate.alias("success_rate"),
        (F.lit(1.0) - rate).alias("failure_rate"),
        (F.col(SUM) / F.nullif(F.col(COUNT), F.lit(0))).alias("average_duration_ms"),
        "median_duration_ms",
    ).orderBy(F.desc("tool_result_count"), "tool_name")


def tool_result_sizes(events: DataFrame) -> DataFrame:
    """Distribution of result sizes per tool."""
    results = _results(events).filter(F.col("tool_result_size_bytes").isNotNull())
    shares = {"median": 0.5, "p90": 0.9, "p99": 0.99}
    sizes = exact_percentiles(results, ["tool_name"], "tool_result_size_bytes", shares)
    return sizes.select(
        "tool_name",
        F.col(COUNT).alias("sized_results"),
        F.col(LEAST).alias("smallest"),
        F.col(GREATEST).alias("largest"),
        (F.col(SUM) / F.col(COUNT)).alias("average"),
        *shares,
    ).orderBy("tool_name")


def tool_decision_mix(events: DataFrame) -> DataFrame:
    """Decisions per source and the share each takes within its source."""
    counts = (
        events.filter(is_event(TOOL_DECISION))
        .groupBy("source", "decision")
        .agg(F.count(F.lit(1)).alias("decision_count"))
    )
    whole = F.sum("decision_count").over(Window.partitionBy("source"))
    return counts.withColumn("share", ratio(F.col("decision_count"), whole)).orderBy(
        F.asc_nulls_last("source"), F.desc("decision_count"), "decision"
    )


def tool_chains(events: DataFrame, length: int = 2) -> DataFrame:
    """How often ``length`` tools follow one another in a session, over tool results.

    A session may be huge, so it is never sorted as a whole. Results are dealt by ranges of
    session and time to slices of about equal size, whatever a session or an hour holds,
    and chains are found slice by slice. Where a session goes on in the next slice, the last
    ``length - 1`` results of the one and the first of the other are put together, two of
    these edges for each slice.
    """
    if length < 2:
        raise ValueError("length must be at least 2")
    order = ["event_timestamp", "event_id"]
    calls = _results(events).filter(F.col("session_id").isNotNull()).select("session_id", "tool_name", *order)
    sliced = calls.repartitionByRange("session_id", *order).withColumn("_slice", F.spark_partition_id())
    whole = Window.partitionBy("_slice").orderBy("session_id", *order)
    unbound = (Window.unboundedPreceding, Window.unboundedFollowing)
    placed = sliced.withColumns(
        {
            "_at": F.row_number().over(whole),
            "_many": F.count(F.lit(1)).over(Window.partitionBy("_slice")),
            "_next": F.array(*[F.lead(F.struct("session_id", "tool_name"), i).over(whole) for i in range(1, length)]),
            "_head": F.first("session_id").over(whole.rowsBetween(*unbound)),
            "_tail": F.last("session_id").over(whole.rowsBetween(*unbound)),
        }
    )
    complete = F.forall("_next", lambda x: x.isNotNull() & (x["session_id"] == F.col("session_id")))
    steps = F.concat(F.array("tool_name"), F.transform("_next", lambda x: x["tool_name"]))
    # Only a slice's first and last session go on elsewhere.
    near_start = (F.col("_at") < length) & (F.col("session_id") == F.col("_head"))
    near_end = (F.col("_at") > F.col("_many") - length + 1) & (F.col("session_id") == F.col("_tail"))
    edge = F.struct(*order, "_slice", "_at", "_many", "tool_name")
    none, text = F.lit(None), F.array_join(steps, " > ")
    told = F.array(
        F.when(complete, F.struct(text.alias("chain"), none.cast("string").alias("session"), F.lit(None).alias("edge"))),
        F.when(near_start | near_end, F.struct(none.cast("string").alias("chain"), F.col("session_id").alias("session"), edge.alias("edge"))),
    )
    found = placed.select(F.explode(told).alias("x")).where("x IS NOT NULL").select("x.*")
    counted = found.groupBy("chain", "session").agg(F.count("chain").alias("n"), F.array_sort(F.collect_list("edge")).alias("edges"))

    def crossing(_, at):
        run = F.slice("edges", at + 1, F.lit(length))
        pairs = F.zip_with(F.slice(run, F.lit(1), F.size(run) - 1), F.slice(run, F.lit(2), F.size(run)), _adjacent)
        crosses = run[0]["_slice"] != F.element_at(run, -1)["_slice"]
        return F.when((F.size(run) == length) & crosses & F.forall(pairs, lambda x: x), F.array_join(F.transform(run, lambda x: x["tool_name"]), " > "))

    across = F.transform(F.filter(F.transform("edges", crossing), F.isnotnull), lambda c: F.struct(c.alias("chain"), F.lit(1).cast("long").alias("n")))
    chains = F.when(F.col("chain").isNotNull(), F.array(F.struct("chain", "n"))).otherwise(across)
    return (
        counted.select(F.inline(chains))
        .groupBy("chain")
        .agg(F.sum("n").alias("occurrences"))
        .orderBy(F.desc("occurrences"), "chain")
    )


def _adjacent(a: Column, b: Column) -> Column:
    """Whether nothing of the session lies between two edges that follow one another."""
    inside = (a["_slice"] == b["_slice"]) & (a["_at"] + 1 == b["_at"])
    return inside | ((a["_slice"] < b["_slice"]) & (a["_at"] == a["_many"]) & (b["_at"] == 1))
