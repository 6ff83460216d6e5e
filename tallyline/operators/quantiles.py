"""Exact interpolated percentiles, counts and sums of groups, from one scan."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Values are looked up digit by digit, each of so many bits.
DIGIT = 16
#: With so many digits no list is longer than 2^DIGIT for values below 2^(DIGIT * DIGITS); above,
#: the uppermost list is longer.
DIGITS = 3

#: What is known of the values of a group besides its percentiles.
COUNT, SUM, LEAST, GREATEST = "_count", "_sum", "_least", "_greatest"


def exact_percentiles(
    frame: DataFrame, keys: list[str], value: str, shares: dict[str, float], measures: dict[str, Column] | None = None
) -> DataFrame:
    """Percentiles of a whole-number column per key group, as columns named by ``shares``.

    The percentile lies at position ``share * (n - 1)`` of the sorted values that are not
    NULL, linearly interpolated. ``measures`` are whole numbers to be summed over all rows of
    a group. Beside them stand the values' COUNT, SUM, LEAST and GREATEST.

    Values are counted first (map-side combine). From the counts a tree is built from the
    leaves: a node stands for all values that agree in their upper digits and lists its
    children with their counts. Its root is the group's row, with the sums. Positions are
    then followed downwards, one digit after another, by joins on group and node, so that
    no list, window or task has all values of a group. The leaves are shuffled once, and
    both ways use them.
    """
    measures = measures or {}
    names = [f"_k{i}" for i in range(len(keys))]
    sums = [F.sum(F.coalesce(m, F.lit(0)).cast("long")) for m in measures.values()]
    # One list of numbers, so that both uses of the leaves have the same columns.
    numbers = F.array(F.count("_value"), *sums).alias("_m")
    rows = frame.select("*", F.col(value).cast("long").alias("_value"))
    leaves = rows.groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names)], "_value").agg(numbers)
    leaves = leaves.withColumn("_node", F.shiftright("_value", DIGIT)).repartition(*names, "_node")
    here = F.col("_value")
    totals = [F.min(here), F.max(here), F.sum(here * F.col("_m")[0]), *[F.sum(F.col("_m")[i]) for i in range(1 + len(measures))]]
    child = F.when(here.isNotNull(), F.struct(here.alias("id"), F.col("_m")[0].alias("rows")))
    nodes = [leaves.groupBy(*names, "_node").agg(F.array_sort(F.collect_list(child)).alias("_children"), F.array(*totals).alias("_t"))]
    for level in range(1, DIGITS):
        root = level == DIGITS - 1
        above = [] if root else [F.shiftright("_node", DIGIT).alias("_node")]
        child = F.when(F.col("_node").isNotNull(), F.struct(F.col("_node").alias("id"), F.col("_t")[3].alias("rows")))
        sums = [F.min(F.col("_t")[0]), F.max(F.col("_t")[1]), *[F.sum(F.col("_t")[i]) for i in range(2, 4 + len(measures))]]
        nodes.append(nodes[-1].groupBy(*names, *above).agg(F.array_sort(F.collect_list(child)).alias("_children"), F.array(*sums).alias("_t")))

    count = F.col("_t")[3]
    wanted = []
    for at, share in enumerate(shares.values()):
        rank = F.lit(share) * (count - 1)
        for high, position in enumerate((F.floor(rank), F.ceil(rank))):
            wanted.append(F.struct(F.lit(2 * at + high).alias("number"), F.when(count > 0, position).alias("position")))
    found = nodes[-1].select(*names, "_t", "_children", F.inline(F.array(*wanted)))
    for below in reversed(nodes[:-1]):
        found = _followed(found).alias("f")
        same = [F.col(f"f.{n}").eqNullSafe(F.col(f"n.{n}")) for n in names]
        # Null-safe, so that no condition on nodes keeps the two uses of the leaves apart.
        same.append(F.col("f._id").eqNullSafe(F.col("n._node")))
        joined = found.join(below.alias("n"), reduce(and_, same), "left")
        found = joined.select(*[F.col(f"f.{n}").alias(n) for n in names], "f._t", "n._children", "number", "position")
    found = _followed(found).groupBy(*names, "_t").agg(
        *[F.max(F.when(F.col("number") == i, F.col("_id"))).alias(f"_p{i}") for i in range(2 * len(shares))]
    )
    marks = []
    for at, (name, share) in enumerate(shares.items()):
        rank, low, high = F.lit(share) * (count - 1), F.col(f"_p{2 * at}"), F.col(f"_p{2 * at + 1}")
        marks.append((low + (high - low) * (rank - F.floor(rank))).alias(name))
    known = [F.col("_t")[i].alias(n) for i, n in enumerate((LEAST, GREATEST, SUM, COUNT, *measures))]
    return found.select(*[F.col(n).alias(k) for k, n in zip(keys, names)], *marks, *known)


def _followed(found: DataFrame) -> DataFrame:
    """The child (``_id``) that holds a position, and the position among that child's values."""
    begin = F.struct(F.lit(0).cast("long").alias("before"), F.lit(None).cast("long").alias("id"), F.lit(0).cast("long").alias("start"))

    def step(so_far: Column, child: Column) -> Column:
        holds = (so_far["before"] <= F.col("position")) & (F.col("position") < so_far["before"] + child["rows"])
        return F.struct(
            (so_far["before"] + child["rows"]).alias("before"),
            F.when(holds, child["id"]).otherwise(so_far["id"]).alias("id"),
            F.when(holds, so_far["before"]).otherwise(so_far["start"]).alias("start"),
        )

    told = found.withColumn("_at", F.aggregate("_children", begin, step))
    return told.select(*[c for c in found.columns if c not in ("_children", "position")], F.col("_at.id").alias("_id"), (F.col("position") - F.col("_at.start")).alias("position"))
