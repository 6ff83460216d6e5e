"""CSV records whose quoted cells hold line breaks, read in splits of a file.

A line break ends a record unless a quoted cell is open. What a line does to that state is
one of four things, whichever state it begins in: leave it, switch it, open, or close. So
do all lines of a split together, and all splits of a file: the state in which a line
begins is a prefix scan, first over the lines of a split, then over the splits of a file.
From the known states lines are joined to records. Lines of one split meet in one task,
which holds no more than a split; of a file, only three numbers for each split do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: A quoted cell that ends where it should, with the comma before it.
_CLOSED = r'(^|,)"(?:[^"]|"")*+"'
_PLACE = ("source_file", "_split")


def leaves_open(line: Column) -> Column:
    """Whether a line that begins outside of quotes ends in an open quoted cell.

    A quote opens a cell only where the cell begins; elsewhere it is a character.
    """
    return F.contains(line, F.lit('"')) & F.regexp_replace(line, _CLOSED, "$1x").rlike('(^|,)"')


def _scanned(frame: DataFrame, before: Column, after_out: Column, after_in: Column, window) -> DataFrame:
    """The frame with ``_open``: the state before each row of a window, in its order.

    ``before`` is the state before the first row; the other two are a row's state afterwards,
    for a row that begins outside or inside of quotes.
    """
    fixed, switch = after_out == after_in, (after_out & ~after_in).cast("int")
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    counted = frame.withColumns({"_fixed": F.when(fixed, after_out.cast("int")), "_switch": switch})
    counted = counted.withColumn("_switches", F.sum("_switch").over(upto))
    # The state after a row that fixes it, with the switches so far taken off.
    counted = counted.withColumn("_base", (F.col("_fixed") + F.col("_switches")) % 2)
    base = F.coalesce(F.last("_base", ignorenulls=True).over(earlier), before.cast("int"))
    switched = F.coalesce(F.sum("_switch").over(earlier), F.lit(0))
    return counted.withColumn("_open", (base + switched) % 2 == 1).drop("_fixed", "_switch", "_switches", "_base")


def read_records(lines: DataFrame) -> DataFrame:
    """(source_file, _split, _row, first, record) from lines (source_file, _split, _row, value) without their breaks.

    The place is that of a record's first line; ``first`` tells the first record of a file.
    Blank lines outside of quotes are no records. A cell that is still open where its file
    ends is the last one, without the line break at the end.
    """
    value = F.col("value")
    told = lines.withColumns({"_after_out": leaves_open(value), "_after_in": leaves_open(F.concat(F.lit('"'), value))})
    in_split = Window.partitionBy(*_PLACE).orderBy("_row")
    by_file = Window.partitionBy("source_file").orderBy("_split")

    # What a split does: its last line's state afterwards, for either state before its first line.
    scanned = told
    for state, name in ((False, "_from_out"), (True, "_from_in")):
        scanned = _scanned(scanned, F.lit(state), F.col("_after_out"), F.col("_after_in"), in_split).withColumnRenamed("_open", name)
    last = F.struct("_row", "_from_out", "_from_in", "_after_out", "_after_in")
    ends = scanned.select(*_PLACE, last.alias("last")).groupBy(*_PLACE).agg(F.max("last").alias("last"))

    def after(begin: str) -> Column:
        return F.when(F.col(f"last.{begin}"), F.col("last._after_in")).otherwise(F.col("last._after_out"))

    splits = _scanned(ends, F.lit(False), after("_from_out"), after("_from_in"), by_file).select(*_PLACE, F.col("_open").alias("_began_open"))
    states = scanned.join(splits, list(_PLACE)).withColumn("_open", F.when(F.col("_began_open"), F.col("_from_in")).otherwise(F.col("_from_out")))
    states = states.where(F.col("_open") | ~value.isin("", "\r"))
    number = F.sum((~F.col("_open")).cast("int")).over(in_split.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    lines_of = F.array_sort(F.collect_list(F.struct("_row", "value")))
    records = states.withColumn("_number", number).groupBy(*_PLACE, "_number").agg(lines_of.alias("_lines"))
    # Number 0 is the rest of a record that began in an earlier split: the last one with a record.
    owners = records.groupBy(*_PLACE).agg(F.max("_number").alias("_many"))
    own = F.when(F.col("_many") > 0, F.struct(F.col("_split").alias("split"), F.col("_many").alias("number")))
    earlier = by_file.rowsBetween(Window.unboundedPreceding, -1)
    head = F.min(own).over(Window.partitionBy("source_file"))["split"]
    owners = owners.select(*_PLACE, F.last(own, ignorenulls=True).over(earlier).alias("_owner"), head.alias("_head"))
    began = F.when(F.col("_number") > 0, F.struct(F.col("_split").alias("split"), F.col("_number").alias("number"))).otherwise(F.col("_owner"))
    first = (F.col("_split") == F.col("_head")) & (F.col("_number") == 1)
    parts = records.join(owners, list(_PLACE)).select("source_file", began.alias("_began"), first.alias("first"), "_split", "_lines")
    whole = parts.groupBy("source_file", "_began").agg(F.max("first").alias("first"), F.array_sort(F.collect_list(F.struct("_split", "_lines"))).alias("_parts"))
    joined = F.array_join(F.transform(F.flatten(F.transform("_parts", lambda p: p["_lines"])), lambda x: x["value"]), "\n")
    record = F.regexp_replace(joined, "\r$", "")
    row = F.col("_parts")[0]["_lines"][0]["_row"]
    return whole.select("source_file", F.col("_began.split").alias("_split"), row.alias("_row"), "first", record.alias("record"))
