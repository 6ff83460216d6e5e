from pyspark.sql import functions as F

from tallyline.llm.frames import HEAVY, evenly_joined, reliable


def test_rows_of_heavy_keys_are_joined_like_others(spark):
    """A third of all rows under one key, keys with few rows, keys without a counterpart, and nulls."""
    ids = spark.range(6000).selectExpr("id", "if(id % 3 = 0, -1, id % 1500) AS k1", "if(id % 3 = 0, 'hot', string(id % 7)) AS k2", "2 AS held", "3 AS other")
    rows = ids.withColumn("k1", F.when(F.col("id") % 100 != 99, F.col("k1")))
    counted = rows.where("k1 IS NOT NULL AND k1 % 10 <> 1").groupBy("k1", "k2").agg(F.count("*").alias("n"), F.min("id").alias("first"))
    table = reliable(counted.withColumn("text", F.concat_ws("-", "k1", "k2")))
    want = rows.join(table.drop("n"), ["k1", "k2"], "left").select(*rows.columns, "first", "text")
    got = evenly_joined(rows, table, ["k1", "k2"], "n")
    assert got.columns == want.columns
    assert sorted(got.collect(), key=repr) == sorted(want.collect(), key=repr)
    # Only the hot key is heavy: others have less than a thousandth of all rows.
    assert table.where(F.col("n") * HEAVY >= 6000).count() == 1
    assert evenly_joined(rows.where("false"), table.where("false"), ["k1", "k2"], "n").collect() == []
