"""Reservoirs that rank only likely rows are those over all rows."""

from pyspark.sql import functions as F

from shapeloom.operators import sampling


def test_likely_rows_hold_the_first_of_each_class(spark):
    rows = spark.range(4000).select(F.concat(F.lit("s"), "id").alias("s"), F.explode(F.when(F.col("id") % 900 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array(F.lit("a")))).alias("c"))
    scoped = rows.withColumn("scope", F.when(F.substring("s", 2, 9).cast("int") % 900 == 0, 2).otherwise(1).cast("long"))
    assert sampling.likely(scoped, 7).count() < 1000
    for neighbours in (False, True):
        want, got = (sorted(map(tuple, sampling.reservoir(x, 7, neighbours=neighbours).collect())) for x in (rows, scoped))
        assert want == got and len(got) == 7 + 5
    alike = scoped.limit(0).union(spark.range(3000).select(F.lit("zz"), F.lit("c"), F.lit(1).cast("long")))  # no hash under the limit, or all
    assert sampling.reservoir(alike, 7).count() == 7
