"""All blocks against all blocks: no plan may send them through the driver."""

from pyspark.sql import functions as F

from voxelgrain.plans import segmentation


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_no_broadcast_of_all_blocks(spark):
    c = spark.range(100).selectExpr("id AS block", "array(CAST(id AS INT) * 10, 0, 0) AS lo", "array(CAST(id AS INT) * 10 + 9, 9, 9) AS hi")
    got = segmentation.adjacent_blocks(c)
    assert "Broadcast" not in _plan(got)
    assert sorted(map(tuple, got.collect())) == [(i, i + 1, 0) for i in range(99)]
    points = spark.range(9).select((F.col("id") % 3).alias("region"), "id", *[F.lit(0).alias(a) for a in "zy"], F.col("id").cast("int").alias("x"))
    assert "Broadcast" not in _plan(segmentation.near_points(points, 2.0))
