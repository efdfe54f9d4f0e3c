from pyspark.sql import functions as F

from voxelgrain.operators import features, rag


def worked_out(spark, column):
    """How many sums over arrays a row of (h, g) pays for the column, those inside of other ones counted once."""
    rows = spark.createDataFrame([([1, 2], [2, 1])], "h array<bigint>, g array<bigint>")
    plan = rows.select(column.alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    return plan.count("aggregate(")


def test_what_histograms_share_is_worked_out_once(spark):
    assert worked_out(spark, features.percentiles(F.col("h"), (0.1, 0.5, 0.9), 0, 1, 2)) == 1
    assert worked_out(spark, features.shares(F.col("h"))) == 1
    apart = rag.js_divergence(features.shares(F.col("h")), features.shares(F.col("g")))
    assert worked_out(spark, apart) == 4


def test_percentiles_of_odd_histograms(spark):
    rows = spark.createDataFrame([(0, [0, 0, 0, 0]), (1, [4, 0, 0, 4]), (2, [0, 0, 0, 1])], "k long, h array<bigint>")
    got = {r.k: r.p for r in rows.select("k", features.percentiles(F.col("h"), (0.25, 0.5, 1.0), 0, 4, 4).alias("p")).collect()}
    assert got == {0: [0.0, 0.0, 0.0], 1: [0.5, 1.0, 4.0], 2: [3.25, 3.5, 4.0]}


def test_bins_and_moments_of_one_pass(spark):
    rows = spark.createDataFrame([(1, 0.0), (1, 1.0), (1, 2.0), (1, None), (1, float("nan")), (2, 5.0)], "k long, p double")
    got = {r.k: r for r in features.described(rows.where("p IS NULL OR NOT isnan(p)"), ["k"], "p", 2, 0, 1, (0.5,), 2).collect()}
    assert got[1].h == [1, 1] and got[2].h == [0, 0]
    assert got[2].features == [1.0, 5.0, 0.0, 0.0, 0.0, 0.0]
