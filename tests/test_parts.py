"""Many small parts in a task: streamed one after the other, also over the ends of batches."""

from voxelgrain.operators import agglomeration


def test_parts_are_whole_whatever_the_batches(spark):
    rows = spark.range(1000).selectExpr("id % 90 AS part", "id AS x")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = agglomeration.by_part(rows, "part", lambda part, xs: [(part, len(xs), [x for x, in xs] == sorted(x for x, in xs))], "part long, n long, sorted boolean", ("x",)).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted((r.part, r.n, r.sorted) for r in got) == [(p, len(range(p, 1000, 90)), True) for p in range(90)]


def test_no_part(spark):
    assert agglomeration.by_part(spark.range(0).selectExpr("id AS part", "id AS x"), "part", lambda part, xs: [(part,)], "part long").count() == 0
