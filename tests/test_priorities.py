"""Priorities from lists, probabilities and oriented channels on small fixtures."""

import math

import pytest

from voxelgrain.operators import priorities, rag
from voxelgrain.sources import volumes


def test_ordered(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (1, 4)], "u long, v long")
    listed = spark.createDataFrame([(0, 3, 2), (1, 1, 2), (2, 4, 1), (3, 2, 1), (4, 8, 9)], "i long, u long, v long")
    out = {(r.u, r.v): r.weight for r in priorities.ordered(edges, listed, ["i"]).collect()}
    assert out == {(2, 3): 0.0, (1, 2): 0.6, (1, 4): 0.4, (3, 4): math.inf}
    none = priorities.ordered(edges, listed.limit(0), ["i"]).collect()
    assert len(none) == 4 and {r.weight for r in none} == {math.inf}


def test_expected_change(spark):
    edges = spark.createDataFrame([(1, 2, 0.25), (2, 3, None)], "u long, v long, p double")
    nodes = spark.createDataFrame([(1, 4), (2, 12), (3, 16)], "node long, size long")
    out = {(r.u, r.v): r.weight for r in priorities.expected_change(edges, nodes, "p", "rand", 2.0, 1.0).collect()}
    assert math.isclose(out[1, 2], (0.25 * 2 - 0.75) * 4 * 12 / (32 * 31 / 2)) and out[2, 3] is None
    vi = -(4 / 32 * math.log2(4 / 32) + 12 / 32 * math.log2(12 / 32) - 16 / 32 * math.log2(16 / 32))
    assert math.isclose(priorities.expected_change(edges, nodes).where("u = 1").first().weight, (0.25 - 0.75) * vi)


def test_oriented_channels(spark):
    v = spark.createDataFrame([(0, 5, 9, 1, 0.0), (1, 5, 9, 1, 1.7), (2, 5, 9, 1, 7.0), (3, None, 9, 1, None)], "idx long, a long, b long, c long, angle double")
    out = {r.idx: (r.oriented, r.strongest) for r in volumes.oriented(v, ["a", "b", "c"], [True, False, True], "angle").collect()}
    assert out == {0: (5, 5), 1: (1, 5), 2: (None, 5), 3: (None, 1)}
    with pytest.raises(ValueError):
        volumes.oriented(v, ["a"], [False], "angle")


def test_scaled(spark):
    v = spark.createDataFrame([(0, 10), (1, 30), (2, 20), (3, None)], "idx long, x long")
    assert {r.idx: r.x for r in volumes.scaled(v, "x").where("x IS NOT NULL").collect()} == {0: 0.0, 1: 1.0, 2: 0.5}
    assert {r.x for r in volumes.scaled(v.where("idx = 0"), "x").collect()} == {0.0}
    assert volumes.scaled(v.limit(0), "x").count() == 0


def test_painting_and_real_edges(spark):
    v = spark.createDataFrame([(0, 1), (1, 1), (2, 2), (3, 3)], "idx long, label long")
    seg = spark.createDataFrame([(1, 1), (2, 1)], "node long, segment long")
    assert {r.idx: r.segment for r in rag.build_volume(v, seg).collect()} == {0: 1, 1: 1, 2: 1, 3: 0}
    assert {r.segment for r in rag.build_volume(v, seg, seg.limit(0)).collect()} == {0}
    boundary = spark.createDataFrame([(1, 2, 1), (1, 2, 2), (2, 3, 2), (2, 3, 3)], "u long, v long, idx long")
    weights = spark.createDataFrame([(1, 2, 0.5), (2, 3, 0.25)], "u long, v long, weight double")
    assert {r.idx: r.weight for r in rag.boundary_map(v, boundary, weights).collect()} == {0: 0.0, 1: 0.5, 2: 0.5, 3: 0.25}
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 9)], "u long, v long")
    assert [tuple(r) for r in rag.real_edges(edges, spark.createDataFrame([(0,), (9,)], "node long")).collect()] == [(1, 2)]
