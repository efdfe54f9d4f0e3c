"""Rounds of least edges that start in chunks of a few edges each, against edges taken one at a time."""

import random

import pytest
from pyspark.sql import functions as F
from test_landscape import heights, one_at_a_time
from test_trees import kruskal

from voxelgrain.operators import chunks, landscape, trees


def _graph(kind, seed):
    """(height, low, u, v) of a graph full of ties, and seeds."""
    r = random.Random(seed)
    if kind == "grid":
        pairs = [(i, j) for i in range(600) for j in (i + 1, i + 20) if j < 600 and (j % 20 or j == i + 20)]
    elif kind == "hub":
        pairs = [(min(i, 250), max(i, 250)) for i in range(500) if i != 250] + [(i, i + 1) for i in range(0, 499, 3)]
    else:
        pairs = sorted({tuple(sorted(r.sample(range(400), 2))) for _ in range(700)})
    edges = [(r.randint(1, 5), r.randint(0, 1), u, v) for u, v in pairs]
    nodes = sorted({n for e in edges for n in e[2:]})
    return edges, {n: i % 7 for i, n in enumerate(r.sample(nodes, {"grid": 12, "hub": 3, "mixed": 5}[kind]))}


@pytest.mark.parametrize("kind", ["grid", "hub", "mixed"])
@pytest.mark.parametrize("chunk", [40, 10_000])
def test_claimed_in_chunks(spark, kind, chunk):
    edges, seeds = _graph(kind, 3)
    table = spark.createDataFrame([(u, v, h, low) for h, low, u, v in edges], "u long, v long, height int, low int")
    out = landscape.claimed(table, spark.createDataFrame(list(seeds.items()), "node long, label long"), chunk=chunk).collect()
    label, height = one_at_a_time(set(edges), seeds), heights([(h, u, v) for h, _, u, v in edges], seeds)
    nodes = {n for e in edges for n in e[2:]}
    assert len(out) == len(nodes)
    assert {r.node: (r.label, r.height) for r in out} == {n: (label.get(n), height.get(n)) for n in nodes}


@pytest.mark.parametrize("kind", ["grid", "hub", "mixed"])
@pytest.mark.parametrize("chunk", [40, 10_000])
def test_forest_in_chunks(spark, kind, chunk):
    edges = [(h, u - 100, v - 100) for h, _, u, v in _graph(kind, 4)[0]]
    out = trees.spanning_forest(spark.createDataFrame(edges, "w int, u long, v long"), ("w",), chunk=chunk).collect()
    assert sorted((r.w, r.u, r.v) for r in out) == kruskal(edges)


def test_little_goes_on_beside_what_chunks_share(spark):
    edges = [(u, v, str(h)) for h, _, u, v in _graph("grid", 5)[0]]
    live = spark.createDataFrame(edges, "a long, b long, h string").select("a", "b", F.struct(F.col("h").cast("int").alias("h"), F.col("a").alias("u"), F.col("b").alias("v")).alias("e"))
    _, rest, taken = chunks.settled(live, False, 200)
    parts = rest.where("a <> b").select(F.explode(F.array("a", "b"))).distinct().count()
    assert 1 < parts < 100
    assert taken.distinct().count() == 599 - (parts - 1)
