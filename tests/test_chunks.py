"""Connected parts and ways, worked out a chunk at a time, against plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import grid, search


def parts(nodes, links):
    top = {n: n for n in nodes}

    def find(x):
        while top[x] != x:
            top[x] = top[top[x]]
            x = top[x]
        return x

    for u, v in links:
        if u in top and v in top:
            a, b = find(u), find(v)
            top[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def _graphs():
    r = random.Random(3)
    names = list(range(3000))
    r.shuffle(names)
    yield "chain", range(3000), list(zip(range(2999), range(1, 3000), strict=True))
    yield "mixed chain", range(3000), list(zip(names, names[1:], strict=False))
    yield "hub", range(-1, 2000), [(1999, i) for i in range(1999)]
    yield "sparse", range(3000), [(r.randrange(3000), r.randrange(3000)) for _ in range(2500)]
    yield "others", range(100), [(1, 2), (5, 1000), (1000, 6), (7, 7)]
    yield "none", range(5), []


@pytest.mark.parametrize("name,nodes,links", list(_graphs()), ids=[g[0] for g in _graphs()])
def test_parts_by_chunks(spark, name, nodes, links):
    table = spark.createDataFrame([(n,) for n in nodes], "node long")
    got = grid.components(table, spark.createDataFrame(links, "u long, v long"), chunk=64)
    assert {r.node: r.component for r in got.collect()} == parts(nodes, links)


def test_a_winding_part_takes_few_jobs(spark):
    """It took a round for each few steps where the least label had to come along the edges."""
    n = 4000
    row = lambda i: (i // 2) if i % 2 == 0 else n - 1 - i // 2  # noqa: E731  far and near numbers by turns
    links = [(row(i), row(i + 1)) for i in range(n - 1)]
    tables = []
    real = grid.written
    grid.written = lambda df, name: tables.append(name) or real(df, name)
    try:
        got = grid.components(spark.range(n).toDF("node"), spark.createDataFrame(links, "u long, v long"), within=True)
        assert got.select(F.max("component")).first()[0] == 0
    finally:
        grid.written = real
    assert len(tables) < 12


@pytest.mark.parametrize("seed", [None, 1])
def test_ways_by_chunks(spark, seed):
    n = 2000
    names = list(range(-5, n - 5))
    if seed is not None:
        random.Random(seed).shuffle(names)
    ways = {names[i]: names[i - 1] if i % 700 else names[i] for i in range(n)}

    def end(x):
        while ways[x] != x:
            x = ways[x]
        return x

    got = search.followed(spark.createDataFrame(list(ways.items()), "idx long, to long"), chunk=100)
    assert sorted(map(tuple, got.collect())) == sorted((x, end(x)) for x in ways)
