"""Pairs looked up tree by tree, in tasks."""

import random

from voxelgrain.operators import grid, trees


def test_pairs_of_small_trees_take_few_tables(spark, monkeypatch):
    """Rooting and climbing took some 40 tables, more for deeper trees."""
    r = random.Random(4)
    edges, pairs, expected = [], set(), {}
    for first in range(0, 3000, 60):
        way = [(r.randrange(50), first + i, first + i + 1) for i in range(59)]
        edges += way
        for _ in range(40):
            a, b = r.randrange(60), r.randrange(60)
            pairs.add((first + a, first + b))
            expected[first + a, first + b] = max(way[min(a, b) : max(a, b)], default=None)
        pairs.add((first, first + 60))
        expected[first, first + 60] = None
    tables = []
    real = grid.written
    for module in (grid, trees):
        monkeypatch.setattr(module, "written", lambda df, name: tables.append(name) or real(df, name))
    forest = spark.createDataFrame(edges, "w long, u long, v long")
    got = trees.heaviest_between(spark.createDataFrame(sorted(pairs), "a long, b long"), forest, ("w",)).collect()
    assert {(x.a, x.b): tuple(x.best) if x.best else None for x in got} == expected and len(got) == len(pairs)
    assert len(tables) < 12
    # A tree with more rows than a task takes climbs by joins, beside others that don't.
    edges += [(i * 7919 % 1009, i, i + 1) for i in range(10_000, 11_000)]
    pairs |= {(10_000, 11_000), (10_500, 10_100)}
    expected |= {(10_000, 11_000): max(edges[-1000:]), (10_500, 10_100): max(edges[-900:-500])}
    forest = spark.createDataFrame(edges, "w long, u long, v long")
    got = trees.heaviest_between(spark.createDataFrame(sorted(pairs), "a long, b long"), forest, ("w",), most_rows=500).collect()
    assert {(x.a, x.b): tuple(x.best) if x.best else None for x in got} == expected and len(got) == len(pairs)
