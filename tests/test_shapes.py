"""Shapes whose two largest spreads are equal, and shapes against a solver."""

import random

from voxelgrain.operators import orientation


def test_turned_shapes_have_no_axis(spark):
    """A shape that a quarter turn maps on itself spreads alike both ways; digits lost in a third of an angle gave some an axis."""
    r = random.Random(5)
    rows = []
    for node in range(300):
        half = {(r.randrange(-4, 5), r.randrange(-4, 5)) for _ in range(r.randrange(1, 9))} - {(0, 0)}
        shape = {t for y, x in half for t in ((y, x), (-x, y), (-y, -x), (x, -y))}
        at = (r.randrange(5, 70_000), r.randrange(5, 95))
        rows += [(node, 0, at[0] + y, at[1] + x) for y, x in shape]
    sums = orientation.coordinate_sums(spark.createDataFrame(rows, "node long, z int, y int, x int"), ["node"])
    got = orientation.described(sums, ["node"]).collect()
    assert [s.node for s in got if s.axis != [0.0, 0.0, 0.0]] == []
    assert all(s.coherence < 1e-20 and abs(s.val1 - s.val2) <= 1e-12 * s.val1 and abs(s.val3) < 1e-12 * s.val1 for s in got if s.n > 1)


def test_shapes_against_a_solver(spark):
    import numpy as np

    r = np.random.default_rng(7)
    rows, want = [], {}
    for node in range(80):
        points = np.unique((r.normal(size=(r.integers(1, 40), 3)) * r.choice([1, 4, 9], 3)).astype(int) * (r.random(3) < 0.8), axis=0)
        rows += [(node, *map(int, p + 50)) for p in points]
        cov = np.cov(points.T) / len(points) if len(points) > 1 else np.zeros((3, 3))
        want[node] = cov, np.linalg.eigvalsh(cov)[::-1]
    sums = orientation.coordinate_sums(spark.createDataFrame(rows, "node long, z int, y int, x int"), ["node"])
    for s in orientation.described(sums, ["node"]).collect():
        cov, values = want[s.node]
        scale = max(values[0], 1e-300)
        assert np.allclose([s.val1, s.val2, s.val3], values, atol=1e-7 * scale)
        assert s.val1 + 1e-12 * scale >= s.val2 >= s.val3 - 1e-12 * scale
        if any(s.axis):
            assert abs(np.linalg.norm(s.axis) - 1) < 1e-9
            assert np.allclose(cov @ s.axis, s.val1 * np.array(s.axis), atol=1e-7 * scale)
        else:
            assert values[0] - values[1] <= 1e-8 * scale
