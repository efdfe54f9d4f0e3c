"""Searches, shapes and drifting precision and recall against plain Python on small fixtures."""

import itertools
import math
import random

import numpy as np

from voxelgrain.operators import agglomeration, contingency, orientation, search
from voxelgrain.sources.volumes import from_arrays


def steps(ndim, connectivity):
    return [s for s in itertools.product((-1, 0, 1), repeat=ndim) if 0 < sum(map(abs, s)) <= connectivity]


def near(at, shape, ss):
    for s in ss:
        q = tuple(a + d for a, d in zip(at, s, strict=True))
        if all(0 <= x < n for x, n in zip(q, shape, strict=True)):
            yield q


def walk(starts, shape, ss, through):
    """{voxel: distance} from one start."""
    seen, queue = {starts: 0}, [starts]
    for p in queue:
        for q in near(p, shape, ss):
            if q not in seen and through(p, q):
                seen[q] = seen[p] + 1
                queue.append(q)
    return seen


def test_undam(spark):
    rng = np.random.default_rng(4)
    a = rng.integers(1, 9, (12, 13)) * (rng.random((12, 13)) < 0.12)
    expected = a.copy()
    labelled = [p for p in np.ndindex(a.shape) if a[p]]
    for p in np.ndindex(a.shape):
        if not a[p]:
            expected[p] = min((max(abs(p[0] - q[0]), abs(p[1] - q[1])), a[q]) for q in labelled)[1]
    out = {r.idx: r.label for r in search.undam(from_arrays(spark, label=a)).collect()}
    assert [out[i] for i in range(a.size)] == expected.ravel().tolist()
    empty = from_arrays(spark, label=np.zeros((2, 3), int))
    assert {r.label for r in search.undam(empty).collect()} == {0}


def test_breadth_first_tells_distances_and_keeps_values(spark):
    rng = np.random.default_rng(9)
    a = rng.integers(0, 2, (9, 11))
    v = from_arrays(spark, v=a)
    starts = [(0, 0), (8, 10), (4, 5)]
    sources = v.where("(y = 0 AND x = 0) OR (y = 8 AND x = 10) OR (y = 4 AND x = 5)").withColumnRenamed("idx", "label")
    expected = {}
    for s in starts:
        for p, d in walk(s, a.shape, steps(2, 1), lambda p, q: a[p] == a[q]).items():
            k = (d, s[0] * 11 + s[1])
            expected[p] = min(expected.get(p, k), k)
    out = search.breadth_first(v, sources, ("y", "x"), 1, ("v",), every=2).collect()
    assert {(r.y, r.x): (r.distance, r.label) for r in out} == expected and len(out) == len(expected)


def test_flood_fill_in_three_axes(spark):
    rng = np.random.default_rng(2)
    a = rng.integers(0, 4, (5, 6, 7))
    starts = [(0, 0, 0), (4, 5, 6), (2, 2, 2), (99, 0, 0)]
    good = {1, 2, 3}
    expected = set()
    for s in starts[:3]:
        if a[s] in good:
            expected |= set(walk(s, a.shape, steps(3, 1), lambda p, q: a[q] in good))
    out = search.flood_fill(from_arrays(spark, label=a), spark.createDataFrame(starts, "z int, y int, x int"), spark.createDataFrame([(g,) for g in good], "g long")).collect()
    assert {(r.z, r.y, r.x) for r in out} == expected and len(out) == len(expected)
    assert search.flood_fill(from_arrays(spark, label=a), spark.createDataFrame([(99, 0, 0)], "z int, y int, x int"), spark.createDataFrame([(1,)], "g long")).count() == 0


def basins_of(a, ss):
    idx = lambda p: int(np.ravel_multi_index(p, a.shape))
    down = {}
    for p in np.ndindex(a.shape):
        q = min(near(p, a.shape, ss), key=lambda q: (a[q], idx(q)))
        if a[q] < a[p]:
            down[p] = q
    way = dict(down)
    for p in np.ndindex(a.shape):
        if p not in down:
            plateau = walk(p, a.shape, ss, lambda x, y: a[x] == a[y] and x not in down)
            exits = [(d, idx(q), q) for q, d in plateau.items() if q in down]
            way[p] = min(exits)[2] if exits else min(plateau, key=idx)
    out = []
    for p in np.ndindex(a.shape):
        while way[p] != p:
            p = way[p]
        out.append(idx(p))
    return out


def test_basins(spark):
    rng = np.random.default_rng(11)
    for shape, levels, axes, connectivity in (((14, 15), 4, ("y", "x"), 1), ((4, 5, 6), 5, ("z", "y", "x"), 2)):
        a = rng.integers(0, levels, shape)
        out = {r.idx: r.basin for r in search.basins(from_arrays(spark, cents=a), axes=axes, connectivity=connectivity).collect()}
        assert [out[i] for i in range(a.size)] == basins_of(a, steps(len(shape), connectivity))


def test_wiggle_room(spark):
    rng = np.random.default_rng(6)
    s, t = rng.integers(0, 6, (8, 9)), (rng.random((8, 9)) < 0.15).astype(int)
    grow = lambda a: np.array([max(a[q] for q in np.ndindex(a.shape) if abs(p[0] - q[0]) + abs(p[1] - q[1]) <= 2) for p in np.ndindex(a.shape)]).reshape(a.shape)
    sd, td = grow(s), grow(t)
    out = {r.threshold: (r.precision, r.recall) for r in contingency.wiggle_room(from_arrays(spark, s=s, t=t), "s", "t", 2).collect()}
    assert out == {k: (td[s >= k].sum() / (s >= k).sum(), t[sd >= k].sum() / t.sum()) for k in np.unique(s)}
    none = contingency.wiggle_room(from_arrays(spark, s=s, t=t * 0), "s", "t", 1).collect()
    assert {r.recall for r in none} == {None} and {r.precision for r in none} == {0.0}


def test_shapes_in_three_axes(spark):
    rng = random.Random(8)
    groups = {1: [(rng.randrange(30), rng.randrange(9), rng.randrange(5)) for _ in range(40)], 2: [(1_000_000 + i, 2 * i, 5 - i) for i in range(6)], 3: [(4, 5, 6)], 4: list(itertools.product((0, 1), repeat=3)), 5: [(i, 7, 3) for i in range(9)]}
    rows = [(k, *p) for k, ps in groups.items() for p in ps]
    voxels = spark.createDataFrame(rows, "node long, z int, y int, x int")
    half = voxels.where("z % 2 = 0"), voxels.where("z % 2 <> 0")
    sums = orientation.merge_sums(orientation.coordinate_sums(half[0], ["node"]).union(orientation.coordinate_sums(half[1], ["node"])), ["node"])
    shapes = orientation.described(sums, ["node"])
    out = {r.node: r for r in shapes.collect()}
    axis = {}
    for k, ps in groups.items():
        p = np.array(ps, float)
        m = np.cov(p.T) / len(p) if len(p) > 1 else np.zeros((3, 3))
        val, vec = np.linalg.eigh(m)
        assert np.allclose([out[k].val3, out[k].val2, out[k].val1], val, atol=1e-7 * max(val.max(), 1)) and np.allclose(out[k].centre, p.mean(0))
        axis[k] = vec[:, 2] if val[2] - val[1] > 1e-9 * val[2] else np.zeros(3)
        assert math.isclose(abs(np.dot(out[k].axis, axis[k])), np.dot(axis[k], axis[k]), abs_tol=1e-7)
        top = val[2] + val[1]
        assert math.isclose(out[k].coherence, ((val[2] - val[1]) / top) ** 2 if top > 0 else 0.0, abs_tol=1e-6)
    angle = lambda a, b: math.acos(min(1, abs(np.dot(a, b))))
    line = np.mean(groups[1], axis=0) - np.mean(groups[5], axis=0)
    line /= np.linalg.norm(line)
    r = orientation.angles(spark.createDataFrame([(1, 5)], "u long, v long"), shapes).first()
    to_line = sorted((angle(axis[1], line), angle(axis[5], line)))
    assert np.allclose([r.between, r.least, r.most, r["mean"]], [angle(axis[1], axis[5]), *to_line, sum(to_line) / 2], atol=1e-5)


def test_first_common_merge_and_undoing_one(spark):
    r = random.Random(1)
    edges = sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(25), r.randrange(25)) for _ in range(60)) if a != b})
    rows = [(u, v, r.randrange(1, 5), r.randrange(1, 40)) for u, v in edges]
    table = spark.createDataFrame(rows, "u long, v long, n long, total long")
    nodes = spark.range(25).toDF("node")
    log = agglomeration.written(agglomeration.history(table, nodes, 14.0), "history")
    merges = sorted((m.weight, m.left, m.right) for m in log.collect())
    expected, part = {}, {i: {i} for i in range(25)}
    for w, a, b in merges:
        p, q = part[a], part[b]
        for x, y in itertools.product(p, q):
            expected[x, y] = expected[y, x] = (w, a, b)
        for x in p | q:
            part[x] = p | q
    pairs = spark.createDataFrame(list(itertools.product(range(25), repeat=2)), "a long, b long")
    out = {(x.a, x.b): x for x in agglomeration.joined_by(log, pairs).collect()}
    assert len(out) == 625
    assert {k: (x.weight, x.left, x.right) for k, x in out.items() if x.weight is not None} == expected
    w, a, b = merges[-1]
    fewer = agglomeration.without_merges(log, spark.createDataFrame([(a, b)], "left long, right long"))
    cut = {x.node: x.segment for x in agglomeration.cut_history(fewer, nodes).collect()}
    whole = {x.node: x.segment for x in agglomeration.cut_history(log, nodes).collect()}
    assert cut[a] != cut[b] and whole[a] == whole[b] and fewer.count() == len(merges) - 1
    apart = [(x, y) for x, y in itertools.combinations(range(25), 2) if (x * y) % 11 == 3]
    cut = {x.node: x.segment for x in agglomeration.separate(log, nodes, spark.createDataFrame([*apart, (4, 4)], "a long, b long")).collect()}
    gone = {expected[p] for p in apart if p in expected}
    part = {i: {i} for i in range(25)}
    for m in merges:
        if m not in gone:
            for x in (both := part[m[1]] | part[m[2]]):
                part[x] = both
    assert gone and cut == {i: min(p) for i, p in part.items()} and all(cut[x] != cut[y] for x, y in apart)
