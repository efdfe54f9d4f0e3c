"""Floods and reconstructions against plain Python on small volumes with few levels, so that many edges tie."""

import heapq
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.operators import landscape
from voxelgrain.sources.volumes import from_arrays


def near(p, shape, connectivity=1):
    for s in itertools.product((-1, 0, 1), repeat=len(shape)):
        q = tuple(a + d for a, d in zip(p, s, strict=True))
        if 0 < sum(map(abs, s)) <= connectivity and all(0 <= x < n for x, n in zip(q, shape, strict=True)):
            yield q


def sunk(marker, mask, connectivity=1):
    """Erosion by neighbour minima over the mask until nothing changes."""
    out = np.maximum(marker, mask)
    while True:
        new = out.copy()
        for p in np.ndindex(mask.shape):
            new[p] = max(mask[p], min([out[p], *(out[q] for q in near(p, mask.shape, connectivity))]))
        if (new == out).all():
            return out
        out = new


def one_at_a_time(edges, seeds):
    """node: label, edges (order..., u, v) taken in order unless both ends have a label."""
    group = {n: {n} for e in edges for n in e[-2:]} | {n: {n} for n in seeds}
    label = dict(seeds)
    for *_, u, v in sorted(edges):
        a, b = group[u], group[v]
        if a is not b and not (u in label and v in label):
            a |= b
            has = label.get(u, label.get(v))
            for n in a:
                group[n] = a
                if has is not None:
                    label[n] = has
    return label


def heights(edges, seeds):
    """node: the least height by which a seed is reached, seeds left out."""
    adj = {}
    for h, u, v in edges:
        adj.setdefault(u, []).append((h, v))
        adj.setdefault(v, []).append((h, u))
    best, queue = {}, [(-1, s) for s in seeds]
    while queue:
        h, n = heapq.heappop(queue)
        if n not in best:
            best[n] = h
            for w, m in adj.get(n, []):
                heapq.heappush(queue, (max(h, w), m))
    return {n: h for n, h in best.items() if n not in seeds}


def test_claimed_equals_edges_taken_one_at_a_time(spark):
    """Many graphs at once, set apart by ranges of their nodes; some parts hold no seed."""
    rng = random.Random(5)
    edges, seeds = set(), {}
    for g in range(60):
        n = rng.randint(2, 14)
        for _ in range(rng.randint(1, 24)):
            u, v = rng.sample(range(n), 2)
            edges.add((rng.randint(1, 4), rng.randint(1, 2), g * 100 + min(u, v), g * 100 + max(u, v)))
        for s in rng.sample(range(n), rng.randint(0, 3) if n > 3 else 1):
            seeds[g * 100 + s] = g * 100 + rng.randint(0, 2)
    table = spark.createDataFrame([(u, v, h, low) for h, low, u, v in edges], "u long, v long, height int, low int")
    marks = spark.createDataFrame(list(seeds.items()), "node long, label long")
    out = landscape.claimed(table, marks).collect()
    label, height = one_at_a_time(edges, seeds), heights([(h, u, v) for h, _, u, v in edges], seeds)
    nodes = {n for e in edges for n in e[2:]} | set(seeds)
    assert len(out) == len(nodes)
    assert {r.node: r.label for r in out} == {n: label.get(n) for n in nodes}
    assert {r.node: r.height for r in out} == {n: height.get(n) for n in nodes}


def test_claimed_of_a_chain_and_a_hub(spark):
    chain = spark.range(3000).select("id", (F.col("id") + 1).alias("v"), F.hash("id").alias("height"), F.lit(0).alias("low")).withColumnRenamed("id", "u")
    hub = spark.range(3000).select(F.lit(10000).cast("long").alias("u"), (F.col("id") + 10001).alias("v"), F.hash("id").alias("height"), F.lit(0).alias("low"))
    seeds = spark.createDataFrame([(0, 1), (3000, 2), (10000, 3)], "node long, label long")
    out = landscape.claimed(chain.union(hub), seeds).collect()
    assert sum(r.label == 3 for r in out) == 3001
    sides = [r.label for r in sorted(out, key=lambda r: r.node) if r.node <= 3000]
    top = max(chain.collect(), key=lambda r: (r.height, r.u))
    assert sides == [1] * (top.u + 1) + [2] * (3000 - top.u)


def test_claimed_without_edges_or_seeds(spark):
    none = spark.createDataFrame([], "u long, v long, height int, low int")
    marks = spark.createDataFrame([(4, 7), (4, 6)], "node long, label long")
    assert [tuple(r) for r in landscape.claimed(none, marks).collect()] == [(4, 6, None)]
    some = spark.createDataFrame([(1, 2, 3, 3)], none.schema)
    assert {tuple(r) for r in landscape.claimed(some, marks.limit(0)).collect()} == {(1, None, None), (2, None, None)}
    assert landscape.claimed(none, marks.limit(0)).count() == 0


@pytest.mark.parametrize("connectivity", [1, 2])
def test_reconstruction_both_ways(spark, connectivity):
    rng = np.random.default_rng(3)
    mask, marker = rng.integers(0, 6, (9, 11)), rng.integers(2, 9, (9, 11))
    v = from_arrays(spark, mask=mask, marker=marker)
    got = {r.idx: r.value for r in landscape.reconstruct_down(v, "marker", "mask", connectivity=connectivity).collect()}
    assert [got[i] for i in range(mask.size)] == sunk(marker, mask, connectivity).ravel().tolist()
    up = {r.idx: r.value for r in landscape.reconstruct(v, "marker", "mask", connectivity=connectivity).collect()}
    assert [up[i] for i in range(mask.size)] == (-sunk(-marker, -mask, connectivity)).ravel().tolist()


def test_reconstruction_with_nulls(spark):
    rows = [(0, 0, 0, 0, 1, None), (1, 0, 0, 1, None, 5), (2, 0, 0, 2, 2, 7), (3, 0, 0, 3, 4, None)]
    v = spark.createDataFrame(rows, "idx long, z int, y int, x int, mask int, marker int")
    got = {r.idx: r.value for r in landscape.reconstruct_down(v, "marker", "mask").collect()}
    assert got == {0: None, 2: 7, 3: 7}
    assert landscape.reconstruct_down(v.limit(0), "marker", "mask").count() == 0


def test_hminima_and_imposed_minima(spark):
    rng = np.random.default_rng(8)
    a = rng.integers(0, 9, (3, 6, 7))
    v = from_arrays(spark, cents=a)
    axes = ("z", "y", "x")
    got = {r.idx: r.value for r in landscape.hminima(v, "cents", 3, axes=axes).collect()}
    assert [got[i] for i in range(a.size)] == sunk(a + 3, a).ravel().tolist()
    chosen = np.zeros(a.shape, bool)
    chosen.ravel()[[5, 77]] = True
    got = {r.idx: r.value for r in landscape.impose_minima(v, "cents", F.col("idx").isin(5, 77), axes=axes).collect()}
    assert [got[i] for i in range(a.size)] == sunk(np.where(chosen, a, a.max()), a).ravel().tolist()
    none = landscape.impose_minima(v, "cents", F.lit(False), axes=axes).select("value").distinct().collect()
    assert [r.value for r in none] == [a.max()]


def test_regional_minima(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 4, (10, 10))
    expected = {}
    for p in np.ndindex(a.shape):
        seen, queue = {p}, [p]
        for q in queue:
            for r in near(q, a.shape):
                if a[r] == a[p] and r not in seen:
                    seen.add(r)
                    queue.append(r)
        low = any(a[r] < a[p] for q in seen for r in near(q, a.shape))
        expected[p[0] * 10 + p[1]] = None if low else min(q[0] * 10 + q[1] for q in seen)
    out = landscape.regional_minima(from_arrays(spark, height=a), "height").collect()  # a name of its own tables
    assert {r.idx: r.minimum for r in out} == expected


def test_flood_equals_edges_taken_one_at_a_time(spark):
    rng = np.random.default_rng(6)
    a = rng.integers(0, 5, (4, 6, 6))
    v = from_arrays(spark, cents=a)
    seeds = {0: 10, 80: 11, 143: 12, 81: 11}
    at = {p: i for i, p in enumerate(np.ndindex(a.shape))}
    edges = [(max(a[p], a[q]), min(a[p], a[q]), at[p], at[q]) for p in at for q in near(p, a.shape) if at[p] < at[q]]
    out = landscape.flood(v, spark.createDataFrame([*seeds.items(), (9999, 1)], "idx long, label long"), axes=("z", "y", "x")).collect()
    assert {r.idx: r.label for r in out} == one_at_a_time(edges, seeds)
    high = heights([(h, u, v) for h, _, u, v in edges], seeds) | {s: a.ravel()[s] for s in seeds}
    assert {r.idx: r.height for r in out} == high


def test_minimum_seeds(spark):
    a = np.zeros((5, 9), int)
    a[0, 1], a[2, 4], a[4, 8] = 3, 5, 2
    v = from_arrays(spark, seed=a)
    points = spark.createDataFrame([(0, 0, 1), (0, 2, 3), (0, 2, 5), (0, 4, 0), (0, 4, 0), (0, 3, 7), (0, 99, 0)], "z int, y int, x int")
    expected = a.copy()
    expected[2, 4], expected[3, 7], expected[4, 0] = 0, 4, 5
    got = {r.idx: r.seed for r in landscape.minimum_seeds(v, points).collect()}
    assert [got[i] for i in range(a.size)] == expected.ravel().tolist()
    expected[2, 3], expected[2, 5], expected[3, 7], expected[4, 0] = 4, 5, 6, 7
    got = {r.idx: r.seed for r in landscape.minimum_seeds(v, points, refill=True).collect()}
    assert [got[i] for i in range(a.size)] == expected.ravel().tolist()


def test_split_exclusions_and_manual_split(spark):
    """Segment 1 holds exclusions 4 and 5 with a ridge between them, 2 holds one exclusion twice, 3 none."""
    label = np.repeat([[1, 1, 1, 1, 1, 2, 2, 2, 3]], 3, 0)
    image = np.repeat([[1, 2, 9, 2, 1, 0, 5, 0, 0]], 3, 0)
    exclusion = np.zeros_like(label)
    exclusion[1, 0], exclusion[1, 4], exclusion[0, 5], exclusion[2, 7] = 4, 5, 6, 6
    v = from_arrays(spark, cents=image, label=label, exclusion=exclusion)
    got = {r.idx: r.label for r in landscape.split_exclusions(v).collect()}
    left, right = 3 + 1 + 9, 3 + 1 + 13
    rows = np.array([got[i] for i in range(label.size)]).reshape(label.shape)
    assert (rows[:, :2] == left).all() and (rows[:, 3:5] == right).all() and (rows[:, 5:] == label[:, 5:]).all()
    assert set(rows[:, 2]) <= {left, right}
    assert {r.idx: r.label for r in landscape.split_exclusions(v.withColumn("exclusion", F.lit(None).cast("long"))).collect()} == dict(enumerate(label.ravel().tolist()))
    seeds = spark.createDataFrame([(0, 71), (4, 72), (8, 73)], "idx long, label long")
    got = {r.idx: r.label for r in landscape.manual_split(v, 1, seeds).collect()}
    rows = np.array([got[i] for i in range(label.size)]).reshape(label.shape)
    assert (rows[:, :2] == 71).all() and (rows[:, 3:5] == 72).all() and (rows[:, 5:] == label[:, 5:]).all()
