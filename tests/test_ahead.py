"""Rounds made many at once, in overlapping chunks, against rounds made one at a time."""

import functools
import random

import pytest
from pyspark.sql import functions as F
from test_agglomeration import brute_epoch, mean, pairs_of

from voxelgrain.operators import agglomeration, ahead, learning, priorities

WIDE, HIGH = 4, 200


def _grid(seed, few=30):
    """A long strip of a grid with many equal weights: edges, nodes, overlaps with a truth of three by three."""
    r = random.Random(seed)
    ids = range(WIDE * HIGH)
    rows = [(i, j, r.randint(1, 3), float(r.randint(1, few))) for i in ids for j in (i + 1, i + WIDE) if j < WIDE * HIGH and (j % WIDE or j == i + WIDE)]
    nodes = {i: {"size": r.randint(2, 9), "total": r.randint(1, 90)} for i in ids}
    table = [(i, i // WIDE // 3 * 10 + t, r.randint(1, 6)) for i in ids for t in r.sample(range(3), 2)]
    return rows, nodes, table


def _tables(spark, rows, nodes, table):
    e = spark.createDataFrame(rows, "u long, v long, n long, total double")
    n = spark.createDataFrame([(i, s["size"], s["total"]) for i, s in nodes.items()], "node long, size long, total long")
    return e, n, spark.createDataFrame(table, "s long, g long, n long")


def _uneven(e):
    """A weight that merges may make lower: the mean, and how far the two sides' means are apart."""
    return e["total"] / e["n"] + abs(e["u_total"] / e["u_size"] - e["v_total"] / e["v_size"])


def _weigh(edges):
    return edges.withColumn("w", F.col("total") / F.col("n") + F.abs(F.col("u_total") / F.col("u_size") - F.col("v_total") / F.col("v_size")))


def _rounds(rows, nodes, threshold):
    """(round, left, right) of all merges, and the name of each node's segment."""
    live = {(u, v): [u, v, n, t] for u, v, n, t in rows}
    held, name, out, now = {i: [s["size"], s["total"]] for i, s in nodes.items()}, {i: i for i in nodes}, [], 0
    while True:
        keys = []
        for (u, v), (tu, tv, n, t) in live.items():
            w = t / n + abs(held[u][1] / held[u][0] - held[v][1] / held[v][0])
            if w < threshold:
                keys.append((w, tu, tv, u, v))
        best = {}
        for k in sorted(keys):
            for x in k[3:]:
                best.setdefault(x, k)
        met = {k[3:] for k in best.values() if best[k[3]] == k == best[k[4]]}
        if not met:
            return sorted(out), name
        to = {v: u for u, v in met}
        out += [(now, u, v) for u, v in met]
        name = {i: to.get(x, x) for i, x in name.items()}
        for u, v in met:
            held[u] = [a + b for a, b in zip(held[u], held.pop(v), strict=True)]
        after = {}
        for (u, v), (tu, tv, n, t) in live.items():
            u, v = sorted((to.get(u, u), to.get(v, v)))
            if u != v:
                a = after.setdefault((u, v), [tu, tv, 0, 0.0])
                a[0], a[1] = max((a[0], a[1]), (tu, tv))
                a[2], a[3] = a[2] + n, a[3] + t
        live, now = after, now + 1


@pytest.fixture
def counted(monkeypatch):
    """How many rounds were made one at a time, and how many by each call in chunks."""
    alone, at_once = [], []

    def spy(module):
        real = module._mutual
        monkeypatch.setattr(module, "_mutual", lambda *a: alone.append(1) or real(*a))

    spy(agglomeration)
    spy(learning)

    def chunks_of(edges):
        real = ahead.advanced

        def advanced(*args, **named):
            out = real(*args, **named, chunk=edges)
            at_once.append(out[1])
            return out

        monkeypatch.setattr(ahead, "advanced", advanced)
        return alone, at_once

    return chunks_of


@pytest.mark.parametrize("edges", [400, 100_000])
def test_merges_by_a_priority(spark, counted, edges):
    rows, nodes, table = _grid(1)
    e, n, _ = _tables(spark, rows, nodes, table)
    alone, at_once = counted(edges)
    weigh = functools.partial(_weigh)
    weigh.arrays = _uneven
    left, held, names, merges = agglomeration.merge_by_priority(e, n, weigh, 12.0)
    want, name = _rounds(rows, nodes, 12.0)
    assert len({k[0] for k in want}) > 4
    assert sorted((r["round"], r.left, r.right) for r in merges.collect()) == want
    assert {r.node: r.segment for r in names.collect()} == name
    assert held.agg(F.sum("size")).first()[0] == sum(s["size"] for s in nodes.values())
    assert at_once[0] > 4 and len(alone) <= 1


@pytest.mark.parametrize("edges", [400])
def test_an_epoch(spark, counted, edges):
    rows, nodes, table = _grid(2)
    alone, at_once = counted(edges)
    got = learning.epoch(*_tables(spark, rows, nodes, table), priorities.mean_weight)
    assert pairs_of(got, "u", "v", "label") == brute_epoch(rows, nodes, table, mean)
    assert at_once[0] > 4 and len(alone) <= 1


def test_a_model_of_arrays(spark):
    e, n, t = _tables(spark, *_grid(3))
    model = learning.fit(learning.flat_training(e, n, t), name="logistic regression")
    side = lambda k: n.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("total").alias(f"{k}_total"))
    weigh = learning.model_weight(model)
    got = weigh(e.join(side("u"), "u").join(side("v"), "v")).toPandas()
    assert abs(weigh.arrays({c: got[c].to_numpy() for c in got.columns if c != "w"}) - got.w.to_numpy()).max() < 1e-12
