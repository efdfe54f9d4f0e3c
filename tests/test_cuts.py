"""Inclusions settled in chunks of a few edges, against blocks of the whole graph and a walk that leaves one node out."""

import random

import pytest

from voxelgrain.operators import trees


def _segments(edges, nodes, outside):
    """Nodes that one node cuts off from outside, joined with it, by taking away each node in turn."""
    near = {}
    for u, v in edges:
        near.setdefault(u, set()).add(v)
        near.setdefault(v, set()).add(u)
    name = {k: k for k in nodes}

    def find(k):
        while name[k] != k:
            k = name[k]
        return k

    for c in nodes:
        seen, todo = {outside}, [outside]
        while todo and c != outside:
            for k in near.get(todo.pop(), set()) - seen - {c}:
                seen.add(k)
                todo.append(k)
        for k in nodes:
            if c != outside and k != c and k not in seen:
                lo, hi = sorted((find(c), find(k)))
                name[hi] = lo
    return {k: find(k) for k in nodes}


@pytest.mark.parametrize("chunk", [15, 60])
def test_inclusions_in_chunks(spark, monkeypatch, chunk):
    r = random.Random(chunk)
    edges = {(0, k) for k in (1, 30, 60, 90, 119)}
    edges |= {(k, k + 1) for k in range(1, 119) if k % 10} | {(k, k + d) for k in range(1, 110) for d in (3, 10) if r.random() < 0.35 and k + d < 120}
    whole = []
    real = trees.blocks
    monkeypatch.setattr(trees, "blocks", lambda e: whole.append(e.count()) or real(e))
    e = spark.createDataFrame(sorted(edges), "u long, v long")
    nodes = range(120)
    reach = {k for e in edges for k in e}
    got = {x.node: x.segment for x in trees.inclusions(e, spark.createDataFrame([(k,) for k in nodes], "node long"), 0, chunk=chunk).collect()}
    want = _segments(edges, sorted(reach), 0)
    assert {k: got[k] for k in reach} == want
    assert all(got[k] == k for k in nodes if k not in reach)
    assert len(set(want.values())) > 5
    # What chunks settle doesn't come to the rounds over the whole table.
    assert all(n < len(edges) for n in whole) and (chunk < 60 or not whole)
