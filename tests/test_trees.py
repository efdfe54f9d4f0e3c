"""Forests, blocks and searches against plain Python."""

import random

from voxelgrain.operators import kernels, trees


def graph(spark, edges, columns="u long, v long"):
    return spark.createDataFrame(edges, columns)


def random_edges(seed, n, m):
    r = random.Random(seed)
    return sorted({(min(a, b), max(a, b)) for a, b in ((r.randrange(n), r.randrange(n)) for _ in range(m)) if a != b})


def kruskal(edges):
    """The least spanning forest of (w, u, v)."""
    top = {}

    def find(x):
        while top.get(x, x) != x:
            x = top[x]
        return x

    out = []
    for w, u, v in sorted(edges):
        a, b = find(u), find(v)
        if a != b:
            top[a] = b
            out.append((w, u, v))
    return out


def test_least_spanning_forest(spark):
    r = random.Random(5)
    edges = [(r.randrange(6), u, v) for u, v in random_edges(5, 60, 90)]
    out = trees.spanning_forest(graph(spark, edges, "w long, u long, v long"), ("w",))
    assert sorted((r.w, r.u, r.v) for r in out.collect()) == sorted(kruskal(edges))
    assert trees.spanning_forest(graph(spark, [])).count() == 0
    assert [tuple(r) for r in trees.spanning_forest(graph(spark, [(4, 2), (2, 4), (3, 3)])).collect()] == [(2, 4)]


def test_rooted_intervals_are_subtrees(spark):
    edges = [(u, v) for _, u, v in kruskal([(0, u, v) for u, v in random_edges(1, 80, 90)])] + [(1000, k) for k in range(1001, 1300)]
    rows = {r.node: r for r in trees.rooted(graph(spark, edges)).collect()}
    assert set(rows) == {x for e in edges for x in e}
    for r in rows.values():
        above, x = set(), r.node
        while x is not None:
            above.add(x)
            x = rows[x].parent
        assert r.root in above and rows[r.root].parent is None
        assert above == {q.node for q in rows.values() if q.root == r.root and q.first <= r.first < q.last}
    assert {(min(r.node, r.parent), max(r.node, r.parent)) for r in rows.values() if r.parent is not None} == {(min(e), max(e)) for e in edges}


def test_heaviest_edge_between(spark):
    r = random.Random(3)
    edges = kruskal([(r.randrange(9), u, v) for u, v in random_edges(3, 50, 70)])
    near = {}
    for w, u, v in edges:
        near.setdefault(u, []).append((v, (w, u, v)))
        near.setdefault(v, []).append((u, (w, u, v)))
    pairs = sorted({(r.randrange(50), r.randrange(50)) for _ in range(300)})
    expected = {}
    for a in {a for a, _ in pairs}:
        seen, queue = {a: None}, [a]
        for x in queue:
            for y, e in near.get(x, []):
                if y not in seen:
                    seen[y] = e if seen[x] is None else max(e, seen[x])
                    queue.append(y)
        for p, b in pairs:
            if p == a:
                expected[a, b] = seen.get(b)
    out = trees.heaviest_between(graph(spark, pairs, "a long, b long"), graph(spark, edges, "w long, u long, v long"), ("w",)).collect()
    assert {(r.a, r.b): tuple(r.best) if r.best else None for r in out} == expected and len(out) == len(pairs)


def test_heaviest_edge_on_a_long_chain(spark):
    n = 100_000
    chain = spark.range(n - 1).selectExpr("id * 7919 % 1000003 AS w", "id AS u", "id + 1 AS v")
    weights = [i * 7919 % 1000003 for i in range(n - 1)]
    pairs = [(0, n - 1), (17, 90_000), (70_001, 70_000), (5, 5)]
    out = {(r.a, r.b): r.best for r in trees.heaviest_between(graph(spark, pairs, "a long, b long"), chain, ("w",)).collect()}
    for a, b in pairs:
        assert (out[a, b].w if out[a, b] else None) == max(weights[min(a, b) : max(a, b)], default=None)


def parts_of(rows):
    out = {}
    for r in rows:
        out.setdefault(r.block, set()).update((r.u, r.v))
    return sorted(map(sorted, out.values()))


def test_blocks(spark):
    for seed, n, m in ((1, 40, 50), (2, 2000, 2400)):
        edges = random_edges(seed, n, m)
        rows = trees.blocks(graph(spark, edges)).collect()
        assert len(rows) == len(edges)
        assert parts_of(rows) == sorted(map(sorted, kernels.biconnected(edges)))


def test_inclusions(spark):
    for seed in (10,):
        edges = random_edges(seed, 30, 34)
        nodes = sorted({x for e in edges for x in e})
        near = {}
        for u, v in edges:
            near.setdefault(u, set()).add(v)
            near.setdefault(v, set()).add(u)

        def reach(start, without):
            seen, queue = {start}, [start]
            for x in queue:
                for y in near[x] - {without}:
                    if y not in seen:
                        seen.add(y)
                        queue.append(y)
            return seen

        outside = nodes[0]
        here = reach(outside, None)
        edges = [e for e in edges if e[0] in here]
        links = [(0, c, w) for c in here - {outside} for w in here - reach(outside, c) - {c}]
        top = {}
        for _, u, v in kruskal(links):
            top.setdefault(u, set()).add(v)
            top.setdefault(v, set()).add(u)
        expected = {}
        for x in sorted(here):
            if x not in expected:
                queue = [x]
                for y in queue:
                    if y not in expected:
                        expected[y] = x
                        queue += top.get(y, ())
        out = trees.inclusions(graph(spark, edges), graph(spark, [(x,) for x in here], "node long"), outside)
        assert {r.node: r.segment for r in out.collect()} == expected


def test_obvious_inclusions(spark):
    edges = [(1, 2), (2, 3), (3, 1), (3, 9), (20, 21), (30, 31), (31, 32)]
    nodes = graph(spark, [(x,) for x in (1, 2, 3, 9, 20, 21, 30, 31, 32, 50)], "node long")
    out = trees.obvious_inclusions(graph(spark, edges), nodes)
    assert {r.node: r.segment for r in out.collect()} == {1: 1, 2: 2, 3: 3, 9: 3, 20: 20, 21: 20, 30: 31, 31: 31, 32: 31, 50: 50}
