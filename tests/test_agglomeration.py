"""Agglomeration and learning by agglomeration against one merge at a time."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from voxelgrain import catalog
from voxelgrain.operators import agglomeration, contingency, learning, priorities, rag
from voxelgrain.sources.volumes import events_volume


def pairs_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


class Graph:
    """Edges {(a, b): {n, total, ...}} between segments (frozensets) with states; ties by the largest pair of fragments."""

    def __init__(self, edges, nodes, sums):
        self.state = {frozenset([i]): dict(s) for i, s in nodes.items()}
        self.edges = {frozenset([frozenset([u]), frozenset([v])]): (dict(zip(sums, s, strict=True)), (u, v)) for u, v, *s in edges}

    def keyed(self, weight):
        out = []
        for e, (s, tie) in self.edges.items():
            a, b = sorted(e, key=min)
            w = weight(s, self.state[a], self.state[b])
            if w is not None:
                out.append((w, tie, a, b))
        return sorted(out, key=lambda x: x[:2])

    def merge(self, a, b):
        p, q = self.state.pop(a), self.state.pop(b)
        self.state[a | b] = {k: p[k] | q[k] if isinstance(p[k], (set, frozenset)) else max(p[k], q[k]) if k == "frozen" else p[k] + q[k] for k in p}
        old, self.edges = self.edges, {}
        for e, (s, tie) in old.items():
            e = frozenset(a | b if x in (a, b) else x for x in e)
            if len(e) == 2:
                have = self.edges.get(e)
                self.edges[e] = ({k: s[k] + have[0][k] for k in s}, max(tie, have[1])) if have else (s, tie)

    def parts(self):
        return sorted((i, min(p)) for p in self.state for i in p)


def one_by_one(g, weight, threshold):
    log = []
    while (keys := g.keyed(weight)) and keys[0][0] < threshold:
        log.append((keys[0][0], keys[0][2], keys[0][3]))
        g.merge(*keys[0][2:])
    return log


def in_rounds(g, weight, threshold):
    while True:
        best = {}
        for k in g.keyed(weight):
            for x in k[2:]:
                best.setdefault(x, k)
        both = [k for k in {id(b): b for b in best.values()}.values() if k[0] < threshold and best[k[2]] is k and best[k[3]] is k]
        if not both:
            return
        for k in both:
            g.merge(*k[2:])


def mean(s, p, q):
    return s["total"] / s["n"]


def graphs(count, nodes, edges, seed, weights=5):
    """Many small graphs in one table, with weights that tie, and leaves."""
    rng, out = random.Random(seed), []
    for g in range(count):
        es = {tuple(sorted(rng.sample(range(nodes - 3), 2))) for _ in range(edges)} | {(rng.randrange(nodes - 3), nodes - 1 - k) for k in range(3)}
        out.append([(100 * g + u, 100 * g + v, rng.randint(1, 3), float(rng.randint(1, weights))) for u, v in sorted(es)])
    return out


def tables(spark, gs, nodes):
    e = spark.createDataFrame([r for g in gs for r in g], "u long, v long, n long, total double")
    return e, spark.createDataFrame([(100 * g + i,) for g in range(len(gs)) for i in range(nodes)], "node long")


@pytest.mark.parametrize("most_edges", [20_000, 0])
def test_rounds_are_the_replay_where_weights_tie(spark, most_edges):
    gs = graphs(60, 14, 30, 4)
    e, n = tables(spark, gs, 14)
    log = agglomeration.history(e, n, 3.0, most_edges)
    want, cuts, weights = [], {t: [] for t in (0.7, 1.5, 2.5)}, []
    for k, rows in enumerate(gs):
        ids = {100 * k + i: {} for i in range(14)}
        g = Graph(rows, ids, ("n", "total"))
        weights += [w for w, _, _ in one_by_one(g, mean, 3.0)]
        want += g.parts()
        for t in cuts:
            g = Graph(rows, ids, ("n", "total"))
            one_by_one(g, mean, t)
            cuts[t] += g.parts()
        members = {i: {i} for i in ids}
        for _, a, b, p, _ in agglomeration.replay(rows, 3.0, first_id=10**6):
            members[p] = members.pop(a) | members.pop(b)
        assert sorted((i, min(m)) for m in members.values() for i in m) == Graph.parts(type("P", (), {"state": {frozenset(m): 0 for m in members.values()}}))
    assert pairs_of(agglomeration.rounds(e, n, 3.0, most_edges), "node", "segment") == sorted(want)
    assert sorted(r.weight for r in log.collect()) == pytest.approx(sorted(weights))
    for t, parts in cuts.items():
        assert pairs_of(agglomeration.cut_history(log, n, threshold=t), "node", "segment") == sorted(parts)


def test_hub_and_chain(spark):
    rng = random.Random(1)
    star = [(0, i, 1, float(rng.randint(1, 10**6))) for i in range(1, 5001)]
    chain = [(i, i + 1, 1, float(i)) for i in range(10_000, 15_000)]
    e = spark.createDataFrame(star + chain, "u long, v long, n long, total double")
    n = spark.createDataFrame([(i,) for i in [*range(5001), *range(10_000, 15_001)]], "node long")
    assert Counter(r.segment for r in agglomeration.rounds(e, n, math.inf).collect()) == {0: 5001, 10_000: 5001}
    few = agglomeration.rounds(e.where("u = 0"), n.where("node < 5001"), 500_000.0, most_edges=0)
    assert Counter(r.segment for r in few.collect())[0] == 1 + sum(w < 500_000 for *_, w in star)


def test_priorities_one_merge_at_a_time(spark):
    """Ladder, frozen nodes and exclusions, with ties: states merge with the segments."""
    gs = graphs(30, 12, 26, 7)
    e, n = tables(spark, gs, 12)
    rng = random.Random(2)
    state = {100 * k + i: {"size": rng.randint(1, 9), "frozen": int(rng.random() < 0.15), "exclusions": frozenset(rng.sample(range(3), 1) if rng.random() < 0.3 else [])} for k in range(30) for i in range(12)}
    nodes = spark.createDataFrame([(i, s["size"], s["frozen"], sorted(s["exclusions"])) for i, s in state.items()], "node long, size long, frozen int, exclusions array<long>")
    cases = {
        "ladder": (priorities.ladder_weight, lambda s, p, q: mean(s, p, q) if p["size"] < 12 or q["size"] < 12 else None),
        "barred": (priorities.barred_weight, lambda s, p, q: None if p["frozen"] or q["frozen"] or p["exclusions"] & q["exclusions"] else mean(s, p, q)),
    }
    for name, (column, weight) in cases.items():
        f = (lambda d: priorities.ladder_weight(d, 12)) if name == "ladder" else column
        got = agglomeration.merge_by_priority(e, nodes, f, 4.0, {"frozen": "max", "exclusions": "union"})
        want = []
        for k, rows in enumerate(gs):
            g = Graph(rows, {100 * k + i: state[100 * k + i] for i in range(12)}, ("n", "total"))
            one_by_one(g, weight, 4.0)
            want += g.parts()
        assert pairs_of(got[2], "node", "segment") == sorted(want), name
        assert got[1].agg(F.sum("size")).first()[0] == sum(s["size"] for s in state.values())


def test_priorities_in_rounds(spark):
    gs = graphs(60, 12, 26, 8)
    squares = [[(u, v, n, t, t * t / n + (7 * u + v) % 5) for u, v, n, t in g] for g in gs]
    e = spark.createDataFrame([r for g in squares for r in g], "u long, v long, n long, total double, squares double")
    nodes = tables(spark, gs, 12)[1]

    def sem(s, p, q):
        m = s["total"] / s["n"]
        return None if s["n"] == 1 else m - 6 * math.sqrt(max(0.0, s["squares"] - m * s["total"]) / (s["n"] - 1) / s["n"])

    got = agglomeration.merge_by_priority(e, nodes, priorities.sem_weight, 0.5)[2]
    want = []
    for k, rows in enumerate(squares):
        g = Graph(rows, {100 * k + i: {} for i in range(12)}, ("n", "total", "squares"))
        in_rounds(g, sem, 0.5)
        want += g.parts()
    assert pairs_of(got, "node", "segment") == sorted(want)


def brute_epoch(rows, nodes, table, weight):
    """The labels of all edges met: (number of fragments on either side, label), by rounds."""
    g, barred, out = Graph(rows, nodes, ("n", "total")), set(), []
    cells = {frozenset([i]): Counter() for i in nodes}
    for s, t, n in table:
        cells[frozenset([s])][t] += n
    while True:
        best = {}
        for k in g.keyed(weight):
            if frozenset(k[2:]) not in barred:
                for x in k[2:]:
                    best.setdefault(x, k)
        met = [k for k in {id(b): b for b in best.values()}.values() if best[k[2]] is k and best[k[3]] is k]
        if not met:
            return sorted(out)
        top = {x: min(c, key=lambda t: (-c[t], t)) for x, c in cells.items()}
        for w, _, a, b in met:
            same = top[a] == top[b]
            out.append((min(a), min(b), -1 if same else 1))
            if same:
                g.merge(a, b)
                cells[a | b] = cells.pop(a) + cells.pop(b)
                barred = {frozenset(a | b if x in (a, b) else x for x in e) for e in barred}
            else:
                barred.add(frozenset((a, b)))


def test_an_epoch_of_learning(spark):
    rows = [r for g in graphs(8, 12, 24, 11, weights=9) for r in g]
    rng = random.Random(5)
    ids = sorted({100 * k + i for k in range(8) for i in range(12)})
    nodes = {i: {"size": rng.randint(2, 9), "total": rng.randint(1, 90)} for i in ids}
    table = [(i, i // 100 * 3 + t, rng.randint(1, 6)) for i in ids for t in rng.sample(range(3), 2)]
    e = spark.createDataFrame(rows, "u long, v long, n long, total double")
    n = spark.createDataFrame([(i, s["size"], s["total"]) for i, s in nodes.items()], "node long, size long, total long")
    t = spark.createDataFrame(table, "s long, g long, n long")
    got = learning.epoch(e, n, t, priorities.mean_weight)
    assert pairs_of(got, "u", "v", "label") == brute_epoch(rows, nodes, table, mean)
    model, all_rows = learning.learn_agglomerate(e, n, t, epochs=2, name="logistic regression")
    assert {r.epoch for r in all_rows.select("epoch").distinct().collect()} == {0, 1}
    assert pairs_of(all_rows.where("epoch = 0"), "u", "v", "label") == brute_epoch(rows, nodes, table, mean)
    first = all_rows.where("epoch = 0 and round = 0 and label is not null")
    again = learning.edge_features(e, n).join(first.select("u", "v", F.col("features").alias("f")), ["u", "v"])
    assert again.where("features <> f").count() == 0 and again.count() == first.count() > 0
    assert learning.learn_agglomerate(e, n, t, epochs=5, enough=1, name="logistic regression")[1].agg(F.max("epoch")).first()[0] == 0
    assert agglomeration.merge_by_priority(e, n, learning.model_weight(model), 0.5)[2].count() == len(ids)


def test_registered_agglomerations(spark, sf):
    """The queries on the events volume against one merge at a time."""
    v = events_volume(spark, sf)
    edges = rag.edges(rag.boundary_voxels(v, "exact", keep=("idx", "cents")))
    rows = [(r.u, r.v, r.n, r.total) for r in edges.collect()]
    size = {r.node: r["size"] for r in rag.nodes(v).collect()}

    least_most = [(r.u, r.v, r.n, r.total) for r in rag.edges(rag.boundary_voxels(v)).collect()]

    def parts(weight, threshold, state=lambda i: {}, rows=rows):
        g = Graph(rows, {i: state(i) for i in size}, ("n", "total"))
        log = one_by_one(g, weight, threshold)
        return g.parts(), log

    q = lambda name: catalog.queries()[name](spark, sf)
    want = parts(mean, 2800.0)[0]
    assert pairs_of(q("agglomerated_by_rounds"), "node", "segment") == want
    cuts = {x: parts(mean, x, rows=least_most)[0] for x in (2000.0, 2800.0)}
    assert pairs_of(q("agglomerated_segments"), "threshold", "node", "segment") == sorted((x, *p) for x, ps in cuts.items() for p in ps)
    assert sorted(r.weight for r in q("merge_history").collect()) == pytest.approx([w for w, _, _ in parts(mean, 3000.0)[1]])
    log = parts(mean, math.inf)[1]
    members = {frozenset([i]) for i in size}
    for _, a, b in log[:50]:
        members = members - {a, b} | {a | b}
    assert pairs_of(q("agglomerated_by_count"), "node", "segment") == sorted((i, min(m)) for m in members for i in m)
    assert pairs_of(q("agglomerated_ladder"), "node", "segment") == parts(lambda s, p, q: mean(s, p, q) if min(p["size"], q["size"]) < 60 else None, 4000.0, lambda i: {"size": size[i]})[0]
    barred = lambda s, p, q: None if p["frozen"] or q["frozen"] or p["x"] & q["x"] else mean(s, p, q)
    state = lambda i: {"frozen": int(i % 7 == 0), "x": frozenset([i % 3] if i % 5 == 1 else [])}
    assert pairs_of(q("agglomerated_frozen"), "node", "segment") == parts(barred, 3500.0, state)[0]
    segment = dict(cuts[2800.0])
    merged = Counter()
    for r in contingency.contingency(v).collect():
        merged[segment[r.s], r.g] += r.n
    table = spark.createDataFrame([(s, g, n) for (s, g), n in merged.items()], "s long, g long, n long")
    vi, got = contingency.split_vi(table).first(), q("agglomerated_vi").first()
    assert (got.under, got.over) == pytest.approx((vi.under, vi.over), abs=1e-5)


@pytest.mark.parametrize("merges", [0, 1, 7, 60, 10_000])
def test_first_merges_are_those_of_the_whole_history(spark, merges):
    r = random.Random(merges)
    pairs = {tuple(sorted(r.sample(range(120), 2))) for _ in range(400)}
    rows = [(u, v, r.randrange(1, 5), r.randrange(1, 10_000)) for u, v in sorted(pairs)]
    edges = spark.createDataFrame(rows, "u long, v long, n long, total long")
    nodes = spark.range(120).withColumnRenamed("id", "node")
    want = agglomeration.history(edges, nodes).orderBy("weight", "left", "right").limit(merges).collect()
    log = agglomeration.first_merges(edges, nodes, merges)
    assert log.orderBy("weight", "left", "right").limit(merges).collect() == want
    if merges == 1:
        assert log.count() < 100
