"""Which edges one node cuts off from the outside, worked out a chunk of edges at a time.

Edges that are biconnected within a chunk are so in the whole graph. What hangs on one node of a chunk, and meets no other
chunk, is settled there. Of each other biconnected part only a circle through the nodes by which it meets the rest goes
on: it holds them together as the part does, whichever node is taken away."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import written

#: Edges of a chunk, about.
EDGES = 100_000


def biconnected(edges: list[tuple[int, int]]) -> list[list[int]]:
    """The biconnected parts of a simple graph, as numbers of its edges."""
    near: dict[int, list[tuple[int, int]]] = {}
    for i, (u, v) in enumerate(edges):
        near.setdefault(u, []).append((v, i))
        near.setdefault(v, []).append((u, i))
    place: dict[int, int] = {}
    low: dict[int, int] = {}
    parts, open_edges = [], []
    for root in near:
        if root in place:
            continue
        place[root] = low[root] = len(place)
        way = [(root, -1, iter(near[root]))]
        while way:
            node, came, rest = way[-1]
            for other, i in rest:
                if i == came:
                    continue
                if other not in place:
                    open_edges.append(i)
                    place[other] = low[other] = len(place)
                    way.append((other, i, iter(near[other])))
                    break
                if place[other] < place[node]:
                    open_edges.append(i)
                    low[node] = min(low[node], place[other])
            else:
                way.pop()
                if way:
                    above = way[-1][0]
                    low[above] = min(low[above], low[node])
                    if low[node] >= place[above]:
                        at = len(open_edges) - 1
                        while open_edges[at] != came:
                            at -= 1
                        parts.append(open_edges[at:])
                        del open_edges[at:]
    return parts


def pruned(edges: list[tuple[int, int]], shared: set[int], outside: int) -> tuple[list[tuple[int, int, int | None]], list[tuple[int, int, int]]]:
    """((edge, part, whether it is cut off: 1, 0 or not known here) of all edges, (u, v, part) of the circles that go on).

    shared has the nodes that other chunks hold too."""
    parts = biconnected(edges)
    nodes = [{k for i in part for k in edges[i]} for part in parts]
    of: dict[int, set[int]] = {}
    for p, ns in enumerate(nodes):
        for k in ns:
            of.setdefault(k, set()).add(p)
    bound = shared | {outside}
    tied = [sum(k in bound or len(of[k]) > 1 for k in ns) for ns in nodes]
    status: list[int | None] = [None] * len(parts)
    loose = [p for p, t in enumerate(tied) if t <= 1]
    while loose:
        p = loose.pop()
        if status[p] is not None:
            continue
        status[p] = int(outside not in nodes[p])
        for k in nodes[p]:
            of[k].discard(p)
            if len(of[k]) == 1 and k not in bound:
                (q,) = of[k]
                tied[q] -= 1
                if tied[q] <= 1:
                    loose.append(q)
    circles = []
    for p, ns in enumerate(nodes):
        if status[p] is None:
            ring = sorted(k for k in ns if k in bound or len(of[k]) > 1)
            circles += [(*sorted(e), p) for e in zip(ring, ring[1:] + ring[:1], strict=True)][: len(ring) if len(ring) > 2 else 1]
    return [(i, p, status[p]) for p, part in enumerate(parts) for i in part], circles


def cut_off(pairs: DataFrame, outside: int, chunk: int = EDGES) -> DataFrame:
    """(u, v): the edges whose biconnected part doesn't hold ``outside``; pairs are distinct, u < v.

    Edges are dealt by ranges of their larger node. Where chunks no longer halve what is left, blocks() over the whole
    table settles it."""
    from .trees import blocks

    rest, levels, before = written(pairs.select(F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v")), "pairs"), [], None

    def run(table: pa.Table) -> pa.Table:
        got = {c: table.column(c).to_pylist() for c in table.column_names}
        edges = list(zip(got["u"], got["v"], strict=True))
        shared = {k for c in "uv" for k, s in zip(got[c], got[f"{c}_shared"], strict=True) if s}
        told, circles = pruned(edges, shared, outside)
        first = got["c"][0] << 32
        rows = [(*edges[i], first + p, s, False) for i, p, s in told] + [(u, v, first + p, None, True) for u, v, p in circles]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.bool_()]
        columns = zip(*rows, strict=True) if rows else [[]] * 5
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["u", "v", "part", "apart", "goes_on"])

    while now := rest.count():
        if before is not None and 2 * now > before:
            of = written(blocks(rest), "blocks")
            seen = of.where((F.col("u") == outside) | (F.col("v") == outside)).select("block").distinct()
            found = of.join(seen, "block", "left_anti").select("u", "v")
            break
        before, many = now, now // chunk + 1
        dealt = written(rest.repartitionByRange(many, "v").withColumn("c", F.spark_partition_id().cast("long")), "dealt")
        ends = dealt.select(F.explode(F.array("u", "v")).alias("node"), "c").groupBy("node").agg(F.min("c").alias("lo"), F.max("c").alias("hi"))
        shared = ends.where("lo < hi").select("node", F.lit(True).alias("_shared"))
        side = lambda k: shared.select(F.col("node").alias(k), F.col("_shared").alias(f"{k}_shared"))  # noqa: E731, B023
        rows = dealt.join(side("u"), "u", "left").join(side("v"), "v", "left").select("c", "u", "v", "u_shared", "v_shared")
        level = written(rows.groupBy("c").applyInArrow(run, "u long, v long, part long, apart int, goes_on boolean"), "level")
        levels.append(level)
        rest = written(level.where("goes_on").select("u", "v").distinct(), "pairs")
    else:
        found = rest.select("u", "v")
    for level in reversed(levels):
        closed = level.where("goes_on").join(found, ["u", "v"], "left_semi").select("part").distinct()
        held = level.where("NOT goes_on")
        later = held.where("apart IS NULL").join(closed, "part", "left_semi").select("u", "v")
        found = written(held.where("apart = 1").select("u", "v").union(later), "cut")
    return found
