"""Spanning forests, their rooting, ancestors by doubling, and the blocks of a graph, all as joins over whole tables.

The number of rounds grows with the logarithm of the graph, whatever its shape: chains and hubs have no rounds or tasks
of their own size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .agglomeration import by_part
from .chunks import EDGES, settled
from .cuts import EDGES as CUT_EDGES
from .cuts import cut_off
from .grid import components, ranked, written

#: Wider than any place in a tour.
_ENDS = 1 << 62


def _once(edge_table: DataFrame, rest: list[str]) -> DataFrame:
    return edge_table.where("u <> v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), *rest)


def spanning_forest(edge_table: DataFrame, order: tuple[str, ...] = (), chunk: int = EDGES) -> DataFrame:
    """(u, v, order...): the least spanning forest by (order..., u, v), u < v.

    In each round every part of the forest takes its least edge to another part, so parts at least halve. No two edges
    are equal in that order, so the edges taken never close a circle. The first rounds are made in chunks. Loops and repeated edges don't count."""
    e = F.struct(*order, "u", "v")
    live = written(_once(edge_table, list(order)).select(F.col("u").alias("a"), F.col("v").alias("b"), e.alias("e")), "live")
    _, live, taken = settled(live, False, chunk)
    live = live.where("a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))
    live, taken = written(live, "live"), taken.select("e.*")
    while live.limit(1).count():
        ends = live.select(F.explode(F.array("a", "b")).alias("part"), F.struct("e", "a", "b").alias("m"))
        chosen = written(ends.groupBy("part").agg(F.min("m").alias("m")).select("m.*").distinct(), "chosen")
        taken = taken.union(chosen.select("e.*"))
        parts = components(chosen.select(F.explode(F.array("a", "b")).alias("node")).distinct(), chosen.select(F.col("a").alias("u"), F.col("b").alias("v")), within=True)
        side = lambda k: parts.select(F.col("node").alias(k), F.col("component").alias(f"_{k}"))  # noqa: E731, B023
        moved = live.join(side("a"), "a").join(side("b"), "b").where("_a <> _b")
        live = written(moved.groupBy(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).agg(F.min("e").alias("e")), "live")
    return written(taken.select("u", "v", *order).distinct(), "forest")


def rooted(forest: DataFrame) -> DataFrame:
    """(node, root, parent, first, last) of a forest's nodes, each tree rooted at its least node, which has no parent.

    Along a tour that goes down and up each edge once, first and last are the steps into a node and out of it, so y is
    below x or is x where first(x) <= first(y) < last(x). Places in the tour are found by doubling; steps are put next
    to each other by ranges of their order, so a node with many edges is no task of its own."""
    both = forest.select(F.col("u").alias("a"), F.col("v").alias("b")).union(forest.select("v", "u"))
    darts = written(ranked(both, ["a", "b"], "at"), "darts")
    span = darts.groupBy("a").agg(F.min("at").alias("lo"), F.max("at").alias("hi"))
    part = components(span.select(F.col("a").alias("node")), forest, within=True)
    twin = darts.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("at").alias("back"))
    turn = darts.join(twin, ["a", "b"]).join(span.withColumnRenamed("a", "b"), "b")
    turn = turn.select("at", F.when(F.col("back") < F.col("hi"), F.col("back") + 1).otherwise(F.col("lo")).alias("to"))
    starts = part.where("node = component").join(span, F.col("node") == F.col("a")).select(F.col("lo").alias("to"), F.lit(True).alias("ends"))
    turn = turn.join(starts, "to", "left").select("at", F.when(F.col("ends"), None).otherwise(F.col("to")).alias("to"))
    left = written(turn.withColumn("left", F.col("to").isNotNull().cast("long")), "left")
    while left.where("to IS NOT NULL").limit(1).count():
        after = left.select(F.col("at").alias("to"), F.col("to").alias("beyond"), F.col("left").alias("more"))
        left = written(left.join(after, "to", "left").select("at", F.col("beyond").alias("to"), (F.col("left") + F.coalesce("more", F.lit(0))).alias("left")), "left")
    timed = darts.join(left, "at").select("a", "b", (-F.col("left")).alias("t"))
    down = timed.join(timed.select(F.col("a").alias("b"), F.col("b").alias("a"), F.col("t").alias("up")), ["a", "b"]).where("t < up")
    down = down.select(F.col("b").alias("node"), F.col("a").alias("parent"), F.col("t").alias("first"), F.col("up").alias("last"))
    out = part.join(down, "node", "left").select("node", F.col("component").alias("root"), "parent", F.coalesce("first", F.lit(-_ENDS)).alias("first"), F.coalesce("last", F.lit(_ENDS)).alias("last"))
    return written(out, "rooted")


def ancestors(tree: DataFrame, best: DataFrame | None = None) -> list[DataFrame]:
    """For k = 0, 1, ... (node, anc, first, last[, best]): each node's 2^k-th ancestor with its first and last.

    tree is rooted()'s; best (node, best) is a value of the edge from a node to its parent, and the result's best the
    largest on the way to the ancestor."""
    place = tree.select(F.col("node").alias("anc"), "first", "last")
    up = tree.where("parent IS NOT NULL").select("node", F.col("parent").alias("anc"))
    if best is not None:
        up = up.join(best, "node")
    up = written(up.join(place, "anc"), "up")
    out = []
    while up.limit(1).count():
        out.append(up)
        more = up.select(F.col("node").alias("anc"), F.col("anc").alias("_anc"), F.col("first").alias("_first"), F.col("last").alias("_last"), *([F.col("best").alias("_best")] if best is not None else []))
        both = [F.greatest("best", "_best").alias("best")] if best is not None else []
        up = written(up.join(more, "anc").select("node", F.col("_anc").alias("anc"), F.col("_first").alias("first"), F.col("_last").alias("last"), *both), "up")
    return out


def heaviest_between(pairs: DataFrame, forest: DataFrame, order: tuple[str, ...], most_rows: int = 20_000) -> DataFrame:
    """(a, b, best): for distinct pairs of nodes, the largest edge, a struct of (order..., u, v), on the way between
    them in a forest; null where a = b or no way leads from one to the other.

    Trees that have at most most_rows edges and pairs are looked through in one task each; in larger ones all pairs climb
    together, one join for each power of two that the trees are deep."""
    pairs, forest = written(pairs.select("a", "b"), "pairs"), written(forest, "forest")
    nodes = forest.select(F.col("u").alias("node")).union(forest.select("v")).distinct()
    part = components(nodes, forest.select("u", "v"), within=True)
    side = lambda k: part.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    none = [F.lit(None).cast(forest.schema[c].dataType).alias(c) for c in order]
    rows = forest.join(side("u"), "u").select(F.col("cu").alias("part"), F.lit(0).alias("kind"), *order, F.col("u").cast("long").alias("u"), F.col("v").cast("long").alias("v"))
    asked = pairs.where("a <> b").join(side("a"), "a").join(side("b"), "b").where("ca = cb")
    rows = written(rows.union(asked.select(F.col("ca").alias("part"), F.lit(1).alias("kind"), *none, F.col("a").cast("long"), F.col("b").cast("long"))), "rows")
    large = written(rows.groupBy("part").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most_rows).select("part"), "large")

    def run(part, rows):
        top: dict[int, int] = {}
        size: dict[int, int] = {}
        joined: dict[int, tuple[int, int, int]] = {}  # the edge, with its place, by which a top went below another
        for i, (kind, *_, a, b) in enumerate(rows):
            x, y, last = a, b, None
            if kind == 0:
                while x in top:
                    x = top[x]
                while y in top:
                    y = top[y]
                x, y = (x, y) if size.get(x, 1) <= size.get(y, 1) else (y, x)
                top[x], joined[x], size[y] = y, (i, a, b), size.get(x, 1) + size.get(y, 1)
                continue
            while x != y:
                # The one that left its place earlier moves up; the last move is the edge that joined both.
                if y not in top or (x in top and joined[x] < joined[y]):
                    x, last = top[x], joined[x]
                else:
                    y, last = top[y], joined[y]
            yield a, b, *last[1:]

    small = rows.join(large, "part", "left_anti")
    found = by_part(small, "part", run, "a long, b long, u long, v long", ("kind", *order, "u", "v"))
    edge = forest.select("u", "v", F.struct(*order, "u", "v").alias("best"))
    found = found.join(edge, ["u", "v"]).select("a", "b", "best")
    if large.limit(1).count():
        inside = part.join(large, F.col("component") == F.col("part"), "left_semi")
        of = lambda t, k: t.join(inside.select(F.col("node").alias(k)), k, "left_semi")
        found = found.union(_climbed(of(of(pairs, "a"), "b"), of(forest, "u"), order).where("best IS NOT NULL"))
    return pairs.join(found, ["a", "b"], "left")


def _climbed(pairs: DataFrame, forest: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """heaviest_between() for all pairs at once, by joins over whole tables."""
    tree = rooted(forest)
    edge = forest.select(F.least("u", "v").alias("_u"), F.greatest("u", "v").alias("_v"), F.struct(*order, "u", "v").alias("best"))
    ends = tree.where("parent IS NOT NULL").select("node", F.least("node", "parent").alias("_u"), F.greatest("node", "parent").alias("_v"))
    ups = ancestors(tree, ends.join(edge, ["_u", "_v"]).select("node", "best"))
    side = lambda k: tree.select(F.col("node").alias(k), F.col("root").alias(f"{k}_root"), F.col("first").alias(f"{k}_first"), F.col("last").alias(f"{k}_last"))
    placed = written(pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").where("a_root = b_root"), "pairs")

    def climb(x: str, y: str) -> DataFrame:
        aim = F.col(f"{y}_first")
        over = lambda lo, hi: (F.col(lo) <= aim) & (aim < F.col(hi))
        at = placed.select("a", "b", f"{y}_first", F.col(x).alias("at"), F.col(f"{x}_first").alias("lo"), F.col(f"{x}_last").alias("hi"), F.lit(None).cast(edge.schema["best"].dataType).alias("way"))
        for k in reversed(range(-1, len(ups))):
            # The last step, by one, goes to the common ancestor itself; all before stay below it.
            up = ups[max(k, 0)].withColumnRenamed("node", "at")
            goes = F.col("anc").isNotNull() & ~(over("first", "last") if k >= 0 else over("lo", "hi"))
            pick = lambda new, old: F.when(goes, F.col(new)).otherwise(F.col(old)).alias(old)  # noqa: E731, B023
            way = F.when(goes, F.greatest("way", "best")).otherwise(F.col("way")).alias("way")
            at = at.join(up, "at", "left").select("a", "b", f"{y}_first", pick("anc", "at"), pick("first", "lo"), pick("last", "hi"), way)
        return written(at.select("a", "b", F.col("way").alias(f"way_{x}")), "climbed")

    if not ups:
        return pairs.select("a", "b", F.lit(None).cast(edge.schema["best"].dataType).alias("best"))
    found = climb("a", "b").join(climb("b", "a"), ["a", "b"]).select("a", "b", F.greatest("way_a", "way_b").alias("best"))
    return pairs.select("a", "b").join(found, ["a", "b"], "left")


def blocks(edge_table: DataFrame) -> DataFrame:
    """(u, v, block): the biconnected part of each edge, u < v; a part is named by a node of it.

    Edges of a spanning tree are one part where the subtree under the lower one has an edge that leaves the subtree
    under the upper one, or where an edge outside the tree runs between their lower ends, neither of which is above the
    other. An edge outside the tree belongs to the tree edge above its end that the tour meets later."""
    pairs = written(_once(edge_table, []).distinct(), "pairs")
    forest = spanning_forest(pairs)
    tree = rooted(forest)
    side = lambda k: tree.select(F.col("node").alias(k), F.col("first").alias(f"{k}_first"), F.col("last").alias(f"{k}_last"))
    rest = written(pairs.join(forest, ["u", "v"], "left_anti").join(side("u"), "u").join(side("v"), "v"), "rest")
    reach = tree.select("node", F.col("first").alias("at")).union(rest.select("u", "v_first")).union(rest.select("v", "u_first"))
    reach = written(reach.groupBy("node").agg(F.min("at").alias("lo"), F.max("at").alias("hi")), "reach")
    for up in ancestors(tree):
        # So far each node knows its subtree to a depth of 2^k; its descendants at that depth know as much again.
        below = reach.join(up.select("node", "anc"), "node").groupBy("anc").agg(F.min("lo").alias("_lo"), F.max("hi").alias("_hi"))
        reach = written(reach.join(below, F.col("node") == F.col("anc"), "left").select("node", F.least("lo", "_lo").alias("lo"), F.greatest("hi", "_hi").alias("hi")), "reach")
    over = tree.where("parent IS NOT NULL").select(F.col("node").alias("parent"), F.col("first").alias("p_first"), F.col("last").alias("p_last"))
    leaving = tree.select("node", "parent").join(over, "parent").join(reach, "node").where("lo < p_first OR hi >= p_last").select(F.col("parent").alias("u"), F.col("node").alias("v"))
    apart = ~((F.col("u_first") <= F.col("v_first")) & (F.col("v_first") < F.col("u_last"))) & ~((F.col("v_first") <= F.col("u_first")) & (F.col("u_first") < F.col("v_last")))
    part = components(tree.where("parent IS NOT NULL").select("node"), leaving.union(rest.where(apart).select("u", "v")), within=True)
    lower = pairs.join(side("u"), "u").join(side("v"), "v").select("u", "v", F.when(F.col("u_first") < F.col("v_first"), F.col("v")).otherwise(F.col("u")).alias("node"))
    return lower.join(part, "node").select("u", "v", F.col("component").alias("block"))


def inclusions(edge_table: DataFrame, nodes: DataFrame, outside: int, chunk: int = CUT_EDGES) -> DataFrame:
    """(node, segment): everything that one node cuts off from ``outside`` merges with that node, named by its least node.

    outside is a node that stands for all beyond the volume. Biconnected parts without it merge, each into one segment
    and those with a common node together; parts of the graph that don't hang together with outside do so too. Chunks of
    edges settle what they can by themselves, see cuts.py."""
    inner = cut_off(_once(edge_table, []).distinct(), outside, chunk)
    return components(nodes.select("node"), inner).select("node", F.col("component").alias("segment"))


def obvious_inclusions(edge_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, segment): nodes with one neighbour go to it, all at once; of two that have only each other, the larger."""
    ends = _once(edge_table, []).distinct()
    both = ends.union(ends.select("v", "u"))
    alone = both.groupBy("u").agg(F.count(F.lit(1)).alias("degree"), F.min("v").alias("to")).where("degree = 1")
    mutual = alone.select(F.col("u").alias("to"), F.col("to").alias("_back"))
    alone = alone.join(mutual, "to", "left").where("_back IS NULL OR u > to").select(F.col("u").alias("node"), "to")
    return nodes.select("node").join(alone, "node", "left").select("node", F.coalesce("to", "node").alias("segment"))
