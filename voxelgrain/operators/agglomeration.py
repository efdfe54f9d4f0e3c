"""Hierarchical agglomeration of a region adjacency graph by the mean of its boundaries.

The mean is the sum of totals over the sum of counts, so merging two edges never gives a weight below the smaller of
theirs. Hence parts of the graph that no edge under the threshold joins never meet, and each is worked through by
itself; and pairs of nodes that are each other's best may merge in any order, all in one round. Ties are settled by the
fragments between which an edge runs, so in whatever order merges are made they are the same."""

from __future__ import annotations

import heapq
import itertools
import operator
from collections.abc import Iterable

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import components, written

LOG = "component long, step long, left long, right long, parent long, weight double"


def replay(rows: Iterable[tuple[int, int, int, float]], threshold: float, most: int | None = None, excluded: dict[int, set] | None = None, first_id: int | None = None) -> list[tuple[int, int, int, int, float]]:
    """Greedy merges (step, left, right, parent, weight) of one graph of edges (u, v, n, total), lowest weight first.

    Equal weights go by the largest pair (u, v) of fragments between which the edge runs, which no merge elsewhere
    changes. A merge takes the next free id. Only edges that two merged nodes have in common get a new weight. Nodes
    whose exclusion sets meet are not merged. Rows may end in such a pair (tu, tv) of an edge that stands for several."""
    near: dict[int, dict[int, list]] = {}
    for u, v, n, total, *tie in rows:
        near.setdefault(u, {})[v] = near.setdefault(v, {})[u] = [n, total, total / n, tuple(tie) or (min(u, v), max(u, v))]
    sets = {k: set(v) for k, v in (excluded or {}).items()}
    queue = [(e[2], e[3], u, v) for u, es in near.items() for v, e in es.items() if u < v]
    heapq.heapify(queue)
    free = first_id if first_id is not None else max(near, default=0) + 1
    name = {k: k for k in near}
    log = []
    while queue and (most is None or len(log) < most):
        w, tie, u, v = heapq.heappop(queue)
        e = near.get(u, {}).get(v)
        if e is None or (e[2], e[3]) != (w, tie):
            continue
        if not w < threshold:
            break
        if sets.get(u, set()) & sets.get(v, set()):
            continue
        log.append((len(log), *sorted((name[u], name[v])), free, w))
        del near[u][v], near[v][u]
        # The node with more edges stays, so that a hub's edges aren't moved at each of its merges.
        stays, goes = (u, v) if len(near[u]) >= len(near[v]) else (v, u)
        sets[stays] = sets.pop(stays, set()) | sets.pop(goes, set())
        for k, state in near.pop(goes).items():
            del near[k][goes]
            if (other := near[stays].get(k)) is not None:
                n, total = state[0] + other[0], state[1] + other[1]
                state = [n, total, total / n, max(state[3], other[3])]
            near[stays][k] = near[k][stays] = state
            heapq.heappush(queue, (state[2], state[3], min(k, stays), max(k, stays)))
        name[stays] = free
        free += 1
    return log


def by_part(rows: DataFrame, key: str, run, schema: str, order: tuple[str, ...] = ()) -> DataFrame:
    """run(part, rows) for the rows, as tuples without the key, of each part; tuples come back.

    Parts are dealt to tasks by hash and lie one after the other there, so thousands of small ones cost no call of their own."""
    dealt = rows.select(key, *[c for c in rows.columns if c != key]).repartition(key).sortWithinPartitions(key, *order)
    kinds = {"long": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}
    fields = [c.split() for c in schema.split(", ")]

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], kinds[k]) for i, (_, k) in enumerate(fields)], names=[n for n, _ in fields])

    def each(batches):
        flat = (row for b in batches for row in zip(*(c.to_pylist() for c in b.columns), strict=True))
        out = []
        for part, group in itertools.groupby(flat, key=operator.itemgetter(0)):
            for row in run(part, [row[1:] for row in group]):
                out.append(row)
                if len(out) >= 10_000:
                    yield batch(out)
                    out = []
        yield batch(out)

    return dealt.mapInArrow(each, schema)


def agglomerate(edge_table: DataFrame, threshold: float, excluded: DataFrame | None = None) -> DataFrame:
    """The merges with weight < threshold: (component, step, left, right, parent, weight).

    edge_table has (u, v, n, total). One task replays each connected part of the edges under the threshold, together
    with the edges within it above; ids of merged nodes start after the part's own largest node, so they are unique in
    a part only. This keeps the exact order and takes exclusions; rounds() and history() need no task for a part."""
    low = edge_table.where(F.col("total") / F.col("n") < threshold)
    nodes = low.select(F.col("u").alias("node")).union(low.select("v")).distinct()
    part = components(nodes, low.select("u", "v"), within=True)
    side = lambda k: part.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    inner = edge_table.join(side("u"), "u").join(side("v"), "v").where("cu = cv").select(F.col("cu").alias("component"), "u", "v", "n", F.col("total").cast("double").alias("total"))

    if excluded is None:
        return by_part(inner, "component", lambda part, rows: [(part, *merge) for merge in replay(rows, threshold)], LOG)
    sets = excluded.join(part, "node").select("component", "node", F.explode(F.col("exclusions").cast("array<bigint>")).alias("e"))

    def run_with(pdf: pd.DataFrame, ex: pd.DataFrame) -> pd.DataFrame:
        if pdf.empty:
            return pd.DataFrame(columns=["component", "step", "left", "right", "parent", "weight"])
        held: dict[int, set] = {}
        for node, e in zip(ex.node.tolist(), ex.e.tolist(), strict=True):
            held.setdefault(node, set()).add(e)
        log = replay(zip(pdf.u.tolist(), pdf.v.tolist(), pdf.n.tolist(), pdf.total.tolist(), strict=True), threshold, excluded=held)
        out = pd.DataFrame(log, columns=["step", "left", "right", "parent", "weight"])
        out.insert(0, "component", int(pdf.component.iloc[0]))
        return out

    return inner.groupBy("component").cogroup(sets.groupBy("component")).applyInPandas(run_with, LOG)


def _together(x: list[int], y: list[int]) -> list[int]:
    """Both lists in the longer one."""
    x, y = (x, y) if len(x) >= len(y) else (y, x)
    x += y
    return x


def segments(log: DataFrame, nodes: DataFrame, threshold: float = float("inf")) -> DataFrame:
    """(node, segment): each fragment's segment after the merges under the threshold, named by its least fragment.

    Merges below a cut are a prefix of the tree, so what they join is the connected parts of the kept merges."""
    key = lambda c: F.struct("component", F.col(c).alias("id"))
    kept = log.where(F.col("weight") < threshold)

    def run(part, rows):
        least: dict[int, list[int]] = {}
        for _, a, b, p in rows:
            least[p] = _together(least.pop(a, [a]), least.pop(b, [b]))
        return [(n, min(ns)) for ns in least.values() for n in ns]

    merged = by_part(kept.select("component", "step", "left", "right", "parent"), "component", run, "node long, segment long", ("step",))
    return nodes.select("node").join(merged, "node", "left").select("node", F.coalesce("segment", "node").alias("segment"))


def _renamed(live: DataFrame, to: DataFrame) -> DataFrame:
    """The edges after nodes take other names (old, new): edges that become one add up, edges within one node go.

    (tu, tv), the largest pair of fragments that an edge stands for, settles ties; the other columns are sums."""
    side = lambda c: to.select(F.col("old").alias(c), F.col("new").alias(f"_{c}"))
    sums = [c for c in live.columns if c not in ("u", "v", "tu", "tv")]
    moved = live.join(side("u"), "u", "left").join(side("v"), "v", "left").select(F.coalesce("_u", "u").alias("a"), F.coalesce("_v", "v").alias("b"), "tu", "tv", *sums).where("a <> b")
    out = moved.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.max(F.struct("tu", "tv")).alias("t"), *[F.sum(c).alias(c) for c in sums])
    return written(out.select("u", "v", "t.tu", "t.tv", *sums), "edges")


def _named(names: DataFrame, to: DataFrame) -> DataFrame:
    return written(names.join(to.select(F.col("old").alias("segment"), F.col("new").alias("_s")), "segment", "left").select("node", F.coalesce("_s", "segment").alias("segment")), "names")


def _tops(scored: DataFrame) -> DataFrame:
    """(node, b, degree): each node's best edge, least (w, tu, tv), and how many it has."""
    ends = scored.select(F.explode(F.array("u", "v")).alias("node"), F.struct("w", "tu", "tv", "u", "v").alias("b"))
    return ends.groupBy("node").agg(F.min("b").alias("b"), F.count(F.lit(1)).alias("degree"))


def _mutual(tops: DataFrame, threshold: float) -> DataFrame:
    """(left, right, weight): the edges under the threshold that are the best of both their ends."""
    pairs = tops.where(F.col("b.w") < threshold).groupBy("b").agg(F.count(F.lit(1)).alias("k")).where("k = 2")
    return pairs.select(F.col("b.u").alias("left"), F.col("b.v").alias("right"), F.col("b.w").alias("weight"))


def finish_parts(live: DataFrame, threshold: float, most_edges: int) -> tuple[DataFrame, DataFrame, bool]:
    """Replays every connected part under the threshold that has at most so many edges, each in a task of its own:
    (the merges, (old, new) names, whether no larger part is left)."""
    low = written(live.where(F.col("total") / F.col("n") < threshold).select("u", "v"), "low")
    part = components(low.select(F.col("u").alias("node")).union(low.select("v")).distinct(), low, within=True)
    side = lambda k: part.select(F.col("node").alias(k), F.col("component").alias(f"c{k}"))
    inner = written(live.join(side("u"), "u").join(side("v"), "v").where("cu = cv").drop("cv"), "inner")
    sizes = written(inner.groupBy("cu").agg(F.count(F.lit(1)).alias("c")), "sizes")
    small = inner.join(sizes.where(F.col("c") <= most_edges).select("cu"), "cu")

    def run(part, rows):
        members: dict[int, tuple[int, list[int]]] = {}
        out = []
        for _, a, b, p, w in replay(rows, threshold):
            (x, xs), (y, ys) = members.pop(a, (a, [a])), members.pop(b, (b, [b]))
            out.append((min(x, y), max(x, y), w, True))
            members[p] = min(x, y), _together(xs, ys)
        return out + [(k, least, 0.0, False) for least, ms in members.values() for k in ms if k != least]

    rows = small.select("cu", "u", "v", "n", "total", "tu", "tv")
    out = written(by_part(rows, "cu", run, "a long, b long, w double, merge boolean"), "replayed")
    merges = out.where("merge").select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("w").alias("weight"))
    return merges, out.where("not merge").select(F.col("a").alias("old"), F.col("b").alias("new")), not sizes.where(F.col("c") > most_edges).limit(1).count()


def merge_rounds(live: DataFrame, names: DataFrame, threshold: float, most_edges: int = 20_000, every: int = 8) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """Merges all that meets under the threshold: (edges left, (node, segment), the merges).

    Parts of the graph that no edge under the threshold joins never meet, so each of at most most_edges edges is
    replayed in one task. Larger ones merge in rounds over the whole table: each node points at its best edge, least
    (weight, tu, tv), and edges that both ends point at merge; so do all nodes with one edge, since nothing can change
    its weight. After ``every`` rounds what has become small is replayed. There is no last round but that without a
    merge, and no task ever holds more than its share or most_edges edges, however much of the graph hangs together.

    Both ways give the replay's merges, ties included: a merged edge's (weight, tu, tv) is never below the lesser of
    the two it comes from, so an edge that is the best of both ends stays so until it is merged. That holds for totals
    that add up exactly, such as whole numbers.

    A merge is (left, right, weight), named by a fragment of each of the two that it joins; segments are named by one
    of their fragments, see least_named()."""
    merges: list[DataFrame] = []
    done = 0
    while True:
        if done % every == 0 and most_edges:
            log, to, last = finish_parts(live, threshold, most_edges)
            merges.append(log)
            live, names = _renamed(live, to), _named(names, to)
            if last:
                return live, names, merges
        tops = written(_tops(live.withColumn("w", F.col("total") / F.col("n"))), "tops")
        # A node with one edge goes to the other end; of two that have only each other, the larger.
        ends = tops.where("degree = 1").where(F.col("b.w") < threshold).select("b.*", "node")
        ends = ends.groupBy("u", "v", "w").agg(F.max("node").alias("leaf")).withColumn("hub", F.when(F.col("leaf") == F.col("u"), F.col("v")).otherwise(F.col("u")))
        ends = written(ends.select("leaf", "hub", "w"), "leaves")
        if ends.limit(1).count():
            # The hub keeps its name: at a lower threshold than the leaf's it is still the one that merged elsewhere.
            pairs = ends.select(F.least("leaf", "hub").alias("left"), F.greatest("leaf", "hub").alias("right"), F.col("w").alias("weight"))
            to = ends.select(F.col("leaf").alias("old"), F.col("hub").alias("new"))
        else:
            pairs = written(_mutual(tops, threshold), "pairs")
            to = pairs.select(F.col("right").alias("old"), F.col("left").alias("new"))
            if not pairs.limit(1).count():
                return live, names, merges
        merges.append(pairs)
        live, names = _renamed(live, to), _named(names, to)
        done += 1


def least_named(names: DataFrame) -> DataFrame:
    """(node, segment) with each segment named by its least node."""
    least = written(names.groupBy("segment").agg(F.min("node").alias("_least")), "least")
    return names.join(least, "segment").select("node", F.col("_least").alias("segment"))


def start(edge_table: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What merge_rounds() begins with: the edges, and every node as its own segment."""
    edges = written(edge_table.select("u", "v", F.col("u").alias("tu"), F.col("v").alias("tv"), "n", F.col("total").cast("double").alias("total")), "edges")
    return edges, written(nodes.select("node", F.col("node").alias("segment")), "names")


def merge_by_priority(edge_table: DataFrame, nodes: DataFrame, priority, threshold: float, merging: dict[str, str] | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Agglomeration by any priority of the state of edges and their ends: (edges left, segments' states, (node, segment), merges).

    All columns of edge_table beside u and v are sums, all of nodes beside node are merged as ``merging`` says: sum
    (the default), max, min or union (of arrays). Each round ``priority`` gets the edges with those of both ends as
    u_<column> and v_<column>, and returns them with a weight w, infinite or null where they must not merge; edges
    under the threshold that are the best of both ends, least (w, tu, tv), merge, and states add up.

    Where a merge never makes a weight lower, as with means, frozen or excluded nodes, or sizes that must be small, the
    result is that of one merge at a time. Other priorities, such as a classifier's, have no such order: there the
    rounds are the definition, a batch of merges that no better one at hand speaks against. A merge is (round, left,
    right, weight), named by the least fragments of what it joins.

    A priority of n, total and both ends' size and total that is also a function of arrays (``arrays``) makes many rounds at
    once, see ahead.py."""
    from . import ahead

    merging = merging or {}
    state = [c for c in nodes.columns if c != "node"]
    live = written(edge_table.select("u", "v", F.col("u").alias("tu"), F.col("v").alias("tv"), *[c for c in edge_table.columns if c not in ("u", "v")]), "edges")
    held, names = written(nodes, "nodes"), written(nodes.select("node", F.col("node").alias("segment")), "names")
    merges, done = None, 0
    how = {"sum": F.sum, "max": F.max, "min": F.min, "union": lambda c: F.array_distinct(F.flatten(F.collect_list(c)))}

    def renamed(to: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        moved = held.join(to, held.node == to.old, "left").withColumn("node", F.coalesce("new", "node"))
        after = written(moved.groupBy("node").agg(*[how[merging.get(c, "sum")](c).alias(c) for c in state]), "nodes") if state else written(moved.select("node").distinct(), "nodes")
        return _renamed(live, to), _named(names, to), after

    at_once = hasattr(priority, "arrays") and sorted(state) == ["size", "total"] and not merging and sorted(live.columns[4:]) == ["n", "total"]
    while at_once:
        rows, many = ahead.advanced(live, held, priority.arrays, threshold)
        pairs = rows.select((F.col("round") + done).alias("round"), F.col("u").alias("left"), F.col("v").alias("right"), F.col("w").alias("weight"))
        merges = pairs if merges is None else merges.unionByName(pairs)
        live, names, held = renamed(ahead.joined(rows))
        if many == ahead.FOREVER:
            return live, held, names, merges
        done += many
        at_once = many >= 8
    while True:
        side = lambda k: held.select(F.col("node").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in state])  # noqa: E731, B023
        scored = priority(live.join(side("u"), "u").join(side("v"), "v") if state else live)
        pairs = written(_mutual(_tops(scored.where(F.col("w") < threshold)), threshold).select(F.lit(done).alias("round"), "left", "right", "weight"), "pairs")
        merges = pairs if merges is None else merges.unionByName(pairs)
        if not pairs.limit(1).count():
            return live, held, names, merges
        to = pairs.select(F.col("right").alias("old"), F.col("left").alias("new"))
        live, names, held = renamed(to)
        done += 1


def rounds(edge_table: DataFrame, nodes: DataFrame, threshold: float, most_edges: int = 20_000) -> DataFrame:
    """(node, segment) as segments(agglomerate()) gives it, ties included, whatever the size of a part."""
    return least_named(merge_rounds(*start(edge_table, nodes), threshold, most_edges)[1])


def history(edge_table: DataFrame, nodes: DataFrame, threshold: float = float("inf"), most_edges: int = 20_000) -> DataFrame:
    """(left, right, weight): all merges under the threshold.

    By weight they are in the order in which one merge at a time would make them, since a merge never makes a lower
    weight; each joins the segments of two fragments. An edge table without an edge
    under the threshold gives no row."""
    merges = merge_rounds(*start(edge_table, nodes), threshold, most_edges)[2]
    out = edge_table.sparkSession.createDataFrame([], "left long, right long, weight double")
    for m in merges:
        out = out.unionByName(m)
    return out


def first_merges(edge_table: DataFrame, nodes: DataFrame, merges: int, most_edges: int = 20_000) -> DataFrame:
    """(left, right, weight): a history() at least as far as its first so many merges.

    Merges under a threshold are the first of all merges, and what no edge under it joins needs no work. So the
    threshold rises, each time to where eight times as many edges are under it, until there are enough merges under it
    or all edges are."""
    edge_table = written(edge_table, "edges")
    weights = edge_table.select((F.col("total") / F.col("n")).alias("w"))
    many = 4 * merges
    while True:
        tops = weights.orderBy("w").limit(many).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("w")).first()
        if tops.n < many:
            return history(edge_table, nodes, most_edges=most_edges)
        log = written(history(edge_table, nodes, tops.w, most_edges), "history")
        if log.limit(merges).count() == merges:
            return log
        many *= 8


def cut_history(log: DataFrame, nodes: DataFrame, threshold: float | None = None, merges: int | None = None) -> DataFrame:
    """(node, segment) after the merges of a history() under a threshold, or after its first so many."""
    kept = log
    if threshold is not None:
        kept = kept.where(F.col("weight") < threshold)
    if merges is not None:
        kept = kept.orderBy("weight", "left", "right").limit(merges)
    return components(nodes.select("node"), kept.select(F.col("left").alias("u"), F.col("right").alias("v"))).select("node", F.col("component").alias("segment"))


def joined_by(log: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b, weight, left, right): the first merge of a history() after which two fragments are in one segment.

    The merges, as edges between the fragments that name them, are a forest, and what joins a and b is the last of those
    on the way between them; all pairs are looked up together. Null where a = b or they never meet."""
    from .trees import heaviest_between

    forest = log.select(F.least("left", "right").alias("u"), F.greatest("left", "right").alias("v"), "weight")
    out = heaviest_between(pairs.select("a", "b").distinct(), forest, ("weight",))
    return out.select("a", "b", "best.weight", F.col("best.u").alias("left"), F.col("best.v").alias("right"))


def without_merges(log: DataFrame, undone: DataFrame) -> DataFrame:
    """A history() without the merges (left, right) of a table; cut_history() of it splits what they held together."""
    return log.join(undone.select("left", "right").distinct(), ["left", "right"], "left_anti").select(log.columns)


def separate(log: DataFrame, nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """(node, segment) after a history() without the merge that first brought each pair (a, b) together.

    Each pair is apart afterwards, since merges are the edges of a forest: without one on the way no other way is left.
    Pairs that share that merge undo it once; pairs of one fragment, or never joined, undo nothing."""
    log = written(log, "log")
    undone = joined_by(log, pairs).where("left IS NOT NULL").select("left", "right")
    return cut_history(without_merges(log, undone), nodes)


def vi_history(log: DataFrame, nodes: DataFrame, table: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, under, over) along a history(): split VI of its cuts against a ground truth."""
    from .contingency import vi_by_threshold

    cuts = threshold_cuts(log.select(F.col("left").alias("u"), F.col("right").alias("v"), "weight"), nodes, thresholds)
    return vi_by_threshold(table, cuts)


def threshold_segments(edge_table: DataFrame, nodes: DataFrame, threshold: float) -> DataFrame:
    """(node, segment): the connected parts of the edges under the threshold, without new weights."""
    low = edge_table.where(F.col("total") / F.col("n") < threshold)
    return components(nodes.select("node"), low.select("u", "v")).select("node", F.col("component").alias("segment"))


def threshold_cuts(edge_table: DataFrame, nodes: DataFrame, thresholds: list[float], weight: str = "weight") -> DataFrame:
    """(threshold, node, segment): threshold_segments() at every threshold, all in the same rounds.

    edge_table has u, v and a weight, nodes are not negative. A node is known as (number of the threshold, node), packed
    into one long, so that the graphs of all thresholds settle side by side, each as fast as it alone would."""
    stride = (nodes.agg(F.max("node")).first()[0] or 0) + 1
    if len(thresholds) * stride >= 1 << 63:
        raise ValueError("too many nodes for so many thresholds")
    numbered = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("i"), F.lit(float(t)).alias("t")) for i, t in enumerate(thresholds)])).alias("c")
    all_nodes = nodes.select("node", numbered).select((F.col("c.i") * stride + F.col("node")).alias("node"))
    links = edge_table.select("u", "v", F.col(weight).alias("w"), numbered).where("w < c.t")
    parts = components(all_nodes, links.select((F.col("c.i") * stride + F.col("u")).alias("u"), (F.col("c.i") * stride + F.col("v")).alias("v")))
    threshold = F.element_at(F.array(*[F.lit(float(t)) for t in thresholds]), (F.floor(F.col("node") / stride) + 1).cast("int"))
    return parts.select(threshold.alias("threshold"), (F.col("node") % stride).alias("node"), (F.col("component") % stride).alias("segment"))


def best_segments(edge_table: DataFrame, nodes: DataFrame, assigned: DataFrame) -> DataFrame:
    """(node, segment): fragments of one ground-truth label, as far as they hang together."""
    side = lambda k: assigned.select(F.col("s").alias(k), F.col("g").alias(f"g{k}"))
    same = edge_table.join(side("u"), "u").join(side("v"), "v").where("gu = gv")
    return components(nodes.select("node"), same.select("u", "v")).select("node", F.col("component").alias("segment"))


def contract(edge_table: DataFrame, mapping: DataFrame) -> DataFrame:
    """The edge table after nodes are merged by a map (node, segment); sums of common edges add up."""
    m = lambda k: mapping.select(F.col("node").alias(k), F.col("segment").alias(f"_{k}"))
    out = edge_table.join(m("u"), "u", "left").join(m("v"), "v", "left").select(F.coalesce("_u", "u").alias("a"), F.coalesce("_v", "v").alias("b"), "n", "total")
    return out.where("a <> b").groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


def countdown(rows: DataFrame, order: str, flag: str, start: int = 1) -> DataFrame:
    """left: start less the number of true flags so far, by the order column.

    A prefix sum over ranges of the order column: each range counts by itself and adds what the ranges before it hold;
    only the one row a range is counted in a single task."""
    from pyspark.sql import Window

    ranges = written(rows.repartitionByRange(F.col(order)).withColumn("_range", F.spark_partition_id()), "ranges")
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranges.groupBy("_range").agg(F.sum(F.col(flag).cast("long")).alias("_n"))
    sums = sums.select("_range", F.sum("_n").over(earlier).alias("_before"))
    here = F.sum(F.col(flag).cast("long")).over(Window.partitionBy("_range").orderBy(order).rowsBetween(Window.unboundedPreceding, 0))
    so_far = F.coalesce(F.col("_before") + F.col("_here"), "_here", "_before")
    return ranges.withColumn("_here", here).join(F.broadcast(sums), "_range").withColumn("left", F.lit(start) - so_far).select(*rows.columns, "left")


def split_merge(log: DataFrame, component: int, f0: int, f1: int) -> DataFrame:
    """The merge of a part of the tree that first brings two fragments together: the one to undo to part them."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        up = {}
        for a, b, p in pdf[["left", "right", "parent"]].itertuples(index=False):
            up[a] = up[b] = p
        path = set()
        k = f0
        while k in up:
            k = up[k]
            path.add(k)
        k = f1
        while k in up:
            k = up[k]
            if k in path:
                return pdf[pdf.parent == k]
        return pdf[:0]

    return log.where(F.col("component") == component).groupBy("component").applyInPandas(run, LOG)
