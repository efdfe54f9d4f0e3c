"""Many rounds of merges by a priority, worked out ahead in chunks of a graph, as rounds over the whole table make them.

What a round does to a node follows from the node's edges and those of the other end of its best edge. So a task that has
some nodes with all their edges knows what becomes of them, except near nodes that it hasn't: those are dark, and each
round the dark spreads to what may depend on them. Chunks overlap, and each tells for how many rounds it knew all of its own
nodes; so many rounds are made at once. The state after them is exact, however near the dark came."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import components, written

#: Edges of a chunk, about, without what it shares with its neighbours.
EDGES = 100_000
#: Ranges of nodes that make up a chunk, and how many more on each side it has to look at.
_PIECES, _MORE = 4, 2
#: Rounds of a chunk in which nothing is left to do at all.
FOREVER = (1 << 31) - 1
SCHEMA = "round int, u long, v long, w double, label int, features array<double>"


def _first(x: np.ndarray, y: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the first edge that has it as an end, or how many edges there are."""
    best = [np.full(n, len(x)), np.full(n, len(x))]
    for b, end in zip(best, (x, y), strict=True):
        b[end[::-1]] = np.arange(len(x))[::-1]  # the last one written stays
    return np.minimum(*best)


def _summed(keys: list[np.ndarray], sums: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Of rows equal in the first two keys (the last one in the order of all keys, the sums)."""
    order = np.lexsort(keys[::-1])
    a, b = keys[0][order], keys[1][order]
    starts = np.flatnonzero(np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, np.int64)
    last = order[np.r_[starts[1:] - 1, len(a) - 1]] if len(a) else order
    return last, [np.add.reduceat(s[order], starts) if len(a) else s for s in sums]


def rounds_ahead(edges: dict, cells: tuple | None, around: tuple[int, int], mine: tuple[int, int], weigh, threshold: float, features=None) -> tuple[int, list[tuple]]:
    """(rounds known, rows (round, u, v, w, label, features)) of one chunk.

    edges are arrays u, v (u < v), tu, tv, n, total, apart, the size and total of both ends (u_size, ...), and the range of
    nodes that either lies in (u_piece, v_piece). Nodes in the ranges ``around`` have all their edges here, those in
    ``mine`` are the chunk's own. With cells (s, g, n) edges are judged as learning.epoch() does, else all that meet merge (-1)."""
    ids, at = np.unique(np.concatenate([edges["u"], edges["v"]]), return_inverse=True)
    many = len(edges["u"])
    x, y, size = at[:many], at[many:], len(ids)
    piece, held = np.empty(size, np.int64), {}
    piece[x], piece[y] = edges["u_piece"], edges["v_piece"]
    for c in ("size", "total"):
        held[c] = np.empty(size, edges[f"u_{c}"].dtype)
        held[c][x], held[c][y] = edges[f"u_{c}"], edges[f"v_{c}"]
    dark = (piece < around[0]) | (piece > around[1])
    mine = (piece >= mine[0]) & (piece <= mine[1])
    own = mine.copy()  # segments with a node of the chunk's own
    tu, tv, n, total, apart = (edges[c] for c in ("tu", "tv", "n", "total", "apart"))
    if cells is not None:
        known = np.isin(cells[0], ids)
        s, g, share = np.searchsorted(ids, cells[0][known]), cells[1][known], cells[2][known]
    rows, now, changed, busy = [], 0, True, 0
    while True:
        if changed:
            free = apart == 0
            lit = np.flatnonzero(free & ~dark[x] & ~dark[y])
            state = {"n": n[lit], "total": total[lit], **{f"{k}_{c}": held[c][e[lit]] for k, e in (("u", x), ("v", y)) for c in held}}
            w = weigh(state)
            under = w < threshold
            lit, w = lit[under], w[under]
            order = np.lexsort((tv[lit], tu[lit], w))
            lit, w = lit[order], w[order]
            best = _first(x[lit], y[lit], size)
        # Nodes that an edge joins to the dark may merge with it, and so may what waits for such a node.
        unsure = dark.copy()
        unsure[x[free & dark[y]]] = unsure[y[free & dark[x]]] = True
        has = np.flatnonzero(~unsure & (best < len(lit)))
        e = lit[best[has]]
        later = unsure.copy()
        later[has] = unsure[np.where(x[e] == has, y[e], x[e])]
        if later[own].any():
            return now, rows
        at = np.arange(len(lit))
        met = (best[x[lit]] == at) & (best[y[lit]] == at) & ~unsure[x[lit]] & ~unsure[y[lit]]
        e, met_w = lit[met], w[met]
        label = np.full(len(e), -1)
        if cells is not None:
            top = np.lexsort((-g, share, s))
            to = np.full(size, -1)
            to[s[top]] = np.arange(len(top))  # an index into top, the last of each s
            judged = (to[x[e]] >= 0) & (to[y[e]] >= 0)
            e, met_w = e[judged], met_w[judged]
            gx, gy = g[top[to[x[e]]]], g[top[to[y[e]]]]
            label = np.where(gx == gy, -1, 1)
        if not len(e):
            if (later == dark).all():
                return FOREVER, rows
            if now > 2 * busy + 64:
                return now + 1, rows
            now, dark, changed = now + 1, later, False
            continue
        busy = now
        told = np.flatnonzero(mine[x[e]])
        state = {"n": n[e], "total": total[e], **{f"{k}_{c}": held[c][end[e]] for k, end in (("u", x), ("v", y)) for c in held}}
        wide = features(state)[told].tolist() if features is not None else [None] * len(told)
        rows += zip([now] * len(told), ids[x[e[told]]].tolist(), ids[y[e[told]]].tolist(), met_w[told].tolist(), label[told].tolist(), wide, strict=True)
        apart = apart.copy()
        apart[e[label == 1]] = 1
        joined = e[label == -1]
        stays, goes = x[joined], y[joined]
        for c in held:
            held[c][stays] += held[c][goes]
        own[stays] |= own[goes]
        own[goes] = False
        into = np.arange(size)
        into[goes] = stays
        dark = later
        a, b = into[x], into[y]
        kept = np.flatnonzero((a != b) & ~(dark[a] & dark[b]))
        a, b = a[kept], b[kept]
        x, y = np.minimum(a, b), np.maximum(a, b)
        last, (n, total, apart) = _summed([x, y, tu[kept], tv[kept]], [n[kept], total[kept], apart[kept]])
        x, y, tu, tv, apart = x[last], y[last], tu[kept][last], tv[kept][last], np.minimum(apart, 1)
        if cells is not None:
            last, (share,) = _summed([into[s], g], [share])
            s, g = into[s][last], g[last]
        now, changed = now + 1, True


def advanced(live: DataFrame, held: DataFrame, weigh, threshold: float, cells: DataFrame | None = None, features=None, chunk: int = EDGES) -> tuple[DataFrame, int]:
    """(rows as SCHEMA, rounds): what so many rounds from this state on do; FOREVER where nothing is left after them.

    live has (u, v, tu, tv, n, total) and with cells ``apart``, held (node, size, total), cells (s, g, n). weigh() and
    features() take arrays n, total, u_size, u_total, v_size, v_total."""
    many = max(1, live.count() // chunk + 1)
    inner = []
    if many > 1:
        # Where to cut only decides who works out what.
        ends = live.select(F.explode(F.array(*[F.col(k).cast("double") for k in "uv"])).alias("node")).sample(min(1.0, 1000 / chunk), seed=1)
        inner = sorted(set(ends.approxQuantile("node", [i / (_PIECES * many) for i in range(1, _PIECES * many)], 0.05 / many)))
    many = len(inner) // _PIECES + 1

    def placed(df: DataFrame, node: str, to: str) -> DataFrame:
        df = df.withColumn("_at", F.col(node).cast("double"))
        df = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol="_at", outputCol=to).transform(df) if inner else df.withColumn(to, F.lit(0.0))
        return df.withColumn(to, F.col(to).cast("int")).drop("_at")

    def seen(*pieces: str):
        lo = lambda p: F.greatest(F.lit(0), F.floor((F.col(p) - _MORE) / _PIECES).cast("int"))
        hi = lambda p: F.least(F.lit(many - 1), F.floor((F.col(p) + _MORE) / _PIECES).cast("int"))
        return F.explode(F.array_distinct(F.concat(*[F.sequence(lo(p), hi(p)) for p in pieces]))).alias("c")

    side = lambda k: held.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("total").alias(f"{k}_total"))
    rows = live if "apart" in live.columns else live.withColumn("apart", F.lit(0))
    rows = rows.withColumn("apart", F.col("apart").cast("long")).join(side("u"), "u").join(side("v"), "v")
    rows = placed(placed(rows, "u", "u_piece"), "v", "v_piece")
    rows = rows.select("*", seen("u_piece", "v_piece"))
    judge = cells is not None
    truth = placed(cells if judge else live.sparkSession.createDataFrame([], "s long, g long, n long"), "s", "piece")
    truth = truth.select("s", "g", "n", seen("piece"))

    def run(table: pa.Table, cell: pa.Table) -> pa.Table:
        got = {c: table.column(c).to_numpy() for c in table.column_names}
        known, out = 0, []
        if any(table.column(c).null_count for c in table.column_names) or any(cell.column(c).null_count for c in cell.column_names):
            known = 0  # null sums and labels are left to rounds over the table
        elif table.num_rows:
            c = int(got.pop("c")[0])
            first, last = c * _PIECES, c * _PIECES + _PIECES - 1
            held = tuple(cell.column(k).to_numpy() for k in ("s", "g", "n")) if judge else None
            with np.errstate(all="ignore"):
                known, out = rounds_ahead(got, held, (first - _MORE, last + _MORE), (first, last), weigh, threshold, features)
        else:
            known = FOREVER  # cells of nodes without edges
        out.append((known, None, None, None, None, None))
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.list_(pa.float64())]
        return pa.Table.from_arrays([pa.array(k, t) for k, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])

    out = written(rows.groupBy("c").cogroup(truth.groupBy("c")).applyInArrow(run, SCHEMA), "ahead")
    rounds = out.where("u IS NULL").agg(F.min("round")).first()[0]
    rounds = FOREVER if rounds is None else rounds
    rows = out.where(F.col("u").isNotNull() & (F.col("round") < rounds))
    # A round in which nothing happens anywhere is the last one.
    last = rows.agg(F.coalesce(F.max("round"), F.lit(-1))).first()[0]
    return rows, FOREVER if last + 1 < rounds else rounds


def joined(rows: DataFrame) -> DataFrame:
    """(old, new): what the merges of advanced() rename; segments take the name of their least node."""
    links = written(rows.where("label < 0").select("u", "v"), "links")
    parts = components(links.select(F.explode(F.array("u", "v")).alias("node")).distinct(), links, within=True)
    return parts.where("node <> component").select(F.col("node").alias("old"), F.col("component").alias("new"))
