"""The first rounds of least edges, worked out a chunk of a graph at a time, so that only what chunks share goes on.

Where every part takes its least edge to another part, a part needs to know its own edges alone. Nodes are dealt to
chunks by ranges of their numbers, and a task has all edges of its nodes; parts of such nodes go on taking edges until
they meet a node of another chunk or a labelled part. Each part's least edge is the same in whatever order parts take
theirs, so the forest is that of rounds over the whole table."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grid import written
from .search import followed

#: Edges of a chunk, about.
EDGES = 250_000
_NODE, _EDGE, _TAKEN = 0, 1, 2


def contracted(a: np.ndarray, b: np.ndarray, own_a: np.ndarray, own_b: np.ndarray, labels: bool) -> tuple:
    """Parts of a chunk's own nodes, each taking its least edge until it meets a node that isn't; edges are sorted, least first.

    (nodes, the node that names each one's part, the last edge taken by parts of it or -1, own nodes, edges taken,
    edges left, their parts a, b). Nodes under 0 are labels with ``labels``; edges between labels are none."""
    ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y, n = at[: len(a)], at[len(a) :], len(ids)
    own, label = np.zeros(n, bool), (ids < 0) & labels
    own[x[own_a]] = own[y[own_b]] = True
    part, edge, rounds, taken = np.arange(n), np.arange(len(a)), [], []
    while True:
        apart = (x != y) & ~(label[x] & label[y])
        x, y, edge = x[apart], y[apart], edge[apart]
        best = np.full(n, len(edge))
        # The last one written stays, so the least edge.
        best[x[::-1]] = np.arange(len(edge))[::-1]
        other = np.full(n, len(edge))
        other[y[::-1]] = np.arange(len(edge))[::-1]
        best = np.minimum(best, other)
        goes = np.flatnonzero(own & (best < len(edge)))
        if not len(goes):
            break
        e = best[goes]
        to = np.where(x[e] == goes, y[e], x[e])
        into = np.arange(n)
        into[goes] = to
        ends = (into[to] == goes) & (goes < to)  # of two that take one edge the lesser stays
        into[goes[ends]] = goes[ends]
        while (into != (beyond := into[into])).any():
            into = beyond
        rounds.append((goes, edge[e], into[goes]))
        taken.append(edge[e])
        own[goes] &= into[goes] == goes
        part, x, y = into[part], into[x], into[y]
    last = np.full(n, -1)
    for goes, e, into in reversed(rounds):
        last[goes] = np.maximum(e, last[into])
    lo, hi = np.minimum(x, y), np.maximum(x, y)
    _, first = np.unique(lo * n + hi, return_index=True)  # the least edge of each two parts
    mine = np.zeros(n, bool)
    mine[at[: len(a)][own_a]] = mine[at[len(a) :][own_b]] = True
    taken = np.unique(np.concatenate(taken)) if taken else np.zeros(0, np.int64)
    return ids, ids[part], last, mine, taken, edge[first], ids[lo[first]], ids[hi[first]]


def settled(live: DataFrame, labels: bool, chunk: int = EDGES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What chunks settle of live (a, b, e), e a struct of the columns by which edges are ordered:
    (steps (part, height, into) of all nodes but labels, live edges between what is left, edges taken).

    height is the first column of the last edge that parts of a node took, null where none did. A node that has a
    large share of all edges is in no chunk."""
    fields = [f.name for f in live.schema["e"].dataType.fields]
    many = max(1, live.count() // chunk + 1)
    ends = live.select(F.explode(F.array("a", "b")).alias("node"))
    ends = ends.where("node >= 0") if labels else ends
    inner, heavy = [], []
    if many > 1:
        # Where to cut only decides who works out what.
        some = ends.sample(min(1.0, 1000 / chunk), seed=1).select(F.col("node").cast("double").alias("node"))
        cuts = some.approxQuantile("node", [i / many for i in range(1, many)], 0.2 / many)
        inner = sorted(set(cuts))
        heavy = sorted({int(c) for c, d in zip(cuts, cuts[1:], strict=False) if c == d})
    rows = live.select("a", "b", "e")
    for k in "ab":
        none = F.col(k).isin(heavy) if heavy else F.lit(False)
        if labels:
            none |= F.col(k) < 0
        rows = rows.withColumn(f"_{k}", F.col(k).cast("double"))
        if inner:
            rows = Bucketizer(splits=[-float("inf"), *inner, float("inf")], inputCol=f"_{k}", outputCol=f"c{k}").transform(rows)
        else:
            rows = rows.withColumn(f"c{k}", F.lit(0.0))
        rows = rows.withColumn(f"c{k}", F.when(none, -1).otherwise(F.col(f"c{k}")).cast("int"))
    columns = ["a", "b", *[f"e{i}" for i in range(len(fields))]]
    rows = rows.select("a", "b", *[F.col(f"e.{f}").alias(f"e{i}") for i, f in enumerate(fields)], "ca", "cb")
    dealt = rows.withColumn("c", F.explode(F.array_distinct(F.array("ca", "cb")))).where("c >= 0")
    schema = rows.select(F.lit(0).alias("kind"), *columns).schema
    for f in schema.fields:
        f.nullable = True

    def run(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        got = {c: table.column(c).to_numpy() for c in table.column_names}
        order = np.lexsort([got[c] for c in reversed(columns[2:])])
        a, b, c = got["a"][order], got["b"][order], got["c"][0]
        nodes, part, last, mine, taken, left, x, y = contracted(a, b, got["ca"][order] == c, got["cb"][order] == c, labels)
        keys = [table.column(name).combine_chunks() for name in columns[2:]]
        none = lambda k: pa.nulls(k, pa.int64())
        height = keys[0].take(pa.array(np.where(last[mine] >= 0, order[last[mine]], -1), mask=last[mine] < 0))
        out = [
            [np.full(mine.sum(), _NODE, np.int32), nodes[mine], part[mine], height, *[k.take(none(mine.sum())) for k in keys[1:]]],
            [np.full(len(left), _EDGE, np.int32), x, y, *[k.take(pa.array(order[left])) for k in keys]],
            [np.full(len(taken), _TAKEN, np.int32), none(len(taken)), none(len(taken)), *[k.take(pa.array(order[taken])) for k in keys]],
        ]
        return pa.concat_tables([pa.Table.from_arrays([k if isinstance(k, pa.Array) else pa.array(k) for k in o], names=["kind", *columns]) for o in out])

    out = written(dealt.groupBy("c").applyInArrow(run, schema), "settled")
    e = F.struct(*[F.col(f"e{i}").alias(f) for i, f in enumerate(fields)]).alias("e")
    tops = out.where(F.col("kind") == _NODE).select(F.col("a").alias("part"), F.col("b").alias("to"), F.col("e0").alias("height"))
    if heavy:
        alone = live.sparkSession.createDataFrame([(h,) for h in heavy], "part long")
        tops = written(tops.union(alone.select("part", F.col("part").alias("to"), F.lit(None).alias("height"))), "tops")
    # Nodes at which other chunks' parts stop lead on to where their own part does; of two that meet on one edge the lesser stays.
    at = tops.where("part <> to" + (" AND to >= 0" if labels else "")).select(F.col("to").alias("part")).distinct()
    ways = written(tops.join(at, "part", "left_semi").select("part", "to"), "ways")
    back = ways.select(F.col("part").alias("to"), F.col("to").alias("_back"))
    ways = ways.join(back, "to", "left").select(F.col("part").alias("idx"), F.when((F.col("_back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("to"))
    ways = written(ways, "ways")
    ways = ways.union(ways.select("to").join(ways.select(F.col("idx").alias("to")), "to", "left_anti").distinct().select("to", F.col("to").alias("_to")))
    met = written(followed(ways), "met")
    steps = tops.join(met.select(F.col("idx").alias("to"), F.col("to").alias("_to")), "to", "left")
    own_way = F.coalesce("_to", "to")
    steps = written(steps.select("part", "height", own_way.alias("into")), "steps")
    rest = out.where(F.col("kind") == _EDGE).select("a", "b", e).union(rows.where("ca < 0 AND cb < 0").select("a", "b", e))
    into = lambda k: steps.select(F.col("part").alias(k), F.col("into").alias(f"_{k}"))
    rest = rest.join(into("a"), "a", "left").join(into("b"), "b", "left").select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "e")
    return steps, rest, out.where(F.col("kind") == _TAKEN).select(e)
