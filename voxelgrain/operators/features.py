"""Feature lists of nodes and edges: moments, histograms with percentiles, neighbourhoods, and how two nodes differ.

All but the neighbourhoods follow from sums that merge by addition, so a merged node's features need no voxels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import rag
from .grid import written
from .rag import let


def shares(counts: Column) -> Column:
    """A histogram's counts as shares of their sum; an empty one stays empty."""
    total = F.aggregate(counts, F.lit(0).cast("long"), lambda a, x: a + x)
    return let(total, lambda t: F.transform(counts, lambda x: x / F.greatest(t, F.lit(1))))


def percentiles(counts: Column, wanted: tuple[float, ...], lo: float, hi: float, bins: int) -> Column:
    """The wanted percentiles of a histogram of equal bins, linear within a bin; lo where it is empty.

    A percentile lies in the first bin up to whose end that share of the counts is reached, in the middle of that bin
    if it holds none."""
    step = (hi - lo) / bins
    start = F.array(F.lit(0).cast("long"))
    sums = F.slice(F.aggregate(counts, start, lambda a, x: F.concat(a, F.array(F.element_at(a, -1) + x))), 2, bins)

    def one(upto: Column, p: float) -> Column:
        found = F.array_position(F.transform(upto, lambda c: c >= p), True)
        return let(F.when(found > 0, found).otherwise(bins).cast("int"), lambda at: within(upto, p, at))

    def within(upto: Column, p: float, at: Column) -> Column:
        before = F.when(at > 1, F.element_at(upto, F.greatest(at - 1, F.lit(1)))).otherwise(0.0)
        held, left = F.element_at(upto, at) - before, F.lit(lo) + (at - 1) * step
        return F.when(held == 0, left + step / 2).otherwise(left + step * (p - before) / held)

    def all_of(sums: Column) -> Column:
        total = F.element_at(sums, -1)
        upto = let(total, lambda t: F.transform(sums, lambda c: c / t))
        return F.when(total == 0, F.array(*[F.lit(float(lo)) for _ in wanted])).otherwise(let(upto, lambda u: F.array(*[one(u, p) for p in wanted])))

    return let(sums, all_of)


def moment_features(sums: DataFrame, keys: list[str], moments: int = 4, root: bool = False) -> DataFrame:
    """keys and moments, an array of the count, the mean and the central moments from the second on; with root, the
    k-th root of each, signed."""
    out = rag.central_moments(sums, moments)
    parts = [F.col("n"), F.col("mean"), *[F.col(f"c{k}") for k in range(2, moments + 1)]]
    if root:
        parts = [p if i < 2 else rag.ith_root(p, i) for i, p in enumerate(parts)]
    return out.select(*keys, F.array(*parts).alias("moments"))


def described(rows: DataFrame, keys: list[str], value: str, bins: int, lo: float, hi: float, wanted: tuple[float, ...], moments: int = 4, root: bool = False) -> DataFrame:
    """keys, moments, h and features (moments, shares, percentiles) of the rows of each key."""
    sums = rows.withColumn("_b", rag.bin_of(value, bins, lo, hi)).groupBy(*keys)
    sums = sums.agg(*rag.power_sums(F.col(value).cast("double"), moments), rag.bin_counts(bins).alias("h"))
    out = moment_features(sums, [*keys, "h"], moments, root).select(*keys, "moments", "h")
    return out.withColumn("features", F.concat("moments", shares(F.col("h")), percentiles(F.col("h"), wanted, lo, hi, bins)))


def difference_features(m1: Column, m2: Column, h1: Column, h2: Column) -> Column:
    """How far the moments of two nodes are apart, and the divergence of their histograms, in nats."""
    return F.concat(F.zip_with(m1, m2, lambda a, b: F.abs(a - b)), F.array(rag.js_divergence(shares(h1), shares(h2))))


def edge_features(voxels: DataFrame, boundary: DataFrame, value: str = "cents", bins: int = 25, lo: float = 0.0, hi: float = 1.0, wanted: tuple[float, ...] = (0.1, 0.5, 0.9), label: str = "label", moments: int = 4, root: bool = False, neighbours: bool = True, extra: DataFrame | None = None) -> DataFrame:
    """(u, v, features) of each edge: the features of the smaller node, of the larger, of the edge, their differences.

    A node's features are its moments, the shares of its histogram and its percentiles, and with ``neighbours`` its
    degree and the mean degree of its neighbours, of which the differences are added; an edge's also how many
    neighbours its ends have in common. ``extra`` (u, v, array extra) is appended. Of
    nodes of one size the one with the lower id is first."""
    node = described(voxels, [label], value, bins, lo, hi, wanted, moments, root).join(voxels.groupBy(label).agg(F.count(F.lit(1)).alias("size")), label)
    edge = written(described(boundary, ["u", "v"], value, bins, lo, hi, wanted, moments, root).select("u", "v", F.col("features").alias("own")), "own")
    pairs = edge.select("u", "v")
    if neighbours:
        degree = F.array(F.col("degree").cast("double"), F.col("neighbour_degree_sum") / F.col("degree"))
        node = node.join(rag.degrees(pairs).select(F.col("node").alias(label), degree.alias("graph")), label)
        node = node.withColumn("features", F.concat("features", "graph"))
        edge = edge.join(rag.common_neighbours(pairs), ["u", "v"]).withColumn("own", F.concat("own", F.array(F.col("common").cast("double"))))
    node = written(node, "nodes")
    columns = ["size", "moments", "h", "features", *(["graph"] if neighbours else [])]
    side = lambda k: node.select(F.col(label).alias(k), *[F.col(c).alias(f"{c}_{k}") for c in columns])
    e = edge.join(side("u"), "u").join(side("v"), "v")
    first = F.col("size_u") <= F.col("size_v")
    both = [F.when(first, F.col("features_u")).otherwise(F.col("features_v")), F.when(first, F.col("features_v")).otherwise(F.col("features_u"))]
    parts = [*both, F.col("own"), difference_features(F.col("moments_u"), F.col("moments_v"), F.col("h_u"), F.col("h_v"))]
    if neighbours:
        sign = F.when(first, 1.0).otherwise(-1.0)
        parts.append(F.zip_with("graph_u", "graph_v", lambda a, b: sign * (a - b)))
    if extra is not None:
        e = e.join(extra, ["u", "v"])
        parts.append(F.col("extra"))
    return e.select("u", "v", F.concat(*parts).alias("features"))


#: Options of edge_features() by the name of a feature list.
PRESETS = {"paper_em": {"bins": 25, "lo": 0.0, "hi": 1.0, "wanted": (0.1, 0.5, 0.9)}}
