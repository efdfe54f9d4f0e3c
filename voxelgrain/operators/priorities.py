"""Merge priorities: columns over an edge table. Infinity forbids a merge."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

INFINITY = float("inf")


def boundary_mean() -> Column:
    return F.col("total") / F.col("n")


def boundary_median(boundary: DataFrame, value: str = "cents") -> DataFrame:
    """(u, v, weight): exact medians need the voxels themselves."""
    return boundary.groupBy("u", "v").agg(F.percentile(value, 0.5).alias("weight"))


def mean_plus_sem(boundary: DataFrame, value: str = "cents", alpha: float = -6.0) -> DataFrame:
    return boundary.groupBy("u", "v").agg((F.avg(value) + alpha * F.stddev_samp(value) / F.sqrt(F.count(value))).alias("weight"))


def mean_weight(edges: DataFrame) -> DataFrame:
    """w, the mean of an edge's boundary, from the sums n and total."""
    return edges.withColumn("w", boundary_mean())


mean_weight.arrays = lambda e: e["total"] / e["n"]


def sem_weight(edges: DataFrame, alpha: float = -6.0) -> DataFrame:
    """w, the mean plus alpha standard errors, from the sums n, total and squares; null for an edge of one voxel."""
    mean = boundary_mean()
    variance = F.greatest(F.lit(0.0), F.col("squares") - mean * F.col("total")) / F.nullif(F.col("n") - 1, F.lit(0))
    return edges.withColumn("w", mean + alpha * F.sqrt(variance / F.col("n")))


def ladder_weight(edges: DataFrame, threshold: int, strictness: int = 1) -> DataFrame:
    """w, the mean where an end is below the threshold in u_size, v_size; null elsewhere. Strictness as in ladder()."""
    small_u, small_v = F.col("u_size") < threshold, F.col("v_size") < threshold
    ok = (small_u != small_v) if strictness >= 2 else small_u | small_v
    if strictness >= 3:
        ok = ok & (F.col("n") > 2)
    return edges.withColumn("w", F.when(ok, boundary_mean()))


def barred_weight(edges: DataFrame) -> DataFrame:
    """w, the mean where neither end is frozen (u_frozen, v_frozen) and their exclusions have nothing in common; else null."""
    free = F.lit(True)
    if "u_frozen" in edges.columns:
        free = free & (F.col("u_frozen") == 0) & (F.col("v_frozen") == 0)
    if "u_exclusions" in edges.columns:
        free = free & ~F.arrays_overlap("u_exclusions", "v_exclusions")
    return edges.withColumn("w", F.when(free, boundary_mean()))


def ladder(edge_table: DataFrame, nodes: DataFrame, weight: Column, threshold: int, strictness: int = 1, at_boundary: DataFrame | None = None) -> DataFrame:
    """The weight where a node below the threshold, not at the boundary, is at hand; else infinity.

    From strictness 2 on exactly one of the two is below it; from 3 on the edge has more than two voxels."""
    size = lambda k, a: nodes.select(F.col("node").alias(k), F.col("size").alias(a))
    e = edge_table.join(size("u", "su"), "u").join(size("v", "sv"), "v")
    for k, a in (("u", "bu"), ("v", "bv")):
        if at_boundary is None:
            e = e.withColumn(a, F.lit(False))
        else:
            e = e.join(at_boundary.select(F.col("node").alias(k), F.lit(True).alias(a)), k, "left").withColumn(a, F.coalesce(a, F.lit(False)))
    small_u, small_v = F.col("su") < threshold, F.col("sv") < threshold
    ok = (small_u & ~F.col("bu")) | (small_v & ~F.col("bv"))
    if strictness >= 2:
        ok = ok & (small_u != small_v)
    if strictness >= 3:
        ok = ok & (F.col("n") > 2)
    return e.select("u", "v", F.when(ok, weight).otherwise(INFINITY).alias("weight"))


def without_frozen(edge_table: DataFrame, frozen_nodes: DataFrame, weight: str = "weight") -> DataFrame:
    """Infinity where either end is frozen."""
    f = lambda k: frozen_nodes.select(F.col("node").alias(k), F.lit(True).alias(f"_{k}"))
    out = edge_table.join(f("u"), "u", "left").join(f("v"), "v", "left")
    return out.withColumn(weight, F.when(F.col("_u") | F.col("_v"), INFINITY).otherwise(F.col(weight))).drop("_u", "_v")


def local_vi_change(s1: Column, s2: Column, n: Column | int) -> Column:
    p1, p2 = s1 / n, s2 / n
    return -(p1 * F.log2(p1) + p2 * F.log2(p2) - (p1 + p2) * F.log2(p1 + p2))


def local_rand_change(s1: Column, s2: Column, n: Column | int) -> Column:
    return s1 * s2 / (n * (n - F.lit(1)) / 2)


def true_deltas(edge_table: DataFrame, table: DataFrame) -> DataFrame:
    """(u, v, s1, s2, cells, shared, total): what the change of VI and Rand by merging u and v follows from.

    cells is the sum over g of xlogx(r1 + r2) - xlogx(r1) - xlogx(r2) and shared that of r1 x r2, both from the labels
    that the two have in common; other labels add nothing. Total counts all positions."""
    e = edge_table.select("u", "v")
    r1 = table.select(F.col("s").alias("u"), "g", F.col("n").alias("r1"))
    r2 = table.select(F.col("s").alias("v"), "g", F.col("n").alias("r2"))
    lg = lambda x: x * F.log2(x)
    both = e.join(r1, "u").join(r2, ["v", "g"]).groupBy("u", "v").agg(F.sum(lg(F.col("r1") + F.col("r2")) - lg(F.col("r1")) - lg(F.col("r2"))).alias("cells"), F.sum(F.col("r1") * F.col("r2")).alias("shared"))
    size = table.groupBy("s").agg(F.sum("n").alias("x"))
    out = e.join(both, ["u", "v"], "left").join(size.select(F.col("s").alias("u"), F.col("x").alias("s1")), "u").join(size.select(F.col("s").alias("v"), F.col("x").alias("s2")), "v")
    total = table.agg(F.sum("n").alias("total"))
    return out.crossJoin(F.broadcast(total)).na.fill({"cells": 0.0, "shared": 0})


def true_delta_vi(edge_table: DataFrame, table: DataFrame) -> DataFrame:
    lg = lambda x: x * F.log2(x)
    s1, s2 = F.col("s1"), F.col("s2")
    return true_deltas(edge_table, table).select("u", "v", ((lg(s1 + s2) - lg(s1) - lg(s2) - 2 * F.col("cells")) / F.col("total")).alias("delta_vi"))


def true_delta_rand(edge_table: DataFrame, table: DataFrame) -> DataFrame:
    t = F.col("total")
    return true_deltas(edge_table, table).select("u", "v", ((2 * F.col("shared") - F.col("s1") * F.col("s2")) / (t * (t - 1) / 2)).alias("delta_rand"))


def mito_merge(edge_table: DataFrame, nodes: DataFrame, frozen_nodes: DataFrame) -> DataFrame:
    """(u, v, weight): for edges with exactly one frozen end that is not the larger, 1 - the edge's share of the frozen end's whole boundary."""
    from .rag import both_ways

    length = both_ways(edge_table.select("u", "v", "n")).groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("length"))
    info = nodes.select("node", "size").join(length, "node").join(frozen_nodes.select("node", F.lit(True).alias("frozen")), "node", "left").na.fill({"frozen": False})
    side = lambda k: info.select(F.col("node").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in ("size", "length", "frozen")])
    e = edge_table.join(side("u"), "u").join(side("v"), "v")
    u_ok = F.col("frozen_u") & ~F.col("frozen_v") & (F.col("size_u") <= F.col("size_v"))
    v_ok = F.col("frozen_v") & ~F.col("frozen_u") & (F.col("size_v") <= F.col("size_u"))
    w = F.when(u_ok, 1 - F.col("n") / F.col("length_u")).when(v_ok, 1 - F.col("n") / F.col("length_v")).otherwise(INFINITY)
    return e.select("u", "v", w.alias("weight"))


def expected_change(edge_table: DataFrame, nodes: DataFrame, probability: str = "p", measure: str = "vi", alpha: float = 1.0, beta: float = 1.0) -> DataFrame:
    """edge_table with a weight: the expected change of VI or Rand by a merge, where the column ``probability`` tells that
    the two should stay apart. alpha weighs a false merge, beta a missed one; nodes has (node, size)."""
    change = {"vi": local_vi_change, "rand": local_rand_change}[measure]
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("size").cast("double").alias(f"_{k}"))
    whole = nodes.agg(F.sum("size").cast("double").alias("_all"))  # one row
    rows = edge_table.join(side("u"), "u").join(side("v"), "v").crossJoin(F.broadcast(whole))
    c, p = change(F.col("_u"), F.col("_v"), F.col("_all")), F.col(probability)
    return rows.withColumn("weight", p * alpha * c - (1 - p) * beta * c).drop("_u", "_v", "_all")


def ordered(edge_table: DataFrame, listed: DataFrame, order: list) -> DataFrame:
    """(u, v, weight): the place of an edge in a list (u, v in either order, and columns to order by) from 0 up to but not
    1, infinity where it isn't listed. An edge listed more than once counts at its last place."""
    from .grid import ranked

    placed = ranked(listed, order, "_place")
    whole = listed.agg(F.count(F.lit(1)).alias("_all"))  # one row
    at = placed.groupBy(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).agg(F.max("_place").alias("_place"))
    at = at.crossJoin(F.broadcast(whole)).select("u", "v", ((F.col("_place") - 1) / F.col("_all")).alias("_w"))
    return edge_table.select("u", "v").join(at, ["u", "v"], "left").select("u", "v", F.coalesce("_w", F.lit(INFINITY)).alias("weight"))
