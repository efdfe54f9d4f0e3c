"""From a labelled volume to segments, and from blocks to one volume."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agglomeration, rag
from ..operators.grid import AXES, components


@dataclass(frozen=True)
class Options:
    thresholds: tuple[float, ...] = (0.1, 0.2)
    value: str = "cents"
    label: str = "label"
    connectivity: int = 1
    axes: tuple[str, ...] = ("y", "x")

    def __post_init__(self):
        if not self.thresholds or sorted(self.thresholds) != list(self.thresholds):
            raise ValueError("thresholds must rise")
        if not 1 <= self.connectivity <= len(self.axes):
            raise ValueError("connectivity is from 1 to the number of axes")


def segment(voxels: DataFrame, options: Options) -> DataFrame:
    """(threshold, node, segment): one agglomeration in rounds up to the last threshold, which stops at each of them."""
    boundary = rag.boundary_voxels(voxels, keep=("idx", options.value), label=options.label, axes=options.axes, connectivity=options.connectivity)
    live, names = agglomeration.start(rag.edges(boundary, options.value), rag.nodes(voxels, options.label))
    out = None
    for t in options.thresholds:
        live, names, _ = agglomeration.merge_rounds(live, names, t)
        cut = agglomeration.least_named(names).select(F.lit(float(t)).alias("threshold"), "node", "segment")
        out = cut if out is None else out.union(cut)
    return out


def adjacent_blocks(blocks: DataFrame) -> DataFrame:
    """(a, b, axis): blocks (block, lo, hi arrays, hi included) that touch: next to each other on one axis, overlapping on the others.

    An equi-join on the touching faces and, on the other two axes, on cells as wide as the widest block: blocks that
    overlap start in the same cell or in neighbouring ones. Both sides are all the blocks, so both are shuffled: none is
    broadcast by way of the driver, however small a few narrow columns look in a plan."""
    lo, hi = [f"lo{i}" for i in range(3)], [f"hi{i}" for i in range(3)]
    flat = blocks.select("block", *[F.element_at("lo", i + 1).alias(lo[i]) for i in range(3)], *[F.element_at("hi", i + 1).alias(hi[i]) for i in range(3)])
    wide = flat.agg(*[F.max(F.col(hi[i]) - F.col(lo[i]) + 1) for i in range(3)]).first()
    cell = [F.floor(F.col(lo[i]) / max(1, wide[i] or 1)) for i in range(3)]
    out = None
    for axis in range(3):
        i, j = (k for k in range(3) if k != axis)
        around = F.explode(F.array(*[F.struct(F.lit(p).alias("p"), F.lit(q).alias("q")) for p in (-1, 0, 1) for q in (-1, 0, 1)]))
        a = flat.withColumn("s", around).select(F.col("block").alias("a"), (F.col(hi[axis]) + 1).alias("touch"), (cell[i] + F.col("s.p")).alias("ci"), (cell[j] + F.col("s.q")).alias("cj"), *[F.col(c).alias(f"a_{c}") for c in lo + hi])
        b = flat.select(F.col("block").alias("b"), F.col(lo[axis]).alias("touch"), cell[i].alias("ci"), cell[j].alias("cj"), *[F.col(c).alias(f"b_{c}") for c in lo + hi])
        pairs = a.join(b.hint("merge"), ["touch", "ci", "cj"])
        for k in (i, j):
            pairs = pairs.where((F.col(f"a_hi{k}") >= F.col(f"b_lo{k}")) & (F.col(f"b_hi{k}") >= F.col(f"a_lo{k}")))
        pairs = pairs.select("a", "b", F.lit(axis).alias("axis"))
        out = pairs if out is None else out.union(pairs)
    return out


def stitch(voxels: DataFrame, axis: str, least_overlap: float = 0.5) -> DataFrame:
    """(label, stitched): labels of blocks (column block) joined across the faces on one axis.

    Blocks are boxes, so only the voxels of their first and last planes on the axis are shuffled. Face voxels side by
    side in different blocks are counted by label pair; a pair joins if it is at least the given share of the smaller
    of the two faces. Labels are unique over all blocks; joined ones take the least."""
    ends = voxels.groupBy("block").agg(F.min(axis).alias("_lo"), F.max(axis).alias("_hi"))
    flat = voxels.join(ends, "block").where((F.col(axis) == F.col("_lo")) | (F.col(axis) == F.col("_hi")))
    here = flat.where(F.col(axis) == F.col("_hi")).select(*AXES, F.col("block").alias("ba"), F.col("label").alias("u"))
    there = flat.where(F.col(axis) == F.col("_lo")).select(*[(F.col(a) - (1 if a == axis else 0)).alias(a) for a in AXES], F.col("block").alias("bb"), F.col("label").alias("v"))
    touching = here.join(there, list(AXES)).where("ba <> bb and u <> 0 and v <> 0").groupBy("u", "v").agg(F.count("*").alias("n"))
    fu, fv = (touching.groupBy(k).agg(F.sum("n").alias(f"f{k}")) for k in "uv")
    links = touching.join(fu, "u").join(fv, "v").where(F.col("n") >= least_overlap * F.least("fu", "fv")).select("u", "v")
    nodes = voxels.where("label <> 0").select(F.col("label").alias("node")).distinct()
    return components(nodes, links).select(F.col("node").alias("label"), F.col("component").alias("stitched"))


def near_points(points: DataFrame, distance: float) -> DataFrame:
    """The points (region, id, z, y, x) within the distance of a point of an earlier region: an equi-join on grid cells
    as wide as the distance, each later point looked for in the 27 around it."""
    cell = [F.floor(F.col(a) / distance).cast("int") for a in AXES]
    shift = F.explode(F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, (i, j, k), strict=True)]) for i in (-1, 0, 1) for j in (-1, 0, 1) for k in (-1, 0, 1)]))
    first = points.select(*[c.alias(f"c{a}") for a, c in zip(AXES, cell, strict=True)], F.col("region").alias("r0"), *[F.col(a).alias(f"p{a}") for a in AXES])
    later = points.withColumns({f"k{a}": c for a, c in zip(AXES, cell, strict=True)}).withColumn("s", shift)
    later = later.select("region", "id", *AXES, *[(F.col(f"k{a}") + F.col(f"s.d{a}")).alias(f"c{a}") for a in AXES])
    far = sum((F.col(a) - F.col(f"p{a}")) ** 2 for a in AXES)
    return later.join(first.hint("merge"), [f"c{a}" for a in AXES]).where((F.col("r0") < F.col("region")) & (far <= distance**2)).select("region", "id").distinct()
