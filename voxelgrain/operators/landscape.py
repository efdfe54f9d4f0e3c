"""Floods and grey reconstruction over whole volumes, as least ways between voxels and starts.

What a flood does follows from edges between neighbouring voxels, each as high as the higher of its two ends: water from
a start reaches a voxel at the least height that no way between them avoids. claimed() finds that height and the start for
all voxels at once, in rounds whose number grows with the logarithm of the volume, however winding the valleys are.
Voxels with a null value are outside the volume."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .chunks import EDGES, settled
from .grid import AXES, components, footprint, offsets, ranked, written
from .search import followed
from .tiles import NO_NAME, Tiles, comparable, least_named, plateaus, tiled


def voxel_edges(voxels: DataFrame, value: str = "cents", axes: tuple[str, ...] = ("y", "x"), connectivity: int = 1, same: tuple[str, ...] = ()) -> DataFrame:
    """(u, v, height, low): neighbouring voxels by their idx, the higher of their values, and the lower.

    Edges join voxels that agree in the columns ``same``. Each voxel is sent to half of its neighbourhood, in one shuffle."""
    key = [*AXES, *same]
    half = [s for s in offsets(axes, connectivity)[1:] if s > (0, 0, 0)]
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, s, strict=True)]) for s in half])
    cells = voxels.where(F.col(value).isNotNull()).select(*key, "idx", F.col(value).alias("_v"))
    sent = cells.select(*same, F.col("idx").alias("u"), F.col("_v").alias("_a"), *AXES, F.explode(steps).alias("s"))
    sent = sent.select(*[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in AXES], *same, "u", "_a")
    met = sent.join(cells.withColumnRenamed("idx", "v"), key)
    return met.select("u", "v", F.greatest("_a", "_v").alias("height"), F.least("_a", "_v").alias("low"))


def claimed(edge_table: DataFrame, seeds: DataFrame, order: tuple[str, ...] = ("height", "low"), chunk: int = EDGES) -> DataFrame:
    """(node, label, height) of each node with an edge or a seed: the label whose seed claims it, and the height of the
    least way there, null on the seed itself. Both are null where no way leads to a seed.

    edge_table has (u, v, order...), seeds (node, label), nodes and labels from 0 on; a node with several seeds takes the
    least label. Edges are taken in the order (order..., u, v), never one that would join two labels: the forest that
    remains is the one that taking them one at a time leaves. In each round every part without a label takes its least
    edge to another part. No way from a part to a seed avoids an edge as high as that, so a node's height is the highest
    that its parts took. Parts at least halve in each round, and only edges between parts go on to the next. What a chunk of
    nodes can settle by itself comes first, see chunks.py.

    Parts are named by a node, those with a label by -1 - label."""
    e = F.struct(*order, "u", "v")
    starts = written(seeds.groupBy("node").agg((-1 - F.min("label").cast("long")).alias("part")), "starts")
    near = written(edge_table.where("u <> v").select("u", "v", *order), "edges")
    named = lambda k: starts.select(F.col("node").alias(k), F.col("part").alias(f"_{k}"))
    live = near.join(named("u"), "u", "left").join(named("v"), "v", "left").select(F.coalesce("_u", "u").alias("a"), F.coalesce("_v", "v").alias("b"), e.alias("e"))
    live = written(live.where("a <> b AND (a >= 0 OR b >= 0)"), "live")
    step, live, _ = settled(live, True, chunk)
    live, rounds = written(_between(live), "live"), [step]
    while live.limit(1).count():
        ends = live.select(F.explode(F.array(F.struct(F.col("a").alias("part"), F.col("b").alias("to")), F.struct(F.col("b").alias("part"), F.col("a").alias("to")))).alias("p"), "e")
        took = ends.where("p.part >= 0").groupBy(F.col("p.part").alias("part")).agg(F.min(F.struct("e", F.col("p.to").alias("to"))).alias("m"))
        took = written(took.select("part", F.col("m.to").alias("to"), F.col(f"m.e.{order[0]}").alias("height")), "took")
        # Of two parts that took one edge, the lesser is where the ways of their group end; elsewhere a label is.
        back = took.select(F.col("part").alias("to"), F.col("to").alias("_back"))
        ways = took.join(back, "to", "left").select("part", F.when((F.col("_back") == F.col("part")) & (F.col("part") < F.col("to")), F.col("part")).otherwise(F.col("to")).alias("to"))
        ways = ways.union(took.where("to < 0").select("to", F.col("to").alias("_to")).distinct())
        group = followed(ways.select(F.col("part").alias("idx"), "to")).select(F.col("idx").alias("part"), F.col("to").alias("into"))
        step = written(took.select("part", "height").join(group, "part"), "step")
        rounds.append(step)
        into = lambda k: step.select(F.col("part").alias(k), F.col("into").alias(f"_{k}"))  # noqa: E731, B023
        live = live.join(into("a"), "a", "left").join(into("b"), "b", "left")
        live = written(_between(live.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"), "e")), "live")
    final = None
    for step in reversed(rounds):
        if final is not None:
            later = final.select(F.col("part").alias("into"), F.col("into").alias("_into"), F.col("height").alias("_height"))
            step = written(step.join(later, "into", "left").select("part", F.greatest("height", "_height").alias("height"), F.coalesce("_into", "into").alias("into")), "final")
        final = step
    nodes = near.select(F.explode(F.array("u", "v")).alias("node")).union(starts.select("node")).distinct().join(starts, "node", "left")
    if final is None:
        return nodes.select("node", (-1 - F.col("part")).alias("label"), F.lit(None).cast(near.schema[order[0]].dataType).alias("height"))
    loose = final.select(F.col("part").alias("node"), "into", F.when(F.col("into") < 0, F.col("height")).alias("_height"))
    out = nodes.join(loose, "node", "left").withColumn("into", F.coalesce("part", "into"))
    return out.select("node", F.when(F.col("into") < 0, -1 - F.col("into")).alias("label"), F.when(F.col("part").isNull(), F.col("_height")).alias("height"))


def _between(live: DataFrame) -> DataFrame:
    """The least edge of each two parts that aren't one, nor both labelled."""
    apart = live.where("a <> b AND (a >= 0 OR b >= 0)")
    return apart.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.min("e").alias("e"))


def flood(voxels: DataFrame, seeds: DataFrame, value: str = "cents", same: tuple[str, ...] = (), **grid) -> DataFrame:
    """(idx, label, height): a watershed of the whole volume from seeds (idx, label), without dams.

    height is that of the pass by which the label comes, a seed's own value on it. Both are null where no seed leads. Of
    equal heights the edge with the lower end goes first, then that of the least idx; water doesn't cross between voxels
    that differ in a column of ``same``. Levels aren't crossed at even speed, so a plateau's halves need not be even."""
    cells = voxels.where(F.col(value).isNotNull()).select("idx", F.col(value).alias("_v"))
    marks = seeds.select(F.col("idx").alias("node"), "label").join(cells.select(F.col("idx").alias("node")), "node", "left_semi")
    got = claimed(voxel_edges(voxels, value, same=same, **grid), marks).withColumnRenamed("node", "idx")
    height = F.coalesce("height", F.when(F.col("label").isNotNull(), F.col("_v")))
    return cells.join(got, "idx", "left").select("idx", "label", height.alias("height"))


def reconstruct_down(voxels: DataFrame, marker: str, mask: str, **grid) -> DataFrame:
    """(idx, value): grey reconstruction by erosion. The marker sinks as far as ways over the mask let it: a voxel gets
    the least of max(marker at y, mask along the way from y) over all y and ways.

    A marker under its mask counts as the mask; a null marker starts nothing, and value is null where nothing starts."""
    edges = voxel_edges(voxels, mask, **grid).select("u", "v", "height")
    cells = voxels.where(F.col(mask).isNotNull())
    # Each marker is a label of its own, tied to its voxel by an edge as high as it; labels' nodes come after all voxels.
    beyond = cells.agg((F.coalesce(F.max("idx"), F.lit(0)) + 1).alias("_n"))  # one row
    tied = cells.where(F.col(marker).isNotNull()).crossJoin(F.broadcast(beyond))
    tied = written(tied.select(F.col("idx").alias("u"), (F.col("idx") + F.col("_n")).alias("v"), F.greatest(marker, mask).alias("height"), F.col("idx").alias("label")), "markers")
    got = claimed(edges.union(tied.select("u", "v", "height")), tied.select(F.col("v").alias("node"), "label"), ("height",))
    return cells.select("idx").join(got.select(F.col("node").alias("idx"), F.col("height").alias("value")), "idx", "left")


def reconstruct(voxels: DataFrame, marker: str, mask: str, **grid) -> DataFrame:
    """(idx, value): grey reconstruction by dilation, the marker spreading under the mask; reconstruct_down() upside down."""
    turned = voxels.withColumns({marker: -F.col(marker), mask: -F.col(mask)})
    return reconstruct_down(turned, marker, mask, **grid).withColumn("value", -F.col("value"))


def hminima(voxels: DataFrame, value: str, depth, **grid) -> DataFrame:
    """(idx, value): minima less deep than ``depth`` filled in, deeper ones made less deep by it."""
    return reconstruct_down(voxels.withColumn("_raised", F.col(value) + depth), "_raised", value, **grid)


def impose_minima(voxels: DataFrame, value: str, minima: Column, **grid) -> DataFrame:
    """(idx, value): the volume filled until the voxels where ``minima`` holds are its only minima; what no way leads to
    them from gets the volume's largest value."""
    out = reconstruct_down(voxels.withColumn("_raised", F.when(minima, F.col(value))), "_raised", value, **grid)
    top = voxels.agg(F.max(value).alias("_top"))  # one row
    return out.crossJoin(F.broadcast(top)).select("idx", F.coalesce("value", "_top").alias("value"))


def regional_minima(voxels: DataFrame, value: str = "cents", axes: tuple[str, ...] = ("y", "x"), connectivity: int = 1) -> DataFrame:
    """(idx, minimum): the least idx of a voxel's plateau where no voxel next to the plateau is lower, null elsewhere.

    A tile tells its plateaus apart by itself; of those that reach beyond it, only the parts in tiles are linked."""

    def run(c: Tiles) -> list:
        idx = c.column("idx")
        top, goes_on, higher = plateaus(c, comparable(c.column("_v")), half)
        drained = np.zeros(len(c), bool)
        drained[top[higher]] = True
        name = least_named(c, top, idx)
        # A voxel beyond the tile tells where its plateau goes on.
        rows = c.own | (name < NO_NAME)
        return [idx[rows], name[rows], c.own[rows], goes_on[rows], drained[top][rows]]

    kind = voxels.schema["idx"].dataType
    half = [s for s in offsets(axes, connectivity)[1:] if s > (0, 0, 0)]
    cells = voxels.where(F.col(value).isNotNull()).select(*AXES, F.col("idx").cast("long").alias("idx"), F.col(value).alias("_v"))
    schema = cells.select("idx", F.col("idx").alias("part"), *[F.lit(None).cast("boolean").alias(k) for k in ("own", "goes_on", "drained")]).schema
    for f in schema.fields:
        f.nullable = True
    rows = written(tiled(cells, ["idx", "_v"], run, schema, axes), "plateaus")
    crossing = written(rows.where("own AND goes_on").select("idx", "part", "drained"), "crossing")
    links = crossing.join(rows.where("NOT own").select("idx", F.col("part").alias("u")), "idx").select("u", F.col("part").alias("v"))
    parts = components(crossing.select(F.col("part").alias("node")).distinct(), links, within=True).withColumnRenamed("node", "part")
    dry = crossing.join(parts, "part").groupBy("component").agg(F.max("drained").alias("drained"))
    whole = parts.join(dry, "component").select("part", F.when(~F.col("drained"), F.col("component")).alias("minimum"))
    out = rows.where("own AND NOT goes_on").select("idx", F.when(~F.col("drained"), F.col("part")).alias("minimum"))
    out = out.union(crossing.join(whole, "part").select("idx", "minimum"))
    return out.select(F.col("idx").cast(kind).alias("idx"), F.col("minimum").cast(kind).alias("minimum"))


def minimum_seeds(voxels: DataFrame, points: DataFrame, column: str = "seed", refill: bool = False, **grid) -> DataFrame:
    """(idx, column): seeds changed so that no seed serves two of the points (z, y, x), and each point has one.

    A point is served by the largest seed on it or next to it. A seed that serves two points or more goes. Points that
    no seed serves get new ones, numbered from the largest seed on by z, y, x; with ``refill`` also those whose seed goes,
    which else stay without."""
    key = list(AXES)
    cells = voxels.withColumn(column, F.coalesce(column, F.lit(0)))
    spots = points.select(*key).distinct()
    served = written(footprint(cells, ["idx"], column, **grid).select(*key, "idx", F.col("hi").alias("_by")).join(spots, key), "served")
    gone = served.where("_by <> 0").groupBy("_by").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("_by").alias(column), F.lit(True).alias("_gone"))
    bare = served.where("_by = 0")
    if refill:
        lost = served.join(gone.withColumnRenamed(column, "_by"), "_by", "left_semi")
        bare = bare.select(*key, "idx").union(lost.select(*key, "idx"))
    kept = written(cells.select("idx", column).join(gone, column, "left").select("idx", F.when(F.col("_gone"), F.lit(0)).otherwise(F.col(column)).cast("long").alias(column)), "kept")
    top = kept.agg(F.coalesce(F.max(column), F.lit(0)).alias("_top"))  # one row
    new = ranked(bare.select(*key, "idx"), key, "_new").select("idx", "_new")
    out = kept.join(new, "idx", "left").crossJoin(F.broadcast(top))
    return out.select("idx", F.when(F.col("_new").isNotNull(), F.col("_new") + F.col("_top")).otherwise(F.col(column)).alias(column))


def split_exclusions(voxels: DataFrame, value: str = "cents", label: str = "label", exclusion: str = "exclusion", axes: tuple[str, ...] = ("y", "x"), connectivity: int = 1) -> DataFrame:
    """(idx, label): segments that hold two exclusions or more (other than 0 and null) flooded anew from them.

    The starts are the connected voxels of one exclusion within the segment; a new segment is the largest label plus 1
    plus the least idx of its start. Voxels that no start leads to keep their label."""
    cells = written(voxels.select(*AXES, "idx", F.col(value).alias("_v"), F.col(label).alias("_l"), F.coalesce(exclusion, F.lit(0)).alias("_e")), "cells")
    split = cells.where("_e <> 0").groupBy("_l").agg((F.min("_e") < F.max("_e")).alias("_split")).where("_split").select("_l")
    inside = written(cells.join(split, "_l", "left_semi"), "inside")
    marked = inside.where("_e <> 0")
    links = voxel_edges(marked, "_v", axes, connectivity, ("_l", "_e")).select("u", "v")
    starts = components(marked.select(F.col("idx").alias("node")), links, within=True).select(F.col("node").alias("idx"), F.col("component").alias("label"))
    top = cells.agg(F.max("_l").cast("long").alias("_top"))  # one row
    got = flood(inside, starts, "_v", ("_l",), axes=axes, connectivity=connectivity).select("idx", F.col("label").alias("_new"))
    out = cells.join(got, "idx", "left").crossJoin(F.broadcast(top))
    return out.select("idx", F.coalesce(F.col("_top") + 1 + F.col("_new"), F.col("_l")).alias(label))


def manual_split(voxels: DataFrame, body: int, seeds: DataFrame, value: str = "cents", label: str = "label", **grid) -> DataFrame:
    """(idx, label): one body flooded anew from seeds (idx, label) on it, which name its pieces; all else stays.

    Only the body's voxels are shuffled and flooded. Seeds beside the body don't count; voxels that none reaches stay."""
    got = flood(voxels.where(F.col(label) == body), seeds, value, **grid).select("idx", F.col("label").alias("_new"))
    return voxels.select("idx", F.col(label).alias("_l")).join(got, "idx", "left").select("idx", F.coalesce("_new", "_l").alias(label))
