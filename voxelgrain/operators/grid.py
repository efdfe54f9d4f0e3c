"""Neighbourhoods on a voxel grid, and what follows from them: borders, dilation, erosion, components."""

from __future__ import annotations

import atexit
import functools
import itertools
import shutil
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def offsets(axes: tuple[str, ...], connectivity: int) -> list[tuple[int, int, int]]:
    """The steps to a voxel's neighbours, itself first: at most ``connectivity`` of the axes move by one."""
    steps = itertools.product(*[(-1, 0, 1) if a in axes else (0,) for a in AXES])
    return sorted((s for s in steps if sum(map(abs, s)) <= connectivity), key=lambda s: (any(s), s))


def seen_by(voxels: DataFrame, columns: list[str], axes: tuple[str, ...] = ("y", "x"), connectivity: int = 1) -> DataFrame:
    """One row for each voxel and neighbour in whose sight it lies: (z, y, x of the neighbour, here, columns).

    here marks a voxel's own row. Grouping by the coordinates then sees each whole neighbourhood after one shuffle;
    neighbours outside the table give groups without an own row."""
    steps = F.array(*[F.struct(*[F.lit(d).alias(f"d{a}") for a, d in zip(AXES, s, strict=True)], F.lit(not any(s)).alias("here")) for s in offsets(axes, connectivity)])
    rows = voxels.select(*AXES, *columns, F.explode(steps).alias("s"))
    return rows.select(*[(F.col(a) + F.col(f"s.d{a}")).alias(a) for a in AXES], "s.here", *columns)


def own(column: str) -> Column:
    return F.max(F.when(F.col("here"), F.col(column))).alias(column)


def footprint(voxels: DataFrame, keep: list[str], column: str = "label", axes: tuple[str, ...] = ("y", "x"), connectivity: int = 1, extra: list[Column] = ()) -> DataFrame:
    """Each voxel with ``keep`` columns and lo, hi, cells: least and largest value of its neighbourhood, itself included, and how many voxels of it exist."""
    columns = list(dict.fromkeys([*keep, column]))
    near = seen_by(voxels, columns, axes, connectivity).groupBy(*AXES)
    out = near.agg(*[own(c) for c in columns], F.min(column).alias("lo"), F.max(column).alias("hi"), F.count("*").alias("cells"), F.max("here").alias("_is"), *extra)
    return out.where("_is").drop("_is")


def dilate(voxels: DataFrame, column: str, steps: int = 1, **grid) -> DataFrame:
    return _spread(voxels, column, "hi", steps, **grid)


def erode(voxels: DataFrame, column: str, steps: int = 1, **grid) -> DataFrame:
    return _spread(voxels, column, "lo", steps, **grid)


def _spread(voxels: DataFrame, column: str, what: str, steps: int, **grid) -> DataFrame:
    keep = [c for c in voxels.columns if c not in AXES]
    for _ in range(steps):
        out = footprint(voxels, keep, column, **grid)
        voxels = out.withColumn(column, F.col(what)).select(*AXES, *keep)
    return voxels


def borders(voxels: DataFrame, column: str = "label", **grid) -> DataFrame:
    """border: whether two labels meet in the voxel's neighbourhood."""
    return footprint(voxels, ["idx"], column, **grid).select("idx", (F.col("lo") != F.col("hi")).alias("border"))


def close_merged_gaps(voxels: DataFrame, column: str = "label", **grid) -> DataFrame:
    """Voxels of label 0 whose other neighbours all have one label take it."""
    some = F.min(F.when(F.col(column) != 0, F.col(column))).alias("least")
    out = footprint(voxels, ["idx"], column, extra=[some], **grid)
    return out.select("idx", F.when((F.col(column) == 0) & (F.col("least") == F.col("hi")), F.col("hi")).otherwise(F.col(column)).alias(column))


def despeckle(voxels: DataFrame, column: str = "label", **grid) -> DataFrame:
    """Labels whose voxels touch exactly one other label take that one; all at once."""
    pairs = label_contacts(voxels, column, **grid)
    both = pairs.select(F.col("u").alias("a"), F.col("v").alias("b")).union(pairs.select("v", "u"))
    alone = both.groupBy("a").agg(F.min("b").alias("to"), F.max("b").alias("hi")).where("to = hi").select(F.col("a").alias(column), "to")
    return voxels.join(alone, column, "left").withColumn(column, F.coalesce("to", column)).drop("to")


def label_contacts(voxels: DataFrame, column: str = "label", **grid) -> DataFrame:
    """The distinct pairs u < v of labels that touch."""
    labels = F.collect_set(column).alias("near")
    out = footprint(voxels, [], column, extra=[labels], **grid).where("lo <> hi").select(column, F.explode("near").alias("o")).where(F.col(column) != F.col("o"))
    return out.select(F.least(column, "o").alias("u"), F.greatest(column, "o").alias("v")).distinct()


def faces(voxels: DataFrame, skin: int = 1, axes: tuple[str, ...] = ("y", "x")) -> DataFrame:
    """The voxels within ``skin`` of a face of the whole grid."""
    ends = voxels.agg(*[f(a).alias(f"{n}_{a}") for a in axes for n, f in (("lo", F.min), ("hi", F.max))])
    at = None
    for a in axes:
        here = (F.col(a) < F.col(f"lo_{a}") + skin) | (F.col(a) > F.col(f"hi_{a}") - skin)
        at = here if at is None else at | here
    return voxels.crossJoin(F.broadcast(ends)).where(at).select(voxels.columns)  # ends is one row


@functools.cache
def _own_folder() -> str:
    root = tempfile.mkdtemp(prefix="voxelgrain-")
    atexit.register(shutil.rmtree, root, True)
    return f"file://{root}"


def written(df: DataFrame, name: str) -> DataFrame:
    """df by way of the shared folder spark.checkpoint.dir: cuts the lineage of a loop and survives a lost executor.

    Where it is unset, a folder of this process serves in local mode; on a cluster that is an error."""
    spark: SparkSession = df.sparkSession
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _own_folder()
    path = f"{root.rstrip('/')}/voxelgrain/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(rows: DataFrame, order: list, name: str, **sums) -> DataFrame:
    """rows with ``name``, their rank from 1 in an order of columns, and the running sum of a column by each name in sums.

    Rows are dealt out by ranges of the order; each range counts by itself and adds what the ranges before it hold, so
    only one row a range is summed in a single task."""
    from pyspark.sql import Window

    columns = rows.columns
    dealt = written(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    totals = dealt.groupBy("_range").agg(F.count(F.lit(1)).alias("_n0"), *[F.sum(c).alias(f"_n{i + 1}") for i, c in enumerate(sums.values())])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select("_range", *[F.coalesce(F.sum(f"_n{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums) + 1)])
    here = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    out = dealt.join(F.broadcast(before), "_range")  # one row for each shuffle partition at most
    counted = [(F.row_number().over(here) + F.col("_b0")).cast("long").alias(name)]
    counted += [(F.sum(c).over(here) + F.col(f"_b{i + 1}")).alias(n) for i, (n, c) in enumerate(sums.items())]
    return out.select(*columns, *counted)


#: Rows of which a task works out what hangs together at once, in some 100 bytes for each.
CHUNK = 1_000_000


def chunked(rows: DataFrame, by: str, run, columns: list[str], chunk: int = CHUNK) -> DataFrame:
    """run() over arrays of the two long columns of rows, dealt by ranges of one of them, at most about ``chunk`` rows at a time."""

    def each(batches):
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= chunk:
                yield done(held)
                held, n = [], 0
        if n:
            yield done(held)

    def done(held):
        out = run(*[np.concatenate([batch.column(i).to_numpy(zero_copy_only=False) for batch in held]) for i in (0, 1)])
        return pa.RecordBatch.from_arrays([pa.array(c) for c in out], names=columns)

    kinds = [f"{c} {'boolean' if c == 'ends' else 'long'}" for c in columns]
    return rows.repartitionByRange(by).mapInArrow(each, ", ".join(kinds))


def least_joined(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of some links, and for each the least node that these links lead to."""
    ids, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    top = np.arange(len(ids))
    while len(a):
        np.minimum.at(top, np.maximum(a, b), np.minimum(a, b))
        while (top != (beyond := top[top])).any():
            top = beyond
        a, b = top[a], top[b]
        apart = a != b
        a, b = a[apart], b[apart]
    return ids, ids[top]


def _starred(links: DataFrame) -> DataFrame:
    """(node, component) of all nodes with a link, by large and small stars: rounds that grow with the logarithm of the longest way."""
    edges = written(links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    state = lambda e: e.agg(F.count(F.lit(1)), F.expr("bit_xor(xxhash64(u, v))")).first()
    mark = state(edges)
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = written(both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        tied = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = written(tied.union(least.select("u", "m")).where("u <> v").distinct(), "links")
        now = state(edges)
        if now == mark:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("component")).union(edges.select("v", "v").distinct())
        mark = now


def components(nodes: DataFrame, links: DataFrame, within: bool = False, chunk: int = CHUNK) -> DataFrame:
    """(node, component): the least node that links lead to, for every row of nodes; nodes are whole numbers.

    Links are dealt by ranges of their nodes. Each task ties its own to the least node they lead to, a chunk at a time;
    only nodes that meet several of those link them, and go on to the next round. So where neighbours have near numbers,
    as on a grid, little but the borders of ranges goes on. Where that halves nothing any more, rounds of stars finish.
    With ``within``, both ends of all links are known to be nodes; otherwise links to others don't count."""
    kind = nodes.schema["node"].dataType
    if not within:
        for k in "uv":
            links = links.join(nodes.select(F.col("node").alias(k)).distinct(), k, "left_semi")
    rest = written(links.where("u <> v").select(F.least("u", "v").cast("long").alias("u"), F.greatest("u", "v").cast("long").alias("v")), "links")
    levels, many = [], None
    found = None
    while now := rest.count():
        if many is not None and 2 * now > many:
            found = _starred(rest)
            break
        many = now
        tops = chunked(rest, "u", least_joined, ["node", "top"], chunk).groupBy("node")
        some = F.when(F.min("top") < F.max("top"), F.collect_set("top")).alias("tops")  # at most one from each chunk
        level = written(tops.agg(F.min("top").alias("component"), some), "level")
        levels.append(level.select("node", "component"))
        rest = level.where("tops IS NOT NULL").select(F.col("component").alias("u"), F.explode("tops").alias("v")).where("u <> v")
        rest = written(rest.distinct(), "links")
    for level in reversed(levels):
        if found is not None:
            later = found.select(F.col("node").alias("component"), F.col("component").alias("_to"))
            level = level.join(later, "component", "left").select("node", F.coalesce("_to", "component").alias("component"))
        found = level
    if found is None:
        return written(nodes.select("node", F.col("node").alias("component")), "labels")
    out = nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").cast(kind).alias("component"))
    return written(out, "labels")


def connected(voxels: DataFrame, column: str, axes: tuple[str, ...] = ("y", "x"), connectivity: int = 1) -> DataFrame:
    """(idx, component): the connected parts of equal value, 0 left out; a part is named by its least idx."""
    solid = voxels.where(F.col(column) != 0)
    pairs = None
    for s in offsets(axes, connectivity)[1:]:
        if s > (0, 0, 0):
            shifted = solid.select(*[(F.col(a) + d).alias(a) for a, d in zip(AXES, s, strict=True)], F.col("idx").alias("u"), F.col(column).alias("_v"))
            p = shifted.join(solid.select(*AXES, F.col("idx").alias("v"), F.col(column).alias("_w")), list(AXES)).where("_v = _w").select("u", "v")
            pairs = p if pairs is None else pairs.union(p)
    out = components(solid.select(F.col("idx").alias("node")), pairs, within=True)
    return out.select(F.col("node").alias("idx"), "component")
