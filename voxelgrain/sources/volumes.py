"""Volumes as tables: one row for each voxel, with its coordinates, labels and intensities."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("z", "y", "x")


def from_arrays(spark: SparkSession, **arrays) -> DataFrame:
    """A voxel table from arrays of one shape, of up to three axes; a column for each name."""
    first = next(iter(arrays.values()))
    shape = (1,) * (3 - np.ndim(first)) + np.shape(first)
    where = np.indices(shape).reshape(3, -1)
    data = {"idx": np.arange(where.shape[1]), **{a: w.astype(np.int32) for a, w in zip(AXES, where, strict=True)}}
    for name, array in arrays.items():
        if np.size(array) != where.shape[1]:
            raise ValueError("all arrays must have one shape")
        data[name] = np.asarray(array).reshape(-1)
    return spark.createDataFrame(pd.DataFrame(data))


def to_array(voxels: DataFrame, column: str, fill=0) -> np.ndarray:
    """A small table's column as an array, for looking at; voxels that are missing get fill."""
    pdf = voxels.select(*AXES, column).toPandas()
    out = np.full([int(pdf[a].max()) + 1 for a in AXES], fill, dtype=pdf[column].dtype)
    out[pdf.z, pdf.y, pdf.x] = pdf[column]
    return out


def events_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events table seen as an image 100 wide: fragments of 5 x 5, a ground truth of 7 x 7, intensity in hundredths."""
    i, y, x = F.col("event_id"), F.expr("event_id div 100"), F.expr("event_id % 100")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        i.alias("idx"),
        F.lit(0).alias("z"),
        y.cast("int").alias("y"),
        x.cast("int").alias("x"),
        F.expr("(event_id div 100 div 5) * 20 + (event_id % 100) div 5 + 1").alias("label"),
        F.expr("(event_id div 100 div 7) * 15 + (event_id % 100) div 7 + 1").alias("gt"),
        F.expr("CAST(round(value * 100) AS BIGINT)").alias("cents"),
    )


def events_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events in order as a row of voxels, labelled by user."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        F.col("event_id").alias("idx"), F.lit(0).alias("z"), F.lit(0).alias("y"), F.col("event_id").cast("int").alias("x"), F.col("user_id").cast("long").alias("label")
    )


def events_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events as planes of 20 x 20, in blocks of 4 x 4 x 4."""
    return spark.read.parquet(f"{sf_dir}/events.parquet").selectExpr(
        "event_id AS idx", "CAST(event_id div 400 AS INT) AS z", "CAST(event_id % 400 div 20 AS INT) AS y", "CAST(event_id % 20 AS INT) AS x",
        "(event_id div 400 div 4) * 25 + (event_id % 400 div 20 div 4) * 5 + event_id % 20 div 4 + 1 AS label", "CAST(round(value * 100) AS BIGINT) AS cents",
    )


def crop(voxels: DataFrame, bounds: dict[str, tuple[int | None, int | None]]) -> DataFrame:
    """The voxels with lo <= coordinate < hi; the filter reaches a Parquet scan."""
    for axis, (lo, hi) in bounds.items():
        if lo is not None:
            voxels = voxels.where(F.col(axis) >= lo)
        if hi is not None:
            voxels = voxels.where(F.col(axis) < hi)
    return voxels


def oriented(voxels: DataFrame, channels: Sequence[str], is_oriented: Sequence[bool], orientation: str) -> DataFrame:
    """voxels with ``oriented``, the value of that oriented channel whose number (from 0) the column orientation holds,
    and ``strongest``, the largest of the oriented channels. A number without a channel gives null."""
    kept = [F.col(c) for c, o in zip(channels, is_oriented, strict=True) if o]
    if not kept:
        raise ValueError("no channel is oriented")
    picked = F.coalesce(*[F.when(F.col(orientation).cast("int") == i, c) for i, c in enumerate(kept)])
    return voxels.withColumns({"oriented": picked, "strongest": F.greatest(*kept) if len(kept) > 1 else kept[0]})


def scaled(voxels: DataFrame, column: str) -> DataFrame:
    """voxels with the column as a double from 0 to 1 over the whole volume; 0 where all values are equal."""
    ends = voxels.agg(F.min(column).cast("double").alias("_lo"), F.max(column).cast("double").alias("_hi"))  # one row
    width = F.col("_hi") - F.col("_lo")
    return voxels.crossJoin(F.broadcast(ends)).withColumn(column, F.when(width > 0, (F.col(column) - F.col("_lo")) / width).otherwise(0.0)).drop("_lo", "_hi")


def write_volume(voxels: DataFrame, path: str, planes: int = 64, compression: str = "zstd") -> None:
    """A Parquet volume in slabs of so many planes, sorted so that crops skip row groups."""
    slab = F.floor(F.col("z") / planes).cast("int")
    out = voxels.withColumn("z_slab", slab).repartition("z_slab").sortWithinPartitions("z", "y", "x")
    out.write.mode("overwrite").option("compression", compression).partitionBy("z_slab").parquet(path)


def read_volume(spark: SparkSession, path: str, bounds: dict | None = None, planes: int = 64) -> DataFrame:
    """A volume that write_volume() wrote; a crop in z prunes slabs."""
    out = spark.read.parquet(path)
    lo, hi = (bounds or {}).get("z", (None, None))
    if lo is not None:
        out = out.where(F.col("z_slab") >= lo // planes)
    if hi is not None:
        out = out.where(F.col("z_slab") <= (hi - 1) // planes)
    return crop(out, bounds or {}).drop("z_slab")


_VTK = {"unsigned_char": "u1", "char": "i1", "unsigned_short": "u2", "short": "i2", "unsigned_int": "u4", "int": "i4", "unsigned_long": "u8", "long": "i8", "float": "f4", "double": "f8"}


def parse_vtk(data: bytes) -> np.ndarray:
    """The array of a binary structured-points file: its header names the sizes from x to z and the kind of number."""
    at, words = 0, {}
    while "LOOKUP_TABLE" not in words:
        end = data.index(b"\n", at)
        head, *rest = data[at:end].decode("ascii", "replace").split() or [""]
        words[head] = rest
        at = end + 1
    shape = [int(n) for n in words["DIMENSIONS"]][::-1]
    kind = np.dtype(_VTK[words["SCALARS"][1]]).newbyteorder(">")
    return np.frombuffer(data, kind, int(np.prod(shape)), at).reshape(shape).astype(kind.newbyteorder("="))


def vtk_bytes(array: np.ndarray, spacing: Sequence[float] = (1.0, 1.0, 1.0)) -> bytes:
    name = next(k for k, v in _VTK.items() if v == array.dtype.str[1:])
    head = ["# vtk DataFile Version 3.0", "volume", "BINARY", "DATASET STRUCTURED_POINTS", "DIMENSIONS " + " ".join(map(str, array.shape[::-1])), "ORIGIN 0 0 0", "SPACING " + " ".join(map(str, spacing[::-1])), f"POINT_DATA {array.size}", f"SCALARS values {name} 1", "LOOKUP_TABLE default"]
    return ("\n".join(head) + "\n").encode() + array.astype(array.dtype.newbyteorder(">")).tobytes()


def read_vtk(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, z, y, x, value double) of each file that fits the pattern; each file is read by one task."""

    def run(batches: Iterable[pd.DataFrame]):
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content, strict=True):
                a = parse_vtk(bytes(content))
                a = a.reshape((1,) * (3 - a.ndim) + a.shape)
                for z, plane in enumerate(a):
                    y, x = np.indices(plane.shape)
                    yield pd.DataFrame({"path": path, "z": np.int32(z), "y": y.ravel().astype(np.int32), "x": x.ravel().astype(np.int32), "value": plane.ravel().astype(float)})

    files = spark.read.format("binaryFile").load(pattern).select("path", "content")
    return files.mapInPandas(run, "path string, z int, y int, x int, value double")


def apply_map(voxels: DataFrame, mapping: DataFrame, column: str = "label", key: str = "old", value: str = "new") -> DataFrame:
    """column sent through a two-column map; labels that the map lacks become 0."""
    m = mapping.select(F.col(key).alias(column), F.col(value).alias("_to"))
    return voxels.join(m, column, "left").withColumn(column, F.coalesce("_to", F.lit(0))).drop("_to")


def rgba_to_label(r, g, b):
    """Colour planes as one label, in base 255."""
    return r + g * 255 + b * 65025


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    """(node1, node2, weight) of a graph file's edge_list, node1 <= node2."""
    schema = "edge_list array<struct<node1: bigint, node2: bigint, weight: double>>"
    e = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("edge_list").alias("e"))
    return e.select(F.least("e.node1", "e.node2").alias("node1"), F.greatest("e.node1", "e.node2").alias("node2"), "e.weight")


def graph_rows(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One JSON line for each edge: its nodes, their sizes, its own size, its weight and its place."""
    size = lambda k: nodes.select(F.col("node").alias(f"node{k}"), F.col("size").alias(f"size{k}"))
    out = edges.join(size(1), "node1").join(size(2), "node2")
    return out.select(F.to_json(F.struct("node1", "node2", "edge_size", "size1", "size2", "weight", "location")).alias("value"))
