"""What the text operators share: scratch tables, word patterns and connected components."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the character class ``[\x20\x09-\x0D]``.
SPACES = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def scratch_root(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Where it is unset, a folder of this process, in local mode alone."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = tempfile.mkdtemp(prefix="voxelgrain-")
        atexit.register(shutil.rmtree, root, True)
        root = f"file://{root}"
        spark.conf.set("spark.checkpoint.dir", root)
    return root


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/voxelgrain/{uuid.uuid4().hex}/{name}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts the lineage and survives a lost executor."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: str = "doc_id"):
    """True for the fifth of the ids whose crc32, of the id as text, is divisible by 5."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def unused(df: DataFrame, *names: str) -> list[str]:
    """The names, with as many underscores in front as make them different from all columns of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def is_small(df: DataFrame, rows: int) -> bool:
    return df.limit(rows + 1).count() <= rows


def connected_components(links: DataFrame, max_rounds: int = 200, broadcast_rows: int = 200_000) -> DataFrame:
    """Component of each node of an undirected graph: (node long, component long), component the smallest node in it.

    links has long columns a and b. Alternates large-star and small-star steps, each an aggregation and a join on
    the node, until the links no longer change; each round's links are written to the shared folder. The rounds grow
    with the logarithm of the longest path; should max_rounds not do, an error is raised. Up to broadcast_rows least
    neighbours are broadcast; beyond that they are written, so that the join stands on two plain shuffles, and
    adaptive execution can split a node with very many links. Nodes without a link to another node aren't returned.
    Null ends and self-links are ignored; an empty graph gives an empty table."""

    def ready(least: DataFrame, most: int) -> DataFrame:
        return F.broadcast(least) if most <= broadcast_rows else keep(least, "least")

    edges = links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    edges = keep(edges, "links")
    mark = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
    for _ in range(max_rounds):
        if not mark[0]:
            break
        # Large star: every larger neighbour of u is tied to the smallest in u's neighbourhood.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        edges = both.join(ready(least, 2 * mark[0]), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # Small star: u and its smaller neighbours are tied to the smallest of them.
        least = ready(edges.groupBy("u").agg(F.min("v").alias("m")), 2 * mark[0])
        tied = edges.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = keep(tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct(), "links")
        now = edges.agg(F.count("*"), F.expr("bit_xor(xxhash64(u, v))")).first()
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components aren't settled after {max_rounds} rounds")
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.unionByName(roots)
