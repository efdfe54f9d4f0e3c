"""Corrections as a stream: merge and separate messages become training rows and a lookup of fragments to segments."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import agglomeration, learning
from ..operators.grid import components, written

MESSAGE = "seq bigint, type string, data struct<fragments: array<bigint>, fragment: bigint, `from`: array<bigint>>"


def messages(spark: SparkSession, folder: str, per_trigger: int = 100) -> DataFrame:
    """A stream of JSON messages, in the order of their files; seq orders them within a batch."""
    return spark.readStream.schema(MESSAGE).option("maxFilesPerTrigger", per_trigger).json(folder)


def merge_links(batch: DataFrame) -> DataFrame:
    """(seq, u, v): the fragments of each merge message, tied to its first."""
    m = batch.where("type = 'merge'").select("seq", "data.fragments")
    return m.select("seq", F.element_at("fragments", 1).alias("u"), F.explode("fragments").alias("v")).where("u <> v")


def separations(batch: DataFrame) -> DataFrame:
    """(seq, u, v): the fragment of each separate message and each of those that it is to be apart from."""
    m = batch.where("type = 'separate'").select("seq", F.col("data.fragment").alias("u"), F.explode("data.from").alias("v"))
    return m.where("u <> v")


def training_rows(batch: DataFrame) -> DataFrame:
    """(seq, u, v, label): 0 for pairs to merge, 1 for pairs to separate, u < v."""
    rows = merge_links(batch).withColumn("label", F.lit(0)).union(separations(batch).withColumn("label", F.lit(1)))
    return rows.select("seq", F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), "label")


def last_words(rows: DataFrame) -> DataFrame:
    """(seq, u, v, label): of each pair the row of the largest seq, of equal ones to keep apart."""
    return rows.groupBy("u", "v").agg(F.max(F.struct("seq", "label")).alias("m")).select("m.seq", "u", "v", "m.label")


def lookup(rows: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, segment) after all training rows: the last word on a pair counts, merges of what remains are transitive."""
    last = last_words(rows).where("label = 0")
    return components(nodes.select("node"), last.select("u", "v")).select("node", F.col("component").alias("segment"))


def learned(edges: DataFrame, nodes: DataFrame, threshold: float = 0.5, name: str = "logistic regression") -> Callable[[DataFrame], DataFrame]:
    """A way to relearn for start(): a model fitted on the corrected pairs that have an edge agglomerates all fragments.

    edges has (u, v, n, total), nodes (node, size, total). Pairs to keep apart don't merge with each other while the
    rounds last; pairs to merge are joined afterwards, whatever the model says. Until there are pairs of both kinds with
    an edge, only the corrections count."""

    def relearn(rows: DataFrame) -> DataFrame:
        last = written(last_words(rows).select("u", "v", F.when(F.col("label") == 0, learning.MERGE).otherwise(learning.SEPARATE).alias("label")), "corrections")
        known = written(learning.edge_features(edges, nodes).join(last, ["u", "v"]), "training")
        if known.select("label").distinct().count() < 2:  # at most two rows
            return lookup(rows, nodes)
        weigh = learning.model_weight(learning.fit(known, "label", name))
        barred = last.where(F.col("label") == learning.SEPARATE).select("u", "v", F.lit(1).alias("_apart"))
        live = edges.select("u", "v", "n", "total").join(barred, ["u", "v"], "left").select("u", "v", "n", "total", F.coalesce("_apart", F.lit(0)).alias("apart"))
        priority = lambda e: weigh(e).withColumn("w", F.when(F.col("apart") > 0, float("inf")).otherwise(F.col("w")))
        merged = agglomeration.merge_by_priority(live, nodes.select("node", "size", "total"), priority, threshold)[2]
        links = merged.select("node", "segment").union(last.where(F.col("label") == learning.MERGE).select("u", "v")).toDF("u", "v")
        return components(nodes.select("node"), links).select("node", F.col("component").alias("segment"))

    return relearn


def start(stream: DataFrame, nodes: DataFrame, folder: str, every: int = 20, relearn: Callable[[DataFrame], DataFrame] | None = None):
    """Keeps folder/training/batch=<id>, one part for each batch, and after each ``every`` new rows folder/segments, which
    ``relearn`` makes of the last words on all pairs; by default lookup() does. Returns the running query.

    folder/words/version=<id> holds the last words up to a batch, so relearning reads these and the parts since alone.
    folder/progress/batch=<id>, written last, has how many rows came since the last relearning and which version that
    made. A batch that is run again after a failure finds the progress before it and writes the same over again: no
    relearning is lost or moved by a restart. The checkpoint is folder/checkpoint; the two belong together."""
    spark = nodes.sparkSession
    schema = "seq bigint, u bigint, v bigint, label int"
    make = relearn or (lambda rows: lookup(rows, nodes))

    def each(batch: DataFrame, batch_id: int) -> None:
        training_rows(batch).write.mode("overwrite").parquet(f"{folder}/training/batch={batch_id}")
        fresh = spark.read.schema(schema).parquet(f"{folder}/training/batch={batch_id}").count()
        waiting, version = 0, -1
        if batch_id:
            waiting, version = spark.read.schema("waiting bigint, version bigint").parquet(f"{folder}/progress/batch={batch_id - 1}").first()
        waiting += fresh
        if waiting and waiting >= every:
            since = spark.read.schema(f"{schema}, batch bigint").parquet(f"{folder}/training").where((F.col("batch") > version) & (F.col("batch") <= batch_id)).drop("batch")
            rows = since if version < 0 else since.union(spark.read.schema(schema).parquet(f"{folder}/words/version={version}"))
            last_words(rows).write.mode("overwrite").parquet(f"{folder}/words/version={batch_id}")
            make(spark.read.schema(schema).parquet(f"{folder}/words/version={batch_id}")).write.mode("overwrite").parquet(f"{folder}/segments")
            waiting, version = 0, batch_id
        spark.range(1).select(F.lit(waiting).cast("long").alias("waiting"), F.lit(version).cast("long").alias("version")).write.mode("overwrite").parquet(f"{folder}/progress/batch={batch_id}")

    return stream.writeStream.foreachBatch(each).option("checkpointLocation", f"{folder}/checkpoint").start()
