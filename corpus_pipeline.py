"""A training corpus in five stages: toxicity, exact dedup, near dedup, mixing and packing.

Each stage works on all rows the one before kept. None of the stages reads labels but the first, which trains on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from voxelgrain.llm import exactdedup, mixing, packing, simhash, toxicity
from voxelgrain.llm.common import keep, table
from voxelgrain.llm.tokens import tokenizer_path


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows below the toxicity threshold, of a model trained on docs with the labels of sf_dir; a null text is scored like an empty one."""
    return toxicity.drop_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each normalised text, that with the smallest id."""
    return exactdedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component of near copies, that with the smallest id; rows without an id stay."""
    return simhash.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row 0 to 2 times, as the sources' target weights say; texts without a word go."""
    return mixing.repeat_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token ids in pieces of power-of-two lengths."""
    return packing.pack_power_of_two(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_copies), ("near_dedup", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: Compression lengths, fingerprints and token ids have no SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other on the documents of sf_dir, each written to the shared folder and read again.

    Null texts and ids, repeated rows and ids, and columns of any name are handled as each stage's operator says; no
    documents give no rows."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = keep(stage(spark, docs, sf_dir), name)
    return docs
