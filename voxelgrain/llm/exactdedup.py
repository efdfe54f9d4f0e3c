"""Exact duplicates by progressive refinement, in DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_small, keep, unused

#: Runs of ASCII white space other than one space.
RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    """The text with each run of ASCII white space as one space; null as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), RUNS, " ")


def _keys(text: Column, prefix: int) -> tuple[Column, Column, Column]:
    """Length in bytes, hash of the first ``prefix`` characters, and SHA-256 of a normalised text."""
    return F.octet_length(text), F.xxhash64(F.substring(text, 1, prefix)), F.unhex(F.sha2(text.cast("binary"), 256))


def _survivors(keys: DataFrame, length: str, head: str) -> DataFrame:
    """(length, head) of more than one row. Rows alone in their length are alone here too, so that one count, summed in
    each task before the shuffle, does for both steps."""
    return keep(keys.groupBy(length, head).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(length, head), "heads")


def _groups(hashed: DataFrame, id_col: str, length: str, full: str) -> DataFrame:
    """(length, full, keep_id, ties, group_size) of each text of more than one row; ties counts the rows with keep_id.

    Written, so that a join with it stands on two plain shuffles, of which adaptive execution splits a frequent key."""
    each = hashed.groupBy(length, full, id_col).agg(F.count(F.lit(1)).alias("n"))
    first = F.min(F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), "n")).alias("first")
    out = each.groupBy(length, full).agg(F.sum("n").alias("group_size"), first).where("group_size > 1")
    return keep(out.select(length, full, F.col("first.id").alias("keep_id"), F.col("first.n").alias("ties"), "group_size"), "groups")


def exact_groups(docs: DataFrame, prefix: int = 256, broadcast_rows: int = 200_000, hash_all: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, keep_id, group_size, kept, len, head, full) of every row; texts are equal if normalised() is.

    Rows are grouped by the length of the text and a hash of its first ``prefix`` characters, and those that share both
    by the SHA-256 of the whole text; full is null for the others, unless hash_all asks for it everywhere. Only keys
    are shuffled, never texts. Up to broadcast_rows surviving keys are broadcast, so that only the texts of surviving
    rows are hashed; beyond that, all rows' are. Counts are summed before each shuffle.

    Each row of docs gives one row. A null text is empty. Rows without an id count in group_size, but an id stays before
    them; kept is true where doc_id equals keep_id, so repeated rows of one id agree. An empty table gives an empty one;
    other columns are ignored. A very long text is hashed in one task, and never leaves it."""
    length, head, full = _keys(normalised(F.col(text_col)), prefix)
    keys = docs.select(F.col(id_col).alias("doc_id"), length.alias("len"), head.alias("head"), *([full.alias("full")] if hash_all else []))
    if hash_all:
        keys = keep(keys, "keys")
    heads = _survivors(keys, "len", "head").withColumn("again", F.lit(True))
    if hash_all:
        rows = keys.join(F.broadcast(heads) if is_small(heads, broadcast_rows) else heads, ["len", "head"], "left")
    elif is_small(heads, broadcast_rows):
        rows = docs.select(F.col(id_col).alias("doc_id"), length.alias("len"), head.alias("head"), F.col(text_col).alias("text"))
        rows = rows.join(F.broadcast(heads), ["len", "head"], "left")
        rows = rows.select("doc_id", "len", "head", "again", F.when(F.col("again"), _keys(normalised(F.col("text")), prefix)[2]).alias("full"))
    else:
        rows = docs.select(F.col(id_col).alias("doc_id"), length.alias("len"), head.alias("head"), full.alias("full")).join(heads, ["len", "head"], "left")
        rows = rows.withColumn("full", F.when(F.col("again"), F.col("full")))
    rows = keep(rows, "hashes")
    groups = _groups(rows.where("again"), "doc_id", "len", "full")
    copies = rows.where("again").join(F.broadcast(groups) if is_small(groups, broadcast_rows) else groups, ["len", "full"], "left")
    size, first = F.coalesce("group_size", F.lit(1)).cast("long"), F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    copies = copies.select("doc_id", first.alias("keep_id"), size.alias("group_size"), "len", "head", "full")
    alone = rows.where("again is null").select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), "len", "head", "full")
    return copies.unionByName(alone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))


def drop_copies(docs: DataFrame, prefix: int = 256, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each text, that with the smallest id, found as by exact_groups().

    Of repeated rows of that id one is left, whichever; rows without an id stay only where no row of the text has one,
    and then one of them. A null text is an empty one. All columns stay as they are, whatever their names; an empty
    table gives an empty one. Texts are shuffled only beyond broadcast_rows surviving keys or repeated texts."""
    c_len, c_head, c_full, c_again, c_keep, c_ties, c_size = unused(docs, "len", "head", "full", "again", "keep_id", "ties", "group_size")
    length, head, full = _keys(normalised(F.col(text_col)), prefix)
    keyed = docs.withColumns({c_len: length, c_head: head})
    heads = _survivors(keyed.select(c_len, c_head), c_len, c_head).withColumn(c_again, F.lit(True))
    if is_small(heads, broadcast_rows):
        marked = keyed.join(F.broadcast(heads), [c_len, c_head], "left").withColumn(c_full, F.when(F.col(c_again), full))
        hashed = marked.where(F.col(c_again)).select(F.col(id_col).alias("doc_id"), c_len, c_full)
    else:
        marked = keyed.withColumn(c_full, full)
        hashed = marked.select(F.col(id_col).alias("doc_id"), c_len, c_head, c_full).join(heads, [c_len, c_head], "left_semi").drop(c_head)
    groups = _groups(hashed, "doc_id", c_len, c_full)
    groups = groups.select(c_len, c_full, F.col("keep_id").alias(c_keep), F.col("ties").alias(c_ties), F.col("group_size").alias(c_size))
    out = marked.join(F.broadcast(groups) if is_small(groups, broadcast_rows) else groups, [c_len, c_full], "left")
    out = out.where(F.col(c_size).isNull() | F.col(id_col).eqNullSafe(F.col(c_keep)))
    if groups.where(F.col(c_ties) > 1).limit(1).count():
        tied = out.where(F.col(c_ties) > 1).dropDuplicates([c_len, c_full])
        out = out.where(F.coalesce(F.col(c_ties), F.lit(1)) == 1).unionByName(tied)
    return out.select(docs.columns)
