"""SimHash near-duplicate groups by covering locality-sensitive hashing."""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, is_small, keep, unused

BITS = 64


def fingerprint(text: str | None, words: int = 4, seed: int = 42) -> int:
    """SimHash of a text's word shingles, as a signed 64-bit integer; 0 if there is no word."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    hash64, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        hashes = np.array([hash64(joined, seed)], np.uint64)
    else:
        sizes = np.fromiter(map(len, parts), np.int64, len(parts))
        ends = np.cumsum(sizes + 1) - 1
        starts = ends - sizes
        n = len(parts) - words + 1
        hashes = np.fromiter((hash64(joined[a:b], seed) for a, b in zip(starts[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n)
    counts = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 32768):
        lot = hashes[i : i + 32768].astype("<u8")
        counts += np.add.reduce(np.unpackbits(lot.view(np.uint8), bitorder="little").reshape(len(lot), BITS), axis=0, dtype=np.uint16)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) of every row, over whole texts."""

    def run(batches):
        for batch in batches:
            fps = [fingerprint(t, words) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def covering_masks(radius: int) -> list[int]:
    """2^(radius+1) - 1 masks of 64 bits such that any radius bits are all outside some mask.

    Each bit gets a non-zero vector of radius + 1 bits; the mask of the non-zero vector v has the bits whose vectors
    have an odd product with v. For radius bits there is a v with an even product with each of their vectors, so two
    fingerprints that differ in those bits agree under v's mask."""
    vectors = [i % ((1 << radius + 1) - 1) + 1 for i in range(BITS)]
    return [sum(1 << i for i, a in enumerate(vectors) if (a & v).bit_count() & 1) for v in range(1, 1 << radius + 1)]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that join the same fingerprints as all links within the radius do, at most one less than there are fingerprints."""
    fps = np.unique(fps)
    top = np.arange(len(fps))

    def root(i):
        while top[i] != i:
            top[i] = i = top[top[i]]
        return i

    links = []
    for a in range(0, len(fps), 128):
        near = np.bitwise_count(fps[a : a + 128, None] ^ fps[None, a:]) <= radius
        for i, j in zip(*np.nonzero(np.triu(near, 1)), strict=True):
            x, y = root(a + i), root(a + j)
            if x != y:
                top[max(x, y)] = min(x, y)
                links.append((int(fps[a + i]), int(fps[a + j])))
    return links


def near_links(fps: DataFrame, radius: int = 4, pairwise: int = 2048) -> DataFrame:
    """Links (a, b) between different fingerprints that lead to the same components as all pairs within the radius.

    fps has one long column fp without repeats. Each fingerprint is put into a bucket for each covering mask. A bucket
    of two is compared at once; one of up to ``pairwise`` is compared in one task, which gives a forest of its links,
    not its pairs. In larger buckets no pairs are formed: two fingerprints within 2r bits of each other have a common
    neighbour at r bits or fewer, so each member is laid under all its neighbours within radius / 2 bits and those
    under one neighbour, at most as many as there are neighbours, are tied to the least of them. (An odd radius needs
    balls of both sizes; then radius must be even here.)"""
    if radius % 2:
        raise ValueError("radius must be even")
    masks = F.array(*[F.struct(F.lit(i).cast("short").alias("mask"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("bits")) for i, m in enumerate(covering_masks(radius))])
    rows = fps.select("fp", F.explode(masks).alias("k")).select("fp", "k.mask", "k.bits")
    buckets = rows.groupBy("mask", "bits").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("n > 1")
    buckets = keep(buckets, "buckets")
    within = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= radius
    out = buckets.where("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).where(within)

    members = rows.join(buckets.where(F.col("n") > 2).select("mask", "bits", "n"), ["mask", "bits"])
    groups = members.where(F.col("n") <= pairwise).groupBy("mask", "bits").agg(F.collect_list("fp").alias("fps")).select("fps")

    def compare(batches):
        for batch in batches:
            links = [x for fps in batch.column(0) for x in forest(fps.values.to_numpy(), radius)]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*links, strict=True) if links else ([], []))], names=["a", "b"])

    out = out.unionByName(groups.mapInArrow(compare, "a long, b long"))
    hot = keep(members.where(F.col("n") > pairwise).select("fp").distinct(), "hot") if buckets.where(F.col("n") > pairwise).limit(1).count() else None
    if hot is not None:
        near = [sum(1 << i for i in c) for k in range(radius // 2 + 1) for c in itertools.combinations(range(BITS), k)]
        ball = hot.select("fp", F.explode(F.array(*[F.lit(_signed(x)) for x in near])).alias("x")).select("fp", F.col("fp").bitwiseXOR(F.col("x")).alias("z"))
        groups = ball.groupBy("z").agg(F.collect_set("fp").alias("fps"), F.min("fp").alias("a")).where(F.size("fps") > 1)
        out = out.unionByName(groups.select("a", F.explode("fps").alias("b")).where("a <> b"))
    return out.distinct()


def simhash_groups(docs: DataFrame, radius: int = 4, words: int = 4, pairwise: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp long, component_id, component) of every row: component_id is the smallest doc_id to which links lead,
    component the least fingerprint.

    Two rows link if their fingerprints differ in at most ``radius`` bits. Equal fingerprints are one node, so copies
    cost nothing more. Null, empty and blank texts have fingerprint 0 and link like any other; rows without an id take
    no part and get a null component; repeated rows agree; rows of one id with different texts are different documents,
    which that id alone doesn't link; an empty table gives an empty one; other columns are ignored. A very long text's
    shingles are hashed in one task, in 8 bytes of memory for each."""
    fps = keep(fingerprints(docs, words, id_col, text_col), "fingerprints")
    nodes = keep(fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("rep")), "nodes")
    parts = connected_components(near_links(nodes.select("fp"), radius, pairwise))
    joined = nodes.join(parts, nodes.fp == parts.node, "left").select("fp", "rep", F.coalesce("component", "fp").alias("component"))
    joined = keep(joined, "components")
    least = keep(joined.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = keep(joined.join(least, "component"), "named")
    out = fps.join(named, "fp", "left")
    known = F.col("doc_id").isNotNull()
    return out.select("doc_id", "fp", F.when(known, F.col("component_id")).alias("component_id"), F.when(known, F.col("component")).alias("component"))


def drop_near_copies(docs: DataFrame, radius: int = 4, words: int = 4, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of each simhash_groups() component, one with its smallest id; rows without an id stay.

    All columns stay as they are, whatever their names. Null and empty texts are near copies of each other. An id that
    occurs more than once, which needs each row's own fingerprint, has it computed again for its rows alone; of such
    rows that are the first of their component one is left. An empty table gives an empty one. What goes is broadcast
    up to broadcast_rows ids, else both sides are shuffled by the id."""
    groups = keep(simhash_groups(docs, radius, words, id_col=id_col, text_col=text_col).where("doc_id is not null"), "groups")
    c_id, c_fp, c_own, c_component, c_gone = unused(docs, "id", "fp", "own", "component", "gone")
    ids = groups.groupBy(F.col("doc_id").alias(c_id)).agg(F.count(F.lit(1)).alias("n"), F.max(F.col("doc_id") != F.col("component_id")).alias(c_gone))
    ids = keep(ids.where(F.col(c_gone) | (F.col("n") > 1)).select(c_id, F.when(F.col("n") == 1, F.col(c_gone)).alias(c_gone)), "ids")
    ready = lambda df: F.broadcast(df) if is_small(df, broadcast_rows) else df
    same = F.col(id_col).cast("long") == F.col(c_id)
    out = docs.join(ready(ids.where(c_gone)), same, "left_anti")
    again = ids.where(F.col(c_gone).isNull()).select(c_id)
    if not again.limit(1).count():
        return out.select(docs.columns)
    rest = out.join(ready(again), same, "left_anti").select(docs.columns)

    @F.pandas_udf("long")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, words) for t in texts], dtype="int64")

    first = groups.where("doc_id = component_id").join(again, F.col("doc_id") == F.col(c_id)).select(F.col("doc_id").alias(c_id), F.col("fp").alias(c_fp), F.col("component").alias(c_component)).distinct()
    some = docs.join(ready(again), same).drop(c_id).withColumns({c_own: own(F.col(text_col))})
    # Different texts of one frequent id are dealt out by their fingerprints.
    some = some.join(first, (F.col(id_col).cast("long") == F.col(c_id)) & (F.col(c_own) == F.col(c_fp)))
    return rest.unionByName(some.dropDuplicates([c_component]).select(docs.columns))


def hex16(fp):
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
