"""MinHash near-duplicates: fast similarity sketches, banding, and verification on the full shingle sets."""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import connected_components, is_small, keep

_TOP = np.uint64(2**64 - 1)


def _mixed(x: np.ndarray) -> np.ndarray:
    """Each 64-bit number scattered over all 64-bit numbers, one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, words: int = 5) -> np.ndarray:
    """The distinct word shingles of a text as sorted 64-bit hashes; a text of fewer words has one shingle, of all of them."""
    import xxhash

    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hash64, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        return np.array([hash64(joined)], np.uint64)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(sizes + 1) - 1
    n = len(parts) - words + 1
    return np.unique(np.fromiter((hash64(joined[a:b]) for a, b in zip((ends - sizes)[:n].tolist(), ends[words - 1 :].tolist(), strict=True)), np.uint64, n))


def sketch(hashes: np.ndarray, size: int = 128) -> np.ndarray:
    """A fast similarity sketch of a non-empty set: two sets agree in a coordinate with the chance of their Jaccard similarity.

    Each round throws all elements into bins anew, with a value that starts with the round's number; a bin keeps its
    least value. In the first ``size`` rounds the bin is hashed, in the next ones round i fills bin i - size, so all are
    filled in the end. Rounds stop once they are: later values are larger than any that is kept."""
    out = np.full(size, _TOP, np.uint64)
    lot = max(1, 2048 // len(hashes))
    for first in range(0, 2 * size, lot):
        rounds = np.arange(first, min(first + lot, 2 * size), dtype=np.uint64)[:, None]
        h = _mixed(hashes[None, :] ^ _mixed((rounds + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        bins = np.where(rounds < size, h % np.uint64(size), rounds - np.uint64(size)).astype(np.int64)
        np.minimum.at(out, bins.ravel(), (rounds << np.uint64(55) | h >> np.uint64(9)).ravel())
        if out.max() < _TOP:
            break
    return out


def band_keys(coordinates: np.ndarray, rows: int) -> np.ndarray:
    """A 64-bit key of each band of ``rows`` coordinates."""
    bands = coordinates[: len(coordinates) // rows * rows].reshape(-1, rows)
    out = np.arange(len(bands), dtype=np.uint64)
    for j in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + bands[:, j])
    return out.view(np.int64)


def _digest(hashes: np.ndarray) -> tuple[int, int]:
    d = hashlib.blake2b(hashes.tobytes(), digest_size=16).digest()
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def sketches(docs: DataFrame, words: int, size: int, rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n, hi, lo, bands, sig) of every row: set size, digest of the set, band keys, and sixteen bits of each coordinate; those are null for an empty set."""

    def run(batches):
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                hashes = shingles(text, words)
                if len(hashes):
                    s = sketch(hashes, size)
                    out.append((len(hashes), *_digest(hashes), band_keys(s, rows), (s >> np.uint64(20)).astype(np.uint16).tobytes()))
                else:
                    out.append((0, None, None, None, None))
            columns = zip(*out, strict=True) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]], names=["doc_id", "n", "hi", "lo", "bands", "sig"])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.binary()]
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, n long, hi long, lo long, bands array<long>, sig binary")


def full_sets(ends: DataFrame, sets: DataFrame, docs: DataFrame, words: int, broadcast_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(node, hashes) of the nodes of ends: their full shingle sets, cut from the texts again."""
    ends = keep(ends.join(sets.select("node", "rep", "hi", "lo"), "node"), "ends")
    texts = docs.select(F.col(id_col).cast("long").alias("rep"), F.col(text_col).alias("text"))
    texts = texts.join(F.broadcast(ends) if is_small(ends, broadcast_rows) else ends, "rep").select("node", "hi", "lo", "text")

    def cut(batches):
        for batch in batches:
            nodes, hi, lo, texts = (c.to_pylist() for c in batch.columns)
            rows = [(node, h.tobytes()) for node, a, b, text in zip(nodes, hi, lo, texts, strict=True) if _digest(h := shingles(text, words)) == (a, b)]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.binary())], names=["node", "hashes"])

    # An id may stand in several rows.
    return keep(texts.mapInArrow(cut, "node long, hashes binary"), "full").dropDuplicates(["node"])


def verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, words: int, percent: int, broadcast_rows: int, id_col: str, text_col: str) -> DataFrame:
    """(a, b, distance, linked) of each pair (a, b) of nodes of sets (node, rep, hi, lo): the Jaccard distance of the full shingle sets.

    Only texts of nodes in some pair are cut into shingles again; up to broadcast_rows such nodes are broadcast to the
    texts, beyond that both sides are shuffled."""
    ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    full = full_sets(ends, sets, docs, words, broadcast_rows, id_col, text_col)
    side = lambda k: full.select(F.col("node").alias(k), F.col("hashes").alias(f"h{k}"))

    def compare(batches):
        for batch in batches:
            a, b, *sides = batch.columns
            x, y = ([np.frombuffer(h.as_buffer(), np.uint64) for h in c] for c in sides)
            common = np.array([len(np.intersect1d(p, q, assume_unique=True)) for p, q in zip(x, y, strict=True)], np.int64)
            union = np.array([len(p) + len(q) for p, q in zip(x, y, strict=True)], np.int64) - common
            yield pa.RecordBatch.from_arrays([a, b, pa.array(1 - common / np.maximum(1, union), pa.float64()), pa.array(100 * common >= percent * union)], names=["a", "b", "distance", "linked"])

    return pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "ha", "hb").mapInArrow(compare, "a long, b long, distance double, linked boolean")


def _near(rows: list[dict], band: int, width: int, percent: int, least: int, most: int | None) -> list[tuple[int, int]]:
    """Pairs of different components that agree in at least so many coordinates and whose sizes allow the similarity.

    A pair that shares an earlier band too is left to it. Jaccard distance is a metric: two sets whose known distances
    from the bucket's least node differ by more than a link's are no pair. With ``most``, of the pairs of two
    components only that many, those that agree best."""
    known = np.array([np.nan if r["distance"] is None else r["distance"] for r in rows])
    far = 1 - percent / 100 + 1e-9
    node, n, component = (np.array([r[k] for r in rows], np.int64) for k in ("node", "n", "component"))
    sig = np.frombuffer(b"".join(r["sig"] for r in rows), np.uint16).reshape(len(rows), -1)
    before = sig[:, : band * width].copy().view(f"V{2 * width}") if band else sig[:, :0]
    found = []
    for i in range(len(rows)):
        j = i + 1 + np.flatnonzero((component[i + 1 :] != component[i]) & (100 * np.minimum(n[i + 1 :], n[i]) >= percent * np.maximum(n[i + 1 :], n[i])))
        same = (sig[j] == sig[i]).sum(1)
        stays = (same >= least) & ~(np.abs(known[j] - known[i]) > far)
        if band:
            stays &= ~(before[j] == before[i]).any(1)
        j, same = j[stays], same[stays]
        found.append(np.c_[np.minimum(component[j], component[i]), np.maximum(component[j], component[i]), -same, np.minimum(node[j], node[i]), np.maximum(node[j], node[i])])
    pairs = np.concatenate(found)
    if most is not None and len(pairs):
        pairs = pairs[np.lexsort(pairs.T[::-1])]
        first = np.flatnonzero(np.append(True, (np.diff(pairs[:, :2], axis=0) != 0).any(1)))
        pairs = pairs[np.arange(len(pairs)) - np.repeat(first, np.diff(np.append(first, len(pairs)))) < most]
    return pairs[:, 3:].tolist()


def _cells(members: DataFrame, block: int, columns: list[str]) -> DataFrame:
    """(key, rows, band): members of buckets with several components, in the blocks that meet in a task.

    A bucket's members are told apart as those of its least node's component and the others, each dealt by hash into
    blocks of about ``block``; two blocks meet in one task, but never two of the first kind, so that a bucket in which
    a large group meets a few others costs the large group times those few."""
    counts = members.groupBy("key", "component").agg(F.count(F.lit(1)).alias("c"), F.min("node").alias("m"))
    each = counts.groupBy("key").agg(F.min_by("component", "m").alias("lead"), F.min_by("c", "m").alias("first"), F.sum("c").alias("c")).where("c > first")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    each = keep(each.select("key", "lead", blocks("first").alias("nd"), F.ceil((F.col("c") - F.col("first")) / block).cast("int").alias("no")), "mixed")
    rows = members.join(each, "key").withColumn("main", F.col("component") == F.col("lead"))
    rows = rows.withColumn("k", F.pmod(F.xxhash64("node"), F.when(F.col("main"), F.col("nd")).otherwise(F.col("no"))).cast("int"))
    cell = lambda t, i, j: F.struct(F.lit(t).alias("t"), i.cast("int").alias("i"), j.cast("int").alias("j"))
    upto = lambda c: F.sequence(F.lit(0), F.col(c) - 1)
    mixed = F.transform(upto("nd"), lambda i: cell(0, i, F.col("k")))
    others = F.when(F.col("no") > 1, F.transform(upto("no"), lambda i: cell(1, F.least(i, "k"), F.greatest(i, "k")))).otherwise(F.slice(F.transform(upto("no"), lambda i: cell(1, i, i)), 1, 0))
    cells = F.when(F.col("main"), F.transform(upto("no"), lambda j: cell(0, F.col("k"), j))).otherwise(F.concat(mixed, others))
    return rows.withColumn("cell", F.explode(cells)).groupBy("key", "cell").agg(F.collect_list(F.struct(*columns)).alias("rows"), F.first("band").alias("band")).select("key", "rows", "band")


def likely(members: DataFrame, width: int, percent: int, least: int, block: int, most: int | None = None) -> DataFrame:
    """(key, node): members (key, band, node, n, component, distance, sig) that by their sketches may be similar to one of
    another component in their bucket. A row for each member, not for each pair. With ``most``, see _near()."""

    def run(batches):
        for batch in batches:
            out = [(r["key"], node) for r in batch.to_pylist() for node in sorted({k for p in _near(r["rows"], r["band"], width, percent, least, most) for k in p})]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], names=["key", "node"])

    return _cells(members, block, ["node", "n", "component", "distance", "sig"]).mapInArrow(run, "key long, node long").distinct()


def _linked(rows: list[dict], pairs: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Those of the pairs that link by their full sets, without links between components that earlier ones join."""
    full = {r["node"]: np.frombuffer(r["hashes"], np.uint64) for r in rows}
    top = {r["component"]: r["component"] for r in rows}
    component = {r["node"]: r["component"] for r in rows}

    def find(x):
        while top[x] != x:
            top[x] = x = top[top[x]]
        return x

    out = []
    for a, b in pairs:
        x, y = find(component[a]), find(component[b])
        if x != y:
            p, q = full[a], full[b]
            common = len(np.intersect1d(p, q, assume_unique=True))
            if 100 * common >= percent * (len(p) + len(q) - common):
                top[max(x, y)] = min(x, y)
                out.append((a, b))
    return out


def links_between(members: DataFrame, full: DataFrame, width: int, percent: int, least: int, block: int, most: int | None = None) -> DataFrame:
    """(a, b): links between components of members, each checked on full sets (node, hashes) in the task where both meet.

    Only links leave a task, and of them no more than join its components, so rows grow with members, not pairs."""

    def run(batches):
        for batch in batches:
            pairs = []
            for i in range(batch.num_rows):  # one cell at a time, as full sets are large
                r = batch.slice(i, 1).to_pylist()[0]
                pairs += _linked(r["rows"], _near(r["rows"], r["band"], width, percent, least, most), percent)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.int64()) for k in (0, 1)], names=["a", "b"])

    columns = ["node", "n", "component", "distance", "sig", "hashes"]
    return _cells(members.join(full, "node"), block, columns).mapInArrow(run, "a long, b long").distinct()


def minhash_groups(docs: DataFrame, words: int = 5, percent: int = 80, size: int = 128, rows: int = 4, block: int = 1024, broadcast_rows: int = 200_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row: component_id is the smallest doc_id to which links lead.

    Rows link if the Jaccard similarity of their sets of word shingles is at least percent / 100. Equal sets are one
    node. Candidates share a bucket: the least node of a bucket is compared with all others, and what then still lies
    in different components is compared by sketches, a block of members with another; every candidate is confirmed on
    full sets. Without such a link a pair of different components is left out, so copies of one text never meet in all
    pairs. Two sets of similarity 0.8 share no bucket with a chance of (1 - 0.8^4)^32 = 5e-8, and a sketch misleads
    with one of 1e-9; other settings have other chances.

    Null, empty and blank texts have an empty set and link with nothing. Rows without an id take no part, get a null
    component and are kept; repeated rows agree; rows of one id with different texts are different documents, which the
    id alone doesn't link. An empty table gives an empty one; other columns are ignored. A very long text's shingles are
    hashed in one task, in some 40 bytes for each."""
    all_rows = keep(sketches(docs, words, size, rows, id_col, text_col), "sketches")
    first = [F.first(c).alias(c) for c in ("n", "bands", "sig")]
    sets = all_rows.where("doc_id is not null and n > 0").groupBy("hi", "lo").agg(F.min("doc_id").alias("rep"), *first)
    sets = keep(sets.withColumn("node", F.monotonically_increasing_id()), "sets")
    members = sets.select("node", "n", F.posexplode("bands").alias("band", "key"))
    lead = F.min(F.struct("node", "n")).alias("lead")
    buckets = keep(members.groupBy("key").agg(F.count(F.lit(1)).alias("c"), lead).where("c > 1").select("key", "c", F.col("lead.node").alias("a"), F.col("lead.n").alias("na")), "buckets")
    allowed = 100 * F.least("n", "na") >= percent * F.greatest("n", "na")
    star = keep(members.join(buckets, "key").where((F.col("node") != F.col("a")) & allowed).select("a", F.col("node").alias("b")).distinct(), "stars")
    check = lambda pairs: keep(verified(pairs, sets, docs, words, percent, broadcast_rows, id_col, text_col), "links")
    known = check(star)
    pairs = lambda: known.where("linked").select("a", "b")
    parts = keep(connected_components(pairs()), "parts")
    from_lead = known.select("a", F.col("b").alias("node"), "distance")
    open_ = members.join(buckets.where("c > 2").select("key", "a"), "key").join(from_lead, ["a", "node"], "left")
    distance = F.when(F.col("node") == F.col("a"), 0.0).otherwise(F.col("distance"))
    open_ = keep(open_.select("key", "band", "node", "n", distance.alias("distance")).join(sets.select("node", "sig"), "node"), "open")
    least = math.floor(size * (percent / 100 - 6 * math.sqrt(percent / 100 * (1 - percent / 100) / size)))
    links = pairs()
    for most in (2, None):  # the likeliest pairs first, as most components meet in them; then all that are left
        now = keep(open_.join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "now")
        some = keep(likely(now, rows, percent, least, block, most), "likely")
        if not some.limit(1).count():
            break
        full = full_sets(some.select("node").distinct(), sets, docs, words, broadcast_rows, id_col, text_col)
        # Where pairs are counted out, those counted are of all members; the others only lose pairs that can't link.
        links = links.unionByName(keep(links_between(now.join(some, ["key", "node"], "left_semi"), full, rows, percent, least, max(1, block // 4), most), "more"))
        parts = keep(connected_components(links), "parts")

    named = keep(sets.select("node", "hi", "lo", "rep").join(parts, "node", "left").withColumn("component", F.coalesce("component", "node")), "named")
    least_ids = keep(named.groupBy("component").agg(F.min("rep").alias("component_id")), "least")
    named = keep(named.join(least_ids, "component").select("hi", "lo", "component_id"), "components")
    out = all_rows.select("doc_id", F.col("n").alias("n_shingles"), "hi", "lo").join(named, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
