"""Hard-negative mining by a table of pivot distances."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import keep


def integer_vectors(table: DataFrame, anchor: Column, scale: int, id_col: str, label_col: str, vector_col: str) -> DataFrame:
    """(vec_id, label, v, anchor, k) of the rows that take part: v the floors of the scaled components, k a hash that tells rows of one id apart."""
    x = F.col("x").cast("array<double>")
    bad = F.exists(x, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("x"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("x").isNotNull()).where(~bad)
    most = F.lit(float(2**31))
    v = F.transform(x, lambda c: F.floor(F.greatest(-most, F.least(most, c * scale))))
    return rows.select("vec_id", "label", v.alias("v"), "anchor").distinct().withColumn("k", F.xxhash64("label", "v", "anchor"))


class PivotTable:
    """Pivots on the sphere of radius M, the longest row's length, to which every row is lifted by one more component.

    A query is stretched to the length M and gets 0 there; then its inner product with a row is
    |q| / 2M * (2 M^2 - d^2), d their distance, and distances to the pivots bracket d by the triangle inequality."""

    def __init__(self, sample: np.ndarray, radius: float, pivots: int):
        self.radius = radius
        lifted = self.lift(sample)
        chosen, far = [0], np.full(len(lifted), np.inf)
        while len(chosen) < min(pivots, len(lifted)):  # the one farthest from those chosen comes next
            far = np.minimum(far, ((lifted - lifted[chosen[-1]]) ** 2).sum(1))
            if far.max() <= 0:
                break
            chosen.append(int(far.argmax()))
        self.pivots = lifted[chosen]

    def lift(self, x: np.ndarray) -> np.ndarray:
        return np.c_[x, np.sqrt(np.maximum(0.0, self.radius**2 - (x * x).sum(1)))]

    def _distances(self, products: np.ndarray) -> np.ndarray:
        return np.sqrt(np.maximum(0.0, 2 * self.radius**2 - 2 * products))

    def of_rows(self, x: np.ndarray) -> np.ndarray:
        return self._distances(self.lift(x) @ self.pivots.T)

    def of_queries(self, q: np.ndarray) -> np.ndarray:
        stretch = self.radius / np.maximum(1e-300, np.sqrt((q * q).sum(1)))
        return self._distances((q * stretch[:, None]) @ self.pivots[:, :-1].T)

    def brackets(self, length: float, dq: np.ndarray, dx: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds below and above the inner products of a query of that length with rows at distances dx from the pivots."""
        m = self.radius
        if not m or not length:
            return np.zeros(len(dx)), np.zeros(len(dx))
        near, far = np.abs(dx - dq).max(1), np.minimum(2 * m, (dx + dq).min(1))
        slack = 1e-7 * length * m + 1e-6
        return length / (2 * m) * (2 * m * m - far**2) - slack, length / (2 * m) * (2 * m * m - near**2) + slack


class _Block:
    """One side of a block: Arrow columns as arrays, vectors padded with zeros."""

    def __init__(self, table: pa.Table, dims: int):
        get = lambda c: table.column(c).to_numpy()
        self.id, self.k, self.label = get("vec_id"), get("k"), get("label")
        self.v = _matrix(table.column("v"), dims)

    def products(self, at: np.ndarray, q: np.ndarray, exact_in_double: bool) -> np.ndarray:
        if exact_in_double:
            return (self.v[at].astype(np.float64) @ q.astype(np.float64)).astype(np.int64)
        return (self.v[at].astype(object) @ q.astype(object)).astype(np.int64)

    def first(self, at: np.ndarray, scores: np.ndarray, most: int) -> np.ndarray:
        """Places in at of the highest scores, ties by smaller id."""
        return np.lexsort((self.k[at], self.id[at], -scores))[:most]


def _matrix(column, dims: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.asarray(column.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    out = np.zeros((len(column), dims), column.type.value_type.to_pandas_dtype())
    out[np.repeat(np.arange(len(column)), lengths), np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = column.flatten().to_numpy()
    return out


def _kth(values: np.ndarray, k: int) -> float:
    return float(np.partition(values, len(values) - k)[len(values) - k]) if len(values) >= k else -math.inf


def hard_negatives(table: DataFrame, anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, scale: int = 256, pivots: int = 16, sample: int = 2048, row_block: int = 8192, anchor_block: int = 4096, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score), all pairs of ``anchor`` rows and their positives.

    A component x counts as floor(scale * x), a score is an integer inner product. The positives of an anchor are the
    first ``positives`` other rows of its label, by falling score and then by id; the negatives of a pair the first
    ``negatives`` rows of other labels with low * positive_score <= 100 * negative_score <= high * positive_score.

    The pivots, farthest-first in a sample of ``sample`` rows with the least hashes, are all that the driver gets; the
    table of distances covers every row. Rows are dealt by label, nearest pivot and id into blocks of equal size,
    anchors likewise; a block of anchors meets a block of rows in one task only if the brackets of the blocks allow a
    score that counts, and there each anchor's exact scores are taken of the rows whose own brackets do.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Equal rows count once; rows
    of one id that differ are different rows. Shorter vectors end in zeros. Other columns are ignored; no rows, or no
    anchors, give an empty table. Components from 2^31 on after scaling, or squared lengths from 2^62 on, raise an
    error, as scores are 64-bit."""
    out = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    spark = table.sparkSession
    rows = keep(integer_vectors(table, anchor, scale, id_col, label_col, vector_col), "vectors")
    square = F.aggregate("v", F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    most = F.max(F.greatest(F.coalesce(F.array_max(F.transform("v", lambda c: F.abs(c))), F.lit(0)), F.lit(0)))
    n, anchors_n, squared, dims, largest = rows.agg(F.count(F.lit(1)), F.count_if("anchor"), F.max(square), F.max(F.size("v")), most).first()
    if not n or not anchors_n:
        return spark.createDataFrame([], out)
    if largest >= 2**31 or squared >= 2**62:
        raise ValueError("vectors are too long for 64-bit scores")
    few = rows.select("v", F.xxhash64("vec_id", "k").alias("h"), "vec_id").orderBy("h", "vec_id").limit(sample).select("v").toArrow()
    index = PivotTable(_matrix(few.column(0), dims).astype(np.float64), math.sqrt(squared), pivots)
    count, in_double = len(index.pivots), squared < 2**52

    def measure(batches):
        for batch in batches:
            x = _matrix(batch.column("v"), dims).astype(np.float64)
            dx, dq = index.of_rows(x), index.of_queries(x)
            more = [pa.array(dx.argmin(1), pa.int32()), pa.array(list(dx), pa.list_(pa.float64())), pa.array([d if a else None for d, a in zip(dq, batch.column("anchor").to_pylist(), strict=True)], pa.list_(pa.float64())), pa.array(np.sqrt((x * x).sum(1)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *more], names=[*batch.schema.names, "cell", "dx", "dq", "length"])

    kind = dict(rows.dtypes)["label"]
    measured = rows.mapInArrow(measure, f"vec_id long, label {kind}, v array<long>, anchor boolean, k long, cell int, dx array<double>, dq array<double>, length double")
    measured = keep(measured, "distances")
    deal = lambda df, blocks, name: keep(df.repartitionByRange(blocks, "label", "cell", "vec_id", "k").withColumn(name, F.spark_partition_id()), f"blocks_{name}")
    blocks = deal(measured.drop("dq", "anchor", "length"), math.ceil(n / row_block), "g")
    queries = deal(measured.where("anchor").drop("dx", "anchor"), math.ceil(anchors_n / anchor_block), "a")
    ends = lambda c: [f(F.col(c)[i]).alias(f"{c}{i}_{m}") for i in range(count) for m, f in (("lo", F.min), ("hi", F.max))]
    by_g = keep(blocks.groupBy("g").agg(F.min("label").alias("l0"), F.max("label").alias("l1"), *ends("dx")), "summary")
    last = (by_g.agg(F.max("g")).first()[0] or 0) + 1

    def met(side: DataFrame, condition: Column) -> DataFrame:
        """The pairs (a, g) of blocks that may hold what is looked for; one row a block on either side."""
        return keep(side.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(last - 1)))).join(by_g, "g").where(condition).select("a", "g"), "met")

    def together(pairs: DataFrame, sides: DataFrame, run, schema: str) -> DataFrame:
        return sides.join(pairs, "a").groupBy("a", "g").cogroup(blocks.join(pairs, "g").groupBy("a", "g")).applyInArrow(run, schema)

    # The positives.
    of_label = queries.groupBy("a").agg(F.min("label").alias("q0"), F.max("label").alias("q1"))
    names = ["vec_id", "k", "positive_id", "pk", "score"]

    def same(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = _Block(left, dims), _Block(right, dims)
        dx, dq = _matrix(right.column("dx"), count), _matrix(left.column("dq"), count)
        found = []
        for i, length in enumerate(left.column("length").to_numpy()):
            at = np.flatnonzero((x.label == q.label[i]) & ((x.id != q.id[i]) | (x.k != q.k[i])))
            below, above = index.brackets(length, dq[i], dx[at])
            at = at[above >= _kth(below, positives)]
            scores = x.products(at, q.v[i], in_double)
            found += [(q.id[i], q.k[i], x.id[at[j]], x.k[at[j]], scores[j]) for j in x.first(at, scores, positives)]
        return pa.table(list(map(pa.array, zip(*found, strict=True))) if found else [pa.array([], pa.int64())] * 5, names=names)

    near = together(met(of_label, F.expr("l0 <= q1 and q0 <= l1")), queries, same, ", ".join(f"{c} long" for c in names))
    first = F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("minus"), "positive_id", "pk"))), 1, positives)
    near = near.groupBy("vec_id", "k").agg(first.alias("p"))
    some = F.filter("p", lambda p: p.minus <= 0)  # no score lies between shares of a negative one
    wanted = keep(queries.join(near, ["vec_id", "k"]).withColumn("p", some).where(F.size("p") > 0), "wanted")

    # The negatives.
    score = -F.element_at("p", F.size("p")).minus
    by_a = wanted.groupBy("a").agg(F.min(score).alias("least"), F.min("length").alias("s0"), F.max("length").alias("s1"), *ends("dq"))
    apart = F.greatest(F.lit(0.0), *[F.col(f"dq{i}_lo") - F.col(f"dx{i}_hi") for i in range(count)], *[F.col(f"dx{i}_lo") - F.col(f"dq{i}_hi") for i in range(count)])
    radius = max(index.radius, 1e-300)
    top = (2 * radius**2 - apart**2) / (2 * radius)
    most_score = F.when(top > 0, top * F.col("s1")).otherwise(top * F.col("s0")) + F.col("s1") * (1e-7 * radius) + 1e-6
    names_b = ["anchor_id", "ak", "positive_id", "pk", "positive_score", "negative_id", "nk", "negative_score"]

    def other(left: pa.Table, right: pa.Table) -> pa.Table:
        q, x = _Block(left, dims), _Block(right, dims)
        dx, dq = _matrix(right.column("dx"), count), _matrix(left.column("dq"), count)
        found = []
        for i, (length, pairs) in enumerate(zip(left.column("length").to_numpy(), left.column("p").to_pylist(), strict=True)):
            at = np.flatnonzero(x.label != q.label[i])
            below, above = index.brackets(length, dq[i], dx[at])
            windows, stays = [], np.zeros(len(at), bool)
            for p in pairs:
                s = -p["minus"]
                lo, hi = -(-low * s // 100), high * s // 100
                windows.append((p["positive_id"], p["pk"], s, lo, hi))
                sure = below[(below >= lo) & (above <= hi)]
                stays |= (above >= max(lo, _kth(sure, negatives))) & (below <= hi)
            at = at[stays]
            scores = x.products(at, q.v[i], in_double)
            for positive, pk, s, lo, hi in windows:
                inside = np.flatnonzero((scores >= lo) & (scores <= hi))
                for j in inside[x.first(at[inside], scores[inside], negatives)]:
                    found.append((q.id[i], q.k[i], positive, pk, s, x.id[at[j]], x.k[at[j]], scores[j]))
        return pa.table([pa.array(c, pa.int64()) for c in zip(*found, strict=True)] if found else [pa.array([], pa.int64())] * 8, names=names_b)

    found = together(met(by_a, most_score >= F.col("least") * (low / 100)), wanted, other, ", ".join(f"{c} long" for c in names_b))
    order = W.Window.partitionBy("anchor_id", "ak", "positive_id", "pk").orderBy(F.desc("negative_score"), "negative_id", "nk")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return ranked.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
