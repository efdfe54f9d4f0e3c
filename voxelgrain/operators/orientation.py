"""The shape of regions from second moments of their coordinates: sums that merge, and closed forms for what follows."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import AXES

PAIRS = list(itertools.combinations_with_replacement(AXES, 2))
SUMS = ["n", *[f"s_{a}" for a in AXES], *[f"s_{a}{b}" for a, b in PAIRS]]


def coordinate_sums(rows: DataFrame, keys: list[str]) -> DataFrame:
    """keys and n, s_z, ..., s_zz, s_zy, ...: exact sums of coordinates and of their products, which merge by addition."""
    of = lambda a: F.col(a).cast("long")
    sums = [F.count(F.lit(1)).alias("n"), *[F.sum(of(a)).alias(f"s_{a}") for a in AXES], *[F.sum(of(a) * of(b)).alias(f"s_{a}{b}") for a, b in PAIRS]]
    return rows.groupBy(*keys).agg(*sums)


def merge_sums(sums: DataFrame, keys: list[str]) -> DataFrame:
    return sums.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in SUMS])


def described(sums: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n, centre (array), val1 >= val2 >= val3, coherence, axis (array).

    The values are the eigenvalues of the sample covariance of the coordinates over n, coherence is the squared relative
    difference of the first two, axis the unit vector of the first; it is zero where the first two are equal. One voxel
    has no spread: all are 0."""
    exact = lambda c: F.col(c).cast("decimal(19,0)")  # noqa: E731  (n * sum - sum * sum cancels in doubles)
    n = F.col("n").cast("double")

    def cov(a: str, b: str) -> Column:
        c = (exact("n") * exact(f"s_{a}{b}") - exact(f"s_{a}") * exact(f"s_{b}")).cast("double")
        return F.when(F.col("n") > 1, c / (n * (n - 1) * n)).otherwise(0.0)

    out = sums.select(*keys, "n", F.array(*[F.col(f"s_{a}") / n for a in AXES]).alias("centre"), *[cov(a, b).alias(f"{a}{b}") for a, b in PAIRS])
    # The eigenvalues of a symmetric 3 x 3 matrix by the cosines of a third of an angle.
    q = (F.col("zz") + F.col("yy") + F.col("xx")) / 3
    off = F.col("zy") * F.col("zy") + F.col("zx") * F.col("zx") + F.col("yx") * F.col("yx")
    out = out.withColumn("q", q)
    d = {a: F.col(f"{a}{a}") - F.col("q") for a in AXES}
    out = out.withColumn("p", F.sqrt((d["z"] * d["z"] + d["y"] * d["y"] + d["x"] * d["x"] + 2 * off) / 6))
    det = d["z"] * (d["y"] * d["x"] - F.col("yx") * F.col("yx")) - F.col("zy") * (F.col("zy") * d["x"] - F.col("yx") * F.col("zx")) + F.col("zx") * (F.col("zy") * F.col("yx") - d["y"] * F.col("zx"))
    r = F.when(F.col("p") > 0, F.greatest(F.lit(-1.0), F.least(F.lit(1.0), det / (2 * F.col("p") * F.col("p") * F.col("p"))))).otherwise(0.0)
    out = out.withColumn("_r", r).withColumn("phi", F.acos("_r") / 3)
    val = lambda turn: F.col("q") + 2 * F.col("p") * F.cos(F.col("phi") + turn)
    out = out.withColumn("_far", F.when(F.col("_r") < 0, val(2 * math.pi / 3)).otherwise(val(0.0)))
    # The value farthest from the others is exact to the last digits, the gap of the other two is not: where they are
    # nearly equal the cosines keep half of the digits. There the matrix is taken across the far value's axis w, where the
    # others are those of a 2 x 2 matrix. The rows of the matrix less that value are at right angles to w, so w is the
    # longest of their cross products.
    at = lambda i, j: F.col("".join(sorted((AXES[i], AXES[j]), reverse=True)))
    rows = [[at(i, j) - F.col("_far") if i == j else at(i, j) for j in range(3)] for i in range(3)]
    cross = lambda a, b: F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])
    out = out.withColumn("_c", F.array(*[cross(rows[i], rows[j]) for i, j in ((0, 1), (0, 2), (1, 2))]))
    size = lambda v: dot(v, v)
    out = out.withColumn("_w", F.array_max(F.transform("_c", lambda v: F.struct(size(v).alias("size"), v.alias("v")))))
    unit = lambda v: F.transform(v, lambda x: x / F.sqrt(size(v)))
    w = F.when(F.col("_w.size") > 0, F.transform("_w.v", lambda x: x / F.sqrt(F.col("_w.size")))).otherwise(F.array(*[F.lit(1.0), F.lit(0.0), F.lit(0.0)]))
    out = out.withColumn("_w", w)
    # Two unit vectors across w: the first at right angles to the axis that w is least along, too.
    least = F.least(*[F.abs(F.col("_w")[i]) for i in range(3)])
    e = [F.array(*[F.lit(float(i == j)) for j in range(3)]) for i in range(3)]
    aside = F.when(F.abs(F.col("_w")[0]) == least, e[0]).when(F.abs(F.col("_w")[1]) == least, e[1]).otherwise(e[2])
    out = out.withColumn("_e", aside).withColumn("_p", cross(F.col("_w"), F.col("_e"))).withColumn("_p", unit(F.col("_p"))).withColumn("_q", cross(F.col("_w"), F.col("_p")))
    times = lambda p, q: sum((at(i, j) * F.col(p)[i] * F.col(q)[j] for i in range(3) for j in range(3)), F.lit(0.0))
    out = out.withColumn("_pp", times("_p", "_p")).withColumn("_qq", times("_q", "_q")).withColumn("_pq", times("_p", "_q"))
    half = (F.col("_pp") - F.col("_qq")) / 2
    out = out.withColumn("_half", half).withColumn("_gap", F.sqrt(half * half + F.col("_pq") * F.col("_pq"))).withColumn("_mid", (F.col("_pp") + F.col("_qq")) / 2)
    out = out.withColumn("_turn", F.atan2("_pq", "_half") / 2)
    upper, lower = F.col("_mid") + F.col("_gap"), F.col("_mid") - F.col("_gap")
    last = F.col("_r") < 0  # the far value is the least one
    plain = [val(0.0), val(2 * math.pi / 3)]
    out = out.withColumn("_1", plain[0]).withColumn("_3", plain[1]).withColumn("_2", 3 * F.col("q") - F.col("_1") - F.col("_3"))
    close = (F.col("_1") - F.col("_2")) <= 1e-6 * F.abs(F.col("_1"))
    pick = lambda when_last, else_, far_apart: F.when(~close, far_apart).when(last, when_last).otherwise(else_)
    out = out.withColumn("val1", pick(upper, F.col("_far"), F.col("_1"))).withColumn("val2", pick(lower, upper, F.col("_2"))).withColumn("val3", pick(F.col("_far"), lower, F.col("_3")))
    out = out.withColumn("_split", F.when(close & last, 2 * F.col("_gap")).otherwise(F.col("val1") - F.col("val2")))
    total = F.col("val1") + F.col("val2")
    out = out.withColumn("coherence", F.when(total > 0, (F.col("_split") / total) ** 2).otherwise(0.0))
    across = F.zip_with("_p", "_q", lambda x, y: F.cos("_turn") * x + F.sin("_turn") * y)
    axis = F.when(F.col("_split") > 1e-9 * F.abs(F.col("val1")), F.when(last, across).otherwise(F.col("_w"))).otherwise(F.array(*[F.lit(0.0)] * 3))
    return out.select(*keys, "n", "centre", "val1", "val2", "val3", "coherence", axis.alias("axis"))


def dot(a: Column, b: Column) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def folded_angle(a: Column, b: Column) -> Column:
    """The angle between two lines along unit vectors, up to a right angle; that too where one is zero."""
    return F.acos(F.least(F.lit(1.0), F.abs(dot(a, b))))


def angles(edge_table: DataFrame, shapes: DataFrame) -> DataFrame:
    """(u, v, between, least, most, mean): the angle between the axes of both ends, and the least, largest and mean angle of
    the two to the line through their centres. shapes is described() by node."""
    side = lambda k: shapes.select(F.col("node").alias(k), F.col("axis").alias(f"a{k}"), F.col("centre").alias(f"c{k}"))
    rows = edge_table.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    rows = rows.withColumn("_d", F.zip_with("cu", "cv", lambda p, q: p - q)).withColumn("_l", F.sqrt(dot(F.col("_d"), F.col("_d"))))
    rows = rows.withColumn("_d", F.when(F.col("_l") > 0, F.transform("_d", lambda x: x / F.col("_l"))).otherwise(F.col("_d")))
    p, q = folded_angle(F.col("au"), F.col("_d")), folded_angle(F.col("av"), F.col("_d"))
    return rows.select("u", "v", folded_angle(F.col("au"), F.col("av")).alias("between"), F.least(p, q).alias("least"), F.greatest(p, q).alias("most"), ((p + q) / 2).alias("mean"))
