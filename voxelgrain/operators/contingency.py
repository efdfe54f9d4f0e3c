"""Comparing two labellings: contingency tables and the measures that follow from them.

A contingency table is a DataFrame (s, g, n): how many positions have label s in the one and g in the other. All
measures are aggregations of it; none needs the positions again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .grid import ranked


def contingency(pairs: DataFrame, s: str = "label", g: str = "gt", ignore_s: tuple = (), ignore_g: tuple = ()) -> DataFrame:
    """Counts of label pairs; positions with an ignored label on either side do not count."""
    rows = pairs.select(F.col(s).alias("s"), F.col(g).alias("g"))
    if ignore_s:
        rows = rows.where(~F.col("s").isin(*ignore_s))
    if ignore_g:
        rows = rows.where(~F.col("g").isin(*ignore_g))
    return rows.groupBy("s", "g").agg(F.count("*").alias("n"))


def normalised(table: DataFrame) -> DataFrame:
    """Adds p = n / sum of n; the sum is one row, joined to all."""
    total = table.agg(F.sum("n").alias("total"))
    return table.crossJoin(F.broadcast(total)).withColumn("p", F.col("n") / F.col("total")).drop("total")


def assignment(table: DataFrame) -> DataFrame:
    """(s, g): the label g with which s overlaps most; of equals the least."""
    return table.groupBy("s").agg(F.max_by(F.col("g"), F.struct(F.col("n"), -F.col("g"))).alias("g"))


def margins(table: DataFrame) -> DataFrame:
    """Adds rs and cg, the sums of n by s and by g."""
    rows = table.groupBy("s").agg(F.sum("n").alias("rs"))
    columns = table.groupBy("g").agg(F.sum("n").alias("cg"))
    return table.join(rows, "s").join(columns, "g")


def overlaps_of(table: DataFrame, s: int, most: int = 4) -> DataFrame:
    """The ``most`` largest partners of one label: (g, n, of_s, of_g), the overlap's share of either."""
    m = margins(table).where(F.col("s") == s)
    return m.select("g", "n", (F.col("n") / F.col("rs")).alias("of_s"), (F.col("n") / F.col("cg")).alias("of_g")).orderBy(F.desc("n"), "g").limit(most)


def xlogx(x: Column) -> Column:
    return F.when(x == 0, 0.0).otherwise(x * F.log2(x))


def split_vi(table: DataFrame) -> DataFrame:
    """One row (under, over): H(g|s), bits of false merges, and H(s|g), bits of false splits."""
    cell = F.col("n") * F.log2(F.col("n"))
    c = table.agg(F.sum(cell).alias("c"), F.sum("n").alias("t"))
    rows = table.groupBy("s").agg(F.sum("n").alias("x")).agg(F.sum(F.col("x") * F.log2("x")).alias("r"))
    cols = table.groupBy("g").agg(F.sum("n").alias("x")).agg(F.sum(F.col("x") * F.log2("x")).alias("k"))
    return c.crossJoin(rows).crossJoin(cols).select(((F.col("r") - F.col("c")) / F.col("t")).alias("under"), ((F.col("k") - F.col("c")) / F.col("t")).alias("over"))


def vi(table: DataFrame, weights: tuple[float, float] = (1.0, 1.0)) -> DataFrame:
    return split_vi(table).select((F.col("under") * weights[0] + F.col("over") * weights[1]).alias("vi"))


def conditional_entropies(table: DataFrame, of: str = "s") -> DataFrame:
    """(label, size, entropy, bits) by label: the entropy of the other side in it, and size / total times that."""
    other = table.groupBy(of).agg(F.sum("n").alias("size"), F.sum(F.col("n") * F.log2("n")).alias("c"))
    total = table.agg(F.sum("n").alias("t"))
    h = F.log2("size") - F.col("c") / F.col("size")
    return other.crossJoin(F.broadcast(total)).select(F.col(of).alias("label"), "size", h.alias("entropy"), (h * F.col("size") / F.col("t")).alias("bits"))


def worst_labels(table: DataFrame, of: str = "s", most: int = 20) -> DataFrame:
    return conditional_entropies(table, of).orderBy(F.desc("bits"), "label").limit(most)


def _pairs(x: Column) -> Column:
    return x * (x - 1) / 2


def rand_values(table: DataFrame) -> DataFrame:
    """One row (a, b, c, d): pairs of positions together in both, in s alone, in g alone, in neither."""
    cells = table.agg(F.sum(_pairs(F.col("n"))).alias("cc"), F.sum("n").alias("t"))
    rows = table.groupBy("s").agg(F.sum("n").alias("x")).agg(F.sum(_pairs(F.col("x"))).alias("rr"))
    cols = table.groupBy("g").agg(F.sum("n").alias("x")).agg(F.sum(_pairs(F.col("x"))).alias("gg"))
    out = cells.crossJoin(rows).crossJoin(cols)
    return out.select(F.col("cc").alias("a"), (F.col("rr") - F.col("cc")).alias("b"), (F.col("gg") - F.col("cc")).alias("c"), (_pairs(F.col("t")) - F.col("rr") - F.col("gg") + F.col("cc")).alias("d"))


def rand_measures(table: DataFrame) -> DataFrame:
    """One row: rand_index, adjusted_rand and fowlkes_mallows."""
    a, b, c, d = (F.col(x) for x in "abcd")
    nk = a + b + c + d
    e = (a + b) * (a + c) + (c + d) * (b + d)
    return rand_values(table).select(((a + d) / nk).alias("rand_index"), ((nk * (a + d) - e) / (nk * nk - e)).alias("adjusted_rand"), (a / F.sqrt((a + b) * (a + c))).alias("fowlkes_mallows"))


def adapted_rand_error(table: DataFrame) -> DataFrame:
    """One row (error, precision, recall)."""
    cells = table.agg(F.sum(F.col("n") * F.col("n")).alias("cc"), F.sum("n").alias("t"))
    rows = table.groupBy("s").agg(F.sum("n").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("rr"))
    cols = table.groupBy("g").agg(F.sum("n").alias("x")).agg(F.sum(F.col("x") * F.col("x")).alias("gg"))
    p = (F.col("cc") - F.col("t")) / (F.col("gg") - F.col("t"))
    r = (F.col("cc") - F.col("t")) / (F.col("rr") - F.col("t"))
    return cells.crossJoin(rows).crossJoin(cols).select(p.alias("precision"), r.alias("recall"), (1 - 2 * p * r / (p + r)).alias("error"))


def edit_distance(table: DataFrame, size_threshold: int = 1000) -> DataFrame:
    """One row (false_merges, false_splits): labels of the other side beyond the first, over cells above the size.

    A label all of whose cells are at most that size counts as -1, on its side."""
    big = table.where("s <> 0 and g <> 0").withColumn("b", (F.col("n") > size_threshold).cast("long"))
    merges = big.groupBy("s").agg((F.sum("b") - 1).alias("x")).agg(F.sum("x").alias("false_merges"))
    splits = big.groupBy("g").agg((F.sum("b") - 1).alias("x")).agg(F.sum("x").alias("false_splits"))
    return merges.crossJoin(splits)


def tables_by_threshold(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """(threshold, s, g, n): the contingency tables after labels s are merged as cuts (threshold, node, segment) say."""
    m = cuts.select("threshold", F.col("node").alias("s"), "segment")
    return table.join(m, "s").groupBy("threshold", F.col("segment").alias("s"), "g").agg(F.sum("n").alias("n"))


def vi_by_threshold(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """(threshold, under, over): split_vi() at every threshold, in one pass."""
    t = tables_by_threshold(table, cuts)
    log = lambda x: F.sum(F.col(x) * F.log2(x))
    c = t.groupBy("threshold").agg(log("n").alias("c"), F.sum("n").alias("t"))
    r = t.groupBy("threshold", "s").agg(F.sum("n").alias("x")).groupBy("threshold").agg(log("x").alias("r"))
    k = t.groupBy("threshold", "g").agg(F.sum("n").alias("x")).groupBy("threshold").agg(log("x").alias("k"))
    return c.join(r, "threshold").join(k, "threshold").select("threshold", ((F.col("r") - F.col("c")) / F.col("t")).alias("under"), ((F.col("k") - F.col("c")) / F.col("t")).alias("over"))


def rand_by_threshold(table: DataFrame, cuts: DataFrame) -> DataFrame:
    """(threshold, rand_index, adjusted_rand) at every threshold, in one pass."""
    t = tables_by_threshold(table, cuts)
    pairs = lambda x: F.sum(_pairs(F.col(x)))
    c = t.groupBy("threshold").agg(pairs("n").alias("cc"), F.sum("n").alias("t"))
    r = t.groupBy("threshold", "s").agg(F.sum("n").alias("x")).groupBy("threshold").agg(pairs("x").alias("rr"))
    k = t.groupBy("threshold", "g").agg(F.sum("n").alias("x")).groupBy("threshold").agg(pairs("x").alias("gg"))
    cc, rr, gg, nk = F.col("cc"), F.col("rr"), F.col("gg"), _pairs(F.col("t"))
    expected = rr * gg / nk
    adjusted = (cc - expected) / ((rr + gg) / 2 - expected)
    return c.join(r, "threshold").join(k, "threshold").select("threshold", ((nk + 2 * cc - rr - gg) / nk).alias("rand_index"), adjusted.alias("adjusted_rand"))


def vi_statistics(evaluations: DataFrame, by: str = "threshold") -> DataFrame:
    """Mean, standard error and median of under and over, by threshold, over the samples of a table of evaluations."""
    out = []
    for c in ("under", "over"):
        out += [F.avg(c).alias(f"mean_{c}"), (F.stddev_pop(c) / F.sqrt(F.count(c))).alias(f"sem_{c}"), F.percentile(c, 0.5).alias(f"median_{c}")]
    return evaluations.groupBy(by).agg(*out)


def pairwise_contingency(voxels: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, s, g, n) of every two label columns, i < j, in one pass and one shuffle."""
    pairs = [F.struct(F.lit(a).alias("i"), F.lit(b).alias("j"), F.col(a).cast("long").alias("s"), F.col(b).cast("long").alias("g")) for k, a in enumerate(columns) for b in columns[k + 1 :]]
    return voxels.select(F.explode(F.array(*pairs)).alias("p")).groupBy("p.i", "p.j", "p.s", "p.g").agg(F.count("*").alias("n"))


def pairwise_vi(voxels: DataFrame, columns: list[str]) -> DataFrame:
    """(i, j, merges, splits) for every two label columns."""
    t = pairwise_contingency(voxels, columns)
    log = lambda x: F.sum(F.col(x) * F.log2(x))
    c = t.groupBy("i", "j").agg(log("n").alias("c"), F.sum("n").alias("t"))
    r = t.groupBy("i", "j", "s").agg(F.sum("n").alias("x")).groupBy("i", "j").agg(log("x").alias("r"))
    k = t.groupBy("i", "j", "g").agg(F.sum("n").alias("x")).groupBy("i", "j").agg(log("x").alias("k"))
    return c.join(r, ["i", "j"]).join(k, ["i", "j"]).select("i", "j", ((F.col("r") - F.col("c")) / F.col("t")).alias("merges"), ((F.col("k") - F.col("c")) / F.col("t")).alias("splits"))


def precision_recall(scores: DataFrame, score: str, truth: str) -> DataFrame:
    """(threshold, precision, recall) at each distinct score: positions at or above it are predicted."""
    s = scores.groupBy(F.col(score).alias("threshold")).agg(F.sum(truth).alias("p"), F.count("*").alias("n"))
    s = ranked(s, [F.desc("threshold")], "rank", above_p="p", above_n="n")
    total = s.agg(F.sum("p").alias("all_p"))
    return s.crossJoin(F.broadcast(total)).select("threshold", (F.col("above_p") / F.col("above_n")).alias("precision"), (F.col("above_p") / F.col("all_p")).alias("recall"))


def wiggle_room(voxels: DataFrame, score: str, truth: str, margin: int = 2, axes: tuple[str, ...] = ("y", "x"), connectivity: int = 1) -> DataFrame:
    """(threshold, precision, recall) at each distinct score, with hits up to ``margin`` steps away allowed.

    Precision is the share of voxels at or above the threshold within reach of a true one (truth 1, else 0); recall that
    of true voxels within reach of one at or above it. Both sides grow by the largest value in reach before the sweep,
    so no pairs of voxels are made. Recall is null without a true voxel."""
    from .grid import own, ranked, seen_by

    grown = voxels.select("z", "y", "x", F.col(score).alias("_score"), F.col(truth).alias("_truth"), F.col(score).alias("_s"), F.col(truth).alias("_t"))
    for _ in range(margin):
        near = seen_by(grown, ["_score", "_truth", "_s", "_t"], axes, connectivity).groupBy("z", "y", "x")
        grown = near.agg(own("_score"), own("_truth"), F.max("_s").alias("_s"), F.max("_t").alias("_t"), F.max("here").alias("_is")).where("_is").drop("_is")
    zero = F.lit(0).cast("long")
    votes = F.array(
        F.struct(F.col("_score").alias("threshold"), F.lit(1).cast("long").alias("n"), F.col("_t").cast("long").alias("hit"), zero.alias("found")),
        F.struct(F.col("_s").alias("threshold"), zero.alias("n"), zero.alias("hit"), F.col("_truth").cast("long").alias("found")),
    )
    sums = grown.select(F.explode(votes).alias("w")).groupBy("w.threshold").agg(*[F.sum(f"w.{c}").alias(c) for c in ("n", "hit", "found")])
    swept = ranked(sums, [F.desc("threshold")], "_rank", above="n", hits="hit", upto="found")
    whole = voxels.agg(F.sum(F.col(truth)).cast("double").alias("_all"))  # one row
    share = lambda p, q: F.when(q != 0, p.cast("double") / q.cast("double"))
    return swept.crossJoin(F.broadcast(whole)).select("threshold", share(F.col("hits"), F.col("above")).alias("precision"), share(F.col("upto"), F.col("_all")).alias("recall"))


def pixel_precision_recall(voxels: DataFrame, pred: str, truth: str) -> DataFrame:
    tp = F.sum(F.col(pred) * F.col(truth))
    return voxels.agg((tp / F.sum(pred)).alias("precision"), (tp / F.sum(truth)).alias("recall"))


def stratified_sample(values: DataFrame, column: str, n: int) -> DataFrame:
    """Sorted distinct values: all if fewer than 2 n, else every (count div n)-th, from the first on."""
    distinct = values.select(F.col(column).alias("value")).distinct()
    places = ranked(distinct, ["value"], "rank").select("value", (F.col("rank") - 1).alias("r"))
    step = F.when(F.col("c") < 2 * n, 1).otherwise(F.expr(f"c div {n}"))
    return places.crossJoin(F.broadcast(distinct.agg(F.count("*").alias("c")))).where(F.col("r") % step == 0).select("value")


def relabel_sequential(labels: DataFrame, column: str = "label") -> DataFrame:
    """(old, new): the distinct labels but 0 numbered from 1 in order; 0 stays."""
    some = labels.select(F.col(column).alias("old")).distinct()
    numbered = ranked(some.where("old <> 0"), ["old"], "new")
    return numbered.union(some.where("old = 0").select("old", F.lit(0).cast("long")))


def merged(table: DataFrame, mapping: DataFrame) -> DataFrame:
    """The contingency table after labels s are merged by a map (old, new); labels it lacks stay."""
    m = mapping.select(F.col("old").alias("s"), "new")
    return table.join(m, "s", "left").groupBy(F.coalesce("new", "s").alias("s"), "g").agg(F.sum("n").alias("n"))
