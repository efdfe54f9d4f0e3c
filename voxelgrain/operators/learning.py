"""Training tables for merge classifiers, and the classifiers."""

from __future__ import annotations

import numpy as np
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from . import ahead, priorities, rag
from .agglomeration import _mutual, _renamed, _tops
from .contingency import assignment
from .grid import written

MERGE, SEPARATE = -1, 1


def edge_features(edge_table: DataFrame, nodes: DataFrame) -> DataFrame:
    """(u, v, features): size and mean of the smaller node, of the larger, of the edge, and their differences.

    nodes has (node, size, total); of equal sizes the node with the lower id comes first."""
    side = lambda k: nodes.select(F.col("node").alias(k), F.col("size").alias(f"s{k}"), (F.col("total") / F.col("size")).alias(f"m{k}"))
    e = edge_table.join(side("u"), "u").join(side("v"), "v")
    first = F.col("su") <= F.col("sv")
    pick = lambda a, b: F.when(first, F.col(a)).otherwise(F.col(b)).cast("double")
    lo, hi, ml, mh = pick("su", "sv"), pick("sv", "su"), pick("mu", "mv"), pick("mv", "mu")
    return e.select("u", "v", F.array(lo, ml, hi, mh, F.col("n").cast("double"), F.col("total") / F.col("n"), hi - lo, F.abs(ml - mh)).alias("features"))


def flat_training(edge_table: DataFrame, nodes: DataFrame, table: DataFrame) -> DataFrame:
    """(u, v, features, by_assignment, by_vi, by_rand, w_vi, w_rand) of every edge; -1 to merge, 1 to keep apart.

    By assignment two nodes merge if they overlap most with one label; by VI and Rand if merging doesn't make them
    worse. The weights are the local changes."""
    a = assignment(table)
    side = lambda k: a.select(F.col("s").alias(k), F.col("g").alias(f"g{k}"))
    total = table.agg(F.sum("n").alias("_t"))
    d = priorities.true_delta_vi(edge_table, table).join(priorities.true_delta_rand(edge_table, table), ["u", "v"])
    sign = lambda c: F.when(F.coalesce(F.col(c), F.lit(0.0)) < 0, MERGE).otherwise(SEPARATE)
    e = edge_features(edge_table, nodes).join(side("u"), "u").join(side("v"), "v").join(d, ["u", "v"]).crossJoin(F.broadcast(total))
    s1, s2 = F.element_at("features", 1), F.element_at("features", 3)
    rand = F.when(F.col("delta_rand") > 0, MERGE).otherwise(SEPARATE)
    return e.select("u", "v", "features", F.when(F.col("gu") == F.col("gv"), MERGE).otherwise(SEPARATE).alias("by_assignment"), sign("delta_vi").alias("by_vi"), rand.alias("by_rand"), priorities.local_vi_change(s1, s2, F.col("_t")).alias("w_vi"), priorities.local_rand_change(s1, s2, F.col("_t")).alias("w_rand"))


def unique_rows(training: DataFrame, order: list[str]) -> DataFrame:
    """The first row, in order, of those with equal features."""
    r = F.row_number().over(W.Window.partitionBy("features").orderBy(*order))
    return training.withColumn("_r", r).where("_r = 1").drop("_r")


def sample_rows(training: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k rows, those with the least hash of seed and edge."""
    return training.orderBy(F.xxhash64(F.lit(seed), "u", "v"), "u", "v").limit(k)


def classifier(name: str = "random forest", seed: int = 0):
    """An estimator by name: random forest, naive Bayes or logistic regression."""
    from pyspark.ml import classification as C

    name = name.lower()
    if "random" in name and "forest" in name:
        return C.RandomForestClassifier(numTrees=100, impurity="entropy", maxDepth=20, bootstrap=False, seed=seed)
    if "naive" in name:
        return C.NaiveBayes(modelType="gaussian")
    if name.startswith("logis"):
        return C.LogisticRegression()
    raise NotImplementedError(name)


def fit(training: DataFrame, label: str = "by_assignment", name: str = "random forest", seed: int = 0):
    rows = training.select(array_to_vector("features").alias("features"), (F.col(label) == SEPARATE).cast("double").alias("label"))
    return classifier(name, seed).fit(rows)


def separate_probability(features: DataFrame, model) -> DataFrame:
    """(u, v, weight): the model's probability that the two ends must stay apart."""
    rows = features.select("u", "v", array_to_vector("features").alias("features"))
    return model.transform(rows).select("u", "v", vector_to_array("probability")[1].alias("weight"))


def model_weight(model):
    """A priority for agglomeration.merge_by_priority(): the model's probability that the ends must stay apart, from the sums of the merged state."""

    def weigh(edges: DataFrame) -> DataFrame:
        rows = edges.withColumn("features", array_to_vector(_features(edges)))
        return model.transform(rows).withColumn("w", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")

    if hasattr(model, "coefficientMatrix") and model.coefficientMatrix.numRows == 1:
        slopes, level = model.coefficients.toArray().tolist(), model.intercept

        def arrays(e: dict) -> np.ndarray:
            margin = sum(c * f for c, f in zip(slopes, _feature_arrays(e).T, strict=True)) + level
            return 1 - 1 / (1 + np.exp(margin))

        weigh.arrays = arrays
    return weigh


def _features(edges: DataFrame) -> Column:
    """The features of edge_features() from n, total and the sizes and totals of both ends."""
    first = F.col("u_size") <= F.col("v_size")
    mean = lambda k: F.col(f"{k}_total") / F.col(f"{k}_size")
    pick = lambda a, b: F.when(first, a).otherwise(b).cast("double")
    lo, hi = pick(F.col("u_size"), F.col("v_size")), pick(F.col("v_size"), F.col("u_size"))
    ml, mh = pick(mean("u"), mean("v")), pick(mean("v"), mean("u"))
    return F.array(lo, ml, hi, mh, F.col("n").cast("double"), F.col("total") / F.col("n"), hi - lo, F.abs(ml - mh))


def _feature_arrays(e: dict) -> np.ndarray:
    """_features() of arrays of the same names, a row for each edge."""
    first = e["u_size"] <= e["v_size"]
    pick = lambda a, b: np.where(first, a, b).astype(float)
    mu, mv = e["u_total"] / e["u_size"], e["v_total"] / e["v_size"]
    lo, hi, ml, mh = pick(e["u_size"], e["v_size"]), pick(e["v_size"], e["u_size"]), pick(mu, mv), pick(mv, mu)
    return np.stack([lo, ml, hi, mh, e["n"].astype(float), e["total"] / e["n"], hi - lo, np.abs(ml - mh)], axis=1)


def epoch(edge_table: DataFrame, nodes: DataFrame, table: DataFrame, priority) -> DataFrame:
    """(round, u, v, features, label) of the edges that one agglomeration meets, judged by ground truth.

    nodes has (node, size, total), table (s, g, n) the fragments' overlaps with the truth. In each round the edges that
    are the best of both ends, least (w, tu, tv), are judged: current segments whose overlaps are largest with the same
    label merge (-1), others stay apart from then on (1). Overlaps, sizes and sums are those of the segments as merged
    so far. The epoch ends when every edge between two segments has been judged. Many rounds are made at once where the
    priority is also a function of arrays, see ahead.py."""
    live = written(edge_table.select("u", "v", F.col("u").alias("tu"), F.col("v").alias("tv"), "n", F.col("total").cast("double").alias("total"), F.lit(0).alias("apart")), "edges")
    held, cells = written(nodes, "nodes"), written(table, "cells")
    rows, done = None, 0

    def after(judged: DataFrame, to: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        name = lambda df, c: df.join(to.select(F.col("old").alias(c), "new"), c, "left").withColumn(c, F.coalesce("new", c)).drop("new")
        barred = name(name(judged.where(F.col("label") == SEPARATE).select("u", "v"), "u"), "v")
        barred = barred.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"), F.lit(1).alias("_apart")).distinct()
        # An edge that takes up a barred one is barred too.
        left = _renamed(live, to).join(barred, ["u", "v"], "left").withColumn("apart", F.greatest(F.least("apart", F.lit(1)), F.coalesce("_apart", F.lit(0)))).drop("_apart")
        nodes = written(name(held, "node").groupBy("node").agg(F.sum("size").alias("size"), F.sum("total").alias("total")), "nodes")
        return written(left, "edges"), nodes, written(name(cells, "s").groupBy("s", "g").agg(F.sum("n").alias("n")), "cells")

    at_once = hasattr(priority, "arrays") and all(dict(cells.dtypes)[c] in ("int", "bigint") for c in "sgn")
    while at_once:
        judged, many = ahead.advanced(live, held, priority.arrays, float("inf"), cells, _feature_arrays)
        told = judged.select((F.col("round") + done).alias("round"), "u", "v", "features", "label")
        rows = told if rows is None else rows.unionByName(told)
        if many == ahead.FOREVER:
            return rows
        live, held, cells = after(judged, ahead.joined(judged))
        done += many
        at_once = many >= 8
    while True:
        side = lambda k: held.select(F.col("node").alias(k), F.col("size").alias(f"{k}_size"), F.col("total").alias(f"{k}_total"))  # noqa: E731, B023
        scored = priority(live.where("apart = 0").join(side("u"), "u").join(side("v"), "v"))
        scored = written(scored.withColumn("features", _features(scored)), "scored")
        met = _mutual(_tops(scored), float("inf")).select(F.col("left").alias("u"), F.col("right").alias("v"))
        best = assignment(cells)
        owner = lambda k: best.select(F.col("s").alias(k), F.col("g").alias(f"g{k}"))  # noqa: E731, B023
        judged = met.join(scored.select("u", "v", "features"), ["u", "v"]).join(owner("u"), "u").join(owner("v"), "v")
        judged = written(judged.select(F.lit(done).alias("round"), "u", "v", "features", F.when(F.col("gu") == F.col("gv"), MERGE).otherwise(SEPARATE).alias("label")), "judged")
        rows = judged if rows is None else rows.unionByName(judged)
        if not judged.limit(1).count():
            return rows
        live, held, cells = after(judged, judged.where(F.col("label") == MERGE).select(F.col("v").alias("old"), F.col("u").alias("new")))
        done += 1


def learn_agglomerate(edge_table: DataFrame, nodes: DataFrame, table: DataFrame, epochs: int = 5, enough: int | None = None, name: str = "random forest", seed: int = 0):
    """(model, rows): a merge classifier learned in epochs, and the rows (epoch, round, u, v, features, label) it was fitted on.

    Epoch 0 agglomerates by the mean, each later one by the model of all rows so far, so that rows come from states
    that the model itself leads to. It ends after ``epochs`` of them, or once there are ``enough`` distinct rows."""
    edge_table, nodes, table = written(edge_table, "edges"), written(nodes, "nodes"), written(table, "table")
    rows, model = None, None
    for k in range(epochs):
        new = epoch(edge_table, nodes, table, priorities.mean_weight if model is None else model_weight(model)).withColumn("epoch", F.lit(k))
        rows = new if rows is None else rows.unionByName(new)
        distinct = written(unique_rows(rows.where("label is not null"), ["epoch", "round", "u", "v"]), "rows")
        model = fit(distinct, "label", name, seed)
        if enough is not None and distinct.count() >= enough:
            break
    return model, rows


def node_table(voxels: DataFrame, label: str = "label", value: str = "cents") -> DataFrame:
    return rag.nodes(voxels, label).join(voxels.groupBy(F.col(label).alias("node")).agg(F.sum(value).alias("total")), "node")
