"""Queries of the segmentation operators on the driver's tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .operators import agglomeration, contingency, features, grid, kernels, landscape, learning, orientation, priorities, rag, search, trees
from .plans import segmentation
from .sources import volumes
from .sources.volumes import events_cube, events_line, events_volume

#: The image of sources.volumes.events_volume() in SQL.
VOX = """vox AS (SELECT event_id AS idx, event_id // 100 AS y, event_id % 100 AS x,
  (event_id // 100 // 5) * 20 + (event_id % 100) // 5 + 1 AS label, (event_id // 100 // 7) * 15 + (event_id % 100) // 7 + 1 AS gt,
  CAST(round(value * 100) AS BIGINT) AS cents FROM events)"""
CT = VOX + ", t AS (SELECT label AS s, gt AS g, count(*) AS n FROM vox GROUP BY 1, 2)"
#: Each voxel with each voxel of its neighbourhood, itself included.
FOOT = VOX + """, d(k) AS (VALUES (0), (1), (-1), (100), (-100)),
near AS (SELECT a.idx, a.y, a.x, a.label, a.gt, a.cents, b.label AS o, b.cents AS oc FROM (SELECT vox.*, k, idx + k AS j FROM vox, d) a JOIN vox b
  ON b.idx = a.j WHERE abs(a.k) <> 1 OR b.y = a.y),
foot AS (SELECT idx, y, x, label, gt, cents, min(o) AS lo, max(o) AS hi, count(*) AS cells FROM near GROUP BY ALL)"""
MINMAX = FOOT + """, bv AS (SELECT lo AS u, label AS v, idx, y, x, cents FROM foot WHERE lo <> label UNION ALL SELECT label, hi, idx, y, x, cents FROM foot WHERE hi <> label)"""
EXACT = FOOT + """, bv AS (SELECT DISTINCT least(label, o) AS u, greatest(label, o) AS v, idx, y, x, cents FROM near WHERE label <> o)"""
EDGES = EXACT + ", e AS (SELECT u, v, count(*) AS n, sum(cents) AS total FROM bv GROUP BY 1, 2)"
NODES = ", nd AS (SELECT label AS node, count(*) AS size, sum(cents) AS total FROM vox GROUP BY 1)"

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = f"WITH {sql}" if not sql.lstrip().upper().startswith(("WITH", "SELECT")) else sql
        return f

    return add


def _table(spark, sf_dir):
    return contingency.contingency(events_volume(spark, sf_dir))


def _exact(spark, sf_dir):
    return rag.boundary_voxels(events_volume(spark, sf_dir), "exact", keep=("idx", "cents"))


def _edges(spark, sf_dir):
    return rag.edges(_exact(spark, sf_dir))


def _nodes(spark, sf_dir):
    return rag.nodes(events_volume(spark, sf_dir))


def _round(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    """Logarithms differ in the last bits between engines; -0.0 becomes 0.0."""
    return df.withColumns({c: F.round(c, digits) + F.lit(0.0) for c in columns})


# Comparing labellings


@query(CT + " SELECT s, g, n FROM t")
def contingency_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir)


@query(VOX + " SELECT label AS s, gt AS g, count(*) AS n FROM vox WHERE label <> 1 AND gt NOT IN (2, 3) GROUP BY 1, 2")
def contingency_ignoring(spark, sf_dir):
    return contingency.contingency(events_volume(spark, sf_dir), ignore_s=(1,), ignore_g=(2, 3))


@query(CT + " SELECT s, g, n, CAST(n AS DOUBLE) / CAST(sum(n) OVER () AS DOUBLE) AS p FROM t")
def contingency_normalised(spark, sf_dir):
    return contingency.normalised(_table(spark, sf_dir))


@query("SELECT lang AS s, source AS g, count(*) AS n FROM documents GROUP BY 1, 2")
def contingency_lang_source(spark, sf_dir):
    return contingency.contingency(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "source")


@query("SELECT o_orderstatus AS s, o_orderpriority AS g, count(*) AS n FROM orders GROUP BY 1, 2")
def contingency_orders(spark, sf_dir):
    return contingency.contingency(spark.read.parquet(f"{sf_dir}/orders.parquet"), "o_orderstatus", "o_orderpriority")


@query(CT + " SELECT s, g FROM (SELECT s, g, row_number() OVER (PARTITION BY s ORDER BY n DESC, g) AS r FROM t) WHERE r = 1")
def assignment(spark, sf_dir):
    return contingency.assignment(_table(spark, sf_dir))


_SPLIT = """, tt AS (SELECT sum(n) AS t FROM t), c AS (SELECT sum(n * log2(n)) AS c FROM t),
r AS (SELECT sum(x * log2(x)) AS r FROM (SELECT sum(n) AS x FROM t GROUP BY s)), k AS (SELECT sum(x * log2(x)) AS k FROM (SELECT sum(n) AS x FROM t GROUP BY g))"""


@query(CT + _SPLIT + " SELECT round((r - c) / t, 6) + 0.0 AS under, round((k - c) / t, 6) + 0.0 AS over FROM tt, c, r, k")
def split_vi(spark, sf_dir):
    return _round(contingency.split_vi(_table(spark, sf_dir)), "under", "over")


@query(CT + _SPLIT + " SELECT round((r + k - 2 * c) / t, 6) + 0.0 AS vi FROM tt, c, r, k")
def vi(spark, sf_dir):
    return _round(contingency.vi(_table(spark, sf_dir)), "vi")


_ENTROPY = """, h AS (SELECT s AS label, CAST(sum(n) AS BIGINT) AS size, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS entropy FROM t GROUP BY s)"""


@query(CT + _ENTROPY + " SELECT label, size, round(entropy, 6) + 0.0 AS entropy, round(entropy * size / (SELECT sum(n) FROM t), 6) + 0.0 AS bits FROM h")
def vi_by_label(spark, sf_dir):
    return _round(contingency.conditional_entropies(_table(spark, sf_dir)), "entropy", "bits")


@query(CT + _ENTROPY + " SELECT label, size, round(entropy, 6) + 0.0 AS entropy, round(entropy * size / (SELECT sum(n) FROM t), 9) + 0.0 AS bits FROM h ORDER BY bits DESC, label LIMIT 25")
def worst_labels(spark, sf_dir):
    e = _round(contingency.conditional_entropies(_table(spark, sf_dir)), "entropy")
    return _round(e, "bits", digits=9).orderBy(F.desc("bits"), "label").limit(25)


@query(CT + """ SELECT g, n, CAST(n AS DOUBLE) / CAST(rs AS DOUBLE) AS of_s, CAST(n AS DOUBLE) / CAST(cg AS DOUBLE) AS of_g FROM
  (SELECT s, g, n, sum(n) OVER (PARTITION BY s) AS rs, sum(n) OVER (PARTITION BY g) AS cg FROM t) WHERE s = 22 ORDER BY n DESC, g LIMIT 4""")
def split_components(spark, sf_dir):
    return contingency.overlaps_of(_table(spark, sf_dir), 22, 4)


_RAND = """, q AS (SELECT sum(n * (n - 1)) // 2 AS cc, sum(n) AS t FROM t), rr AS (SELECT sum(x * (x - 1)) // 2 AS r FROM (SELECT sum(n) AS x FROM t GROUP BY s)),
gg AS (SELECT sum(x * (x - 1)) // 2 AS k FROM (SELECT sum(n) AS x FROM t GROUP BY g)),
rv AS (SELECT CAST(cc AS DOUBLE) AS a, CAST(r - cc AS DOUBLE) AS b, CAST(k - cc AS DOUBLE) AS c, CAST(t * (t - 1) // 2 - r - k + cc AS DOUBLE) AS d FROM q, rr, gg)"""


@query(CT + _RAND + " SELECT a, b, c, d FROM rv")
def rand_values(spark, sf_dir):
    return contingency.rand_values(_table(spark, sf_dir))


@query(CT + _RAND + """ SELECT round((a + d) / (a + b + c + d), 9) AS rand_index,
  round(((a + b + c + d) * (a + d) - ((a + b) * (a + c) + (c + d) * (b + d))) / ((a + b + c + d) * (a + b + c + d) - ((a + b) * (a + c) + (c + d) * (b + d))), 9) AS adjusted_rand,
  round(a / sqrt((a + b) * (a + c)), 9) AS fowlkes_mallows FROM rv""")
def rand_measures(spark, sf_dir):
    return _round(contingency.rand_measures(_table(spark, sf_dir)), "rand_index", "adjusted_rand", "fowlkes_mallows", digits=9)


@query(CT + """, q AS (SELECT sum(n * n) AS cc, sum(n) AS t FROM t), r AS (SELECT sum(x * x) AS rr FROM (SELECT sum(n) AS x FROM t GROUP BY s)),
k AS (SELECT sum(x * x) AS gg FROM (SELECT sum(n) AS x FROM t GROUP BY g)),
pr AS (SELECT CAST(cc - t AS DOUBLE) / CAST(gg - t AS DOUBLE) AS p, CAST(cc - t AS DOUBLE) / CAST(rr - t AS DOUBLE) AS r FROM q, r, k)
SELECT p AS precision, r AS recall, round(1 - 2 * p * r / (p + r), 9) AS error FROM pr""")
def adapted_rand_error(spark, sf_dir):
    return _round(contingency.adapted_rand_error(_table(spark, sf_dir)), "error", digits=9)


@query(CT + """, b AS (SELECT s, g, CAST(n > 9 AS BIGINT) AS b FROM t WHERE s <> 0 AND g <> 0)
SELECT (SELECT CAST(sum(x) AS BIGINT) FROM (SELECT sum(b) - 1 AS x FROM b GROUP BY s)) AS false_merges, (SELECT CAST(sum(x) AS BIGINT) FROM (SELECT sum(b) - 1 AS x FROM b GROUP BY g)) AS false_splits""")
def edit_distance(spark, sf_dir):
    return contingency.edit_distance(_table(spark, sf_dir), 9)


def _three(spark, sf_dir):
    return events_volume(spark, sf_dir).withColumn("cells", F.expr("y div 10 * 10 + x div 10"))


@query(VOX + """, w AS (SELECT label, gt, y // 10 * 10 + x // 10 AS cells FROM vox),
t AS (SELECT 'label' AS i, 'gt' AS j, label AS s, gt AS g, count(*) AS n FROM w GROUP BY 3, 4 UNION ALL SELECT 'label', 'cells', label, cells, count(*) FROM w GROUP BY 3, 4 UNION ALL SELECT 'gt', 'cells', gt, cells, count(*) FROM w GROUP BY 3, 4),
c AS (SELECT i, j, sum(n * log2(n)) AS c, sum(n) AS t FROM t GROUP BY 1, 2),
r AS (SELECT i, j, sum(x * log2(x)) AS r FROM (SELECT i, j, s, sum(n) AS x FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2), k AS (SELECT i, j, sum(x * log2(x)) AS k FROM (SELECT i, j, g, sum(n) AS x FROM t GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT i, j, round((r - c) / t, 6) + 0.0 AS merges, round((k - c) / t, 6) + 0.0 AS splits FROM c JOIN r USING (i, j) JOIN k USING (i, j)""")
def pairwise_vi(spark, sf_dir):
    return _round(contingency.pairwise_vi(_three(spark, sf_dir), ["label", "gt", "cells"]), "merges", "splits")


_BITS = """, w AS (SELECT CAST(cents >= 2500 AS BIGINT) AS pred, CAST((y % 7 = 0 OR x % 7 = 0) AS BIGINT) AS truth, cents FROM vox)"""


def _predicted(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    return v.withColumn("pred", (F.col("cents") >= 2500).cast("long")).withColumn("truth", F.expr("CAST(y % 7 = 0 OR x % 7 = 0 AS BIGINT)"))


@query(VOX + _BITS + " SELECT CAST(sum(pred * truth) AS DOUBLE) / CAST(sum(pred) AS DOUBLE) AS precision, CAST(sum(pred * truth) AS DOUBLE) / CAST(sum(truth) AS DOUBLE) AS recall FROM w")
def pixel_precision_recall(spark, sf_dir):
    return contingency.pixel_precision_recall(_predicted(spark, sf_dir), "pred", "truth")


@query(VOX + _BITS + """, g AS (SELECT cents // 1000 AS threshold, sum(truth) AS p, count(*) AS n FROM w GROUP BY 1)
SELECT threshold, CAST(sum(p) OVER (ORDER BY threshold DESC) AS DOUBLE) / CAST(sum(n) OVER (ORDER BY threshold DESC) AS DOUBLE) AS precision, CAST(sum(p) OVER (ORDER BY threshold DESC) AS DOUBLE) / CAST(sum(p) OVER () AS DOUBLE) AS recall FROM g""")
def precision_recall_curve(spark, sf_dir):
    return contingency.precision_recall(_predicted(spark, sf_dir).withColumn("score", F.expr("cents div 1000")), "score", "truth")


@query(VOX + """, d AS (SELECT DISTINCT cents AS value FROM vox), r AS (SELECT value, row_number() OVER (ORDER BY value) - 1 AS r, count(*) OVER () AS c FROM d)
SELECT value FROM r WHERE r % (CASE WHEN c < 20 THEN 1 ELSE c // 10 END) = 0""")
def stratified_sample(spark, sf_dir):
    return contingency.stratified_sample(events_volume(spark, sf_dir), "cents", 10)


@query(VOX + " SELECT old, CASE WHEN old = 0 THEN 0 ELSE row_number() OVER (PARTITION BY old = 0 ORDER BY old) END AS new FROM (SELECT DISTINCT gt * 3 - 3 AS old FROM vox)")
def relabel_sequential(spark, sf_dir):
    return contingency.relabel_sequential(events_volume(spark, sf_dir).withColumn("label", F.col("gt") * 3 - 3))


@query(CT + " SELECT s // 3 AS s, g, CAST(sum(n) AS BIGINT) AS n FROM t GROUP BY 1, 2")
def contingency_after_merges(spark, sf_dir):
    t = _table(spark, sf_dir)
    return contingency.merged(t, t.select(F.col("s").alias("old"), F.expr("s div 3").alias("new")).distinct())


# The graph


@query(MINMAX + " SELECT u, v, count(*) AS n FROM bv GROUP BY 1, 2")
def rag_minmax(spark, sf_dir):
    return rag.boundary_voxels(events_volume(spark, sf_dir), "minmax", keep=("idx",)).groupBy("u", "v").agg(F.count("*").alias("n"))


@query(FOOT + """, bb AS (SELECT max(label) + 1 AS b FROM vox), f AS (SELECT idx, label, lo, CASE WHEN cells < 5 THEN b ELSE hi END AS hi FROM foot, bb)
SELECT u, v, count(*) AS n FROM (SELECT lo AS u, label AS v FROM f WHERE lo <> label UNION ALL SELECT label, hi FROM f WHERE hi <> label) GROUP BY 1, 2""")
def rag_padded(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    return rag.boundary_voxels(v, "minmax", keep=("idx",), boundary=True).groupBy("u", "v").agg(F.count("*").alias("n"))


@query(EDGES + " SELECT u, v, n, CAST(total AS BIGINT) AS total, CAST(total AS DOUBLE) / CAST(n AS DOUBLE) AS weight FROM e")
def rag_exact(spark, sf_dir):
    return _edges(spark, sf_dir).withColumn("weight", priorities.boundary_mean())


@query(VOX + """, d(dy, dx) AS (VALUES (0, 1), (1, 0), (1, 1), (1, -1)), p AS (SELECT a.label AS u, b.label AS v, a.idx AS i, b.idx AS j FROM (SELECT vox.*, dy, dx, y + dy AS yy, x + dx AS xx FROM vox, d) a JOIN vox b ON b.y = a.yy AND b.x = a.xx WHERE a.label <> b.label)
SELECT u, v, count(*) AS n FROM (SELECT DISTINCT least(u, v) AS u, greatest(u, v) AS v, i FROM p UNION SELECT DISTINCT least(u, v), greatest(u, v), j FROM p) GROUP BY 1, 2""")
def rag_diagonal(spark, sf_dir):
    return rag.boundary_voxels(events_volume(spark, sf_dir), "exact", keep=("idx",), connectivity=2).groupBy("u", "v").agg(F.count("*").alias("n"))


@query("""w AS (SELECT event_id AS idx, CAST(user_id AS BIGINT) AS label, lag(CAST(user_id AS BIGINT)) OVER (ORDER BY event_id) AS p FROM events), s AS (SELECT idx, label, p, lead(label) OVER (ORDER BY idx) AS q FROM w),
f AS (SELECT idx, label, least(label, coalesce(p, label), coalesce(q, label)) AS lo, greatest(label, coalesce(p, label), coalesce(q, label)) AS hi FROM s)
SELECT u, v, count(*) AS n FROM (SELECT lo AS u, label AS v FROM f WHERE lo <> label UNION ALL SELECT label, hi FROM f WHERE hi <> label) GROUP BY 1, 2""")
def rag_line(spark, sf_dir):
    return rag.boundary_voxels(events_line(spark, sf_dir), "minmax", keep=("idx",), axes=("x",)).groupBy("u", "v").agg(F.count("*").alias("n"))


@query("""c AS (SELECT event_id AS idx, event_id // 400 AS z, event_id % 400 // 20 AS y, event_id % 20 AS x, (event_id // 400 // 4) * 25 + (event_id % 400 // 20 // 4) * 5 + event_id % 20 // 4 + 1 AS label FROM events),
d(dz, dy, dx) AS (VALUES (0, 0, 1), (0, 1, 0), (1, 0, 0)), p AS (SELECT a.label AS u, b.label AS v, a.idx AS i, b.idx AS j FROM (SELECT c.*, z + dz AS zz, y + dy AS yy, x + dx AS xx FROM c, d) a JOIN c b ON b.z = a.zz AND b.y = a.yy AND b.x = a.xx WHERE a.label <> b.label)
SELECT u, v, count(*) AS n FROM (SELECT least(u, v) AS u, greatest(u, v) AS v, i FROM p UNION SELECT least(u, v), greatest(u, v), j FROM p) GROUP BY 1, 2""")
def rag_cube(spark, sf_dir):
    return rag.boundary_voxels(events_cube(spark, sf_dir), "exact", keep=("idx",), axes=("z", "y", "x")).groupBy("u", "v").agg(F.count("*").alias("n"))


@query(VOX + " SELECT label AS node, count(*) AS size, min(idx) AS first_idx FROM vox GROUP BY 1")
def node_sizes(spark, sf_dir):
    return _nodes(spark, sf_dir)


@query(VOX + " SELECT DISTINCT label AS node FROM vox, (SELECT min(y) AS a, max(y) AS b, min(x) AS c, max(x) AS d FROM vox) WHERE y IN (a, b) OR x IN (c, d)")
def face_labels(spark, sf_dir):
    return rag.face_labels(events_volume(spark, sf_dir))


@query(VOX + " SELECT DISTINCT label AS node FROM vox WHERE label NOT IN (SELECT label FROM vox, (SELECT min(y) AS a, max(y) AS b, min(x) AS c, max(x) AS d FROM vox) WHERE y IN (a, b) OR x IN (c, d))")
def orphans(spark, sf_dir):
    return rag.orphans(events_volume(spark, sf_dir))


@query(VOX + " SELECT label, CAST(count(*) AS DOUBLE) AS m0, CAST(sum(cents) AS DOUBLE) AS m1, CAST(sum(cents * cents) AS DOUBLE) AS m2 FROM vox GROUP BY 1")
def node_moments(spark, sf_dir):
    return rag.moment_sums(events_volume(spark, sf_dir), ["label"], F.col("cents").cast("double"), 2)


@query(EXACT + " SELECT u, v, CAST(count(*) AS DOUBLE) AS m0, CAST(sum(cents) AS DOUBLE) AS m1, CAST(sum(cents * cents) AS DOUBLE) AS m2 FROM bv GROUP BY 1, 2")
def edge_moments(spark, sf_dir):
    return rag.moment_sums(_exact(spark, sf_dir), ["u", "v"], F.col("cents").cast("double"), 2)


@query(VOX + """, m AS (SELECT label, avg(cents / 50000.0::DOUBLE) AS mean FROM vox GROUP BY 1)
SELECT label, round(any_value(mean), 6) AS mean, round(avg((cents / 50000.0 - mean) ** 2), 6) AS c2, round(avg((cents / 50000.0 - mean) ** 3), 6) + 0.0 AS c3, round(avg((cents / 50000.0 - mean) ** 4), 6) + 0.0 AS c4 FROM vox JOIN m USING (label) GROUP BY 1""")
def central_moments(spark, sf_dir):
    sums = rag.moment_sums(events_volume(spark, sf_dir), ["label"], F.col("cents") / 50000.0, 4)
    return _round(rag.central_moments(sums, 4).select("label", "mean", "c2", "c3", "c4"), "mean", "c2", "c3", "c4")


@query(EXACT + """, b AS (SELECT u, v, least(cents * 5 // 50000, 4) AS b FROM bv WHERE cents BETWEEN 0 AND 50000)
SELECT u, v, count(*) FILTER (b = 0) AS h0, count(*) FILTER (b = 1) AS h1, count(*) FILTER (b = 2) AS h2, count(*) FILTER (b = 3) AS h3, count(*) FILTER (b = 4) AS h4 FROM b GROUP BY 1, 2""")
def edge_histograms(spark, sf_dir):
    h = rag.histogram(_exact(spark, sf_dir), ["u", "v"], "cents", 5, 0, 50000)
    return h.select("u", "v", *[F.col("h")[i].alias(f"h{i}") for i in range(5)])


#: The 0.1, 0.5 and 0.9 percentiles of 5 bins over 0 to 50000, from rows x(<keys>, cents).
_PERCENTILES = """, xb AS (SELECT {k}, least(cents * 5 // 50000, 4) AS b FROM x WHERE cents BETWEEN 0 AND 50000), xk AS (SELECT DISTINCT {k} FROM x),
xh AS (SELECT {k}, r.b, (SELECT count(*) FROM xb WHERE {same} AND xb.b = r.b) AS c FROM xk, (SELECT range AS b FROM range(5)) r),
xc AS (SELECT {k}, b, c, sum(c) OVER (PARTITION BY {k} ORDER BY b) AS upto, sum(c) OVER (PARTITION BY {k}) AS total FROM xh),
xp AS (SELECT {k}, p, min(b) AS b FROM xc, (VALUES (0.1::DOUBLE), (0.5::DOUBLE), (0.9::DOUBLE)) w(p) WHERE upto / total >= p GROUP BY ALL)
SELECT {k}, round(max(val) FILTER (p = 0.1::DOUBLE), 4) AS p10, round(max(val) FILTER (p = 0.5::DOUBLE), 4) AS p50, round(max(val) FILTER (p = 0.9::DOUBLE), 4) AS p90
FROM (SELECT {k}, p, b * 10000 + 10000.0::DOUBLE * (p - (upto - c) / total) / (upto / total - (upto - c) / total) AS val FROM xp JOIN xc USING ({k}, b)) GROUP BY {k}"""


def _percentile_columns(h, *keys):
    ps = features.percentiles(F.col("h"), (0.1, 0.5, 0.9), 0, 50000, 5)
    return h.select(*keys, ps.alias("ps")).select(*keys, *[F.round(F.element_at("ps", i + 1), 4).alias(n) for i, n in enumerate(("p10", "p50", "p90"))])


@query(VOX + ", x AS (SELECT label, cents FROM vox)" + _PERCENTILES.format(k="label", same="xb.label = xk.label"))
def node_percentiles(spark, sf_dir):
    return _percentile_columns(rag.histogram(events_volume(spark, sf_dir), ["label"], "cents", 5, 0, 50000), "label")


@query(EXACT + ", x AS (SELECT u, v, cents FROM bv)" + _PERCENTILES.format(k="u, v", same="xb.u = xk.u AND xb.v = xk.v"))
def edge_percentiles(spark, sf_dir):
    return _percentile_columns(rag.histogram(_exact(spark, sf_dir), ["u", "v"], "cents", 5, 0, 50000), "u", "v")


@query(EDGES + """, m AS (SELECT label, count(*) AS n, avg(cents / 50000.0) AS mean, var_pop(cents / 50000.0) AS c2 FROM vox GROUP BY 1),
b AS (SELECT label, least(cents * 5 // 50000, 4) AS b, count(*)::DOUBLE AS c FROM vox WHERE cents BETWEEN 0 AND 50000 GROUP BY 1, 2),
h AS (SELECT label, b, c / sum(c) OVER (PARTITION BY label) AS h FROM b),
j AS (SELECT e.u, e.v, r.b, coalesce(p.h, 0) AS p, coalesce(q.h, 0) AS q FROM e CROSS JOIN (SELECT range AS b FROM range(5)) r LEFT JOIN h p ON p.label = e.u AND p.b = r.b LEFT JOIN h q ON q.label = e.v AND q.b = r.b),
js AS (SELECT u, v, sum(CASE WHEN p > 0 THEN p * ln(2 * p / (p + q)) ELSE 0 END + CASE WHEN q > 0 THEN q * ln(2 * q / (p + q)) ELSE 0 END) / 2 AS js FROM j GROUP BY 1, 2)
SELECT u, v, CAST(abs(x.n - y.n) AS DOUBLE) AS d_size, round(abs(x.mean - y.mean), 6) AS d_mean, round(abs(x.c2 - y.c2), 6) AS d_c2, round(js.js, 6) AS js FROM js JOIN m x ON x.label = u JOIN m y ON y.label = v""")
def edge_differences(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("p", F.col("cents") / 50000.0)
    node = features.described(v, ["label"], "p", 5, 0, 1, (0.5,), 2)
    side = lambda k: node.select(F.col("label").alias(k), F.col("moments").alias(f"m{k}"), F.col("h").alias(f"h{k}"))
    e = _edges(spark, sf_dir).select("u", "v").join(side("u"), "u").join(side("v"), "v")
    d = e.select("u", "v", features.difference_features(F.col("mu"), F.col("mv"), F.col("hu"), F.col("hv")).alias("d"))
    return d.select("u", "v", F.col("d")[0].alias("d_size"), *[F.round(F.col("d")[i], 6).alias(n) for i, n in ((1, "d_mean"), (2, "d_c2"), (3, "js"))])


@query()
def edge_feature_list(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("p", F.col("cents") / 50000.0)
    return features.edge_features(v, rag.boundary_voxels(v, "exact", keep=("idx", "p")), "p", **features.PRESETS["paper_em"])


@query(EXACT + " SELECT u, v, median(cents) AS weight FROM bv GROUP BY 1, 2")
def edge_median(spark, sf_dir):
    return priorities.boundary_median(_exact(spark, sf_dir))


@query(EXACT + " SELECT u, v, round(avg(cents) - 6 * stddev_samp(cents) / sqrt(count(*)), 4) AS weight FROM bv GROUP BY 1, 2")
def edge_mean_plus_sem(spark, sf_dir):
    """The weight of an edge of one voxel is null."""
    return _round(priorities.mean_plus_sem(_exact(spark, sf_dir)), "weight", digits=4)


@query(EDGES + """, b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e), dg AS (SELECT u AS node, count(*) AS degree FROM b GROUP BY 1)
SELECT dg.node, dg.degree, CAST(sum(q.degree) AS BIGINT) AS neighbour_degree_sum FROM dg JOIN b ON b.u = dg.node JOIN dg q ON q.node = b.v GROUP BY 1, 2""")
def node_degrees(spark, sf_dir):
    return rag.degrees(_edges(spark, sf_dir))


@query(EDGES + """, b AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)
SELECT e.u, e.v, count(q.v) AS common FROM e LEFT JOIN b p ON p.u = e.u LEFT JOIN b q ON q.u = e.v AND q.v = p.v GROUP BY 1, 2""")
def common_neighbours(spark, sf_dir):
    return rag.common_neighbours(_edges(spark, sf_dir))


@query(EDGES + """, b AS (SELECT u, v, n FROM e UNION ALL SELECT v, u, n FROM e), r AS (SELECT u, n, row_number() OVER (PARTITION BY u ORDER BY n DESC, v) AS r FROM b)
SELECT u AS node, CAST(sum(n) AS BIGINT) AS total, max(n) FILTER (r = 1) AS longest, coalesce(max(n) FILTER (r = 2), 0) AS second FROM r GROUP BY 1""")
def inclusiveness(spark, sf_dir):
    return rag.inclusiveness(_edges(spark, sf_dir))


def _located(spark, sf_dir):
    return rag.boundary_voxels(events_volume(spark, sf_dir), "exact", keep=("idx",))


@query(EXACT + " SELECT u, v, count(DISTINCT idx) AS voxels, CAST(0 AS INT) AS lo_z, CAST(0 AS INT) AS hi_z, CAST(min(y) AS INT) AS lo_y, CAST(max(y) AS INT) AS hi_y, CAST(min(x) AS INT) AS lo_x, CAST(max(x) AS INT) AS hi_x FROM bv GROUP BY 1, 2")
def edge_boxes(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    b = _located(spark, sf_dir).join(v.select("idx", "z", "y", "x"), "idx")
    return rag.edge_boxes(b)


@query(EXACT + """, py AS (SELECT u, v, y, row_number() OVER (PARTITION BY u, v ORDER BY count(*) DESC, y) AS r FROM bv GROUP BY 1, 2, 3), px AS (SELECT u, v, x, row_number() OVER (PARTITION BY u, v ORDER BY count(*) DESC, x) AS r FROM bv GROUP BY 1, 2, 3)
SELECT u, v, CAST(0 AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM (SELECT * FROM py WHERE r = 1) JOIN (SELECT u, v, x FROM px WHERE r = 1) USING (u, v)""")
def edge_places(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    return rag.edge_places(_located(spark, sf_dir).join(v.select("idx", "z", "y", "x"), "idx"))


@query(EXACT + """, s AS (SELECT label, count(*) FILTER (cents > 5000) AS s0, count(*) FILTER (cents > 20000) AS s1 FROM vox GROUP BY 1), b AS (SELECT u, v, count(*) FILTER (cents > 5000) AS b0, count(*) FILTER (cents > 20000) AS b1 FROM bv GROUP BY 1, 2)
SELECT u, v, b0 + 1 AS b0, b1 + 1 AS b1, p.s0 + 1 AS p0, p.s1 + 1 AS p1, q.s0 + 1 AS q0, q.s1 + 1 AS q1 FROM b JOIN s p ON p.label = u JOIN s q ON q.label = v""")
def contact_features(spark, sf_dir):
    return rag.contact_features(_exact(spark, sf_dir), events_volume(spark, sf_dir), (5000, 20000))


@query(VOX + " SELECT label AS node, list_sort(list(DISTINCT idx % 11) FILTER (idx % 97 = 3 AND idx % 11 <> 0))::VARCHAR AS exclusions FROM vox GROUP BY 1 HAVING count(*) FILTER (idx % 97 = 3 AND idx % 11 <> 0) > 0")
def exclusion_sets(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("excl", F.expr("CASE WHEN idx % 97 = 3 THEN idx % 11 ELSE 0 END"))
    e = rag.exclusions(v).where(F.size("exclusions") > 0)
    return e.select("node", F.concat(F.lit("["), F.array_join(F.transform("exclusions", lambda x: x.cast("string")), ", "), F.lit("]")).alias("exclusions"))


# Priorities


@query(EDGES + NODES + """ SELECT u, v, CASE WHEN (p.size < 25) <> (q.size < 25) THEN CAST(e.total AS DOUBLE) / CAST(n AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS weight FROM e JOIN nd p ON p.node = u JOIN nd q ON q.node = v""")
def ladder_priority(spark, sf_dir):
    return priorities.ladder(_edges(spark, sf_dir), _nodes(spark, sf_dir), priorities.boundary_mean(), 25, 2)


@query(EDGES + " SELECT u, v, CASE WHEN u % 7 = 0 OR v % 7 = 0 THEN CAST('inf' AS DOUBLE) ELSE CAST(total AS DOUBLE) / CAST(n AS DOUBLE) END AS weight FROM e")
def frozen_priority(spark, sf_dir):
    frozen = _nodes(spark, sf_dir).where("node % 7 = 0").select("node")
    out = priorities.without_frozen(_edges(spark, sf_dir).withColumn("weight", priorities.boundary_mean()), frozen)
    return out.select("u", "v", "weight")


@query(EDGES + NODES + """, b AS (SELECT u AS node, sum(n) AS length FROM (SELECT u, n FROM e UNION ALL SELECT v, n FROM e) GROUP BY 1)
SELECT e.u, e.v, CASE WHEN u % 7 = 0 AND v % 7 <> 0 AND p.size <= q.size THEN 1 - CAST(n AS DOUBLE) / CAST(bu.length AS DOUBLE) WHEN v % 7 = 0 AND u % 7 <> 0 AND q.size <= p.size THEN 1 - CAST(n AS DOUBLE) / CAST(bw.length AS DOUBLE) ELSE CAST('inf' AS DOUBLE) END AS weight
FROM e JOIN nd p ON p.node = u JOIN nd q ON q.node = v JOIN b bu ON bu.node = u JOIN b bw ON bw.node = v""")
def mito_priority(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    return priorities.mito_merge(_edges(spark, sf_dir), n, n.where("node % 7 = 0").select("node"))


@query(EDGES + CT.split("FROM events)", 1)[1] + """, z AS (SELECT s, sum(n) AS x FROM t GROUP BY 1), tt AS (SELECT sum(n) AS t FROM t),
c AS (SELECT e.u, e.v, sum((a.n + b.n) * log2(a.n + b.n) - a.n * log2(a.n) - b.n * log2(b.n)) AS c FROM e JOIN t a ON a.s = u JOIN t b ON b.s = v AND b.g = a.g GROUP BY 1, 2)
SELECT e.u, e.v, round(((p.x + q.x) * log2(p.x + q.x) - p.x * log2(p.x) - q.x * log2(q.x) - 2 * coalesce(c, 0)) / t, 8) + 0.0 AS delta_vi FROM e JOIN z p ON p.s = u JOIN z q ON q.s = v LEFT JOIN c ON c.u = e.u AND c.v = e.v, tt""")
def delta_vi_true(spark, sf_dir):
    return _round(priorities.true_delta_vi(_edges(spark, sf_dir), _table(spark, sf_dir)), "delta_vi", digits=8)


@query(EDGES + CT.split("FROM events)", 1)[1] + """, z AS (SELECT s, sum(n) AS x FROM t GROUP BY 1), tt AS (SELECT sum(n) AS t FROM t),
c AS (SELECT e.u, e.v, sum(a.n * b.n) AS c FROM e JOIN t a ON a.s = u JOIN t b ON b.s = v AND b.g = a.g GROUP BY 1, 2)
SELECT e.u, e.v, CAST(2 * coalesce(c, 0) - p.x * q.x AS DOUBLE) / CAST(t * (t - 1) // 2 AS DOUBLE) AS delta_rand FROM e JOIN z p ON p.s = u JOIN z q ON q.s = v LEFT JOIN c ON c.u = e.u AND c.v = e.v, tt""")
def delta_rand_true(spark, sf_dir):
    return priorities.true_delta_rand(_edges(spark, sf_dir), _table(spark, sf_dir))


@query(EDGES + NODES + """, tt AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM vox), w AS (SELECT u, v, CAST(p.size AS DOUBLE) AS a, CAST(q.size AS DOUBLE) AS b, t FROM e JOIN nd p ON p.node = u JOIN nd q ON q.node = v, tt)
SELECT u, v, round(-(a / t * log2(a / t) + b / t * log2(b / t) - (a + b) / t * log2((a + b) / t)), 9) AS local_vi, round(a * b / (t * (t - 1) / 2), 12) AS local_rand FROM w""")
def local_changes(spark, sf_dir):
    n = _nodes(spark, sf_dir)
    side = lambda k: n.select(F.col("node").alias(k), F.col("size").cast("double").alias(f"s{k}"))
    e = _edges(spark, sf_dir).join(side("u"), "u").join(side("v"), "v").crossJoin(F.broadcast(n.agg(F.sum("size").cast("double").alias("t"))))
    e = e.select("u", "v", priorities.local_vi_change(F.col("su"), F.col("sv"), F.col("t")).alias("local_vi"), priorities.local_rand_change(F.col("su"), F.col("sv"), F.col("t")).alias("local_rand"))
    return _round(_round(e, "local_vi", digits=9), "local_rand", digits=12)


@query(EDGES + NODES + """, tt AS (SELECT CAST(count(*) AS DOUBLE) AS t FROM vox), w AS (SELECT u, v, least(1, CAST(e.total AS DOUBLE) / CAST(n AS DOUBLE) / 10000) AS p, CAST(p.size AS DOUBLE) AS a, CAST(q.size AS DOUBLE) AS b, t FROM e JOIN nd p ON p.node = u JOIN nd q ON q.node = v, tt),
c AS (SELECT u, v, p, -(a / t * log2(a / t) + b / t * log2(b / t) - (a + b) / t * log2((a + b) / t)) AS vi, a * b / (t * (t - 1) / 2) AS rand FROM w)
SELECT u, v, round(p * 2 * vi - (1 - p) * 0.5 * vi, 8) + 0.0 AS expected_vi, round((p - (1 - p)) * rand, 12) + 0.0 AS expected_rand FROM c""")
def expected_changes(spark, sf_dir):
    e = _edges(spark, sf_dir).select("u", "v", F.least(F.lit(1.0), priorities.boundary_mean() / 10000).alias("p"))
    n = _nodes(spark, sf_dir)
    vi_change = priorities.expected_change(e, n, "p", "vi", 2.0, 0.5).withColumnRenamed("weight", "expected_vi")
    out = priorities.expected_change(vi_change, n, "p", "rand").withColumnRenamed("weight", "expected_rand")
    return _round(_round(out.select("u", "v", "expected_vi", "expected_rand"), "expected_vi", digits=8), "expected_rand", digits=12)


@query(EDGES + """, k AS (SELECT u, v, row_number() OVER (ORDER BY n DESC, total, u, v) - 1 AS i, count(*) OVER () AS c FROM e WHERE (u + v) % 3 = 0)
SELECT e.u, e.v, coalesce(CAST(i AS DOUBLE) / CAST(c AS DOUBLE), CAST('inf' AS DOUBLE)) AS weight FROM e LEFT JOIN k ON k.u = e.u AND k.v = e.v""")
def ordered_priority(spark, sf_dir):
    e = grid.written(_edges(spark, sf_dir), "edges")
    return priorities.ordered(e, e.where("(u + v) % 3 = 0"), [F.desc("n"), "total", "u", "v"])


@query(EXACT + """, c AS (SELECT u, v, CASE idx % 3 WHEN 0 THEN cents WHEN 1 THEN cents // 2 ELSE cents % 1000 END AS o, greatest(cents, cents // 2, cents % 1000) AS s FROM bv)
SELECT u, v, CAST(sum(o) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS oriented_mean, CAST(sum(s) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS strongest_mean FROM c GROUP BY 1, 2""")
def oriented_boundary_mean(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumns({"half": F.expr("cents div 2"), "rest": F.expr("cents % 1000"), "other": F.lit(0), "angle": F.expr("idx % 3")})
    v = volumes.oriented(v, ["cents", "half", "other", "rest"], [True, True, False, True], "angle")
    b = rag.boundary_voxels(v, "exact", keep=("idx", "oriented", "strongest"))
    mean = lambda c: (F.sum(c).cast("double") / F.count("*")).alias(f"{c}_mean")
    return b.groupBy("u", "v").agg(mean("oriented"), mean("strongest"))


@query(VOX + " SELECT idx, CAST(cents - (SELECT min(cents) FROM vox) AS DOUBLE) / CAST((SELECT max(cents) - min(cents) FROM vox) AS DOUBLE) AS cents FROM vox")
def scaled_probabilities(spark, sf_dir):
    return volumes.scaled(events_volume(spark, sf_dir), "cents").select("idx", "cents")


@query(EDGES + " SELECT u, v FROM e")
def real_edges(spark, sf_dir):
    """The edges of a graph with the outside as a node, without those to the outside."""
    v = events_volume(spark, sf_dir)
    edges = _edges(spark, sf_dir).select("u", "v").union(rag.face_labels(v).select(F.lit(0).cast("long"), "node"))
    return rag.real_edges(edges, spark.range(1).select(F.col("id").alias("node")))


# Maps and morphology


@query(VOX + " SELECT idx, CASE WHEN label % 3 = 0 THEN label // 3 ELSE 0 END AS label FROM vox")
def apply_map(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    m = v.where("label % 3 = 0").select(F.col("label").alias("old"), F.expr("label div 3").alias("new")).distinct()
    return volumes.apply_map(v, m).select("idx", "label")


@query(VOX + " SELECT DISTINCT label AS sp, gt AS body FROM vox")
def sp_to_body_map(spark, sf_dir):
    return events_volume(spark, sf_dir).select(F.col("label").alias("sp"), F.col("gt").alias("body")).distinct()


@query(VOX + " SELECT idx, CASE label WHEN 7 THEN 1 WHEN 3 THEN 2 WHEN 22 THEN 3 ELSE 0 END AS segment FROM vox")
def extract_segments(spark, sf_dir):
    ids = F.array(*[F.lit(i).cast("long") for i in (7, 3, 22)])
    return events_volume(spark, sf_dir).select("idx", F.array_position(ids, F.col("label")).cast("int").alias("segment"))


@query(VOX + " SELECT idx, CASE WHEN count(*) OVER (PARTITION BY gt) < 40 THEN 0 ELSE gt END AS gt FROM vox")
def remove_small(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    size = v.groupBy("gt").agg(F.count("*").alias("c"))
    return v.join(size, "gt").select("idx", F.when(F.col("c") < 40, 0).otherwise(F.col("gt")).alias("gt"))


@query(VOX + " SELECT idx, CAST(sum(cents) OVER (PARTITION BY label) AS DOUBLE) / CAST(count(*) OVER (PARTITION BY label) AS DOUBLE) AS colour FROM vox")
def draw_segments(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    mean = v.groupBy("label").agg((F.sum("cents").cast("double") / F.count("*")).alias("colour"))
    return v.join(mean, "label").select("idx", "colour")


@query(FOOT + " SELECT idx, lo <> hi AS border FROM foot")
def seg_to_boundary(spark, sf_dir):
    return grid.borders(events_volume(spark, sf_dir))


@query(FOOT + " SELECT idx, max(oc) AS cents FROM near GROUP BY 1")
def dilate(spark, sf_dir):
    return grid.dilate(events_volume(spark, sf_dir).select("z", "y", "x", "idx", "cents"), "cents").select("idx", "cents")


@query(FOOT + " SELECT idx, min(oc) AS cents FROM near GROUP BY 1")
def erode(spark, sf_dir):
    return grid.erode(events_volume(spark, sf_dir).select("z", "y", "x", "idx", "cents"), "cents").select("idx", "cents")


@query(FOOT + """, w AS (SELECT idx, max(CASE WHEN o % 4 = 0 THEN 0 ELSE o END) AS hi, min(CASE WHEN o % 4 <> 0 THEN o END) AS lo, max(CASE WHEN label % 4 = 0 THEN 0 ELSE label END) AS label FROM near GROUP BY 1)
SELECT idx, CASE WHEN label = 0 AND lo = hi THEN hi ELSE label END AS label FROM w""")
def remove_merged_boundaries(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("label", F.expr("CASE WHEN label % 4 = 0 THEN 0L ELSE label END"))
    return grid.close_merged_gaps(v)


@query(VOX + """, w AS (SELECT idx, y, x, CASE WHEN y % 10 = 4 AND x % 10 = 4 THEN idx + 1000000 ELSE label // 400 * 400 END AS label FROM vox), d(k) AS (VALUES (1), (-1), (100), (-100)),
p AS (SELECT DISTINCT a.label AS a, b.label AS b FROM (SELECT w.*, k, idx + k AS j FROM w, d) a JOIN w b ON b.idx = a.j WHERE (abs(a.k) <> 1 OR b.y = a.y) AND a.label <> b.label), s AS (SELECT a, min(b) AS t FROM p GROUP BY 1 HAVING count(*) = 1)
SELECT idx, coalesce(t, label) AS label FROM w LEFT JOIN s ON a = label""")
def despeckle(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("label", F.expr("CASE WHEN y % 10 = 4 AND x % 10 = 4 THEN idx + 1000000 ELSE label div 400 * 400 END"))
    return grid.despeckle(v).select("idx", "label")


@query(VOX + " SELECT (SELECT count(*) FROM vox WHERE y BETWEEN 1 AND (SELECT max(y) - 1 FROM vox) AND x BETWEEN 1 AND 98) AS inside, (SELECT count(*) FROM vox WHERE y IN (0, (SELECT max(y) FROM vox)) OR x IN (0, 99)) AS crust")
def crust_counts(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    f = grid.faces(v).agg(F.count("*").alias("crust"))
    return v.agg(F.count("*").alias("n")).crossJoin(f).select((F.col("n") - F.col("crust")).alias("inside"), "crust")


@query(VOX + """, z AS (SELECT y AS z, gt FROM vox GROUP BY 1, 2), r AS (SELECT z, gt AS old, row_number() OVER (PARTITION BY z ORDER BY gt) AS k FROM z), m AS (SELECT z, max(k) AS top FROM r GROUP BY 1), o AS (SELECT z, coalesce(sum(top) OVER (ORDER BY z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM m)
SELECT r.z, old, CAST(k + o AS BIGINT) AS new FROM r JOIN o USING (z)""")
def serial_section_map(spark, sf_dir):
    planes = events_volume(spark, sf_dir).select(F.col("y").cast("long").alias("z"), F.col("gt").alias("old")).distinct()
    r = planes.withColumn("k", F.row_number().over(W.Window.partitionBy("z").orderBy("old")))
    o = grid.ranked(r.groupBy("z").agg(F.max("k").alias("top")), ["z"], "plane", upto="top").select("z", (F.col("upto") - F.col("top")).alias("o"))
    return r.join(o, "z").select("z", "old", (F.col("k") + F.col("o")).cast("long").alias("new"))


@query(VOX + " SELECT idx, cents FROM vox WHERE y >= 2 AND y < 8 AND x >= 10 AND x < 90")
def crop(spark, sf_dir):
    return volumes.crop(events_volume(spark, sf_dir), {"y": (2, 8), "x": (10, 90)}).select("idx", "cents")


@query(EDGES + """, h AS (SELECT least(100, CAST(total AS BIGINT) * 100 // (n * 50000)) AS bin, CAST(a.gt <> b.gt AS BIGINT) AS apart FROM e JOIN (SELECT label, min(gt) AS gt FROM vox GROUP BY 1) a ON a.label = u JOIN (SELECT label, min(gt) AS gt FROM vox GROUP BY 1) b ON b.label = v)
SELECT b.bin, count(h.bin) AS edges, CAST(coalesce(sum(apart), 0) AS BIGINT) AS apart FROM (SELECT range AS bin FROM range(101)) b LEFT JOIN h ON h.bin = b.bin GROUP BY 1""")
def priority_histogram(spark, sf_dir):
    g = events_volume(spark, sf_dir).groupBy("label").agg(F.min("gt").alias("gt"))
    side = lambda k: g.select(F.col("label").alias(k), F.col("gt").alias(f"g{k}"))
    h = _edges(spark, sf_dir).join(side("u"), "u").join(side("v"), "v").select(F.least(F.lit(100), F.expr("total * 100 div (n * 50000)")).alias("bin"), (F.col("gu") != F.col("gv")).cast("long").alias("apart"))
    h = h.groupBy("bin").agg(F.count("*").alias("edges"), F.sum("apart").alias("apart"))
    return spark.range(101).select(F.col("id").alias("bin")).join(h, "bin", "left").na.fill(0)


@query(VOX + " SELECT idx, 3 - CAST(sum(CAST(cents > 20000 AS BIGINT)) OVER (ORDER BY idx) AS BIGINT) AS \"left\" FROM vox")
def conditional_countdown(spark, sf_dir):
    rows = events_volume(spark, sf_dir).withColumn("hit", F.col("cents") > 20000)
    return agglomeration.countdown(rows, "idx", "hit", 3).select("idx", "left")


# Components and agglomeration


_PARTS = """, l AS (SELECT u, v FROM e WHERE {} UNION SELECT v, u FROM e WHERE {}), reach(a, b) AS (SELECT label, label FROM vox UNION SELECT r.a, l.v FROM reach r JOIN l ON l.u = r.b)
SELECT a AS node, min(b) AS segment FROM reach GROUP BY 1"""


@query("WITH RECURSIVE " + EDGES + _PARTS.format(*["CAST(total AS DOUBLE) / CAST(n AS DOUBLE) < 3000"] * 2))
def threshold_segments(spark, sf_dir):
    return agglomeration.threshold_segments(_edges(spark, sf_dir), _nodes(spark, sf_dir), 3000.0)


@query("WITH RECURSIVE " + EDGES + ", t AS (SELECT label AS s, gt AS g, count(*) AS n FROM vox GROUP BY 1, 2), asg AS (SELECT s, g FROM (SELECT s, g, row_number() OVER (PARTITION BY s ORDER BY n DESC, g) AS r FROM t) WHERE r = 1)" + _PARTS.format(*["(SELECT g FROM asg WHERE s = u) = (SELECT g FROM asg WHERE s = v)"] * 2))
def best_segments(spark, sf_dir):
    return agglomeration.best_segments(_edges(spark, sf_dir), _nodes(spark, sf_dir), contingency.assignment(_table(spark, sf_dir)))


@query(EDGES + " SELECT least(a, b) AS u, greatest(a, b) AS v, CAST(sum(n) AS BIGINT) AS n, CAST(sum(total) AS BIGINT) AS total FROM (SELECT u // 4 AS a, v // 4 AS b, n, total FROM e) WHERE a <> b GROUP BY 1, 2")
def contract_edges(spark, sf_dir):
    m = _nodes(spark, sf_dir).select("node", F.expr("node div 4").alias("segment"))
    return agglomeration.contract(_edges(spark, sf_dir), m)


@query()
def agglomerate(spark, sf_dir):
    return agglomeration.agglomerate(_edges(spark, sf_dir), 2800.0)


@query()
def agglomerated_segments(spark, sf_dir):
    return segmentation.segment(events_volume(spark, sf_dir), segmentation.Options((2000.0, 2800.0)))


_CUTS = "WITH RECURSIVE " + EDGES + """, cut(t) AS (VALUES (1500.0::DOUBLE), (2500.0::DOUBLE), (3000.0::DOUBLE)), l0 AS (SELECT u, v, t FROM e, cut WHERE CAST(total AS DOUBLE) / CAST(n AS DOUBLE) < t), l AS (SELECT u, v, t FROM l0 UNION SELECT v, u, t FROM l0),
reach(t, a, b) AS (SELECT t, label, label FROM vox, cut UNION SELECT r.t, r.a, l.v FROM reach r JOIN l ON l.u = r.b AND l.t = r.t), seg AS (SELECT t, a, min(b) AS s FROM reach GROUP BY 1, 2),
c AS (SELECT t, s, gt AS g, count(*) AS n FROM vox JOIN seg ON a = label GROUP BY 1, 2, 3), rs AS (SELECT t, s, sum(n) AS x FROM c GROUP BY 1, 2), cg AS (SELECT t, g, sum(n) AS x FROM c GROUP BY 1, 2)"""


def _cuts(spark, sf_dir):
    e = _edges(spark, sf_dir).withColumn("weight", priorities.boundary_mean())
    return agglomeration.threshold_cuts(e, _nodes(spark, sf_dir), [1500.0, 2500.0, 3000.0])


@query(_CUTS + """ SELECT t AS threshold, round(((SELECT sum(x * log2(x)) FROM rs WHERE rs.t = c.t) - sum(n * log2(n))) / sum(n), 6) AS under, round(((SELECT sum(x * log2(x)) FROM cg WHERE cg.t = c.t) - sum(n * log2(n))) / sum(n), 6) AS over FROM c GROUP BY t""")
def vi_by_threshold(spark, sf_dir):
    return _round(contingency.vi_by_threshold(_table(spark, sf_dir), _cuts(spark, sf_dir)), "under", "over")


@query(_CUTS + """, q AS (SELECT t, sum(n * (n - 1) / 2.0::DOUBLE) AS cc, sum(n) * (sum(n) - 1) / 2.0::DOUBLE AS nk, (SELECT sum(x * (x - 1) / 2.0::DOUBLE) FROM rs WHERE rs.t = c.t) AS rr, (SELECT sum(x * (x - 1) / 2.0::DOUBLE) FROM cg WHERE cg.t = c.t) AS gg FROM c GROUP BY t)
SELECT t AS threshold, round((nk + 2 * cc - rr - gg) / nk, 6) AS rand_index, round((cc - rr * gg / nk) / ((rr + gg) / 2 - rr * gg / nk), 6) AS adjusted_rand FROM q""")
def rand_by_threshold(spark, sf_dir):
    return _round(contingency.rand_by_threshold(_table(spark, sf_dir), _cuts(spark, sf_dir)), "rand_index", "adjusted_rand")


@query()
def agglomerated_by_rounds(spark, sf_dir):
    return agglomeration.rounds(_edges(spark, sf_dir), _nodes(spark, sf_dir), 2800.0)


@query()
def merge_history(spark, sf_dir):
    return agglomeration.history(_edges(spark, sf_dir), _nodes(spark, sf_dir), 3000.0)


@query()
def agglomerated_by_count(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return agglomeration.cut_history(agglomeration.first_merges(_edges(spark, sf_dir), nodes, 50), nodes, merges=50)


@query()
def vi_along_merges(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    log = agglomeration.history(_edges(spark, sf_dir), nodes, 3000.0)
    return _round(agglomeration.vi_history(log, nodes, _table(spark, sf_dir), [2000.0, 2500.0, 3000.0]), "under", "over")


@query()
def agglomerated_vi(spark, sf_dir):
    cut = segmentation.segment(events_volume(spark, sf_dir), segmentation.Options((2800.0,)))
    return _round(contingency.split_vi(contingency.merged(_table(spark, sf_dir), cut.select(F.col("node").alias("old"), F.col("segment").alias("new")))), "under", "over")


def _sums(spark, sf_dir):
    b = _exact(spark, sf_dir)
    return b.groupBy("u", "v").agg(F.count("*").alias("n"), F.sum("cents").alias("total"), F.sum(F.col("cents") * F.col("cents")).cast("double").alias("squares"))


@query()
def agglomerated_ladder(spark, sf_dir):
    """Segments by the mean as long as one of two has under 60 voxels."""
    weight = lambda e: priorities.ladder_weight(e, 60)
    return agglomeration.merge_by_priority(_edges(spark, sf_dir), _nodes(spark, sf_dir).select("node", "size"), weight, 4000.0)[2]


@query()
def agglomerated_frozen(spark, sf_dir):
    """Segments by the mean; every seventh fragment stays alone, and segments that hold a common exclusion stay apart."""
    state = _nodes(spark, sf_dir).select("node", (F.col("node") % 7 == 0).cast("int").alias("frozen"), F.when(F.col("node") % 5 == 1, F.array(F.col("node") % 3)).otherwise(F.array().cast("array<long>")).alias("exclusions"))
    return agglomeration.merge_by_priority(_edges(spark, sf_dir), state, priorities.barred_weight, 3500.0, {"frozen": "max", "exclusions": "union"})[2]


@query()
def agglomerated_by_sem(spark, sf_dir):
    """Segments in rounds by the mean less six standard errors, from sums that merge."""
    return agglomeration.merge_by_priority(_sums(spark, sf_dir), _nodes(spark, sf_dir).select("node"), priorities.sem_weight, 0.0)[2]


@query()
def agglomerated_by_model(spark, sf_dir):
    """Segments in rounds by a logistic model of flat training, features and probabilities anew in each round."""
    edges, nodes = grid.written(_edges(spark, sf_dir), "edges"), grid.written(learning.node_table(events_volume(spark, sf_dir)), "nodes")
    table = grid.written(_table(spark, sf_dir), "table")
    model = learning.fit(grid.written(learning.flat_training(edges, nodes, table), "training"), name="logistic regression")
    return agglomeration.merge_by_priority(edges, nodes.select("node", "size", "total"), learning.model_weight(model), 0.4)[2]


@query()
def learned_epochs(spark, sf_dir):
    """How many rows of each label two epochs of learning by agglomeration gather."""
    edges, nodes = _edges(spark, sf_dir), learning.node_table(events_volume(spark, sf_dir))
    rows = learning.learn_agglomerate(edges, nodes.select("node", "size", "total"), _table(spark, sf_dir), epochs=2, name="logistic regression")[1]
    return rows.groupBy("epoch", "label").agg(F.count("*").alias("edges"))


_PLACES = "WITH RECURSIVE " + VOX + """, f AS (SELECT idx, y, x, label FROM vox, (SELECT max(y) AS b, max(x) AS d FROM vox) WHERE y IN (0, b) OR x IN (0, d)), d(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
l AS (SELECT p.idx AS u, q.idx AS v FROM (SELECT idx, label, y + dy AS yy, x + dx AS xx FROM f, d) p JOIN f q ON q.y = p.yy AND q.x = p.xx AND q.label = p.label),
reach(a, b) AS (SELECT idx, idx FROM f UNION SELECT r.a, l.v FROM reach r JOIN l ON l.u = r.b), part AS (SELECT a AS idx, min(b) AS component FROM reach GROUP BY 1),
t AS (SELECT label AS node FROM f JOIN part USING (idx) GROUP BY 1 HAVING count(DISTINCT component) >= 2)"""


def _bands(spark, sf_dir):
    """Bands that cross the volume, cut off in every third, so that some traverse it and some don't."""
    label = F.expr("IF(x div 10 % 3 = 0 AND y >= 40 AND y < 60, 100L + x, x div 10 + 1L)")
    return events_volume(spark, sf_dir).withColumn("label", label)


_BAND_PLACES = _PLACES.replace("(event_id // 100 // 5) * 20 + (event_id % 100) // 5 + 1 AS label", "CASE WHEN event_id % 100 // 10 % 3 = 0 AND event_id // 100 BETWEEN 40 AND 59 THEN 100 + event_id % 100 ELSE event_id % 100 // 10 + 1 END AS label")


@query(_BAND_PLACES + " SELECT node FROM t")
def traversing_bodies(spark, sf_dir):
    return rag.traversing(_bands(spark, sf_dir))


@query(_BAND_PLACES + " SELECT DISTINCT label AS node FROM vox WHERE label <> 0 AND label NOT IN (SELECT node FROM t)")
def non_traversing_bodies(spark, sf_dir):
    return rag.non_traversing(_bands(spark, sf_dir))


@query()
def watershed_planes(spark, sf_dir):
    return kernels.watershed_sequence(events_volume(spark, sf_dir).withColumn("z", F.expr("CAST(y div 25 AS INT)")))


@query("WITH RECURSIVE " + VOX + """, b AS (SELECT idx, y, x FROM vox WHERE cents > 8000), d(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
l AS (SELECT p.idx AS u, q.idx AS v FROM (SELECT idx, y + dy AS yy, x + dx AS xx FROM b, d) p JOIN b q ON q.y = p.yy AND q.x = p.xx),
reach(a, b) AS (SELECT idx, idx FROM b UNION SELECT r.a, l.v FROM reach r JOIN l ON l.u = r.b) SELECT a AS idx, min(b) AS component FROM reach GROUP BY 1""")
def connected_bright(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("bright", (F.col("cents") > 8000).cast("int"))
    return grid.connected(v, "bright")


@query(EDGES + NODES + """, t AS (SELECT label AS s, gt AS g, count(*) AS n FROM vox GROUP BY 1, 2), best AS (SELECT s, arg_max(g, n * 1000000 - g) AS g FROM t GROUP BY 1), w AS (SELECT count(*)::DOUBLE AS t FROM vox),
c AS (SELECT u, v, sum((p.n + q.n) * log2(p.n + q.n) - p.n * log2(p.n) - q.n * log2(q.n)) AS cells, sum(p.n * q.n) AS shared FROM e JOIN t p ON p.s = u JOIN t q ON q.s = v AND q.g = p.g GROUP BY 1, 2),
f AS (SELECT e.u, e.v, e.n, e.total / e.n AS m, a.size AS su, b.size AS sv, a.total / a.size AS mu, b.total / b.size AS mv, coalesce(cells, 0) AS cells, coalesce(shared, 0) AS shared FROM e JOIN nd a ON a.node = e.u JOIN nd b ON b.node = e.v LEFT JOIN c ON c.u = e.u AND c.v = e.v),
o AS (SELECT *, least(su, sv)::DOUBLE AS lo, greatest(su, sv)::DOUBLE AS hi, CASE WHEN su <= sv THEN mu ELSE mv END AS ml, CASE WHEN su <= sv THEN mv ELSE mu END AS mh FROM f, w)
SELECT o.u, o.v, round(lo, 6) AS f1, round(ml, 6) AS f2, round(hi, 6) AS f3, round(mh, 6) AS f4, round(o.n::DOUBLE, 6) AS f5, round(m, 6) AS f6, round(hi - lo, 6) AS f7, round(abs(ml - mh), 6) AS f8,
CAST(CASE WHEN x.g = y.g THEN -1 ELSE 1 END AS INT) AS by_assignment, CAST(CASE WHEN (lo + hi) * log2(lo + hi) - lo * log2(lo) - hi * log2(hi) - 2 * cells < 0 THEN -1 ELSE 1 END AS INT) AS by_vi, CAST(CASE WHEN 2 * shared > lo * hi THEN -1 ELSE 1 END AS INT) AS by_rand,
round(-(lo / t * log2(lo / t) + hi / t * log2(hi / t) - (lo + hi) / t * log2((lo + hi) / t)), 6) AS w_vi, round(lo * hi / (t * (t - 1) / 2), 6) AS w_rand FROM o JOIN best x ON x.s = o.u JOIN best y ON y.s = o.v""")
def flat_training_columns(spark, sf_dir):
    """flat_training() with a column for each feature."""
    out = flat_training(spark, sf_dir)
    fs = [f"f{i + 1}" for i in range(8)]
    out = out.select("u", "v", *[F.col("features")[i].alias(f) for i, f in enumerate(fs)], "by_assignment", "by_vi", "by_rand", "w_vi", "w_rand")
    return _round(out, *fs, "w_vi", "w_rand")


@query()
def flat_training(spark, sf_dir):
    nodes = learning.node_table(events_volume(spark, sf_dir))
    return learning.flat_training(_edges(spark, sf_dir), nodes, _table(spark, sf_dir))


@query("""b AS (SELECT c_custkey AS block, c_custkey % 30 * 10 AS lz, c_custkey // 30 % 30 * 10 AS ly, c_custkey // 900 * 10 AS lx FROM customer)
SELECT a.block AS a, b.block AS b, CAST(0 AS INT) AS axis FROM b a JOIN b ON a.lz + 10 = b.lz AND a.ly = b.ly AND a.lx = b.lx
UNION ALL SELECT a.block, b.block, 1 FROM b a JOIN b ON a.lz = b.lz AND a.ly + 10 = b.ly AND a.lx = b.lx
UNION ALL SELECT a.block, b.block, 2 FROM b a JOIN b ON a.lz = b.lz AND a.ly = b.ly AND a.lx + 10 = b.lx""")
def adjacent_blocks(spark, sf_dir):
    """A block of every customer, in planes of 30 x 30 blocks."""
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    lo = [F.expr(f"CAST({e} * 10 AS INT)") for e in ("c_custkey % 30", "c_custkey div 30 % 30", "c_custkey div 900")]
    return segmentation.adjacent_blocks(c.select(F.col("c_custkey").alias("block"), F.array(*lo).alias("lo"), F.array(*[x + 9 for x in lo]).alias("hi")))


@query("""q AS (SELECT event_id AS id, user_id % 5 AS region, event_id // 400 AS z, event_id % 400 // 20 AS y, event_id % 20 AS x FROM events),
d(k) AS (VALUES (-2), (-1), (0), (1), (2)), s AS (SELECT q.*, z + i.k AS zz, y + j.k AS yy, x + l.k AS xx FROM q, d i, d j, d l WHERE i.k * i.k + j.k * j.k + l.k * l.k <= 4)
SELECT DISTINCT s.region, s.id FROM s JOIN q ON q.z = s.zz AND q.y = s.yy AND q.x = s.xx WHERE q.region < s.region""")
def near_points(spark, sf_dir):
    p = events_cube(spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("event_id").alias("idx"), (F.col("user_id") % 5).alias("region")), "idx")
    return segmentation.near_points(p.select("region", F.col("idx").alias("id"), "z", "y", "x"), 2.0)


@query("WITH RECURSIVE " + VOX + """, k AS (SELECT y, x, x // 50 AS block, gt + x // 50 * 1000000 AS label FROM vox), n AS (SELECT a.label AS u, b.label AS v, count(*) AS n FROM k a JOIN k b ON b.y = a.y AND b.x = a.x + 1 AND b.block <> a.block GROUP BY 1, 2),
l0 AS (SELECT u, v FROM (SELECT u, v, n, sum(n) OVER (PARTITION BY u) AS fu, sum(n) OVER (PARTITION BY v) AS fv FROM n) WHERE n >= 0.5::DOUBLE * least(fu, fv)), l AS (SELECT u, v FROM l0 UNION SELECT v, u FROM l0),
reach(a, b) AS (SELECT DISTINCT label, label FROM k UNION SELECT r.a, l.v FROM reach r JOIN l ON l.u = r.b) SELECT a AS label, min(b) AS stitched FROM reach GROUP BY 1""")
def stitched_blocks(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("block", F.expr("x div 50")).withColumn("label", F.expr("gt + block * 1000000"))
    return segmentation.stitch(v, "x")


# Back on the voxels


@query("WITH RECURSIVE " + EDGES + ", seg AS (" + _PARTS.format(*["CAST(total AS DOUBLE) / CAST(n AS DOUBLE) < 3000"] * 2).replace(", l AS", "WITH RECURSIVE l AS", 1) + ") SELECT idx, segment FROM vox JOIN seg ON node = label")
def segment_volume(spark, sf_dir):
    return rag.build_volume(events_volume(spark, sf_dir), threshold_segments(spark, sf_dir))


@query("WITH RECURSIVE " + EDGES + ", seg AS (" + _PARTS.format(*["CAST(total AS DOUBLE) / CAST(n AS DOUBLE) < 3000"] * 2).replace(", l AS", "WITH RECURSIVE l AS", 1) + ") SELECT idx, CASE WHEN segment IN (SELECT segment FROM seg GROUP BY 1 HAVING count(*) > 1) THEN segment ELSE 0 END AS segment FROM vox JOIN seg ON node = label")
def merged_volume(spark, sf_dir):
    """The voxels of segments of more than one fragment, 0 elsewhere."""
    seg = grid.written(threshold_segments(spark, sf_dir), "segments")
    return rag.build_volume(events_volume(spark, sf_dir), seg, seg.groupBy("segment").count().where("count > 1").select("segment"))


@query(EDGES + """, m AS (SELECT idx, max(CAST(e.total AS DOUBLE) / CAST(e.n AS DOUBLE)) AS w FROM bv JOIN e USING (u, v) GROUP BY 1)
SELECT idx, coalesce(w, 0) AS weight FROM vox LEFT JOIN m USING (idx)""")
def boundary_map(spark, sf_dir):
    b = grid.written(_exact(spark, sf_dir), "boundary")
    return rag.boundary_map(events_volume(spark, sf_dir), b, rag.edges(b).withColumn("weight", priorities.boundary_mean()))


@query(VOX + _BITS + """, g AS (SELECT idx, y, x, cents // 1000 AS s, truth AS t FROM w JOIN vox USING (idx)), d(k) AS (VALUES (-2), (-1), (0), (1), (2)),
o AS (SELECT i.k AS dy, j.k AS dx FROM d i, d j WHERE abs(i.k) + abs(j.k) <= 2),
r AS (SELECT a.idx, any_value(a.s) AS s, any_value(a.t) AS t, max(g.s) AS sd, max(g.t) AS td FROM (SELECT g.*, y + dy AS yy, x + dx AS xx FROM g, o) a JOIN g ON g.y = a.yy AND g.x = a.xx GROUP BY 1),
k AS (SELECT s AS threshold, count(*) AS n, sum(td) AS hit FROM r GROUP BY 1), f AS (SELECT sd AS threshold, sum(t) AS found FROM r GROUP BY 1)
SELECT threshold, CAST(sum(hit) OVER q AS DOUBLE) / CAST(sum(n) OVER q AS DOUBLE) AS precision, CAST(sum(coalesce(found, 0)) OVER q AS DOUBLE) / CAST((SELECT sum(t) FROM r) AS DOUBLE) AS recall FROM k LEFT JOIN f USING (threshold) WINDOW q AS (ORDER BY threshold DESC)""".replace("w JOIN vox USING (idx)", "wv").replace("truth AS t FROM wv", "CAST((y % 7 = 0 OR x % 7 = 0) AS BIGINT) AS t FROM vox"))
def wiggle_room_precision_recall(spark, sf_dir):
    return contingency.wiggle_room(_predicted(spark, sf_dir).withColumn("score", F.expr("cents div 1000")), "score", "truth", 2)


@query(EXACT + """, b AS (SELECT u, v, count(DISTINCT idx) AS n, max(y) - min(y) + 1 AS h, max(x) - min(x) + 1 AS w FROM bv GROUP BY 1, 2)
SELECT u, v, CAST(n AS DOUBLE) / CAST(h * w * 2 AS DOUBLE) AS squiggliness FROM b""")
def squiggliness(spark, sf_dir):
    v = events_volume(spark, sf_dir)
    return rag.squiggliness(rag.edge_boxes(_located(spark, sf_dir).join(v.select("idx", "z", "y", "x"), "idx")))


@query(EDGES + NODES + """, s AS (SELECT label, count(*) FILTER (cents > 5000) + 1 AS s FROM vox GROUP BY 1), b AS (SELECT u, v, count(*) FILTER (cents > 5000) + 1 AS b FROM bv GROUP BY 1, 2)
SELECT u, v, round(b / p.s, 6) AS u0, round(b / p.s / (e.n / a.size), 6) AS u0_rel, round(b / q.s, 6) AS v0, round(b / q.s / (e.n / c.size), 6) AS v0_rel
FROM b JOIN e USING (u, v) JOIN s p ON p.label = u JOIN s q ON q.label = v JOIN nd a ON a.node = u JOIN nd c ON c.node = v""")
def contact_ratios(spark, sf_dir):
    b = grid.written(_exact(spark, sf_dir), "boundary")
    v = events_volume(spark, sf_dir)
    out = rag.contact_ratios(rag.contact_features(b, v, (5000,)), rag.edges(b), rag.nodes(v), 1)
    return _round(out, "u0", "u0_rel", "v0", "v0_rel")


# Shapes: fragments of the voxels over 20.00


_SHAPES = VOX + """, g AS (SELECT label AS node, count(*) AS n, avg(y) AS cy, avg(x) AS cx, coalesce(var_samp(y), 0) / count(*) AS a, coalesce(var_samp(x), 0) / count(*) AS b, coalesce(covar_samp(y, x), 0) / count(*) AS c FROM vox WHERE cents > 2000 GROUP BY 1),
s AS (SELECT *, (a + b) / 2 + sqrt(((a - b) / 2) ** 2 + c ** 2) AS v1, (a + b) / 2 - sqrt(((a - b) / 2) ** 2 + c ** 2) AS v2, atan2(2 * c, a - b) / 2 AS phi FROM g)"""


def _shapes(spark, sf_dir):
    bright = events_volume(spark, sf_dir).where("cents > 2000").withColumnRenamed("label", "node")
    return orientation.described(orientation.coordinate_sums(bright, ["node"]), ["node"])


@query(_SHAPES + " SELECT node, n, round(v1, 4) + 0.0 AS val1, round(abs(v2), 4) + 0.0 AS val2, CASE WHEN v1 + v2 > 0 THEN round(((v1 - v2) / (v1 + v2)) ** 2, 4) + 0.0 ELSE 0.0 END AS coherence FROM s")
def node_orientations(spark, sf_dir):
    s = _shapes(spark, sf_dir).select("node", "n", "val1", F.abs("val2").alias("val2"), "coherence")
    return _round(s, "val1", "val2", "coherence", digits=4)


@query(EXACT + _SHAPES.split("FROM events)", 1)[1] + """, t AS (SELECT *, CASE WHEN v1 - v2 > 1e-9 * v1 THEN cos(phi) ELSE 0 END AS ey, CASE WHEN v1 - v2 > 1e-9 * v1 THEN sin(phi) ELSE 0 END AS ex FROM s),
p AS (SELECT DISTINCT u, v FROM bv), j AS (SELECT u, v, k.ey AS py, k.ex AS px, q.ey AS qy, q.ex AS qx, k.cy - q.cy AS dy, k.cx - q.cx AS dx FROM p JOIN t k ON k.node = u JOIN t q ON q.node = v),
m AS (SELECT u, v, acos(least(1, abs(py * qy + px * qx))) AS b, acos(least(1, abs(py * dy + px * dx) / sqrt(dy * dy + dx * dx))) AS p, acos(least(1, abs(qy * dy + qx * dx) / sqrt(dy * dy + dx * dx))) AS q FROM j)
SELECT u, v, round(b, 4) + 0.0 AS between_axes, round(least(p, q), 4) + 0.0 AS least_angle, round(greatest(p, q), 4) + 0.0 AS most_angle, round((p + q) / 2, 4) + 0.0 AS mean_angle FROM m""")
def orientation_angles(spark, sf_dir):
    a = orientation.angles(_edges(spark, sf_dir), _shapes(spark, sf_dir))
    a = a.select("u", "v", F.col("between").alias("between_axes"), F.col("least").alias("least_angle"), F.col("most").alias("most_angle"), F.col("mean").alias("mean_angle"))
    return _round(a, "between_axes", "least_angle", "most_angle", "mean_angle", digits=4)


# Searches


@query(VOX + """, k AS (SELECT idx, y, x, CASE WHEN y % 12 < 5 AND x % 9 < 4 THEN 0 ELSE label END AS label FROM vox), d(k) AS (SELECT range - 5 FROM range(11)),
near AS (SELECT a.idx, arg_min(k.label, greatest(abs(dy), abs(dx)) * 1000000000 + k.label) AS label FROM (SELECT k.*, i.k AS dy, j.k AS dx, y + i.k AS yy, x + j.k AS xx FROM k, d i, d j WHERE label = 0) a JOIN k ON k.y = a.yy AND k.x = a.xx WHERE k.label <> 0 GROUP BY 1)
SELECT idx, coalesce(near.label, k.label) AS label FROM k LEFT JOIN near USING (idx)""")
def undammed(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("label", F.expr("IF(y % 12 < 5 AND x % 9 < 4, 0L, label)"))
    return search.undam(v)


@query("WITH RECURSIVE " + VOX + """, f AS (SELECT idx, y, x FROM vox WHERE least(cents // 1000, 9) IN (0, 1, 2, 3, 4, 5)), d(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
r AS (SELECT idx, y, x FROM f WHERE idx % 2500 = 7 UNION SELECT f.idx, f.y, f.x FROM (SELECT y + dy AS yy, x + dx AS xx FROM r, d) s JOIN f ON f.y = yy AND f.x = xx) SELECT CAST(0 AS INT) AS z, CAST(y AS INT) AS y, CAST(x AS INT) AS x FROM r""")
def flood_filled(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("level", F.expr("least(cents div 1000, 9L)"))
    return search.flood_fill(v, v.where("idx % 2500 = 7"), spark.range(6).toDF("level"), "level", ("y", "x")).select("z", "y", "x")


@query("WITH RECURSIVE " + VOX + """, k AS (SELECT idx, y, x, cents // 500 AS v FROM vox), d(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
near AS (SELECT a.idx, a.v, k.idx AS o, k.v AS ov FROM (SELECT k.*, y + dy AS yy, x + dx AS xx FROM k, d) a JOIN k ON k.y = a.yy AND k.x = a.xx),
low AS (SELECT idx, any_value(v) AS v, min(ov) AS lv, arg_min(o, ov * 1000000000 + o) AS o FROM near GROUP BY 1), slope AS (SELECT idx, v, o FROM low WHERE lv < v), lvl AS (SELECT idx, v FROM low WHERE lv >= v),
step AS (SELECT near.idx, near.o FROM near JOIN lvl ON lvl.idx = near.o WHERE near.v = near.ov),
fr(idx, src, d) AS (SELECT idx, idx, 0 FROM slope UNION SELECT s.o, fr.src, d + 1 FROM fr JOIN step s ON s.idx = fr.idx WHERE d < 14), ex AS (SELECT idx, arg_min(src, CAST(d AS BIGINT) * 1000000000 + src) AS src FROM fr WHERE d > 0 GROUP BY 1),
fl AS (SELECT idx FROM lvl WHERE idx NOT IN (SELECT idx FROM ex)), part(a, b) AS (SELECT idx, idx FROM fl UNION SELECT p.a, s.o FROM part p JOIN step s ON s.idx = p.b),
way AS (SELECT idx, o AS t FROM slope UNION ALL SELECT idx, src FROM ex UNION ALL SELECT a, min(b) FROM part GROUP BY 1),
go(idx, b) AS (SELECT idx, idx FROM way UNION SELECT go.idx, w.t FROM go JOIN way w ON w.idx = go.b) SELECT go.idx, b AS basin FROM go JOIN way w ON w.idx = b WHERE w.t = b""")
def basins(spark, sf_dir):
    return search.basins(events_volume(spark, sf_dir).withColumn("level", F.expr("cents div 500")), "level")


# Floods and minima, on the intensity in steps of 20.00


#: lv has the volume's voxels with a height and a marker; sunk the least height by which markers, let down, reach each.
_LAND = "WITH RECURSIVE " + VOX + """, lv AS (SELECT idx, y, x, least(cents // 2000, 7) AS h, {marker} AS m FROM vox), t(t) AS (SELECT range FROM range(20)), d(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)),
r(t, y, x) AS (SELECT t, y, x FROM lv, t WHERE m <= t AND h <= t UNION SELECT s.t, lv.y, lv.x FROM (SELECT t, y + dy AS yy, x + dx AS xx FROM r, d) s JOIN lv ON lv.y = s.yy AND lv.x = s.xx AND lv.h <= s.t),
sunk AS (SELECT y, x, min(t) AS value FROM r GROUP BY 1, 2)"""


def _land(spark, sf_dir):
    return events_volume(spark, sf_dir).withColumn("height", F.expr("least(cents div 2000, 7L)"))


@query(_LAND.format(marker="idx % 11 + 2") + " SELECT idx, CAST(value AS BIGINT) AS value FROM lv LEFT JOIN sunk USING (y, x)")
def reconstructed(spark, sf_dir):
    return landscape.reconstruct_down(_land(spark, sf_dir).withColumn("marker", F.expr("idx % 11 + 2")), "marker", "height")


@query(_LAND.format(marker="least(cents // 2000, 7) + 2") + " SELECT idx, CAST(value AS BIGINT) AS value FROM lv LEFT JOIN sunk USING (y, x)")
def hminima(spark, sf_dir):
    return landscape.hminima(_land(spark, sf_dir), "height", 2)


@query(_LAND.format(marker="CASE WHEN idx % 997 = 5 THEN least(cents // 2000, 7) END") + " SELECT idx, CAST(coalesce(value, (SELECT max(h) FROM lv)) AS BIGINT) AS value FROM lv LEFT JOIN sunk USING (y, x)")
def imposed_minima(spark, sf_dir):
    return landscape.impose_minima(_land(spark, sf_dir), "height", F.expr("idx % 997 = 5"))


@query(_LAND.format(marker="NULL::BIGINT").split(", t(t)")[0] + """, d(dy, dx) AS (VALUES (0, 1), (0, -1), (1, 0), (-1, 0)), near AS (SELECT a.idx, a.h, b.idx AS o, b.h AS oh FROM (SELECT lv.*, y + dy AS yy, x + dx AS xx FROM lv, d) a JOIN lv b ON b.y = a.yy AND b.x = a.xx),
dry(idx) AS (SELECT idx FROM near WHERE oh < h UNION SELECT n.o FROM dry JOIN near n ON n.idx = dry.idx WHERE n.h = n.oh), part(a, b) AS (SELECT idx, idx FROM lv WHERE idx NOT IN (SELECT idx FROM dry) UNION SELECT p.a, n.o FROM part p JOIN near n ON n.idx = p.b WHERE n.h = n.oh)
SELECT idx, m.b AS minimum FROM lv LEFT JOIN (SELECT a, min(b) AS b FROM part GROUP BY 1) m ON m.a = idx""")
def regional_minima(spark, sf_dir):
    return landscape.regional_minima(_land(spark, sf_dir), "height")


@query(_LAND.format(marker="CASE WHEN idx % 997 = 5 THEN least(cents // 2000, 7) END") + " SELECT idx, CAST(value AS BIGINT) AS height FROM lv LEFT JOIN sunk USING (y, x)")
def flood_heights(spark, sf_dir):
    """How high the water stands where a flood from every 997th voxel first reaches a voxel."""
    v = _land(spark, sf_dir)
    return landscape.flood(v, v.where("idx % 997 = 5").select("idx", F.col("idx").alias("label")), "height").select("idx", "height")


@query()
def flooded(spark, sf_dir):
    """A watershed of the whole volume from its regional minima of full intensity."""
    v = events_volume(spark, sf_dir)
    seeds = grid.written(landscape.regional_minima(v).where("minimum IS NOT NULL").select("idx", F.col("minimum").alias("label")), "seeds")
    return landscape.flood(v, seeds).select("idx", "label")


_SEEDS = VOX + """, k AS (SELECT idx, y, x, CASE WHEN y % 9 < 2 AND x % 13 < 3 THEN label ELSE 0 END AS seed FROM vox), p AS (SELECT * FROM k WHERE idx % 17 = 3), d(dy, dx) AS (VALUES (0, 0), (0, 1), (0, -1), (1, 0), (-1, 0)),
b AS (SELECT p.idx, max(k.seed) AS s FROM (SELECT p.*, y + dy AS yy, x + dx AS xx FROM p, d) p JOIN k ON k.y = p.yy AND k.x = p.xx GROUP BY 1), gone AS (SELECT s FROM b WHERE s <> 0 GROUP BY 1 HAVING count(*) > 1),
kept AS (SELECT idx, CASE WHEN seed IN (SELECT s FROM gone) THEN 0 ELSE seed END AS seed FROM k), n AS (SELECT idx, row_number() OVER (ORDER BY idx) AS r FROM b WHERE s = 0)"""


@query(_SEEDS + " SELECT idx, CAST(coalesce(r + (SELECT max(seed) FROM kept), seed) AS BIGINT) AS seed FROM kept LEFT JOIN n USING (idx)")
def minimum_seeds(spark, sf_dir):
    v = events_volume(spark, sf_dir).withColumn("seed", F.expr("IF(y % 9 < 2 AND x % 13 < 3, label, 0L)"))
    return landscape.minimum_seeds(v, v.where("idx % 17 = 3"))


@query()
def exclusions_split(spark, sf_dir):
    """Fragments with voxels of two bright spots, flooded anew from the spots."""
    v = events_volume(spark, sf_dir).withColumn("exclusion", F.expr("IF(cents > 20000, gt, 0L)"))
    return landscape.split_exclusions(v)


@query()
def manually_split(spark, sf_dir):
    """The body of the first voxel, cut in two by seeds in its corners."""
    v = events_volume(spark, sf_dir)
    seeds = v.where("idx IN (0, 606)").select("idx", (F.col("idx") + 1000000).alias("label"))
    return landscape.manual_split(v, 1, seeds, label="gt").withColumnRenamed("gt", "body")


# Trees and inclusions


@query("WITH RECURSIVE " + EDGES + """, k AS (SELECT u, v, row_number() OVER (ORDER BY CAST(total AS DOUBLE) / CAST(n AS DOUBLE), u, v) AS r FROM e), adj AS (SELECT u, v, r FROM k UNION ALL SELECT v, u, r FROM k),
rc(r, x) AS (SELECT r, u FROM k UNION SELECT rc.r, a.v FROM rc JOIN adj a ON a.u = rc.x AND a.r < rc.r) SELECT u, v FROM k WHERE NOT EXISTS (SELECT 1 FROM rc WHERE rc.r = k.r AND rc.x = k.v)""")
def least_spanning_forest(spark, sf_dir):
    return trees.spanning_forest(_edges(spark, sf_dir).withColumn("weight", priorities.boundary_mean()), ("weight",)).select("u", "v")


@query()
def lowest_common_merges(spark, sf_dir):
    """For fragments 37 apart, the merge of the history under 3000 that first brings them together, if one does."""
    nodes = grid.written(_nodes(spark, sf_dir).select("node"), "fragments")
    log = grid.written(agglomeration.history(_edges(spark, sf_dir), nodes, 3000.0), "history")
    pairs = nodes.select(F.col("node").alias("a"), (F.col("node") + 37).alias("b")).join(nodes.select(F.col("node").alias("b")), "b", "left_semi")
    return agglomeration.joined_by(log, pairs)


@query()
def separated_fragments(spark, sf_dir):
    """Segments of the history under 3000 after fragments side by side that belong to different bodies are set apart."""
    nodes, edges = grid.written(_nodes(spark, sf_dir).select("node"), "fragments"), grid.written(_edges(spark, sf_dir), "edges")
    best = grid.written(contingency.assignment(_table(spark, sf_dir)), "assignment")
    side = lambda k: best.select(F.col("s").alias(k), F.col("g").alias(f"g{k}"))
    wrong = edges.join(side("u"), "u").join(side("v"), "v").where("gu <> gv").select(F.col("u").alias("a"), F.col("v").alias("b"))
    return agglomeration.separate(agglomeration.history(edges, nodes, 3000.0), nodes, wrong)


_RINGED = "WITH RECURSIVE " + FOOT.replace("(event_id // 100 // 5) * 20 + (event_id % 100) // 5 + 1 AS label", """(event_id // 1000 * 10 + event_id % 100 // 10) * 8 +
  CASE WHEN least(event_id // 100 % 10, 9 - event_id // 100 % 10, event_id % 10, 9 - event_id % 10) = 2 AND event_id % 10 >= 5 THEN 6 ELSE least(event_id // 100 % 10, 9 - event_id // 100 % 10, event_id % 10, 9 - event_id % 10) + 1 END AS label""") + """,
e0 AS (SELECT DISTINCT least(label, o) AS u, greatest(label, o) AS v FROM near WHERE label <> o UNION SELECT DISTINCT 0, label FROM vox, (SELECT max(y) AS b, max(x) AS d FROM vox) WHERE y IN (0, b) OR x IN (0, d)),
adj AS (SELECT u, v FROM e0 UNION ALL SELECT v, u FROM e0), nd AS (SELECT DISTINCT label AS node FROM vox)"""


def _ringed(spark, sf_dir):
    """Nested rings in each 10 x 10 voxels, the third one of two halves, and 0 for all beyond the volume: (edges, nodes)."""
    ring = "least(y % 10, 9 - y % 10, x % 10, 9 - x % 10)"
    v = events_volume(spark, sf_dir).withColumn("label", F.expr(f"CAST((y div 10 * 10 + x div 10) * 8 + IF({ring} = 2 AND x % 10 >= 5, 6, {ring} + 1) AS BIGINT)"))
    edges = grid.label_contacts(v).union(rag.face_labels(v).select(F.lit(0).cast("long"), "node"))
    return grid.written(edges, "edges"), v.select(F.col("label").alias("node")).distinct()


@query(_RINGED + """, rc(c, x) AS (SELECT node, 0 FROM nd UNION SELECT r.c, a.v FROM rc r JOIN adj a ON a.u = r.x WHERE a.v <> r.c),
cut AS (SELECT c.node AS c, w.node AS w FROM nd c, nd w WHERE c.node <> w.node AND NOT EXISTS (SELECT 1 FROM rc WHERE rc.c = c.node AND rc.x = w.node)), l AS (SELECT c AS u, w AS v FROM cut UNION ALL SELECT w, c FROM cut),
reach(a, b) AS (SELECT node, node FROM nd UNION SELECT r.a, l.v FROM reach r JOIN l ON l.u = r.b) SELECT a AS node, min(b) AS segment FROM reach GROUP BY 1""")
def inclusions_removed(spark, sf_dir):
    edges, nodes = _ringed(spark, sf_dir)
    return trees.inclusions(edges, nodes, 0)


@query(_RINGED + """, al AS (SELECT u, min(v) AS v FROM adj GROUP BY 1 HAVING count(*) = 1)
SELECT node, coalesce((SELECT v FROM al WHERE al.u = node AND NOT EXISTS (SELECT 1 FROM al q WHERE q.u = al.v AND q.v = al.u AND al.u < al.v)), node) AS segment FROM nd""")
def obvious_inclusions_removed(spark, sf_dir):
    edges, nodes = _ringed(spark, sf_dir)
    return trees.obvious_inclusions(edges, nodes)


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
