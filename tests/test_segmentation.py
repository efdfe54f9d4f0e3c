"""The segmentation operators against small volumes whose results are known, and against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain import catalog
from voxelgrain.operators import agglomeration, contingency, grid, kernels, learning, priorities, rag
from voxelgrain.plans import segmentation
from voxelgrain.sources import volumes
from voxelgrain.streaming import proofread


def labels_of(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


@pytest.fixture(scope="module")
def small(spark):
    a = np.array([[1, 1, 1, 2, 2], [1, 1, 1, 2, 2], [3, 3, 4, 4, 4], [3, 3, 4, 4, 4]])
    p = np.arange(20).reshape(4, 5) * 10
    return volumes.from_arrays(spark, label=a, cents=p, gt=(a + 1) // 2).cache()


def brute_edges(a, p, exact, boundary=None):
    out = {}
    for at in np.ndindex(a.shape):
        near = []
        for s in ((0, 1), (1, 0), (0, -1), (-1, 0)):
            k = (at[0] + s[0], at[1] + s[1])
            if 0 <= k[0] < a.shape[0] and 0 <= k[1] < a.shape[1]:
                near.append(int(a[k]))
            elif boundary:
                near.append(boundary)
        me = int(a[at])
        if exact:
            pairs = [(min(me, o), max(me, o)) for o in set(near) - {me}]
        else:
            lo, hi = min([me, *near]), max([me, *near])
            pairs = [(lo, me)] * (lo != me) + [(me, hi)] * (hi != me)
        for e in pairs:
            n, t = out.get(e, (0, 0))
            out[e] = (n + 1, t + int(p[at]))
    return sorted((*k, *v) for k, v in out.items())


def test_edges_of_a_small_volume(small):
    got = {(u, v): n for u, v, n in labels_of(rag.edges(rag.boundary_voxels(small)), "u", "v", "n")}
    assert got == {(1, 2): 3, (1, 3): 4, (1, 4): 2, (2, 4): 4, (3, 4): 3}


@pytest.mark.parametrize("exact,boundary", [(True, None), (False, None), (False, 7)])
def test_edges_against_brute_force(spark, exact, boundary):
    rng = np.random.default_rng(2)
    a, p = rng.integers(1, 7, (9, 11)), rng.integers(0, 100, (9, 11))
    v = volumes.from_arrays(spark, label=a, cents=p)
    got = labels_of(rag.edges(rag.boundary_voxels(v, "exact" if exact else "minmax", boundary=boundary is not None)), "u", "v", "n", "total")
    assert got == brute_edges(a, p, exact, boundary)


def test_thin_fragment_and_line(spark):
    thin = volumes.from_arrays(spark, label=np.array([[1, 2, 3]] * 3), cents=np.zeros((3, 3), int))
    assert (1, 3) not in labels_of(rag.boundary_voxels(thin), "u", "v")
    line = volumes.from_arrays(spark, label=np.array([1, 1, 5, 5]), cents=np.zeros(4, int))
    assert set(labels_of(rag.boundary_voxels(line, axes=("x",)), "u", "v")) == {(1, 5)}


def test_diagonal_means(spark):
    v = volumes.from_arrays(spark, label=np.array([[1, 2], [3, 4]]), cents=np.array([[1, 0], [0, 1]]))
    e = rag.edges(rag.boundary_voxels(v, "exact", connectivity=2)).withColumn("w", priorities.boundary_mean())
    got = {(u, x): w for u, x, w in labels_of(e, "u", "v", "w")}
    assert got[(1, 2)] == 0.5 and got[(1, 4)] == 1.0


def test_a_masked_voxel_is_no_neighbour(spark):
    v = volumes.from_arrays(spark, label=np.array([[1, 2], [3, 4]]), cents=np.zeros((2, 2), int)).where("label <> 4")
    assert set(labels_of(rag.boundary_voxels(v, "exact"), "u", "v")) == {(1, 2), (1, 3)}


def test_known_comparisons(spark):
    pairs = lambda s, g: spark.createDataFrame(list(zip(s, g, strict=True)), "label long, gt long")
    t = contingency.contingency(pairs([0, 1, 1, 1, 2, 2, 2, 3], [1, 1, 1, 2, 2, 2, 2, 0]))
    assert {(s, g): p for s, g, p in labels_of(contingency.normalised(t), "s", "g", "p")} == {(0, 1): 0.125, (1, 1): 0.25, (1, 2): 0.125, (2, 2): 0.375, (3, 0): 0.125}
    t = contingency.contingency(pairs([1, 2, 3, 4], [1, 1, 8, 8]))
    assert contingency.vi(t).first().vi == 1
    assert tuple(contingency.split_vi(t).first()) == (0, 1)
    from itertools import product

    seg, gt = [[2, 1], [1, 2]], [[1, 2], [3, 1]]
    t = contingency.contingency(pairs([x for r in seg for x in r], [x for r in gt for x in r]))
    assert contingency.adapted_rand_error(t).first().error == pytest.approx(1 / 3)
    s, g = [1, 1, 1, 2, 2, 3], [1, 1, 2, 2, 3, 3]
    same = [(s[i] == s[j], g[i] == g[j]) for i, j in product(range(6), range(6)) if i < j]
    want = tuple(same.count(k) for k in ((True, True), (True, False), (False, True), (False, False)))
    assert tuple(contingency.rand_values(contingency.contingency(pairs(s, g))).first()) == want
    assert labels_of(contingency.stratified_sample(spark.createDataFrame([(x,) for x in (4, 0, 1, 2, 3, 1)], "v int"), "v", 2), "value") == [(0,), (2,), (4,)]


def test_vanished_labels_count_as_minus_one(spark):
    t = spark.createDataFrame([(1, 1, 5), (1, 2, 5), (2, 2, 1)], "s long, g long, n long")
    assert tuple(contingency.edit_distance(t, 3).first()) == (0, 0)


def test_small_volume_operators(small, spark):
    assert labels_of(grid.label_contacts(small), "u", "v") == [(1, 2), (1, 3), (1, 4), (2, 4), (3, 4)]
    assert labels_of(rag.common_neighbours(rag.edges(rag.boundary_voxels(small))), "u", "v", "common") == [(1, 2, 1), (1, 3, 1), (1, 4, 2), (2, 4, 1), (3, 4, 1)]
    m = rag.central_moments(rag.moment_sums(small, ["label"], F.col("cents").cast("double"), 3), 3).where("label = 2").first()
    x = np.array([30, 40, 80, 90])
    assert m["mean"] == x.mean() and m["c2"] == pytest.approx(((x - x.mean()) ** 2).mean()) and m["c3"] == pytest.approx(((x - x.mean()) ** 3).mean(), abs=1e-6)
    h = {r.label: r.h for r in rag.histogram(small, ["label"], "cents", 4, 0, 190).collect()}
    for k, v in h.items():
        p = [r.cents for r in small.where(F.col("label") == k).collect()]
        assert v == np.histogram(p, 4, (0, 190))[0].tolist()
    ring = volumes.from_arrays(spark, label=np.array([[1, 1, 1], [1, 2, 1], [1, 1, 1]]))
    assert labels_of(rag.orphans(ring), "node") == [(2,)]
    assert {r.label for r in grid.despeckle(ring).select("idx", "label").collect()} <= {1, 2}
    gap = volumes.from_arrays(spark, label=np.array([[1, 0, 1, 0, 2]]))
    assert [x for _, x in labels_of(grid.close_merged_gaps(gap), "idx", "label")] == [1, 1, 1, 0, 2]
    js = spark.createDataFrame([([0.5, 0.5], [1.0, 0.0])], "p array<double>, q array<double>").select(rag.js_divergence(F.col("p"), F.col("q")).alias("x")).first().x
    assert js == pytest.approx(0.5 * (0.5 * np.log(0.5 / 0.75) + 0.5 * np.log(0.5 / 0.25)) + 0.5 * np.log(1 / 0.75))


def random_graph(rng, n=40):
    e = {}
    for i in range(n):
        for j in (i + 1, i + 7):
            if j < n:
                e[(i, j)] = (int(rng.integers(1, 9)), float(rng.integers(1, 1000)))
    return [(u, v, k, t) for (u, v), (k, t) in e.items()]


@pytest.mark.parametrize("threshold", [20.0, 60.0])
def test_agglomeration_is_one_replay(spark, threshold):
    rng = np.random.default_rng(4)
    rows = random_graph(rng)
    edges = spark.createDataFrame(rows, "u long, v long, n long, total double")
    nodes = spark.range(40).withColumnRenamed("id", "node")
    held = {i: {i} for i in range(40)}
    for _, a, b, p, w in agglomeration.replay(rows, threshold):
        assert w < threshold
        held[p] = held.pop(a) | held.pop(b)
    want = sorted((n, min(s)) for s in held.values() for n in s)
    log = agglomeration.agglomerate(edges, threshold).cache()
    assert labels_of(agglomeration.segments(log, nodes), "node", "segment") == want
    assert labels_of(agglomeration.rounds(edges, nodes, threshold), "node", "segment") == want
    cut = threshold / 2
    held = {i: {i} for i in range(40)}
    for _, a, b, p, _ in agglomeration.replay(rows, cut):
        held[p] = held.pop(a) | held.pop(b)
    assert labels_of(agglomeration.segments(log, nodes, cut), "node", "segment") == sorted((n, min(s)) for s in held.values() for n in s)


def test_merge_order_ids_and_exclusions(spark):
    rows = [(1, 2, 1, 0.1), (2, 3, 1, 0.2), (1, 3, 1, 0.9), (3, 4, 1, 0.3)]
    assert agglomeration.replay(rows, 1.0, first_id=10) == [(0, 1, 2, 10, 0.1), (1, 3, 4, 11, 0.3), (2, 10, 11, 12, pytest.approx(0.55))]
    assert agglomeration.replay(rows, 1.0, most=1, first_id=10) == [(0, 1, 2, 10, 0.1)]
    assert agglomeration.replay(rows, 0.1) == []
    log = agglomeration.replay(rows, 1.0, excluded={1: {5}, 2: {5}}, first_id=10)
    assert all({a, b} != {1, 2} for _, a, b, _, _ in log)
    edges = spark.createDataFrame(rows, "u long, v long, n long, total double")
    ex = spark.createDataFrame([(1, [5]), (2, [5])], "node long, exclusions array<int>")
    got = agglomeration.agglomerate(edges, 1.0, ex).collect()
    assert len(got) == len(agglomeration.replay(rows, 1.0, excluded={1: {5}, 2: {5}}))
    one = agglomeration.split_merge(agglomeration.agglomerate(edges, 1.0), 1, 1, 4).first()
    assert one.weight == pytest.approx(0.55)


def test_components_and_best_segments(spark):
    nodes = spark.range(30).withColumnRenamed("id", "node")
    links = spark.createDataFrame([(i, i + 1) for i in range(5, 20)] + [(25, 22), (25, 28)], "u long, v long")
    got = dict(labels_of(grid.components(nodes, links), "node", "component"))
    assert got == {**{i: i for i in range(30)}, **{i: 5 for i in range(5, 21)}, 25: 22, 28: 22}
    a = np.array([[1, 1, 2, 2], [1, 0, 0, 2], [3, 3, 1, 1]])
    v = volumes.from_arrays(spark, label=a)
    assert dict(labels_of(grid.connected(v, "label"), "idx", "component")) == {0: 0, 1: 0, 4: 0, 2: 2, 3: 2, 7: 2, 8: 8, 9: 8, 10: 10, 11: 10}


def test_delta_vi_and_rand_are_the_changes(spark):
    rng = np.random.default_rng(8)
    s, g = rng.integers(0, 5, 60), rng.integers(0, 4, 60)
    pairs = lambda x: contingency.contingency(spark.createDataFrame(list(zip(x.tolist(), g.tolist(), strict=True)), "label long, gt long"))
    edge = spark.createDataFrame([(1, 3, 1, 0.0)], "u long, v long, n long, total double")
    before, after = pairs(s), pairs(np.where(s == 3, 1, s))
    assert priorities.true_delta_vi(edge, before).first().delta_vi == pytest.approx(contingency.vi(after).first().vi - contingency.vi(before).first().vi)
    rand = lambda t: contingency.rand_measures(t).first().rand_index
    assert priorities.true_delta_rand(edge, before).first().delta_rand == pytest.approx(rand(after) - rand(before))


def test_watershed_kernels():
    line = np.array([1, 0, 1, 2, 1, 3, 2, 0, 2, 4, 1, 0])
    assert kernels.watershed(line).tolist() == [1, 1, 1, 0, 2, 0, 3, 3, 3, 0, 4, 4]
    assert set(kernels.watershed(line, dams=False).tolist()) == {1, 2, 3, 4}
    saddle = np.array([[0, 0, 3], [2, 1, 2], [0, 0, 3]])
    assert kernels.watershed(saddle).tolist() == [[1, 1, 1], [0, 0, 0], [2, 2, 2]]
    seeds = np.zeros(12, int)
    seeds[1], seeds[11] = 1, 2
    assert set(kernels.watershed(line, seeds).tolist()) == {0, 1, 2}
    assert kernels.nearest_label(np.array([1, 0, 0, 2])).tolist() == [1, 1, 2, 2]
    a = np.array([3, 1, 3, 2, 3, 0, 3])
    assert (kernels.regional_minima(kernels.hminima(a, 1)) > 0).sum() == 2 and kernels.hminima(a, 1).max() == 3
    only = kernels.impose_minima(a, np.array([0, 1, 0, 0, 0, 0, 0], bool))
    assert np.flatnonzero(kernels.regional_minima(only)).tolist() == [1]
    c = kernels.compact_watershed(np.zeros((4, 6)), np.array([[1, 0, 0, 0, 0, 2]] + [[0] * 6] * 3), 1.0)
    assert (c[:, :3] == 1).all() and (c[:, 3:] == 2).all()
    vol = np.zeros((2, 3, 4), int)
    vol[1, 1:] = 5
    assert len(kernels.flood_fill(vol, (1, 1, 0), [5])) == 8 and kernels.flood_fill(vol, (0, 0, 0), [5]) == []
    with pytest.raises(ValueError):
        kernels.flood_fill(vol[0], (0, 0), [0])


def test_graph_kernels():
    edges = [(0, 1), (1, 2), (2, 0), (2, 3), (3, 4), (4, 5), (5, 3)]
    assert sorted(map(sorted, kernels.biconnected(edges))) == [[0, 1, 2], [2, 3], [3, 4, 5]]
    assert kernels.inclusions(edges, 0) == {3: 2, 4: 2, 5: 2}
    w = np.kron(np.eye(3), np.ones((4, 4)))
    c = kernels.normalised_cut(w, 3)
    assert len({tuple(set(c[i : i + 4])) for i in (0, 4, 8)}) == 3


def test_vtk_round_trip(spark, tmp_path):
    for kind in (np.uint8, np.int32, np.float64):
        a = (np.arange(24) * 3).reshape(2, 3, 4).astype(kind)
        assert (volumes.parse_vtk(volumes.vtk_bytes(a)) == a).all()
    (tmp_path / "a.vtk").write_bytes(volumes.vtk_bytes(a))
    rows = labels_of(volumes.read_vtk(spark, f"file://{tmp_path}/*.vtk"), "z", "y", "x", "value")
    assert [r[3] for r in rows] == a.ravel().tolist()


def test_volume_files_and_maps(small, spark, tmp_path):
    volumes.write_volume(small, f"file://{tmp_path}/v")
    back = volumes.read_volume(spark, f"file://{tmp_path}/v", {"z": (0, 1), "y": (1, 3)})
    assert labels_of(back, "idx") == [(i,) for i in range(5, 15)]
    m = spark.createDataFrame([(1, 7), (2, 8)], "old long, new long")
    assert {x for (x,) in labels_of(volumes.apply_map(small, m), "label")} == {0, 7, 8}
    assert volumes.to_array(small, "label").shape == (1, 4, 5)
    (tmp_path / "g.json").write_text(json.dumps({"edge_list": [{"node1": 5, "node2": 2, "weight": 0.5}]}))
    assert labels_of(volumes.read_graph(spark, f"file://{tmp_path}/g.json"), "node1", "node2", "weight") == [(2, 5, 0.5)]


def test_learning(spark, sf):
    from voxelgrain import catalog

    t = catalog.queries()["flat_training"](spark, sf).cache()
    assert {r.by_assignment for r in t.select("by_assignment").distinct().collect()} == {-1, 1}
    model = learning.fit(t, name="logistic")
    p = learning.separate_probability(t, model).collect()
    assert len(p) == t.count() and all(0 <= r.weight <= 1 for r in p)
    assert learning.sample_rows(t, 5).count() == 5 and learning.unique_rows(t.union(t), ["u", "v"]).count() == t.select("features").distinct().count()
    with pytest.raises(NotImplementedError):
        learning.classifier("perceptron")


def test_proofreading_stream(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    say = lambda n, *ms: (folder / f"{n}.json").write_text("\n".join(json.dumps(m) for m in ms))
    say(1, {"seq": 1, "type": "merge", "data": {"fragments": [1, 2, 3]}}, {"seq": 2, "type": "separate", "data": {"fragment": 4, "from": [1]}})
    say(2, {"seq": 3, "type": "merge", "data": {"fragments": [5, 6]}}, {"seq": 4, "type": "separate", "data": {"fragment": 3, "from": [1]}}, {"seq": 5, "type": "request", "data": {"what": "fragment-segment-lut"}})
    nodes = spark.range(1, 8).withColumnRenamed("id", "node")
    q = proofread.start(proofread.messages(spark, str(folder), 1), nodes, str(tmp_path / "out"), every=1)
    q.processAllAvailable()
    q.stop()
    got = dict(labels_of(spark.read.parquet(str(tmp_path / "out/segments")), "node", "segment"))
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 5, 7: 7}


def test_plans(spark, small):
    with pytest.raises(ValueError):
        segmentation.Options((0.5, 0.1))
    out = segmentation.segment(small, segmentation.Options((1.0, 1000.0)))
    assert {(t, s) for t, s in labels_of(out, "threshold", "segment")} == {(1.0, 1), (1.0, 2), (1.0, 3), (1.0, 4), (1000.0, 1)}
    v = small.withColumn("block", F.expr("x div 2")).withColumn("label", F.expr("label + block * 10"))
    got = dict(labels_of(segmentation.stitch(v, "x"), "label", "stitched"))
    assert got[11] == 1 and got[22] == 12


def test_countdown_over_ranges(spark):
    hits = [i % 7 == 3 or i % 11 == 0 for i in range(3000)]
    rows = spark.createDataFrame(list(enumerate(hits)), "idx long, hit boolean").repartition(5, "hit")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = agglomeration.countdown(rows, "idx", "hit", 3)
        assert out.columns == ["idx", "hit", "left"]
        assert labels_of(out, "idx", "left") == list(enumerate((3 - np.cumsum(hits)).tolist()))
        assert max(r["count"] for r in out.groupBy(F.spark_partition_id()).count().collect()) < 3000
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_adjacent_blocks_of_all_sizes(spark):
    rng = np.random.default_rng(4)
    lo, size = rng.integers(-12, 12, (300, 3)), rng.integers(1, 6, (300, 3))
    rows = [(i, a.tolist(), (a + s - 1).tolist()) for i, (a, s) in enumerate(zip(lo, size, strict=True))]
    want = []
    for i, al, ah in rows:
        for j, bl, bh in rows:
            for axis in range(3):
                if ah[axis] + 1 == bl[axis] and all(ah[k] >= bl[k] and bh[k] >= al[k] for k in range(3) if k != axis):
                    want.append((i, j, axis))
    blocks = spark.createDataFrame(rows, "block long, lo array<int>, hi array<int>")
    assert labels_of(segmentation.adjacent_blocks(blocks), "a", "b", "axis") == sorted(want)
    assert segmentation.adjacent_blocks(blocks.limit(0)).count() == 0


def test_whole_tables(spark, sf):
    """These queries leave no row of their tables out."""
    ev = spark.read.parquet(f"{sf}/events.parquet").select("event_id", "user_id", "value").toPandas().sort_values("event_id")
    id_, region = ev.event_id.to_numpy(), (ev.user_id % 5).to_numpy()
    at = np.stack([id_ // 400, id_ % 400 // 20, id_ % 20], 1)
    near = ((at[:, None] - at[None]) ** 2).sum(2) <= 4
    want = near & (region[None] < region[:, None])
    assert labels_of(catalog.queries()["near_points"](spark, sf), "region", "id") == sorted((int(r), int(i)) for r, i, w in zip(region, id_, want.any(1), strict=True) if w)

    left = 3 - np.cumsum(np.round(ev.value.to_numpy() * 100) > 20000)
    assert labels_of(catalog.queries()["conditional_countdown"](spark, sf), "idx", "left") == list(zip(id_.tolist(), left.tolist(), strict=True))

    keys = {r[0] for r in spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey").collect()}
    place = {(k % 30, k // 30 % 30, k // 900): k for k in keys}
    want = [(k, place[q], axis) for p, k in place.items() for axis in range(3) if (q := tuple(c + (i == axis) for i, c in enumerate(p))) in place]
    assert len(want) > len(keys) and labels_of(catalog.queries()["adjacent_blocks"](spark, sf), "a", "b", "axis") == sorted(want)


def brute_moments(x, k=4):
    return [len(x), x.mean(), *[((x - x.mean()) ** i).mean() for i in range(2, k + 1)]]


def brute_percentiles(counts, wanted, lo, hi):
    if not counts.sum():
        return [lo] * len(wanted)
    step, upto = (hi - lo) / len(counts), np.cumsum(counts) / counts.sum()
    out = []
    for p in wanted:
        b = int(np.argmax(upto >= p))
        before = upto[b - 1] if b else 0.0
        out.append(lo + b * step + (step / 2 if upto[b] == before else step * (p - before) / (upto[b] - before)))
    return out


def test_edge_feature_lists(spark):
    from voxelgrain.operators import features

    rng = np.random.default_rng(2)
    label = np.repeat(np.repeat(np.array([[1, 2, 3], [4, 5, 5]]), 3, 0), 4, 1)
    label[0, :3] = 2
    p = rng.random(label.shape)
    p[label == 3] = 2.0  # beyond the histogram
    v = volumes.from_arrays(spark, label=label.astype(np.int64), p=p)
    wanted, bins = (0.1, 0.5, 0.9), 5
    rows = features.edge_features(v, rag.boundary_voxels(v, "exact", keep=("idx", "p")), "p", bins, 0.0, 1.0, wanted).collect()
    touching = {}
    for i in range(label.shape[0]):
        for j in range(label.shape[1]):
            for a, b in ((i + 1, j), (i - 1, j), (i, j + 1), (i, j - 1)):
                if 0 <= a < label.shape[0] and 0 <= b < label.shape[1] and label[a, b] != label[i, j]:
                    touching.setdefault((min(label[a, b], label[i, j]), max(label[a, b], label[i, j])), set()).add((i, j))
    near = {n: {b if a == n else a for a, b in touching if n in (a, b)} for n in range(1, 6)}

    def described(x):
        h = np.histogram(x, bins, (0, 1))[0]
        return [*brute_moments(x), *(h / max(1, h.sum())), *brute_percentiles(h, wanted, 0.0, 1.0)], np.array(brute_moments(x)), h / max(1, h.sum())

    def kl(a, b):
        some = a * b > 0
        return (a[some] * np.log(a[some] / b[some])).sum()

    assert {(r.u, r.v) for r in rows} == set(touching)
    for r in rows:
        first, second = sorted((r.u, r.v), key=lambda n: ((label == n).sum(), n))
        (fa, ma, ha), (fb, mb, hb) = described(p[label == first]), described(p[label == second])
        own, _, _ = described(np.array([p[q] for q in touching[r.u, r.v]] * 1))
        graph = lambda n: np.array([len(near[n]), np.mean([len(near[k]) for k in near[n]])])
        m = (ha + hb) / 2
        want = [*fa, *graph(first), *fb, *graph(second), *own, len(near[r.u] & near[r.v]), *abs(ma - mb), (kl(ha, m) + kl(hb, m)) / 2, *(graph(first) - graph(second))]
        assert len(r.features) == len(want)
        assert np.allclose(r.features, want, atol=1e-9), (r.u, r.v)


def test_percentiles_of_odd_histograms(spark):
    from voxelgrain.operators import features

    hs = [[0, 0, 0], [5, 0, 0], [0, 0, 2], [1, 0, 1], [1, 1, 1]]
    got = spark.createDataFrame([(i, h) for i, h in enumerate(hs)], "i int, h array<bigint>").select("i", features.percentiles(F.col("h"), (0.0, 0.25, 0.5, 1.0), 1.0, 4.0, 3).alias("p")).collect()
    for r in got:
        assert r.p == pytest.approx(brute_percentiles(np.array(hs[r.i]), (0.0, 0.25, 0.5, 1.0), 1.0, 4.0))


def test_cuts_at_many_thresholds(spark):
    e = spark.createDataFrame([(1, 2, 0.1), (2, 3, 0.4), (4, 5, 0.2), (3, 4, 0.9)], "u long, v long, weight double")
    n = spark.createDataFrame([(i,) for i in range(0, 7)], "node long")
    got = labels_of(agglomeration.threshold_cuts(e, n, [0.05, 0.3, 0.5, 1.0]), "threshold", "node", "segment")
    parts = {0.05: [0, 1, 2, 3, 4, 5, 6], 0.3: [0, 1, 1, 3, 4, 4, 6], 0.5: [0, 1, 1, 1, 4, 4, 6], 1.0: [0, 1, 1, 1, 1, 1, 6]}
    assert got == sorted((t, i, s) for t, ss in parts.items() for i, s in enumerate(ss))
    table = spark.createDataFrame([(1, 1, 4), (2, 1, 4), (3, 2, 4), (4, 2, 4)], "s long, g long, n long")
    cuts = agglomeration.threshold_cuts(e, n, [0.05, 0.3, 0.5])
    vi = {r.threshold: (r.under, r.over) for r in contingency.vi_by_threshold(table, cuts).collect()}
    assert vi[0.05] == pytest.approx((0.0, 1.0)) and vi[0.3] == pytest.approx((0.0, 0.5)) and vi[0.5][0] > 0
    stats = contingency.vi_statistics(contingency.vi_by_threshold(table, cuts).withColumn("threshold", F.lit(0))).collect()[0]
    assert stats.mean_over == pytest.approx(np.mean([o for _, o in vi.values()])) and stats.median_over == pytest.approx(np.median([o for _, o in vi.values()]))


def test_merge_history_is_the_replay(spark):
    rng = np.random.default_rng(9)
    pairs = {tuple(sorted(p)) for p in rng.integers(1, 40, (110, 2)).tolist() if p[0] != p[1]}
    rows = [(u, v, int(rng.integers(1, 9)), float(rng.integers(1, 10**6))) for u, v in sorted(pairs)]
    e = spark.createDataFrame(rows, "u long, v long, n long, total double")
    nodes = spark.createDataFrame([(i,) for i in range(1, 41)], "node long")
    log = agglomeration.history(e, nodes)
    want = agglomeration.replay(rows, float("inf"), first_id=1000)
    assert [r.weight for r in log.orderBy("weight").collect()] == pytest.approx([w for *_, w in want])

    def parts(merges):
        members = {i: {i} for i in range(1, 41)}
        for _, a, b, p, _ in merges:
            members[p] = members.pop(a) | members.pop(b)
        return sorted((n, min(ns)) for ns in members.values() for n in ns)

    for k in (0, 1, 7, len(want)):
        assert labels_of(agglomeration.cut_history(log, nodes, merges=k), "node", "segment") == parts(want[:k])
    t = want[len(want) // 2][4]
    assert labels_of(agglomeration.cut_history(log, nodes, threshold=t), "node", "segment") == parts([m for m in want if m[4] < t]) == labels_of(agglomeration.rounds(e, nodes, t), "node", "segment")
    assert agglomeration.history(e.limit(0), nodes).count() == 0


def test_ranks_over_ranges(spark):
    rng = np.random.default_rng(4)
    rows = [(int(a), int(b)) for a, b in zip(rng.permutation(500), rng.integers(0, 9, 500), strict=True)]
    df = spark.createDataFrame(rows, "a long, b long").repartition(5)
    got = labels_of(grid.ranked(df, ["a"], "rank", upto="b"), "a", "rank", "upto")
    rows.sort()
    assert got == [(a, i + 1, s) for i, ((a, _), s) in enumerate(zip(rows, np.cumsum([b for _, b in rows]).tolist(), strict=True))]
    assert grid.ranked(df.limit(0), ["a"], "rank").count() == 0
