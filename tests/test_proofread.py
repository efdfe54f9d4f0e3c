"""The stream of corrections: what a restart keeps, and learning from corrections."""

import json

from pyspark.sql import functions as F

from voxelgrain.streaming import proofread


def merge(seq, *fragments):
    return {"seq": seq, "type": "merge", "data": {"fragments": fragments}}


def separate(seq, fragment, *others):
    return {"seq": seq, "type": "separate", "data": {"fragment": fragment, "from": others}}


def test_restart_neither_loses_nor_repeats_relearning(spark, tmp_path):
    folder, out = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    say = lambda n, *ms: (folder / f"{n}.json").write_text("\n".join(json.dumps(m) for m in ms))
    nodes = spark.range(1, 9).withColumnRenamed("id", "node")
    seen = []

    def relearn(rows):
        seen.append(sorted((r.u, r.v, r.label) for r in rows.collect()))
        return proofread.lookup(rows, nodes)

    def run():
        q = proofread.start(proofread.messages(spark, str(folder), 1), nodes, out, 3, relearn)
        q.processAllAvailable()
        q.stop()

    say(1, merge(1, 1, 2), merge(2, 3, 4))
    run()
    assert not seen  # two rows wait
    say(2, separate(3, 2, 1))
    run()
    assert seen == [[(1, 2, 1), (3, 4, 0)]]
    say(3, merge(4, 5, 6), merge(5, 1, 2))
    run()
    assert len(seen) == 1  # counted from the last relearning, not from the start
    say(4, {"seq": 6, "type": "request", "data": {}})
    run()
    assert len(seen) == 1
    say(5, merge(7, 7, 8))
    run()
    assert seen[1:] == [[(1, 2, 0), (3, 4, 0), (5, 6, 0), (7, 8, 0)]]
    got = {r.node: r.segment for r in spark.read.parquet(f"{out}/segments").collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7, 8: 7}


def test_learned_segments_follow_corrections(spark):
    """A row of fragments: low edges inside pairs, high ones between them; corrections on the first few teach the rest.

    Fragments 10 and 11 look like a pair to the model; only the correction keeps them apart."""
    n = 24
    edges = spark.range(n - 1).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(10).cast("long").alias("n"), F.expr("IF(id % 2 = 0, 100L, 900L)").alias("total"))
    nodes = spark.range(n).select(F.col("id").alias("node"), F.lit(50).cast("long").alias("size"), F.lit(5000).cast("long").alias("total"))
    words = [(1, 0, 1, 0), (2, 2, 3, 0), (3, 1, 2, 1), (4, 3, 4, 1), (5, 4, 5, 0), (6, 10, 11, 1), (7, 0, 20, 0)]
    rows = spark.createDataFrame([*words, (0, 4, 5, 1)], "seq long, u long, v long, label int")
    got = {r.node: r.segment for r in proofread.learned(edges, nodes)(rows).collect()}
    assert set(got) == set(range(n)) and got[10] != got[11] and got[0] == got[20] == got[21]
    assert all(got[i] == got[i + 1] for i in range(0, n, 2) if i != 10)
    assert len(set(got.values())) == 12  # 12 pairs, one cut in two, two joined
    few = proofread.learned(edges, nodes)(rows.where("label = 0")).collect()
    assert {r.node for r in few if r.segment == 0} == {0, 1, 20}
