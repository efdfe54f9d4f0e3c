"""A bucket of many likely but unlinked members gives a row for each member, not for each pair."""

import numpy as np

from voxelgrain.llm import minhash


def test_rows_grow_with_members_not_pairs(spark):
    r = np.random.default_rng(1)
    common = r.integers(1, 2**60, 300).astype(np.uint64)
    rows, sets = [], {}
    for node in range(120):
        own = r.integers(1, 2**60, 45).astype(np.uint64)
        mine = np.unique(np.concatenate([common, sets[node - 60] if node in (61, 62) else own]))
        sets[node] = own
        s = minhash.sketch(mine)
        sig = (s >> np.uint64(20)).astype(np.uint16).tobytes()
        rows.append((7, 0, node, len(mine), node, None, sig, mine.tobytes()))
    table = spark.createDataFrame(rows, "key long, band int, node long, n long, component long, distance double, sig binary, hashes binary")
    members, full = table.drop("hashes"), table.select("node", "hashes")
    some = minhash.likely(members, 4, 80, 60, 1024)
    assert 100 <= some.count() <= 120
    for block in (16, 1024):
        links = minhash.links_between(members, full, 4, 80, 60, block)
        assert sorted(map(tuple, links.collect())) == [(1, 61), (2, 62)]
