"""Hard negatives, collocations and MinHash groups against brute force."""

import itertools
import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from voxelgrain.llm import collocations, hardneg, minhash, oracle_sql, queries

EXTRA = ("n", "lang_", "k", "node", "key", "component", "score", "v", "dx", "a", "g", "chunk", "part", "id", "left", "rank")


def clashing(df):
    return df.withColumns({c: F.lit("x") for c in EXTRA})


def rows_of(df, *columns):
    return sorted(tuple(r[c] for c in columns) for r in df.collect())


# MinHash


def word_set(text, words):
    parts = (text or "").encode().lower().split()
    return frozenset(tuple(parts[i : i + words]) for i in range(len(parts) - words + 1)) if len(parts) > words else frozenset([tuple(parts)] if parts else [])


def brute_groups(rows, words, percent=80):
    """{(doc_id, text): (n, component)}"""
    sets = [(i, t, word_set(t, words)) for i, t in rows if i is not None]
    top = list(range(len(sets)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for (x, (_, _, p)), (y, (_, _, q)) in itertools.combinations(enumerate(sets), 2):
        if p and q and 100 * len(p & q) >= percent * len(p | q):
            top[root(x)] = root(y)
    least = {}
    for x, (i, _, _) in enumerate(sets):
        least[root(x)] = min(i, least.get(root(x), i))
    return sorted((i, len(s), least[root(x)]) for x, (i, _, s) in enumerate(sets))


def test_minhash_on_a_table(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    got = rows_of(queries()["op13_minhash"](spark, sf), "doc_id", "n_shingles", "component_id")
    assert got == brute_groups([(r.doc_id, r.text) for r in docs.collect()], 2)


def test_minhash_odd_rows(spark):
    long = " ".join(f"w{i % 5003}" for i in range(60_000))
    rows = [(1, "A b c d e f"), (2, "a  B c\td e f "), (3, None), (4, ""), (5, " \n"), (6, long), (7, long + " end"), (None, "a b c d e f"), (None, None), (8, "x"), (9, "X"), (8, "other text of one id"), (8, "x"), (10, "a b"), (-3, "a b")]
    out = minhash.minhash_groups(clashing(spark.createDataFrame(rows, "doc_id long, text string")), words=2)
    assert rows_of(out.where("doc_id is not null"), "doc_id", "n_shingles", "component_id") == brute_groups(rows, 2)
    assert [(r.component_id, r.kept) for r in out.where("doc_id is null").collect()] == [(None, True)] * 2
    assert all(r.kept == (r.doc_id == r.component_id) for r in out.where("doc_id is not null").collect())
    assert minhash.minhash_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_minhash_large_buckets(spark):
    """One base with many near copies, and chains of texts that leave it step by step: few bands, so that all share buckets."""
    rng = random.Random(3)
    base = [f"b{i}" for i in range(60)]
    rows = []
    for i in range(120):
        words = list(base)
        for _ in range(rng.choice([0, 1, 2, 6, 12, 14])):
            words[rng.randrange(60)] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = minhash.minhash_groups(df, words=1, size=64, rows=1, block=7)
    assert rows_of(out, "doc_id", "n_shingles", "component_id") == brute_groups(rows, 1)


def test_sketch_estimates_similarity():
    rng = np.random.default_rng(5)
    for common, own in ((80, 20), (900, 100), (4, 1), (1, 0)):
        hits = []
        for _ in range(30):
            x = rng.integers(0, 2**63, common + 2 * own, dtype=np.uint64)
            a, b = minhash.sketch(x[: common + own]), minhash.sketch(np.r_[x[:common], x[common + own :]])
            assert a.max() < 2**64 - 1
            hits.append((a == b).mean())
        assert abs(np.mean(hits) - common / (common + 2 * own)) < 0.05


# Collocations


def brute_collocations(rows, least=100, longest=5, top=2000):
    counts, total = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + m])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        inner = {}
        for p, a in found.items():
            for i, j in itertools.combinations(range(len(p) + 1), 2):
                if 1 < j - i < len(p):
                    inner[p[i:j]] = max(a, inner.get(p[i:j], 0))
        each = []
        for p, a in found.items():
            if 100 * inner.get(p, 0) < 100 * a:
                score, _, l, r = min((1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
                each.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, total[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(each)[:top])]
    return sorted(out)


COLUMNS = ("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def test_collocations_odd_rows(spark):
    rng = random.Random(1)
    words = ["Aa", "bb", "cc", "été", "dd", "aa aa", "x\ty", "e.e", "f,", "\U0001f600"]
    rows = [(rng.choice(["en", "fr", None, "und", ""]), " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 5, 300])))) for _ in range(150)]
    rows += [("en", None), (None, None), ("en", ""), ("de", " .. \n\r\x0b, "), ("de", "aa " * 3000), ("en", rows[7][1]), ("en", rows[7][1])]
    df = clashing(spark.createDataFrame(rows, "lang string, text string").repartition(5))
    for least, longest, top in ((3, 5, 2000), (20, 4, 7), (10_000, 3, 10)):
        got = rows_of(collocations.collocations(df, least, longest, top=top, chunk=900, part=50), *COLUMNS)
        assert got == brute_collocations(rows, least, longest, top)
    none = spark.createDataFrame([], "lang string, text string")
    assert collocations.collocations(none).collect() == []


def test_collocations_share(spark):
    rows = [("en", "a b c. " * 9 + "a b. b c d")]
    df = spark.createDataFrame(rows, "lang string, text string")
    assert {r.phrase for r in collocations.collocations(df, 2, share=95).collect()} == {"a b c", "a b", "b c"}
    assert {r.phrase for r in collocations.collocations(df, 2, share=90).collect()} == {"a b c"}


def test_collocations_score_past_64_bits(spark):
    """Products such as 1000 a n pass 2^63 where counts do not."""
    df = spark.createDataFrame([(10**12, 10**13, 10**12, 10**12)], "a long, n long, l long, r long")
    whole = {c.upper() + "_": F.col(c).cast("decimal(19,0)") for c in ("a", "n", "l", "r")}
    assert df.withColumns(whole).select(F.expr("CAST(1000 AS DECIMAL(4,0)) * A_ * N_ div (L_ * R_)").alias("s")).first().s == 1000 * 10**25 // 10**24


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_collocations"])
def test_against_sql(spark, name):
    sf = "/root/testdata/sf0.01"
    got = queries()[name](spark, sf)
    c = duckdb.connect()
    for t in ("documents", "embeddings"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    r = c.execute(oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert rows_of(got, *names) == sorted(r.fetchall())


# Hard negatives


def brute_negatives(rows, is_anchor, positives=5, negatives=3):
    good = {(i, l, tuple(v)) for i, l, v in rows if None not in (i, l, v) and all(x is not None and math.isfinite(x) for x in v)}
    good = sorted((i, l, tuple(math.floor(256 * x) for x in v)) for i, l, v in good)
    dot = lambda p, q: sum(x * y for x, y in zip(p, q))
    out = []
    for anchor in good:
        if not is_anchor(anchor[0]):
            continue
        scored = sorted((-dot(anchor[2], r[2]), r[0], r[1]) for r in good if r is not anchor)
        for s, p, _ in [x for x in scored if x[2] == anchor[1]][:positives]:
            fits = [x for x in scored if x[2] != anchor[1] and 50 * -s <= 100 * -x[0] <= 95 * -s][:negatives]
            out += [(anchor[0], p, k + 1, x[1], -s, -x[0]) for k, x in enumerate(fits)]
    return sorted(out)


NEGATIVES = ("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


@pytest.mark.parametrize("spread", [0.05, 1.0])
def test_hard_negatives(spark, spread):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(4, 6))
    rows = [(i, int(rng.integers(0, 3)), (centres[i % 4] + spread * rng.normal(size=6)).tolist()) for i in range(300)]
    # Ties, equal vectors under many ids, negative and zero vectors, rows that take no part, repeated rows.
    rows += [(i, i % 3, rows[5][2]) for i in range(300, 360)] + [(360, 0, [0.0] * 6), (370, 1, [-x for x in rows[5][2]])]
    rows += [(400, None, [1.0]), (410, 1, None), (None, 1, [1.0] * 6), (420, 1, [1.0, None]), (430, 1, [float("nan")] * 6), (440, 1, [float("inf")] * 6), (450, 2, []), (460, 2, [0.5, -0.25])]
    rows += [rows[10], rows[10], rows[299]]
    df = clashing(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, label int, embedding array<double>, lengths int").repartition(4))
    want = brute_negatives(rows, lambda i: i % 10 == 0)
    assert len(want) > 200
    for sizes in ({}, {"row_block": 50, "anchor_block": 8, "pivots": 3, "sample": 20}):
        assert rows_of(hardneg.hard_negatives(df, F.col("vec_id") % 10 == 0, **sizes), *NEGATIVES) == want


def test_hard_negatives_same_id_and_empty(spark):
    schema = "vec_id long, label int, embedding array<float>"
    rows = [(0, 1, [1.0, 0.5]), (0, 1, [0.5, 1.0]), (0, 2, [0.75, 0.5]), (1, 2, [0.75, 0.25]), (2, 2, [0.5, 0.5])]
    got = rows_of(hardneg.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") == 0), *NEGATIVES)
    assert got == brute_negatives(rows, lambda i: i == 0)
    assert hardneg.hard_negatives(spark.createDataFrame([], schema), F.col("vec_id") == 0).collect() == []
    assert hardneg.hard_negatives(spark.createDataFrame(rows, schema), F.col("vec_id") == 9).collect() == []
    with pytest.raises(ValueError):
        hardneg.hard_negatives(spark.createDataFrame([(0, 1, [1e30])], schema), F.col("vec_id") == 0)


def test_brackets_hold():
    rng = np.random.default_rng(4)
    x, q = rng.integers(-300, 300, (500, 8)).astype(float), rng.integers(-300, 300, (20, 8)).astype(float)
    index = hardneg.PivotTable(x[:100], math.sqrt((x * x).sum(1).max()), 5)
    dx, dq = index.of_rows(x), index.of_queries(q)
    for i in range(len(q)):
        below, above = index.brackets(float(np.sqrt(q[i] @ q[i])), dq[i], dx)
        assert (below <= x @ q[i]).all() and (x @ q[i] <= above).all()
