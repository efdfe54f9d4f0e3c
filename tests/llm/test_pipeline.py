"""The stages of the corpus pipeline, each against brute force, and the registered queries over a whole small table."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelgrain.llm import linededup, queries, tokens

from test_llm_operators import SCHEMA, brute_components, brute_fingerprint, encode, squeeze

INSULTS = "you are a worthless idiot and a pathetic loser"


def some_texts():
    rng = np.random.default_rng(7)
    words = ["".join(rng.choice(list("abdefgilmnorstu"), rng.integers(2, 9))) for _ in range(400)]
    base = [" ".join(rng.choice(words, rng.integers(20, 60))) for _ in range(60)]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(base)]
    rows += [(100 + i, base[i], "en", "s1") for i in range(10)] + [(120 + i, base[i].replace(" ", "\t\n "), "en", "s2") for i in range(5)]
    rows += [(140 + i, base[i] + " end", "en", "s0") for i in range(20, 30)] + [(160 + i, f"{t} {INSULTS}. {t}", "en", "s1") for i, t in enumerate(base[40:60])]
    rows += [(None, base[0], "en", "s0"), (None, None, None, None), (None, "a text of no id and no copy", "en", "s0"), (200, None, "en", "s1"), (201, "", None, None), (202, " \n", "en", "s2")]
    rows += [(203, base[1], "en", "s0"), (203, base[31] + " x", "en", "s0"), (203, "one more text of this id", "en", "s0"), (204, "word " * 40_000, "en", None), (5, base[5], "en", "s2")]
    return rows


@pytest.fixture(scope="module")
def corpus(spark):
    names = ("_len", "_head", "_i", "_l", "_h", "_size", "_s", "_z", "_copies", "_n", "_id", "_spans", "len", "head", "full", "fp", "own", "component", "gone", "rows", "rank", "words", "copies", "id", "source_", "size", "n", "i", "h", "y", "t", "score")
    return spark.createDataFrame(some_texts(), SCHEMA).repartition(4).withColumns({c: F.lit(k) for k, c in enumerate(names)})


@pytest.fixture(scope="module")
def labelled(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, 1, int(INSULTS in (t or ""))) for i, t, _, _ in some_texts() if i is not None]
    spark.createDataFrame(rows, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def whole(rows):
    return Counter(map(tuple, rows))


def test_toxicity_stage(spark, corpus, labelled):
    from voxelgrain.llm import toxicity
    from voxelgrain.llm.common import table

    out = corpus_pipeline.drop_toxic(spark, corpus, labelled)
    model = toxicity.train(corpus, table(spark, labelled, "labels"))
    assert out.columns == corpus.columns
    assert whole(out.collect()) == whole(r for r in corpus.collect() if model.score(r.text) < 0.5)
    assert corpus_pipeline.drop_toxic(spark, corpus.limit(0), labelled).count() == 0


def test_exact_stage(spark, corpus, labelled):
    rows, out = corpus.collect(), corpus_pipeline.drop_copies(spark, corpus, labelled)
    got = out.collect()
    assert out.columns == corpus.columns and not whole(got) - whole(rows)
    least = {}
    for r in rows:
        k = squeeze(r.text)
        least[k] = min(least.get(k, (True, 0)), (r.doc_id is None, r.doc_id or 0))
    assert sorted((squeeze(r.text), (r.doc_id is None, r.doc_id or 0)) for r in got) == sorted(least.items())


def test_near_stage(spark, corpus, labelled):
    rows, out = corpus.collect(), corpus_pipeline.drop_near_copies(spark, corpus, labelled)
    got = out.collect()
    assert out.columns == corpus.columns and not whole(got) - whole(rows)
    prints = {(r.doc_id, brute_fingerprint(r.text)) for r in rows if r.doc_id is not None}
    nodes = {f for _, f in prints}
    top = brute_components(nodes, [(a, b) for a in nodes for b in nodes if a < b and (a ^ b).bit_count() <= 4])
    first = {}
    for i, f in prints:
        first[top[f]] = min(i, first.get(top[f], i))
    kept = [(r.doc_id, top[brute_fingerprint(r.text)]) for r in got if r.doc_id is not None]
    assert sorted(kept) == sorted((i, c) for c, i in first.items())
    assert whole(r for r in got if r.doc_id is None) == whole(r for r in rows if r.doc_id is None)


def test_mixing_stage(spark, corpus, labelled):
    rows, out = corpus.collect(), corpus_pipeline.mix(spark, corpus, labelled)
    got = out.collect()
    assert out.columns == corpus.columns and set(whole(got)) <= set(whole(rows))
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert all(n <= 2 * whole(rows)[r] for r, n in whole(got).items())
    total, taken, largest, mid = defaultdict(int), defaultdict(int), defaultdict(int), defaultdict(list)
    for r in rows:
        total[r.source] += size(r.text)
        largest[r.source] = max(largest[r.source], size(r.text))
        mid[r.source].append(size(r.text))
    for r in got:
        taken[r.source] += size(r.text)
    names = sorted((s for s in total if s is not None)) + [None]
    weight, target, free, left = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}, {}, set(names), 1.5 * sum(total.values())
    while True:
        over = {s for s in free if left / sum(weight[x] for x in free) * weight[s] > 2 * total[s]}
        if not over:
            break
        target |= {s: 2 * total[s] for s in over}
        left, free = left - sum(target[s] for s in over), free - over
    target |= {s: left / sum(weight[x] for x in free) * weight[s] for s in free}
    for s, t in target.items():
        # A source comes as near as half its middle text, one of few texts as its largest allows.
        assert abs(taken[s] - t) <= (np.median(mid[s]) if len(mid[s]) > 10 else largest[s] / 2 + 1), (s, t, taken[s])
    assert sorted(map(str, corpus_pipeline.mix(spark, corpus.repartition(7), labelled).collect())) == sorted(map(str, got))


def test_stages_of_an_empty_table(spark, corpus, labelled):
    none = corpus.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, labelled).count() == 0, name


def test_whole_pipeline(spark, corpus, labelled):
    path = labelled
    corpus.select("doc_id", "text", "lang", "source").write.mode("overwrite").parquet(f"{path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "exact_dedup", "near_dedup", "mixing", "packing"]
    rows = corpus_pipeline.run(spark, path).collect()
    docs = spark.read.parquet(f"{path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, path).collect(), docs.schema)
    word = tokens.tokenizer_path("word_bpe_49k.json")
    want = Counter()
    for r in docs.collect():
        want[r.doc_id, np.array([*encode(word, r.text), 2], "<u4").tobytes()] += 1
    got = Counter()
    parts = defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 4096 and r.offset == 0 and len(r.ids) == 4 * r.length
        parts[r.doc_id, r.doc_tokens].append(r)
    for (doc_id, n), ps in parts.items():
        ids = b"".join(p.ids for p in sorted(ps, key=lambda p: (p.sequence_id & (1 << 56) - 1, p.start)))
        got[doc_id, n] += len(ids) // 4 // n
        assert len(ids) % (4 * n) == 0
    assert got == Counter({k: v for k, v in sum((Counter({(d, len(b) // 4): m}) for (d, b), m in want.items()), Counter()).items()})
    assert len({r.sequence_id for r in rows}) == len(rows)


def brute_units(text, least):
    """Lines and sentences, cut sign by sign: (start, end, words, text in lower case) of each that has a letter or digit."""
    cuts, i = [], 0
    while i < len(text):
        j = i + 1
        if text[i] in ".!?":
            while j < len(text) and text[j] in "\"')]»”":
                j += 1
            if j < len(text) and text[j].isspace():
                cuts.append(j)
        elif text[i] == "\n":
            cuts.append(j)
        i = j if text[i] in ".!?" and cuts and cuts[-1] == j else i + 1
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(text)], strict=True):
        part = text[a:b]
        plain = " ".join("".join(c if c.isalnum() else " " for c in part.lower()).split())
        if plain:
            start = a + len(part) - len(part.lstrip())
            out.append((start, start + len(part.strip()), len(part.split()), plain))
    return [u for u in out if u[2] >= least]


def test_line_units_by_an_own_cutter(spark, sf):
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()] + ['He said: "Go." Then... left?! (Yes.) so 3.5 end', "a.b c!\n\n d", " .. ", "\n"]
    for t in texts:
        got = [(a, b, n) for a, b, n, _ in linededup.units(t, 1)]
        assert got == [(a, b, n) for a, b, n, _ in brute_units(t, 1)]
        whole_units = {(a, b): d for a, b, n, d in linededup.units(t, 8) if n >= 8}
        for a, b, n, plain in brute_units(t, 8):
            assert whole_units[a, b] == hashlib.blake2b(plain.encode(), digest_size=16).digest()


@pytest.fixture(scope="module")
def results(spark, sf):
    return {name: query(spark, sf).collect() for name, query in queries().items()}


def test_registered_queries(spark, sf, results):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    word, byte = tokens.tokenizer_path("word_bpe_49k.json"), tokens.tokenizer_path("byte_bpe_50k.json")
    pieces = defaultdict(list)
    for r in results["op1_packing"]:
        pieces[r.doc_id].append(r)
    assert set(pieces) == set(docs)
    for i, ps in pieces.items():
        ids = [*encode(word, docs[i]), 2]
        assert sum(p.length for p in ps) == len(ids) and {p.doc_tokens for p in ps} == {len(ids)}
        assert all(p.ids_crc32 == crc(ids[p.start : p.start + p.length]) for p in ps)
    start, by_id = 0, {r.doc_id: r for r in results["op2_token_binary"]}
    for i in sorted(docs):
        ids = [*encode(byte, docs[i]), 2]
        r = by_id[i]
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), crc(ids))
        start += len(ids)
    prints = {i: brute_fingerprint(t) for i, t in docs.items()}
    top = brute_components(set(docs), [(i, j) for i in docs for j in docs if i < j and (prints[i] ^ prints[j]).bit_count() <= 4])
    assert {(r.doc_id, r.fingerprint, r.component_id) for r in results["op4_simhash"]} == {(i, f"{prints[i]:016x}", top[i]) for i in docs}
    for r in results["op6_media"]:
        data = docs[r.doc_id].encode()
        full = data + b"\xff" * (-len(data) % 576 if data else 576)
        counts = np.bincount(np.frombuffer(full, np.uint8) >> 4, minlength=16)
        frames = -(-len(full) // (128 * 576))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-32:]))
        assert r.feature == f"{frames}:{40 * frames}:{','.join(map(str, counts))}" and r.media_bytes > 0 and len(r.media_sha256) == 64
    for name, key in (("op3_mixing", "doc_id"), ("op5_url_filter", "page_id"), ("op7_toxicity", "doc_id"), ("op8_exact_dedup", "doc_id"), ("op9_language", "doc_id")):
        ids = [r[key] for r in results[name]]
        assert len(ids) == len(set(ids)) and (key == "page_id" or set(ids) == set(docs)), name
    for r in results["op8_exact_dedup"]:
        same = [i for i, t in docs.items() if squeeze(t) == squeeze(docs[r.doc_id])]
        assert (r.keep_id, r.group_size, r.kept) == (min(same), len(same), r.doc_id == min(same))
    for r in results["op10_line_dedup"]:
        a, b = docs[r.doc_id][r.start : r.end], docs[r.keep_doc_id][r.keep_start :]
        a, b = (" ".join("".join(c if c.isalnum() else " " for c in t.lower()).split()) for t in (a, b))
        assert (r.keep_doc_id, r.keep_start) < (r.doc_id, r.start) and b.startswith(a)
