"""The text operators against brute force, on a small table and on one with every odd row that a table may hold."""

import hashlib
import os
import re
import zlib
from collections import defaultdict
from functools import cache

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from voxelgrain.llm import exactdedup, gif, langid, linededup, mixing, packing, queries, simhash, tokenbin, tokens, toxicity, urlfilter
from voxelgrain.llm.common import connected_components

LONG = " ".join(f"word{i % 977} und{i}" for i in range(30_000))
ODD = [
    (1, "A b c d e f", "en", "s1"), (2, "a  B c\td e f ", "en", "s1"), (3, None, None, None), (4, "", "de", "s2"), (5, " \n\t ", "fr", "s2"),
    (6, LONG, "en", None), (7, LONG, "en", "s1"), (None, "no id at all, but words enough to be one line of text.", "en", "s3"), (None, None, None, None),
    (8, "été 12\u3000x  y <|endoftext|> 'tis I'll\n\nfoo  bar", "fr", "é"), (8, "été 12\u3000x  y <|endoftext|> 'tis I'll\n\nfoo  bar", "fr", "é"), (8, "another text of the same id", "fr", "é"),
    (9, "no id at all, but words enough to be one line of text.", "en", "s3"), (-5, "𝔘nicode 😀 " * 50, "en", "Z"), (10, "1234 5678", "en", "Z"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def odd(spark):
    # Other columns with names that the operators use inside.
    extra = {c: F.lit("x") for c in ("fp", "n", "len", "head", "size", "unit", "copy", "start", "ids", "keep_id", "component", "score", "sid")}
    return spark.createDataFrame(ODD, SCHEMA).repartition(3).withColumns(extra)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r.doc_id: r.text for r in docs.collect()}


@cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def encode(path, text):
    return tokenizer(path).encode(text or "", add_special_tokens=False).ids


#: Words, signs and white space that meet at every kind of place where texts may or may not be cut.
PARTS = ["a", "Word", "I", "été", "É", "H\u0331", "e\u0301", "\u0301", "İ", "Σας", "ΣΑΣ", "中文", "ไทย", "𝔘", "😀", "1", "42", "²", "Ⅷ", "٣", "'", "'s", "'re", "'LL", ".", ",", "...", "!?", "_", "%", "’", "«", "\x00", "\x1c", "\x1e", "\x7f", "\u200b", "<|endoftext|>", "<|startoftext|>", "<|", "x" * 90]
BLANKS = ["", "", " ", " ", " ", "  ", "\n", "\n\n", "\t", "\r\n", " \n", "\n ", "\x0b", "\x0c", "\x85", "\u00a0", " \u00a0", "\u1680", "\u2003", "\u2028", "\u202f", "\u205f", "\u3000 "]


def odd_texts(n=1500):
    import random

    r = random.Random(11)
    return ["".join(r.choice(PARTS) + r.choice(BLANKS) for _ in range(r.randint(1, 14))) for _ in range(n)] + [b + p + c for p in PARTS for b in BLANKS[4:] for c in ("", " ", "\n", "a")]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_is_the_tokenizer(name, texts):
    import pyarrow as pa

    path = tokens.tokenizer_path(name)
    some = [*list(texts.values())[:60], *(t or "" for _, t, _, _ in ODD), "", None, "", *odd_texts()]
    e = tokens._ENCODERS[path] = tokens.Encoder(path, remember=100)
    assert e.mode == {"w": "drop", "b": "bytes"}[name[0]]
    want = [x.ids for x in tokenizer(path).encode_batch([t or "" for t in some], add_special_tokens=False)]
    for most in (200, 10**7):
        for end in (None, 2):
            got = [a.tolist() for _, ids, sizes in tokens.encode_column(path, pa.array(some, pa.string()).slice(0), end, most) for a in np.split(ids, np.cumsum(sizes)[:-1])]
            assert [g for g, w in zip(got, want, strict=True) if g != w + [end] * (end is not None)] == []
    part = [a.tolist() for _, ids, sizes in tokens.encode_column(path, pa.array(some, pa.large_string()).slice(7, 30)) for a in np.split(ids, np.cumsum(sizes)[:-1])]
    assert part == want[7:37]
    e.mode = "whole"
    e._forget()
    got = [a.tolist() for _, ids, sizes in tokens.encode_column(path, pa.array(some, pa.string())) for a in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == want
    del tokens._ENCODERS[path]


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_packing(request, which):
    df, path = request.getfixturevalue(which), tokens.tokenizer_path("word_bpe_49k.json")
    rows = packing.pack_power_of_two(df, path, longest=256).collect()
    assert len({r.sequence_id for r in rows}) == len(rows)
    got = defaultdict(list)
    for r in rows:
        assert r.length & (r.length - 1) == 0 and r.length <= 256 and len(r.ids) == 4 * r.length and r.offset == 0
        got[r.doc_id].append(r)
    want = defaultdict(list)
    for r in df.collect():
        want[r.doc_id].append(np.array([*encode(path, r.text), 2], "<u4").tobytes())
    assert set(got) == set(want)
    for k, v in got.items():
        if len(want[k]) == 1:
            v.sort(key=lambda r: r.start)
            assert [r.start for r in v] == [sum(x.length for x in v[:i]) for i in range(len(v))]
            assert b"".join(r.ids for r in v) == want[k][0] and {r.doc_tokens for r in v} == {len(want[k][0]) // 4}
        else:
            assert sum(r.length for r in v) == sum(len(x) // 4 for x in want[k])
    with pytest.raises(ValueError):
        packing.pack_power_of_two(df, path, longest=100)


def test_elias_fano():
    rng = np.random.default_rng(0)
    one_long = np.r_[np.arange(300), np.arange(300) + 10**6]
    for values in ([], [0], [0, 0, 0], [5], [2**40], one_long, np.r_[np.zeros(1000, int), np.arange(70) * 5000, 10**6], np.arange(5000), np.sort(rng.integers(0, 10**9, 1000)), np.cumsum(rng.integers(0, 3, 700))):
        e = tokenbin.EliasFano.of(np.array(values, np.uint64))
        data = e.to_bytes()
        e, at = tokenbin.EliasFano.read(memoryview(data), 0)
        assert at == len(data) and e.slice(0, len(values)).tolist() == list(values) and [e.get(i) for i in range(len(values))] == list(values)
        for i, j in rng.integers(0, len(values) + 1, (20, 2)).tolist():
            assert e.slice(i, j).tolist() == list(values[i:j])
    assert len(data) < 800
    with pytest.raises(ValueError):
        tokenbin.EliasFano.of(np.array([2, 1], np.uint64))


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_token_binary(request, which, tmp_path):
    df, path = request.getfixturevalue(which), tokens.tokenizer_path("byte_bpe_50k.json")
    rows = tokenbin.token_binary(df, path, f"file://{tmp_path}/out", shard_tokens=5000).collect()
    want = sorted([r.doc_id is not None, r.doc_id or 0, np.array([*encode(path, r.text), 2], "<u4").tobytes()] for r in df.collect())
    rows.sort(key=lambda r: r.start)
    assert [r.doc_id for r in rows] == [k if known else None for known, k, _ in want]
    assert [r.start for r in rows] == [sum(x.n_tokens for x in rows[:i]) for i in range(len(rows))]
    assert sorted((r.doc_id or 0, r.ids) for r in rows) == sorted((k, b) for _, k, b in want)
    for f in list((tmp_path / "out").glob("*.eft"))[:3]:
        s = tokenbin.read_shard(f.read_bytes())
        for i in range(s["docs"]):
            assert tokenbin.document_ids(s, i)[-1] == 2
    if rows:
        with pytest.raises(ValueError):
            tokenbin.token_binary(df, path, f"file://{tmp_path}/out")


def test_source_targets(spark):
    sizes = [("a", 100), ("b", 10), (None, 50), ("é", 0), ("B", 1000)]
    rows = {r.source: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "source string, source_size long")).collect()}
    names = sorted([s for s, _ in sizes if s is not None], key=lambda s: s.encode()) + [None]
    w = {s: (5.0, 2.0, 1.0)[i % 3] for i, s in enumerate(names)}
    size, target, free = dict(sizes), {}, set(names)
    left = 1.5 * sum(size.values())
    while True:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if level * w[s] > 2 * size[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * size[s]
            left -= target[s]
        free -= over
    target |= {s: level * w[s] for s in free}
    assert rows == pytest.approx(target)
    assert sum(rows.values()) == pytest.approx(1.5 * 1160)


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_mixing(request, which):
    df = request.getfixturevalue(which)
    out = mixing.mix_sources(df)
    rows = out.collect()
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix_sources(df.repartition(5)).collect()))
    assert len(rows) == df.count()
    size, taken, target, largest = defaultdict(int), defaultdict(int), {}, defaultdict(int)
    for r in df.collect():
        size[r.source] += len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    for r in rows:
        assert r.source_size == size[r.source] and 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
        largest[r.source] = max(largest[r.source], r.size)
    for s, t in target.items():
        assert abs(taken[s] - t) <= max(1, largest[s] / 2), (s, t, taken[s])


def test_mixing_comes_near(spark):
    rows = mixing.mix_sources(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect()
    assert all(abs(r.taken - r.target) <= 0.02 * r.target for r in rows)


def test_pivotal_rounding_keeps_means(spark):
    units = spark.range(4000).selectExpr("1L AS sid", "id AS unit", "1 AS copy", "10L AS size", "CASE WHEN id % 4 = 0 THEN 0.9D ELSE 0.3D END AS part")
    up = {r.unit: r.up for r in mixing.pivotal_rounding(units, arity=16).collect()}
    assert sum(up.values()) == round(4000 * (0.25 * 0.9 + 0.75 * 0.3))
    assert sum(v for k, v in up.items() if k % 4 == 0) / 1000 == pytest.approx(0.9, abs=0.05)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(nodes, linked):
    top = {n: n for n in nodes}

    def root(x):
        while top[x] != x:
            x = top[x]
        return x

    for a, b in linked:
        a, b = root(a), root(b)
        top[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_covering_masks_cover():
    import random

    masks = simhash.covering_masks(4)
    random.seed(3)
    for _ in range(3000):
        bits = sum(1 << b for b in random.sample(range(64), 4))
        assert any(not m & bits for m in masks)
    assert len(masks) == 31 and all(30 <= m.bit_count() <= 36 for m in masks)


@pytest.mark.parametrize("pairwise", [2048, 3])
@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_simhash(request, which, pairwise):
    df = request.getfixturevalue(which)
    rows = simhash.simhash_groups(df, pairwise=pairwise).collect()
    want = [(r.doc_id, brute_fingerprint(r.text)) for r in df.collect()]
    assert sorted((r.doc_id or -1, r.fp % 2**64) for r in rows) == sorted((i or -1, f) for i, f in want)
    known = [(i, f) for i, f in want if i is not None]
    links = [(i, j) for i, f in known for j, g in known if i < j and (f ^ g).bit_count() <= 4]
    comp = brute_components({i for i, _ in known}, links)
    if which == "docs":
        assert {r.doc_id: r.component_id for r in rows} == comp
    by_fp = defaultdict(set)
    for r in rows:
        by_fp[r.fp].add(r.component_id if r.doc_id is not None else None)
        assert r.doc_id is not None or r.component_id is None
    assert all(len(v - {None}) <= 1 for v in by_fp.values())


def test_near_links_of_crowded_buckets(spark):
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 40, dtype=np.int64)
    fps = {int(b) ^ sum(1 << int(k) for k in rng.choice(63, int(rng.integers(0, 7)), False)) for b in base for _ in range(25)}
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    for pairwise in (4, 4096):
        links = simhash.near_links(df, 4, pairwise)
        got = {r.node: r.component for r in connected_components(links).collect()}
        assert {f: got.get(f, f) for f in fps} == want


def brute_judge(url):
    rules = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]
    rest = (url or "").partition("://")[2] if "://" in (url or "") else ""
    host = re.sub("[A-Z]", lambda m: m[0].lower(), re.match(r"[^/?#]*", rest)[0])
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    fit = [(len(r), v, r) for v, r in rules if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith(r[r.index("/") :])]
    return (host, path, max(fit)[2], max(fit)[1]) if fit else (host, path, None, "allow")


def test_urls(spark, sf):
    odd = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x?y", "x://evil.net/a.com/en/", "x://a.net/es/", "x://net/fr/\nq", "x://com", "x://com?/", "x://xcom/", "x://www.example.com/en/#://b.net/es/", "\nhttp://b.com/é", "x://a.b.example.com/en/", "a://b://c.com/"]
    pages = spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")
    df = pages.unionByName(spark.createDataFrame([(10_000 + i, u) for i, u in enumerate(odd)] + [(None, "x://a.com/")], "page_id long, url string"))
    from voxelgrain.llm.queries import RULES

    urls = {r.page_id: r.url for r in df.collect()}
    rows = urlfilter.judge_urls(df.withColumn("host", F.lit(1)), RULES).collect()
    assert len(rows) == len(urls)
    for r in rows:
        assert (r.host, r.path, r.rule, r.verdict) == brute_judge(urls[r.page_id]), urls[r.page_id]
    assert urlfilter.judge_urls(df.limit(0), RULES).count() == 0


def test_globs():
    def regex(g):
        return re.compile("".join({"**": "(?s:.*)", "*": "[^/]*", "?": "[^/]"}.get(p, re.escape(p)) for p in re.findall(r"\*\*|.", g, re.S)) + r"\Z")

    globs = ["a*c", "**", "*", "?b?", "*.com/**", "x" * 70 + "*y", "**/en/*", ""]
    some = ["", "a", "abc", "a/c", "ac", "xbz", "w.com/", "w/.com/", "x" * 70 + "qqy", "x" * 71, "q/en/", "q/en/a/b", "abcabc"]
    fits = urlfilter.GlobAutomaton(globs).match([s.encode() for s in some])
    assert [[bool(regex(g).match(s)) for g in globs] for s in some] == fits.tolist()


@pytest.mark.parametrize("n", [0, 1, 2, 300, 4000, 9000, 60_000])
def test_lzw(n):
    rng = np.random.default_rng(n)
    for data in (rng.integers(0, 256, n, np.uint8).tobytes(), bytes(n), rng.choice(np.frombuffer(b"ab c", np.uint8), n).tobytes()):
        assert gif.lzw_decode(gif.lzw_encode(data), 8, max(1, n)) == data


def picture(left, top, rows, palette, disposal=0, delay=3, clear=None, interlace=False):
    h, w = len(rows), len(rows[0])
    order = [*range(0, h, 8), *range(4, h, 8), *range(2, h, 4), *range(1, h, 2)] if interlace else range(h)
    bits = max(1, (len(palette) - 1).bit_length())
    body = gif.lzw_encode(bytes(x for i in order for x in rows[i]), max(2, bits))
    table = bytes(x for c in palette for x in c).ljust(3 << bits, b"\0")
    control = b"\x21\xf9\x04" + bytes([disposal << 2 | (clear is not None), delay, 0, clear or 0]) + b"\0"
    return control + b"\x2c" + b"".join(x.to_bytes(2, "little") for x in (left, top, w, h)) + bytes([0x80 | 0x40 * interlace | bits - 1]) + table + bytes([max(2, bits)]) + gif._blocks(body)


def test_gif_frames():
    red, blue, green, black = (255, 0, 0), (0, 0, 255), (0, 255, 0), (0, 0, 0)
    head = b"GIF89a" + (3).to_bytes(2, "little") + (2).to_bytes(2, "little") + b"\0\0\0"
    data = head + picture(0, 0, [[0, 0, 0], [0, 0, 0]], [red, blue], 1) + picture(1, 0, [[1, 0]], [red, blue], 3, clear=0) + picture(0, 1, [[0, 1]], [green, blue], 2) + b"\x21\xfe\x01x\0" + picture(2, 1, [[1]], [red, blue], clear=0) + b"\x3b"
    shown = [[tuple(p) for p in np.frombuffer(f["pixels"], np.uint8).reshape(-1, 3)] for f in gif.decode_gif(data)]
    assert shown == [[red] * 6, [red, blue, red, red, red, red], [red, red, red, green, blue, red], [red, red, red, black, black, blue]]
    f = gif.decode_gif(data)
    assert f[0]["delay_ms"] == 30 and f[1]["histogram"][3] == 1 and sum(f[1]["histogram"]) == 1 and sum(f[0]["histogram"]) == 6
    rows = [[i] for i in range(11)]
    one = gif.decode_gif(b"GIF87a" + (1).to_bytes(2, "little") + (11).to_bytes(2, "little") + b"\0\0\0" + picture(0, 0, rows, [(i, i, i) for i in range(16)], interlace=True) + b"\x3b")
    assert one[0]["mode"] == "L" and list(one[0]["pixels"]) == list(range(11))
    with pytest.raises(ValueError):
        gif.decode_gif(b"PNG...")


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_media(request, which):
    df = request.getfixturevalue(which)
    rows = gif.text_media(df).collect()
    want = sorted((r.text or "").encode() for r in df.collect())
    assert sorted(bytes(r.payload)[: r.n_bytes] for r in rows) == want
    for r in rows:
        assert len(r.payload) % 576 == 0 and len(r.payload) >= max(1, r.n_bytes) and set(bytes(r.payload)[r.n_bytes :]) <= {255}
        assert sum(sum(f.histogram) for f in r.frames) == len(r.payload) and bytes(r.media).startswith(b"GIF89a")
    assert {len(r.frames) for r in rows if r.n_bytes > 128 * 576} in ([set()], set()) or all(len(r.frames) == -(-len(r.payload) // (128 * 576)) for r in rows)


def toxic_figures(docs, labels):
    """(accuracy, area under the curve, model) on the held-out fifth."""
    model = toxicity.train(docs, labels)
    labelled = docs.join(labels, "doc_id", "left_semi")
    rows = toxicity.score_toxicity(labelled, model).join(labels, "doc_id").select("held_out", "score", "predicted", "toxic", "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    held = [r for r in rows if r.held_out]
    score = {y: np.array([r.score for r in held if r.toxic == y]) for y in (0, 1)}
    print(np.mean([r.predicted == r.toxic for r in held]), np.mean(score[1] >= 0.5), np.mean(score[0] >= 0.5), np.mean(score[1][:, None] > score[0][None, :]))
    return np.mean([r.predicted == r.toxic for r in held]), np.mean(score[1][:, None] > score[0][None, :]), model


def test_toxicity_with_many_labels(spark):
    path = "/root/testdata/check_s"
    if not os.path.isdir(path):
        pytest.skip("no such table")
    accuracy, area, _ = toxic_figures(*(spark.read.parquet(f"{path}/{t}.parquet") for t in ("documents", "labels")))
    assert accuracy > 0.95 and area > 0.95


def test_toxicity(spark, odd, none):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    # Of 352 toxic texts the dictionaries learn less than of thousands.
    accuracy, area, model = toxic_figures(docs, labels)
    assert accuracy > 0.93 and area > 0.9
    assert toxicity.score_toxicity(odd, model).count() == len(ODD) and toxicity.score_toxicity(none, model).count() == 0
    empty = toxicity.train(none, labels.limit(0))
    assert {r.predicted for r in toxicity.score_toxicity(odd, empty).collect()} <= {0, 1}
    for t in (LONG, "", None, "a", "x" * 1000):
        words = [w[:5].upper() + w for w in (t or "").lower().split()]
        assert b" ".join(toxicity.windows(t, 32)).replace(b" ", b"") == "".join(words).encode()


HEAD = "the same two hundred and fifty-six characters " * 6
#: Rows that share ids, lengths and the first characters, but not texts.
ALIKE = [
    (1, HEAD + "x", "en", "s1"), (1, HEAD + "y", "en", "s1"), (1, HEAD + "x", "en", "s2"), (None, HEAD + "x", "en", "s1"), (None, HEAD + "y", "en", "s1"), (None, HEAD + "z", "en", "s1"),
    (None, HEAD + "w", "en", None), (None, HEAD + "w", "en", "s1"), (2, HEAD + "v", "en", "s1"), (3, HEAD + "v", "en", "s1"), (4, "", "en", "s1"), (5, None, "en", "s1"), (5, None, "en", "s1"), (2, "short", None, None),
]


@pytest.fixture(scope="module")
def alike(spark):
    extra = {c: F.lit(i) for i, c in enumerate(("len", "_len", "head", "_head", "full", "keep_id", "ties", "group_size", "_i", "_l", "_h", "again", "n", "id"))}
    return spark.createDataFrame(ALIKE, SCHEMA).repartition(4).withColumns(extra)


def squeeze(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


@pytest.mark.parametrize("which", ["docs", "odd", "none", "alike"])
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_exact(request, which, broadcast_rows):
    df = request.getfixturevalue(which)
    groups = defaultdict(list)
    for r in df.collect():
        groups[squeeze(r.text)].append(r.doc_id)
    want = []
    for text, ids in groups.items():
        first = min((i for i in ids if i is not None), default=None)
        want += [(i, first, len(ids), i == first, hashlib.sha256(text.encode()).hexdigest()) for i in ids]
    for hash_all in (True, False):
        rows = exactdedup.exact_groups(df, 8, broadcast_rows, hash_all).collect()
        got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.full and r.full.hex()) for r in rows]
        if hash_all:
            assert sorted(map(str, want)) == sorted(map(str, got))
        else:
            assert sorted(str(w[:4]) for w in want) == sorted(str(g[:4]) for g in got)
            assert {g[4] for g in got} - {None} <= {w[4] for w in want} and all(g[4] for g in got if g[2] > 1)


@pytest.mark.parametrize("which", ["docs", "odd", "none", "alike"])
@pytest.mark.parametrize("broadcast_rows", [200_000, 0])
def test_drop_copies(request, which, broadcast_rows):
    df = request.getfixturevalue(which)
    rows = df.collect()
    out = exactdedup.drop_copies(df, 8, broadcast_rows)
    got = out.collect()
    assert out.columns == df.columns
    least = {}
    for r in rows:
        key = (r.doc_id is None, r.doc_id or 0)
        least[squeeze(r.text)] = min(least.get(squeeze(r.text), key), key)
    assert sorted((squeeze(r.text), (r.doc_id is None, r.doc_id or 0)) for r in got) == sorted(least.items())
    every = list(map(tuple, rows))
    assert all(tuple(r) in every for r in got)


def brute_phrases(text, source, stretch):
    """Longest matches of each stretch of text in source, from the left; a sign that source lacks is one phrase."""
    n = 0
    for i in range(0, len(text), stretch):
        part, at = text[i : i + stretch], 0
        while at < len(part):
            k = 1
            while at + k < len(part) and part[at : at + k + 1] in source:
                k += 1
            n, at = n + 1, at + k
    return n


@pytest.mark.parametrize("dense", [96, 1, 0])
def test_suffix_automaton(dense):
    rng = np.random.default_rng(1)
    signs = rng.integers(3, 6, 200).tolist()
    automaton = langid.SuffixAutomaton(signs, 8, dense)
    joined = "".join(map(str, signs))
    for _ in range(300):
        q, s = rng.integers(2, 7, 7).tolist(), np.zeros(1, np.int64)
        for c in q:
            s = automaton.step(s, np.array([c]))
            if not s[0]:
                break
        assert bool(s[0]) == ("".join(map(str, q)) in joined)


def test_cross_parser_counts_phrases():
    rng = np.random.default_rng(3)
    sources = {"a": ["abcabd"], "b": ["xyzxy"], "zh": ["".join(chr(0x4E00 + i) for i in rng.integers(0, 300, 900))], "é": ["éaé bé", "ça y"]}
    p = langid.CrossParser(sources, stretch=4)
    assert p.automata[2].keys.size  # more letters than columns
    odd = ["".join(rng.choice(list("abcdqxyz é,中𝔘") + [sources["zh"][0][5:9]], 9)) for _ in range(200)]
    for t in ("abcabd", "abdabc", "xyab", "aaaaaaaaa", "xyzxyab", "aqb", "qqqq", "", sources["zh"][0][100:160], *odd):
        plain = re.sub(r"[^\W\d_]", lambda m: m[0], re.sub(r"[\W\d_]+", " ", t))
        counts, sizes = p.phrases([t, "ab"])
        want = [brute_phrases(plain, "\n".join(re.sub(r"[\W\d_]+", " ", x) for x in sources[k]), 4) for k in p.languages]
        assert counts[0].tolist() == want and sizes[0] == len(plain), t
        got = p.predict([t])[0]
        lengths = [sum(len(x) + 1 for x in sources[k]) for k in p.languages]
        entropy = [n * np.log(m) for n, m in zip(want, lengths, strict=True)]
        order = sorted(entropy)
        letters = any(c.isalpha() for c in t)
        assert got[0] == (p.languages[entropy.index(order[0])] if letters else "und")
        assert got[1] == pytest.approx(1 - order[0] / order[1] if letters else 0.0)


def test_languages_of_short_texts_and_other_scripts(spark):
    rows = [(i, "".join(chr(c + (i * 7 + k * 5) % 20) for k in range(9)), name) for i, (name, c) in enumerate([("ja", 0x3042), ("zh", 0x4E10), ("got", 0x10330), ("ru", 0x430)] * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {r.doc_id: r.lang_pred for r in langid.identify_languages(docs, langid.train(docs)).collect()}
    assert got == {i: name for i, _, name in rows}


def test_language(docs, odd, none, spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    parser = langid.train(big)
    got = {r.doc_id: r for r in langid.identify_languages(big, parser).collect()}
    lang = {r.doc_id: r.lang for r in big.collect()}
    held = [r for r in got.values() if r.held_out]
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in held]) > 0.95
    rows = langid.identify_languages(odd, parser).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert {r.lang_pred for r in rows if r.doc_id in (3, 4, 5, 10)} == {"und"}
    assert langid.identify_languages(none, langid.train(none)).count() == 0
    assert {r.lang_pred for r in langid.identify_languages(odd, langid.train(none)).collect()} == {"und"}


@pytest.mark.parametrize("which", ["docs", "odd", "none"])
def test_lines(request, which):
    df = request.getfixturevalue(which)
    rows = linededup.repeated_units(df, min_words=4).collect()
    seen, want = {}, set()
    for r in sorted({(x.doc_id is None, x.doc_id or 0, x.h, x.text) for x in df.withColumn("h", F.xxhash64("text")).collect()}, key=lambda x: x[:3]):
        for start, end, words, digest in linededup.units(r[3] or "", 4):
            doc = None if r[0] else r[1]
            if digest in seen:
                want.add((doc, start, end, words, *seen[digest]))
            seen.setdefault(digest, (doc, start))
    assert {(r.doc_id, r.start, r.end, r.words, r.keep_doc_id, r.keep_start) for r in rows} == want
    if which == "docs":
        text = {r.doc_id: r.text for r in df.collect()}
        out = {r.doc_id: r.text for r in linededup.remove_spans(df, linededup.repeated_units(df)).collect()}
        assert len(out) == len(text)
        gone = sum(r.end - r.start for r in linededup.repeated_units(df).collect())
        assert sum(map(len, text.values())) - sum(map(len, out.values())) == gone > 0


def test_lines_of_repeated_and_missing_ids(spark):
    line, own = "One line of eight words or a few more", "An other text of the same id that no earlier document ho"
    rows = [(7, f"{line}.\n{own}"), (7, f"{own[:20]} and then something else that nobody says twice"), (8, f"{line}.\nAnd more"), (None, f"{line}.\nMore"), (None, f"{line}.\nEven more"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = linededup.repeated_units(df)
    out = sorted((r.doc_id or 0, r.text or "") for r in linededup.remove_spans(df, spans).collect())
    left = [(i or 0, t or "") for i, t in rows[:2]] + [(8, "\nAnd more"), (0, "\nMore"), (0, "\nEven more"), (0, "")]
    assert out == sorted(left) and {r.copies for r in spans.collect()} == {4}
    same = spark.createDataFrame([(None, line), (None, line), (3, line)], "doc_id long, text string")
    assert [(r.doc_id, r.keep_doc_id) for r in linededup.repeated_units(same).collect()] == [(None, 3)]


def test_passages_of_short_lines_and_of_scripts_without_spaces(spark):
    short = " ".join(f"Go to {i}. Then back!" for i in range(20))
    # No space between words or after a sentence.
    dense = "".join(chr(0x4E00 + (i * 37) % 5000) + ("。" if i % 10 == 9 else "") for i in range(200))
    rows = [(1, f"First of all. {short} An end."), (2, f"Well. So it is. Yes. {short} Another end of it."), (3, f"前の文。{dense}"), (4, f"別。の文。{dense}"), (5, "Go to 3. And stay there for a while."), (6, "Too short.")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = linededup.repeated_units(df)
    out = {r.doc_id: r.text for r in linededup.remove_spans(df, spans).collect()}
    assert all(out[k] == t for k, t in rows if k not in (2, 4))
    assert len(out[2].split()) <= 11 + 7 and out[2].startswith("Well. So it is. Yes.") and out[2].endswith("Another end of it.")
    assert len(out[4]) <= 5 + 20 and out[4].startswith("別。の文。")
    text = dict(rows)
    for r in spans.collect():
        assert text[r.doc_id][r.start : r.end] == text[r.keep_doc_id][r.keep_start : r.keep_start + r.end - r.start]


def test_components_of_long_paths_and_stars(spark):
    links = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, 7: 7, **{i: 7 for i in range(200, 260)}}


def test_every_query_runs_on_sf(spark, sf):
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 14))
