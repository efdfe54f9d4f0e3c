"""The queries of the text operators and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, exactdedup, gif, hardneg, langid, linededup, minhash, mixing, packing, simhash, tokenbin, toxicity, urlfilter
from .common import table
from .tokens import tokenizer_path

RULES = [("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")]


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack_power_of_two(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", packing.ids_crc32(F.col("ids")).alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tokenbin.token_binary(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))
    return docs.select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.simhash_groups(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex16(F.col("fp")).alias("fingerprint"), "component_id")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op6_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = gif.text_media(table(spark, sf_dir, "documents"))
    return media.select(
        "doc_id",
        "n_bytes",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2("payload", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(payload, -32, 32)")).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"),
        F.sha2("media", 256).alias("media_sha256"),
        gif.histogram_feature().alias("feature"),
    )


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_toxicity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    groups = exactdedup.exact_groups(docs, hash_all=True)
    return groups.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("full")).alias("text_sha256"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify_languages(docs, langid.train(docs))


def op10_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.repeated_units(table(spark, sf_dir, "documents"))


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", label.alias("label"), "embedding")
    return hardneg.hard_negatives(vectors, F.col("vec_id") % 50 == 0)


def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


def op13_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.minhash_groups(table(spark, sf_dir, "documents"), words=2)


def queries() -> dict:
    ops = (op1_packing, op2_token_binary, op3_mixing, op4_simhash, op5_url_filter, op6_media, op7_toxicity, op8_exact_dedup, op9_language, op10_line_dedup, op11_hard_negatives, op12_collocations, op13_minhash)
    return {f.__name__: f for f in ops}


def oracle_sql() -> dict[str, str]:
    return {
        "op5_url_filter": r"""
WITH u AS (
  SELECT page_id,
         translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
  FROM pages),
r(rank, host_r, path_r, name, verdict_r) AS (VALUES
  (1, 'www.example.com', '/en/', 'www.example.com/en/', 'allow'),
  (2, 'example.com', '/en/', 'example.com/en/', 'block'),
  (3, 'net', '/es/', 'net/es/', 'block'),
  (4, 'net', '/fr/', 'net/fr/', 'block'),
  (5, 'com', '/', 'com/', 'allow')),
f AS (
  SELECT page_id, host, path, name, verdict_r, rank
  FROM u LEFT JOIN r ON (host = host_r OR ends_with(host, '.' || host_r)) AND starts_with(path, path_r))
SELECT page_id, host, path, arg_min(name, rank) AS rule, coalesce(arg_min(verdict_r, rank), 'allow') AS verdict
FROM f GROUP BY page_id, host, path
""",
        "op8_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents)
SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
""",
            "op11_hard_negatives": r"""
WITH e AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS al, b.vec_id AS id, b.label AS bl, list_dot_product(a.v, b.v)::BIGINT AS score FROM e a JOIN e b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE al = bl QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5),
n AS (SELECT p.*, id AS negative_id, score AS negative_score FROM p JOIN s USING (anchor_id) WHERE al <> bl AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY negative_score DESC, negative_id) AS INT) AS rank FROM n)
SELECT anchor_id, positive_id, rank, negative_id, positive_score, negative_score FROM o WHERE rank <= 3
""",
        "op12_collocations": r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, i, unnest(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]')) AS piece, generate_subscripts(regexp_split_to_array(t, '[.,;:!?\x0A-\x0D]'), 1) AS j FROM d),
w AS (SELECT lang, i, j, unnest(ws) AS w, generate_subscripts(ws, 1) AS k FROM (SELECT lang, i, j, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)),
g AS (SELECT lang, w AS w1, lead(w, 1) OVER z AS w2, lead(w, 2) OVER z AS w3, lead(w, 3) OVER z AS w4, lead(w, 4) OVER z AS w5 FROM w WINDOW z AS (PARTITION BY lang, i, j ORDER BY k)),
c AS (
  SELECT lang, 1 AS m, [w1] AS ws, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 2, [w1, w2], count(*) FROM g WHERE w2 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 3, [w1, w2, w3], count(*) FROM g WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 4, [w1, w2, w3, w4], count(*) FROM g WHERE w4 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100
  UNION ALL SELECT lang, 5, [w1, w2, w3, w4, w5], count(*) FROM g WHERE w5 IS NOT NULL GROUP BY ALL HAVING count(*) >= 100),
inner_ AS (SELECT DISTINCT lang, ws[s : s + q - 1] AS ws, f FROM c, range(1, 5) a(s), range(2, 5) b(q) WHERE q < m AND s + q - 1 <= m),
kept AS (SELECT c.* FROM c WHERE m > 1 AND NOT EXISTS (SELECT 1 FROM inner_ x WHERE x.lang = c.lang AND x.ws = c.ws AND 100 * x.f >= 100 * c.f)),
n AS (SELECT lang, count(*) AS n FROM w GROUP BY 1),
cut AS (SELECT kept.lang, ws, f AS a, k, (1000::HUGEINT * f * n.n) AS top, ws[1 : k] AS ls, ws[k + 1 : m] AS rs, n.n FROM kept JOIN n ON n.lang = kept.lang, range(1, 5) q(k) WHERE k < m),
s AS (SELECT cut.lang, array_to_string(cut.ws, ' ') AS phrase, a, l.f AS l, r.f AS r, cut.n, k, CAST(top // (l.f::HUGEINT * r.f) AS BIGINT) AS score FROM cut JOIN c l ON l.lang = cut.lang AND l.ws = ls JOIN c r ON r.lang = cut.lang AND r.ws = rs),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
o AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM b)
SELECT * FROM o WHERE rank <= 2000
""",
    }
