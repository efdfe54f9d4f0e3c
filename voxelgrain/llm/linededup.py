"""Substring dedup by hashing of lines and sentences."""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, unused

#: A unit ends at a line's end, or after a sentence's end that white space follows, or after a full-width one.
_END = re.compile(r"[.!?।॥؟۔።][\"')\]»”]*(?=\s)|[。！？｡][\"')\]»”」』）】]*|\n")
_JUNK = re.compile(r"[\W_]+")
#: Letters of scripts without spaces between words: Thai to Lao, Burmese, Khmer, kana, Han.
_DENSE = re.compile(r"[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]")


def count_words(text: str) -> int:
    """Words between white space; of scripts that have no spaces, every two letters are one word."""
    if text.isascii():
        return len(text.split())
    spaced, dense = _DENSE.subn(" ", text)
    return len(_JUNK.sub(" ", spaced).split()) + (dense + 1) // 2 if dense else len(text.split())


def units(text: str, min_words: int) -> list[tuple[int, int, int, bytes]]:
    """(start, end, words, digest) of each line or sentence; offsets are in characters, and units don't overlap.

    The digest (128 bits) is that of the unit in lower case, with each run of other signs than letters and digits as
    one space. A unit under min_words words is digested with the units after it, as many as give min_words words, or
    at the text's end with the ones before it; so it equals another only where both stand in a passage of min_words
    words. Texts under min_words words have no units."""
    found, at = [], 0
    ends = [m.end() for m in _END.finditer(text)]
    for end in [*ends, len(text)]:
        part = text[at:end]
        plain = _JUNK.sub(" ", part.lower()).strip()
        if plain:
            body = part.strip()
            start = at + len(part) - len(part.lstrip())
            found.append((start, start + len(body), count_words(part), plain))
        at = end
    out = []
    for i, (start, end, words, plain) in enumerate(found):
        if words < min_words:
            n, first, last = words, i, i + 1
            while n < min_words and last < len(found):
                n, last = n + found[last][2], last + 1
            while n < min_words and first > 0:
                first -= 1
                n += found[first][2]
            if n < min_words:
                break
            # No plain text holds a zero: these keys are neither those of whole units nor, at the end, of each other.
            plain = "\0".join(["", *([f"\0{i - first}"] if first < i else []), *[f[3] for f in found[first:last]]])
        out.append((start, end, words, hashlib.blake2b(plain.encode("utf-8", "surrogatepass"), digest_size=16).digest()))
    return out


def text_units(docs: DataFrame, min_words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, end, words, hi, lo): every unit of every text, with the digest as two longs.

    The hash of the text tells rows of one id, or without an id, apart."""

    def run(batches):
        for batch in batches:
            ids, texts, hashes = (c.to_pylist() for c in batch.columns)
            rows: list[tuple] = []
            for doc_id, text, text_hash in zip(ids, texts, hashes, strict=True):
                for start, end, words, digest in units(text or "", min_words):
                    rows.append((doc_id, text_hash, start, end, words, int.from_bytes(digest[:8], "little", signed=True), int.from_bytes(digest[8:], "little", signed=True)))
                if len(rows) >= 50_000:
                    yield frame(rows)
                    rows = []
            yield frame(rows)

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
    names = ["doc_id", "text_hash", "start", "end", "words", "hi", "lo"]

    def frame(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 7, kinds, strict=True)], names=names)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(text_col)).alias("text_hash")).mapInArrow(run, "doc_id long, text_hash long, start long, end long, words int, hi long, lo long")


def repeated_units(docs: DataFrame, min_words: int = 8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, end, words, keep_doc_id, keep_start, copies): one row for each unit to remove, at its place in the text.

    Of units with one digest, the first by (doc_id, text_hash, start) stays, in keep_doc_id at keep_start; copies counts
    all of them. Lines shorter than min_words words recur by chance, so they count only with their neighbours, see
    units(); of the whole units of a repeated passage, its last ones of less than min_words words in all may stay for
    that. The digests are summed before the shuffle; a line that stands in a large part of all texts is one row for
    each task, and the join back to its places is split by adaptive execution.

    Null and empty texts have no units. Rows of one id with different texts are different texts; texts without an id
    come after all others and are removed like any copy. Rows that agree in id and text count as one, since their
    places are the same. An empty table gives an empty one; other columns are ignored."""
    places = keep(text_units(docs, min_words, id_col, text_col), "units")
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash", "start")
    # Written, so that the join stands on two plain shuffles, which adaptive execution can split.
    seen = places.groupBy("hi", "lo").agg(F.min(place).alias("first"), F.count("*").alias("copies")).where("copies > 1")
    seen = keep(seen.select("hi", "lo", F.col("first.doc_id").alias("keep_doc_id"), F.col("first.text_hash").alias("keep_hash"), F.col("first.start").alias("keep_start"), "copies"), "seen")
    first = F.col("doc_id").eqNullSafe(F.col("keep_doc_id")) & (F.col("text_hash") == F.col("keep_hash")) & (F.col("start") == F.col("keep_start"))
    return places.join(seen, ["hi", "lo"]).where(~first).select("doc_id", "text_hash", "start", "end", "words", "keep_doc_id", "keep_start", "copies").distinct()


def remove_spans(docs: DataFrame, spans: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with the spans (doc_id, text_hash, start, end) taken out of their texts; null texts stay as they are.

    Spans hold for the rows of their id, null included, whose text has that hash. Other columns stay as they are, whatever their names; spans beyond a text's
    end take nothing; no spans, or an empty table, change nothing."""
    c_id, c_hash, c_spans = unused(docs, "id", "text_hash", "spans")
    each = spans.groupBy(F.col("doc_id").alias(c_id), F.col("text_hash").alias(c_hash)).agg(F.sort_array(F.collect_set(F.struct("start", "end"))).alias(c_spans))

    @F.pandas_udf("string")
    def cut(texts, lists):
        out = []
        for text, spans_ in zip(texts, lists, strict=True):
            if text is None or spans_ is None:
                out.append(text)
                continue
            parts, at = [], 0
            for s in spans_:
                parts.append(text[at : s["start"]])
                at = max(at, s["end"])
            out.append("".join([*parts, text[at:]]))
        import pandas as pd

        return pd.Series(out, dtype=object)

    joined = docs.join(each, F.col(id_col).cast("long").eqNullSafe(F.col(c_id)) & (F.xxhash64(F.col(text_col)) == F.col(c_hash)), "left")
    return joined.select(*[cut(F.col(text_col), F.col(c_spans)).alias(c) if c == text_col else F.col(c) for c in docs.columns])
