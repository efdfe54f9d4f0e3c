"""Phrase collocations by vertical positional inverted lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import keep

#: Piece ends become one sign that no word can hold, tabs become spaces.
_SIGNS = bytes(46 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else c for c in range(256))
STATE = "lang string, chunk long, n long, ids array<long>, lengths binary, gaps binary"


def piece_words(text: str | None) -> list[bytes]:
    """The words of a text in lower case (A-Z alone), with ``b"."`` wherever one piece ends."""
    data = (text or "").encode("utf-8", "surrogatepass").lower().translate(_SIGNS)
    return data.replace(b".", b" . ").split()


def _pack(numbers: np.ndarray) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=1, write_content_size=True).compress(numbers.tobytes())


def _unpack(data: bytes, dtype=np.int32) -> np.ndarray:
    import zstandard

    return np.frombuffer(zstandard.ZstdDecompressor().decompress(data), dtype)


def _gaps(positions: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions of concatenated lists as gaps; the first of a list stays."""
    out = np.diff(positions, prepend=positions[:1] * 0)
    starts = (np.cumsum(lengths) - lengths)[lengths > 0]
    out[starts] = positions[starts]
    return out.astype(np.int32)


def _positions(gaps: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    sums = np.cumsum(gaps, dtype=np.int64)
    starts = np.cumsum(lengths) - lengths
    before = np.append(0, sums)[starts]
    return (sums - np.repeat(before, lengths)).astype(np.int32)


def _batch(rows: list[tuple], schema: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, (_, k) in zip(columns, schema, strict=True)], names=[n for n, _ in schema])


class _Numbers(dict):
    """Words numbered from 1 as they come; a piece's end is 0."""

    def __missing__(self, word):
        out = self[word] = len(self)
        return out


def word_lists(docs: DataFrame, most: int, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, chunk, n, terms, lengths, gaps): the positions of every word, a row for each chunk of one language's texts.

    Chunks end with the text that fills ``most`` positions, and never leave the task that reads them. A chunk's lists
    stand one after the other in the order of terms; lengths says how long each is."""

    def run(batches):
        from pyspark import TaskContext

        task, made, open_ = TaskContext.get().partitionId(), 0, {}
        schema = [("lang", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("terms", pa.list_(pa.string())), ("lengths", pa.list_(pa.int32())), ("gaps", pa.binary())]

        def close(lang):
            nonlocal made
            numbers, parts, _ = open_.pop(lang)
            ids = np.concatenate(parts)
            lengths = np.bincount(ids, minlength=len(numbers))
            positions = np.argsort(ids, kind="stable")[lengths[0] :].astype(np.int32)
            terms = [w.decode("utf-8", "surrogatepass") for w in numbers][1:]
            made += 1
            return _batch([(lang, task << 32 | made, len(positions), terms, lengths[1:].astype(np.int32), _pack(_gaps(positions, lengths[1:])))], schema)

        for batch in batches:
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if lang not in open_:
                    open_[lang] = [_Numbers({b".": 0}), [], 0]
                state, words = open_[lang], [*piece_words(text), b"."]
                state[1].append(np.fromiter(map(state[0].__getitem__, words), np.int32, len(words)))
                state[2] += len(words)
                if state[2] >= most:
                    yield close(lang)
        for lang in list(open_):
            yield close(lang)

    rows = docs.select(F.coalesce(lang_col, F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "lang string, chunk long, n long, terms array<string>, lengths array<int>, gaps binary")


def frequent_words(lists: DataFrame, found: DataFrame) -> DataFrame:
    """The word lists of the terms found (lang, term, id), as STATE; other lists go."""
    each = lists.select("lang", "chunk", F.posexplode("terms").alias("i", "term")).join(found.select("lang", "term", "id"), ["lang", "term"])
    kept = each.groupBy("chunk").agg(F.sort_array(F.collect_list(F.struct("i", "id"))).alias("kept"))
    rows = lists.select("lang", "chunk", "lengths", "gaps").join(kept, "chunk").select("lang", "chunk", "lengths", "gaps", F.col("kept.i").alias("i"), F.col("kept.id").alias("id"))

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                lengths = np.array(row["lengths"], np.int64)
                positions = _positions(_unpack(row["gaps"]), lengths)
                stays = np.zeros(len(lengths), bool)
                stays[row["i"]] = True
                positions, lengths = positions[np.repeat(stays, lengths)], lengths[stays]
                out.append((row["lang"], row["chunk"], len(positions), row["id"], _pack(lengths.astype(np.int32)), _pack(_gaps(positions, lengths))))
            yield _batch(out, _STATE)

    return rows.mapInArrow(run, STATE)


_STATE = [("lang", pa.string()), ("chunk", pa.int64()), ("n", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.binary()), ("gaps", pa.binary())]


def _joined(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (left, right) of a chunk's phrases that follow each other one position apart, their lists' lengths, and the lists.

    Each list of positions p is merged with the lists that hold p + 1, which end in the adjacent word: those are the
    adjacent word's own postings, already narrowed to where the words between precede it."""
    ids, lengths = np.array(row["ids"], np.int64), _unpack(row["lengths"]).astype(np.int64)
    positions = _positions(_unpack(row["gaps"]), lengths)
    if not len(positions):
        return ids[:0], ids[:0], lengths[:0], positions
    owner = np.repeat(np.arange(len(ids)), lengths)
    holds = np.full(int(positions.max()) + 2, -1, np.int64)
    holds[positions] = owner
    after = holds[positions + 1]
    meets = after >= 0
    pair, positions = owner[meets] * len(ids) + after[meets], positions[meets]
    order = np.argsort(pair, kind="stable")
    pair, positions = pair[order], positions[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    keys = pair[first]
    return ids[keys // len(ids)], ids[keys % len(ids)], np.diff(np.append(first, len(pair))), positions


def _part(left: np.ndarray, right: np.ndarray, parts: int) -> np.ndarray:
    x = left.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + right.astype(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return ((x ^ (x >> np.uint64(29))) % np.uint64(parts)).astype(np.int64)


def longer_phrases(state: DataFrame, least: int, parts: int) -> DataFrame:
    """The pairs of phrases whose lists are ``least`` long in all: (chunk, packed, left, right, id, f).

    Rows without a chunk hold a part's pairs, with their ids and counts, as arrays; rows with one hold, packed, those
    of the pairs that the chunk has. Each chunk deals the lengths of its lists into parts by a hash of the pair, packed;
    a part adds up those of all chunks. A pair is there at most once for each chunk, so no part is much larger than
    another."""

    def deal(batches):
        for batch in batches:
            for row in batch.to_pylist():
                left, right, lengths, _ = _joined(row)
                part = _part(left, right, parts)
                order = np.argsort(part, kind="stable")
                left, right, lengths, part = left[order], right[order], lengths[order], part[order]
                ends = np.searchsorted(part, np.arange(parts + 1))
                out = [(p, row["chunk"], _pack(left[a:b]), _pack(right[a:b]), _pack(lengths[a:b])) for p, (a, b) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)) if b > a]
                yield _batch(out, schema)

    schema = [("part", pa.int64()), ("chunk", pa.int64()), ("left", pa.binary()), ("right", pa.binary()), ("lengths", pa.binary())]
    dealt = state.mapInArrow(deal, "part long, chunk long, left binary, right binary, lengths binary")

    def add(table: pa.Table) -> pa.Table:
        columns = [[_unpack(x, np.int64) for x in table.column(c).to_pylist()] for c in ("left", "right", "lengths")]
        sizes = [len(x) for x in columns[0]]
        left, right, lengths = (np.concatenate(c) for c in columns)
        order = np.lexsort((right, left))
        starts = np.flatnonzero(np.append(True, (np.diff(left[order]) != 0) | (np.diff(right[order]) != 0)))
        sums = np.add.reduceat(lengths[order], starts)
        good = np.flatnonzero(sums >= least)
        number = np.full(len(starts), -1, np.int64)
        number[good] = (table.column("part")[0].as_py() << 32) + np.arange(len(good))
        each = np.empty(len(order), np.int64)
        each[order] = np.repeat(number, np.diff(np.append(starts, len(order))))
        heads = order[starts[good]]
        out, at = [(None, None, left[heads], right[heads], number[good], sums[good])], 0
        for chunk, size in zip(table.column("chunk").to_pylist(), sizes, strict=True):
            here = at + np.flatnonzero(each[at : at + size] >= 0)
            if len(here):
                out.append((chunk, [_pack(left[here]), _pack(right[here]), _pack(each[here])], None, None, None, None))
            at += size
        return pa.Table.from_batches([_batch(out, found)])

    longs = pa.list_(pa.int64())
    found = [("chunk", pa.int64()), ("packed", pa.list_(pa.binary())), *[(c, longs) for c in ("left", "right", "id", "f")]]
    return dealt.groupBy("part").applyInArrow(add, "chunk long, packed array<binary>, left array<long>, right array<long>, id array<long>, f array<long>")


def extended(state: DataFrame, kept: DataFrame) -> DataFrame:
    """The lists of the longer phrases kept (chunk, kept: packed left, right and id of each part), as STATE."""
    rows = state.join(kept, "chunk")

    def run(batches):
        for batch in batches:
            out = []
            for row in batch.to_pylist():
                left, right, lengths, positions = _joined(row)
                known, (k_left, k_right, ids) = np.sort(np.array(row["ids"], np.int64)), (np.concatenate([_unpack(p[i], np.int64) for p in row["kept"]]) for i in range(3))
                key = lambda a, b: np.searchsorted(known, a) * len(known) + np.searchsorted(known, b)  # noqa: E731, B023
                want = key(k_left, k_right)
                order = np.argsort(want)
                want, ids, have = want[order], ids[order], key(left, right)
                at = np.minimum(np.searchsorted(want, have), len(want) - 1)
                stays = want[at] == have
                positions, lengths = positions[np.repeat(stays, lengths)], lengths[stays]
                out.append((row["lang"], row["chunk"], len(positions), ids[at[stays]], _pack(lengths.astype(np.int32)), _pack(_gaps(positions, lengths))))
            yield _batch(out, _STATE)

    return rows.mapInArrow(run, STATE)


def collocations(docs: DataFrame, least: int = 100, longest: int = 5, share: int = 100, top: int = 2000, chunk: int = 2_000_000, part: int = 2_000_000, lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): each language's ``top`` phrases of 2 to ``longest`` words that occur ``least`` times or more.

    Texts are cut into pieces at ``[.,;:!?\\x0A-\\x0D]`` and into words at spaces and tabs, A-Z in lower case. n counts a
    language's words, a, l and r the occurrences of a phrase and of its two parts at the cut with the least
    floor(1000 a n / (l r)). A phrase inside a longer one that has ``share`` percent of its occurrences goes. Every
    phrase is a list of positions in each chunk of texts; two frequent phrases of k words that stand one position apart
    make one of k + 1, whose merged list's length is its exact count. Counts are added over all chunks in each round.

    Null texts are empty, a null language is ``und``; repeated rows count each time; other columns are ignored; without
    frequent phrases, or without rows, the result is empty. Equal scores go by more occurrences, then by the phrase's
    bytes. A text longer than ``chunk`` words is a chunk by itself, held in one task in some 100 bytes a word."""
    lists = keep(word_lists(docs, chunk, lang_col, text_col), "words")
    total = lists.groupBy("lang").agg(F.sum("n").alias("n"))
    words = lists.select("lang", F.explode(F.arrays_zip("terms", "lengths")).alias("w")).groupBy("lang", F.col("w.terms").alias("term")).agg(F.sum(F.col("w.lengths").cast("long")).alias("f")).where(F.col("f") >= least)
    empty = F.array().cast("array<long>")
    # pre and suf: how often the first, and the last, 1, 2, ... words occur, in turn.
    found = keep(words.select(F.monotonically_increasing_id().alias("id"), "lang", "term", F.col("term").alias("last"), "f", empty.alias("pre"), empty.alias("suf")), "found")
    state = keep(frequent_words(lists, found), "lists")
    phrases, shorter = None, None
    for _ in range(2, longest + 1):
        occurrences = state.agg(F.sum("n")).first()[0] or 0
        pairs = keep(longer_phrases(state, least, max(1, math.ceil(occurrences / part))), "pairs")
        new = pairs.where("chunk is null").select(F.explode(F.arrays_zip("left", "right", "id", "f")).alias("p")).select("p.*")
        ends = lambda k, *cs: found.select(F.col("id").alias(k), *[F.col(c).alias(f"{k}_{c}") for c in cs])  # noqa: E731, B023
        new = new.join(ends("left", "lang", "term", "f", "pre"), "left").join(ends("right", "last", "f", "suf"), "right")
        new = new.select("id", F.col("left_lang").alias("lang"), F.concat_ws(" ", "left_term", "right_last").alias("term"), F.col("right_last").alias("last"), "f", F.array_append("left_pre", F.col("left_f")).alias("pre"), F.array_append("right_suf", F.col("right_f")).alias("suf"), "left", "right")
        new = keep(new, "found")
        if shorter is not None:
            inside = new.select(F.col("left").alias("id"), "f").union(new.select("right", "f")).groupBy("id").agg(F.max("f").alias("in_longer"))
            shorter = shorter.join(inside, "id", "left").where(F.col("in_longer").isNull() | (100 * F.col("in_longer") < share * F.col("f")))
            shorter = shorter.select("lang", "term", "f", "pre", "suf")
            phrases = shorter if phrases is None else phrases.unionByName(shorter)
        shorter = new
        if not new.limit(1).count():
            break
        kept = pairs.where("chunk is not null").groupBy("chunk").agg(F.collect_list("packed").alias("kept"))
        state, found = keep(extended(state, kept), "lists"), new
    last = shorter.select("lang", "term", "f", "pre", "suf")
    phrases = keep(last if phrases is None else phrases.unionByName(last), "phrases").join(total, "lang")
    whole = lambda c: c.cast("decimal(19,0)")
    cuts = F.transform("pre", lambda l, k: F.struct(l.alias("l"), F.element_at("suf", F.size("pre") - k).alias("r"), (k + 1).alias("k")))
    each = phrases.select("lang", "term", F.col("f").alias("a"), "n", F.explode(cuts).alias("c")).select("lang", "term", "a", "n", "c.*")
    each = each.withColumns({c.upper() + "_": whole(F.col(c)) for c in ("a", "n", "l", "r")}).withColumn("score", F.expr("CAST(1000 AS DECIMAL(4,0)) * A_ * N_ div (L_ * R_)"))
    best = each.groupBy("lang", "term", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("b"))
    best = best.select("lang", F.col("term").alias("phrase"), "a", "b.l", "b.r", "n", "b.score")
    order = W.Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
