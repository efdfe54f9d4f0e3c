"""Token ids in binary shards: one concatenated id array and Elias-Fano encoded document boundaries."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import window as W

from .common import keep, scratch_path
from .tokens import encode_column

MAGIC = b"EFTB0002"
_HEAD = struct.Struct("<8sIIQQQBB6x")  # magic, part, shard, tokens before it in its part, documents, tokens, id width, has null ids
_EF = struct.Struct("<QQBQI")  # values, largest value, low bits, bytes of high bits, wide stretches
_EVERY, _WIDE = 64, 4096


class EliasFano:
    """A non-decreasing sequence of integers from 0, in about 2 + log2(largest / count) bits each.

    The low bits stand side by side; the high bits are in unary. Two small tables make select quick however the
    values are spread: the place of every 64th one bit, and, for the stretches of 64 ones that reach over more than
    4,096 bits, the places of all ones in them. So get(i) never looks at more than 512 bytes of the high bits."""

    def __init__(self, n: int, top: int, low_bits: int, low: bytes, high: bytes, places: np.ndarray, wide: np.ndarray, far: np.ndarray):
        self.n, self.top, self.low_bits, self.low, self.high, self.places, self.wide, self.far = n, top, low_bits, low, high, places, wide, far

    @classmethod
    def of(cls, values: np.ndarray) -> EliasFano:
        v = np.asarray(values, np.uint64)
        n, top = len(v), int(v[-1]) if len(v) else 0
        if n and np.any(v[1:] < v[:-1]):
            raise ValueError("the sequence must not decrease")
        k = max(0, (top // n).bit_length() - 1) if n else 0
        bits = (v[:, None] >> np.arange(k, dtype=np.uint64)).astype(np.uint8) & 1
        ones = (v >> np.uint64(k)).astype(np.int64) + np.arange(n)
        high = np.zeros((top >> k) + n + 1, np.uint8)
        high[ones] = 1
        full = ones[: n // _EVERY * _EVERY].reshape(-1, _EVERY)
        wide = np.flatnonzero(full[:, -1] - full[:, 0] > _WIDE) if len(full) else np.zeros(0, np.int64)
        far = full[wide]
        if n % _EVERY and ones[-1] - ones[n // _EVERY * _EVERY] > _WIDE:  # the last stretch, filled up with its last place
            wide = np.append(wide, n // _EVERY)
            last = ones[n // _EVERY * _EVERY :]
            far = np.r_[far.reshape(-1, _EVERY), np.append(last, np.full(_EVERY - len(last), last[-1]))[None]]
        return cls(n, top, k, np.packbits(bits.reshape(-1), bitorder="little").tobytes(), np.packbits(high, bitorder="little").tobytes(), ones[::_EVERY].astype("<u8"), wide.astype("<u8"), far.reshape(-1, _EVERY).astype("<u8"))

    def to_bytes(self) -> bytes:
        return _EF.pack(self.n, self.top, self.low_bits, len(self.high), len(self.wide)) + self.low + self.high + self.places.tobytes() + self.wide.tobytes() + self.far.tobytes()

    @classmethod
    def read(cls, data: memoryview, at: int) -> tuple[EliasFano, int]:
        n, top, k, m, w = _EF.unpack_from(data, at)
        at += _EF.size
        low = bytes(data[at : at + (n * k + 7) // 8])
        at += len(low)
        high = bytes(data[at : at + m])
        at += m
        tables = []
        for size in (-(-n // _EVERY), w, w * _EVERY):
            tables.append(np.frombuffer(data, "<u8", size, at))
            at += 8 * size
        return cls(n, top, k, low, high, tables[0], tables[1], tables[2].reshape(-1, _EVERY)), at

    def _low(self, i: int) -> int:
        a, b = i * self.low_bits, (i + 1) * self.low_bits
        return int.from_bytes(self.low[a // 8 : -(-b // 8)], "little") >> a % 8 & (1 << self.low_bits) - 1

    def get(self, i: int) -> int:
        """The i-th value, by select."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        block, left = divmod(i, _EVERY)
        at, w = int(self.places[block]), int(np.searchsorted(self.wide, block))
        if w < len(self.wide) and self.wide[w] == block:
            at = int(self.far[w, left])
        elif left:
            first = at >> 3
            ones = np.flatnonzero(np.unpackbits(np.frombuffer(self.high, np.uint8, min(len(self.high) - first, _WIDE // 8 + 2), first), bitorder="little")[at & 7 :])
            at += int(ones[left])
        return (at - i) << self.low_bits | self._low(i)

    def slice(self, i: int, j: int) -> np.ndarray:
        """The values i to j - 1: select finds both ends, and only what lies between is decoded."""
        j = min(j, self.n)
        if i >= j:
            return np.zeros(0, np.int64)
        first, last = (self.get(i) >> self.low_bits) + i, (self.get(j - 1) >> self.low_bits) + j - 1
        bits = np.unpackbits(np.frombuffer(self.high, np.uint8, (last >> 3) - (first >> 3) + 1, first >> 3), bitorder="little")
        ones = np.flatnonzero(bits)
        ones = ones[ones >= (first & 7)][: j - i] + (first >> 3 << 3)
        out = (ones - np.arange(i, j)).astype(np.int64) << self.low_bits
        if self.low_bits:
            a = i * self.low_bits
            low = np.frombuffer(self.low, np.uint8, -(-j * self.low_bits // 8) - (a >> 3), a >> 3)
            low = np.unpackbits(low, bitorder="little")[a & 7 :][: (j - i) * self.low_bits].reshape(j - i, self.low_bits)
            out += low.astype(np.int64) @ (1 << np.arange(self.low_bits, dtype=np.int64))
        return out


def shard_bytes(part: int, shard: int, before: int, doc_ids: list[int | None], sizes: np.ndarray, ids: list[np.ndarray], width: int) -> bytes:
    """One shard: header, boundaries, document ids (from the least; nulls first), then all ids in width bytes each."""
    nulls = sum(x is None for x in doc_ids)
    known = [x for x in doc_ids if x is not None]
    least = known[0] if known else 0
    names = EliasFano.of(np.array([x - least for x in known], np.uint64))
    head = _HEAD.pack(MAGIC, part, shard, before, len(sizes), int(sizes.sum()), width, nulls > 0)
    return head + struct.pack("<qQ", least, nulls) + EliasFano.of(np.r_[0, np.cumsum(sizes)]).to_bytes() + names.to_bytes() + b"".join(x.tobytes() for x in ids)


def read_shard(data: bytes) -> dict:
    """What a shard holds; bounds and doc_ids are EliasFano sequences, ids an array over the shard's own bytes."""
    magic, part, shard, before, docs, tokens, width, _ = _HEAD.unpack_from(data)
    if magic != MAGIC:
        raise ValueError("not a shard of token ids")
    view, at = memoryview(data), _HEAD.size
    least, nulls = struct.unpack_from("<qQ", data, at)
    bounds, at = EliasFano.read(view, at + 16)
    names, at = EliasFano.read(view, at)
    ids = np.frombuffer(view, f"<u{width}", tokens, at)
    return {"part": part, "shard": shard, "before": before, "docs": docs, "least": least, "nulls": nulls, "bounds": bounds, "names": names, "ids": ids}


def document_ids(shard: dict, i: int) -> np.ndarray:
    """The token ids of the shard's i-th document, found by select."""
    return shard["ids"][shard["bounds"].get(i) : shard["bounds"].get(i + 1)]


def _store(folder: str):
    """(file system, path in it) of a folder's address."""
    import re

    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder) if ":" in folder else f"file://{folder}")


def _put(folder: str, name: str, data: bytes) -> None:
    """Writes a file of the shared folder under another name first; a task that runs again writes the same bytes."""
    import uuid

    store, path = _store(folder)
    store.create_dir(path, recursive=True)
    part = f"{path}/_{uuid.uuid4().hex}"
    with store.open_output_stream(part) as out:
        out.write(data)
    store.move(part, f"{path}/{name}")


def _holds_shards(folder: str) -> bool:
    from pyarrow import fs

    store, path = _store(folder)
    return any(f.base_name.endswith(".eft") for f in store.get_file_info(fs.FileSelector(path, allow_not_found=True)))


def write_shards(docs: DataFrame, folder: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", shard_tokens: int = 2_000_000, width: int = 2) -> DataFrame:
    """Writes the shards, documents in ascending id order (nulls first), and returns one row for each shard.

    Texts are dealt out by ranges of the id, equal ids also by a hash of the text, so that one frequent id does not
    fill one task. A shard ends with the document that brings it to shard_tokens ids. A null text is empty."""

    def write(batches):
        from pyspark import TaskContext

        part, shard, before, n = TaskContext.get().partitionId(), 0, 0, 0
        wide, schema = f"<u{width}", pa.schema([(c, pa.int64()) for c in ("part", "shard", "docs", "tokens", "bytes")])
        names: list[int | None] = []
        sizes: list[np.ndarray] = []
        held: list[np.ndarray] = []

        def row():
            data = shard_bytes(part, shard, before, names, np.concatenate(sizes), held, width)
            _put(folder, f"part-{part:06d}-{shard:06d}.eft", data)
            return pa.RecordBatch.from_pydict({"part": [part], "shard": [shard], "docs": [len(names)], "tokens": [n], "bytes": [len(data)]}, schema)

        for batch in batches:
            for at, ids, counts in encode_column(tokenizer, batch.column(1), end_id):
                if width < 4 and len(ids) and int(ids.max()) >> 8 * width:
                    raise ValueError("an id needs more bytes than width")
                ids, upto, i = ids.astype(wide), np.append(0, np.cumsum(counts)), 0
                while i < len(counts):
                    j = min(len(counts), int(np.searchsorted(upto, upto[i] + shard_tokens - n, "left")))
                    j = max(j, i + 1)
                    names += batch.column(0).slice(at + i, j - i).to_pylist()
                    sizes.append(counts[i:j])
                    held.append(ids[upto[i] : upto[j]])
                    n, i = n + int(upto[j] - upto[i]), j
                    if n >= shard_tokens:
                        yield row()
                        shard, before, n, names, sizes, held = shard + 1, before + n, 0, [], [], []
        if names:
            yield row()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(F.col("doc_id").asc_nulls_first(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), F.xxhash64("text"))
    return rows.mapInArrow(write, "part long, shard long, docs long, tokens long, bytes long")


def read_documents(spark, folder: str, step: int = 2000) -> DataFrame:
    """Reads every shard of a folder: (part, shard, doc_id, start in its part, n_tokens, ids binary: little-endian unsigned 32-bit).

    Boundaries and document ids are taken from the sequences by select, ``step`` documents at a time."""

    def read(batches):
        for batch in batches:
            for data in batch.column(0):
                s = read_shard(data.as_buffer().to_pybytes())
                for i in range(0, s["docs"], step):
                    cut = s["bounds"].slice(i, i + step + 1)
                    k, nulls = len(cut) - 1, max(0, min(s["nulls"] - i, step, s["docs"] - i))
                    names = (s["names"].slice(i + nulls - s["nulls"], i + k - s["nulls"]) + s["least"]).tolist()
                    ids = s["ids"][cut[0] : cut[-1]].astype("<u4")
                    ids = pa.Array.from_buffers(pa.large_binary(), k, [None, pa.py_buffer(4 * (cut - cut[0])), pa.py_buffer(ids)]).cast(pa.binary())
                    columns = [[s["part"]] * k, [s["shard"]] * k, [None] * nulls + names, cut[:-1] + s["before"], np.diff(cut)]
                    yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns), ids], names=["part", "shard", "doc_id", "start", "n_tokens", "ids"])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.eft").load(folder).select("content")
    return files.mapInArrow(read, "part long, shard long, doc_id long, start long, n_tokens long, ids binary")


def token_binary(docs: DataFrame, tokenizer: str, folder: str | None = None, **options) -> DataFrame:
    """Writes all documents' ids in shards under folder, reads them back and returns (doc_id, start, n_tokens, ids).

    start counts the ids of all documents before, over all shards; what the parts hold before is summed from one row a
    part, of which there are as many as shuffle partitions at most. A folder that holds shards already is refused, and
    shards that the manifest doesn't name, left by a task that was lost, are passed over. Empty and null texts hold the
    end id alone. Repeated rows each have their own place; an empty table gives no row and no file; other columns are
    ignored. A very long text makes one long shard, which is written and read in one task."""
    spark = docs.sparkSession
    if folder and _holds_shards(folder):
        raise ValueError(f"{folder} holds shards already")
    folder = folder or scratch_path(spark, "shards")
    shards = keep(write_shards(docs, folder, tokenizer, **options), "manifest")
    parts = shards.groupBy("part").agg(F.sum("tokens").alias("tokens"), F.max("shard").alias("last"))
    base = parts.select("part", "last", (F.sum("tokens").over(W.Window.orderBy("part")) - F.col("tokens")).alias("base"))
    if not shards.limit(1).count():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids binary")
    rows = read_documents(spark, folder).join(F.broadcast(base), "part").where("shard <= last")
    return rows.select("doc_id", (F.col("start") + F.col("base")).alias("start"), "n_tokens", "ids")
