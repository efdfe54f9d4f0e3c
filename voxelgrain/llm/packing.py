"""Packing by power-of-two decomposition."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .tokens import encode_column

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def piece_lengths(tokens: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, length) of all pieces: each number of tokens as powers of two, none above longest, the largest first."""
    bits = np.arange(longest.bit_length() - 1, -1, -1)
    # A column for each power; the largest may occur more than once.
    times = np.c_[tokens // longest, tokens[:, None] >> bits[1:] & 1]
    return np.repeat(np.arange(len(tokens)), times.sum(1)), np.repeat(np.tile(1 << bits, len(tokens)), times.reshape(-1))


def pack_power_of_two(docs: DataFrame, tokenizer: str, longest: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Cuts each document's ids, with end_id appended, into pieces whose lengths are powers of two; each piece is a sequence.

    No sequence holds two documents and none needs padding. Sequences of one length form a bucket, the top byte of
    sequence_id (log2 of the length); below it stand the partition and the piece's rank in it, so that ids are unique
    and a rerun of a task gives the same ones, without any shuffle. ids holds little-endian unsigned 32-bit ids.

    Null and empty texts give one piece with end_id alone. Repeated rows are packed each for itself, a null id stays
    null, an empty table gives no row, and other columns are ignored. A very long text is held in memory whole, with
    about 20 bytes for each of its own; no other rows are held beside it."""
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")

    def pack(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId() if TaskContext.get() else 0
        used = np.zeros(longest.bit_length(), np.int64)  # pieces so far, by log2 of the length
        for batch in batches:
            for at, ids, tokens in encode_column(tokenizer, batch.column(1), end_id):
                doc, length = piece_lengths(tokens, longest)
                upto = np.cumsum(length)
                start = upto - length - (np.cumsum(tokens) - tokens)[doc]
                power = np.round(np.log2(length)).astype(np.int64)
                rank = np.zeros(len(length), np.int64)
                for k in range(len(used)):
                    same = power == k
                    rank[same] = used[k] + np.arange(same.sum())
                    used[k] += same.sum()
                bounds = np.append(0, 4 * upto).astype(np.int32)
                pieces = pa.Array.from_buffers(pa.binary(), len(length), [None, pa.py_buffer(bounds), pa.py_buffer(ids.astype("<u4", copy=False))])
                columns = [batch.column(0).take(pa.array(at + doc)), start, length, tokens[doc], power << 56 | part << 32 | rank, np.zeros(len(length), np.int64), pieces]
                yield pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in SCHEMA.split(", ")])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(pack, SCHEMA)


def ids_crc32(ids: Column) -> Column:
    return F.crc32(ids)


def unpack_ids(ids: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<u4")
