"""GIF media columns: LZW code streams, palettes, disposal, transparency, timed frames and colour histograms."""

from __future__ import annotations

import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Samples in a row of a stored picture; payloads are padded to whole rows.
ROW = 576
_PAD = 255


def lzw_encode(data: bytes, min_bits: int = 8) -> bytes:
    """GIF's LZW: codes of growing width, packed from the least bit on, with a clear code when the table is full."""
    clear = 1 << min_bits
    codes, runs, table = [], [], {}
    emit, get, code = codes.append, table.get, clear + 2
    cur = data[0] if data else None
    for b in memoryview(data)[1:]:
        key = cur << 8 | b
        nxt = get(key)
        if nxt is None:
            emit(cur)
            if code < 4096:
                table[key] = code
                code += 1
            else:
                runs.append(codes)
                codes, code = [], clear + 2
                emit = codes.append
                table.clear()
            cur = b
        else:
            cur = nxt
    if data:
        emit(cur)
    runs.append(codes)
    widths, first = _widths(min_bits), min_bits + 1
    every = np.concatenate([[clear]] + [x for i, run in enumerate(runs) for x in (run, [clear if i < len(runs) - 1 else clear + 1])]).astype(np.int64)
    width = np.concatenate([[first]] + [widths[: len(run) + 1] for run in runs])
    bits = (every[:, None] >> np.arange(12) & 1).astype(np.uint8)
    return np.packbits(bits[np.arange(12) < width[:, None]], bitorder="little").tobytes()


@cache
def _widths(min_bits: int) -> np.ndarray:
    """Width of each code after a clear code, as far as the table grows; then it stays at 12."""
    known = np.arange((1 << min_bits) + 1, 4097)  # table size - 1 once the k-th code is to be read
    return np.minimum(np.maximum(np.frexp(known.astype(float))[1], min_bits + 1), 12)


@cache
def _places(min_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bit offset, width and mask of each code after a clear code; the last stands for all after it."""
    widths = _widths(min_bits)
    return np.r_[0, np.cumsum(widths)[:-1]].astype(np.int64), widths.astype(np.int64), ((1 << widths) - 1).astype(np.uint32)


def lzw_codes(data: bytes, min_bits: int) -> list[np.ndarray]:
    """The codes between clear codes, up to the end code. Widths depend on the count since the last clear code alone."""
    offsets, widths, masks = _places(min_bits)
    clear, end = 1 << min_bits, (1 << min_bits) + 1
    padded = np.frombuffer(data + bytes(8), np.uint8).astype(np.uint32)
    padded = padded[:-2] | padded[1:-1] << 8 | padded[2:] << 16
    at, top, out = 0, 8 * len(data), []
    while at < top:
        parts, place = [], at
        while True:  # once, or again where the table stays full
            late = bool(parts)
            bit = place + (np.arange(4096) * 12 if late else offsets)
            bit = bit[: np.searchsorted(bit + (12 if late else widths), top, "right")]
            codes = padded[bit >> 3] >> (bit & 7).astype(np.uint32) & (4095 if late else masks[: len(bit)])
            stop = np.flatnonzero(codes >> 1 == clear >> 1)
            if len(stop) or not len(codes):
                break
            parts.append(codes)
            place = int(bit[-1]) + 12
            if len(bit) < len(offsets):
                break
        found = int(stop[0]) if len(stop) else len(codes)
        if len(stop) or not parts:
            parts.append(codes[:found])
        run = np.concatenate(parts).astype(np.int64)
        if len(run):
            out.append(run)
        if not len(stop) or codes[found] == end:
            break
        at = int(bit[found]) + (12 if late else int(widths[found]))
    return out


def lzw_decode(data: bytes, min_bits: int, pixels: int) -> bytes:
    """The samples of a code stream, as many as there are up to pixels."""
    clear = 1 << min_bits
    singles = [bytes([i]) for i in range(clear)] + [b"", b""]
    out, n = [], 0
    for codes in lzw_codes(data, min_bits):
        table, codes = singles.copy(), codes.tolist()
        add, put, growing = table.append, out.append, 4096 - len(table) + 1
        if codes[0] >= clear:
            raise ValueError("a code that isn't in the table")
        old = table[codes[0]]
        put(old)
        for c in codes[1:growing]:
            if c < len(table):
                new = table[c]
            elif c == len(table):
                new = old + old[:1]
            else:
                raise ValueError("a code that isn't in the table")
            add(old + new[:1])
            put(new)
            old = new
        out += map(table.__getitem__, codes[growing:])
    return b"".join(out)[:pixels]


def _blocks(data: bytes) -> bytes:
    out = bytearray()
    for i in range(0, len(data), 255):
        part = data[i : i + 255]
        out.append(len(part))
        out += part
    return bytes(out) + b"\0"


GREY = bytes(x for i in range(256) for x in (i, i, i))


def encode_gif(frames: list[np.ndarray], delay: int = 4) -> bytes:
    """Grey frames (arrays of bytes of one width) as a GIF; each frame starts at the top left, ``delay`` hundredths long."""
    width, height = frames[0].shape[1], max(f.shape[0] for f in frames)
    out = bytearray(b"GIF89a" + struct.pack("<HHBBB", width, height, 0xF7, 0, 0) + GREY)
    for f in frames:
        out += b"\x21\xf9\x04" + struct.pack("<BHB", 1 << 2, delay, 0) + b"\0"
        out += b"\x2c" + struct.pack("<HHHHB", 0, 0, f.shape[1], f.shape[0], 0) + b"\x08" + _blocks(lzw_encode(f.tobytes()))
    return bytes(out + b"\x3b")


def _unblock(data: bytes, at: int) -> tuple[bytes, int]:
    parts = []
    while data[at]:
        parts.append(data[at + 1 : at + 1 + data[at]])
        at += 1 + data[at]
    return b"".join(parts), at + 1


def decode_gif(data: bytes) -> list[dict]:
    """The frames of a GIF as shown: (left, top, width, height of the picture drawn, delay_ms, mode, pixels, histogram).

    pixels is the whole canvas after the picture is drawn onto it, by its palette (its own or the common one), around
    transparent samples, and after the frame before was disposed of: kept (0, 1), cleared (2) or put back as it was
    (3). mode is L, one byte a pixel, if all palettes are grey and nothing is left undrawn in colour, else RGB. The
    histogram counts the drawn picture's pixels by 16 steps of grey or 4 x 4 x 4 of colour."""
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise ValueError("not a GIF")
    width, height, flags, _, _ = struct.unpack_from("<HHBBB", data, 6)
    at, common = 13, None
    if flags & 0x80:
        n = 3 << (flags & 7) + 1
        common = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
        at += n
    pictures, control, grey = [], (0, 0, None), True
    while at < len(data) and data[at] != 0x3B:
        if data[at] == 0x21:
            label = data[at + 1]
            body, end = _unblock(data, at + 2)
            if label == 0xF9 and len(body) >= 4:
                control = (body[0] >> 2 & 7, struct.unpack_from("<H", body, 1)[0] * 10, body[3] if body[0] & 1 else None)
            at = end
        elif data[at] == 0x2C:
            left, top, w, h, local = struct.unpack_from("<HHHHB", data, at + 1)
            at += 10
            palette = common
            if local & 0x80:
                n = 3 << (local & 7) + 1
                palette = np.frombuffer(data, np.uint8, n, at).reshape(-1, 3)
                at += n
            if palette is None:
                raise ValueError("no palette")
            min_bits = data[at]
            body, at = _unblock(data, at + 1)
            index = np.frombuffer(lzw_decode(body, min_bits, w * h).ljust(w * h, b"\0"), np.uint8).reshape(h, w)
            if local & 0x40:  # interlaced: rows 0, 8, ..; 4, 12, ..; 2, 6, ..; 1, 3, ..
                rows = np.r_[0:h:8, 4:h:8, 2:h:4, 1:h:2]
                index, passed = np.empty_like(index), index
                index[rows] = passed
            grey &= bool((palette[:, :1] == palette).all())
            pictures.append((left, top, w, h, index, palette, *control))
            control = (0, 0, None)
        else:
            raise ValueError("an unknown block")
    depth = 1 if grey else 3
    canvas, frames = np.zeros((height, width, depth), np.uint8), []
    for left, top, w, h, index, palette, disposal, delay, clear in pictures:
        w, h = min(w, width - left), min(h, height - top)
        index, area = index[:h, :w], (slice(top, top + h), slice(left, left + w))
        before = canvas[area].copy() if disposal == 3 else None
        drawn = palette[np.minimum(index, len(palette) - 1)][..., :depth]
        seen = index != clear if clear is not None else None
        if seen is None:
            canvas[area] = drawn
        else:
            canvas[area][seen] = drawn[seen]
        colours = drawn.reshape(-1, depth) if seen is None else drawn[seen]
        bins = colours[:, 0] >> 4 if grey else (colours[:, 0] >> 6) * 16 + (colours[:, 1] >> 6) * 4 + (colours[:, 2] >> 6)
        frames.append({"left": left, "top": top, "width": w, "height": h, "delay_ms": delay, "mode": "L" if grey else "RGB", "pixels": canvas.tobytes(), "drawn": canvas[area].tobytes(), "histogram": np.bincount(bins, minlength=16 if grey else 64).tolist()})
        if disposal == 2:
            canvas[area] = 0
        elif disposal == 3:
            canvas[area] = before
    return frames


FRAMES = "array<struct<left: int, top: int, width: int, height: int, delay_ms: int, mode: string, pixels: binary, histogram: array<int>>>"


def store_payloads(rows: DataFrame, frame_rows: int = 128) -> DataFrame:
    """(doc_id, n_bytes, media): rows (doc_id, payload) as GIFs of 576 samples a row and at most frame_rows rows a frame.

    The payload gets bytes 255 up to a positive multiple of 576. A null payload is empty."""

    def run(batches):
        for batch in batches:
            payloads = batch.column(1).to_pylist()
            for at in range(0, len(payloads), 256):
                media, sizes = [], []
                for p in payloads[at : at + 256]:
                    p = p or b""
                    full = np.frombuffer(p + bytes([_PAD]) * (-len(p) % ROW if p else ROW), np.uint8).reshape(-1, ROW)
                    media.append(encode_gif([full[i : i + frame_rows] for i in range(0, len(full), frame_rows)]))
                    sizes.append(len(p))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 256), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, media binary")


def media_frames(rows: DataFrame, canvas: bool = True, joined: bool = False) -> DataFrame:
    """(doc_id, n_bytes, media, frames): decodes each GIF into its timed frames with their histograms.

    With canvas, a frame's pixels are the whole canvas; else the drawn area alone. With joined, payload holds the drawn
    areas of all frames one after the other, and the frames hold no pixels. Null media give null frames."""
    fields = pa.list_(pa.struct([("left", pa.int32()), ("top", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("delay_ms", pa.int32()), ("mode", pa.string()), ("pixels", pa.binary()), ("histogram", pa.list_(pa.int32()))]))
    what = "pixels" if canvas else "drawn"

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                decoded = [None if m is None else decode_gif(m) for m in part.column(2).to_pylist()]
                named = ("left", "top", "width", "height", "delay_ms", "mode", "histogram")
                frames = [fs and [{**{k: f[k] for k in named}, "pixels": None if joined else f[what]} for f in fs] for fs in decoded]
                payload = [pa.array([fs and b"".join(f["drawn"] for f in fs) for fs in decoded], pa.binary())] if joined else []
                yield pa.RecordBatch.from_arrays([*part.columns[:3], pa.array(frames, fields), *payload], names=["doc_id", "n_bytes", "media", "frames", "payload"][: 4 + joined])

    return rows.mapInArrow(run, f"doc_id long, n_bytes long, media binary, frames {FRAMES}{', payload binary' * joined}")


def text_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media, frames, payload) of every row's text: stored as a GIF, read back and joined again.

    A null or empty text gives one row of padding. Repeated rows are each stored; a null id stays null; an empty table
    gives an empty one; other columns are ignored. A very long text is encoded and decoded in one task, frame by frame."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload"))
    return media_frames(store_payloads(rows), joined=True)


def histogram_feature():
    """The frames' grey histograms summed and joined by commas, with the number of frames and their time in front."""
    total = F.aggregate("frames", F.array_repeat(F.lit(0), 16), lambda acc, f: F.zip_with(acc, f["histogram"], lambda a, b: a + b))
    time = F.aggregate("frames", F.lit(0), lambda acc, f: acc + f["delay_ms"])
    return F.concat_ws(":", F.size("frames"), time, F.array_join(F.transform(total, lambda x: x.cast("string")), ","))
