"""Token ids of whole texts by a ready-made tokenizer, with the ids of the words met so far remembered.

Texts are cut where no token can reach across, on whole Arrow buffers at once; what stands between two cuts is a
piece. Only pieces that a worker process hasn't met are given to the tokenizer."""

from __future__ import annotations

import itertools
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Classes of bytes: unknown (never cut beside it), space, other white space, letter, digit, apostrophe, other sign,
# part of a character above ASCII, and the white space that stands alone between characters that are none.
_UNKNOWN, _SPACE, _BLANK, _LETTER, _DIGIT, _QUOTE, _SIGN, _HIGH, _LONE_SPACE, _LONE_BLANK = range(10)
_KINDS = 10


def _byte_classes() -> np.ndarray:
    table = np.full(256, _UNKNOWN, np.uint8)
    for c in range(33, 127):
        table[c] = _LETTER if chr(c).isalpha() else _DIGIT if chr(c).isdigit() else _QUOTE if chr(c) == "'" else _SIGN
    table[[9, 10, 11, 12, 13]] = _BLANK
    table[32] = _SPACE
    table[128:] = _HIGH
    return table


def _pairs(*cuts: tuple[list[int], list[int]]) -> np.ndarray:
    table = np.zeros(_KINDS * _KINDS, bool)
    for left, right in cuts:
        for a in left:
            for b in right:
                table[a * _KINDS + b] = True
    return table


_ASCII = [_LETTER, _DIGIT, _QUOTE, _SIGN]
_SEEN = [*_ASCII, _HIGH]
_WORDS = [([_LETTER], [_DIGIT, _QUOTE, _SIGN]), ([_DIGIT], [_LETTER, _QUOTE, _SIGN]), ([_SIGN], [_LETTER, _DIGIT]), ([_QUOTE], [_DIGIT])]
#: Where to cut, by the classes of the byte before and the byte after. A run of signs is one word, and a letter after
#: an apostrophe may belong to it ('s), so these stay together.
_CUTS = {
    # Spaces are dropped, each digit is a word.
    "drop": _pairs(*_WORDS, ([_DIGIT], [_DIGIT])),
    # A lone space belongs to what follows; in other runs of white space nothing is cut.
    "bytes": _pairs(*_WORDS, (_SEEN, [_LONE_SPACE, _LONE_BLANK]), ([_LONE_BLANK], _SEEN)),
}
_CLASS = _byte_classes()
_LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
#: First bytes of the characters U+0080 to U+02FF, which no letter before them is combined with, and ASCII.
_NOT_COMBINING = np.array([c < 0x80 or 0xC2 <= c <= 0xCB for c in range(256)])
#: The byte-level pre-tokenizers' signs: visible bytes of Latin-1 stand for themselves, the others for U+0100 on, in order.
_SEEN_BYTES = [*range(33, 127), *range(161, 173), *range(174, 256)]
_VISIBLE = {b: chr(b) for b in _SEEN_BYTES} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _SEEN_BYTES)}
#: Below it, letters are the same in every version of Unicode in use, and each has one character in lower case (but U+0130).
_FIRST_PHONETIC = "\u0250"


def cut_mode(tokenizer) -> str:
    """How texts may be cut for a tokenizer: ``bytes``, ``drop`` or, if its pre-tokenizer isn't one of the two, ``whole``."""
    d = json.loads(tokenizer.to_str())
    pre, norm = d["pre_tokenizer"] or {}, d["normalizer"] or {}
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in d["added_tokens"]) or (d["model"].get("dropout") or 0) > 0:
        return "whole"
    if pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"] and not norm:
        return "bytes"
    steps = pre.get("pretokenizers") or [{}]
    # The one pattern and the normalizers for which the cuts of "drop" are right.
    words = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    split = steps[0].get("pattern") == {"Regex": words} and steps[0].get("behavior") == "Removed" and steps[0].get("invert")
    bytes_after = len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
    if split and bytes_after and [n["type"] for n in norm.get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]:
        return "drop"
    return "whole"


def _mark_wide_spaces(data: np.ndarray, kind: np.ndarray) -> None:
    """Gives white space above ASCII the class unknown: U+0085, 00A0, 1680, 2000-200A, 2028, 2029, 202F, 205F, 3000."""
    for lead in (0xC2, 0xE1, 0xE2, 0xE3):
        at = np.flatnonzero(data == lead)
        at = at[at + (1 if lead == 0xC2 else 2) < len(data)]
        if not len(at):
            continue
        one, two = data[at + 1], data[np.minimum(at + 2, len(data) - 1)]
        if lead == 0xC2:
            at = at[(one == 0x85) | (one == 0xA0)]
        elif lead == 0xE1:
            at = at[(one == 0x9A) & (two == 0x80)]
        elif lead == 0xE2:
            at = at[(one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF)) | (one == 0x81) & (two == 0x9F)]
        else:
            at = at[(one == 0x80) & (two == 0x80)]
        for i in range(2 if lead == 0xC2 else 3):
            kind[at + i] = _UNKNOWN


class Encoder:
    """Ids of texts, equal to ``Tokenizer.encode(text, add_special_tokens=False).ids`` of each whole text.

    Texts that hold one of the tokenizer's added tokens are encoded whole; so are all texts if its pre-tokenizer is
    another than the two that cut_mode() knows. What is remembered is bounded: beyond ``remember`` pieces, or as many
    times 8 ids, all is forgotten and learned again."""

    def __init__(self, path: str, remember: int = 200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.mode = cut_mode(self.tokenizer)
        self.added = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.remember = remember
        self._forget()

    def _forget(self) -> None:
        self.known: dict[bytes, int] = {}
        self.flat = np.zeros(1 << 16, np.uint32)
        self.ends = np.zeros(1 << 14, np.int64)  # of each known piece: where its ids end in flat

    def _ids(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each piece. Plain words go to the model at once: normalizer and pre-tokenizer would leave each as one word."""
        spaced, lower = self.mode == "bytes", self.mode == "drop"
        model, out, rest = self.tokenizer.model.tokenize, [], []
        for i, p in enumerate(pieces):
            t = p.decode("utf-8", "replace")
            lead = spaced and t[:1] == " "
            word = t[1:] if lead else t.lower() if lower else t
            if self.mode != "whole" and len(t) <= 64 and word.isalpha() and (word.isascii() or max(t) < _FIRST_PHONETIC and unicodedata.is_normalized("NFC", t)):
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_VISIBLE)
                out.append([x.id for x in model(f"{_VISIBLE[32]}{word}" if lead else word)])
            else:
                out.append(None)
                rest.append((i, t))
        for (i, _), x in zip(rest, self.tokenizer.encode_batch_fast([t for _, t in rest], add_special_tokens=False), strict=True):
            out[i] = x.ids
        return out

    def _learn(self, pieces: list[bytes]) -> None:
        for i in range(0, len(pieces), 10_000):
            lot = pieces[i : i + 10_000]
            got = self._ids(lot)
            k = len(self.known)
            sizes = np.fromiter(map(len, got), np.int64, len(got))
            at = int(self.ends[k - 1]) if k else 0
            need = at + int(sizes.sum())
            if need > len(self.flat):
                self.flat = np.concatenate([self.flat[:at], np.zeros(2 * need - at, np.uint32)])
            if k + len(lot) > len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends) + len(lot), np.int64)])
            self.flat[at:need] = np.fromiter(itertools.chain.from_iterable(got), np.uint32, need - at)
            self.ends[k : k + len(lot)] = at + np.cumsum(sizes)
            self.known.update(zip(lot, range(k, k + len(lot)), strict=True))

    def _pieces(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, whole: np.ndarray) -> tuple[pa.Array, np.ndarray]:
        """(pieces, number of pieces by text) of texts that aren't empty and stand side by side in data."""
        begin = np.zeros(len(data), bool)
        begin[starts] = True
        if self.mode != "whole":
            kind = _CLASS[data]
            _mark_wide_spaces(data, kind)
            keep_case = None
            if self.mode == "drop":
                blank = (kind == _SPACE) | (kind == _BLANK)
                for a, b in zip(starts[whole], ends[whole], strict=True):
                    blank[a:b] = False
                begin[1:] |= _CUTS["drop"][kind[:-1] * np.uint8(_KINDS) + kind[1:]] | blank[:-1]
                begin &= ~blank
                keep_case = whole
            else:
                seen = kind >= _LETTER
                lone = (kind == _SPACE) | (kind == _BLANK)
                lone[1:] &= seen[:-1]
                lone[:-1] &= seen[1:]
                lone[starts] = lone[ends - 1] = False
                kind[lone & (kind == _SPACE)] = _LONE_SPACE
                kind[lone & (kind == _BLANK)] = _LONE_BLANK
                begin[1:] |= _CUTS["bytes"][kind[:-1] * np.uint8(_KINDS) + kind[1:]]
            for a, b in zip(starts[whole], ends[whole], strict=True):
                begin[a + 1 : b] = False
            counts = np.add.reduceat(begin, starts, dtype=np.int64)
            if self.mode == "drop":
                lower = _LOWER[data]
                lower[:-1] = np.where(_NOT_COMBINING[data[1:]], lower[:-1], data[:-1])
                for a, b in zip(starts[keep_case], ends[keep_case], strict=True):
                    lower[a:b] = data[a:b]
                stay = ~blank
                data, begin = lower[stay], begin[stay]
        else:
            counts = np.ones(len(starts), np.int64)
        offsets = np.append(np.flatnonzero(begin), len(data)).astype(np.int32)
        return pa.Array.from_buffers(pa.binary(), len(offsets) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(data))]), counts

    def encode_lot(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts side by side, number of ids by text); text i is data[offsets[i]:offsets[i + 1]], in UTF-8."""
        sizes = np.zeros(len(offsets) - 1, np.int64)
        data = data[offsets[0] : offsets[-1]]
        full = np.flatnonzero(np.diff(offsets))
        if not len(full):
            return np.zeros(0, np.uint32), sizes
        if len(self.known) > self.remember or (len(self.known) and self.ends[len(self.known) - 1] > 8 * self.remember):
            self._forget()
        starts, ends = (offsets[full] - offsets[0]).astype(np.int64), (offsets[full + 1] - offsets[0]).astype(np.int64)
        whole = np.zeros(len(full), bool)
        raw = data.tobytes()
        if any(a in raw for a in self.added):
            whole = np.array([any(a in raw[s:e] for a in self.added) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)])
        pieces, counts = self._pieces(data, starts, ends, whole)
        coded = pieces.dictionary_encode()
        words = coded.dictionary.to_pylist()
        at = np.fromiter(map(self.known.get, words, itertools.repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(at < 0)
        if len(new):
            at[new] = len(self.known) + np.arange(len(new))
            self._learn([words[i] for i in new.tolist()])
        at = at[coded.indices.to_numpy(zero_copy_only=False)]
        stop = self.ends[at]
        n = stop - np.where(at > 0, self.ends[at - 1], 0)
        upto = np.cumsum(n)
        ids = self.flat[np.repeat(stop - upto, n) + np.arange(int(upto[-1]) if len(upto) else 0)]
        last = np.cumsum(counts)
        bounds = np.append(0, upto)
        sizes[full] = bounds[last] - bounds[last - counts]
        return ids, sizes


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def encode_column(path: str, texts: pa.Array, end_id: int | None = None, most_bytes: int = 1_000_000) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, ids side by side, number of ids by row) of a string column, in lots of about most_bytes, one text at least.

    Null is the empty text. With end_id, each row's ids end with it."""
    if texts.null_count:
        texts = texts.fill_null("")
    wide = pa.types.is_large_string(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(offsets, int(offsets[at]) + most_bytes, "right")) - 1)
        ids, sizes = encoder(path).encode_lot(data, offsets[at : to + 1])
        if end_id is not None:
            sizes = sizes + 1
            stops = np.cumsum(sizes) - 1
            out = np.empty(len(ids) + len(sizes), np.uint32)
            plain = np.ones(len(out), bool)
            plain[stops] = False
            out[plain], out[stops] = ids, end_id
            ids = out
        yield at, ids, sizes
        at = to


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
