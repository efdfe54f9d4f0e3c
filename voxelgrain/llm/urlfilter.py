"""URL rules as globs, all matched at once by a bit-parallel automaton."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class GlobAutomaton:
    """Shift-And over several 64-bit words: one bit for each state of each glob, all globs side by side.

    ``*`` stands for any characters but ``/``, ``**`` for any at all, ``?`` for one that isn't ``/``; a glob must fit
    the whole text. State j of a glob means that its first j signs are matched. A star adds no state: it lets the
    state stay where it is. match() steps through the columns of a batch of texts, so each step is a few operations
    on whole arrays."""

    def __init__(self, globs: list[str]):
        self.n = len(globs)
        states, stays = [], []  # of each glob: the signs to get to states 1.., and what each state may stay on
        for glob in globs:
            data, signs, stay, i = glob.encode(), [], [0], 0
            while i < len(data):
                if data[i : i + 2] == b"**":
                    stay[-1], i = 2, i + 2
                elif data[i : i + 1] == b"*":
                    stay[-1], i = max(stay[-1], 1), i + 1
                else:
                    signs.append(None if data[i : i + 1] == b"?" else data[i])
                    stay.append(0)
                    i += 1
            states.append(signs)
            stays.append(stay)
        total = sum(len(s) + 1 for s in states)
        self.words = max(1, -(-total // 64))
        enter, hold = [0] * 256, [0] * 256
        first = last = bit = 0
        self.accept = []
        slash = ord("/")
        for signs, stay in zip(states, stays, strict=True):
            first |= 1 << bit
            for j, kind in enumerate(stay):
                for c in range(256):
                    if kind == 2 or kind == 1 and c != slash:
                        hold[c] |= 1 << bit + j
            for j, sign in enumerate(signs):
                for c in [c for c in range(256) if c != slash] if sign is None else [sign]:
                    enter[c] |= 1 << bit + j + 1
            bit += len(signs) + 1
            self.accept.append(bit - 1)
        split = lambda x: [x >> 64 * w & (1 << 64) - 1 for w in range(self.words)]
        self.first = np.array(split(first), np.uint64)
        self.enter = np.array([split(x) for x in enter], np.uint64)
        self.hold = np.array([split(x) for x in hold], np.uint64)

    def match(self, texts: list[bytes]) -> np.ndarray:
        """True at [i, g] where glob g fits text i."""
        out = np.zeros((len(texts), self.n), bool)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-sizes, kind="stable")
        sizes, texts = sizes[order], [texts[i] for i in order]
        flat, starts = np.frombuffer(b"".join(texts), np.uint8), np.r_[0, np.cumsum(sizes)[:-1]] if len(texts) else []
        state = np.tile(self.first, (len(texts), 1))
        for t in range(int(sizes[0]) if len(texts) else 0):
            live = int(np.searchsorted(-sizes, -t, "left"))  # texts longer than t come first
            c, s = flat[starts[:live] + t], state[:live]
            up = s << np.uint64(1)
            up[:, 1:] |= s[:, :-1] >> np.uint64(63)
            state[:live] = up & self.enter[c] | s & self.hold[c]
        for g, bit in enumerate(self.accept):
            out[order, g] = state[:, bit // 64] >> np.uint64(bit % 64) & np.uint64(1) == 1
        return out


def url_host(url: Column) -> Column:
    """What stands after the first ``://`` up to ``/``, ``?``, ``#`` or the end, with A-Z in lower case; else empty."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_path(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def rule_globs(rule: str) -> list[str]:
    """The globs of a rule like ``example.com/en/``: its host and all subdomains, paths that start with its path."""
    host, slash, path = rule.partition("/")
    tail = f"{host}{slash}{path}**"
    return [tail, f"*.{tail}"]


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]], globs: list[tuple[str, str]] = (), default: str = "allow", id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(page_id, host, path, rule, verdict) of every row.

    rules are (verdict, host/path); the longest that fits decides, and is named in rule. Where none fits, rule is null
    and the verdict is that of the first fitting glob of ``globs`` (verdict, glob over host and path), else
    ``default``. Rules' letters are plain text apart from ``*`` and ``?``.

    A null url, and one without ``://``, has an empty host and path, which no rule fits. Repeated rows are each judged;
    an empty table gives an empty one; other columns are ignored."""
    rules = sorted(rules, key=lambda r: -len(r[1]))
    every = [g for _, rule in rules for g in rule_globs(rule)] + [g for _, g in globs]
    automaton = GlobAutomaton(every)
    names, verdicts = [r for _, r in rules], [v for v, _ in rules] + [v for v, _ in globs] + [default]

    def run(batches):
        for batch in batches:
            page_id, host, path = batch.columns[:3]
            for at in range(0, batch.num_rows, 4096):
                h, p = host.slice(at, 4096).to_pylist(), path.slice(at, 4096).to_pylist()
                fits = automaton.match([f"{a}{b}".encode() for a, b in zip(h, p, strict=True)])
                k = 2 * len(names)
                fits = np.c_[fits[:, 0:k:2] | fits[:, 1:k:2], fits[:, k:], np.ones(len(h), bool)]
                won = fits.argmax(1).tolist()
                rule = [names[i] if i < len(names) else None for i in won]
                yield pa.RecordBatch.from_arrays([page_id.slice(at, 4096), pa.array(h, pa.string()), pa.array(p, pa.string()), pa.array(rule, pa.string()), pa.array([verdicts[i] for i in won], pa.string())], names=["page_id", "host", "path", "rule", "verdict"])

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    return rows.mapInArrow(run, "page_id long, host string, path string, rule string, verdict string")
