"""Toxicity by compression distance: how much shorter windows get with a toxic dictionary besides an ordinary one."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out

#: Signs of ASCII other than letters and digits count as spaces; letters in other scripts stay.
_PLAIN = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def windows(text: str | None, size: int, start: int = 5) -> list[bytes]:
    """The whole text's words, in lower case and with a space before and after, in windows of about ``size`` bytes.

    Each word follows its own first ``start`` letters in upper case, so that a match tells the beginning of a word from
    its inside. A window ends at the last space within the size, so it holds whole words; a longer word is cut."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_PLAIN).decode("utf-8", "surrogatepass").split()
    data = b" " + " ".join([w[:start].upper() + w for w in words]).encode("utf-8", "surrogatepass") + b" "
    out, i, n = [], 0, len(data) - 1
    while i < n:
        j = n if i + size >= n else data.rfind(b" ", i + 1, i + size)
        if j > 0:
            out.append(data[i : j + 1])
        else:
            j = i + size
            out.append(data[i:j])
        i = j
    return out


def _grams(data: bytes, n: int) -> np.ndarray:
    """All n-byte strings of data as integers."""
    a, out = np.frombuffer(data, np.uint8).astype(np.uint64), np.zeros(max(0, len(data) - n + 1), np.uint64)
    for i in range(n):
        out = out << np.uint64(8) | a[i : i + len(out)]
    return out


def unmatched(data: bytes, known: np.ndarray, n: int) -> bytes:
    """The parts of words in which zstandard finds no match of n bytes in a dictionary; known are the dictionary's _grams."""
    grams = _grams(data, n)
    if not len(grams) or not len(known):
        return data
    spaces = np.append(0, np.cumsum(np.frombuffer(data, np.uint8) == 32))
    within = spaces[n - 1 : n - 1 + len(grams)] == spaces[1 : 1 + len(grams)]
    new = within & (known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] != grams)
    turns = np.diff(np.r_[0, new.astype(np.int8), 0])
    return b"\0\0".join(data[i : j + n - 1] for i, j in zip(np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), strict=True))


def train_dictionary(samples: list[bytes], size: int, segment: int, seed: int = 1) -> bytes:
    """A dictionary of about size bytes trained by zstandard; of too few samples, their own last bytes."""
    import zstandard

    samples = [samples[i] for i in np.random.default_rng(seed).permutation(len(samples)) if len(samples[i]) >= 8]
    try:
        return zstandard.train_dictionary(size, samples, k=segment, d=8, threads=1).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


class CompressionModel:
    """Zstandard dictionaries trained on ordinary text and on toxic text, in pairs, and calibrated thresholds.

    The ordinary one of a pair is trained on windows of the ordinary class. The toxic one is trained on what it leaves
    unmatched in the toxic texts, one sample a text, so that it isn't filled with what both classes share. A window is
    compressed with the ordinary dictionary alone and with both; its gain is by how many bytes the toxic one shortens
    it. ``scales`` holds the bytes of each pair: beside a large ordinary dictionary only what ordinary text never says
    gains, beside a small one what it says rarely.

    How many windows reach each of ``steps``, in all and for each window, is weighed by a logistic regression. Its
    features come from dictionaries trained on the other half of the sample, as a text's own dictionary would flatter
    it. ``odds`` is how many toxic texts there are to one ordinary text, where the sample has another mixture."""

    def __init__(self, toxic: list[str], ordinary: list[str], odds: float | None = None, window: int = 96, start: int = 5, steps: tuple[int, ...] = (2, 3, 4, 5, 6, 7, 8, 10, 12), min_match: int = 7, scales: tuple[tuple[int, int], ...] = ((32_768, 4096), (262_144, 2048)), most_train: int = 8_000_000):
        self.window, self.start, self.steps, self.min_match, self.scales, self.most_train = window, start, steps, min_match, scales, most_train
        parts = [[windows(t, window, start) for t in ts] for ts in (ordinary, toxic)]
        x: list[np.ndarray] = []
        y: list[int] = []
        for half in (0, 1):
            self._train(*([p for i, p in enumerate(ps) if i % 2 != half] for ps in parts))
            for label, ps in enumerate(parts):
                x += [self._features(p) for i, p in enumerate(ps) if i % 2 == half]
                y += [label] * (len(x) - len(y))
        self._train(*parts)
        self._calibrate(np.array(x), np.array(y))
        if odds and toxic and ordinary:
            self.weights[-1] += math.log(odds * len(ordinary) / len(toxic))

    def _train(self, ordinary: list[list[bytes]], toxic: list[list[bytes]]) -> None:
        # At most most_train bytes train an ordinary dictionary: texts as they come, in the order of a hash.
        samples = [w for p in ordinary for w in p][: self.most_train // self.window]
        self.dictionaries = []
        for ordinary_bytes, toxic_bytes in self.scales:
            plain = train_dictionary(samples, ordinary_bytes, 32)
            known = np.unique(_grams(plain, self.min_match))
            self.dictionaries.append((plain, train_dictionary([unmatched(b"".join(p), known, self.min_match) for p in toxic], toxic_bytes, 12)))
        self.__dict__.pop("_made", None)

    def _compressors(self):
        import zstandard

        if "_made" not in self.__dict__:
            out = []
            for plain, toxic in self.dictionaries:
                # The last bytes of a dictionary aren't found by zstandard.
                for data in (plain, plain + toxic + b" " * 16):
                    # The fast strategy with a target length leaves literals as they are, so that matches alone change a length.
                    params = zstandard.ZstdCompressionParameters(strategy=zstandard.STRATEGY_FAST, target_length=1, min_match=self.min_match, window_log=19, hash_log=18, write_content_size=False, write_checksum=False, write_dict_id=False)
                    d = zstandard.ZstdCompressionDict(data or b" ", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                    d.precompute_compress(compression_params=params)
                    out.append(zstandard.ZstdCompressor(dict_data=d, compression_params=params).compress)
            self._made = list(zip(out[::2], out[1::2], strict=True))
        return self._made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_made"}

    def _features(self, parts: list[bytes]) -> np.ndarray:
        """Of a text's windows, by pair: the two largest gains, how many reach each step, in all and for each window, and their mean."""
        out, n = [math.log1p(len(parts))], max(1, len(parts))
        for plain, both in self._compressors():
            gains = np.fromiter((len(plain(w)) - len(both(w)) for w in parts), np.int64, len(parts))
            top = sorted([0, 0, *gains[gains > 0].tolist()])[-2:]
            reach = np.array([(gains >= k).sum() for k in self.steps], float)
            out += [*top, *np.log1p(reach), *np.sqrt(reach / n), gains.sum() / n]
        return np.array(out)

    def _calibrate(self, x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> None:
        k = 1 + len(self.scales) * (3 + 2 * len(self.steps))
        if not len(x):
            x, y = np.zeros((1, k)), np.zeros(1, int)
        self.mean, self.scale = x.mean(0), x.std(0) + 1e-6
        z = np.c_[(x - self.mean) / self.scale, np.ones(len(x))]
        w = np.zeros(k + 1)
        for _ in range(30):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            w -= np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + ridge * np.eye(k + 1), z.T @ (p - y) + ridge * w)
        self.weights = w

    def score(self, text: str | None) -> float:
        z = (self._features(windows(text, self.window, self.start)) - self.mean) / self.scale
        return float(1 / (1 + math.exp(-max(-30.0, min(30.0, float(z @ self.weights[:-1] + self.weights[-1]))))))


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 2500, most_chars: int = 4_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", **options) -> CompressionModel:
    """A model from labelled rows outside the held-out fifth.

    The sample is bounded, for training alone: at most most_rows texts of each class, those with the smallest hash of the id,
    of each at most most_chars characters, and of the ordinary windows at most most_train bytes. The odds are those of
    all labelled rows.

    Rows without a label, id or text are left out; a document labelled twice counts as often."""
    label = labels.select(F.col(id_col).alias("i"), F.col(label_col).cast("int").alias("y")).where("y in (0, 1) and i is not null").where(~held_out("i"))
    label = label.withColumn("h", F.xxhash64("i")).distinct()
    all_rows = {r.y: r.n for r in label.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    few = label.where("y = 0").orderBy("h", "i").limit(most_rows).unionByName(label.where("y = 1").orderBy("h", "i").limit(most_rows))
    rows = docs.select(F.col(id_col).alias("i"), F.substring(F.col(text_col), 1, most_chars).alias("t")).where("t is not null")
    found = rows.join(F.broadcast(few), "i")  # an id may stand in any number of rows
    texts = {y: [r.t for r in found.where(F.col("y") == y).orderBy("h", "i", "t").limit(most_rows).select("t").collect()] for y in (0, 1)}
    return CompressionModel(texts[1], texts[0], all_rows.get(1, 0) / max(1, all_rows.get(0, 0)), **options)


def toxicity_score(model: CompressionModel):
    """A column function: the score, 0 to 1, of a text column."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series([model.score(t) for t in texts], dtype="float64")

    return score


def score_toxicity(docs: DataFrame, model: CompressionModel, threshold: float = 0.5, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row, from the whole text alone.

    Null and empty texts have the score of no windows; repeated rows agree; a null id counts as not held out; an empty
    table gives an empty one; other columns are ignored. A very long text is scored in one task, in some 30 bytes of
    memory a word."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), toxicity_score(model)(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def drop_toxic(docs: DataFrame, model: CompressionModel, threshold: float = 0.5, text_col: str = "text") -> DataFrame:
    """docs without the rows whose score reaches the threshold; all columns stay as they are, whatever their names.

    Null and empty texts have the score of no windows; repeated rows stay or go together; an empty table gives an empty
    one."""
    return docs.where(toxicity_score(model)(F.col(text_col)) < threshold)
