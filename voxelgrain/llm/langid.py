"""Language by cross-parsing: the language whose text explains a document in the fewest phrases."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out


class SuffixAutomaton:
    """All substrings of a sequence of signs 2, 3, ..: what follows a state by a sign, 0 where nothing does.

    The ``dense`` most frequent signs have columns of a table; the others, of which large scripts have thousands, are
    looked up in a sorted list of (state, sign), which has three entries a training sign at most."""

    def __init__(self, signs: list[int], alphabet: int, dense: int = 96):
        link, size, move = [-1], [0], [{}]
        last = 0
        for c in signs:
            cur = len(size)
            size.append(size[last] + 1)
            link.append(0)
            move.append({})
            p = last
            while p >= 0 and c not in move[p]:
                move[p][c] = cur
                p = link[p]
            if p >= 0:
                q = move[p][c]
                if size[p] + 1 == size[q]:
                    link[cur] = q
                else:
                    twin = len(size)
                    size.append(size[p] + 1)
                    link.append(link[q])
                    move.append(dict(move[q]))
                    while p >= 0 and move[p].get(c) == q:
                        move[p][c] = twin
                        p = link[p]
                    link[q] = link[cur] = twin
            last = cur
        self.length, self.alphabet = len(signs), alphabet
        often = [c for c, _ in sorted(Counter(signs).items(), key=lambda x: (-x[1], x[0]))]
        #: Column of each sign: 0 for signs that aren't in the sequence, 1 for those in the list.
        self.column = np.zeros(alphabet, np.uint8)
        self.column[often[dense:]] = 1
        self.column[often[:dense]] = np.arange(2, 2 + len(often[:dense]))
        self.width = 2 + len(often[:dense])
        table = np.zeros((len(size), self.width), np.int32)
        rare: dict[int, int] = {}
        for s, m in enumerate(move):
            for c, to in m.items():
                if self.column[c] > 1:
                    table[s, self.column[c]] = to
                else:
                    rare[s * alphabet + c] = to
        self.flat = table.reshape(-1)
        self.keys = np.array(sorted(rare), np.int64)
        self.values = np.array([rare[k] for k in self.keys.tolist()], np.int64)

    def step(self, state: np.ndarray, signs: np.ndarray) -> np.ndarray:
        column = self.column[signs]
        to = self.flat[state * self.width + column].astype(np.int64)
        if len(self.keys):
            rare = np.flatnonzero(column == 1)
            if len(rare):
                key = state[rare] * self.alphabet + signs[rare]
                at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                to[rare] = np.where(self.keys[at] == key, self.values[at], 0)
        return to


class CrossParser:
    """A suffix automaton of each language's text, by which a text is parsed into longest matches, the phrases.

    Texts become signs: letters in lower case, each its own sign, and one sign for other characters and their runs. A
    letter that no language has is a phrase by itself. Of each text all characters are parsed, in stretches of
    ``stretch`` signs, all stretches of a batch side by side. phrases x log(length of the language's text) / signs
    estimates the entropy of the text given the language, so more text of a language doesn't favour it."""

    def __init__(self, texts: dict[str, list[str]], most_chars: int = 30_000, stretch: int = 192):
        self.languages = sorted(texts)
        self.stretch = stretch
        used = {}
        for name in self.languages:
            left = most_chars
            used[name] = []
            for t in texts[name]:
                if left <= 0:
                    break
                used[name].append(t[:left].lower())
                left -= len(t)
        letters = sorted({c for ts in used.values() for t in ts for c in t if c.isalpha()})
        #: 0 a character that is no letter, 1 a letter that isn't known, 2 a mark between documents.
        self.signs = {c: i + 3 for i, c in enumerate(letters)}
        self.automata = [SuffixAutomaton([s for t in used[name] for s in [*self.encode(t).tolist(), 2]], len(letters) + 3) for name in self.languages]

    def _map(self) -> np.ndarray:
        if "_lookup" not in self.__dict__:
            table = np.zeros(0x110000, np.int32)
            table[[i for i in range(0x110000) if chr(i).isalpha()]] = 1
            table[[ord(c) for c in self.signs]] = list(self.signs.values())
            self._lookup = table
        return self._lookup

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_lookup"}

    def encode(self, text: str) -> np.ndarray:
        signs = self._map()[np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        again = (signs[1:] == 0) & (signs[:-1] == 0)
        return signs[np.r_[True, ~again]] if len(signs) else signs

    def phrases(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(phrases by text and language, signs by text)."""
        coded = [self.encode(t) for t in texts]
        sizes = np.array([len(c) for c in coded], np.int64)
        cuts = -(-sizes // self.stretch)
        of = np.repeat(np.arange(len(texts)), cuts)
        counts = np.zeros((len(texts), len(self.languages)), np.int64)
        if len(of):
            grid = np.full((len(of), self.stretch), -1, np.int32)
            row = 0
            for c, k in zip(coded, cuts.tolist(), strict=True):
                if k:
                    grid[row : row + k].reshape(-1)[: len(c)] = c
                    row += k
            columns = np.ascontiguousarray(grid.T)
            lives = columns >= 0
            columns[~lives] = 0
            for i, automaton in enumerate(self.automata):
                # A phrase begins where none is open and where the open one can't go on.
                first = automaton.step(np.zeros(automaton.alphabet, np.int64), np.arange(automaton.alphabet))
                n, state = np.zeros(len(of), np.int64), np.zeros(len(of), np.int64)
                for signs, live in zip(columns, lives, strict=True):
                    to = automaton.step(state, signs)
                    lost = to == 0
                    n += ((state == 0) | lost) & live
                    state = np.where(lost & (state > 0), first[signs], to)
                counts[:, i] = np.bincount(of, n, len(texts)).astype(np.int64)
        return counts, sizes

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """(language, score) of each text; ``und`` with score 0 if no character is a letter.

        The score is by what share the best language's entropy is below the next one's: 0 at a tie."""
        whole = [t or "" for t in texts]
        counts, _ = self.phrases(whole)
        entropy = counts * np.log([max(2, a.length) for a in self.automata]) if self.automata else counts
        out = []
        for t, row in zip(whole, entropy, strict=True):
            if not self.languages or not any(map(str.isalpha, t)):
                out.append(("und", 0.0))
                continue
            best = int(row.argmin())
            others = np.delete(row, best)
            out.append((self.languages[best], 1.0 - float(row[best] / others.min()) if len(others) else 1.0))
        return out


def train(docs: DataFrame, most_rows: int = 60, most_chars: int = 30_000, text_chars: int = 2_000, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> CrossParser:
    """A parser from rows with a language outside the held-out fifth.

    The sample has three bounds, which hold for training alone: of each language at most most_rows texts, those with
    the least hash of the text in each of so many buckets by that hash; of each text its first text_chars characters;
    most_chars characters of a language in all. Short texts count like long ones. Ids, sources and lengths aren't used.
    Rows with null or empty text or null language are left out."""
    rows = docs.select(F.col(id_col).alias("i"), F.col(lang_col).alias("lang"), F.substring(F.col(text_col), 1, text_chars).alias("t")).where("lang is not null and length(t) > 0").where(~held_out("i")).select("lang", "t").withColumn("h", F.xxhash64("t"))
    picks = rows.groupBy("lang", F.pmod("h", F.lit(most_rows))).agg(F.min("h").alias("h")).select("lang", "h")
    few = rows.join(F.broadcast(picks), ["lang", "h"]).dropDuplicates(["lang", "h"])
    texts: dict[str, list[str]] = {}
    for r in few.orderBy("lang", "h").collect():  # at most most_rows x text_chars a language
        texts.setdefault(r.lang, []).append(r.t)
    return CrossParser(texts, most_chars)


def identify_languages(docs: DataFrame, parser: CrossParser, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row, from the whole text alone.

    Null texts and those without a letter are ``und`` with score 0; ties go to the first language in order; repeated
    rows agree; an empty table gives an empty one; other columns are ignored. A very long text is parsed in one task, in
    about 20 bytes of memory a character."""
    shared = docs.sparkSession.sparkContext.broadcast(parser)

    def run(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            lot, n, got = [], 0, []
            for t in texts:
                lot.append(t)
                n += len(t or "")
                if n > 1_000_000:
                    got += shared.value.predict(lot)
                    lot, n = [], 0
            got += shared.value.predict(lot) if lot else []
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([x[0] for x in got], pa.string()), pa.array([x[1] for x in got], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(id_col).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
