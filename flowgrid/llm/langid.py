"""Language identification by prediction by partial matching.

For every language a variable-order tree of byte contexts (up to ``ORDER`` bytes) is counted once and frozen. A
byte's code length is the one of the longest context that has seen it; on the way down each known context that
hasn't adds its escape. The language with the shortest code for the whole text wins. Code lengths are kept as
integers (1/4096 bit), so sums don't depend on their order.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.shared import bounded_sample, pick
from flowgrid.llm.tokens import in_batches

#: Bytes of context at most.
ORDER = 4
#: Training documents taken for each language at most: those of least hash among the eligible ones.
PER_LANGUAGE = 400
#: One bit in the integers that code lengths are kept in.
BIT = 4096
UNKNOWN = "und"
OUT = "doc_id long, held_out boolean, lang_pred string, score double"
_LETTER = re.compile(r"[^\W\d_]")  # or a numeral that is no digit
_EMPTY = np.uint64(2**64 - 1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


class KeyTable:
    """Open addressing over unsigned keys, looked up a whole array at a time."""

    def __init__(self, keys: np.ndarray):
        bits = max(8, int(np.ceil(np.log2(max(1, len(keys))))) + 2)
        self.shift, self.mask = np.uint64(64 - bits), np.int64((1 << bits) - 1)
        self.key, self.row = np.full(1 << bits, _EMPTY, np.uint64), np.full(1 << bits, -1, np.int32)
        rows, at = np.arange(len(keys), dtype=np.int32), self._home(keys)
        while len(rows):  # each round the first key for a free slot gets it, the others move on by one
            free = self.row[at] < 0
            slot, first = np.unique(at[free], return_index=True)
            won = np.flatnonzero(free)[first]
            self.key[slot], self.row[slot] = keys[rows[won]], rows[won]
            rest = np.ones(len(rows), bool)
            rest[won] = False
            rows, at = rows[rest], (at[rest] + 1) & self.mask

    def _home(self, keys):
        return ((keys * _MIX) >> self.shift).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Each key's row, or -1."""
        at = self._home(keys)
        got = self.key[at]
        out = np.where(got == keys, self.row[at], np.int32(-1))
        open_ = np.flatnonzero((got != keys) & (got != _EMPTY))
        while len(open_):
            at[open_] = (at[open_] + 1) & self.mask
            got = self.key[at[open_]]
            hit = got == keys[open_]
            out[open_[hit]] = self.row[at[open_[hit]]]
            open_ = open_[~hit & (got != _EMPTY)]
        return out


def _bytes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All texts in lower case as bytes, ``ORDER`` blanks before each; where each begins and ends."""
    coded = [t.lower().encode("utf-8", "replace") for t in texts]
    size = np.fromiter(map(len, coded), np.int64, len(coded))
    pad = b" " * ORDER
    begin = np.cumsum(size + ORDER) - size
    return np.frombuffer(pad + pad.join(coded), np.uint8), begin, begin + size


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """The n bytes that end at each place from ORDER on, as one number."""
    out = np.zeros(len(data) - ORDER, np.uint64)
    for k in range(n):
        out = (out << np.uint64(8)) | data[ORDER - n + 1 + k : len(data) - n + 1 + k]
    return out


class PPM:
    """Frozen context trees of several languages. ``texts``: language to its training texts."""

    def __init__(self, texts: dict[str, list[str]]):
        self.languages = sorted(texts)
        data = {lang: _bytes(texts[lang]) for lang in self.languages}
        self.tables: list[tuple[KeyTable, np.ndarray]] = []  # by order: byte strings with their code lengths
        self.escapes: list[tuple[KeyTable, np.ndarray]] = []  # by order: contexts with their escapes
        for order in range(ORDER + 1):
            counted = []
            for lang in self.languages:
                d, begin, end = data[lang]
                inside = np.concatenate([np.arange(a, b) for a, b in zip(begin, end)]) - ORDER if len(begin) else np.zeros(0, np.int64)
                counted.append(np.unique(_grams(d, order + 1)[inside], return_counts=True))
            keys = np.unique(np.concatenate([k for k, _ in counted])) if counted else np.zeros(0, np.uint64)
            contexts = np.unique(keys >> np.uint64(8))
            cost, escape = np.zeros((len(keys), len(self.languages)), np.int32), np.zeros((len(contexts), len(self.languages)), np.int32)
            of = np.searchsorted(contexts, keys >> np.uint64(8))
            for j, (k, n) in enumerate(counted):
                c = np.zeros(len(keys))
                c[np.searchsorted(keys, k)] = n
                total, kinds = np.bincount(of, c, len(contexts)), np.bincount(of, c > 0, len(contexts))
                known = total > 0
                escape[known, j] = np.rint(-BIT * np.log2(kinds[known] / (total + kinds)[known]))
                lower = self._lower(order, keys, j) + escape[of, j]
                with np.errstate(divide="ignore", invalid="ignore"):
                    cost[:, j] = np.where(c > 0, np.rint(-BIT * np.log2(c / (total + kinds)[of])), lower)
            self.tables.append((KeyTable(keys), cost))
            self.escapes.append((KeyTable(contexts), escape))

    def _lower(self, order: int, keys: np.ndarray, j: int) -> np.ndarray:
        if not order:
            return np.full(len(keys), 8 * BIT, np.int32)  # below all contexts every byte is as likely
        table, cost = self.tables[order - 1]
        return cost[table.find(keys & np.uint64((1 << 8 * order) - 1)), j]

    def code_lengths(self, texts: list[str]) -> np.ndarray:
        """Texts by languages: the exact code length of each whole text, in 1/4096 bit."""
        out = np.zeros((len(texts), len(self.languages)), np.int64)
        data, begin, end = _bytes(texts)
        if len(data) == ORDER * len(texts) or not self.languages:
            return out
        keys = _grams(data, ORDER + 1)
        table, cost = self.tables[ORDER]
        row = table.find(keys)
        each = cost[np.maximum(row, 0)]
        todo = np.flatnonzero(row < 0)
        each[todo] = 0
        for order in range(ORDER, -1, -1):
            if not len(todo):
                break
            contexts, escape = self.escapes[order]
            table, cost = self.tables[order]
            own = keys[todo] & np.uint64((1 << 8 * (order + 1)) - 1)
            row = table.find(own)
            each[todo[row >= 0]] += cost[row[row >= 0]]
            todo, own = todo[row < 0], own[row < 0]
            at = contexts.find(own >> np.uint64(8))
            each[todo[at >= 0]] += escape[at[at >= 0]]
        each[todo] += 8 * BIT
        full = np.flatnonzero(end > begin)
        bounds = np.stack([begin[full], end[full]], 1).ravel() - ORDER
        padded = np.concatenate([each, np.zeros((1, each.shape[1]), np.int32)])
        out[full] = np.add.reduceat(padded, bounds, axis=0, dtype=np.int64)[::2]
        return out


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE) -> DataFrame:
    """lang, h (a hash) and text of at most ``per_language`` documents of each language whose crc32(doc_id) mod 3 isn't 1."""
    rows = pick(docs, "doc_id", "text", "lang").filter((F.crc32(F.col("doc_id").cast("string")) % 3 != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return bounded_sample(rows, None, "lang", per_language)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> PPM:
    """Count and freeze the trees of all languages on a bounded sample of labelled documents."""
    texts: dict[str, list[str]] = {}
    for r in sorted(training_sample(docs, per_language).toLocalIterator(), key=lambda r: r.h):
        texts.setdefault(r.lang, []).append(r.text)
    return PPM(texts)


def identify(docs: DataFrame, model: PPM) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every whole text; only the text is looked at.

    score is the winner's share of the probability that the code lengths give all languages. Texts that are null,
    empty or without a letter are ``und`` with score 0, as is everything when there was nothing to learn from.
    Equal code lengths go to the language that is first by name. held_out is false for a null doc_id; repeated
    rows are kept; extra columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size follows the bounded training sample

    def run(batches):
        ppm = shared.value
        for pdf in batches:
            texts = [t if isinstance(t, str) and any(m[0].isalpha() for m in _LETTER.finditer(t)) else "" for t in pdf.text]
            for lo, hi in in_batches(texts, 1_000_000):
                part, bits = pdf.iloc[lo:hi], ppm.code_lengths(texts[lo:hi]) / BIT
                known = np.array([bool(t) and bool(ppm.languages) for t in texts[lo:hi]])
                if ppm.languages:
                    share = 1 / np.exp2(np.maximum(bits.min(1, keepdims=True) - bits, -1000)).sum(1)
                    best = np.array(ppm.languages, object)[bits.argmin(1)]
                else:
                    share, best = np.zeros(hi - lo), np.full(hi - lo, UNKNOWN, object)
                yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64"), "held_out": part.held_out, "lang_pred": np.where(known, best, UNKNOWN), "score": np.where(known, share, 0.0)})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInPandas(run, OUT)
