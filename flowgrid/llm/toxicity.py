"""Toxicity scores from a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as two vectors: one of the word itself, one made of its character 3- and 4-grams. A forward and
a backward gated unit read windows of ``WINDOW`` words that overlap by a quarter; attention pools a window, a logistic
output scores it, and a text's score is its highest window's. Every window of every text is scored.
"""

from __future__ import annotations

from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.shared import bounded_sample, pick
from flowgrid.llm.tokens import in_batches, text_batches

WINDOW, STRIDE = 32, 24
#: Rows of the word and character tables, numbers in a row, size of a gated unit's state.
WORD_ROWS, CHAR_ROWS, WIDE, STATE = 1 << 15, 1 << 15, 8, 8
#: Training texts that a word or character row must be in to be learned; others stay zero.
LEAST_TEXTS = 5
#: Labelled documents of each label used for training at most: those of least hash.
PER_LABEL = 1000
#: Windows whose states are held at once.
SLICE = 4096
STEPS, BATCH, THRESHOLD, SEED = 180, 48, 0.3, 7
EDGES = ".,;:!?|\"'()[]{}*#$%&<>-"
OUT = "doc_id long, held_out boolean, score double, predicted int"


def _sigmoid(x):
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Words:
    """The distinct words of some texts with their table rows, and the texts as numbers of words."""

    def __init__(self, texts: list[str]):
        split = [t.lower().split() for t in texts]
        self.count = np.fromiter(map(len, split), np.int64, len(split))
        at, seen = pd.factorize(np.array(list(chain.from_iterable(split)), object))
        cores, self.core = pd.factorize(np.array([w.strip(EDGES) or "#" for w in seen] or ["#"], object))
        self.index = cores[at] if len(at) else np.zeros(0, np.int64)
        core = [w.encode("utf-8", "replace") for w in self.core]
        self.word = (pd.util.hash_array(np.array(self.core, object), categorize=False) % WORD_ROWS).astype(np.int64)
        size = np.fromiter(map(len, core), np.int64, len(core))
        data = np.frombuffer(b"<" + b">><".join(core) + b">>", np.uint8).astype(np.uint32)
        begin = np.cumsum(size + 3) - size - 3
        p = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint32)
        tri = data[:-2] * p[0] ^ data[1:-1] * p[1] ^ data[2:] * p[2]
        four = tri[:-1] * np.uint32(31) ^ data[3:] * p[3]
        #: per word: its 3-grams, then its 4-grams
        self.grams = np.stack([2 * size + 1, begin, size], 1)
        n3, n4 = size + 1, size
        at3 = np.repeat(begin - (np.cumsum(n3) - n3), n3) + np.arange(n3.sum())
        at4 = np.repeat(begin - (np.cumsum(n4) - n4), n4) + np.arange(n4.sum())
        mix = lambda x: ((x ^ (x >> np.uint32(15))) * np.uint32(2246822519) >> np.uint32(17)).astype(np.int64) % CHAR_ROWS
        self.char3, self.char4, self.n3, self.n4 = mix(tri[at3]), mix(four[at4]), n3, n4

    def features(self, words: np.ndarray, chars: np.ndarray) -> np.ndarray:
        total = np.add.reduceat(chars[self.char3], np.cumsum(self.n3) - self.n3) + np.add.reduceat(chars[self.char4], np.cumsum(self.n4) - self.n4)
        return np.concatenate([words[self.word], total / (self.n3 + self.n4)[:, None].astype(np.float32)], 1)

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all windows (-1: past the end), the text of each, each text's number of windows."""
        n = np.maximum(1, -(-(self.count - WINDOW) // STRIDE) + 1)
        doc = np.repeat(np.arange(len(n)), n)
        start = (np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)) * STRIDE
        at = start[:, None] + np.arange(WINDOW)
        inside = at < self.count[doc][:, None]
        flat = (np.cumsum(self.count) - self.count)[doc][:, None] + at
        return np.where(inside, np.append(self.index, 0)[np.where(inside, flat, 0)], -1), doc, n


class Network:
    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        f = lambda *s: (r.standard_normal(s) * 0.3).astype(np.float32)
        h, d = STATE, 2 * WIDE
        self.p = {"word": np.zeros((WORD_ROWS, WIDE), np.float32), "char": np.zeros((CHAR_ROWS, WIDE), np.float32), "attend": f(2 * h), "out": f(2 * h), "bias": np.float32([-1.0])}
        for way in ("fw", "bw"):
            self.p |= {f"{way}_in": f(d, 3 * h), f"{way}_b": np.zeros(3 * h, np.float32), f"{way}_h": f(h, 3 * h)}

    def _read(self, way: str, projected: np.ndarray, win: np.ndarray, keep: list | None):
        """States after each word of each window; ``projected`` has a further row for places past the end."""
        h, u, B, T = STATE, self.p[f"{way}_h"], len(win), win.shape[1]
        state, states = np.zeros((B, h), np.float32), np.empty((T, B, h), np.float32)
        turned = np.ascontiguousarray(win.T)
        full = (turned >= 0).all(1)
        for t in range(T) if way == "fw" else range(T - 1, -1, -1):
            x, a = projected[turned[t]], state @ u
            x[:, : 2 * h] += a[:, : 2 * h]
            zr = _sigmoid(x[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(x[:, 2 * h :] + r * a[:, 2 * h :])
            new = n + z * (state - n)
            m = (turned[t] >= 0)[:, None]
            if not full[t]:
                new = np.where(m, new, state)
            if keep is not None:
                keep.append((t, state, z, r, n, a[:, 2 * h :], m))
            states[t] = state = new
        return states

    def forward(self, features: np.ndarray, win: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """The logit of each window."""
        states = []
        for way in ("fw", "bw"):
            projected = np.concatenate([features @ self.p[f"{way}_in"] + self.p[f"{way}_b"], np.zeros((1, 3 * STATE), np.float32)])
            if keep is not None:
                keep[way] = []
            states.append(self._read(way, projected, win, None if keep is None else keep[way]))
        both, m = np.concatenate(states, 2).transpose(1, 0, 2), win >= 0
        a = np.where(m, both @ self.p["attend"], -1e9)
        e = np.exp(a - a.max(1, keepdims=True)) * m
        w = e / (e.sum(1, keepdims=True) + np.float32(1e-9))
        pooled = np.einsum("bt,bth->bh", w, both, optimize=False)
        if keep is not None:
            keep |= {"both": both, "w": w, "pooled": pooled}
        return pooled @ self.p["out"] + self.p["bias"][0]

    def logits(self, words: Words, win: np.ndarray) -> np.ndarray:
        """The logit of each of any number of windows."""
        features = words.features(self.p["word"], self.p["char"])
        return np.concatenate([self.forward(features, win[k : k + SLICE]) for k in range(0, len(win), SLICE)])

    def gradients(self, words: Words, win: np.ndarray, label: np.ndarray) -> dict:
        p, keep, h = self.p, {}, STATE
        features = words.features(p["word"], p["char"])
        d = (_sigmoid(self.forward(features, win, keep)) - label)[:, None].astype(np.float32) / len(win)
        g = {"out": keep["pooled"].T @ d[:, 0], "bias": d.sum(0)}
        dpool = d * p["out"]
        both, w = keep["both"], keep["w"]
        dw = np.einsum("bh,bth->bt", dpool, both)
        da = w * (dw - (w * dw).sum(1, keepdims=True))
        g["attend"] = np.einsum("bt,bth->h", da, both)
        dboth = w[:, :, None] * dpool[:, None, :] + da[:, :, None] * p["attend"]
        dfeat = np.zeros_like(features)
        for k, way in enumerate(("fw", "bw")):
            u, dstates = p[f"{way}_h"], dboth[:, :, k * h : (k + 1) * h]
            dproj, dh, du = np.zeros((len(features) + 1, 3 * h), np.float32), np.zeros((len(win), h), np.float32), np.zeros_like(u)
            for t, state, z, r, n, an, m in reversed(keep[way]):
                dh = dh + dstates[:, t]
                dnew = dh * m
                dn, dz = dnew * (1 - z), dnew * (state - n)
                dan = dn * (1 - n * n)
                gate = np.concatenate([dz * z * (1 - z), dan * an * r * (1 - r)], 1)
                dp, dact = np.concatenate([gate, dan], 1), np.concatenate([gate, dan * r], 1)
                np.add.at(dproj, win[:, t], dp)
                du += state.T @ dact
                dh = dh * ~m + dnew * z + dact @ u.T
            g |= {f"{way}_h": du, f"{way}_in": features.T @ dproj[:-1], f"{way}_b": dproj[:-1].sum(0)}
            dfeat += dproj[:-1] @ p[f"{way}_in"].T
        g["word"], g["char"] = np.zeros_like(p["word"]), np.zeros_like(p["char"])
        np.add.at(g["word"], words.word, dfeat[:, :WIDE])
        share = dfeat[:, WIDE:] / (words.n3 + words.n4)[:, None].astype(np.float32)
        np.add.at(g["char"], words.char3, np.repeat(share, words.n3, 0))
        np.add.at(g["char"], words.char4, np.repeat(share, words.n4, 0))
        return g

    def fit(self, texts: list[str], labels: list[int], steps: int = STEPS, seed: int = SEED, rate: float = 0.02) -> None:
        """Adam, ``steps`` batches of texts. In the first quarter all windows carry their text's label; later a text's highest window does,
        and in texts labelled 0 another one too."""
        r, moment = np.random.default_rng(seed), {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in self.p.items()}
        step, order = 0, np.zeros(0, np.int64)
        seen = {"word": np.zeros(WORD_ROWS, np.int64), "char": np.zeros(CHAR_ROWS, np.int64)}
        for t in texts:
            one = Words([t])
            seen["word"][np.unique(one.word)] += 1
            seen["char"][np.unique(np.concatenate([one.char3, one.char4]))] += 1
        learned = {k: (v >= LEAST_TEXTS)[:, None] for k, v in seen.items()}
        while step < steps:
            if len(order) < BATCH:
                order = np.concatenate([order, r.permutation(len(texts))])
            some, order = order[:BATCH], order[BATCH:]
            words = Words([texts[i] for i in some])
            win, doc, n = words.windows()
            y = np.array([labels[i] for i in some], np.float32)
            if 4 * step >= steps:
                logit = self.logits(words, win)
                top = np.lexsort((-logit, doc))
                first = np.unique(doc[top], return_index=True)[1]
                other = r.permutation(len(win))[: len(some)]
                chosen = np.concatenate([top[first], other[y[doc[other]] == 0]])
            else:
                chosen = r.permutation(len(win))[:512]
            g, step = self.gradients(words, win[chosen], y[doc[chosen]]), step + 1
            for k, v in g.items():
                v = v * learned[k] if k in learned else v
                a, b = moment[k]
                a += 0.1 * (v - a)
                b += 0.01 * (v * v - b)
                self.p[k] = (self.p[k] - rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-7)).astype(np.float32)

    def score(self, texts: list[str]) -> np.ndarray:
        """The probability of each whole text's highest window."""
        words = Words(texts)
        win, doc, n = words.windows()
        logit = self.logits(words, win)
        return _sigmoid(np.maximum.reduceat(logit, np.cumsum(n) - n).astype(np.float64))


def training_sample(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> DataFrame:
    """toxic, h (a hash) and text of at most ``per_label`` documents of each label whose crc32(doc_id) mod 4 isn't 2."""
    marks = pick(labels, "doc_id", "toxic").filter(F.col("toxic").isin(0, 1) & (F.crc32(F.col("doc_id").cast("string")) % 4 != 2))
    marks = marks.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    return bounded_sample(pick(docs, "doc_id", "text").filter(F.col("text").isNotNull()), marks, "toxic", per_label)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL, steps: int = STEPS) -> Network:
    """Train on a bounded sample of labelled documents; the same tables give the same network."""
    rows = sorted((r.h, r.text, r.toxic) for r in training_sample(docs, labels, per_label).toLocalIterator())
    net = Network()
    if len({t for _, _, t in rows}) == 2:
        net.fit([t for _, t, _ in rows], [y for _, _, y in rows], steps)
    return net


def score(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score and predicted (1 if score >= threshold) of every whole text.

    Null and empty texts count as one window without words and get the score that the bias gives. Without labels
    of both kinds the network stays untrained and scores are low. held_out is false for a null doc_id; repeated
    rows are kept; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(net.p)  # of fixed size

    def run(batches):
        n = Network()
        n.p = shared.value
        for pdf in batches:
            texts = pdf.text.fillna("").tolist()
            for lo, hi in in_batches(texts, 1_000_000):
                s, part = n.score(texts[lo:hi]), pdf.iloc[lo:hi]
                yield pd.DataFrame({"doc_id": part.doc_id.astype("Int64"), "held_out": part.held_out, "score": s, "predicted": (s >= threshold).astype(np.int32)})

    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), "text")
    return rows.mapInPandas(run, OUT)


def without_toxic(docs: DataFrame, net: Network, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` whose whole text scores below ``threshold``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(net.p)  # of fixed size

    def run(batches):
        n = Network()
        n.p = shared.value
        for b in batches:
            for lo, hi, texts in text_batches(b.column("text"), 1_000_000):
                yield b.slice(lo, hi - lo).filter(pa.array(n.score(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
