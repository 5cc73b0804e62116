"""Benchmark decontamination: rare word seeds bring passages to test items, Smith-Waterman alignment scores them.

An item's n-grams are single words here, so that no edit can break them: of n words a copy keeps at least the share COVERAGE, so of the
rarest half and a few more it keeps at least those few (a pigeonhole bound, which holds for any choice of words; rarity only makes hits
few). A window of text with so many seeds of an item is aligned with it if it holds as many of all the item's words as a copy must
keep, and holds them in order and near each other (longest common subsequences of its parts). The window has room for every alignment that begins in its first half, and the whole table is filled, without a band:
edited copies count by the words they keep in order, however far their parts drift. Nothing that a whole table over all texts and
items would find is lost.

Items come in blocks of bounded size. Each block is one pass over the corpus, so a benchmark of any size can be used.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.align import align_whole
from flowgrid.llm.shared import materialize, pick
from flowgrid.llm.tokens import in_batches

#: Seeds of an item beyond those that a copy can lose: so many a window must hold.
EXTRA = 3
#: Words of items in a block at most: what is held by each worker at once (a longer item is a block of its own).
BLOCK_WORDS = 500_000
#: Share of the item's words that an alignment must keep; items of up to so many words are kept whole or not at all.
COVERAGE, WHOLE_WORDS = 0.5, 2
#: Seeds or words looked at together at most.
SLICE = 1 << 21
#: Items that an alignment spans less than: as many unmatched words as use up what its matches gain, and the matches.
SPAN = 3
OUT = "doc_id long, item_id long, score long, coverage double, n_matched long, begin_word long, end_word long"
WORD = re.compile(r"\w+")


class _Lists:
    """Lists of pairs of whole numbers, one after the other in arrays."""

    def __init__(self, lists):
        lists = [list(x) for x in lists]
        self.n = np.fromiter(map(len, lists), np.int64, len(lists))
        self.first = np.cumsum(self.n) - self.n
        self.pairs = np.array(list(chain.from_iterable(lists)), np.int64).reshape(-1, 2).T

    def of(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The pairs of all lists ``rows``, and for each pair its place in ``rows``."""
        n = self.n[rows]
        each = np.repeat(np.arange(len(rows)), n)
        return each, self.pairs[:, np.arange(len(each)) + (self.first[rows] - np.cumsum(n) + n)[each]]


def _slices(ends: np.ndarray):
    """Ranges that hold SLICE at most, or one; ``ends``: running totals."""
    lo = 0
    while lo < len(ends):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + SLICE, "right")))
        yield lo, hi
        lo = hi


def least_matches(n: int) -> int:
    """Words of an item of ``n`` that a copy keeps at least."""
    return n if n <= WHOLE_WORDS else math.ceil(COVERAGE * n)


class Items:
    """A block of items: their words as numbers, and which of them are seeds."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids = [i for i, _ in rows]
        words = [WORD.findall(t.lower()) for _, t in rows]
        self.vocabulary = {w: k for k, w in enumerate(dict.fromkeys(chain.from_iterable(words)))}
        self.items = [[self.vocabulary[w] for w in x] for x in words]
        self.size = np.fromiter(map(len, self.items), np.int64, len(self.items))
        self.least = np.fromiter(map(least_matches, self.size.tolist()), np.int64, len(self.items))
        self.bags = _Lists(Counter(x).items() for x in self.items)
        self.holders = None
        # for each item and word of it, by item * words + word, the places of the word in the item as bits of 64-bit numbers
        self.limbs = -(-int(self.size.max(initial=1)) // 64)
        bits: dict[int, list[int]] = {}
        for k, x in enumerate(self.items):
            for at, w in enumerate(x):
                bits.setdefault(k * len(self.vocabulary) + w, [0] * self.limbs)[at // 64] |= 1 << at % 64
        self.placed = np.array(sorted(bits), np.int64)
        self.places = np.array([bits[k] for k in self.placed.tolist()], np.uint64).reshape(-1, self.limbs)

    def rank(self, words: np.ndarray) -> None:
        """Choose the seeds: each item's words that are rarest among ``words`` (numbers, -1: in no item)."""
        seen = np.bincount(words[words >= 0], minlength=len(self.vocabulary))
        lists: list[list[tuple[int, int]]] = [[] for _ in self.vocabulary]
        chosen = np.minimum(self.size, self.size - self.least + EXTRA)
        for k, (x, n) in enumerate(zip(self.items, chosen.tolist())):
            for w in set(sorted(x, key=lambda w: (seen[w], w))[:n]):
                lists[w].append((k, 0))
        self.need = chosen - (self.size - self.least)
        self.holders = _Lists(lists)

    def find(self, texts: list[str]):
        """Every text's words as numbers (-1: in no item), where texts begin and how long they are, and texts and places of words that are seeds."""
        split = [WORD.findall(t.lower()) for t in texts]
        count = np.fromiter(map(len, split), np.int64, len(split))
        number = self.vocabulary.get
        words = np.fromiter((number(w, -1) for w in chain.from_iterable(split)), np.int64, int(count.sum()))
        first = np.cumsum(count) - count
        if self.holders is None:
            self.rank(words)
        ok = np.flatnonzero(words >= 0)
        ok = ok[self.holders.n[words[ok]] > 0]
        doc = np.searchsorted(first + count, ok, "right")
        return words, first, count, doc, ok

    def candidates(self, words, first, count, doc, at) -> tuple[np.ndarray, ...]:
        """Texts, items, and begins and ends of the windows that hold enough seeds and enough of the item's words.

        An alignment costs a point for every word it doesn't match and gains two for every other, so it spans less than
        SPAN times its item. Window k begins at k * SPAN items and is twice that long: it holds all alignments that
        begin in its first half.
        """
        most = int((count // (SPAN * self.size.min())).max(initial=0)) + 2
        found, times = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in _slices(np.cumsum(self.holders.n[words[at]])):
            each, (item, _) = self.holders.of(words[at[lo:hi]])
            d = doc[lo:hi][each]
            half = (at[lo:hi][each] - first[d]) // (SPAN * self.size[item])
            halves, n = np.unique((d * len(self.items) + item) * most + half, return_counts=True)
            found.append(halves)
            times.append(n)
        halves, where = np.unique(np.concatenate(found), return_inverse=True)
        seeds = np.bincount(where, np.concatenate(times), len(halves)).astype(np.int64)
        # a window is two halves; it begins with one that has a seed, or just before
        begin = np.unique(np.concatenate([halves, halves[halves % most > 0] - 1]))
        held = np.zeros(len(begin), np.int64)
        for step in (0, 1):
            place = np.searchsorted(halves, begin + step)
            hit = place < len(halves)
            hit[hit] = halves[place[hit]] == begin[hit] + step
            held[hit] += seeds[place[hit]]
        pair, k = np.divmod(begin, most)
        doc, item = np.divmod(pair, len(self.items))
        keep = held >= self.need[item]
        doc, item, k = doc[keep], item[keep], k[keep]
        begin = first[doc] + k * SPAN * self.size[item]
        end = np.minimum(begin + 2 * SPAN * self.size[item], (first + count)[doc])
        for test in (self.enough, self.ordered):
            keep = test(words, item, begin, end)
            doc, item, begin, end = doc[keep], item[keep], begin[keep], end[keep]
        return doc, item, begin, end

    def enough(self, words, item, begin, end) -> np.ndarray:
        """Whether the windows hold as many of their item's words as a copy keeps, each as often as the item at most, in any order."""
        known = np.flatnonzero(words >= 0)
        stride = len(words) + 1
        places = np.sort(words[known] * stride + known)
        out = np.zeros(len(item), bool)
        for lo, hi in _slices(np.cumsum(self.bags.n[item])):
            each, (w, n) = self.bags.of(item[lo:hi])
            held = np.searchsorted(places, w * stride + end[lo:hi][each]) - np.searchsorted(places, w * stride + begin[lo:hi][each])
            out[lo:hi] = np.bincount(each, np.minimum(held, n), hi - lo) >= self.least[item[lo:hi]]
        return out

    def ordered(self, words, item, begin, end) -> np.ndarray:
        """Whether the windows have a stretch with as many of their item's words in order as a copy keeps.

        An alignment with m matches spans less than SPAN * m words of text. For m from a least to a most number, any stretch of that span is
        inside one of the parts of the window that follow each other at a third of it, and so has a common subsequence of the least.
        """
        out = np.zeros(len(item), bool)
        for lo, hi in _slices(np.cumsum(end - begin)):
            out[lo:hi] = self._ordered(words, item[lo:hi], begin[lo:hi], end[lo:hi])
        return out

    def _ordered(self, words, item, begin, end) -> np.ndarray:
        wide = int((end - begin).max(initial=0))
        at = begin[:, None] + np.arange(wide)
        inside = at < end[:, None]
        w = np.where(inside, words[np.minimum(at, len(words) - 1)], -1)
        key = np.where(w >= 0, item[:, None] * len(self.vocabulary) + w, -1)
        row = np.minimum(np.searchsorted(self.placed, key), len(self.placed) - 1)
        masks = np.where((self.placed[row] == key)[:, :, None], self.places[row], np.uint64(0)).reshape(-1, self.limbs)
        n, least = self.size[item], self.least[item]
        cuts = [least, np.maximum(least, -(-6 * n // 10)), np.maximum(least, -(-3 * n // 4)), n + 1]
        out, every = np.zeros(len(item), bool), np.arange(len(item))
        hopeful = self._common(masks, every * wide, end - begin, n) >= least
        for low, high in zip(cuts, cuts[1:]):
            span = SPAN * (high - 1) - 1
            step = np.maximum(1, span // 3)
            live = np.flatnonzero((low < high) & ~out & hopeful)
            start = np.zeros(len(item), np.int64)
            while len(live):
                size = np.minimum(span[live] + step[live] - 1, wide - start[live])
                out[live] |= self._common(masks, live * wide + start[live], size, n[live]) >= low[live]
                start[live] += step[live]
                live = live[~out[live] & (begin[live] + start[live] < end[live])]
        return out

    def _common(self, masks, start, size, n) -> np.ndarray:
        """Longest common subsequences of stretches (of ``masks``, from ``start`` on) with items of ``n`` words, 64 places of an item at once.

        Of each word's places those above a longest prefix so far are set to 0: an addition carries over runs of free places.
        """
        free = np.full((self.limbs, len(start)), 2**64 - 1, np.uint64)
        for t in range(int(size.max(initial=0))):
            if t >= size.min():
                mask = np.where((t < size)[:, None], masks[np.minimum(start + t, len(masks) - 1)], np.uint64(0))
            else:
                mask = masks[start + t]
            carry = None
            for k in range(self.limbs):
                v, m = free[k], mask[:, k]
                u = v & m
                total = v + u
                if self.limbs > 1:
                    over = total < v
                    if carry is not None:
                        total = total + carry
                        over |= total < carry
                    carry = over.astype(np.uint64)
                free[k] = total | (v ^ u)
        taken = np.zeros(len(start), np.int64)
        for k in range(self.limbs):
            used = np.clip(n - 64 * k, 0, 64)
            low = np.where(used >= 64, np.uint64(2**64 - 1), (np.uint64(1) << np.minimum(used, 63).astype(np.uint64)) - np.uint64(1))
            taken += np.bitwise_count(~free[k] & low).astype(np.int64)
        return taken

    def matches(self, texts: list[str]) -> list[tuple]:
        """(text number, item id, score, coverage, matched words, begin, end) of the best place of each item in each text."""
        words, first, count, *hits = self.find(texts)
        best: dict[tuple[int, int], tuple] = {}
        for d, k, lo, hi in zip(*(x.tolist() for x in self.candidates(words, first, count, *hits))):
            a = self.items[k]
            found = align_whole(np.array(a), words[lo:hi], int(self.least[k]))
            if found and found[:2] > best.get((d, k), (0, 0))[:2]:
                best[d, k] = (*found[:2], int(lo - first[d]) + found[2], int(lo - first[d]) + found[3])
        return [(d, self.ids[k], score, m / len(self.items[k]), m, p, q) for (d, k), (score, m, p, q) in best.items()]


def blocks(items: DataFrame, words: int = BLOCK_WORDS):
    """The items, one block in memory at a time; null ones and those without a word are left out."""
    block, size = [], 0
    for r in pick(items, "item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        n = len(WORD.findall(r.text))
        if not n:
            continue
        if block and size + n > words:
            yield Items(block)
            block, size = [], 0
        block, size = [*block, (r.item_id, r.text)], size + n
    if block:
        yield Items(block)


def contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, score, coverage, n_matched, begin_word, end_word: every whole text that holds a copy of an item.

    One row for each text and item, for the best alignment; begin and end count the text's words. Texts without a
    copy, null and empty texts give no row, as do items that are null or without a word; items of one or two words must be there
    whole. A null item_id is kept. Ties go to the first place. Repeated rows give repeated results; other columns are ignored.
    """
    spark = docs.sparkSession
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    out = None
    for items in blocks(benchmark):
        shared = spark.sparkContext.broadcast(items)  # BLOCK_WORDS bounds it

        def run(batches, shared=shared):
            block = shared.value
            for pdf in batches:
                texts = pdf.text.fillna("").tolist()
                for lo, hi in in_batches(texts):
                    m = block.matches(texts[lo:hi])
                    ids = pdf.doc_id.astype("Int64").array[[lo + x[0] for x in m]]
                    yield pd.DataFrame({"doc_id": ids, "item_id": pd.array([x[1] for x in m], "Int64"), "score": [x[2] for x in m], "coverage": np.round([float(x[3]) for x in m], 9), "n_matched": [x[4] for x in m], "begin_word": [x[5] for x in m], "end_word": [x[6] for x in m]})

        part = materialize(rows.mapInPandas(run, OUT), "contaminated")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else spark.createDataFrame([], OUT)


def without_copies(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a copy of an item, with all its columns. Rows with a null doc_id stay."""
    found = contaminated(docs, benchmark)
    copies = found.select(F.col("doc_id").alias("copy")).distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))  # whole, however its columns are called
    return rows.join(copies, F.col("row.doc_id") == F.col("copy"), "left_anti").select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])
