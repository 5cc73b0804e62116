"""Exact tokenisation of whole texts with a public vocabulary, at the cost of encoding each distinct word once.

A vocabulary that drops white space and has no pre-token that spans a blank gives a text the ids of its
blank-separated chunks, one after another. Each Python worker keeps the ids of the chunks it met. Other vocabularies
(told by their normaliser and pre-tokeniser) encode whole texts.
"""

from __future__ import annotations

import json
import os
from itertools import chain, repeat
from pathlib import Path

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: The vocabulary file's name among the public ones; operators take the path as a parameter.
DEFAULT_VOCABULARY = "word_bpe_49k.json"
#: Marks that may close a chunk.
MARKS = ".,"
# The normaliser and the pre-tokeniser for which chunks can be encoded one by one, in any letter case.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Chunks kept per worker (about 70 MB) and the longest one kept; others are encoded when met.
CACHE_CHUNKS, CACHE_CHUNK_CHARS = 400_000, 48
#: Characters worked on at once.
BATCH_CHARS = 2_000_000

_encoders: dict[str, "ChunkEncoder"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_VOCABULARY)


def encoder(path: str) -> "ChunkEncoder":
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


class ChunkEncoder:
    def __init__(self, path: str, keep: int = CACHE_CHUNKS):
        from tokenizers import Tokenizer

        self.tokenizer, self.keep = Tokenizer.from_file(path), keep
        rules = json.loads(Path(path).read_text(encoding="utf-8"))
        self.by_chunk = rules.get("normalizer") == NORMALIZER and rules.get("pre_tokenizer") == PRE_TOKENIZER and not rules.get("post_processor")
        self.index: dict[str, int] = {}
        self.ids, self.start = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)
        self.chunks, self.met = 0, np.zeros(keep, np.uint8)

    def _append(self, encoded) -> None:
        """Store the ids of further chunks behind those there are."""
        lens = np.fromiter((len(x) for x in encoded), np.int64, len(encoded))
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(lens.sum()))
        at, n = self.start[self.chunks], len(lens)
        if at + len(flat) > len(self.ids):
            self.ids = np.concatenate([self.ids[:at], np.zeros(at + 2 * len(flat), np.int32)])
        if self.chunks + n + 1 > len(self.start):
            self.start = np.concatenate([self.start[: self.chunks + 1], np.zeros(self.chunks + 2 * n + 1, np.int64)])
        self.ids[at : at + len(flat)] = flat
        self.start[self.chunks + 1 : self.chunks + n + 1] = at + np.cumsum(lens)
        self.chunks += n

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        """The library's ids of each chunk. Plain chunks that differ in case or in one closing mark share one call:
        the vocabulary lower-cases, and a mark after a letter is a pre-token of its own."""
        parts, unknown = [], {}
        for w in chunks:
            core, mark = w, ""
            if "<|" not in w:  # special tokens stay as they are
                # Latin letters as single characters: nothing to compose, and each has one letter as its lower case (but for one)
                if w.isascii() or (max(w) < "\u0250" and "\u0130" not in w):
                    core = w.lower()
                # letters of old scripts only: every Unicode version knows them, and none ends in a combining mark in lower case
                if len(w) > 1 and w[-1] in MARKS and w[-2] < "\u0530" and w[-2].lower()[-1].isalpha():
                    core, mark = core[:-1], core[-1]
            parts.append((core, mark))
            if core not in self.index and core not in unknown:
                unknown[core] = len(unknown)
        coded = [e.ids for e in self.tokenizer.encode_batch_fast([*unknown, *MARKS], add_special_tokens=False)]
        marks = dict(zip(["", *MARKS], [[], *coded[len(unknown) :]]))
        out = []
        for core, mark in parts:
            k = self.index.get(core)
            ids = coded[unknown[core]] if k is None else self.ids[self.start[k] : self.start[k + 1]].tolist()
            out.append(ids + marks[mark] if mark else ids)
        return out

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's ids begin (one entry more than texts)."""
        if not self.by_chunk:
            coded = [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
            return np.fromiter(chain.from_iterable(coded), np.int32), np.cumsum([0, *map(len, coded)])
        split = [t.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ") for t in texts]
        words = list(chain.from_iterable(split))
        per_text = np.fromiter(map(len, split), np.int64, len(split))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        kept, new, known = self.chunks, [], at[at >= 0]
        self.met[known] = np.minimum(self.met[known], 200) + 1
        if (missing := np.flatnonzero(at < 0)).size:
            new = list(dict.fromkeys(words[i] for i in missing))
            new.sort(key=lambda w: len(w) > CACHE_CHUNK_CHARS)
            self._append(self._encode_chunks(new))
            here = {w: kept + k for k, w in enumerate(new)}
            at[missing] = np.fromiter((here[words[i]] for i in missing), np.int64, len(missing))
        first, size = self.start[at], self.start[at + 1] - self.start[at]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[np.repeat(first - (ends - size), size) + np.arange(total)]
        offsets = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(per_text)])]
        if new:  # keep what fits, forget the rest
            stay = min(sum(len(w) <= CACHE_CHUNK_CHARS for w in new), max(0, self.keep - kept))
            self.index.update((w, kept + k) for k, w in enumerate(new[:stay]))
            self.chunks = kept + stay
            if self.chunks == self.keep:
                self._forget()
        return ids, offsets

    def _forget(self) -> None:
        """Make room by dropping the chunks that didn't come again, if they are a quarter or more; the others age."""
        stay = self.met[: self.chunks] > 0
        if (n := int(stay.sum())) * 4 <= 3 * self.keep:
            # the index lists chunks in the order of their numbers
            self.index = {w: k for k, w in enumerate(w for w, k in self.index.items() if stay[k])}
            size, ids = np.diff(self.start[: self.chunks + 1]), self.ids[: self.start[self.chunks]]
            ids = ids[np.repeat(stay, size)]
            self.ids[: len(ids)], self.start[1 : n + 1] = ids, np.cumsum(size[stay])
            self.met[:n], self.met[n:], self.chunks = self.met[: len(stay)][stay], 0, n
        self.met >>= 1


def text_batches(column, most: int = BATCH_CHARS):
    """Ranges (lo, hi) of an Arrow column of texts that hold about ``most`` bytes each, with those texts: only they are Python strings.

    Every text is whole; nulls count as empty.
    """
    import pyarrow.compute as pc

    ends, lo = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)), 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + most, "right")))
        yield lo, hi, column.slice(lo, hi - lo).fill_null("").to_pylist()
        lo = hi


def in_batches(texts: list[str], most: int = BATCH_CHARS):
    """Ranges of texts that hold about ``most`` characters each; every text is whole."""
    begin = size = 0
    for k, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, k
            begin, size = k, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)
