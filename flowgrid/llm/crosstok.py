"""Cross-tokenizer alignment: which tokens of a byte-level vocabulary (A) and of a piece vocabulary (B) cover the same bytes.

Both vocabularies cut the bytes of space + text. The tokens of both are sorted by where they start and the running maximum
of their ends is taken: a group breaks where a start reaches that maximum, which is where tokens of both sides end. Inside
a group every A token overlaps a B token. A and B tokens that end at one byte are linked.

No token of either vocabulary reaches over a gap from other characters to white space, so a text's tokens are those of its
chunks (a run of blanks, tabs and line feeds with what follows), one chunk after another. Each Python worker keeps the
aligned form of the chunks it met. Texts with rarer kinds of white space are aligned whole.
"""

from __future__ import annotations

import hashlib
import re
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.llm.shared import materialize, pick
from flowgrid.llm.tokens import in_batches

#: Chunks kept per worker and the longest one kept; others are aligned when met.
CACHE_CHUNKS, CACHE_CHUNK_CHARS = 400_000, 48
#: Characters of texts worked on at once, and new chunks that go to the libraries in one text.
BATCH_CHARS, BLOCK_CHUNKS = 1_000_000, 2048

_CHUNK = re.compile(r"[ \n\t]+[^ \n\t]*")
_ODD_SPACE = re.compile(r"[\x0b-\x0d\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u2064\u3000\ufeff]")
_RUNS = ("  ", "\n\n", " \n", "\n ", "\t")
_ROWS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
_STORED = "doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs array<int>, times array<int>"
_vocabularies: dict[tuple[str, str], "Vocabularies"] = {}
_kept: dict[tuple[str, str], "Chunks"] = {}


def default_paths() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones themselves, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Vocabularies:
    """Both libraries' encoders and the bytes of every token."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        letters = _byte_letters()
        spelled = {i: bytes(map(letters.__getitem__, t)) if all(c in letters for c in t) else t.encode() for t, i in self.a.get_vocab().items()}
        self.bytes_a = [spelled.get(i, b"") for i in range(max(spelled) + 1)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(pieces)]
        self.size_a, self.size_b = (np.array([len(t) for t in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self._pairs = None
        self.blank = self.b.piece_to_id("▁")
        #: Chunks can be encoded alone if no piece reaches over the start of blanks, tabs or line feeds.
        self.by_chunk = not any("▁" in p.lstrip("▁") or re.search(r"[\n\t]", p) for p in pieces)

    def encode(self, chunks: list[str]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Blocks of aligned chunks: A ids, B ids, how many of each a chunk has, and whether both give its bytes (else it has none).

        Chunks go to the libraries as one text and are told apart by their bytes; if that fails, in halves.
        """
        raw, text = [c.encode() for c in chunks], "".join(chunks)
        spelled, bounds = b"".join(raw), np.cumsum([len(r) for r in raw])
        ids_a = np.array(self.a.encode_batch_fast([text], add_special_tokens=False)[0].ids, np.int64)
        # B puts a blank in front of any text: the text's own first blank gives way to it, else it goes again
        ids_b = np.array(self.b.encode(text[1:] if text[0] == " " else text) if text != " " else [self.blank], np.int64)[text[0] != " " :]
        ends_a, ends_b = np.cumsum(self.size_a[ids_a]), np.cumsum(self.size_b[ids_b])
        same = all(b"".join(map(names.__getitem__, ids.tolist())) == spelled for names, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b)))
        if same:
            upto_a, upto_b = np.searchsorted(ends_a, bounds), np.searchsorted(ends_b, bounds)
            if (ends_a[upto_a] == bounds).all() and (ends_b[upto_b] == bounds).all():
                return [(ids_a, ids_b, np.diff(upto_a, prepend=-1), np.diff(upto_b, prepend=-1), np.ones(len(chunks), bool))]
        if len(chunks) == 1:
            none = np.zeros(0, np.int64)
            return [(none, none, np.zeros(1, np.int64), np.zeros(1, np.int64), np.zeros(1, bool))]
        half = len(chunks) // 2
        return self.encode(chunks[:half]) + self.encode(chunks[half:])

    def pairs(self) -> "Pairs":
        """All pairs that can end together."""
        if self._pairs is None:
            self._pairs = Pairs(self.bytes_a, self.bytes_b)
        return self._pairs


class Pairs:
    """The pairs of an A and a B id that can end at one byte: one token's bytes are a suffix of the other's.

    A token has no more suffixes than bytes, so there are about as many pairs as bytes in both vocabularies, whatever the corpus.
    """

    def __init__(self, bytes_a: list[bytes], bytes_b: list[bytes]):
        found = set()
        for flip, (long, short) in enumerate(((bytes_a, bytes_b), (bytes_b, bytes_a))):
            ids: dict[bytes, list[int]] = {}
            for i, t in enumerate(short):
                ids.setdefault(t, []).append(i)
            for i, t in enumerate(long):
                for k in range(len(t)):
                    for other in ids.get(t[k:], ()):
                        found.add((other << 32 | i) if flip else (i << 32 | other))
        self.keys = np.array(sorted(found), np.int64)

    def __len__(self) -> int:
        return len(self.keys)

    def number(self, ids_a: np.ndarray, ids_b: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.keys, ids_a << 32 | ids_b)

    def sides(self) -> tuple[np.ndarray, np.ndarray]:
        return self.keys >> 32, self.keys & 0xFFFFFFFF


def vocabularies(path_a: str, path_b: str) -> Vocabularies:
    key = (path_a, path_b)
    if key not in _vocabularies:
        _vocabularies[key] = Vocabularies(path_a, path_b)
    return _vocabularies[key]


def coalesce(start_a: np.ndarray, end_a: np.ndarray, start_b: np.ndarray, end_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each A and of each B token, numbered from 0 in order, for tokens that cover one range of bytes twice."""
    starts, ends = np.concatenate([start_a, start_b]), np.concatenate([end_a, end_b])
    order = np.lexsort((ends, starts))
    reach = np.maximum.accumulate(ends[order])
    fresh = np.ones(len(order), bool)
    fresh[1:] = starts[order][1:] >= reach[:-1]
    group = np.empty(len(order), np.int64)
    group[order] = np.cumsum(fresh) - 1
    return group[: len(start_a)], group[len(start_a) :]


class _Rows:
    """A growing array."""

    def __init__(self, kind=np.int64):
        self.data, self.n = np.zeros(1 << 12, kind), 0

    def add(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate([self.data[: self.n], np.zeros(self.n + 2 * len(values), self.data.dtype)])
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)

    def cut(self, n: int) -> None:
        self.n = n


class Chunks:
    """Aligned chunks of a worker: how many tokens and groups they have, their linked pairs, and the groups as text."""

    def __init__(self, vocabulary: Vocabularies, keep: int = CACHE_CHUNKS):
        self.vocabulary, self.keep = vocabulary, keep
        self.index: dict[str, int] = {}
        self.text: list[str] = []
        self.whole = _Rows(bool)  # joined tokens give the chunk's bytes
        self.odd = _Rows(bool)  # only a whole text tells how this is cut
        self.sizes = {k: _Rows() for k in ("n_a", "n_b", "n_groups")}
        self.first, self.pairs = _Rows(), _Rows(np.int32)
        self.first.add(np.zeros(1, np.int64))

    def _add(self, chunks: list[str]) -> None:
        for lo in range(0, len(chunks), BLOCK_CHUNKS):
            for block in self.vocabulary.encode(chunks[lo : lo + BLOCK_CHUNKS]):
                self._align(*block)
        self.odd.add(np.fromiter((_ODD_SPACE.search(c) is not None for c in chunks), bool, len(chunks)))

    def _align(self, ids_a: np.ndarray, ids_b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, whole: np.ndarray) -> None:
        v = self.vocabulary
        end_a, end_b = np.cumsum(v.size_a[ids_a]), np.cumsum(v.size_b[ids_b])
        group_a, group_b = coalesce(end_a - v.size_a[ids_a], end_a, end_b - v.size_b[ids_b], end_b)
        # a group's last tokens end together, and no others do
        last_a, last_b = (np.flatnonzero(np.diff(g, append=-1)) for g in (group_a, group_b))
        n_groups = np.bincount(np.repeat(np.arange(len(n_a)), n_a)[last_a], minlength=len(n_a))
        upto = np.cumsum(n_groups)
        names_a, names_b = list(map(str, ids_a.tolist())), list(map(str, ids_b.tolist()))
        stops_a, stops_b = (last_a + 1).tolist(), (last_b + 1).tolist()
        spelled = [",".join(names_a[a0:a1]) + "|" + ",".join(names_b[b0:b1]) for a0, a1, b0, b1 in zip([0, *stops_a], stops_a, [0, *stops_b], stops_b)]
        self.text += [";".join(spelled[x:y]) for x, y in zip([0, *upto[:-1].tolist()], upto.tolist())]
        self.pairs.add(v.pairs().number(ids_a[last_a], ids_b[last_b]))
        self.first.add(self.first.data[self.first.n - 1] + upto)
        for name, values in (("n_a", n_a), ("n_b", n_b), ("n_groups", n_groups)):
            self.sizes[name].add(values)
        self.whole.add(whole)

    def _cut(self, n: int) -> None:
        for rows in (self.whole, self.odd, *self.sizes.values()):
            rows.cut(n)
        del self.text[n:]
        self.first.cut(n + 1)
        self.pairs.cut(int(self.first.data[n]))

    def _keys(self, text: str) -> list[str]:
        """The chunks of space + text; a leading blank is left out where a word follows it."""
        if text[0] in " \n\t" or any(run in text for run in _RUNS):
            return [c[1:] if c[0] == " " and (len(c) == 1 or c[1] not in " \n\t") else c for c in _CHUNK.findall(" " + text)]
        return text.replace("\n", " \n").split(" ")

    def align(self, texts: list[str]):
        """The places of all texts' chunks in one array, where each text's begin, and whether a text can be aligned.

        New chunks are learned on the way; ``forget`` must follow.
        """
        by_chunk = self.vocabulary.by_chunk
        cut = [self._keys(t) if t and by_chunk else [] for t in texts]
        kept = self.whole.n
        words = list(chain.from_iterable(cut))
        at = np.fromiter(map(self.index.get, words, repeat(-1)), np.int64, len(words))
        self.new: list[str] = []
        if (missing := np.flatnonzero(at < 0)).size:
            self.new = sorted(dict.fromkeys(words[i] for i in missing.tolist()), key=lambda w: len(w) > CACHE_CHUNK_CHARS)
            self._add([w if w and w[0] in " \n\t" else " " + w for w in self.new])
            here = {w: kept + k for k, w in enumerate(self.new)}
            at[missing] = np.fromiter((here[words[i]] for i in missing.tolist()), np.int64, len(missing))
        upto = np.concatenate([[0], np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)))])
        odd = np.diff(np.concatenate([[0], np.cumsum(self.odd.data[at])])[upto]) > 0 if by_chunk else np.array([bool(t) for t in texts])
        if odd.any():  # these texts as one chunk each
            places = np.split(at, upto[1:-1]) if len(cut) else []
            for t in np.flatnonzero(odd).tolist():
                self._add([" " + texts[t]])
            nth = self.whole.n - int(odd.sum())
            for k in np.flatnonzero(odd):
                places[k], nth = np.array([nth]), nth + 1
            at, upto = np.concatenate(places), np.concatenate([[0], np.cumsum([len(p) for p in places])])
        bad = np.diff(np.concatenate([[0], np.cumsum(~self.whole.data[at])])[upto]) > 0
        self.kept = kept
        return at, upto, ~bad

    def forget(self) -> None:
        """Keep new chunks as far as there is room, drop the rest."""
        stay = min(sum(len(w) <= CACHE_CHUNK_CHARS for w in self.new), max(0, self.keep - self.kept))
        self.index.update((w, self.kept + k) for k, w in enumerate(self.new[:stay]))
        self._cut(self.kept + stay)


def _digests(path_a: str, path_b: str):
    """The alignment of each text, with its linked pairs by number and how often it has them."""

    def run(batches):
        chunks = _chunks(path_a, path_b)
        for b in batches:
            texts, doc_ids = b.column("text").fill_null("").to_pylist(), b.column("doc_id")
            for lo, hi in in_batches(texts, BATCH_CHARS):
                at, upto, fine = chunks.align(texts[lo:hi])
                sums = [np.where(fine, np.diff(np.concatenate([[0], np.cumsum(chunks.sizes[k].data[at])])[upto]), 0) for k in ("n_a", "n_b", "n_groups")]
                spelled = list(map(chunks.text.__getitem__, at.tolist()))
                digests, pairs, times = [], [], []
                first = chunks.first.data
                size = first[at + 1] - first[at]
                flat = chunks.pairs.data[np.repeat(first[at] - np.cumsum(size) + size, size) + np.arange(int(size.sum()))]
                stops = np.concatenate([[0], np.cumsum(size)])[upto]
                for x, y, p, q, ok in zip(upto[:-1].tolist(), upto[1:].tolist(), stops[:-1].tolist(), stops[1:].tolist(), fine.tolist()):
                    digests.append(hashlib.sha256(";".join(spelled[x:y]).encode()).hexdigest() if ok and y > x else "")
                    values, n = np.unique(flat[p : q if ok else p], return_counts=True)
                    pairs.append(values)
                    times.append(n)
                offsets = pa.array(np.concatenate([[0], np.cumsum([len(p) for p in pairs])]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(x).astype(np.int32))) for x in (pairs, times)]
                yield pa.RecordBatch.from_arrays([doc_ids.slice(lo, hi - lo), *map(pa.array, sums), pa.array(digests, pa.string()), *lists], ["doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "pairs", "times"])
                chunks.forget()

    return run


def _chunks(path_a: str, path_b: str) -> Chunks:
    """This worker's chunks, kept from task to task."""
    key = (path_a, path_b)
    if key not in _kept:
        _kept[key] = Chunks(vocabularies(path_a, path_b))
    return _kept[key]


def _counted(n_pairs: int):
    """How often a task's texts hold each pair."""

    def run(batches):
        tally = np.zeros(n_pairs, np.int64)
        for b in batches:
            pairs, times = (b.column(k).flatten().to_numpy() for k in ("pairs", "times"))
            tally += np.bincount(pairs, times, minlength=n_pairs).astype(np.int64)
        held = np.flatnonzero(tally)
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(tally[held])], ["pair", "n"])

    return run


def _scored(table):
    """The sum of the counts of a text's links, and how many of them have the highest count of their B id."""

    def run(batches):
        count, best = table.value
        for b in batches:
            pairs, times = (b.column(k).flatten().to_numpy().astype(np.int64) for k in ("pairs", "times"))
            stops = np.concatenate([[0], np.cumsum(b.column("pairs").value_lengths().to_numpy())])
            n_best, count_sum = (np.diff(np.concatenate([[0], np.cumsum(x[pairs] * times)])[stops]) for x in (best, count))
            kept = [b.column(k) for k in ("doc_id", "n_a", "n_b", "n_groups")]
            yield pa.RecordBatch.from_arrays([*kept, kept[-1], pa.array(n_best), pa.array(count_sum), b.column("groups_sha256")], _NAMES)

    return run


def pair_counts(aligned: DataFrame, pairs: Pairs) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the number of its links in all texts, and whether no pair of its B id has more.

    Tasks add up what they hold; the driver gets a number for each pair at most (about half a million, see ``Pairs``).
    """
    sums = aligned.select("pairs", "times").mapInArrow(_counted(len(pairs)), "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n")).toArrow()
    count = np.zeros(len(pairs), np.int64)
    count[sums.column("pair").to_numpy()] = sums.column("n").to_numpy()
    _, side_b = pairs.sides()
    most = np.zeros(int(side_b.max(initial=0)) + 1, np.int64)
    np.maximum.at(most, side_b, count)
    return count, (count == most[side_b]).astype(np.int64)


def align_tokens(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): the alignment of its A and B tokens in numbers and as a digest.

    n_a, n_b: tokens; n_groups: groups between bytes where tokens of both sides end; n_links: pairs of tokens that end
    together; n_best: links whose pair is (also in a tie) the most frequent of its B id over all rows; count_sum: the sum of those
    frequencies; groups_sha256: digest of the groups as ``a,a|b;a|b,b``. Null and empty texts, and texts that a vocabulary
    can't spell (a literal U+2581), have no tokens: zeros and an empty digest. Rows are counted as often as they come, null
    doc_ids stay null, other columns are ignored, an empty table gives no rows.

    Each text is encoded once; its pairs by number, a few bytes each, go to a stored table, from which they are counted and
    scored. No text travels.
    """
    spark, (a, b) = docs.sparkSession, default_paths()
    path_a, path_b = path_a or a, path_b or b
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    aligned = materialize(rows.mapInArrow(_digests(path_a, path_b), _STORED), "aligned")
    table = spark.sparkContext.broadcast(pair_counts(aligned, vocabularies(path_a, path_b).pairs()))
    return aligned.mapInArrow(_scored(table), _ROWS)
