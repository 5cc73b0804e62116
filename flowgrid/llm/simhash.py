"""SimHash near-duplicates: 64-bit fingerprints over word shingles, linked at few differing bits.

Of eight bytes, four differing bits leave at least four untouched. An inverted index over byte positions lists
the distinct fingerprints by what they hold at three positions at once; twenty such position triples suffice for
every choice of four equal bytes to contain one. A pair of fingerprints from one list has its equal positional
bytes tallied, is kept if the tally reaches four, and is verified bit by bit.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.llm.shared import materialize, pick
from flowgrid.operators.components import components

SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Shingles whose bits are summed at once.
STEP = 1 << 16
_GROUPS = ((0, 1, 2), (3, 4, 5), (6, 7))


def triples() -> list[tuple[int, int, int]]:
    """Position triples such that any four of the eight positions contain one.

    The positions form three groups; the triples lie inside a group, or take two of a group and one of the next.
    """
    inside = [t for g in _GROUPS for t in combinations(g, 3)]
    across = [tuple(sorted((*two, one))) for k, g in enumerate(_GROUPS) for two in combinations(g, 2) for one in _GROUPS[(k + 1) % 3]]
    return sorted(inside + across)


def fingerprint(text: str | None) -> int:
    """Bit i is set if it is in over half of the shingles' XXH64 values; no word: zero."""
    import xxhash

    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, size = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts, h = (ends - size).tolist(), xxhash.xxh64_intdigest
    last = ends[min(SHINGLE, len(words)) - 1 :].tolist()
    values = np.fromiter((h(joined[a:b], SEED) for a, b in zip(starts, last)), np.uint64, len(last)).astype(">u8")
    total = np.zeros(64)
    for k in range(0, len(values), STEP):
        bits = np.unpackbits(values[k : k + STEP].view(np.uint8)).reshape(-1, 64).astype(np.float32)
        total += np.ones(len(bits), np.float32) @ bits
    return int.from_bytes(np.packbits(2 * total > len(values)).tobytes(), "big")


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fp (the 64 bits as a signed long) of every whole text; null and wordless texts have fp 0."""

    def run(batches):
        for pdf in batches:
            fps = np.array([fingerprint(t if isinstance(t, str) else None) for t in pdf.text], np.uint64).astype(np.int64)
            yield pd.DataFrame({"doc_id": pdf.doc_id.astype("Int64"), "fp": fps})

    return pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, "doc_id long, fp long")


def _bytes(c: str) -> list:
    return [F.shiftrightunsigned(F.col(c), 8 * (7 - k)).bitwiseAND(F.lit(255)) for k in range(8)]


def links(fps: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Pairs (a, b), a < b, of distinct fingerprints (column fp) that differ in 1 to ``most_bits`` (at most 4) bits; each pair once."""
    if most_bits > 4:
        raise ValueError("the index guarantees pairs of up to 4 differing bits")
    chosen, byte = triples(), _bytes("fp")
    # lists are keyed by the triple's number and the three bytes
    keys = F.array(*[F.lit(k << 24).cast("long") + byte[x] * 65536 + byte[y] * 256 + byte[z] for k, (x, y, z) in enumerate(chosen)])
    listed = fps.select("fp", F.explode(keys).alias("key"))
    # an equal-bytes mask tells the first triple a pair shares; only that list gives the pair
    first = [next((k for k, t in enumerate(chosen) if all(m >> (7 - i) & 1 for i in t)), -1) for m in range(256)]
    a, b = listed.select(F.col("fp").alias("a"), "key"), listed.select(F.col("fp").alias("b"), F.col("key").alias("key_b"))
    x = F.col("a").bitwiseXOR(F.col("b"))
    equal = [(F.shiftrightunsigned(x, 8 * (7 - k)).bitwiseAND(F.lit(255)) == 0).cast("int") for k in range(8)]
    tally = sum(equal[1:], equal[0])
    mask = sum((e * (1 << (7 - k)) for k, e in enumerate(equal)), F.lit(0))
    once = F.element_at(F.from_json(F.lit(str(first)), "array<int>"), mask + 1) == F.shiftright(F.col("key"), 24)
    return a.join(b, (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (tally >= 4) & (F.bit_count(x) <= most_bits) & once).select("a", "b")


def near_duplicates(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id (least doc_id reachable over links, itself included).

    Rows with one fingerprint are one node of the graph, however many they are. Null and empty texts share
    fingerprint 0. A null doc_id keeps its row; a component of nothing but null doc_ids has a null id. Extra columns
    are ignored; an empty table gives an empty result.
    """
    members = materialize(fingerprints(docs), "fingerprints")
    nodes = materialize(members.groupBy("fp").agg(F.min("doc_id").alias("least")), "nodes")
    found = components(links(nodes, most_bits), "a", "b")
    placed = nodes.join(found.select(F.col("node").alias("fp"), "component"), "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    placed = materialize(placed, "placed")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    by_fp = placed.join(least, "component").select("fp", "component_id")
    return members.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each component the document of least doc_id stays, with all its columns.

    Of repeated rows of that doc_id one stays. Rows with a null doc_id can't be told apart by it and all stay.
    """
    stay = near_duplicates(docs, most_bits).filter(F.col("doc_id") == F.col("component_id")).select(F.col("doc_id").alias("stays")).distinct()
    rows = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("row"))  # whole, however its columns are called
    order = Window.partitionBy("row.doc_id").orderBy(F.xxhash64("row.text"), "row.text")
    kept = rows.join(stay, F.col("row.doc_id") == F.col("stays"), "left_semi").withColumn("place", F.row_number().over(order)).filter("place = 1")
    return kept.select("row").unionByName(rows.filter("row.doc_id is null")).select(*[F.col(f"row.`{c}`") for c in docs.columns])
