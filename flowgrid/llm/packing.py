"""Best-fit packing of token pieces into fixed-length sequences, planned over a histogram of lengths.

The plan looks at counts per length, not at documents: at most ``capacity`` lengths, taken from long to short,
each length's pieces going to the open sequences with the least room that still takes them. What comes out is
a short list of slot ranges; documents then take the slots by joining on their rank within their length.
"""

from __future__ import annotations

import bisect
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.llm.shared import materialize, pick
from flowgrid.llm.tokens import encoder, text_batches

CAPACITY = 4096
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _pieces(vocabulary: str, capacity: int, end_id: int | None):
    def run(batches):
        code = encoder(vocabulary)
        for b in batches:
            for lo, hi, texts in text_batches(b.column("text"), 1_000_000):
                ids, offs = code.encode(texts)
                if end_id is not None:
                    ids, offs = np.insert(ids, offs[1:], end_id), offs + np.arange(len(offs))
                ids, size = ids.astype("<u4"), np.diff(offs)
                n = np.maximum(1, -(-size // capacity))  # pieces of each document; an empty one has one empty piece
                piece = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                start, doc = piece * capacity, np.repeat(np.arange(len(n)), n)
                length = np.minimum(capacity, size[doc] - start)
                crc = [zlib.crc32(ids[a:b]) for a, b in zip(offs[doc] + start, offs[doc] + start + length)]
                doc_ids = b.column("doc_id").slice(lo, hi - lo).take(pa.array(doc))
                yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, (piece.astype(np.int32), start, length, np.array(crc, np.int64)))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int | None = 1) -> DataFrame:
    """Cut every encoded document into pieces of at most ``capacity`` ids; only longer documents are cut.

    Returns doc_id, piece, start, length, ids_crc32. Null texts count as empty.
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(_pieces(vocabulary, capacity, end_id), PIECES)


def plan_slots(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit over counts: rows of (length, first rank, ranks, first sequence, pieces a sequence, offset).

    A row says: the pieces of that length with ranks from ``first rank`` on take the sequences from ``first
    sequence`` on, so many to each, beginning at ``offset``. The open sequences are kept as runs of equal ones by
    the room that is left, so time and size depend on the number of lengths only.
    """
    runs: dict[int, list[tuple[int, int]]] = {}  # room left: runs of sequences as (first, count)
    rooms: list[int] = []  # the keys of runs, ascending
    slots, opened = [], 0

    def add(room: int, first: int, count: int) -> None:
        if room and count:
            if room not in runs:
                bisect.insort(rooms, room)
            runs.setdefault(room, []).append((first, count))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left, rank = histogram[length], 0

        def fill(first: int, count: int, room: int) -> int:
            """Give up to ``count`` like sequences pieces of this length; how many sequences got any."""
            nonlocal left, rank
            each = room // length
            whole = min(count, left // each)
            for n, k, at in ((whole, each, first), (int(whole < count and left % each > 0), left % each, first + whole)):
                if n:
                    slots.append((length, rank, n * k, at, k, capacity - room))
                    rank, left = rank + n * k, left - n * k
                    add(room - k * length, at, n)
            return whole if not (whole < count and slots[-1][3] == first + whole) else whole + 1

        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                each = capacity // length
                used = fill(opened, -(-left // each), capacity)
                opened += used
                break
            room = rooms[k]
            first, count = runs[room].pop()
            if not runs[room]:
                del runs[room], rooms[k]
            used = fill(first, count, room)
            add(room, first + used, count - used)
    return slots


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Give every piece (columns of ``token_pieces``) a sequence_id and an offset in it.

    Offsets are gapless from 0. Empty pieces (length 0) all go to offset 0 of sequence 0. ``pieces`` is read
    three times, so it should be a stored table. Rows with equal keys count as different pieces; an empty table
    gives an empty result.
    """
    spark = pieces.sparkSession
    blocks = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # rank within length in two levels: a length that a third of all pieces share is numbered by many tasks
    block = F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)).cast("int")
    keyed = pieces.withColumn("block", block)
    counts = keyed.groupBy("length", "block").agg(F.count("*").alias("n"))
    counts = materialize(counts, "pack-counts")
    before = counts.select("length", "block", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("ranks_before"))
    histogram = {r.length: r.n for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity + 1 rows at most
    slots = plan_slots(histogram, capacity)
    by_length: dict[int, list] = {0: [(0, histogram.get(0, 0), 0, 1, 0)]}
    for length, *slot in slots:
        by_length.setdefault(length, []).append(tuple(slot))
    plan = spark.createDataFrame(
        [(k, v) for k, v in by_length.items()],
        "length long, slots array<struct<first_rank: long, ranks: long, first_sequence: long, each: long, offset: long>>",
    )
    local = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "start", "ids_crc32")
    ranked = keyed.withColumn("local", F.row_number().over(local) - 1).join(before, ["length", "block"])
    ranked = ranked.withColumn("rank", F.col("local") + F.col("ranks_before"))
    # the plan's size follows the number of lengths (4096), not the number of pieces
    found = ranked.join(F.broadcast(plan), "length").withColumn("slot", F.expr("filter(slots, s -> rank >= s.first_rank and rank < s.first_rank + s.ranks)[0]"))
    step = F.col("rank") - F.col("slot.first_rank")
    return found.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        F.when(F.col("length") == 0, F.lit(0).cast("long")).otherwise(F.col("slot.first_sequence") + F.floor(step / F.col("slot.each"))).alias("sequence_id"),
        F.when(F.col("length") == 0, F.lit(0).cast("long")).otherwise(F.col("slot.offset") + step % F.col("slot.each") * F.col("length")).alias("offset"),
    )


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int | None = 1) -> DataFrame:
    """Encode, cut and pack whole documents: one row per piece with its sequence and place.

    Uses doc_id and text only. Null texts are empty and hold their end id; null or repeated doc_ids are packed
    like any other row.
    """
    return pack(materialize(token_pieces(docs, vocabulary, capacity, end_id), "pieces"), capacity)
