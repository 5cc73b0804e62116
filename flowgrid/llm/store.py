"""Token-ID output: one Parquet row per document with its ids as a list column, laid out for selective reads.

The list column is dictionary-encoded (ids repeat), the ascending integer columns are delta-encoded, row groups
and pages are small and of set size, and every page has an entry in the file's page index. A reader that wants
few documents, or only the metadata, skips the other pages and columns.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgrid.llm.shared import pick
from flowgrid.llm.tokens import encoder, text_batches

STORED = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"

#: Writer settings. Ids below 2^16 fit a dictionary page of 1 MB; version 2 pages hold integers without a
#: dictionary as deltas; pages end after ROWS_PER_PAGE documents, which is what the page index can skip by.
ROWS_PER_PAGE = 200
LAYOUT = {
    "compression": "zstd",
    "parquet.writer.version": "v2",
    "parquet.block.size": str(16 << 20),
    "parquet.page.size": str(256 << 10),
    "parquet.page.row.count.limit": str(ROWS_PER_PAGE),
    "parquet.dictionary.page.size": str(1 << 20),
    "parquet.enable.dictionary": "true",
    "parquet.enable.dictionary#doc_id": "false",
    "parquet.enable.dictionary#local_start": "false",
    "parquet.enable.dictionary#n_tokens": "false",
}


def _encode(vocabulary: str, end_id: int | None):
    def run(batches):
        from pyspark import TaskContext

        code, part, at = encoder(vocabulary), TaskContext.get().partitionId(), 0
        for b in batches:
            doc_ids = b.column("doc_id")
            for lo, hi, texts in text_batches(b.column("text")):
                ids, offs = code.encode(texts)
                if end_id is not None:
                    ids, offs = np.insert(ids, offs[1:], end_id), offs + np.arange(len(offs))
                columns = [
                    doc_ids.slice(lo, hi - lo), pa.array(np.full(hi - lo, part, np.int32)), pa.array(at + offs[:-1]), pa.array(np.diff(offs)),
                    pa.ListArray.from_arrays(pa.array(offs.astype(np.int32)), pa.array(ids.astype(np.int32, copy=False))),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "part", "local_start", "n_tokens", "ids"])
                at += int(offs[-1])

    return run


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int | None = 2) -> None:
    """Encode ``docs`` (doc_id, text; other columns are ignored) and write the token files to ``path``.

    Files follow ascending doc_id: a range shuffle deals the documents out, each task sorts its range and
    writes it. Null texts count as empty; null doc_ids come first; rows with one doc_id follow each other by
    text, so repeated rows are stored as often as they come. An empty table gives an empty folder of files.
    ``end_id`` closes every document (None: nothing does).
    """
    rows = pick(docs, "doc_id", "text").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    # The hash keeps a doc_id that very many rows share from filling one range.
    ordered = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange("doc_id", "tie")
    ordered = ordered.sortWithinPartitions("doc_id", "tie", "text").select("doc_id", "text")
    ordered.mapInArrow(_encode(vocabulary, end_id), STORED).write.options(**LAYOUT).mode("overwrite").parquet(path)


def read_tokens(spark: SparkSession, path: str, first: int | None = None, last: int | None = None, ids: bool = True) -> DataFrame:
    """Documents ``first`` to ``last`` (both included; None: no bound) of the token files.

    Returns doc_id, start (ids of all documents before it), n_tokens and, if asked for, ids. The bounds reach the
    scan as filters on doc_id, and without ``ids`` the list column isn't read.
    """
    stored = spark.read.schema(STORED).parquet(path)
    # one row per file: its total gives the place where the next file's ids begin
    totals = stored.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    base = totals.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    if first is not None:
        stored = stored.filter(F.col("doc_id") >= first)
    if last is not None:
        stored = stored.filter(F.col("doc_id") <= last)
    out = ["doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", *["ids"] * ids]
    return stored.join(F.broadcast(base), "part").select(*out)  # as many rows as there are files


def _crc(batches):
    for b in batches:
        rows = b.column("ids")
        flat, offs = rows.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), rows.offsets.to_numpy()
        crcs = [zlib.crc32(flat[x:y].data) for x, y in zip(offs[:-1], offs[1:])]
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "start", "n_tokens")), pa.array(crcs, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])


def digest(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and the unsigned CRC-32 of the ids as little-endian unsigned 32-bit integers."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")
