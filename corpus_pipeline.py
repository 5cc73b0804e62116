"""A corpus pipeline over documents: reject toxic texts, remove repeated lines, keep one of near-duplicates, drop
benchmark copies, pack what is left into sequences.

Every stage takes (spark, documents, folder of the tables) and works on all rows that its predecessor kept. All but
the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.llm import decontam, line_dedup, packing, simhash, tokens, toxicity
from flowgrid.llm.shared import materialize, table


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Train on the labelled documents that are here and drop every text that scores as toxic."""
    return toxicity.without_toxic(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def remove_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Remove lines that match an earlier one; documents stay with all their columns, n_chars follows the text."""
    # the other columns travel under one name, so that they can be called as they like
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    rows = docs.select("doc_id", "text", F.struct(*[docs[f"`{c}`"].alias(c) for c in others] or [F.lit(0).alias("none")]).alias("others"))
    out = line_dedup.dedup_lines(rows)
    columns = {c: F.col(f"others.`{c}`") for c in others} | {"doc_id": F.col("doc_id"), "text": F.col("text")}
    if "n_chars" in others:
        columns["n_chars"] = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("others.n_chars"))
    return out.select(*[columns[c].alias(c) for c in docs.columns])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least doc_id of each group of near-duplicates."""
    return simhash.keep_one(docs)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a copy of a benchmark item."""
    return decontam.without_copies(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encode and pack all documents: one row for each piece."""
    return packing.pack_documents(docs, tokens.default_path(), end_id=1)


STAGES = [
    ("toxicity", reject_toxic),
    ("line dedup", remove_lines),
    ("simhash near-dedup", keep_one),
    ("benchmark decontamination", drop_copies),
    ("best-fit packing", pack),
]

#: A trained classifier, alignments and a tokeniser can't be said in SQL; the stages are tested by brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
