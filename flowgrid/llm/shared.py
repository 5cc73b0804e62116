"""Helpers that several text operators use."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowgrid.functions.storage import discard, fresh_path, materialize, shared_dir

__all__ = ["SPACE", "bounded_sample", "discard", "fresh_path", "materialize", "pick", "shared_dir", "table"]

#: Words are maximal runs of anything but ASCII white space.
SPACE = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, so that extra columns of the input can't clash with an operator's own."""
    return df.select(*[df[f"`{n}`"] for n in names])


def bounded_sample(docs: DataFrame, marks: DataFrame | None, by: str, most: int, parts: int = 64) -> DataFrame:
    """``by``, h (a hash) and text of at most ``most`` rows of ``docs`` (doc_id, text) for each value of ``by``: those of least hash.

    ``by`` is a column of ``docs``, or comes by doc_id from ``marks``. Rows with one doc_id, text and value count once,
    however often they come. Only hashes travel until the rows are chosen, and they are chosen in two steps, so that a value
    that most rows share is cut by many tasks before one task sees what is left.
    """
    hashed = docs.withColumn("h", F.xxhash64("doc_id", "text"))
    slim = hashed.select("h", by) if marks is None else hashed.select("doc_id", "h").join(marks.select("doc_id", by), "doc_id").select("h", by)
    least = lambda df, *keys: df.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy("h"))).filter(F.col("n") <= most).drop("n")
    some = least(least(slim.distinct().withColumn("part", F.pmod(F.shiftright("h", 32), F.lit(parts))), by, "part"), by).select(by, "h")
    # ``most`` rows for each value of ``by``
    return hashed.select("h", "text").join(F.broadcast(some), "h").groupBy(by, "h").agg(F.any_value("text").alias("text"))
