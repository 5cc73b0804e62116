"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``, else a folder under the warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    return (found or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch").rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


#: Spark's own switch that frees the shuffle files of a query as soon as it has ended.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def _shuffles_freed(spark: SparkSession):
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, options: dict[str, str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from these files, not from lineage.

    Shuffle files of the job go when the table is written. ``options`` go to the writer.
    """
    spark, path, schema = df.sparkSession, fresh_path(df.sparkSession, name), df.schema
    with _shuffles_freed(spark):
        df.write.option("compression", "zstd").options(**options or {}).parquet(path)
    back = spark.read.schema(schema).parquet(path)
    back._stored_at = path
    return back


def discard(df: DataFrame) -> None:
    """Remove a table that ``materialize`` wrote and nothing reads any more."""
    if path := getattr(df, "_stored_at", None):
        p = df.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(p, True)
