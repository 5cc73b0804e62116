"""Histograms and profiles over equal bins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, column: str, bins: int, weight: str | None = None, limits: tuple[float, float] | None = None) -> DataFrame:
    """bin, low, high, n: equal bins from least to largest value (or within ``limits``), the last closed on the right; empty ones too.

    Values beyond the limits and nulls don't count. With ``weight`` n is the sum of that column. If all values are
    equal, everything is in bin 0.
    """
    v = F.col(column).cast("double")
    ends = df.agg(F.min(v).alias("lo"), F.max(v).alias("hi")) if limits is None else df.sparkSession.range(1).select(F.lit(float(limits[0])).alias("lo"), F.lit(float(limits[1])).alias("hi"))
    ends = ends.withColumn("w", (F.col("hi") - F.col("lo")) / bins)
    rows = df.select(v.alias("v"), (F.col(weight) if weight else F.lit(1)).cast("double").alias("x")).join(F.broadcast(ends), F.expr("v >= lo and v <= hi"))  # one row
    k = F.least(F.floor(F.coalesce(F.try_divide(F.round(F.col("v") - F.col("lo"), 9), F.col("w")), F.lit(0.0))), F.lit(bins - 1))
    counts = rows.groupBy(k.alias("bin")).agg(F.sum("x").alias("n"))
    spine = df.sparkSession.range(bins).withColumnRenamed("id", "bin").crossJoin(F.broadcast(ends))
    return spine.join(counts, "bin", "left").select("bin", (F.col("lo") + F.col("bin") * F.col("w")).alias("low"), (F.col("lo") + (F.col("bin") + 1) * F.col("w")).alias("high"), F.coalesce("n", F.lit(0.0)).alias("n"))


def cumulative_share(hist: DataFrame, share: float) -> DataFrame:
    """The leading bins up to the first at which ``share`` of the total is reached; a histogram has few rows."""
    w = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    total = F.sum("n").over(Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return hist.withColumn("before", F.coalesce(F.sum("n").over(w), F.lit(0.0))).withColumn("total", total).filter(F.col("before") < share * F.col("total")).drop("before", "total")


def fill_empty_bins(hist: DataFrame) -> DataFrame:
    """n of empty bins by linear interpolation between the nearest full ones, flat at the ends."""
    back = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    ahead = Window.orderBy("bin").rowsBetween(0, Window.unboundedFollowing)
    full, at = F.when(F.col("n") > 0, F.col("n")), F.when(F.col("n") > 0, F.col("bin"))
    h = hist.withColumns({"a": F.last(full, True).over(back), "ka": F.last(at, True).over(back), "b": F.first(full, True).over(ahead), "kb": F.first(at, True).over(ahead)})
    line = F.col("a") + (F.col("b") - F.col("a")) * F.try_divide((F.col("bin") - F.col("ka")).cast("double"), (F.col("kb") - F.col("ka")).cast("double"))
    return h.withColumn("n", F.coalesce(full, line, "a", "b", F.lit(0.0))).drop("a", "ka", "b", "kb")


def exceedance(df: DataFrame, column: str, limits: list[float]) -> DataFrame:
    """gamma, total, count, fraction: what lies above each limit."""
    rows = df.select(F.col(column).alias("v"), F.explode(F.array(*[F.lit(float(g)) for g in limits])).alias("gamma"))
    hit = F.col("v") > F.col("gamma")
    return rows.groupBy("gamma").agg(F.coalesce(F.sum(F.when(hit, F.col("v"))), F.lit(0)).alias("total"), F.count_if(hit).alias("count"), (F.count_if(hit) / F.count("*")).alias("fraction"))


def thin_by_gap(df: DataFrame, column: str, gap: float) -> DataFrame:
    """Ascending values, each kept if it is more than ``gap`` above the last kept one. For short lists of parameters."""
    values = df.agg(F.array_sort(F.collect_set(column)).alias("v"))
    keep = F.aggregate("v", F.array().cast("array<double>"), lambda s, x: F.when((F.size(s) == 0) | (F.round(x - F.element_at(s, -1), 12) > gap), F.concat(s, F.array(x))).otherwise(s))
    return values.select(F.explode(keep).alias(column))
