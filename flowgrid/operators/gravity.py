"""Gravity model of flows: features, least-squares fit by grouped sums, prediction, rescaling, profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowgrid.functions import exact
from flowgrid.operators import blocks


def flow_features(tij: DataFrame, pairs: DataFrame, cells: DataFrame) -> DataFrame:
    """origin, destination, w (people), mi, mj (populations), d (km) of all flows between known cells."""
    m = lambda name, side: cells.select(F.col("idx").alias(side), F.col("population").cast("double").alias(name))
    rows = tij.join(pairs.select(F.col("i").alias("origin"), F.col("j").alias("destination"), F.col("distance").alias("d")), ["origin", "destination"])
    rows = rows.join(m("mi", "origin"), "origin").join(m("mj", "destination"), "destination")
    return rows.select("origin", "destination", F.col("number_people").cast("double").alias("w"), "mi", "mj", "d")


def usable(features: DataFrame) -> DataFrame:
    """Flows with people and both masses above 0; those inside a cell (no distance) count."""
    return features.filter("w > 0 and mi > 0 and mj > 0")


def usable_share(features: DataFrame) -> DataFrame:
    ok = F.expr("w > 0 and mi > 0 and mj > 0")
    return features.agg(F.count_if(ok).alias("kept"), F.count("*").alias("flows"), (F.count_if(ok) / F.count("*")).alias("share"))


def gravity_fit(features: DataFrame, by: list[str] | None = None) -> DataFrame:
    """logk, alpha, gamma, inverse_d0 (and n) of ln w on ln mi, ln mj and d, for each group.

    Values are placed between the ends of their range as whole numbers, whose products add up exactly; the three slopes follow by
    elimination on the centred sums, so equal rows give equal bits in any order.
    """
    terms = {"a": F.ln("mi"), "b": F.ln("mj"), "c": F.col("d"), "y": F.ln("w")}
    s = exact.moments(usable(features), by or [], terms)
    # eliminate a, then b
    s = s.withColumns({"f1": F.try_divide("ab", "aa"), "f2": F.try_divide("ac", "aa")})
    s = s.withColumns({"bb1": F.expr("bb - f1 * ab"), "bc1": F.expr("bc - f1 * ac"), "by1": F.expr("`by` - f1 * ay"), "cc1": F.expr("cc - f2 * ac"), "cy1": F.expr("cy - f2 * ay")})
    s = s.withColumn("f3", F.try_divide("bc1", "bb1"))
    s = s.withColumn("inverse_d0", F.expr("try_divide(cy1 - f3 * by1, cc1 - f3 * bc1)"))
    s = s.withColumn("gamma", F.expr("try_divide(by1 - bc1 * inverse_d0, bb1)")).withColumn("alpha", F.expr("try_divide(ay - ab * gamma - ac * inverse_d0, aa)"))
    return s.select(*(by or []), "n", F.expr("my - alpha * ma - gamma * mb - inverse_d0 * mc").alias("logk"), "alpha", "gamma", "inverse_d0")


def predict(features: DataFrame, params: DataFrame) -> DataFrame:
    """Adds w_model with one row of parameters, rescaled so that the totals agree (scale is the factor)."""
    raw = F.exp("logk") * F.pow("mi", F.col("alpha")) * F.pow("mj", F.col("gamma")) * F.exp(F.col("d") * F.col("inverse_d0"))
    rows = usable(features).crossJoin(F.broadcast(params.select("logk", "alpha", "gamma", "inverse_d0"))).withColumn("raw", raw)  # one row
    total = rows.agg((F.sum("w") / F.sum("raw")).alias("scale"))
    return rows.crossJoin(F.broadcast(total)).withColumn("w_model", F.col("raw") * F.col("scale"))  # one row


def gravity_flows(cells: DataFrame, pairs: DataFrame, k: float, alpha: float, gamma: float, inverse_d0: float, total: float, by: list[str] | None = None) -> DataFrame:
    """origin, destination, people: flows of given populations, 0 for empty cells or far pairs, rescaled to ``total`` for each group."""
    m = F.col("population").cast("double")
    mass = lambda power: F.when(F.floor(m) == 0, F.lit(0.0)).otherwise(F.pow(m, F.lit(power)))
    weights = cells.select(*(by or []), "idx", (k * mass(alpha)).alias("w"), mass(gamma).alias("u"))
    decay = F.exp(F.col("distance") * inverse_d0)
    near = pairs.select("i", "j", F.when(decay > 1e-4, decay).otherwise(F.lit(0.0)).alias("decay"))
    rows = blocks.pair_products(near, "decay", weights, by or [], "w", "u", total)
    return rows.select(*(by or []), F.col("i").alias("origin"), F.col("j").alias("destination"), F.col("amount").alias("people"))


def gravity_estimate(features: DataFrame, d0: float) -> DataFrame:
    """origin < destination, w, estimate mi * mj * exp(-d / d0), and whether it is an error (ten times the largest flow or more)."""
    rows = features.filter("origin < destination").withColumn("estimate", F.col("mi") * F.col("mj") * F.exp(-F.col("d") / d0))
    top = rows.agg(F.max("w").alias("top"))
    return rows.crossJoin(F.broadcast(top)).select("origin", "destination", "w", "estimate", (F.col("estimate") >= 10 * F.col("top")).alias("is_error"))  # one row


def binned_profile(predicted: DataFrame, alpha: float, gamma: float, bins: int) -> DataFrame:
    """bin, n, mean, spread (2 std) of w / (mi^alpha mj^gamma), ratio and ratio_spread of w_model / w over the first bin's.

    Distance bins are open at both ends, so points on a limit are left out.
    """
    ends = predicted.agg(F.min("d").alias("lo"), ((F.max("d") - F.min("d")) / bins).alias("wide"))
    rows = predicted.crossJoin(F.broadcast(ends)).withColumn("place", F.round((F.col("d") - F.col("lo")) / F.col("wide"), 9))  # one row
    rows = rows.filter(F.col("place") != F.floor("place")).withColumn("bin", F.floor("place"))
    flux, ratio = F.col("w") / (F.pow("mi", F.lit(alpha)) * F.pow("mj", F.lit(gamma))), F.col("w_model") / F.col("w")
    out = rows.groupBy("bin").agg(F.count("*").alias("n"), F.avg(flux).alias("mean"), F.coalesce(2 * F.stddev_samp(flux), F.lit(0.0)).alias("spread"), F.avg(ratio).alias("r"), F.coalesce(2 * F.stddev_samp(ratio), F.lit(0.0)).alias("rs"))
    first = out.agg(F.min_by("r", "bin").alias("r0"))
    return out.crossJoin(F.broadcast(first)).select("bin", "n", "mean", "spread", (F.col("r") / F.col("r0")).alias("ratio"), (F.col("rs") / F.col("r0")).alias("ratio_spread"))  # one row


def fit_error_summary(predicted: DataFrame) -> DataFrame:
    e = F.abs(F.col("w_model") - F.col("w")) / F.col("w")
    return predicted.agg(F.max("w").alias("max_flow"), F.max("w_model").alias("max_model"), F.max(e).alias("max_error"), F.min(e).alias("min_error"), F.avg(e).alias("mean_error"), F.sum("w").alias("flow"), F.sum("w_model").alias("model"))


def initial_guesses(features: DataFrame) -> DataFrame:
    """One row of starting values with unit exponents: logk from the mean logarithm, log_mean_k from the mean of people
    over the squared population of the origin, inverse_d0 from the mean distance of flows between cells. Null without a flow."""
    u = usable(features)
    return u.agg(
        F.avg(F.ln("w") - F.ln("mi") - F.ln("mj")).alias("logk"), F.ln(F.avg(F.col("w") / (F.col("mi") * F.col("mi")))).alias("log_mean_k"),
        F.try_divide(F.lit(1.0), F.avg(F.when(F.col("d") != 0, F.col("d")))).alias("inverse_d0"),
    )


def od_matrix(tij: DataFrame, cells: DataFrame) -> DataFrame:
    """origin, destination, number_people and both cells' (i, j), every pair of cells, 0 where no one goes."""
    a = cells.select(F.col("idx").alias("origin"), F.col("i").alias("oi"), F.col("j").alias("oj"))
    b = cells.select(F.col("idx").alias("destination"), F.col("i").alias("di"), F.col("j").alias("dj"))
    return a.crossJoin(b).join(tij, ["origin", "destination"], "left").fillna(0, ["number_people"])  # all pairs by definition


def gershgorin(tij: DataFrame, upper: bool = False) -> DataFrame:
    """i, center, radius, bound of each row's disc; ``upper`` sums only beyond the diagonal."""
    off = F.col("destination") > F.col("origin") if upper else F.col("destination") != F.col("origin")
    v = F.abs("number_people")
    center, radius = F.sum(F.when(F.col("origin") == F.col("destination"), v).otherwise(0)), F.sum(F.when(off, v).otherwise(0))
    return tij.groupBy(F.col("origin").alias("i")).agg(center.alias("center"), radius.alias("radius"), (center + radius).alias("bound"))


def top_flows(tij: DataFrame, k: int) -> DataFrame:
    """The k largest flows and their share of all people; ties by origin and destination."""
    total = tij.agg(F.sum("number_people").alias("t"))
    top = tij.orderBy(F.desc("number_people"), "origin", "destination").limit(k)
    return top.crossJoin(F.broadcast(total)).select("origin", "destination", "number_people", (F.col("number_people") / F.col("t")).alias("share"))  # one row


def pair_rows(pairs: DataFrame) -> DataFrame:
    """i, distances: each cell's row of the distance matrix as an array in order of j."""
    return pairs.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "distance"))), lambda x: x["distance"]).alias("distances"))


def proportional_fit(df: DataFrame, column: str, total: float, by: list[str] | None = None) -> DataFrame:
    """``column`` scaled so that it sums to ``total`` in each group."""
    sums = df.groupBy(*(by or [])).agg(F.sum(column).alias("_s"))
    out = df.join(F.broadcast(sums), by) if by else df.crossJoin(F.broadcast(sums))  # a row for each group
    return out.withColumn(column, F.try_divide(F.col(column) * F.lit(float(total)), F.col("_s"))).drop("_s")


