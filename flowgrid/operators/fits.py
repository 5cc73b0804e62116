"""Power-law against exponential decay of unloading curves, and what follows from it. Every fit is a grouped sum, exact in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowgrid.functions import exact
from flowgrid.operators.slices import bin_start

FIRST, BASE, LEAST_WINDOW = 4, 3, 10


#: Errors are compared after rounding, so that equal ones are equal however they were added up.
PLACES = 12


def _log(x: Column) -> Column:
    """ln of a positive number, null otherwise."""
    return F.when(x > 0, F.ln(x))


def _laws(x: str, y: str) -> dict[str, tuple[Column, Column]]:
    return {"pl": (_log(F.col(y)), _log(F.col(x))), "exp": (_log(F.col(y)), F.col(x))}


def _named(tags) -> list[Column]:
    """alpha, amplitude and rounded error of each law."""
    return [c for t in tags for c in (F.col(f"slope_{t}").alias(f"alpha_{t}"), F.exp(f"intercept_{t}").alias(f"a_{t}"), F.round(f"rmse_{t}", PLACES).alias(f"err_{t}"))]


def ols(points: DataFrame, by: list[str], y: str, x: str) -> DataFrame:
    """``by``, n, slope, intercept and rmse of a straight line for each group (null slope where x has one value)."""
    out = exact.fit_lines(points, by, {"": (F.col(y), F.col(x))})
    return out.select(*by, "n", *[F.col(f"{c}_").alias(c) for c in ("slope", "intercept", "rmse")])


def compare_pl_exp(points: DataFrame, by: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """Both fits of ln y for each group: error, amplitude and exponent of either."""
    laws = _laws(x, y)
    return exact.fit_lines(points, by, laws).select(*by, "n", *_named(laws))


def curve_positions(unload: DataFrame, run: list[str]) -> DataFrame:
    """run columns, i, k, t (hours), n: the bins with arrivals, numbered from 0."""
    i = F.row_number().over(Window.partitionBy(*run).orderBy("k")) - 1
    return unload.filter("n_rows > 0").select(*run, i.cast("bigint").alias("i"), "k", (bin_start(F.col("k")) / F.lit(3600.0)).alias("t"), F.col("n_rows").cast("double").alias("n"))


def window_points(curve: DataFrame, run: list[str], lag: int = 1) -> DataFrame:
    """run columns, i, t, x, y: the hours since position 3 and the value ``lag`` places before, at every position."""
    w = Window.partitionBy(*run)
    x = F.col("t") - F.max(F.when(F.col("i") == BASE, F.col("t"))).over(w)
    y = F.lag("n", lag).over(w.orderBy("i")) if lag else F.col("n")
    return curve.select(*run, "i", "t", x.alias("x"), y.alias("y"))


def expanding_fits(curve: DataFrame, run: list[str], lag: int = 1, least: int = LEAST_WINDOW) -> DataFrame:
    """Both fits for every window of every run: run columns, t0, t (where the window ends), n and the laws' columns.

    A window holds positions 4 to t0 - 1, so its sums are running sums of the run; they are exact, and so the same in any run of the job.
    """
    points = window_points(curve, run, lag).filter(F.col("i") >= FIRST)
    group = Window.partitionBy(*run)
    laws = _laws("x", "y")
    fitted = exact.running_lines(points, group, group.orderBy("i").rowsBetween(Window.unboundedPreceding, -1), laws)
    return fitted.filter(F.col("i") >= least).select(*run, F.col("i").alias("t0"), "t", "n", *_named(laws))


def jam_decision(runs: DataFrame, fits: DataFrame, run: list[str]) -> DataFrame:
    """run columns, verdict (jam, no jam, undecided), alpha, t and error of the best window of the winning law.

    A run is jammed if the power law has the lesser error in any window.
    """
    pl = F.col("err_pl") <= F.col("err_exp")
    best = fits.groupBy(*run).agg(
        F.bool_or(pl).alias("jam"),
        F.min(F.when(pl, F.struct(F.col("err_pl").alias("e"), "t", F.col("alpha_pl").alias("a")))).alias("b_pl"),
        F.min(F.when(~pl, F.struct(F.col("err_exp").alias("e"), "t", F.col("alpha_exp").alias("a")))).alias("b_exp"),
    )
    b = F.when(F.col("jam"), F.col("b_pl")).otherwise(F.col("b_exp"))
    verdict = F.when(F.col("jam").isNull(), "undecided").when(F.col("jam"), "jam").otherwise("no jam")
    out = runs.select(*run).distinct().join(best, run, "left").withColumn("b", b)
    return out.select(*run, verdict.alias("verdict"), F.col("b.a").alias("alpha"), F.col("b.t").alias("t"), F.col("b.e").alias("error"))


def tau_from_curve(fractions: DataFrame, run: list[str]) -> DataFrame:
    """run columns, tau: hours from the peak (the first of equals) to the first later bin with at most 1/e of it."""
    w = Window.partitionBy(*run)
    rows = fractions.withColumn("peak", F.max("fraction").over(w))
    rows = rows.withColumn("at", F.min(F.when(F.col("fraction") == F.col("peak"), F.col("time_hours"))).over(w))
    low = (F.col("time_hours") > F.col("at")) & (F.col("fraction") <= F.col("peak") / F.exp(F.lit(1.0)))
    return rows.groupBy(*run).agg((F.min(F.when(low, F.col("time_hours"))) - F.min("at")).alias("tau"))


def tau(decisions: DataFrame, curve_tau: DataFrame, run: list[str]) -> DataFrame:
    """run columns, verdict, tau: -1/alpha of the exponential if not jammed, from the curve if jammed."""
    out = decisions.join(curve_tau, run, "left")
    value = F.when(F.col("verdict") == "jam", F.col("tau")).when(F.col("verdict") == "no jam", F.try_divide(F.lit(-1.0), F.col("alpha")))
    return out.select(*run, "verdict", value.alias("tau"))


def fitted_curve(curve: DataFrame, fits: DataFrame, run: list[str]) -> DataFrame:
    """run columns, t0, i, n, fitted: the better law of every window on the window's positions, scaled to the value at position 4."""
    pl = F.col("err_pl") <= F.col("err_exp")
    w = Window.partitionBy(*run)
    points = curve.withColumn("x", F.col("t") - F.max(F.when(F.col("i") == BASE, F.col("t"))).over(w)).filter(F.col("i") >= FIRST).drop("t")
    rows = points.join(fits.drop("n", "t"), run).filter("i < t0")
    value = F.when(pl, F.col("a_pl") * F.pow("x", F.col("alpha_pl"))).otherwise(F.col("a_exp") * F.exp(F.col("alpha_exp") * F.col("x")))
    rows = rows.withColumn("value", value)
    first = Window.partitionBy(*run, "t0")
    at4 = lambda c: F.max(F.when(F.col("i") == FIRST, F.col(c))).over(first)
    return rows.select(*run, "t0", "i", "n", (F.col("value") * F.try_divide(at4("n"), at4("value"))).alias("fitted"))


def windowed_alpha(unload: DataFrame, run: list[str], start: int = 28, least: int = 4) -> DataFrame:
    """run columns, k, alpha, error: exponential fits from bin ``start`` on over windows of ``least`` bins or more, the one of least error."""
    rows = unload.filter(F.col("k") >= start).filter("n_rows > 0").select(*run, "k", ((F.col("k") - start + 1) / F.lit(4.0)).alias("x"), F.col("n_rows").cast("double").alias("y"))
    group = Window.partitionBy(*run)
    law = {"exp": _laws("x", "y")["exp"]}
    fit = exact.running_lines(rows, group, group.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), law)
    fit = fit.filter((F.col("n") >= least) & (F.col("k") >= start + least - 1)).select(*run, F.col("k").alias("end"), *_named(law))
    best = fit.groupBy(*run).agg(F.min(F.struct(F.col("err_exp").alias("e"), "end", "alpha_exp")).alias("b"))
    return best.select(*run, F.col("b.end").alias("k"), F.col("b.alpha_exp").alias("alpha"), F.col("b.e").alias("error"))


def beta(unload: DataFrame, critical: DataFrame) -> DataFrame:
    """uci10, k, n, beta, error: at each bin, ln of the number of rows on ln of epsilon over the rates above the critical one."""
    rows = unload.join(critical, "uci10").filter("r > r_critical and n_rows > 0")
    e = (F.col("r") * F.col("r") - F.col("r_critical") * F.col("r_critical")) / (F.col("r_critical") * F.col("r_critical"))
    rows = rows.select("uci10", "k", F.ln(e.cast("double")).alias("x"), F.ln(F.col("n_rows").cast("double")).alias("y"))
    return ols(rows, ["uci10", "k"], "y", "x").filter("n > 1").select("uci10", "k", "n", F.col("slope").alias("beta"), F.col("rmse").alias("error"))


# Critical exponents of directed percolation in 1, 2, 3 and 4 or more dimensions: beta, nu across, nu along.
DIRECTED_PERCOLATION = [("1", 0.276486, 1.096854, 1.733847), ("2", 0.584, 0.734, 1.295), ("3", 0.81, 0.581, 1.105), ("mean field", 1.0, 0.5, 1.0)]


def dp_exponents(decisions: DataFrame) -> DataFrame:
    """All columns of jammed runs with the class of directed percolation whose decay exponent delta = beta / nu_along is nearest."""
    spark = decisions.sparkSession
    known = spark.createDataFrame(DIRECTED_PERCOLATION, "dimension string, beta double, nu_across double, nu_along double")
    known = known.withColumns({"z": F.col("nu_along") / F.col("nu_across"), "delta": F.col("beta") / F.col("nu_along")})
    rows = decisions.filter("verdict = 'jam'").crossJoin(F.broadcast(known))  # four rows
    best = F.min_by(F.struct("dimension", "delta", "z"), F.struct(F.round(F.abs(-F.col("alpha") - F.col("delta")), 9), "dimension"))
    return rows.groupBy(*decisions.columns).agg(best.alias("b")).select(*decisions.columns, "b.*")
