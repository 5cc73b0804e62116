"""Fits: the same bits whatever the partitions, known lines and curves, degenerate groups."""

import math

from pyspark.sql import functions as F

from flowgrid.functions import exact
from flowgrid.operators import fits, gravity
from flowgrid.plans import flows, trips

RUN = trips.RUN


def raw(df, *keys):
    return {tuple(r[k] for k in keys): tuple(r) for r in df.collect()}


def test_fits_are_the_same_bits_in_any_order(spark, sf):
    curve = trips.curve(spark, sf).coalesce(1).cache()
    features = flows.features(spark, sf).coalesce(1).cache()
    first = None
    try:
        for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            mixed = lambda df, n=n: df.repartition(n, F.rand(n))
            points = mixed(features)
            got = (
                raw(fits.expanding_fits(mixed(curve), RUN), *RUN, "t0"),
                raw(fits.compare_pl_exp(points.withColumns({"x": F.col("d") + 1, "y": F.col("w")}), ["origin"]), "origin"),
                raw(fits.ols(points, ["destination"], "w", "d"), "destination"),
                raw(gravity.gravity_fit(points, ["origin"]), "origin"),
            )
            first = first or got
            assert got == first, n
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
    assert first[0] and first[1] and all(v is None or math.isfinite(v) for r in first[0].values() for v in r[4:])


def test_lines_and_their_errors(spark):
    rows = [("a", float(x), 3.0 - 0.5 * x) for x in range(20)] + [("b", 2.0, 1.0), ("b", 2.0, 5.0)] + [("c", 1.0, 7.0)] + [(None, float(x), 1e9 * x) for x in range(4)] + [("d", None, 1.0), ("d", 1.0, None)]
    got = {r.g: r for r in exact.fit_lines(spark.createDataFrame(rows, "g string, x double, y double"), ["g"], {"l": (F.col("y"), F.col("x"))}).collect()}
    assert got["a"].n == 20 and abs(got["a"].slope_l + 0.5) < 1e-11 and abs(got["a"].intercept_l - 3) < 1e-10 and got["a"].rmse_l < 1e-5
    assert got["b"].slope_l is None and got["c"].slope_l is None and got["d"].slope_l is None and got["d"].n == 2
    assert abs(got[None].slope_l - 1e9) < 1e-2
    with_error = [("e", float(x), float(x + (-1) ** x)) for x in range(1000)]
    r = exact.fit_lines(spark.createDataFrame(with_error, "g string, x double, y double"), ["g"], {"l": (F.col("y"), F.col("x"))}).first()
    assert abs(r.rmse_l - 1) < 1e-5


def test_running_lines_are_those_of_their_prefix(spark):
    from pyspark.sql import Window

    rows = [(k, math.log(k + 2), math.sin(k)) for k in range(30)]
    df = spark.createDataFrame(rows, "k long, x double, y double").withColumn("g", F.lit(1))
    w = Window.partitionBy("g")
    line = {"": (F.col("y"), F.col("x"))}
    got = {r.k: r for r in exact.running_lines(df, w, w.orderBy("k").rowsBetween(Window.unboundedPreceding, 0), line).collect()}
    for k in (1, 5, 29):
        want = exact.fit_lines(df.filter(F.col("k") <= k), [], line).first()
        assert got[k].n == want.n == k + 1 and abs(got[k].slope_ - want.slope_) < 1e-9 and abs(got[k].rmse_ - want.rmse_) < 1e-6


def test_equal_errors_count_as_a_jam(spark):
    """Both laws fit a constant curve without an error: the power law wins the tie."""
    curve = spark.createDataFrame([(1, 1, i, i, i / 4, 5.0) for i in range(30)], "uci10 long, r long, i long, k long, t double, n double")
    f = fits.expanding_fits(curve, RUN)
    assert {(r.err_pl, r.err_exp) for r in f.collect()} == {(0.0, 0.0)}
    assert {r.verdict for r in fits.jam_decision(curve, f, RUN).collect()} == {"jam"}


def test_empty_tables(spark):
    none = spark.createDataFrame([], "g string, x double, y double")
    assert exact.fit_lines(none, ["g"], {"l": (F.col("y"), F.col("x"))}).count() == 0
    assert exact.moments(none, [], {"x": F.col("x"), "y": F.col("y")}).count() == 0
