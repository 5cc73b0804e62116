"""Queries on trips, trajectories, time slices and fits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowgrid.functions.storage import materialize
from flowgrid.operators import fits, slices, trajectory
from flowgrid.plans.catalogue import query
from flowgrid.plans.views import table, view

RUN = ["uci10", "r"]
CONTROL = "time_departure >= 25200 AND time_departure < 28800"


#: Rows of routes that a task sorts and spreads over time, however large the table is.
TASK_ROWS = 1_000_000


def task_count(spark: SparkSession, d: str) -> int | None:
    """Over how many tasks the rows of routes are dealt; with few rows none: Spark's own partitions, one for each core at least, are small enough."""
    parts = table(spark, d, "lineitem").count() // TASK_ROWS  # from the files' footers
    return parts if parts > spark.sparkContext.defaultParallelism else None


def traj(spark: SparkSession, d: str) -> DataFrame:
    views = (view(spark, d, name) for name in ("routes", "people", "edges"))
    return trajectory.road_times(trajectory.trajectory(*views, task_count(spark, d)))


def road_slices(spark: SparkSession, d: str) -> DataFrame:
    return slices.edge_slices(traj(spark, d), parts=task_count(spark, d))


def run_traj(spark: SparkSession, d: str) -> DataFrame:
    """The control group's trajectories with their runs."""
    people = trajectory.control_group(view(spark, d, "people"))
    fact = trajectory.trajectory(view(spark, d, "routes"), people, view(spark, d, "edges"))
    return fact.join(view(spark, d, "runs"), "p")


def unload(spark: SparkSession, d: str) -> DataFrame:
    return slices.unload_curve(run_traj(spark, d), RUN)


def curve(spark: SparkSession, d: str) -> DataFrame:
    return fits.curve_positions(unload(spark, d), RUN)


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    return df.select(*[F.round(c, places).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes])


@query("m01_parse_route", "SELECT p, pos, route FROM routes")
def m01(spark, d):
    parts = view(spark, d, "routes").groupBy("p").agg(F.array_sort(F.collect_list(F.struct("pos", "route"))).alias("x"))
    text = parts.select("p", F.concat(F.lit("["), F.array_join(F.col("x.route").cast("array<string>"), ","), F.lit(",]")).alias("route"))
    return trajectory.explode_routes(text).select("p", F.col("pos").cast("bigint").alias("pos"), "route")


@query("p01_control_group", f"SELECT p, time_departure FROM people WHERE {CONTROL}")
def p01(spark, d):
    return trajectory.control_group(view(spark, d, "people")).select("p", "time_departure")


@query("p02_arrived_in", "SELECT p, last_time_simulated FROM people WHERE last_time_simulated >= 27000 AND last_time_simulated < 30000")
def p02(spark, d):
    return trajectory.arrived_in(view(spark, d, "people"), 27000, 30000).select("p", "last_time_simulated")


@query("p03_drop_if_present", "SELECT p, time_departure, num_steps, last_time_simulated FROM people")
def p03(spark, d):
    return trajectory.drop_if_present(view(spark, d, "people"), ["o_custkey", "distance", "no_such_column"])


@query("p04_dedupe", "SELECT u, v, min(uniqueid) AS uniqueid FROM edges GROUP BY u, v")
def p04(spark, d):
    return trajectory.dedupe(view(spark, d, "edges"), ["u", "v"], ["uniqueid"]).select("u", "v", "uniqueid")


@query("p05_convert_units", "SELECT uniqueid, round(speed_mph * 1.6::double, 6) AS speed_kmh, round(speed_mph * 1.60934::double, 6) AS speed_kmh_roads, round(length / 1000, 6) AS length_km, round(speed_mph * 1.6::double / 3.6::double, 6) AS mps FROM edges")
def p05(spark, d):
    return rounded(trajectory.convert_units(view(spark, d, "edges")).select("uniqueid", "speed_kmh", "speed_kmh_roads", "length_km", "mps"))


@query("p06_valid_trips", "SELECT p, round(distance / num_steps * 3.6::double, 6) AS kmh FROM people WHERE num_steps <> 0 AND distance / num_steps * 3.6::double < 150")
def p06(spark, d):
    return rounded(trajectory.valid_trips(view(spark, d, "people")).select("p", "kmh"))


@query("j01_routes_people", "SELECT r.p, r.pos, r.route, w.time_departure FROM routes r LEFT JOIN people w ON r.p = w.p")
def j01(spark, d):
    return view(spark, d, "routes").join(view(spark, d, "people"), "p", "left").select("p", "pos", "route", "time_departure")


@query("j02_trajectory", "SELECT p, pos, route, length, capacity, round(kmh, 6) AS kmh FROM traj")
def j02(spark, d):
    fact = trajectory.trajectory(view(spark, d, "routes"), view(spark, d, "people"), view(spark, d, "edges"))
    return rounded(fact.select("p", "pos", "route", "length", "capacity", "kmh"))


@query("j03_edges_capacity", "SELECT uniqueid, u, v, lanes, capacity / lanes AS lane_capacity FROM edges")
def j03(spark, d):
    e = view(spark, d, "edges")
    return e.select("uniqueid", "u", "v").join(e.select("uniqueid", "lanes", (F.col("capacity") / F.col("lanes")).alias("lane_capacity")), "uniqueid")


@query("w01_road_times", "SELECT p, pos, route, round(own, 5) AS own, round(time_entering_road, 5) AS time_entering_road, round(time_leaving_road, 5) AS time_leaving_road FROM traj")
def w01(spark, d):
    return rounded(traj(spark, d).select("p", "pos", "route", "own", "time_entering_road", "time_leaving_road"), 5)


@query("a01_unload_curve", "SELECT uci10, r, k, n_rows, n_people FROM unload")
def a01(spark, d):
    return unload(spark, d)


@query("a02_fractions", "SELECT uci10, r, k, round(floor(k * 86400 / 95.0) / 3600, 6) AS time_hours, round(n_rows / nullif(sum(n_rows) OVER (PARTITION BY uci10, r), 0), 9) AS fraction FROM unload")
def a02(spark, d):
    return slices.fractions(unload(spark, d), RUN).select(*RUN, "k", F.round("time_hours", 6).alias("time_hours"), F.round("fraction", 9).alias("fraction"))


@query("a03_arrival_histogram", "SELECT last_time_simulated // 1500 AS k, count(*) AS n FROM people WHERE time_departure <> last_time_simulated AND last_time_simulated % 1500 <> 0 GROUP BY 1")
def a03(spark, d):
    return slices.arrival_histogram(view(spark, d, "people"))


STABBED = """SELECT traj.*, unnest(range((ceil(a)::BIGINT * 95 + 86399) // 86400, least(((floor(b)::BIGINT + 1) * 95 - 1) // 86400, 95) + 1)) AS k
    FROM (SELECT *, {a} AS a, time_leaving_road AS b FROM traj) AS traj"""
BY_DEPARTURE, BY_ENTRY = STABBED.format(a="time_departure"), STABBED.format(a="round(time_entering_road, 6)")
SLICES = f"SELECT route, k, count(p) AS flux, avg(kmh) AS speed_kmh FROM ({BY_DEPARTURE}) GROUP BY route, k"


def rounded_traj(spark, d):
    """Entering times rounded, so that sums of floats don't decide which instant is covered."""
    return traj(spark, d).withColumn("time_entering_road", F.round("time_entering_road", 6))


@query("j07_stabbing", f"SELECT p, pos, k FROM ({BY_DEPARTURE})")
def j07(spark, d):
    return slices.stab(traj(spark, d)).select("p", "pos", "k")


@query("a04_edge_slices", f"SELECT route, k, flux, round(speed_kmh, 6) AS speed_kmh FROM ({SLICES})")
def a04(spark, d):
    return rounded(road_slices(spark, d))


@query("a05_edge_slices_wide", f"SELECT route, coalesce(max(CASE WHEN k = 28 THEN flux END), 0) AS flux_28, round(coalesce(max(CASE WHEN k = 28 THEN speed_kmh END), 0), 6) AS speed_kmh_28, coalesce(max(CASE WHEN k = 36 THEN flux END), 0) AS flux_36, round(coalesce(max(CASE WHEN k = 36 THEN speed_kmh END), 0), 6) AS speed_kmh_36 FROM ({SLICES}) GROUP BY route")
def a05(spark, d):
    return rounded(slices.edge_slices_wide(road_slices(spark, d), [28, 36]))


@query("j04_edges_slices", f"SELECT e.uniqueid, e.u, e.v, k, flux FROM edges e LEFT JOIN ({SLICES}) s ON e.uniqueid = s.route WHERE e.uniqueid IN (SELECT min(uniqueid) FROM edges GROUP BY u, v)")
def j04(spark, d):
    return slices.edges_with_slices(view(spark, d, "edges"), road_slices(spark, d)).select("uniqueid", "u", "v", "k", "flux")


@query("a17_gamma", f"SELECT round(sum(length) / sum(capacity * length), 12) AS gamma FROM traj WHERE {CONTROL}")
def a17(spark, d):
    return slices.gamma(trajectory.control_group(traj(spark, d))).select(F.round("gamma", 12).alias("gamma"))


@query("a18_mfd_road_time", f"SELECT e.uniqueid AS route, t.k, round(coalesce(s.speed_kmh, e.speed_mph * 1.6::double), 6) AS speed_kmh, coalesce(s.flux, 0) AS people FROM edges e CROSS JOIN (SELECT unnest(range(96)) AS k) t LEFT JOIN ({SLICES}) s ON s.route = e.uniqueid AND s.k = t.k")
def a18(spark, d):
    return rounded(slices.road_time_table(view(spark, d, "edges"), road_slices(spark, d), spark.range(96).withColumnRenamed("id", "k")))


@query("a19_mfd", f"SELECT k, cast(sum(flux) AS BIGINT) AS people, round(sum(speed_kmh * flux), 4) AS flow FROM ({SLICES}) GROUP BY k")
def a19(spark, d):
    return rounded(slices.mfd(road_slices(spark, d)), 4)


CLASSED = f"SELECT route, u, v, k, round(speed_kmh / (speed_mph * 1.6::double), 9) AS ratio FROM ({SLICES}) JOIN edges ON route = uniqueid"


@query("c01_classes", f"SELECT route, k, ratio, ratio < 0.25 AS severe, ratio < 0.5 AS moderate, ratio < 0.9 AS free_flow, CASE WHEN ratio < 0.25 THEN 'severe' WHEN ratio < 0.5 THEN 'moderate' WHEN ratio < 0.9 THEN 'free_flow' ELSE 'none' END AS traffic_class FROM ({CLASSED})")
def c01(spark, d):
    classes = slices.traffic_classes(road_slices(spark, d), view(spark, d, "edges"))
    return classes.select("route", "k", "ratio", "severe", "moderate", "free_flow", "traffic_class")


@query("a27_class_counts", f"SELECT k, count(*) FILTER (ratio < 0.25) AS severe, count(*) FILTER (ratio < 0.5) AS moderate, count(*) FILTER (ratio < 0.9) AS free_flow, count(*) AS roads FROM ({CLASSED}) GROUP BY k")
def a27(spark, d):
    return slices.class_counts(slices.traffic_classes(road_slices(spark, d), view(spark, d, "edges")))


@query("j13_flag_merge", f"SELECT e.uniqueid, e.u, e.v, coalesce(c.ratio < 0.5, false) AS moderate FROM edges e LEFT JOIN (SELECT * FROM ({CLASSED}) WHERE k = 32) c ON c.route = e.uniqueid")
def j13(spark, d):
    e = view(spark, d, "edges")
    flags = slices.traffic_classes(road_slices(spark, d).filter("k = 32"), e).select(F.col("route").alias("uniqueid"), "moderate")
    return e.select("uniqueid", "u", "v").join(flags, "uniqueid", "left").fillna(False, ["moderate"])


@query("a31_trapped", f"SELECT route, k, count(DISTINCT p) AS n, string_agg(DISTINCT p::VARCHAR, ',' ORDER BY p::VARCHAR) AS users FROM ({BY_ENTRY}) GROUP BY route, k")
def a31(spark, d):
    out = slices.trapped(rounded_traj(spark, d))
    return out.select("route", "k", "n", F.array_join(F.array_sort(F.col("users").cast("array<string>")), ",").alias("users"))


AT = f"SELECT DISTINCT p, k, route FROM ({BY_ENTRY})"


@query("j08_transitions", f"SELECT a.k, a.route AS e, b.route AS e2, count(*) AS n FROM ({AT}) a JOIN ({AT}) b ON a.p = b.p AND b.k = a.k + 1 GROUP BY ALL")
def j08(spark, d):
    return slices.transitions(rounded_traj(spark, d)).select("k", "e", "e2", "n")


@query("u02_both_edges", f"SELECT a.k, a.p FROM ({AT}) a JOIN ({AT}) b ON a.p = b.p AND b.k = a.k + 1 AND b.route <> a.route GROUP BY ALL")
def u02(spark, d):
    at = slices.stab(rounded_traj(spark, d), "time_entering_road").select("p", "k", "route").distinct()
    later = at.select("p", (F.col("k") - 1).alias("k"), F.col("route").alias("e2"))
    return at.join(later, ["p", "k"]).filter("route <> e2").select("k", "p").distinct()


@query("c12_transition_matrix", f"SELECT a.k, a.route AS e, b.route AS e2, round(count(*) / sum(count(*)) OVER (PARTITION BY a.k, a.route), 9) AS share FROM ({AT}) a JOIN ({AT}) b ON a.p = b.p AND b.k = a.k + 1 GROUP BY a.k, a.route, b.route")
def c12(spark, d):
    return slices.transitions(rounded_traj(spark, d)).select("k", "e", "e2", F.round("share", 9).alias("share"))


_EXITED = f"WITH at_k AS (SELECT DISTINCT p, k FROM ({BY_ENTRY})) SELECT k, count(*) AS n FROM at_k a WHERE NOT EXISTS (SELECT 1 FROM at_k b WHERE b.p = a.p AND b.k = a.k + 1) GROUP BY k"
for _name in ("j09_exited", "u03_difference"):
    query(_name, _EXITED)(lambda spark, d: slices.exited(rounded_traj(spark, d)))


@query("a32_routes_used", "SELECT count(*) AS n_edges, count(r) AS n_used, count(*) - count(r) AS n_unused FROM edges LEFT JOIN (SELECT DISTINCT route AS r FROM routes) x ON uniqueid = r")
def a32(spark, d):
    return slices.routes_used(view(spark, d, "routes"), view(spark, d, "edges"))


@query("b01_present", "SELECT k, count(*) AS n FROM (SELECT DISTINCT p, time_departure AS a, last_time_simulated AS b FROM traj) x CROSS JOIN (SELECT unnest(range(96)) AS k) t WHERE floor(k * 86400 / 95.0) >= a AND floor(k * 86400 / 95.0) < b GROUP BY k")
def b01(spark, d):
    return slices.present(traj(spark, d))


FIT_COLUMNS = ("alpha_pl", "a_pl", "err_pl", "alpha_exp", "a_exp", "err_exp")
_FITS = "SELECT uci10, r, t0, n, " + ", ".join(f"round({c}, 5) AS {c}" for c in FIT_COLUMNS) + " FROM fits"


@query("w05_expanding_fits", _FITS)
def w05(spark, d):
    return rounded(fits.expanding_fits(curve(spark, d), RUN).select(*RUN, "t0", "n", *FIT_COLUMNS), 5)


@query("f02_pl_vs_exp", "SELECT uci10, r, t0, round(err_pl, 6) AS err_pl, round(err_exp, 6) AS err_exp, CASE WHEN err_pl <= err_exp THEN 'power law' ELSE 'exponential' END AS best FROM fits")
def f02(spark, d):
    out = fits.expanding_fits(curve(spark, d), RUN)
    return rounded(out.select(*RUN, "t0", "err_pl", "err_exp", F.when(F.col("err_pl") <= F.col("err_exp"), "power law").otherwise("exponential").alias("best")))


DECIDED = """SELECT g.uci10, g.r, CASE WHEN jam IS NULL THEN 'undecided' WHEN jam THEN 'jam' ELSE 'no jam' END AS verdict, alpha, t, error
    FROM (SELECT DISTINCT uci10, r FROM unload) g LEFT JOIN (
    SELECT uci10, r, jam, CASE WHEN jam THEN arg_min(alpha_pl, round(err_pl, 12)) FILTER (err_pl <= err_exp) ELSE arg_min(alpha_exp, round(err_exp, 12)) END AS alpha,
      CASE WHEN jam THEN arg_min(t, round(err_pl, 12)) FILTER (err_pl <= err_exp) ELSE arg_min(t, round(err_exp, 12)) END AS t,
      CASE WHEN jam THEN min(err_pl) FILTER (err_pl <= err_exp) ELSE min(err_exp) END AS error
    FROM (SELECT *, bool_or(err_pl <= err_exp) OVER (PARTITION BY uci10, r) AS jam FROM fits) f GROUP BY uci10, r, jam) x ON x.uci10 = g.uci10 AND x.r = g.r"""


def decisions(spark, d, stored=None):
    """The decision of every run, from the unloading curve: it is read three times, so it is stored (95 rows a run)."""
    c = materialize(unload(spark, d), "unload") if stored is None else stored
    return fits.jam_decision(c, fits.expanding_fits(fits.curve_positions(c, RUN), RUN), RUN)


@query("f03_jam", f"SELECT uci10, r, verdict, round(alpha, 5) AS alpha, round(t, 6) AS t, round(error, 6) AS error FROM ({DECIDED})")
def f03(spark, d):
    out = decisions(spark, d)
    return out.select(*RUN, "verdict", F.round("alpha", 5).alias("alpha"), F.round("t", 6).alias("t"), F.round("error", 6).alias("error"))


@query("t03_best_window", "SELECT uci10, r, arg_min(t0, round(least(err_pl, err_exp), 12)) AS t0, round(min(least(err_pl, err_exp)), 6) AS error FROM fits GROUP BY uci10, r")
def t03(spark, d):
    f = fits.expanding_fits(curve(spark, d), RUN).withColumn("e", F.least("err_pl", "err_exp"))
    return f.groupBy(*RUN).agg(F.min_by("t0", F.struct(F.round("e", 12), "t0")).alias("t0"), F.round(F.min("e"), 6).alias("error"))


@query("f01_ols", "SELECT route % 10 AS g, round(regr_slope(kmh, length), 9) AS slope, round(regr_intercept(kmh, length), 6) AS intercept FROM traj GROUP BY 1")
def f01(spark, d):
    out = fits.ols(traj(spark, d).withColumn("g", F.col("route") % 10), ["g"], "kmh", "length")
    return out.select("g", F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


CURVE_TAU = """SELECT uci10, r, min(CASE WHEN h > top AND f <= peak / exp(1.0::double) THEN h END) - min(top) AS tau FROM (
    SELECT *, min(CASE WHEN f = peak THEN h END) OVER (PARTITION BY uci10, r) AS top FROM (
    SELECT uci10, r, floor(k * 86400 / 95.0) / 3600 AS h, n_rows / sum(n_rows) OVER (PARTITION BY uci10, r) AS f, max(n_rows / t) OVER (PARTITION BY uci10, r) AS peak
    FROM (SELECT *, sum(n_rows) OVER (PARTITION BY uci10, r) AS t FROM unload) u)) GROUP BY uci10, r"""


@query("w07_tau_from_curve", f"SELECT uci10, r, round(tau, 6) AS tau FROM ({CURVE_TAU})")
def w07(spark, d):
    return rounded(fits.tau_from_curve(slices.fractions(unload(spark, d), RUN), RUN))


TAU = f"SELECT x.uci10, x.r, verdict, CASE verdict WHEN 'jam' THEN c.tau WHEN 'no jam' THEN -1 / nullif(alpha, 0) END AS tau FROM ({DECIDED}) x LEFT JOIN ({CURVE_TAU}) c ON c.uci10 = x.uci10 AND c.r = x.r"


def taus(spark, d, fact=None):
    c = materialize(unload(spark, d) if fact is None else slices.unload_curve(fact, RUN), "unload")
    return fits.tau(decisions(spark, d, c), fits.tau_from_curve(slices.fractions(c, RUN), RUN), RUN)


@query("f04_tau", f"SELECT uci10, r, verdict, round(tau, 4) AS tau FROM ({TAU})")
def f04(spark, d):
    return rounded(taus(spark, d), 4)


@query("f17_gamma_tau", f"SELECT uci10, r, round(gamma, 12) AS gamma, round(tau, 4) AS tau FROM ({TAU}) JOIN (SELECT uci10, r, sum(length) / sum(capacity * length) AS gamma FROM traj JOIN runs USING (p) WHERE {CONTROL} GROUP BY uci10, r) USING (uci10, r)")
def f17(spark, d):
    fact = materialize(run_traj(spark, d), "trajectory")
    return taus(spark, d, fact).join(slices.gamma(fact, RUN), RUN).select(*RUN, F.round("gamma", 12).alias("gamma"), F.round("tau", 4).alias("tau"))


@query("t04_critical_rate", f"SELECT uci10, min(r) FILTER (verdict = 'jam') AS r_critical FROM ({DECIDED}) GROUP BY uci10")
def t04(spark, d):
    return decisions(spark, d).groupBy("uci10").agg(F.min(F.when(F.col("verdict") == "jam", F.col("r"))).alias("r_critical"))
