"""Queries on flows, gravity and centrality."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowgrid.functions import curves
from flowgrid.operators import centrality, gravity, tiling
from flowgrid.plans.catalogue import query
from flowgrid.plans.trips import rounded
from flowgrid.plans.views import view


def pairs(spark, d):
    return tiling.cell_pairs(view(spark, d, "cells")).withColumn("distance", F.round("distance", 9))


def features(spark, d):
    return gravity.flow_features(view(spark, d, "tij"), pairs(spark, d), view(spark, d, "cells"))


FEATURES = "SELECT origin, destination, number_people::double AS w, a.population::double AS mi, b.population::double AS mj, distance AS d FROM tij JOIN pairs ON origin = i AND destination = j JOIN cells a ON a.idx = origin JOIN cells b ON b.idx = destination"
USABLE = f"SELECT * FROM ({FEATURES}) WHERE w > 0 AND mi > 0 AND mj > 0"


@query("j05_flow_features", f"SELECT origin, destination, w, mi, mj, round(d, 6) AS d FROM ({FEATURES})")
def j05(spark, d):
    return rounded(features(spark, d))


@query("j06_pair_attributes", "SELECT z.i, z.j, a.population AS population_i, b.population AS population_j FROM pairs z JOIN cells a ON a.idx = z.i JOIN cells b ON b.idx = z.j")
def j06(spark, d):
    c = view(spark, d, "cells")
    side = lambda s: c.select(F.col("idx").alias(s), F.col("population").alias(f"population_{s}"))
    return pairs(spark, d).select("i", "j").join(side("i"), "i").join(side("j"), "j")


@query("p25_positive_flows", f"SELECT (SELECT count(*) FROM ({USABLE})) AS kept, count(*) AS flows, round((SELECT count(*) FROM ({USABLE})) / count(*), 9) AS share FROM ({FEATURES})")
def p25(spark, d):
    return rounded(gravity.usable_share(features(spark, d)), 9)


# Frisch-Waugh: residuals of everything on the first variable, then on the second
RESIDUAL = f"""SELECT *, ln(w) AS y, ln(mi) AS a, ln(mj) AS b FROM ({USABLE})"""
STEP1 = f"""SELECT y - (SELECT regr_slope(y, a) FROM q) * a - (SELECT regr_intercept(y, a) FROM q) AS y1, b - (SELECT regr_slope(b, a) FROM q) * a - (SELECT regr_intercept(b, a) FROM q) AS b1,
    d - (SELECT regr_slope(d, a) FROM q) * a - (SELECT regr_intercept(d, a) FROM q) AS d1 FROM q"""
FIT_WITH = f"""q AS (SELECT *, ln(w) AS y, ln(mi) AS a, ln(mj) AS b FROM ({USABLE})), s1 AS ({STEP1}),
    s2 AS (SELECT y1 - (SELECT regr_slope(y1, b1) FROM s1) * b1 AS y2, d1 - (SELECT regr_slope(d1, b1) FROM s1) * b1 AS d2 FROM s1),
    k3 AS (SELECT regr_slope(y2, d2) AS c FROM s2), k2 AS (SELECT regr_slope(y1 - c * d1, b1) AS g, any_value(c) AS c FROM s1, k3),
    fit AS (SELECT count(*) AS n, regr_slope(y - c * d - g * b, a) AS alpha, any_value(g) AS gamma, any_value(c) AS inverse_d0, regr_intercept(y - c * d - g * b, a) AS logk FROM q, k2)"""


@query("f07_gravity_fit", f"WITH {FIT_WITH} SELECT n, round(logk, 5) AS logk, round(alpha, 6) AS alpha, round(gamma, 6) AS gamma, round(inverse_d0, 6) AS inverse_d0 FROM fit")
def f07(spark, d):
    return gravity.gravity_fit(features(spark, d)).select("n", F.round("logk", 5).alias("logk"), *[F.round(c, 6).alias(c) for c in ("alpha", "gamma", "inverse_d0")])


PREDICTED = """predicted AS (SELECT *, raw * (SELECT sum(w) / sum(raw) FROM r0) AS w_model FROM r0)"""
RAW = "r0 AS (SELECT q.*, exp(logk) * pow(mi, alpha) * pow(mj, gamma) * exp(d * inverse_d0) AS raw FROM q, fit)"


def predicted(spark, d):
    f = features(spark, d)
    return gravity.predict(f, gravity.gravity_fit(f))


@query("f08_gravity_rescale", f"WITH {FIT_WITH}, {RAW}, {PREDICTED} SELECT origin, destination, round(w_model, 4) AS w_model FROM predicted")
def f08(spark, d):
    return rounded(predicted(spark, d).select("origin", "destination", "w_model"), 4)


@query("f14_fit_error_summary", f"WITH {FIT_WITH}, {RAW}, {PREDICTED} SELECT max(w) AS max_flow, round(max(w_model), 3) AS max_model, round(max(abs(w_model - w) / w), 4) AS max_error, round(avg(abs(w_model - w) / w), 4) AS mean_error, sum(w) AS flow, round(sum(w_model), 3) AS model FROM predicted")
def f14(spark, d):
    s = gravity.fit_error_summary(predicted(spark, d))
    return s.select("max_flow", F.round("max_model", 3).alias("max_model"), F.round("max_error", 4).alias("max_error"), F.round("mean_error", 4).alias("mean_error"), "flow", F.round("model", 3).alias("model"))


@query("a07_binned_profile", f"""WITH {FIT_WITH}, {RAW}, {PREDICTED}, e AS (SELECT min(d) AS lo, (max(d) - min(d)) / 20 AS wide FROM predicted),
    b AS (SELECT *, round((d - lo) / wide, 9) AS place FROM predicted, e), g AS (SELECT cast(floor(place) AS BIGINT) AS bin, count(*) AS n, avg(w / (mi * mj)) AS mean, coalesce(2 * stddev_samp(w / (mi * mj)), 0) AS spread, avg(w_model / w) AS r FROM b WHERE place <> floor(place) GROUP BY 1)
    SELECT bin, n, round(mean * 1e6, 4) AS mean, round(spread * 1e6, 3) AS spread, round(r / (SELECT arg_min(r, bin) FROM g), 4) AS ratio FROM g""")
def a07(spark, d):
    p = gravity.binned_profile(predicted(spark, d), 1.0, 1.0, 20)
    return p.select("bin", "n", F.round(F.col("mean") * 1e6, 4).alias("mean"), F.round(F.col("spread") * 1e6, 3).alias("spread"), F.round("ratio", 4).alias("ratio"))


FLOWS = "SELECT z.i AS origin, z.j AS destination, CASE WHEN a.population = 0 OR b.population = 0 OR exp(distance * -0.1::double) <= 1e-4 THEN 0::double ELSE 0.5 * pow(a.population, 0.9::double) * pow(b.population, 0.7::double) * exp(distance * -0.1::double) END AS raw FROM pairs z JOIN cells a ON a.idx = z.i JOIN cells b ON b.idx = z.j"


def modelled(spark, d, cells=None, by=None):
    return gravity.gravity_flows(cells if cells is not None else view(spark, d, "cells"), pairs(spark, d), 0.5, 0.9, 0.7, -0.1, 10000.0, by)


@query("f09_gravity_flows", f"SELECT origin, destination, round(raw * 10000 / sum(raw) OVER (), 5) AS people FROM ({FLOWS})")
def f09(spark, d):
    return rounded(modelled(spark, d), 5)


@query("f10_initial_guesses", f"SELECT round(avg(ln(w) - ln(mi) - ln(mj)), 6) AS logk, round(ln(avg(w / (mi * mi))), 6) AS log_mean_k, round(1 / avg(d) FILTER (d <> 0), 6) AS inverse_d0 FROM ({USABLE})")
def f10(spark, d):
    return rounded(gravity.initial_guesses(features(spark, d)))


@query("f12_gravity_estimate", f"SELECT origin, destination, w, round(mi * mj * exp(-d / 2), 3) AS estimate, mi * mj * exp(-d / 2) >= 10 * max(w) OVER () AS is_error FROM ({FEATURES}) WHERE origin < destination")
def f12(spark, d):
    return rounded(gravity.gravity_estimate(features(spark, d), 2.0), 3)


@query("f13_gravity_features", f"SELECT mi, mj, round(d, 6) AS d, w FROM ({FEATURES}) WHERE origin < destination AND w > 0")
def f13(spark, d):
    return rounded(features(spark, d).filter("origin < destination and w > 0").select("mi", "mj", "d", "w"))


@query("m11_gravity", f"SELECT origin, destination, round(0.01::double * pow(mi, 0.8::double) * pow(mj, 0.6::double) * exp(d * -0.05::double), 6) AS g FROM ({FEATURES})")
def m11(spark, d):
    return rounded(features(spark, d).select("origin", "destination", curves.gravity(F.col("mi"), F.col("mj"), F.col("d"), 0.01, 0.8, 0.6, -0.05).alias("g")))


@query("m12_flux_over_masses", f"SELECT origin, destination, round(w / (pow(mi, 0.8::double) * pow(mj, 0.6::double)), 9) AS g FROM ({FEATURES}) WHERE mi > 0 AND mj > 0")
def m12(spark, d):
    f = features(spark, d).filter("mi > 0 and mj > 0")
    return rounded(f.select("origin", "destination", (F.col("w") / (F.pow("mi", F.lit(0.8)) * F.pow("mj", F.lit(0.6)))).alias("g")), 9)


@query("m13_model_curves", """SELECT p, round(2 * pow(x, -1.5::double), 6) AS pl, round(2 * exp(-0.5::double * x), 6) AS ex, round(1 + 2 * x, 6) AS li, round(exp(-pow(ln(x) - 0.1::double, 2) / 0.5::double) / (x * 0.5::double * sqrt(2 * pi())), 6) AS lognormal,
    round(pow(x, 1.5::double) * exp(-x / 0.7::double) / (gamma(2.5::double) * pow(0.7::double, 2.5::double)), 6) AS gamma_pdf, round(2.0::double / 1.5::double * (x / 1.5::double) * exp(-pow(x / 1.5::double, 2)), 6) AS weibull FROM (SELECT p, distance / 10000 AS x FROM people WHERE distance > 0)""")
def m13(spark, d):
    x = F.col("x")
    rows = view(spark, d, "people").filter("distance > 0").select("p", (F.col("distance") / F.lit(10000.0)).alias("x"))
    return rounded(rows.select("p", curves.power_law(x, F.lit(2.0), F.lit(-1.5)).alias("pl"), curves.exponential(x, F.lit(2.0), F.lit(-0.5)).alias("ex"), curves.linear(x, 1.0, 2.0).alias("li"), curves.lognormal_pdf(x, 0.1, 0.5).alias("lognormal"), curves.gamma_pdf(x, 2.5, 0.7).alias("gamma_pdf"), curves.weibull_pdf(x, 2.0, 1.5).alias("weibull")))


@query("m14_quadratic_loss", f"SELECT round(sum(pow(w - 20, 2)), 3) AS loss FROM ({FEATURES})")
def m14(spark, d):
    return rounded(features(spark, d).agg(F.sum(F.pow(F.col("w") - 20, 2)).alias("loss")), 3)


@query("a08_od_matrix", "SELECT a.idx AS origin, b.idx AS destination, a.i AS oi, a.j AS oj, b.i AS di, b.j AS dj, coalesce(number_people, 0) AS number_people FROM cells a CROSS JOIN cells b LEFT JOIN tij ON origin = a.idx AND destination = b.idx")
def a08(spark, d):
    return gravity.od_matrix(view(spark, d, "tij"), view(spark, d, "cells"))


@query("a10_totals", "SELECT (SELECT cast(sum(population) AS BIGINT) FROM cells) AS population, cast(sum(number_people) AS BIGINT) AS flux, round(sum(number_people) / 3600, 9) AS per_second, round(sum(number_people) / (SELECT sum(population) FROM cells), 9) AS moving FROM tij")
def a10(spark, d):
    pop = view(spark, d, "cells").agg(F.sum("population").alias("population"))
    t = view(spark, d, "tij").agg(F.sum("number_people").alias("flux")).crossJoin(pop)  # one row each
    return rounded(t.select("population", "flux", (F.col("flux") / F.lit(3600.0)).alias("per_second"), (F.col("flux") / F.col("population")).alias("moving")), 9)


@query("a20_gershgorin", "SELECT origin AS i, cast(sum(number_people) FILTER (origin = destination) AS BIGINT) AS center, cast(coalesce(sum(number_people) FILTER (origin <> destination), 0) AS BIGINT) AS radius, cast(sum(number_people) AS BIGINT) AS bound FROM (SELECT * FROM tij UNION ALL SELECT idx, idx, 0 FROM cells) GROUP BY origin")
def a20(spark, d):
    t = view(spark, d, "tij").unionByName(view(spark, d, "cells").select(F.col("idx").alias("origin"), F.col("idx").alias("destination"), F.lit(0).cast("long").alias("number_people")))
    return gravity.gershgorin(t)


@query("a33_pair_matrix", "SELECT i, string_agg(cast(round(distance)::BIGINT AS VARCHAR), ',' ORDER BY j) AS row FROM pairs GROUP BY i")
def a33(spark, d):
    rows = gravity.pair_rows(pairs(spark, d))
    return rows.select("i", F.array_join(F.transform("distances", lambda x: F.round(x).cast("bigint").cast("string")), ",").alias("row"))


@query("t01_top_flows", "SELECT origin, destination, number_people, round(number_people / (SELECT sum(number_people) FROM tij), 9) AS share FROM tij ORDER BY number_people DESC, origin, destination LIMIT 50")
def t01(spark, d):
    return rounded(gravity.top_flows(view(spark, d, "tij"), 50), 9)


@query("d11_proportional_fit", "SELECT idx, round(population * 1000 / (SELECT sum(population) FROM cells), 6) AS population FROM cells")
def d11(spark, d):
    c = view(spark, d, "cells").select("idx", F.col("population").cast("double").alias("population"))
    return rounded(gravity.proportional_fit(c, "population", 1000.0).select("idx", "population"))


INNER = "(SELECT * FROM cells WHERE position = 'inside' AND population > 0)"
PI = f"""SELECT 1 - (SELECT sum(distance * a.population * b.population) FROM pairs z JOIN {INNER} a ON a.idx = z.i JOIN {INNER} b ON b.idx = z.j) / pow((SELECT sum(population) FROM {INNER}), 2) /
    ((SELECT sum(distance) FROM pairs z JOIN cells a ON a.idx = z.i JOIN cells b ON b.idx = z.j WHERE a.relation_to_line = 'edge' AND b.relation_to_line = 'edge') / pow((SELECT count(*) FROM cells WHERE relation_to_line = 'edge'), 2)) AS pi"""
LC = f"SELECT count(*) AS n, cast(floor(round(count(*) + 1 - sum(population) / max(population), 9)) AS BIGINT) AS f_star, floor(round(count(*) + 1 - sum(population) / max(population), 9)) / count(*) AS lc FROM cells"


@query("a13_proximity_index", f"SELECT round(pi, 9) AS pi FROM ({PI})")
def a13(spark, d):
    return rounded(centrality.proximity_index(pairs(spark, d), view(spark, d, "cells"), "population").select("pi"), 9)


@query("a14_pair_energy", """WITH f AS (SELECT idx, CASE WHEN population / (SELECT sum(population) FROM cells) < 1e-7 THEN 0 ELSE population / (SELECT sum(population) FROM cells) END AS f, CASE WHEN relation_to_line = 'edge' THEN 1.0::double / (SELECT count(*) FROM cells WHERE relation_to_line = 'edge') ELSE 0 END AS u FROM cells)
    SELECT round(sum(distance * a.f * b.f) / 2, 9) AS v, round(sum(distance * a.u * b.u) / 2, 9) AS vmax FROM pairs JOIN f a ON a.idx = i JOIN f b ON b.idx = j""")
def a14(spark, d):
    return rounded(centrality.pair_energy(pairs(spark, d), view(spark, d, "cells")), 9)


@query("a15_lorenz_index", f"SELECT n, f_star, round(lc, 9) AS lc FROM ({LC})")
def a15(spark, d):
    return rounded(centrality.lorenz_index(view(spark, d, "cells"), "population"), 9)


@query("a16_uci", f"SELECT round(pi, 9) AS pi, round(lc, 9) AS lc, round(pi * lc, 9) AS uci FROM ({PI}) a, ({LC}) b")
def a16(spark, d):
    return rounded(centrality.uci(pairs(spark, d), view(spark, d, "cells"), "population"), 9)


@query("a12_inhabited_stats", "SELECT round(mi, 6) AS mean_inhabited, round(ma, 6) AS mean_all, count(*) FILTER (population > mi) AS above_inhabited, count(*) FILTER (population > ma) AS above_all, round(count(*) FILTER (population > 0) / count(*), 9) AS inhabited_share, round((SELECT count(*) FROM tij WHERE number_people > 0) / (count(*) * count(*)), 9) AS flow_share FROM cells, (SELECT avg(population) FILTER (population > 0) AS mi, avg(population) AS ma FROM cells) m GROUP BY mi, ma")
def a12(spark, d):
    s = centrality.inhabited_stats(view(spark, d, "cells"), view(spark, d, "tij"))
    return s.select(F.round("mean_inhabited", 6).alias("mean_inhabited"), F.round("mean_all", 6).alias("mean_all"), "above_inhabited", "above_all", F.round("inhabited_share", 9).alias("inhabited_share"), F.round("flow_share", 9).alias("flow_share"))


@query("a21_densest_cell", "SELECT idx, round(cx, 6) AS cx, round(cy, 6) AS cy, population FROM cells ORDER BY population DESC, idx LIMIT 1")
def a21(spark, d):
    return rounded(centrality.densest_cell(view(spark, d, "cells")))


@query("a22_center_of_mass", "SELECT round(avg(population * (cx + 71.16::double)), 6) AS x, round(avg(population * (cy - 42.24::double)), 6) AS y FROM cells")
def a22(spark, d):
    return rounded(centrality.center_of_mass(view(spark, d, "cells"), (-71.16, 42.24)))


@query("w02_lorenz_curve", "SELECT position, row_number() OVER w AS rank, round(row_number() OVER w / count(*) OVER (PARTITION BY position), 9) AS x, round(sum(population) OVER (w ROWS UNBOUNDED PRECEDING) / sum(population) OVER (PARTITION BY position), 9) AS share FROM cells WINDOW w AS (PARTITION BY position ORDER BY population, idx)")
def w02(spark, d):
    return rounded(centrality.lorenz_curve(view(spark, d, "cells"), "population", ["position"]), 9)


@query("w03_centers", "SELECT position, idx, population, rank FROM (SELECT *, row_number() OVER (PARTITION BY position ORDER BY population DESC, idx) AS rank, count(*) OVER (PARTITION BY position) AS n, floor(round(count(*) OVER (PARTITION BY position) + 1 - sum(population) OVER (PARTITION BY position) / max(population) OVER (PARTITION BY position), 9)) AS f FROM cells) WHERE rank <= n - f")
def w03(spark, d):
    return centrality.centers(view(spark, d, "cells"), "population", ["position"])
